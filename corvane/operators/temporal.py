"""State from append-only events, reminders, claims valid at an instant, walks over typed relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLETED, SET, CLEARED = "completed", "deadline_set", "deadline_cleared"


def latest_state(events: DataFrame) -> DataFrame:
    """events (node_id, event_type, value_at, created_at, id, origin) -> node_id, status, completed_at, due_at, origin.

    Completion sticks, its time is that of the latest completion; the deadline is what the latest set or clear leaves.
    """
    order = F.struct("created_at", "id")
    done = F.max_by("created_at", F.when(F.col("event_type") == COMPLETED, order))
    last = F.max_by(F.struct("event_type", "value_at", "origin"), F.when(F.col("event_type").isin(SET, CLEARED), order))
    out = events.groupBy("node_id").agg(done.alias("completed_at"), last.alias("last"))
    return out.select(
        "node_id", F.when(F.col("completed_at").isNotNull(), COMPLETED).otherwise("active").alias("status"), "completed_at",
        F.when(F.col("last.event_type") == SET, F.col("last.value_at")).alias("due_at"), F.col("last.origin").alias("origin"),
    )


def reminders(state: DataFrame, as_of: Column) -> DataFrame:
    due = state.where((F.col("status") == "active") & F.col("due_at").isNotNull())
    return due.select("node_id", "due_at", F.when(F.col("due_at") < as_of, "overdue").otherwise("upcoming").alias("bucket"))


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """Half-open; null is unbounded."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (at < end))


def epistemic_state(subjects: DataFrame, claims: DataFrame, paths: DataFrame, at: Column, healthy: Column) -> DataFrame:
    """subjects (subject), claims (subject, value, ratified, valid_from, valid_to), paths (subject, authorised)."""
    current = claims.where(F.col("ratified") & valid_at(F.col("valid_from"), F.col("valid_to"), at))
    values = current.groupBy("subject").agg(F.count_distinct("value").alias("n"))
    ways = paths.groupBy("subject").agg(F.bool_or("authorised").alias("authorised"))
    state = (
        F.when(~healthy, "retrieval_failure").when(F.col("n") > 1, "conflicting").when(F.col("n") == 1, "supported_current")
        .when(F.col("authorised"), "missing_resolvable").when(F.col("authorised").isNotNull(), "inaccessible").otherwise("missing_unresolved")
    )
    actions = {
        "retrieval_failure": "repair_machine_index_and_retry", "conflicting": "surface_conflict_and_request_ratification", "supported_current": "answer_with_evidence",
        "missing_resolvable": "follow_resolution_path", "inaccessible": "report_blocked_source", "missing_unresolved": "tell_owner_and_request_source",
    }
    action = F.create_map(*[F.lit(x) for kv in actions.items() for x in kv])[F.col("state")]
    return subjects.join(values, "subject", "left").join(ways, "subject", "left").select("subject", state.alias("state")).withColumn("next_action", action)


def walk(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """starts (start), edges (source, predicate, target) -> start, node, depth, path, predicates: every way without a cycle.

    Steps are joins, unrolled to the depth given: each is planned by itself, so a hub is a skewed join that is split.
    """
    found = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.array("start").alias("path"), F.array().cast("array<string>").alias("predicates"))
    out, front = [], found
    for i in range(1, depth + 1):
        step = front.alias("f").join(edges.alias("e"), F.col("f.node") == F.col("e.source")).where(~F.array_contains("f.path", F.col("e.target")))
        front = step.select("start", F.col("e.target").alias("node"), F.lit(i).alias("depth"), F.concat("path", F.array("e.target")).alias("path"), F.concat("predicates", F.array("e.predicate")).alias("predicates"))
        out.append(front)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def with_inverses(relations: DataFrame, names: DataFrame) -> DataFrame:
    """relations (source, predicate, target) and, for predicates that have an inverse (predicate, inverse), the same the other way round."""
    back = relations.join(names, "predicate").select(F.col("target").alias("source"), F.col("inverse").alias("predicate"), F.col("source").alias("target"))
    return relations.unionByName(back)

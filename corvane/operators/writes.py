"""Writes as plans: what a request would append, what it would only report, what it is refused for.

A table is append-only; a later state is an overlay by key. Requests are rows, and a bad one never fails its neighbours:
each gets an outcome.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import redact
from corvane.operators import ingest as I
from corvane.operators import temporal as G

BLANK = r"^\s*$"
#: How many issues of a refused archive are reported, and which fields are never scrubbed.
MOST_ISSUES, EXEMPT = 20, ("source_id", "relation.receipt_id")


def filled(c: str | Column) -> Column:
    return ~F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")).rlike(BLANK)


def node_issue(title: Column, raw: Column, connections: Column) -> Column:
    """Why a node is refused, null if it isn't: the first of the rules. connections: array of struct(target, why)."""
    return (
        F.when(~filled(title), "title is required").when(~filled(raw), "raw is required")
        .when(F.exists(connections, lambda c: ~filled(c["target"])), "connection target is required").when(F.exists(connections, lambda c: ~filled(c["why"])), "every connection needs a why")
    )


def add_nodes(requests: DataFrame, receipts: DataFrame) -> DataFrame:
    """requests (request_id, title, raw, body, connections), receipts (request_id, digest)
    -> request_id, digest, outcome (refused, stored, replayed, conflict), issue, title, raw, body. The body falls back to the raw words."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("title", "raw", "body")]
    rows = requests.withColumn("digest", F.sha2(F.to_json(F.array(*fields, F.to_json("connections"))), 256))
    rows = rows.withColumn("issue", node_issue(F.col("title"), F.col("raw"), F.col("connections"))).withColumn("body", F.when(filled("body"), F.col("body")).otherwise(F.col("raw")))
    outcomes = I.receipt_outcome(rows.select("request_id", "digest"), receipts)
    outcome = F.when(F.col("issue").isNotNull(), "refused").otherwise(F.col("outcome"))
    return rows.join(outcomes, "request_id").select("request_id", "digest", outcome.alias("outcome"), "issue", F.trim("title").alias("title"), "raw", "body")


def complete_nodes(asked: DataFrame, nodes: DataFrame, events: DataFrame) -> DataFrame:
    """asked (request_id, node_id), repeats allowed; nodes (node_id); events of latest_state
    -> request_id, node_id, outcome: not_found for all of a request that names a node there isn't, else completed or already_completed."""
    asked = asked.distinct()
    wanted = asked.select("node_id").distinct()
    known = nodes.join(wanted, "node_id", "left_semi").select("node_id", F.lit(True).alias("there"))
    state = G.latest_state(events.join(wanted, "node_id", "left_semi")).select("node_id", "status")
    rows = asked.join(known, "node_id", "left").join(state, "node_id", "left")
    missing = F.max(F.col("there").isNull()).over(Window.partitionBy("request_id"))
    outcome = F.when(missing, "not_found").when(F.col("status") == G.COMPLETED, "already_completed").otherwise("completed")
    return rows.select("request_id", "node_id", outcome.alias("outcome"))


def overlay(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """rows with column as the latest change (key, at, value) leaves it; a change to null clears it."""
    last = changes.groupBy(key).agg(F.max_by(F.struct("value"), F.struct("at", "value")).alias("last"))
    value = F.when(F.col("last").isNotNull(), F.col("last.value")).otherwise(F.col(column))
    return rows.join(last, key, "left").withColumn(column, value).select(*rows.columns)


def set_once(rows: DataFrame, marks: DataFrame, key: str, column: str) -> DataFrame:
    """rows with column set to the first mark (key, at) where it was null: later marks change nothing."""
    first = marks.groupBy(key).agg(F.min("at").alias("first_at"))
    return rows.join(first, key, "left").withColumn(column, F.coalesce(column, "first_at")).select(*rows.columns)


def add_batches(items: DataFrame, atomic: str | None = None) -> DataFrame:
    """items (..., issue) -> with outcome: stored or refused, item by item, or for all that share `atomic` if one of them is refused."""
    bad = F.col("issue").isNotNull()
    refused = bad if atomic is None else F.max(bad).over(Window.partitionBy(atomic))
    return items.withColumn("outcome", F.when(bad, "refused").when(refused, "rolled_back").otherwise("stored"))


def scrub_struct(rows: DataFrame, column: str) -> DataFrame:
    """The strings of a nested column as path, value, clean, reasons: what redaction would change, fields with identifiers left out.

    Fields are walked by their type, arrays by their places.
    """
    from pyspark.sql import types as T

    def leaves(c: Column, kind, path: Column) -> list[Column]:
        if isinstance(kind, T.StringType):
            return [F.array(F.struct(path.alias("path"), c.alias("value")))]
        if isinstance(kind, T.StructType):
            dot = F.when(path == "", "").otherwise(F.concat(path, F.lit(".")))
            return [x for f in kind.fields for x in leaves(c[f.name], f.dataType, F.concat(dot, F.lit(f.name)))]
        if isinstance(kind, T.ArrayType):
            inner = lambda x, i: F.concat(*leaves(x, kind.elementType, F.concat(path, F.lit("."), i.cast("string"))))
            return [F.coalesce(F.flatten(F.transform(c, inner)), F.array())] if leaves(F.lit(None), kind.elementType, path) else []
        return []

    found = rows.withColumn("leaf", F.explode(F.concat(*leaves(F.col(column), rows.schema[column].dataType, F.lit(""))))).where("leaf.value is not null")
    value, exempt = F.col("leaf.value"), F.col("leaf.path").isin(*EXEMPT)
    return found.select(
        *[c for c in rows.columns if c != column], F.col("leaf.path").alias("path"), value.alias("value"),
        F.when(exempt, value).otherwise(redact.scrub(value)).alias("clean"), F.when(exempt, F.array().cast("array<string>")).otherwise(redact.reasons(value)).alias("reasons"),
    )


def issue_report(rows: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows, rules (code -> path, broken) -> with issues (array of struct(path, code), at most MOST_ISSUES) and valid."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"))) for code, (path, broken) in rules.items()]))
    return rows.withColumn("issues", F.slice(found, 1, MOST_ISSUES)).withColumn("valid", F.size("issues") == 0)


def verify_archive(records: DataFrame, messages: DataFrame, quotes: DataFrame) -> DataFrame:
    """records (key, digest), messages (key, ordinal, text), quotes (key, ordinal, text) as stored
    -> key, digest_ok, order_ok: the digest made again of the messages, and whether the quotes are these texts in this order."""
    of = lambda rows, name: rows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda m: m["text"]).alias(name))
    rows = records.join(of(messages, "m"), "key", "left").join(of(quotes, "q"), "key", "left")
    return rows.select("key", F.coalesce(F.sha2(F.to_json("m"), 256) == F.col("digest"), F.lit(False)).alias("digest_ok"), F.col("m").eqNullSafe(F.col("q")).alias("order_ok"))


def import_outcome(requests: DataFrame, receipts: DataFrame, related: DataFrame) -> DataFrame:
    """requests (request_id, digest, authorised, valid, excluded, relation), receipts (request_id, digest), related (request_id of what may be referred to)
    -> request_id, outcome: the first check that fails, in the order that an import makes them."""
    known = I.receipt_outcome(requests.select("request_id", "digest"), receipts)
    there = related.select(F.col("request_id").alias("relation"), F.lit(True).alias("found")).distinct()
    rows = requests.join(known, "request_id").join(there, "relation", "left")
    checks = [(~F.col("authorised"), "forbidden"), (~F.col("valid"), "invalid"), (F.col("excluded"), "excluded"), (F.col("outcome") != "stored", None), (F.col("relation").isNotNull() & F.col("found").isNull(), "relation_missing")]
    outcome = reduce(lambda rest, check: F.when(check[0], F.col("outcome") if check[1] is None else F.lit(check[1])).otherwise(rest), reversed(checks), F.lit("stored"))
    return rows.select("request_id", outcome.alias("outcome"))


def trace_state(starts: DataFrame, finishes: DataFrame, reports: DataFrame) -> DataFrame:
    """starts (trace, at, operation), finishes (trace, at, outcome), reports (trace, stage) -> one row a trace: state, milliseconds, reports.

    A finish without a start is a trace too; of several starts or finishes the first counts.
    """
    first = lambda rows, *columns: rows.groupBy("trace").agg(F.min_by(F.struct(*columns), F.struct("at", *columns)).alias("f")).select("trace", *[F.col(f"f.{c}") for c in columns])
    s = first(starts, "at", "operation").withColumnRenamed("at", "started")
    f = first(finishes, "at", "outcome").withColumnRenamed("at", "finished")
    n = reports.groupBy("trace").agg(F.count(F.lit(1)).alias("reports"))
    rows = s.join(f, "trace", "full").join(n, "trace", "left")
    state = F.when(F.col("started").isNull(), "orphan").when(F.col("finished").isNull(), "incomplete").when(F.col("finished") < F.col("started"), "out_of_order").otherwise(F.col("outcome"))
    ms = F.round((F.unix_micros(F.col("finished").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1000, 3)
    return rows.select("trace", "operation", state.alias("state"), ms.alias("ms"), F.coalesce("reports", F.lit(0)).alias("reports"))


def rotation(candidates: DataFrame, after: str | None, limit: int, key: str = "id") -> DataFrame:
    """The next `limit` candidates in the order of their keys, beginning after a cursor and going round; nth counts from 1.

    The cursor is a hint: one that is past the end, or of a candidate that is gone, changes only where the round begins.
    """
    past = F.lit(False) if after is None else F.col(key) > after
    head = candidates.withColumn("wrapped", ~past).orderBy("wrapped", key).limit(limit)
    return head.withColumn("nth", F.row_number().over(Window.orderBy("wrapped", key))).drop("wrapped")


def changed_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """files (path, version, mtime, size) that the ledger of what was read doesn't hold with all four alike."""
    return files.join(ledger.select("path", "version", "mtime", "size"), ["path", "version", "mtime", "size"], "left_anti")


def run_cycle(steps: dict[str, Column], failed: set[str]) -> Column:
    """Outcomes of the steps of a scheduled cycle: a step that fails is isolated, the others run."""
    return F.array(*[F.struct(F.lit(name).alias("step"), F.when(F.lit(name in failed), "failed").otherwise(work).alias("outcome")) for name, work in steps.items()])


def resume(done: DataFrame, work: DataFrame) -> DataFrame:
    """done (qid, digest, line): lines appended by earlier runs, the later the truer; work (qid, digest) -> what is still to do."""
    last = done.groupBy("qid").agg(F.max_by("digest", "line").alias("digest"))
    return work.join(last, ["qid", "digest"], "left_anti")


def restamp(items: DataFrame, stored: DataFrame) -> DataFrame:
    """items (id, locator, stamp), stored (locator) -> id, action: what a repeated run does with each.

    A stored item that is stamped is left alone; one without a stamp was broken off half-way and is only stamped again.
    """
    there = stored.select("locator", F.lit(True).alias("there")).distinct()
    action = F.when(F.col("there").isNull(), "insert").when(F.col("stamp").isNull(), "stamp").otherwise("skip")
    return items.join(there, "locator", "left").select("id", action.alias("action"))


def ingest_counters(rows: DataFrame, by: str, status: str, names: list[str]) -> DataFrame:
    """How many rows of a source went which way; every way has its column, so a way that nothing went is 0."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("scanned"), *[F.count_if(F.col(status) == n).alias(n) for n in names])

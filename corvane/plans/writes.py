"""Queries of writes, imports, validation and ingestion control."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import redact
from corvane.operators import ingest as I
from corvane.operators import writes as W
from corvane.plans.registry import query
from corvane.plans.state import _STATE, state_events
from corvane.sources import table

_NODES = """r AS (SELECT conv_id, turn, conv_id || ':' || turn AS request_id, CASE WHEN turn % 6 = 1 THEN ' ' ELSE 'turn ' || turn END AS title, CASE WHEN turn % 6 = 2 THEN '' ELSE text END AS raw, CASE WHEN turn % 2 = 0 THEN 'read ' || turn END AS body,
 CASE turn % 6 WHEN 3 THEN '' WHEN 5 THEN 'n1' ELSE 'n2' END AS target, CASE turn % 6 WHEN 4 THEN ' ' ELSE 'because' END AS why FROM conversations)"""


def _requests(spark, d):
    t = F.col("turn")
    connection = F.struct(F.when(t % 6 == 3, "").when(t % 6 == 5, "n1").otherwise("n2").alias("target"), F.when(t % 6 == 4, " ").otherwise("because").alias("why"))
    return table(spark, d, "conversations").select(
        F.concat("conv_id", F.lit(":"), "turn").alias("request_id"), F.when(t % 6 == 1, " ").otherwise(F.concat(F.lit("turn "), t)).alias("title"), F.when(t % 6 == 2, "").otherwise(F.col("text")).alias("raw"),
        F.when(t % 2 == 0, F.concat(F.lit("read "), t)).alias("body"), F.array(connection).alias("connections"), "conv_id", t,
    )


_ISSUE = "CASE WHEN trim(title) = '' THEN 'title is required' WHEN raw = '' THEN 'raw is required' WHEN target = '' THEN 'connection target is required' WHEN trim(why) = '' THEN 'every connection needs a why' END"


@query("node_validation", f"WITH {_NODES} SELECT request_id, {_ISSUE} AS issue FROM r")
def node_validation(spark, d):
    return _requests(spark, d).select("request_id", W.node_issue(F.col("title"), F.col("raw"), F.col("connections")).alias("issue"))


@query("add_nodes", f"""WITH {_NODES}, i AS (SELECT *, {_ISSUE} AS issue FROM r)
SELECT request_id, CASE WHEN issue IS NOT NULL THEN 'refused' WHEN conv_id % 5 = 0 THEN 'replayed' WHEN conv_id % 5 = 1 THEN 'conflict' ELSE 'stored' END AS outcome, issue, trim(title) AS title, md5(coalesce(body, raw)) AS body FROM i""")
def add_nodes(spark, d):
    """Requests to write nodes, some of them sent before: a fifth as they were, a fifth with other words."""
    requests = _requests(spark, d)
    before = requests.where("conv_id % 5 = 0").unionByName(requests.where("conv_id % 5 = 1").withColumn("raw", F.concat("raw", F.lit("!"))))
    empty = spark.createDataFrame([], "request_id string, digest string")
    receipts = W.add_nodes(before, empty).select("request_id", "digest")
    return W.add_nodes(requests, receipts).select("request_id", "outcome", "issue", "title", F.md5(F.col("body").cast("binary")).alias("body"))


@query("mark_complete", _STATE + """, n AS (SELECT DISTINCT user_id, node_id FROM (SELECT user_id, user_id || '-' || json_extract_string(props, '$.k') AS node_id FROM events WHERE event_id % 11 = 0)),
a AS (SELECT user_id AS request_id, node_id FROM n UNION ALL SELECT DISTINCT user_id, 'nowhere' FROM n WHERE user_id % 4 = 0), j AS (SELECT a.request_id, a.node_id, s.node_id IS NULL AS missing, s.status FROM a LEFT JOIN state s USING (node_id))
SELECT request_id, node_id, CASE WHEN bool_or(missing) OVER (PARTITION BY request_id) THEN 'not_found' WHEN status = 'completed' THEN 'already_completed' ELSE 'completed' END AS outcome FROM j""")
def mark_complete(spark, d):
    """A user's request names nodes, some twice; one in four also names a node that there isn't."""
    named = table(spark, d, "events").where("event_id % 11 = 0").select(F.col("user_id").alias("request_id"), F.concat("user_id", F.lit("-"), F.get_json_object("props", "$.k")).alias("node_id"))
    asked = named.unionByName(named.where("request_id % 4 = 0").withColumn("node_id", F.lit("nowhere")))
    events = state_events(spark, d)
    return W.complete_nodes(asked, events.select("node_id").distinct(), events)


@query("deadline_overlay", "WITH c AS (SELECT user_id, arg_max({'v': CASE WHEN event_type = 'error' THEN NULL ELSE floor(value)::BIGINT END}, (ts, event_id)) AS l FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id) SELECT c_custkey, CASE WHEN c.user_id IS NULL THEN c_nationkey::BIGINT ELSE l.v END AS due FROM customer LEFT JOIN c ON user_id = c_custkey")
def deadline_overlay(spark, d):
    """Values set and cleared by later events: what the latest one left."""
    changes = table(spark, d, "events").where("event_type in ('signup', 'error')")
    changes = changes.select(F.col("user_id").alias("c_custkey"), F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "signup", F.floor("value").cast("long")).alias("value"))
    return W.overlay(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("due")), changes, "c_custkey", "due")


@query("sender_deleted_once", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '2020-01-01' END, m) AS deleted_at FROM customer LEFT JOIN (SELECT user_id, min(ts) AS m FROM events WHERE event_type = 'error' GROUP BY user_id) ON user_id = c_custkey")
def sender_deleted_once(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.lit("2020-01-01").cast("timestamp_ntz")).alias("deleted_at"))
    marks = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("c_custkey"), F.col("ts").cast("timestamp_ntz").alias("at"))
    return W.set_once(rows, marks, "c_custkey", "deleted_at")


@query("evidence_batches", f"""WITH {_NODES}, i AS (SELECT *, {_ISSUE} AS issue FROM r)
SELECT request_id, CASE WHEN issue IS NOT NULL THEN 'refused' ELSE 'stored' END AS one_by_one, CASE WHEN issue IS NOT NULL THEN 'refused' WHEN bool_or(issue IS NOT NULL) OVER (PARTITION BY conv_id) THEN 'rolled_back' ELSE 'stored' END AS all_or_nothing FROM i""")
def evidence_batches(spark, d):
    """A list of items that succeed or fail each for itself, and one that is stored whole or not at all."""
    items = _requests(spark, d).withColumn("issue", W.node_issue(F.col("title"), F.col("raw"), F.col("connections")))
    return W.add_batches(W.add_batches(items).withColumnRenamed("outcome", "one_by_one"), "conv_id").select("request_id", "one_by_one", F.col("outcome").alias("all_or_nothing"))


@query("import_archives", """WITH c AS (SELECT conv_id, count(*) AS n, bool_or(contains(lower(text), 'tion')) AS excluded FROM conversations GROUP BY conv_id)
SELECT conv_id AS request_id, CASE WHEN conv_id % 11 = 0 THEN 'forbidden' WHEN n < 3 THEN 'invalid' WHEN excluded THEN 'excluded' WHEN conv_id % 7 = 1 THEN 'replayed' WHEN conv_id % 7 = 2 THEN 'conflict' WHEN conv_id % 7 = 3 AND conv_id + 5 NOT IN (SELECT conv_id FROM c) THEN 'relation_missing' ELSE 'stored' END AS outcome FROM c""")
def import_archives(spark, d):
    """Conversations as archives to import, checked in order: who asks, the rules, exclusions, what is known, what is referred to."""
    c = table(spark, d, "conversations")
    i = F.col("conv_id")
    r = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max(I.excluded(F.col("text"), F.lit(""), F.lit("word"), F.lit("TION"))).alias("excluded"))
    requests = r.select(i.alias("request_id"), F.sha2(i.cast("string"), 256).alias("digest"), (i % 11 != 0).alias("authorised"), (F.col("n") >= 3).alias("valid"), "excluded", F.when(i % 7 == 3, i + 5).alias("relation"))
    receipts = r.where("conv_id % 7 in (1, 2)").select(i.alias("request_id"), F.when(i % 7 == 2, "other").otherwise(F.sha2(i.cast("string"), 256)).alias("digest"))
    return W.import_outcome(requests, receipts, r.select(i.alias("request_id")))


_MESSAGES = "m AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 3 AND turn = 1 THEN 'changed' ELSE md5(text) END AS text, CASE WHEN conv_id % 4 = 2 THEN -turn ELSE turn END AS stored_at, md5(text) AS quote FROM conversations)"


@query("verify_archives", f"""WITH {_MESSAGES}, g AS (SELECT conv_id, '["' || string_agg(text, '","' ORDER BY turn) || '"]' AS now, '["' || string_agg(quote, '","' ORDER BY turn) || '"]' AS was, list(text ORDER BY turn) AS a, list(quote ORDER BY stored_at) AS b FROM m GROUP BY conv_id)
SELECT conv_id AS key, sha256(now) = sha256(was) AS digest_ok, a = b AS order_ok FROM g""")
def verify_archives(spark, d):
    """Archives against their digest and their stored quotes: in some a message was changed, in some the order."""
    c, i = table(spark, d, "conversations"), F.col("conv_id")
    quote = F.md5(F.col("text").cast("binary"))
    messages = c.select(i.alias("key"), F.col("turn").alias("ordinal"), F.when((i % 5 == 3) & (F.col("turn") == 1), "changed").otherwise(quote).alias("text"))
    quotes = c.select(i.alias("key"), F.when(i % 4 == 2, -F.col("turn")).otherwise(F.col("turn")).alias("ordinal"), quote.alias("text"))
    first = c.select(i.alias("key"), F.col("turn").alias("ordinal"), quote.alias("text"))
    listed = first.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda m: m["text"]).alias("m"))
    return W.verify_archive(listed.select("key", F.sha2(F.to_json("m"), 256).alias("digest")), messages, quotes)


_ARCHIVES = """a AS (SELECT conv_id AS key, count(*) AS n, count(DISTINCT role) AS ids, CASE conv_id % 3 WHEN 0 THEN 'model_assembled' WHEN 1 THEN 'source_export' ELSE 'user_paste' END AS kind, CASE WHEN conv_id % 2 = 0 THEN 'complete' ELSE 'partial' END AS completeness,
 CASE WHEN conv_id % 4 < 2 THEN 0 ELSE 1 END AS limitations, conv_id % 5 = 0 AS has_original, conv_id % 7 AS lo, conv_id % 6 AS hi, conv_id % 9 AS ordinal FROM conversations GROUP BY conv_id),
i AS (SELECT key, list_filter([CASE WHEN kind = 'model_assembled' AND completeness = 'complete' THEN 'assembly_not_complete' END, CASE WHEN kind = 'model_assembled' AND limitations = 0 THEN 'limitations_missing' END, CASE WHEN has_original AND kind <> 'source_export' THEN 'original_needs_export' END,
 CASE WHEN lo > hi THEN 'dates_reversed' END, CASE WHEN ids < n THEN 'message_ids_repeat' END, CASE WHEN ordinal >= n THEN 'ordinal_out_of_range' END], lambda x: x IS NOT NULL) AS issues FROM a)"""


def _archives(spark, d):
    """Conversations as archives that break each rule in some of them: a message's id is its role, so ids repeat."""
    i, day = F.col("conv_id"), lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")).cast("timestamp")
    a = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("role")).alias("message_ids"))
    return a.select(
        i.alias("key"), F.when(i % 3 == 0, "model_assembled").when(i % 3 == 1, "source_export").otherwise("user_paste").alias("kind"), F.when(i % 2 == 0, "complete").otherwise("partial").alias("completeness"),
        F.when(i % 4 < 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("sampled"))).alias("limitations"), day(i % 7).alias("from_at"), day(i % 6).alias("until_at"), (i % 5 == 0).alias("has_original"),
        "message_ids", F.array((i % 9).cast("int")).alias("ordinals"),
    )


@query("archive_validation", f"WITH {_ARCHIVES} SELECT key, array_to_string(issues, ',') AS issues FROM i")
def archive_validation(spark, d):
    return I.validate_transfer(_archives(spark, d)).select("key", F.array_join("issues", ",").alias("issues"))


@query("archive_issue_report", f"""WITH {_ARCHIVES}, p AS (SELECT key, list_transform(issues, lambda c: CASE c WHEN 'assembly_not_complete' THEN 'coverage.completeness' WHEN 'limitations_missing' THEN 'coverage.limitations' WHEN 'original_needs_export' THEN 'original' WHEN 'dates_reversed' THEN 'coverage.until' WHEN 'message_ids_repeat' THEN 'messages' ELSE 'reflection.message_ordinals' END || '=' || c) AS l FROM i)
SELECT key, array_to_string(l, ';') AS report, len(l) = 0 AS valid FROM p""")
def archive_issue_report(spark, d):
    """Where an archive is wrong, by paths that are safe to show."""
    made, n = F.col("kind") == "model_assembled", F.size("message_ids")
    rules = {
        "assembly_not_complete": ("coverage.completeness", made & (F.col("completeness") == "complete")), "limitations_missing": ("coverage.limitations", made & (F.size("limitations") == 0)),
        "original_needs_export": ("original", F.col("has_original") & (F.col("kind") != "source_export")), "dates_reversed": ("coverage.until", F.col("from_at") > F.col("until_at")),
        "message_ids_repeat": ("messages", F.size(F.array_distinct("message_ids")) < n), "ordinal_out_of_range": ("reflection.message_ordinals", F.exists("ordinals", lambda o: o >= n)),
    }
    told = W.issue_report(_archives(spark, d), rules)
    return told.select("key", F.array_join(F.transform("issues", lambda i: F.concat(i["path"], F.lit("="), i["code"])), ";").alias("report"), "valid")


@query("recursive_scrub", r"""WITH t AS (SELECT conv_id, 'source_id' AS path, '123-45-6789' AS value FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id, 'source.title', 'id 123-45-6789' FROM conversations GROUP BY conv_id
UNION ALL SELECT conv_id, 'messages.' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || '.text', 'turn ' || turn || CASE WHEN turn % 2 = 0 THEN ' 987-65-4321' ELSE '' END FROM conversations)
SELECT conv_id, path, CASE WHEN path = 'source_id' THEN value ELSE regexp_replace(value, '\b\d{3}-\d{2}-\d{4}\b', '[REDACTED:ssn_pattern]', 'g') END AS clean, path <> 'source_id' AND regexp_matches(value, '\b\d{3}-\d{2}-\d{4}\b') AS changed FROM t""")
def recursive_scrub(spark, d):
    """Numbers taken out of every string of a nested archive, wherever it stands, but not out of identifiers."""
    text = F.concat(F.lit("turn "), "turn", F.when(F.col("turn") % 2 == 0, " 987-65-4321").otherwise(""))
    a = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", text.alias("text")))).alias("messages"))
    a = a.select("conv_id", F.struct(F.lit("123-45-6789").alias("source_id"), F.struct(F.lit("id 123-45-6789").alias("title")).alias("source"), "messages").alias("a"))
    return W.scrub_struct(a, "a").select("conv_id", "path", "clean", (F.size("reasons") > 0).alias("changed"))


@query("trace_states", """WITH s AS (SELECT user_id, arg_min({'at': ts, 'operation': json_extract_string(props, '$.k')}, (ts, json_extract_string(props, '$.k'))) AS f FROM events WHERE event_type = 'view' GROUP BY user_id),
f AS (SELECT user_id, arg_min({'at': ts, 'outcome': CASE WHEN value > 50 THEN 'ok' ELSE 'error' END}, (ts, CASE WHEN value > 50 THEN 'ok' ELSE 'error' END)) AS f FROM events WHERE event_type = 'purchase' GROUP BY user_id), n AS (SELECT user_id, count(*) AS reports FROM events WHERE event_type = 'error' GROUP BY user_id),
j AS (SELECT user_id, s.f.at AS started, s.f.operation AS operation, f.f.at AS finished, f.f.outcome AS outcome FROM s FULL JOIN f USING (user_id))
SELECT user_id AS trace, operation, CASE WHEN started IS NULL THEN 'orphan' WHEN finished IS NULL THEN 'incomplete' WHEN finished < started THEN 'out_of_order' ELSE outcome END AS state, round((epoch_us(finished) - epoch_us(started)) / 1000, 3) AS ms, coalesce(reports, 0) AS reports FROM j LEFT JOIN n USING (user_id)""")
def trace_states(spark, d):
    e = table(spark, d, "events")
    of = lambda kind: e.where(F.col("event_type") == kind).withColumn("trace", F.col("user_id"))
    starts = of("view").select("trace", F.col("ts").alias("at"), F.get_json_object("props", "$.k").alias("operation"))
    finishes = of("purchase").select("trace", F.col("ts").alias("at"), F.when(F.col("value") > 50, "ok").otherwise("error").alias("outcome"))
    return W.trace_state(starts, finishes, of("error").select("trace"))


@query("fair_rotation", "WITH q AS (SELECT c_name AS id, NOT c_name > 'Customer#000000100' AS wrapped FROM customer) SELECT id, nth::INTEGER AS nth FROM (SELECT id, row_number() OVER (ORDER BY wrapped, id) AS nth FROM q) WHERE nth <= 60")
def fair_rotation(spark, d):
    """The next sixty after the one that was read last, and from the beginning again."""
    return W.rotation(table(spark, d, "customer").select(F.col("c_name").alias("id")), "Customer#000000100", 60)


@query("unchanged_files", "SELECT doc_id AS path FROM documents WHERE NOT (doc_id % 3 <> 0 AND doc_id % 5 <> 1 AND doc_id % 7 <> 2)")
def unchanged_files(spark, d):
    """Files that aren't in the ledger as they are now: never read, read by an older parser, or grown since."""
    i = F.col("doc_id")
    files = table(spark, d, "documents").select(i.alias("path"), F.lit(4).alias("version"), F.lit(17).alias("mtime"), F.col("n_chars").alias("size"))
    ledger = files.where("path % 3 <> 0").withColumn("version", F.when(F.col("path") % 5 == 1, 3).otherwise(4)).withColumn("size", F.col("size") - F.when(F.col("path") % 7 == 2, 1).otherwise(0))
    return W.changed_files(files, ledger).select("path")


@query("scheduled_cycle", "SELECT unnest(['ingest', 'watch_items', 'embedding']) AS step, unnest(['ran', 'failed', 'ran']) AS outcome")
def scheduled_cycle(spark, d):
    """Three steps of a cycle; what goes wrong in one doesn't stop the others."""
    steps = {"ingest": lambda: table(spark, d, "conversations").count(), "watch_items": lambda: 1 // 0, "embedding": lambda: table(spark, d, "embeddings").count()}
    failed = set()
    for name, work in steps.items():
        try:
            work()
        except Exception:  # a step may fail in any way; its name is what the cycle reports
            failed.add(name)
    return spark.range(1).select(F.inline(W.run_cycle({name: F.lit("ran") for name in steps}, failed)))


@query("resume_checkpoint", "SELECT item_id AS qid FROM benchmark WHERE NOT (item_id % 3 <> 0 AND item_id % 4 <> 1)")
def resume_checkpoint(spark, d):
    """Questions that no line of an earlier run answers as they are asked now; the last line of a question counts."""
    digest = F.md5(F.col("text").cast("binary"))
    work = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), digest.alias("digest"))
    done = work.where("qid % 3 <> 0").withColumn("line", F.lit(1)).unionByName(work.where("qid % 4 = 1").select("qid", F.lit("older text").alias("digest"), F.lit(2).alias("line")))
    return W.resume(done, work).select("qid")


@query("retry_convergence", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'insert' WHEN event_id % 2 = 0 THEN 'stamp' ELSE 'skip' END AS action FROM events")
def retry_convergence(spark, d):
    """What a run does with items after one that broke off: a third was never stored, half of the rest not stamped."""
    e = F.col("event_id")
    items = table(spark, d, "events").select(e.alias("id"), F.concat(F.lit("item:"), e).alias("locator"), F.when(e % 2 == 1, F.col("ts")).alias("stamp"))
    return W.restamp(items, items.where("id % 3 <> 0").select("locator"))


_STATUS = "CASE WHEN n_chars < 200 THEN 'deferred' WHEN doc_id % 4 = 0 THEN 'unchanged' ELSE 'attempted' END"


@query("ingest_counters", f"SELECT source, count(*) AS scanned, count_if(s = 'attempted')::BIGINT AS attempted, count_if(s = 'deferred')::BIGINT AS deferred, count_if(s = 'unchanged')::BIGINT AS unchanged, count_if(s = 'failed')::BIGINT AS failed FROM (SELECT source, {_STATUS} AS s FROM documents) GROUP BY source")
def ingest_counters(spark, d):
    return W.ingest_counters(table(spark, d, "documents").select("source", F.expr(_STATUS).alias("status")), "source", "status", ["attempted", "deferred", "unchanged", "failed"])


@query("redaction_reasons", r"SELECT conv_id, turn, CASE WHEN regexp_matches(q, '\b\d{3}-\d{2}-\d{4}\b') THEN '[REDACTED:ssn_pattern]' WHEN turn % 5 = 1 THEN '[REDACTED:credit_card_pattern]' ELSE q END AS quote FROM (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN text || ' 123-45-6789' WHEN 1 THEN 'card 4111 1111 1111 1111' WHEN 2 THEN 'no card 4111 1111 1111 1112' ELSE 'plain ' || turn END AS q FROM conversations)")
def redaction_reasons(spark, d):
    """Quotes that hold a number that must go are replaced whole, by the first reason; one with a wrong check digit stays."""
    t = F.col("turn")
    q = F.when(t % 5 == 0, F.concat("text", F.lit(" 123-45-6789"))).when(t % 5 == 1, "card 4111 1111 1111 1111").when(t % 5 == 2, "no card 4111 1111 1111 1112").otherwise(F.concat(F.lit("plain "), t))
    return table(spark, d, "conversations").select("conv_id", "turn", redact.redact_quote(q).alias("quote"))

"""Queries of the transcript, clipping and archive readers, on files made of the conversations, and of question scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators.scope import Scope, plan
from corvane.plans.registry import query
from corvane.sources import table
from corvane.sources import transcripts as T


def _files(rows, by: str, order: str, line) -> object:
    """One file a session: its lines in order."""
    listed = rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"]).alias("l"))
    return listed.select(F.concat(F.lit("file-"), by).alias("path"), F.array_join("l", "\n").alias("value"))


_SPOKEN = """c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'owner' ELSE 'assistant' END AS speaker, CASE WHEN role = 'user' OR turn % 2 = 1 THEN 't' || turn ELSE '' END AS text, CASE WHEN role = 'user' THEN 0 ELSE turn % 3 END AS calls FROM conversations WHERE {where}),
t AS (SELECT *, sum(calls) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM c), s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, total - coalesce(lag(total) OVER (PARTITION BY conv_id, speaker ORDER BY turn), 0) AS o, bool_or(speaker = 'owner') OVER (PARTITION BY conv_id) AS person FROM t WHERE text <> '')
SELECT 'file-' || conv_id AS path, place::INTEGER AS turn, speaker, text, CASE WHEN speaker = 'owner' THEN 0 ELSE o END::INTEGER AS omitted FROM s WHERE person"""


@query("chat_transcripts", "WITH " + _SPOKEN.format(where="role <> 'system' AND turn % 5 <> 4"))
def chat_transcripts(spark, d):
    """First dialect: talk in blocks, tool calls between, turns that aren't talk, injected blocks, and a broken line."""
    t = F.col("turn")
    text = F.when((F.col("role") == "user") | (t % 2 == 1), F.concat(F.lit("t"), t)).otherwise("")
    calls = F.transform(F.sequence(F.lit(0), (t % 3).cast("int")), lambda i: F.when(i > 0, F.lit('{"type":"tool_use"}')))
    said = F.concat(F.lit('{"type":"text","text":"'), text, F.lit('"}'))
    blocks = F.array_join(F.concat(F.array_compact(calls), F.array(said)), ",")
    person = F.concat(F.lit('{"type":"user","message":{"content":"'), text, F.lit('<system-reminder>no</system-reminder>"}}'))
    reply = F.concat(F.lit('{"type":"assistant","message":{"content":['), blocks, F.lit("]}}"))
    meta = F.lit('{"type":"user","isMeta":true,"message":{"content":"not talk"}}')
    line = F.when(F.col("role") == "system", "{broken").when(t % 5 == 4, meta).when(F.col("role") == "user", person).otherwise(reply)
    return T.chat_turns(_files(table(spark, d, "conversations"), "conv_id", "turn", line)).select("path", "turn", "speaker", "text", "omitted")


@query("rollout_transcripts", "WITH " + _SPOKEN.format(where="role <> 'system'"))
def rollout_transcripts(spark, d):
    """Second dialect: calls are entries of their own, before what was said."""
    t, item = F.col("turn"), lambda p: F.concat(F.lit('{"type":"response_item","payload":'), p, F.lit("}"))
    text = F.when((F.col("role") == "user") | (t % 2 == 1), F.concat(F.lit("t"), t)).otherwise("")
    call = item(F.lit('{"type":"function_call"}'))
    calls = F.array_compact(F.transform(F.sequence(F.lit(0), (t % 3).cast("int")), lambda i: F.when(i > 0, call)))
    person = item(F.concat(F.lit('{"type":"message","role":"user","content":[{"type":"input_text","text":"'), text, F.lit('<environment_context>no</environment_context>"}]}')))
    reply = item(F.concat(F.lit('{"type":"message","role":"assistant","content":[{"type":"output_text","text":"'), text, F.lit('"}]}')))
    line = F.when(F.col("role") == "system", "{broken").when(F.col("role") == "user", person).otherwise(F.array_join(F.concat(calls, F.array(reply)), "\n"))
    return T.rollout_turns(_files(table(spark, d, "conversations"), "conv_id", "turn", line)).select("path", "turn", "speaker", "text", "omitted")


@query("clipping_files", """SELECT 'c' || page_id || CASE WHEN page_id % 3 = 0 THEN '.txt' ELSE '.json' END AS path, CASE WHEN page_id % 3 = 1 THEN url END AS url, CASE page_id % 3 WHEN 0 THEN 'note ' || page_id WHEN 2 THEN '{cut off ' || page_id END AS note FROM pages""")
def clipping_files(spark, d):
    """Clippings as JSON, as plain text, and as JSON that was cut off, which counts as text; blank ones don't come."""
    p = F.col("page_id")
    value = F.when(p % 3 == 0, F.concat(F.lit("note "), p)).when(p % 3 == 1, F.to_json(F.struct("url"))).otherwise(F.concat(F.lit("{cut off "), p))
    files = table(spark, d, "pages").select(F.concat(F.lit("c"), p, F.when(p % 3 == 0, ".txt").otherwise(".json")).alias("path"), value.alias("value"))
    blank = spark.createDataFrame([("blank.txt", "  "), ("blank.json", '{"note": " "}')], "path string, value string")
    return T.clippings(files.unionByName(blank)).select("path", "url", "note")


@query("archive_messages", "SELECT 'file-' || conv_id AS path, 'key-' || conv_id AS source_key, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS ordinal, role, md5(text) AS digest FROM conversations WHERE conv_id % 6 <> 5")
def archive_messages(spark, d):
    """Messages of portable archives; an archive that isn't JSON has none."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    messages = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    whole = F.to_json(F.struct(F.concat(F.lit("key-"), "conv_id").alias("source_key"), messages.alias("messages")))
    files = c.select(F.concat(F.lit("file-"), "conv_id").alias("path"), F.when(F.col("conv_id") % 6 == 5, F.lit("{oops")).otherwise(whole).alias("value"))
    return T.archive_messages(T.archives(files)).select("path", "source_key", "ordinal", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


def _scoped(spark, d):
    o = table(spark, d, "orders")
    layer = F.when(F.col("o_orderkey") % 3 == 0, "node").otherwise("evidence")
    role = F.when(F.col("o_orderkey") % 2 == 0, "user").otherwise("assistant")
    source = F.concat(F.lit("00000000-0000-0000-0000-00000000000"), (F.col("o_orderkey") % 10).cast("string"))
    return o.select("o_orderkey", layer.alias("layer"), role.alias("role"), source.alias("source_id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("timestamp")).alias("at"))


@query("scoped_rows", """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS node, o_orderkey % 2 = 0 AS person, o_orderkey % 10 AS src, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS t FROM orders)
SELECT 'nodes' AS scope, count(*) AS n FROM r WHERE node UNION ALL SELECT 'role', count(*) FROM r WHERE NOT node AND person UNION ALL SELECT 'source', count(*) FROM r WHERE NOT node AND src = 4 UNION ALL SELECT 'closed', count(*) FROM r WHERE t >= TIMESTAMP '1996-01-01' AND t <= TIMESTAMP '1996-12-31' UNION ALL SELECT 'open', count(*) FROM r WHERE t >= TIMESTAMP '1998-01-01'""")
def scoped_rows(spark, d):
    """Scopes of a question: a layer, a role or a source (which mean evidence), closed bounds that rows without a time never satisfy."""
    scopes = {
        "nodes": {"layer": "nodes"}, "role": {"role": "user"}, "source": {"source_id": "00000000-0000-0000-0000-000000000004"}, "closed": {"start": "1996-01-01T00:00:00Z", "until": "1996-12-31T01:00:00+01:00"}, "open": {"start": "1998-01-01T00:00:00Z"},
    }
    rows, out = _scoped(spark, d), None
    for name, given in scopes.items():
        one = Scope.of(**given).apply(rows).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("scope"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("question_plans", "SELECT * FROM (VALUES ('anchored', 5, 'exact_lookup', 'choose_authorized_action'), ('open', 8, 'exact_lookup', 'choose_authorized_action'), ('short', 3, 'exact_lookup', 'semantic_seed')) v(kind, steps, first, last)")
def question_plans(spark, d):
    """The steps that a question takes with and without a known anchor, and with few steps allowed."""
    plans = {"anchored": plan(True), "open": plan(False), "short": plan(False, 3)}
    return spark.createDataFrame([(k, len(p), p[0], p[-1]) for k, p in plans.items()], "kind string, steps int, first string, last string")

"""Queries of look-ups, pages, sources and sinks, updates and JSON shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import corpus as C
from corvane.operators import records as R
from corvane.operators import temporal as G
from corvane.plans.registry import query
from corvane.plans.state import _STATE, state_events
from corvane.sources import optional_table, parse_lines, table
from corvane.streaming.scratch import scratch


@query("whole_graph", "SELECT 'node' AS kind, c_custkey AS id, NULL::TIMESTAMP AS at FROM customer UNION ALL SELECT 'edge', o_orderkey, o_orderdate FROM orders")
def whole_graph(spark, d):
    """Nodes and edges, each in the order of creation."""
    nodes = table(spark, d, "customer").select(F.lit("node").alias("kind"), F.col("c_custkey").alias("id"), F.lit(None).cast("timestamp_ntz").alias("at"))
    edges = table(spark, d, "orders").select(F.lit("edge").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    return nodes.unionByName(edges).orderBy(F.desc("kind"), "at", "id")


@query("node_lookup", _STATE + ", asked AS (SELECT DISTINCT user_id || '-' || json_extract_string(props, '$.k') AS node_id FROM events WHERE event_id % 97 = 0) SELECT node_id, status, due_at FROM asked LEFT JOIN state USING (node_id)")
def node_lookup(spark, d):
    """Some nodes by their ids, with their state; the ids are a table, as short or long as it may be."""
    asked = table(spark, d, "events").where("event_id % 97 = 0").select(F.concat("user_id", F.lit("-"), F.get_json_object("props", "$.k")).alias("node_id")).distinct()
    wanted = state_events(spark, d).join(asked, "node_id", "left_semi")  # events of other nodes go before the aggregation
    return asked.join(G.latest_state(wanted).select("node_id", "status", "due_at"), "node_id", "left")


@query("jsonl_errors", """WITH l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line, turn, text FROM conversations)
SELECT 'conv-' || conv_id AS path, line::INTEGER AS line, turn % 4 <> 1 AS ok, CASE WHEN turn % 4 <> 1 THEN length(text)::BIGINT END AS size FROM l""")
def jsonl_errors(spark, d):
    """Lines of JSON, one file a conversation, one line in four cut off: the errors say in which line they are."""
    whole = F.to_json(F.struct("turn", "text"))
    line = F.when(F.col("turn") % 4 == 1, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    lines = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    files = lines.select(F.concat(F.lit("conv-"), "conv_id").alias("path"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("value"))
    return parse_lines(files).select("path", "line", F.col("error").isNull().alias("ok"), F.length(F.try_variant_get("v", "$.text", "string")).cast("long").alias("size"))


@query("jsonl_round_trip", "SELECT page_id, md5(url) AS url_digest, md5(html) AS html_digest FROM pages")
def jsonl_round_trip(spark, d):
    """Every column of a table, written as lines of JSON and read again."""
    pages, path = table(spark, d, "pages"), f"{scratch(spark, 'jsonl')}/pages"
    pages.write.mode("errorifexists").json(path)
    digest = lambda c: F.md5(F.col(c).cast("binary")).alias(f"{c}_digest")
    return spark.read.schema(pages.schema).json(path).select("page_id", digest("url"), digest("html"))


@query("bulk_ingest", "SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total, min(ts) AS first_at FROM events GROUP BY event_type")
def bulk_ingest(spark, d):
    """Rows as text, cast by a schema, written in bulk, read again."""
    path = f"{scratch(spark, 'bulk')}/rows"
    rows = table(spark, d, "events").select(F.struct(F.col("event_type"), F.col("ts").cast("string").alias("at"), F.get_json_object("props", "$.k").alias("k")).alias("r"))
    rows.select("r.event_type", F.col("r.at").cast("timestamp_ntz").alias("at"), F.col("r.k").cast("long").alias("k")).write.parquet(path)
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.min("at").alias("first_at"))


SPACE, FILL_SEED = 4000, "filler-1"


@query("stream_corpus", f"""WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM labels),
p AS (SELECT k * {SPACE} // n AS id, 'structured' AS kind, doc_id FROM s), f AS (SELECT r.id, 'filler' AS kind, NULL::BIGINT AS doc_id FROM range({SPACE}) r(id) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id = r.id))
SELECT id, kind, doc_id, CASE WHEN kind = 'filler' THEN ('0x' || substr(md5('{FILL_SEED}/word/' || id), 1, 15))::BIGINT % 1000 END AS word FROM (SELECT * FROM p UNION ALL SELECT * FROM f)""")
def stream_corpus(spark, d):
    """Structured rows spread over the whole space of ids; filler is made for the others from their numbers alone."""
    structured = C.spread_ids(table(spark, d, "labels").select("doc_id"), "doc_id", SPACE).withColumn("kind", F.lit("structured"))
    filler = spark.range(SPACE).join(structured.select("id"), "id", "left_anti").select("id", F.lit("filler").alias("kind"), F.lit(None).cast("long").alias("doc_id"))
    word = F.when(F.col("kind") == "filler", C.draw(FILL_SEED, "word", F.col("id"), 1000))
    return structured.unionByName(filler).select("id", "kind", "doc_id", word.alias("word"))


@query("vector_cache", """WITH c AS (SELECT item_id, CASE WHEN item_id % 5 = 2 THEN 'changed' ELSE md5(text) END AS digest FROM benchmark WHERE item_id % 7 <> 3)
SELECT b.item_id AS qid, CASE WHEN c.item_id IS NULL THEN 'missing' WHEN c.digest = md5(b.text) THEN 'fresh' ELSE 'stale' END AS state FROM benchmark b LEFT JOIN c USING (item_id)""")
def vector_cache(spark, d):
    """Which questions' vectors may be taken from a cache: it keeps a digest of each text."""
    digest = F.md5(F.col("text").cast("binary"))
    b = table(spark, d, "benchmark")
    cached = b.where("item_id % 7 <> 3").select(F.col("item_id").alias("cached_id"), F.when(F.col("item_id") % 5 == 2, "changed").otherwise(digest).alias("digest"))
    state = F.when(F.col("cached_id").isNull(), "missing").when(F.col("digest") == digest, "fresh").otherwise("stale")
    return b.join(cached, F.col("item_id") == F.col("cached_id"), "left").select(F.col("item_id").alias("qid"), state.alias("state"))


def _packed(most_rows: int, most_size: int, padded: bool) -> str:
    grown = "greatest(w.total, n.size) * (w.rows + 1)" if padded else "w.total + n.size"
    return f"""WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
w(conv_id, k, turn, batch, rows, total) AS (SELECT conv_id, k, turn, 0::BIGINT, 1::BIGINT, size::BIGINT FROM r WHERE k = 1
UNION ALL SELECT n.conv_id, n.k, n.turn, CASE WHEN w.rows = {most_rows} OR {grown} > {most_size} THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.rows = {most_rows} OR {grown} > {most_size} THEN 1 ELSE w.rows + 1 END,
 CASE WHEN w.rows = {most_rows} OR {grown} > {most_size} THEN n.size ELSE {'greatest(w.total, n.size)' if padded else 'w.total + n.size'} END FROM w JOIN r n ON n.conv_id = w.conv_id AND n.k = w.k + 1)
SELECT conv_id, turn, batch FROM w"""


def _batches(spark, d, most_rows: int, most_size: int, padded: bool = False):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return R.pack_batches(rows, "conv_id", "turn", "size", most_rows, most_size, padded).select("conv_id", "turn", "batch")


@query("insert_batches", _packed(3, 1500, False))
def insert_batches(spark, d):
    """Rows of a session cut into statements of at most so many rows and bytes, in order."""
    return _batches(spark, d, 3, 1500)


@query("token_budget_batches", _packed(R.MODEL_ROWS, 900, True))
def token_budget_batches(spark, d):
    """Batches for a model: the widest row times the number of rows stays within a budget."""
    return _batches(spark, d, R.MODEL_ROWS, 900, True)


SAVED = ["region", "nation", "labels", "benchmark"]


@query("backup_restore", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in SAVED))
def backup_restore(spark, d):
    """Tables copied into an empty place; what comes back is read from the copy."""
    target = f"{scratch(spark, 'backup')}/tables"
    R.backup(spark, d, SAVED, target)
    counts = [table(spark, target, n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n in SAVED]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("event_file_page", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS k FROM events WHERE event_id > 100) WHERE k <= 51")
def event_file_page(spark, d):
    """Events in files that are never overwritten, listed by id after a cursor; one more than a page."""
    path = f"{scratch(spark, 'journal')}/events"
    events = table(spark, d, "events").select("event_id", "event_type")
    events.write.mode("errorifexists").json(path)
    return spark.read.schema(events.schema).json(path).where("event_id > 100").orderBy("event_id").limit(51)


@query("tool_calls", """SELECT 'node' AS tool, (SELECT count(*) FROM customer WHERE c_custkey IN (1, 2, 3)) AS rows UNION ALL SELECT 'edges', (SELECT count(*) FROM orders WHERE o_custkey = 1) UNION ALL SELECT 'status', 3""")
def tool_calls(spark, d):
    """The read tools that a client may call by name, with the arguments it gives."""
    from corvane.api import Reader

    reader = Reader(spark, d)
    calls = [("node", {"ids": [1, 2, 3]}), ("edges", {"node": 1}), ("status", {})]
    counts = [reader.call(tool, arguments).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(tool).alias("tool"), "rows") for tool, arguments in calls]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("optional_tables", "SELECT * FROM (VALUES ('labels', true), ('no_such_table', false)) v(name, present)")
def optional_tables(spark, d):
    """A table that isn't there makes an answer poorer, not wrong."""
    return spark.createDataFrame([(n, optional_table(spark, d, n) is not None) for n in ("labels", "no_such_table")], "name string, present boolean")


@query("date_basis", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'node' ELSE 'evidence' END AS layer, CASE WHEN o_orderkey % 3 = 0 THEN c ELSE m END AS explicit_at, CASE WHEN o_orderkey % 3 = 0 THEN c ELSE coalesce(m, c) END AS inferred_at
FROM (SELECT o_orderkey, o_orderdate AS c, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS m FROM orders)""")
def date_basis(spark, d):
    """An explicit bound looks at the message's own time only; an inferred one falls back to the episode's; nodes have theirs."""
    from corvane.functions.dates import basis

    at = F.col("o_orderdate")
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "node").otherwise("evidence").alias("layer"), at.alias("created"), F.when(F.col("o_orderkey") % 2 == 0, at + F.expr("INTERVAL 1 DAY")).alias("message"))
    return rows.select("o_orderkey", "layer", *[basis(F.col("layer"), F.col("message"), F.col("created"), explicit).alias(n) for n, explicit in (("explicit_at", True), ("inferred_at", False))])


_LOCATORS = "l AS (SELECT event_id, user_id, 'session-' || user_id || CASE event_id % 3 WHEN 0 THEN ':turns:' || event_id WHEN 1 THEN ':sync:' || sha256(event_id::VARCHAR) ELSE '' END AS locator FROM events)"


def _locators(spark, d):
    e = F.col("event_id")
    end = F.when(e % 3 == 0, F.concat(F.lit(":turns:"), e)).when(e % 3 == 1, F.concat(F.lit(":sync:"), F.sha2(e.cast("string"), 256))).otherwise("")
    return table(spark, d, "events").select("event_id", "user_id", F.concat(F.lit("session-"), "user_id", end).alias("locator"))


@query("locator_prefix", f"WITH {_LOCATORS} SELECT user_id, count(*) AS n FROM l WHERE starts_with(locator, 'session-' || user_id || ':turns:') OR starts_with(locator, 'session-' || user_id || ':sync:') GROUP BY user_id")
def locator_prefix(spark, d):
    own = F.concat(F.lit("session-"), F.col("user_id"))
    rows = _locators(spark, d).where(F.startswith("locator", F.concat(own, F.lit(":turns:"))) | F.startswith("locator", F.concat(own, F.lit(":sync:"))))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("legacy_provenance", f"""WITH {_LOCATORS}, r AS (SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN 'clipping' WHEN 1 THEN 'rollout_session' ELSE 'chat_session' END AS kind, CASE event_id % 7 WHEN 0 THEN 'archive:' || event_id WHEN 1 THEN NULL ELSE locator END AS locator,
CASE event_id % 2 WHEN 0 THEN 'owner' ELSE 'assistant' END AS speaker FROM l), s AS (SELECT *, kind <> 'clipping' AND coalesce(locator NOT LIKE 'archive:%', true) AS session FROM r)
SELECT event_id, CASE WHEN session AND locator IS NOT NULL THEN user_id || ':session-' || user_id ELSE event_id::VARCHAR END AS observation_group, CASE WHEN NOT session THEN 'unknown' WHEN speaker = 'owner' THEN 'user' ELSE 'assistant' END AS role, 'unknown' AS fidelity FROM s""")
def legacy_provenance(spark, d):
    e = F.col("event_id")
    rows = _locators(spark, d).select(
        "event_id", e.alias("episode_id"), F.col("user_id").alias("source_id"), F.when(e % 5 == 0, "clipping").when(e % 5 == 1, "rollout_session").otherwise("chat_session").alias("source_kind"),
        F.when(e % 7 == 0, F.concat(F.lit("archive:"), e)).when(e % 7 != 1, F.col("locator")).alias("locator"), F.when(e % 2 == 0, "owner").otherwise("assistant").alias("speaker"),
    )
    return R.observation(rows).select("event_id", "observation_group", "role", "fidelity")


@query("evidence_messages", """SELECT l_orderkey, l_linenumber, o_orderpriority AS role, c_name AS record FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey""")
def evidence_messages(spark, d):
    """Evidence with the archived message behind it and that message's record, where there are any."""
    messages = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("role"))
    found = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_name").alias("record"))
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return e.join(messages, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(found, F.col("o_custkey") == F.col("c_custkey"), "left").select("l_orderkey", "l_linenumber", "role", "record")


@query("update_join", "SELECT doc_id, CASE WHEN quality IS NOT NULL AND lang <> 'de' THEN quality ELSE n_chars END AS n_chars FROM documents LEFT JOIN (SELECT doc_id, quality::BIGINT AS quality FROM labels) USING (doc_id)")
def update_join(spark, d):
    """Values that a job brings are written where a row is still as the job saw it."""
    changes = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("value"))
    return R.update_from(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), changes, "doc_id", "n_chars", F.col("lang") != "de").select("doc_id", "n_chars")


@query("upsert_rows", """WITH n AS (SELECT event_id AS c_custkey, 'new-' || event_id AS name FROM events WHERE event_id < 400 AND event_id % 2 = 0), o AS (SELECT c_custkey, c_name AS name FROM customer),
u AS (SELECT c_custkey, coalesce(n.name, o.name) AS updated, coalesce(o.name, n.name) AS kept FROM n FULL JOIN o USING (c_custkey)) SELECT * FROM u""")
def upsert_rows(spark, d):
    """Both answers to a key that is there already: the new row wins, or the old one does."""
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"))
    new = table(spark, d, "events").where("event_id < 400 and event_id % 2 = 0").select(F.col("event_id").alias("c_custkey"), F.concat(F.lit("new-"), "event_id").alias("name"))
    one = lambda update, name: R.upsert(rows, new, ["c_custkey"], update).withColumnRenamed("name", name)
    return one(True, "updated").join(one(False, "kept"), "c_custkey")


@query("two_list_page", """WITH k AS (SELECT event_type AS kind, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events WHERE event_type NOT IN ('click') AND (event_type <> 'view' OR event_id > 50)),
e AS (SELECT kind, max(nth) AS found, max(CASE WHEN nth = 20 THEN id END) AS last FROM k WHERE nth <= 21 GROUP BY kind) SELECT kind, id, CASE WHEN found > 20 THEN last END AS next FROM k JOIN e USING (kind) WHERE nth <= 20""")
def two_list_page(spark, d):
    """Lists that are continued side by side: "click" is exhausted, "view" goes on after 50, the others begin."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"))
    return R.next_page(rows, {"click": None, "view": 50}, 20)


@query("slice_pages", """WITH m AS (SELECT conv_id, list(turn ORDER BY turn) AS turns, string_agg(text, ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(turns[3:5], ',') AS turns, CASE WHEN len(turns) > 5 THEN 5 END AS next_turn, substr(t, 101, 200) AS part, CASE WHEN length(t) > 300 THEN 300 END AS next_char FROM m""")
def slice_pages(spark, d):
    """Three messages after the first two, 200 characters after the first 100, and where to go on."""
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("m"))
    m = m.select("conv_id", R.page_of(F.transform("m", lambda x: x["turn"].cast("string")), 2, 3).alias("p"), R.text_page(F.array_join(F.transform("m", lambda x: x["text"]), " "), 100, 200).alias("t"))
    return m.select("conv_id", F.array_join("p.items", ",").alias("turns"), F.col("p.next").alias("next_turn"), "t.part", F.col("t.next").alias("next_char"))


@query("distinct_sorted", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '|') AS priorities FROM orders GROUP BY o_custkey")
def distinct_sorted(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"))


_SHAPES = "['{\"a\": 1}', '[1, 2]', '\"x\"', '3.5', 'true', 'null', '{broken', '{\"b\": {}}']"


@query("json_shapes", f"""WITH s AS (SELECT event_id, {_SHAPES}[(event_id % 8)::INTEGER + 1] AS j FROM events), k AS (SELECT event_id, j, CASE WHEN json_valid(j) THEN json_type(j) END AS t, CASE WHEN json_valid(j) THEN json_type(j, '$.a') END AS a FROM s)
SELECT event_id, CASE t WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE CASE WHEN t IS NULL THEN 'invalid' ELSE 'number' END END AS kind, CASE WHEN t IS NULL THEN 'invalid' WHEN a IS NULL THEN 'missing' ELSE 'number' END AS kind_of_a FROM k""")
def json_shapes(spark, d):
    shapes = ['{"a": 1}', "[1, 2]", '"x"', "3.5", "true", "null", "{broken", '{"b": {}}']
    j = F.element_at(F.array(*map(F.lit, shapes)), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", j.alias("j")).select("event_id", R.json_kind(F.col("j")).alias("kind"), R.json_kind(F.col("j"), "$.a").alias("kind_of_a"))


@query("null_safe_changes", "SELECT a.conv_id, a.turn, a.r IS DISTINCT FROM b.r AS changed FROM (SELECT conv_id, turn, CASE WHEN role <> 'system' THEN role END AS r FROM conversations) a JOIN (SELECT conv_id, turn - 1 AS turn, CASE WHEN role <> 'system' THEN role END AS r FROM conversations) b USING (conv_id, turn)")
def null_safe_changes(spark, d):
    """Whether the next turn has another role, where a missing one equals a missing one."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") != "system", F.col("role")).alias("r"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("r").alias("next"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", (~F.col("r").eqNullSafe(F.col("next"))).alias("changed"))


@query("row_without_keys", """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' AS j FROM customer""")
def row_without_keys(spark, d):
    """A row as JSON without the columns that only its table needs."""
    c = table(spark, d, "customer")
    return c.select("c_custkey", R.without_keys(c, ["c_acctbal", "c_nationkey"]).alias("j"))

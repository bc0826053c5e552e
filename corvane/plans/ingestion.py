"""Queries of query understanding, filters, ingestion and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import redact
from corvane.functions import text as T
from corvane.operators import features as Q
from corvane.operators import ingest as I
from corvane.operators import lanes as L
from corvane.operators import postings as P
from corvane.plans import sqltext as S
from corvane.plans.registry import query
from corvane.sources import table

_QUESTIONS = "qs AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"
_FEATURES = f"""WITH df0 AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({S.terms('text')}) AS term FROM documents) GROUP BY term),
sdf AS (SELECT stem, max(df) AS df FROM ({S.stem('df0')}) GROUP BY stem), {_QUESTIONS},
t0 AS (SELECT conv_id, turn, unnest({S.content('text')}) AS term FROM qs), t1 AS ({S.stem('t0')}),
t2 AS (SELECT t1.*, CASE WHEN df > 0 THEN ln((SELECT count(*) FROM documents)::DOUBLE / df) END AS idf FROM t1 LEFT JOIN sdf USING (stem)),
g AS (SELECT conv_id, turn, count(*) AS n_stems, max(idf) AS max_idf, avg(idf) AS mean_idf, count_if(idf IS NULL)::BIGINT AS n_oov, list_sort(list_distinct(list(CASE WHEN idf >= 5.0 THEN stem END))) AS rare FROM t2 GROUP BY conv_id, turn),
f AS (SELECT qs.conv_id, qs.turn, len({S.terms('text')}) AS n_terms, coalesce(n_stems, 0) AS n_stems, greatest(coalesce(max_idf, 0), 0) AS max_idf, coalesce(mean_idf, 0) AS mean_idf, array_to_string(rare, ' ') AS rare, coalesce(n_oov / nullif(n_stems, 0), 0) AS oov FROM qs LEFT JOIN g USING (conv_id, turn)),
w AS (SELECT *, n_terms >= 8 AND oov >= 0.6 AS para, oov >= 0.34 AND n_terms <= 6 AS typo FROM f)"""


def asked_features(spark, d) -> DataFrame:
    """What users say is asked; a question's key is its conversation and turn."""
    docs = table(spark, d, "documents")
    asked = table(spark, d, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("qid"), "text")
    return Q.term_features(asked, P.stem_frequency(docs, "text"), docs.count(), Q.PRODUCT)


@query("query_features", _FEATURES + " SELECT conv_id, turn, n_terms::INTEGER AS n_terms, n_stems, round(max_idf, 6) AS max_idf, round(mean_idf, 6) AS mean_idf, coalesce(rare, '') AS rare_terms, round(oov, 6) AS oov_ratio, para AS looks_paraphrase, typo AS typo_suspect FROM w")
def query_features(spark, d):
    f = asked_features(spark, d)
    return f.select("qid.conv_id", "qid.turn", "n_terms", "n_stems", F.round("max_idf", 6).alias("max_idf"), F.round("mean_idf", 6).alias("mean_idf"), F.array_join("rare_terms", " ").alias("rare_terms"), F.round("oov_ratio", 6).alias("oov_ratio"), "looks_paraphrase", "typo_suspect")


@query("array_overlap_filter", f"SELECT doc_id FROM documents WHERE list_has_any({S.terms('text')}, ['the', 'und', 'que']) AND NOT list_contains({S.terms('text')}, 'of')")
def array_overlap_filter(spark, d):
    t = T.terms(F.col("text"))
    return table(spark, d, "documents").where(F.arrays_overlap(t, F.array(*map(F.lit, ["the", "und", "que"]))) & ~F.array_contains(t, "of")).select("doc_id")


@query("title_pattern_hits", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, list_any_value(list_filter(['%the%', '%ion%'], lambda p: regexp_extract(html, '(?s)<title>(.*?)</title>', 1) ILIKE p)) IS NOT NULL AS title_hit FROM pages")
def title_pattern_hits(spark, d):
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    hit = F.exists(F.array(F.lit("the"), F.lit("ion")), lambda p: F.contains(F.lower(title), p))
    return table(spark, d, "pages").select("page_id", title.alias("title"), hit.alias("title_hit"))


ENVELOPE = r"^\s*(Hello memory agent,[^\n]*\s+)?<observed_from_primary_session>"


@query("noise_envelope_exclusion", f"""WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '<observed_from_primary_session>' || text ELSE text END AS quote FROM conversations)
SELECT conv_id, turn FROM c WHERE NOT regexp_matches(substr(quote, 1, 500), '{ENVELOPE}')""")
def noise_envelope_exclusion(spark, d):
    """System turns wear the envelope of an observer; the operator looks at the first 500 characters."""
    quote = F.when(F.col("role") == "system", F.concat(F.lit("<observed_from_primary_session>"), "text")).otherwise(F.col("text"))
    return table(spark, d, "conversations").where(~F.substring(quote, 1, 500).rlike(ENVELOPE)).select("conv_id", "turn")


@query("role_source_scope", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE 'unknown' END AS scoped_role FROM conversations WHERE role <> 'system'")
def role_source_scope(spark, d):
    role = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("unknown")
    return table(spark, d, "conversations").where("role <> 'system'").select("conv_id", "turn", role.alias("scoped_role"))


def turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", F.col("role").alias("speaker"), "text", (F.col("turn") % 3).cast("int").alias("omitted"))


_TURNS = """p AS (SELECT conv_id AS session, turn, role AS speaker, text, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN '[1 tool call omitted]' || chr(10) || chr(10) ELSE '[2 tool calls omitted]' || chr(10) || chr(10) END || role || ':' || chr(10) AS pre FROM conversations),
r AS (SELECT *, coalesce(sum(length(pre) + length(text) + 2) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(pre) AS st FROM p)"""


@query("session_turn_spans", f"WITH {_TURNS} SELECT session, turn, st AS start, st + length(text) AS \"end\" FROM r")
def session_turn_spans(spark, d):
    return I.render(turns(spark, d)).select("session", "turn", "start", "end")


@query("session_page_render", f"WITH {_TURNS} SELECT session, md5(rtrim(string_agg(pre || text, chr(10) || chr(10) ORDER BY turn))) AS digest, count(*) AS n FROM r GROUP BY session")
def session_page_render(spark, d):
    pages = I.pages(I.render(turns(spark, d))).select("session", F.md5(F.rtrim("raw").cast("binary")).alias("digest"))
    n = turns(spark, d).groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    return pages.join(n, "session")


@query("span_validation", f"""WITH {_TURNS}, pg AS (SELECT session, string_agg(pre || text || chr(10) || chr(10), '' ORDER BY turn) AS raw FROM r GROUP BY session)
SELECT session, turn, CASE WHEN substr(raw, st + 1, length(text)) = text THEN '' ELSE 'quote_differs' END AS issues FROM r JOIN pg USING (session)""")
def span_validation(spark, d):
    """Every rendered span is checked against its page; a page lacks only the last two line feeds."""
    rendered = I.render(turns(spark, d))
    spans = rendered.join(I.pages(rendered), "session").select(F.col("session").alias("doc"), "turn", "start", "end", F.col("text").alias("quote"), "raw")
    return I.span_issues(spans).select(F.col("doc").alias("session"), "turn", F.array_join("issues", ",").alias("issues"))


@query("bag_difference_new_turns", """WITH f AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) AS nth FROM conversations),
s AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) AS nth FROM conversations WHERE turn < 3)
SELECT conv_id, turn, role FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = f.conv_id AND s.role = f.role AND s.text = f.text AND s.nth = f.nth)""")
def bag_difference_new_turns(spark, d):
    """What a grown transcript has beyond the three turns stored before, repeats counted."""
    c = table(spark, d, "conversations")
    return I.new_turns(c, c.where("turn < 3"), ["conv_id", "role", "text"], ["turn"]).select("conv_id", "turn", "role")


@query("latest_checkpoint_per_session", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_checkpoint_per_session(spark, d):
    return I.latest_per_key(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("receipt_replay_conflict", """WITH r AS (SELECT conv_id || ':' || turn AS request_id, md5(text) AS digest FROM conversations),
k AS (SELECT conv_id || ':' || turn AS request_id, CASE WHEN turn = 2 THEN 'other' ELSE md5(text) END AS known FROM conversations WHERE turn BETWEEN 1 AND 2)
SELECT request_id, CASE WHEN known IS NULL THEN 'stored' WHEN known = digest THEN 'replayed' ELSE 'conflict' END AS outcome FROM r LEFT JOIN k USING (request_id)""")
def receipt_replay_conflict(spark, d):
    request, digest = F.concat("conv_id", F.lit(":"), "turn"), F.md5(F.col("text").cast("binary"))
    c = table(spark, d, "conversations")
    known = c.where("turn between 1 and 2").select(request.alias("request_id"), F.when(F.col("turn") == 2, "other").otherwise(digest).alias("digest"))
    return I.receipt_outcome(c.select(request.alias("request_id"), digest.alias("digest")), known)


@query("settled_sessions", "SELECT user_id, max(ts) AS last_at, count(*) AS n FROM events GROUP BY user_id HAVING max(ts) <= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def settled_sessions(spark, d):
    """Sessions without a change in the last day of the log."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    return e.groupBy("user_id").agg(F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n")).where(F.col("last_at") <= F.lit(now) - F.expr("INTERVAL 24 HOURS"))


@query("larger_file_wins", "SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id DESC) AS k FROM documents) WHERE k = 1")
def larger_file_wins(spark, d):
    """Of files with one session id (here: source and language), the larger, then the later one."""
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"))


@query("exclusion_gate", "SELECT conv_id, count(*) AS turns FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE contains(lower(text), 'tion')) GROUP BY conv_id")
def exclusion_gate(spark, d):
    """One excluded turn keeps its whole session out."""
    c = table(spark, d, "conversations")
    hit = c.where(I.excluded(F.col("text"), F.lit(""), F.lit("word"), F.lit("TION"))).select("conv_id").distinct()
    return c.join(hit, "conv_id", "left_anti").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))


@query("redact_ssn_cards", r"""SELECT doc_id, md5(regexp_replace(text, '\b\d{3}-\d{2}-\d{4}\b', '[REDACTED:ssn_pattern]', 'g')) AS no_ssn, regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b') AS has_ssn,
 len(list_filter(regexp_extract_all(text, '\b(?:\d[ -]?){13,19}\b'), lambda m: list_sum(list_transform(range(length(regexp_replace(m, '[ -]', '', 'g'))), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN substr(regexp_replace(m, '[ -]', '', 'g'), length(regexp_replace(m, '[ -]', '', 'g')) - i, 1)::INTEGER * 2 > 9 THEN substr(regexp_replace(m, '[ -]', '', 'g'), length(regexp_replace(m, '[ -]', '', 'g')) - i, 1)::INTEGER * 2 - 9 ELSE substr(regexp_replace(m, '[ -]', '', 'g'), length(regexp_replace(m, '[ -]', '', 'g')) - i, 1)::INTEGER * 2 END ELSE substr(regexp_replace(m, '[ -]', '', 'g'), length(regexp_replace(m, '[ -]', '', 'g')) - i, 1)::INTEGER END)) % 10 = 0))::INTEGER AS n_cards FROM documents""")
def redact_ssn_cards(spark, d):
    docs = table(spark, d, "documents")
    no_ssn = F.regexp_replace("text", redact.SSN, "[REDACTED:ssn_pattern]")
    return docs.select("doc_id", F.md5(no_ssn.cast("binary")).alias("no_ssn"), F.col("text").rlike(redact.SSN).alias("has_ssn"), F.size(redact.cards(F.col("text"))).alias("n_cards"))


@query("redact_evidence_quotes", r"""WITH n AS (SELECT doc_id, text, regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b') AS ssn, regexp_replace(text, '\b\d{3}-\d{2}-\d{4}\b', '', 'g') AS t FROM documents),
m AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(t, '\b(?:\d[ -]?){13,19}\b')), '[ -]', '', 'g') AS d FROM n), c AS (SELECT DISTINCT doc_id FROM m WHERE LUHN)
SELECT n.doc_id, array_to_string(list_filter([CASE WHEN ssn THEN 'ssn_pattern' END, CASE WHEN c.doc_id IS NOT NULL THEN 'credit_card_pattern' END], lambda r: r IS NOT NULL), ',') AS reasons,
 CASE WHEN ssn THEN '[REDACTED:ssn_pattern]' WHEN c.doc_id IS NOT NULL THEN '[REDACTED:credit_card_pattern]' ELSE text END AS quote FROM n LEFT JOIN c ON c.doc_id = n.doc_id""".replace("LUHN", "list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN substr(d, length(d) - i, 1)::INTEGER * 2 > 9 THEN substr(d, length(d) - i, 1)::INTEGER * 2 - 9 ELSE substr(d, length(d) - i, 1)::INTEGER * 2 END ELSE substr(d, length(d) - i, 1)::INTEGER END)) % 10 = 0"))
def redact_evidence_quotes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(redact.reasons(F.col("text")), ",").alias("reasons"), redact.redact_quote(F.col("text")).alias("quote"))


@query("title_from_text", r"""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS l FROM documents) SELECT doc_id, CASE WHEN length(l) > 120 THEN substr(l, 1, 117) || '...' ELSE l END AS title FROM s""")
def title_from_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.title_of(F.col("text")).alias("title"))


@query("clip_text", "SELECT conv_id, turn, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || ' ...' ELSE text END AS clipped FROM conversations")
def clip_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.clip(F.col("text"), 80).alias("clipped"))


@query("strip_injected_blocks", "SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', '', 'g'), '(?s)<style>.*?</style>', '', 'g')) AS digest FROM pages")
def strip_injected_blocks(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.strip_tagged(F.col("html"), ["script", "style"]).cast("binary")).alias("digest"))


@query("command_detection", r"SELECT conv_id, turn, regexp_matches(text, '(?i)^\s*(please\s+)?(remember|save|note)\b') AS remembers, regexp_matches(text, '(?i)^\s*(please\s+)?(mark|complete|finish)\b') AS completes FROM conversations")
def command_detection(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_remember_command(F.col("text")).alias("remembers"), T.is_complete_command(F.col("text")).alias("completes"))


@query("transcript_chunks")
def transcript_chunks(spark, d):
    """Spans of at most 1500 characters, cut at blanks; a walk over blocks that SQL can't express."""
    return I.chunk_transcripts(table(spark, d, "documents"), "doc_id", "text")


@query("edge_lane", f"""WITH e AS (SELECT o_orderkey AS id, o_custkey AS source, min(l_suppkey) + 1000000 AS target, o_totalprice AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_totalprice),
k AS (SELECT *, row_number() OVER (PARTITION BY 1 ORDER BY score DESC, id) AS rnk FROM e)
SELECT 1 AS qid, id AS edge, rnk::INTEGER AS rnk, unnest([source, target]) AS node FROM k WHERE rnk <= 24""")
def edge_lane(spark, d):
    """A matched edge puts both its ends at its rank; a node that two edges name comes twice."""
    first = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.min("l_suppkey") + 1000000).alias("target"))
    o = table(spark, d, "orders").join(first, "o_orderkey")
    edges = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source"), "target")
    return L.edge_lane(o.select(F.lit(1).alias("qid"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")), edges, 24)


@query("trace_lifecycle_join", """WITH s AS (SELECT user_id, min(event_id) AS id, min(ts) AS started FROM events WHERE event_type = 'view' GROUP BY user_id), f AS (SELECT user_id, max(ts) AS finished FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT s.user_id, started, finished, CASE WHEN finished IS NULL THEN 'incomplete' WHEN finished < started THEN 'out_of_order' ELSE 'complete' END AS state FROM s LEFT JOIN f USING (user_id)""")
def trace_lifecycle_join(spark, d):
    e = table(spark, d, "events")
    starts = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("ts").alias("started"))
    ends = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("finished"))
    state = F.when(F.col("finished").isNull(), "incomplete").when(F.col("finished") < F.col("started"), "out_of_order").otherwise("complete")
    return starts.join(ends, "user_id", "left").select("user_id", "started", "finished", state.alias("state"))


@query("embedding_sweep_order", "SELECT doc_id, place::INTEGER AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS place FROM (SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id DESC LIMIT 64))")
def embedding_sweep_order(spark, d):
    """A page of the 64 newest rows still without a label, shortest first."""
    page = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").orderBy(F.desc("doc_id")).limit(64)
    return page.select("doc_id", F.row_number().over(Window.orderBy("n_chars", "doc_id")).alias("place"))


@query("json_dump", "SELECT page_id, md5(page_id || '|' || url) AS digest FROM pages")
def json_dump(spark, d):
    dumped = table(spark, d, "pages").select(F.to_json(F.struct("page_id", "url")).alias("j")).select(F.from_json("j", "page_id long, url string").alias("r"))
    return dumped.select("r.page_id", F.md5(F.concat(F.col("r.page_id").cast("string"), F.lit("|"), F.col("r.url")).cast("binary")).alias("digest"))


@query("json_path", "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events")
def json_path(spark, d):
    return table(spark, d, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'int')").alias("k"))

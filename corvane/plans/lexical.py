"""Queries of query syntax, cover density, weighted fields, certificate stems, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import dates as D
from corvane.functions import render as N
from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import postings as P
from corvane.operators import syntax as X
from corvane.plans import sqltext as S
from corvane.plans.registry import query
from corvane.plans.retrieval import questions
from corvane.sources import table

_POS = f"pos AS (SELECT id, word, pos FROM (SELECT doc_id AS id, unnest({S.terms('text')}) AS word, unnest(range(len({S.terms('text')}))) AS pos FROM documents))"


@query("syntax_matches", f"""WITH c AS (SELECT item_id AS qid, {S.content('text')} AS c FROM benchmark), {_POS},
w AS (SELECT DISTINCT qid, id FROM c JOIN pos ON word = c[1]), neg AS (SELECT DISTINCT qid, id FROM c JOIN pos ON word = c[4]),
ph AS (SELECT DISTINCT qid, a.id FROM c JOIN pos a ON a.word = c[2] JOIN pos b ON b.id = a.id AND b.pos = a.pos + 1 AND b.word = c[3]), alt AS (SELECT DISTINCT qid, id FROM c JOIN pos ON word = c[5])
SELECT qid, id FROM (SELECT ph.qid, ph.id FROM ph JOIN w USING (qid, id) WHERE NOT EXISTS (SELECT 1 FROM neg WHERE neg.qid = ph.qid AND neg.id = ph.id) UNION SELECT qid, id FROM alt WHERE qid % 2 = 0)""")
def syntax_matches(spark, d):
    """Questions with a word, a phrase, a word that must not be there, and, every other, an alternative of one word."""
    c = questions(spark, d).select("qid", T.content_terms(F.col("text")).alias("c"))
    word = lambda i: F.coalesce(F.get("c", i), F.lit(""))
    text = F.concat(word(0), F.lit(' "'), word(1), F.lit(" "), word(2), F.lit('" -'), word(3), F.when(F.col("qid") % 2 == 0, F.concat(F.lit(" OR "), word(4))).otherwise(""))
    return X.matches(table(spark, d, "documents"), "doc_id", "text", X.clauses(c.select("qid", text.alias("text"))))


@query("lane_and_cover_density", f"""WITH {S.query_terms(3)}, {_POS}, e AS (SELECT qid, id, n_terms, pos, term FROM pos JOIN qt ON word = term),
f AS (SELECT a.qid, a.id, a.n_terms, a.pos, b.term, max(b.pos) AS last FROM e a JOIN e b ON a.qid = b.qid AND a.id = b.id AND b.pos <= a.pos GROUP BY ALL),
g AS (SELECT qid, id, pos, min(last) AS p FROM f GROUP BY qid, id, pos, n_terms HAVING count(*) = n_terms), x AS (SELECT qid, id, p, min(pos) AS q FROM g GROUP BY qid, id, p),
m AS (SELECT x.qid, x.id, x.p, x.q, count(*) AS m FROM x JOIN e ON e.qid = x.qid AND e.id = x.id AND e.pos BETWEEN x.p AND x.q GROUP BY ALL),
s AS (SELECT qid, id, round(sum(0.1::DOUBLE / (1 + (q - p) - (m - 1))) / any_value(len({S.terms('text')})), 9) AS score FROM m JOIN documents ON doc_id = id GROUP BY qid, id), {S.ranked('s', 'true', 24, 'lane')}
SELECT qid, id, score, rnk::INTEGER AS rnk FROM lane""")
def lane_and_cover_density(spark, d):
    """The first three content terms of each question, ranked by how densely they stand together, over the text's length."""
    return X.cover_lane(table(spark, d, "documents"), "doc_id", "text", P.query_terms(questions(spark, d), 3), 24)


_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"


@query("weighted_postings", f"""WITH f AS (SELECT page_id AS id, 'A' AS weight, unnest({S.terms(_TITLE)}) AS term FROM pages UNION ALL SELECT page_id, 'B', unnest({S.terms('url')}) FROM pages UNION ALL SELECT page_id, 'C', unnest({S.terms('html')}) FROM pages)
SELECT term, weight, count(DISTINCT id) AS df, count(*) AS tf FROM f GROUP BY term, weight""")
def weighted_postings(spark, d):
    """Terms of titles, addresses and bodies, each with its weight."""
    pages = table(spark, d, "pages").withColumn("title", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    return X.weighted_postings(pages, "page_id", {"title": "A", "url": "B", "html": "C"}).groupBy("term", "weight").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query("lexeme_overlap", f"""WITH l AS (SELECT conv_id, turn, list_distinct({S.content('text')}) AS l FROM conversations) SELECT a.conv_id, a.turn, len(list_intersect(a.l, b.l)) AS shared, list_has_all(b.l, a.l) AS contained FROM l a JOIN l b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn""")
def lexeme_overlap(spark, d):
    """How many lexemes a turn shares with the next, and whether that one holds them all."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(T.content_terms(F.col("text"))).alias("l"))
    pairs = rows.join(rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("l").alias("next")), ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.size(F.array_intersect("l", "next")).cast("long").alias("shared"), (F.size(F.array_except("l", "next")) == 0).alias("contained"))


@query("certificate_stems", f"""WITH v AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS w FROM benchmark) WHERE w NOT IN {S.STOP} AND length(w) > 1)
SELECT w AS term, CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 4 AND w LIKE '%es' THEN w[:-3] WHEN length(w) > 4 AND w LIKE '%ing' THEN w[:-4] WHEN length(w) > 4 AND w LIKE '%ed' THEN w[:-3] WHEN length(w) > 3 AND w LIKE '%ly' THEN w[:-3] WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END AS stem FROM v""")
def certificate_stems(spark, d):
    """The other, coarser stemmer, which certificates of questions are made with."""
    terms = table(spark, d, "benchmark").select(F.explode(T.certificate_terms(F.col("text"))).alias("term")).distinct()
    return terms.select("term", T.certificate_stem(F.col("term")).alias("stem"))


@query("clipping_render", """WITH c AS (SELECT page_id, 'clipping at 2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || CASE WHEN page_id % 3 = 0 THEN ' from app' ELSE '' END || chr(10) || CASE WHEN page_id % 4 <> 0 THEN 'title: page ' || page_id || chr(10) ELSE '' END || 'url: ' || url || chr(10) AS head, CASE WHEN page_id % 2 = 0 THEN 'chosen ' || page_id END AS sel, CASE WHEN page_id % 5 <> 1 THEN 'my note' END AS note FROM pages),
r AS (SELECT *, head || CASE WHEN sel IS NOT NULL THEN chr(10) || 'selection:' || chr(10) || sel || chr(10) ELSE '' END || CASE WHEN note IS NOT NULL THEN chr(10) || 'note:' || chr(10) || note || chr(10) ELSE '' END AS raw FROM c)
SELECT page_id, md5(raw) AS digest, speaker, st AS start, st + length(q) AS "end" FROM (SELECT page_id, raw, NULL AS speaker, sel AS q, length(head) + 12 AS st FROM r WHERE sel IS NOT NULL UNION ALL SELECT page_id, raw, 'owner', note, length(head) + coalesce(length(sel) + 13, 0) + 7 FROM r WHERE note IS NOT NULL)""")
def clipping_render(spark, d):
    """Clippings as a page of labelled spans, and where each quote stands in it."""
    p = F.col("page_id")
    at = F.concat(F.lit("2024-01-"), F.lpad((p % 28 + 1).cast("string"), 2, "0"))
    rows = table(spark, d, "pages").select(
        p, at.alias("captured_at"), F.when(p % 3 == 0, "app").alias("app"), F.lit(None).cast("string").alias("device"), F.when(p % 4 != 0, F.concat(F.lit("page "), p)).alias("title"), "url",
        F.when(p % 2 == 0, F.concat(F.lit("chosen "), p)).alias("selection"), F.when(p % 5 != 1, "my note").alias("note"),
    )
    spans = N.clipping(rows).select("page_id", "raw", F.explode("spans").alias("s"))
    return spans.select("page_id", F.md5(F.col("raw").cast("binary")).alias("digest"), "s.speaker", "s.start", "s.end")


@query("reminder_lines", "SELECT o_orderkey, strftime((o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d') AS local_date, '- ' || strftime((o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d') || ' America/Los_Angeles  ' || o_orderpriority || '  (untyped)' AS line FROM orders")
def reminder_lines(spark, d):
    """A reminder as a line for people, with the day of the owner's calendar."""
    day = D.local_date(F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", day.alias("local_date"), N.reminder_line(F.col("o_orderdate"), F.col("o_orderpriority"), F.lit(None).cast("string")).alias("line"))


@query("graph_snapshot", """WITH n AS (SELECT c_nationkey AS k, count(*) AS nodes, string_agg('### ' || c_name || chr(10) || 'raw: ' || CASE WHEN length(c_mktsegment) > 6 THEN substr(c_mktsegment, 1, 6) || ' ...' ELSE c_mktsegment END, chr(10) ORDER BY c_custkey) AS body FROM customer GROUP BY 1)
SELECT k AS graph, md5(CASE WHEN length(t) > 400 THEN substr(t, 1, 400) || ' ...' ELSE t END) AS digest FROM (SELECT k, nodes || ' nodes.' || chr(10) || body AS t FROM n)""")
def graph_snapshot(spark, d):
    """The nodes of a graph (here: a nation's) as one text, every node clipped, and the whole."""
    return N.snapshot(table(spark, d, "customer"), "c_nationkey", "c_custkey", "c_name", "c_mktsegment", 6, 400).select(F.col("c_nationkey").alias("graph"), F.md5(F.col("page").cast("binary")).alias("digest"))


@query("fenced_drafts", """WITH r AS (SELECT conv_id, turn, turn % 4 AS k FROM conversations) SELECT conv_id, turn, CASE k WHEN 0 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS drafts, CASE k WHEN 0 THEN 'a title' WHEN 3 THEN 'b' END AS title, CASE k WHEN 0 THEN 'words' WHEN 3 THEN 'x' END AS body FROM r""")
def fenced_drafts(spark, d):
    """Drafts that a reply holds in fenced blocks: those that a write would refuse, and what isn't JSON, are no drafts."""
    forms = ['hello\n```node\n{"title": " a title ", "raw": "words"}\n```\nbye', 'x ```node\n{"title": "", "raw": "w"}``` y', "```node\n{broken```", '```node {"title": "b", "raw": "r", "body": "x"}```']
    reply = F.element_at(F.array(*map(F.lit, forms)), (F.col("turn") % 4 + 1).cast("int"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", N.drafts(reply).alias("d"))
    return rows.select("conv_id", "turn", F.size("d").alias("drafts"), F.get("d", 0)["title"].alias("title"), F.get("d", 0)["body"].alias("body"))


_DOT = "list_inner_product"


@query("vector_norms", f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT *, list_avg(v) AS mu FROM v), s AS (SELECT *, sqrt(list_avg(list_transform(v, lambda x: (x - mu) * (x - mu))) + 1e-5::DOUBLE) AS sd, sqrt({_DOT}(v, v)) AS n FROM m)
SELECT vec_id, round(v[1] / n, 6) AS unit_first, round((v[1] - mu) / sd, 5) AS normed_first, round((v[64] - mu) / sd, 5) AS normed_last FROM s""")
def vector_norms(spark, d):
    """Vectors at unit length, and with mean 0 and variance 1."""
    v = table(spark, d, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("v")).select("vec_id", V.unit(F.col("v")).alias("u"), V.layer_norm(F.col("v")).alias("l"))
    return v.select("vec_id", F.round(F.col("u")[0], 6).alias("unit_first"), F.round(F.col("l")[0], 5).alias("normed_first"), F.round(F.col("l")[63], 5).alias("normed_last"))


@query("mean_pool", "SELECT label, round(sum(CASE WHEN vec_id % 3 <> 0 THEN embedding[1]::DOUBLE END) / greatest(count_if(vec_id % 3 <> 0), 1), 6) AS first, count_if(vec_id % 3 <> 0)::BIGINT AS n FROM embeddings GROUP BY label")
def mean_pool(spark, d):
    """The mean of a label's vectors, masked ones left out: as a model's token vectors are pooled."""
    e = table(spark, d, "embeddings").select("label", V.as_double(F.col("embedding")).alias("v"), (F.col("vec_id") % 3 != 0).alias("mask"))
    return V.mean_pool(e, "label", "v", "mask", 64).select("label", F.round(F.col("v")[0], 6).alias("first"), "n")


@query("seeded_vectors", """WITH u AS (SELECT id, i, (('0x' || substr(md5('v1/a/' || id || '/' || i), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370497 AS a, ('0x' || substr(md5('v1/b/' || id || '/' || i), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS b FROM range(200) r(id), range(8) t(i)),
g AS (SELECT id, i, sqrt(-2 * ln(a)) * cos(2 * pi() * b) AS g FROM u), n AS (SELECT id, sqrt(sum(g * g)) AS n FROM g GROUP BY id) SELECT id, i::INTEGER AS i, round(g / n, 6) AS x FROM g JOIN n USING (id)""")
def seeded_vectors(spark, d):
    """Unit vectors with seeded normal components: the same in any engine, in any order."""
    v = spark.range(200).select("id", V.unit(V.seeded_gaussian("v1", F.col("id"), 8)).alias("v"))
    return v.select("id", F.posexplode("v").alias("i", "x")).select("id", "i", F.round("x", 6).alias("x"))


@query("sentence_search", f"""WITH {S.query_terms(4)}, p AS (SELECT conv_id * 100 + turn AS id, {S.terms('text')} AS t FROM conversations WHERE role = 'assistant'),
h AS (SELECT qid, id, count(*) AS n, any_value(len(t)) AS len FROM (SELECT id, t, unnest(t) AS term FROM p) JOIN qt USING (term) GROUP BY qid, id),
s AS (SELECT qid, id, round(n / (1 + ln(len)), 6) AS score FROM h), {S.ranked('s', 'true', 3, 'lane')} SELECT qid, id, score, rnk::INTEGER AS rnk FROM lane""")
def sentence_search(spark, d):
    """The three turns of one role with the most occurrences of a question's terms, over the logarithm of their length."""
    rows = table(spark, d, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    terms = P.query_terms(questions(spark, d), 4)
    posted = P.postings(rows, "id", "text", terms.select("term").distinct())
    score = F.round(F.sum("tf") / (1 + F.log(F.col("len"))), 6)
    from corvane.operators.lanes import top_k

    return top_k(posted.join(terms, "term").groupBy("qid", "id", "len").agg(score.alias("score")).select("qid", "id", "score"), 3)

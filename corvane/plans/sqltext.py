"""Pieces of SQL that the oracles share."""

from __future__ import annotations

from corvane.functions.text import STOPWORDS, TERM


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP = "(" + ", ".join(map(quoted, STOPWORDS)) + ")"


def terms(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {quoted(TERM)})"


def content(x: str) -> str:
    return f"list_filter({terms(x)}, lambda t: t NOT IN {STOP} AND NOT regexp_matches(t, '^[0-9]+$'))"


def query_terms(most: int = 32) -> str:
    return f"""qt AS (SELECT qid, term, count(*) OVER (PARTITION BY qid) AS n_terms FROM (
  SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY pos) AS k FROM (
    SELECT qid, term, min(pos) AS pos FROM (SELECT qid, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT item_id AS qid, {content('text')} AS t FROM benchmark)) GROUP BY qid, term))
  WHERE k <= {most})"""


HITS = f"""{query_terms()},
tok AS (SELECT doc_id AS id, {terms('text')} AS t FROM documents),
p AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY id, len, term),
hits AS (SELECT qid, id, n_terms, count(*) AS matched, sum(tf) / len AS score FROM p JOIN qt USING (term) GROUP BY qid, id, len, n_terms)"""

CENTROIDS = """q AS (SELECT label AS qid, list(m ORDER BY i) AS qv FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings)"""

VECTOR_SCORED = CENTROIDS + """,
scored AS (SELECT qid, id, round(list_inner_product(qv, v) / (sqrt(list_inner_product(qv, qv)) * sqrt(list_inner_product(v, v))), 6) AS score FROM q, v)"""


def ranked(table: str, where: str, k: int, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rnk FROM {table} WHERE {where}) WHERE rnk <= {k})"


def stem(x: str) -> str:
    """Nested SELECTs that stem column `term` of relation x into column `stem`."""
    cut = lambda n: f"substr(w, 1, length(w) - {n})"
    single = "CASE WHEN regexp_matches({0}, '[b-df-hj-np-tv-z]$') AND right({0}, 1) = left(right({0}, 2), 1) AND length({0}) > 1 AND NOT regexp_matches({0}, '(ll|ss|zz)$') THEN substr({0}, 1, length({0}) - 1) ELSE {0} END"
    s0 = f"SELECT *, regexp_replace(term, '''s$', '') AS w FROM {x}"
    s1 = f"SELECT * REPLACE (CASE WHEN w LIKE '%ies' AND length(w) > 5 THEN {cut(3)} || 'y' WHEN regexp_matches(w, '[^s]s$') AND NOT regexp_matches(w, '(ss|us|is)$') THEN {cut(1)} ELSE w END AS w) FROM ({s0})"
    s2 = f"SELECT * REPLACE (CASE WHEN w LIKE '%ing' AND length(w) > 5 THEN {single.format(cut(3))} WHEN w LIKE '%ed' AND w NOT LIKE '%eed' AND length(w) > 4 THEN {single.format(cut(2))} ELSE w END AS w) FROM ({s1})"
    s3 = f"SELECT * REPLACE (CASE WHEN w LIKE '%iness' AND length(w) > 6 THEN {cut(5)} || 'y' WHEN w LIKE '%ness' AND length(w) > 5 THEN {cut(4)} WHEN w LIKE '%ly' AND length(w) > 4 THEN {cut(2)} ELSE w END AS w) FROM ({s2})"
    return f"SELECT * EXCLUDE (w), CASE WHEN length(term) < 4 THEN term ELSE w END AS stem FROM ({s3})"


def trigrams(word: str) -> str:
    return f"list_distinct(list_transform(range(1, length({word}) + 2), lambda i: substr('  ' || lower({word}) || ' ', i, 3)))"


def text_trigrams(text: str) -> str:
    return f"list_distinct(flatten(list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"

"""Queries of temporal state, graph walks and claims, over events, orders and the nations' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import dates as D
from corvane.operators import rank as R
from corvane.operators import temporal as G
from corvane.plans.registry import query
from corvane.sources import table

#: Which event stands for which state change, and the instants that queries are asked at.
KINDS = {"purchase": G.COMPLETED, "signup": G.SET, "error": G.CLEARED}
AS_OF, CLAIMS_AT = "2024-01-20 00:00:00", "1998-06-01 00:00:00"


def state_events(spark, d, rows: DataFrame | None = None) -> DataFrame:
    """Events as state changes of (user, k) nodes; a deadline lies as many days ahead as its value says."""
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")]
    e = (table(spark, d, "events") if rows is None else rows).where(F.col("event_type").isin(list(KINDS)))
    node = F.concat("user_id", F.lit("-"), F.get_json_object("props", "$.k"))
    value_at = F.when(F.col("event_type") == "signup", F.col("ts") + F.make_dt_interval(F.floor("value").cast("int")))
    return e.select(node.alias("node_id"), kind.alias("event_type"), value_at.alias("value_at"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"), F.lit("derived").alias("origin"))


_STATE = """WITH e AS (SELECT user_id || '-' || json_extract_string(props, '$.k') AS node_id, event_type, CASE WHEN event_type = 'signup' THEN ts + to_days(floor(value)::INTEGER) END AS value_at, ts, event_id FROM events WHERE event_type IN ('purchase', 'signup', 'error')),
done AS (SELECT node_id, max(ts) AS completed_at FROM e WHERE event_type = 'purchase' GROUP BY node_id),
last AS (SELECT node_id, event_type, value_at FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, event_id DESC) AS k FROM e WHERE event_type <> 'purchase') WHERE k = 1),
state AS (SELECT node_id, CASE WHEN completed_at IS NOT NULL THEN 'completed' ELSE 'active' END AS status, completed_at, CASE WHEN event_type = 'signup' THEN value_at END AS due_at, CASE WHEN event_type IS NOT NULL THEN 'derived' END AS origin
          FROM (SELECT DISTINCT node_id FROM e) LEFT JOIN done USING (node_id) LEFT JOIN last USING (node_id))"""


@query("temporal_state_latest", _STATE + " SELECT * FROM state")
def temporal_state_latest(spark, d):
    return G.latest_state(state_events(spark, d))


@query("reminders_split", _STATE + f" SELECT node_id, due_at, CASE WHEN due_at < TIMESTAMP '{AS_OF}' THEN 'overdue' ELSE 'upcoming' END AS bucket FROM state WHERE status = 'active' AND due_at IS NOT NULL")
def reminders_split(spark, d):
    return G.reminders(G.latest_state(state_events(spark, d)), F.lit(AS_OF).cast("timestamp"))


@query("mark_complete_plan", _STATE + " SELECT status, count(*) AS nodes, count(due_at) AS with_deadline FROM state GROUP BY status")
def mark_complete_plan(spark, d):
    """What a bulk completion would append to (active) and what it would only report (completed)."""
    return G.latest_state(state_events(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("nodes"), F.count("due_at").alias("with_deadline"))


def claims(spark, d) -> DataFrame:
    """Each order is a claim about its customer's priority, valid until the customer's next order."""
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    later = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select(
        F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("value"), (F.col("o_orderstatus") != "P").alias("ratified"), F.col("o_orderdate").alias("valid_from"), later.alias("valid_to")
    )


_CLAIMS = "WITH c AS (SELECT o_custkey AS subject, o_orderpriority AS value, o_orderstatus <> 'P' AS ratified, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)"


@query("as_of_claims", _CLAIMS + f" SELECT subject, value, valid_from, valid_to FROM c WHERE ratified AND valid_from <= TIMESTAMP '{CLAIMS_AT}' AND (valid_to IS NULL OR TIMESTAMP '{CLAIMS_AT}' < valid_to)")
def as_of_claims(spark, d):
    return claims(spark, d).where(F.col("ratified") & G.valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(CLAIMS_AT).cast("timestamp"))).select("subject", "value", "valid_from", "valid_to")


@query("epistemic_state", _CLAIMS + f""", v AS (SELECT subject, count(DISTINCT value) AS n FROM c WHERE ratified AND valid_from <= TIMESTAMP '{CLAIMS_AT}' AND (valid_to IS NULL OR TIMESTAMP '{CLAIMS_AT}' < valid_to) GROUP BY subject),
p AS (SELECT o_custkey AS subject, bool_or(o_totalprice > 400000) AS ok FROM orders GROUP BY o_custkey),
s AS (SELECT c_custkey AS subject, CASE WHEN n > 1 THEN 'conflicting' WHEN n = 1 THEN 'supported_current' WHEN ok THEN 'missing_resolvable' WHEN ok IS NOT NULL THEN 'inaccessible' ELSE 'missing_unresolved' END AS state FROM customer LEFT JOIN v ON v.subject = c_custkey LEFT JOIN p ON p.subject = c_custkey)
SELECT subject, state, CASE state WHEN 'conflicting' THEN 'surface_conflict_and_request_ratification' WHEN 'supported_current' THEN 'answer_with_evidence' WHEN 'missing_resolvable' THEN 'follow_resolution_path' WHEN 'inaccessible' THEN 'report_blocked_source' ELSE 'tell_owner_and_request_source' END AS next_action FROM s""")
def epistemic_state(spark, d):
    subjects = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"))
    paths = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), (F.col("o_totalprice") > 400000).alias("authorised"))
    return G.epistemic_state(subjects, claims(spark, d), paths, F.lit(CLAIMS_AT).cast("timestamp"), F.lit(True))


def relations(spark, d) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    of = lambda df, s, p, t: df.select(s.alias("source"), F.lit(p).alias("predicate"), t.alias("target"))
    node = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))
    return (
        of(table(spark, d, "customer"), node("customer", "c_custkey"), "lives_in", node("nation", "c_nationkey"))
        .unionByName(of(table(spark, d, "supplier"), node("supplier", "s_suppkey"), "based_in", node("nation", "s_nationkey")))
        .unionByName(of(nation, node("nation", "n_nationkey"), "part_of", node("region", "n_regionkey")))
        .unionByName(of(region, node("region", "r_regionkey"), "named", F.col("r_name")))
    )


_REL = """rel AS (SELECT 'customer:' || c_custkey AS source, 'lives_in' AS predicate, 'nation:' || c_nationkey AS target FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'based_in', 'nation:' || s_nationkey FROM supplier
UNION ALL SELECT 'nation:' || n_nationkey, 'part_of', 'region:' || n_regionkey FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'named', r_name FROM region)"""


@query("recursive_claim_walk", f"""WITH RECURSIVE {_REL}, w(start, node, depth, path, predicates) AS (SELECT 'customer:' || c_custkey, 'customer:' || c_custkey, 0, ['customer:' || c_custkey], []::VARCHAR[] FROM customer
UNION ALL SELECT start, target, depth + 1, list_append(path, target), list_append(predicates, predicate) FROM w JOIN rel ON source = node WHERE depth < 4 AND NOT list_contains(path, target))
SELECT start, node, depth, array_to_string(path, '>') AS path, array_to_string(predicates, '>') AS predicates FROM w WHERE depth > 0""")
def recursive_claim_walk(spark, d):
    starts = table(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("start"))
    w = G.walk(starts, relations(spark, d), 4)
    return w.select("start", "node", "depth", F.array_join("path", ">").alias("path"), F.array_join("predicates", ">").alias("predicates"))


@query("bounded_traverse", f"""WITH {_REL}, a AS (SELECT * FROM rel WHERE predicate IN ('based_in', 'part_of')),
w AS (SELECT source AS start, target AS node, 1 AS depth FROM a WHERE predicate = 'based_in' UNION ALL SELECT x.source, y.target, 2 FROM a x JOIN a y ON x.target = y.source WHERE x.predicate = 'based_in')
SELECT node, count(*) AS reached_from, min(depth)::INTEGER AS depth FROM w GROUP BY node""")
def bounded_traverse(spark, d):
    """Out direction, two kinds of edges, at most three steps."""
    edges = relations(spark, d).where(F.col("predicate").isin("based_in", "part_of"))
    starts = edges.where("predicate = 'based_in'").select(F.col("source").alias("start")).distinct()
    return G.walk(starts, edges, 3).groupBy("node").agg(F.count(F.lit(1)).alias("reached_from"), F.min("depth").alias("depth"))


_HOP = """e AS (SELECT o_custkey AS source, l_suppkey + 1000000 AS target, min(o_orderpriority) AS why FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
h AS (SELECT 1 AS qid, c_custkey AS id, round(1.0 / (60 + row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)), 9)::DOUBLE AS rrf FROM customer QUALIFY row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) <= 25)"""


@query("one_hop_expand", f"""WITH {_HOP}, b AS (SELECT source AS id, target AS nb, why FROM e UNION ALL SELECT target, source, why FROM e),
r AS (SELECT qid, nb, rrf * 0.35 AS gain, why, h.id AS parent FROM h JOIN b USING (id) WHERE nb NOT IN (SELECT id FROM h))
SELECT qid, nb AS id, round(gain, 9) AS rrf, parent, why FROM (SELECT *, row_number() OVER (PARTITION BY qid, nb ORDER BY gain DESC, parent) AS k FROM r) WHERE k = 1""")
def one_hop_expand(spark, d):
    """Neighbours of the 25 best customers in the graph of who bought from whom."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    edges = o.join(li, o.o_orderkey == li.l_orderkey).groupBy(F.col("o_custkey").alias("source"), (F.col("l_suppkey") + 1000000).alias("target")).agg(F.min("o_orderpriority").alias("why"))
    top = table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(R.SHORTLIST)
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey"))
    hits = top.select(F.lit(1).alias("qid"), F.col("c_custkey").alias("id"), F.round(1.0 / (60 + place), 9).alias("rrf"))
    return R.one_hop(hits, edges)


_ASK = """ask AS (SELECT conv_id, turn, lower(CASE turn % 8 WHEN 0 THEN 'what happened in ' || m || ' ' || y WHEN 1 THEN 'that ' || s || ' of ' || y WHEN 2 THEN 'before ' || y WHEN 3 THEN 'after ' || y WHEN 4 THEN 'in ' || y WHEN 5 THEN 'last ' || m WHEN 6 THEN 'around ' || m ELSE 'nothing ' || m END) AS phrase, m, s, y, turn % 8 AS t
 FROM (SELECT conv_id, turn, ['january','february','march','april','may','june','july','august','september','october','november','december'][(conv_id % 12)::INTEGER + 1] AS m, ['spring','summer','fall','autumn','winter'][(conv_id % 5)::INTEGER + 1] AS s, 2015 + conv_id % 10 AS y, (conv_id % 12 + 1)::INTEGER AS mi FROM conversations))"""


@query("date_phrase_ranges", f"""WITH {_ASK}, n AS (SELECT *, list_position(['january','february','march','april','may','june','july','august','september','october','november','december'], m) AS mi, CASE s WHEN 'spring' THEN 3 WHEN 'summer' THEN 6 WHEN 'winter' THEN 12 ELSE 9 END AS si FROM ask),
r AS (SELECT *, make_date(y, 1, 1) AS y0, CASE WHEN mi >= 3 THEN 2025 ELSE 2026 END AS ly FROM n)
SELECT conv_id, turn, phrase, CASE t WHEN 0 THEN 'in-month-year' WHEN 1 THEN 'that-season-of-year' WHEN 2 THEN 'before-year' WHEN 3 THEN 'after-year' WHEN 4 THEN 'in-year' WHEN 5 THEN 'last-month' WHEN 6 THEN 'around-month' END AS kind,
 (CASE t WHEN 0 THEN make_date(y, mi, 1) WHEN 1 THEN make_date(y, si, 1) WHEN 3 THEN make_date(y + 1, 1, 1) WHEN 4 THEN y0 WHEN 5 THEN make_date(ly, mi, 1) WHEN 6 THEN make_date(ly, mi, 1) - INTERVAL 1 MONTH END)::DATE::VARCHAR AS from_date,
 (CASE t WHEN 0 THEN make_date(y, mi, 1) + INTERVAL 1 MONTH WHEN 1 THEN make_date(y, si, 1) + INTERVAL 3 MONTH WHEN 2 THEN y0 WHEN 4 THEN y0 + INTERVAL 1 YEAR WHEN 5 THEN make_date(ly, mi, 1) + INTERVAL 1 MONTH WHEN 6 THEN make_date(ly, mi, 1) + INTERVAL 2 MONTH END)::DATE::VARCHAR AS to_date FROM r""")
def date_phrase_ranges(spark, d):
    """One phrase of each template per conversation, resolved as of March 2026."""
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col("conv_id") % by + 1).cast("int"))
    m, s, y, t = pick(D.MONTHS, 12), pick(list(D.SEASON_START), 5), (F.col("conv_id") % 10 + 2015).cast("string"), F.col("turn") % 8
    forms = [F.concat(F.lit("what happened in "), m, F.lit(" "), y), F.concat(F.lit("that "), s, F.lit(" of "), y), F.concat(F.lit("before "), y), F.concat(F.lit("after "), y), F.concat(F.lit("in "), y), F.concat(F.lit("last "), m), F.concat(F.lit("around "), m), F.concat(F.lit("nothing "), m)]
    phrase = F.lower(F.element_at(F.array(*forms), (t + 1).cast("int")))
    asked = table(spark, d, "conversations").select("conv_id", "turn", phrase.alias("phrase"))
    return asked.withColumn("r", D.date_range(F.col("phrase"), F.lit("2026-03-01").cast("date"))).select("conv_id", "turn", "phrase", "r.kind", F.col("r.from_date").cast("string").alias("from_date"), F.col("r.to_date").cast("string").alias("to_date"))


@query("date_filtered_lane", """WITH q AS (SELECT r_regionkey AS qid, make_date(1995 + r_regionkey, 1, 1)::TIMESTAMP AS lo, make_date(1996 + r_regionkey, 1, 1)::TIMESTAMP AS hi FROM region)
SELECT qid, id, score, rnk::INTEGER AS rnk FROM (SELECT qid, o_orderkey AS id, o_totalprice AS score, row_number() OVER (PARTITION BY qid ORDER BY o_totalprice DESC, o_orderkey) AS rnk FROM q JOIN orders ON o_orderdate >= lo AND o_orderdate < hi) WHERE rnk <= 24""")
def date_filtered_lane(spark, d):
    """The date filter stands before the ranking: rows outside can't use up a place."""
    from corvane.operators.lanes import pairwise, top_k

    year = lambda n: F.make_date(F.col("r_regionkey") + n, F.lit(1), F.lit(1)).cast("timestamp")
    asked = table(spark, d, "region").select(F.col("r_regionkey").alias("qid"), year(1995).alias("lo"), year(1996).alias("hi"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), "o_orderdate")
    hit = pairwise(asked, rows).where(D.in_range(F.col("o_orderdate"), F.col("lo"), F.col("hi"), closed=False))
    return top_k(hit.select("qid", "id", "score"), 24)


@query("recency_and_date_fit", """SELECT o_orderkey, round(CASE WHEN d <= 0 THEN 1 ELSE pow(0.5, d / 730.5) END, 6) AS recency,
 round(CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN pow(0.5, (epoch_us(TIMESTAMP '1997-01-01') - epoch_us(o_orderdate)) / 86400000000 / 365.25) WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN pow(0.5, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-01-01')) / 86400000000 / 365.25) ELSE 1 END, 6) AS date_fit
 FROM (SELECT *, (epoch_us(TIMESTAMP '2001-08-01') - epoch_us(o_orderdate)) / 86400000000 AS d FROM orders)""")
def recency_and_date_fit(spark, d):
    days = (F.unix_micros(F.lit("2001-08-01").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / F.lit(86_400_000_000)
    fit = D.date_fit(F.col("o_orderdate"), F.lit("1997-01-01").cast("date"), F.lit("1998-01-01").cast("date"), R.DATE_FIT_HALF_LIFE_DAYS)
    return table(spark, d, "orders").select("o_orderkey", F.round(D.decay(days, R.RECENCY_HALF_LIFE_DAYS), 6).alias("recency"), F.round(fit, 6).alias("date_fit"))

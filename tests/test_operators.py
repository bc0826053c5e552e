"""Lanes, fusion, reranking, state, graph, ingestion and metrics on small fixtures."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import corpus, features, ingest, lanes, metrics, postings, rank, temporal
from corvane.plans import evaluation, lab, retrieval  # noqa: F401
from corvane.streaming import ingest as streams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fusion_sums_lanes_skips_zero_weights_and_keeps_repeats(spark):
    lane = spark.createDataFrame([(1, "and", 10, 1, 1.0), (1, "or", 10, 2, 0.6), (1, "vector", 20, 1, 1.0), (1, "zero", 50, 1, 0.0), (1, "edge", 30, 1, 0.5), (1, "edge", 30, 2, 0.5)], "qid int, lane string, id long, rnk int, weight double")
    got = {r.id: (r.rrf, r.lane_ranks) for r in rank.fuse(lane).collect()}
    assert got[10][0] == pytest.approx(1 / 61 + 0.6 / 62, abs=1e-9) and got[10][1] == {"and": 1, "or": 2}
    assert got[30][0] == pytest.approx(0.5 / 61 + 0.5 / 62, abs=1e-9) and got[30][1] == {"edge": 1} and 50 not in got


def test_dense_and_ordinal_ranks(spark):
    hits = spark.createDataFrame([(1, 5, 9.0), (1, 4, 9.0), (1, 3, 4.0)], "qid int, id long, score double")
    assert [(r.id, r.rnk) for r in lanes.top_k(hits, 3, dense=True).orderBy("rnk", "id").collect()] == [(4, 1), (5, 1), (3, 2)]
    assert [(r.id, r.rnk) for r in lanes.top_k(hits, 2).orderBy("rnk").collect()] == [(4, 1), (5, 2)]


def test_lanes_need_all_terms_or_two(spark):
    q = spark.createDataFrame([(1, "red door house"), (2, "lamp"), (3, "the of")], "qid int, text string")
    docs = spark.createDataFrame([(1, "a red door in a house"), (2, "red door"), (3, "red"), (4, "lamp lamp"), (5, None)], "id long, text string")
    terms = postings.query_terms(q)
    hits = postings.term_hits(postings.postings(docs, "id", "text", terms.select("term").distinct()), terms)
    assert {(r.qid, r.id) for r in lanes.and_lane(hits, 5).collect()} == {(1, 1), (2, 4)}
    assert {(r.qid, r.id) for r in lanes.or_lane(hits, 5).collect()} == {(1, 1), (1, 2), (2, 4)}


def test_question_hits_by_matrix_and_by_postings(spark, monkeypatch):
    q = spark.createDataFrame([(1, "red door house"), (2, "lamp"), (3, "the of")], "qid int, text string")
    docs = spark.createDataFrame([(1, "a red door, RED house"), (2, "red door"), (3, "red"), (4, "lamp lamp x"), (5, None), (6, "")], "id long, text string")
    terms = postings.query_terms(q)
    by_matrix = rows(postings.question_hits(docs, "id", "text", terms))
    monkeypatch.setattr(postings, "MATRIX_ENTRIES", 0)
    assert by_matrix == rows(postings.question_hits(docs, "id", "text", terms)) == [(1, 1, 3, 3, 4 / 5), (1, 2, 3, 2, 1.0), (2, 4, 1, 1, 2 / 3)]


def test_filters_before_ranking(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, qv array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2), (3, None, 2)], "id long, v array<double>, year int")
    assert [r.id for r in lanes.vector_lane(q, v.where("year = 2").select("id", "v"), 1).collect()] == [2]


def test_anchor_walk_stops_at_the_first_overflow(spark):
    t = spark.createDataFrame([(1, "a", 10), (1, "b", 400), (1, "c", 401), (2, "x", 900), (2, "y", 950), (3, "p", 1), (3, "q", 1), (3, "r", 1), (3, "s", 1)], "qid int, term string, df long")
    assert {(r.qid, r.term) for r in lanes.scale_anchors(t).collect()} == {(1, "a"), (2, "x"), (3, "p"), (3, "q"), (3, "r")}


def test_spell_correction(spark):
    got = lanes.nearest_terms(spark.createDataFrame([("housse",), ("zzz",)], "word string"), spark.createDataFrame([("house",), ("mouse",)], "term string")).collect()
    assert [(r.word, r.term) for r in got] == [("housse", "house")]


def test_rerank_duplicates_and_ties(spark):
    c = [(1, i, i, 0.05 - 0.001 * i, 0.0, 0.0, 0.0, 0.0, 0.0, i == 4, False, 7 if i < 4 else None) for i in range(1, 5)]
    df = spark.createDataFrame(c, "qid int, id long, fused_rank int, rrf double, lexical double, cosine double, entity double, recency double, date_fit double, rare_hit boolean, title_hit boolean, dup_group int")
    got = {r.id: (r.dup_penalty, r.final_rank) for r in rank.rerank(df).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == [0, 1, 2, 0] and got[4][1] == 1 and got[3][1] == 4


def test_five_answer_states(spark):
    q = spark.createDataFrame([(i,) for i in range(1, 6)], "qid int")
    h = spark.createDataFrame([(2, "node", True, True), (3, "node", True, False), (3, "evidence", True, False), (4, "evidence", True, False), (5, "node", False, True)], "qid int, layer string, strong boolean, contradicted boolean")
    assert rows(rank.answer_state(q, h)) == [(1, "missing"), (2, "conflicting"), (3, "supported"), (4, "evidence"), (5, "partial")]


def test_one_hop_takes_the_best_parent_and_no_hits(spark):
    hits = spark.createDataFrame([(1, 1, 0.04), (1, 2, 0.02)], "qid int, id long, rrf double")
    edges = spark.createDataFrame([(1, 9, "x"), (9, 2, "y"), (1, 2, "z")], "source long, target long, why string")
    assert rows(rank.one_hop(hits, edges).select("id", "rrf", "parent", "why")) == [(9, 0.014, 1, "x")]


def test_temporal_state(spark):
    e = [("a", "deadline_set", "2024-02-01", "2024-01-01", 1), ("a", "deadline_cleared", None, "2024-01-02", 2), ("b", "deadline_set", "2024-02-01", "2024-01-01", 3), ("b", "deadline_set", "2024-03-01", "2024-01-01", 4), ("c", "completed", None, "2024-01-05", 5), ("c", "deadline_set", "2024-02-02", "2024-01-06", 6)]
    df = spark.createDataFrame(e, "node_id string, event_type string, value_at string, created_at string, id long").withColumn("origin", F.lit("u"))
    got = {r.node_id: (r.status, r.due_at) for r in temporal.latest_state(df).collect()}
    assert got == {"a": ("active", None), "b": ("active", "2024-03-01"), "c": ("completed", "2024-02-02")}
    assert rows(temporal.reminders(temporal.latest_state(df), F.lit("2024-03-01")).select("node_id", "bucket")) == [("b", "upcoming")]


def test_epistemic_ladder(spark):
    s = spark.createDataFrame([(x,) for x in "abcdef"], "subject string")
    claims = spark.createDataFrame([("a", "1", True, None, None), ("a", "2", True, None, None), ("b", "1", True, 1, 5), ("b", "2", True, 5, None), ("c", "1", False, None, None)], "subject string, value string, ratified boolean, valid_from int, valid_to int")
    paths = spark.createDataFrame([("c", True), ("d", False)], "subject string, authorised boolean")
    got = dict(rows(temporal.epistemic_state(s, claims, paths, F.lit(5), F.lit(True)).select("subject", "state")))
    assert got == {"a": "conflicting", "b": "supported_current", "c": "missing_resolvable", "d": "inaccessible", "e": "missing_unresolved", "f": "missing_unresolved"}
    assert {r.state for r in temporal.epistemic_state(s, claims, paths, F.lit(5), F.lit(False)).collect()} == {"retrieval_failure"}


def test_walk_has_no_cycles(spark):
    edges = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("c", "q", "d")], "source string, predicate string, target string")
    got = rows(temporal.walk(spark.createDataFrame([("a",)], "start string"), edges, 4).select("node", "depth", F.array_join("path", ">")))
    assert got == [("b", 1, "a>b"), ("c", 2, "a>b>c"), ("d", 3, "a>b>c>d")]


def test_render_and_spans(spark):
    t = spark.createDataFrame([("s", 0, "user", "hi", 0), ("s", 1, "assistant", "yo\nyo", 2)], "session string, turn int, speaker string, text string, omitted int")
    r = ingest.render(t)
    raw = ingest.pages(r).first().raw
    assert raw == "user:\nhi\n\n[2 tool calls omitted]\n\nassistant:\nyo\nyo"
    assert all(raw[x.start : x.end] == x.text for x in r.collect())
    spans = spark.createDataFrame([("d", 0, 2, "ab", "abc"), ("d", 1, 3, "xx", "abc"), ("d", 3, 3, "", "abc")], "doc string, start int, end int, quote string, raw string")
    assert {(x.start, tuple(x.issues)) for x in ingest.span_issues(spans).collect()} == {(0, ()), (1, ("overlaps", "quote_differs")), (3, ("empty_or_reversed",))}


def test_new_turns_count_repeats(spark):
    found = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "x")], "turn int, text string")
    assert [r.turn for r in ingest.new_turns(found, found.where("turn = 1 or turn = 3"), ["text"], ["turn"]).orderBy("turn").collect()] == [2, 4]


def test_chunks():
    text = "[0:00:01] " + "word " * 400 + "[0:10:00] end " * 3
    spans = ingest.chunk(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert max(b - a for a, b in spans[:-1]) <= 1500 and spans[-1][1] - spans[-1][0] >= 500
    assert ingest.chunk("x" * 3200)[0] == (0, 1500) and ingest.chunk("  ") == []


def test_transfer_rules(spark):
    a = spark.createDataFrame([("k", "model_assembled", "complete", [], 2, 1, True, ["m", "m", None], [3])], "key string, kind string, completeness string, limitations array<string>, from_at int, until_at int, has_original boolean, message_ids array<string>, ordinals array<int>")
    assert ingest.validate_transfer(a).first().issues == ["assembly_not_complete", "limitations_missing", "original_needs_export", "dates_reversed", "message_ids_repeat", "ordinal_out_of_range"]


def test_metrics_by_hand(spark):
    r = spark.createDataFrame([(1, 1), (2, 5), (3, 10), (4, None), (5, 3)], "qid int, rank int")
    got = metrics.summary(r).first()
    assert (got.recall_at_1, got.recall_at_5, got.recall_at_10, got.mrr_at_10) == (0.2, 0.6, 0.8, round((1 + 1 / 5 + 1 / 10 + 1 / 3) / 5, 6))
    shares = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("c", 0.25)], "name string, share double")
    assert rows(metrics.apportion(shares, 10)) == [("a", 5), ("b", 3), ("c", 2)]
    p = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double").agg(metrics.nearest_rank("x", 0.5).alias("a"), metrics.nearest_rank("x", 0.95).alias("b")).first()
    assert (p.a, p.b) == (5.0, 10.0)


def test_bootstrap_of_constant_values(spark):
    v = spark.createDataFrame([(i, 1.0) for i in range(10)], "place long, x double")
    assert tuple(metrics.bootstrap(v, 20, lambda r, i, n: (r + i) % n).first()) == (1.0, 1.0, 1.0)


def test_bootstrap_query_draws_ten_thousand_resamples(spark, sf_dir):
    rows = evaluation.ranks(spark, sf_dir).select("qid", "rank").collect()
    x = [float(rank is not None and rank <= 10) for _, rank in sorted((r.qid, r["rank"]) for r in rows)]
    n = len(x)
    place = lambda r, i: int(hashlib.md5(f"boot:{r}:{i}".encode()).hexdigest()[:15], 16) % n
    means = sorted(round(sum(x[place(r, i)] for i in range(n)) / n, 9) for r in range(10_000))
    got = evaluation.bootstrap_ci(spark, sf_dir).first()
    assert tuple(got) == pytest.approx((sum(x) / n, means[250], means[9749]), abs=1e-6)


def test_failure_causes(spark):
    t, f = True, False
    cases = [((t, f, t, t, 0, 0, 1), "date_misparse"), ((f, t, t, t, 0, 0, 1), "filter_excluded"), ((f, f, f, f, 0, 0, None), "not_retrieved"), ((f, f, f, t, 0, 0, None), "lost_in_fusion"), ((f, f, t, t, 3, 0, 1), "crowded_by_dups"), ((f, f, t, t, 2, 5, 1), "entity_confusion"), ((f, f, t, t, 0, 0, 10), "lost_in_rerank"), ((f, f, t, t, 0, 0, 11), "lost_in_fusion")]
    df = spark.createDataFrame([c for c, _ in cases], "a boolean, b boolean, c boolean, d boolean, e int, g int, h int")
    assert [r.x for r in df.select(metrics.failure_cause(*[F.col(c) for c in "abcdegh"]).alias("x")).collect()] == [want for _, want in cases]


def test_lane_weights_clamp_once(spark):
    row = lambda **k: spark.range(1).select(*[c.alias(n) for n, c in features.lane_weights(k.pop("w"), *[F.lit(v) for v in k.values()]).items()]).first().asDict()
    assert row(w=features.PRODUCT, idf=6.0, para=True, typo=False, person=False, date=False) == {"and": pytest.approx(2.1), "or": 0.0, "vector": pytest.approx(2.6), "trigram": 0.0}
    assert row(w=features.PRODUCT, idf=6.0, para=False, typo=True, person=True, date=True) == {"and": 3.0, "or": 1.0, "vector": pytest.approx(1.2), "trigram": 1.5}
    assert row(w=features.LEARNED, idf=1.0, para=False, typo=False, person=False, date=False)["vector"] == 0.0


def test_entities(spark):
    q = spark.createDataFrame([(1, "did anna maria see Bob, not bobby?"), (2, "an apple")], "qid int, text string")
    a = spark.createDataFrame([("anna", "Anna Maria", False), ("bob", "bob", True), ("an", "an", False)], "slug string, alias string, ambiguous boolean")
    assert {(r.qid, r.slug, r.ambiguous) for r in features.entities(q, a).collect()} == {(1, "anna", False), (1, "bob", True)}


def test_coordinate_descent_moves_only_for_gains():
    x = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 1.0]])
    w, best = corpus.descend(x, np.array([1, 1, 2, 2]), np.array([False, True, False, True]), np.array([1.0, 0.5]), np.linspace(0, 3, 16), k=1)
    assert best == 1.0 and w[1] > w[0]


def test_stream_ingest_reruns_are_no_ops(spark, tmp_path):
    rows_in = [(1, i, "user", f"t{i % 2}") for i in range(4)]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows_in, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda n: streams.ingest_turns(streams.read_stream(spark, f"{tmp_path}/in"), f"file://{tmp_path}/ledger", f"{tmp_path}/check{n}", ["conv_id", "role", "text"], ["turn"])
    run(0)
    run(0)
    run(1)
    spark.createDataFrame([(1, 4, "user", "t0"), (1, 5, "user", "new")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(0)
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/ledger").collect()) == ["new", "t0", "t0", "t1", "t1"]


def test_trigram_lane_by_matrix_and_by_postings(spark, monkeypatch):
    q = spark.createDataFrame([(1, "red door"), (2, "opening lamps"), (3, "??")], "qid int, text string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a red dor", "red doors and lamps", "opened a lamp", None, "", "red door"])], "id long, text string").repartition(3)
    by_matrix = rows(lanes.trigram_lane(q, docs, 2, 0.3))
    monkeypatch.setattr(lanes, "MATRIX_QUESTIONS", 0)
    assert by_matrix == rows(lanes.trigram_lane(q, docs, 2, 0.3)) and (1, 5, 1.0, 1) in by_matrix


def test_batches_close_before_they_grow_too_large(spark):
    from corvane.operators import records as R

    rows = spark.createDataFrame([("a", i, n) for i, n in enumerate([5, 5, 20, 1, 1, 1, 9])] + [("b", 0, 3)], "g string, o long, n int")
    got = {(r.g, r.o): r.batch for r in R.pack_batches(rows, "g", "o", "n", 3, 10).collect()}
    assert [got["a", i] for i in range(7)] == [0, 0, 1, 2, 2, 2, 3] and got["b", 0] == 0
    padded = {(r.g, r.o): r.batch for r in R.pack_batches(rows, "g", "o", "n", 9, 10, padded=True).collect()}
    assert [padded["a", i] for i in range(7)] == [0, 0, 1, 2, 2, 2, 3]
    assert R.pack_batches(rows.limit(0), "g", "o", "n", 3, 10).count() == 0


def test_lists_that_ended_do_not_start_again(spark):
    from corvane.operators import records as R

    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(5)], "kind string, id long")
    seen, cursors = [], {"a": -1, "b": 2}
    while any(c is not None for c in cursors.values()):
        page = R.next_page(rows, cursors, 2).collect()
        seen += [(r.kind, r.id) for r in page]
        cursors = {k: next((r.next for r in page if r.kind == k), None) for k in cursors}
    assert sorted(seen) == [("a", i) for i in range(5)] + [("b", 3), ("b", 4)]


def test_writes_on_odd_requests(spark):
    from corvane.operators import writes as W

    ids = spark.createDataFrame([("x",), ("y",), ("z",)], "id string")
    assert [[r.id for r in W.rotation(ids, after, 2).orderBy("nth").collect()] for after in (None, "x", "y", "zz")] == [["x", "y"], ["y", "z"], ["z", "x"], ["x", "y"]]
    rows = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "k int, v int")
    changes = spark.createDataFrame([(1, 1, 7), (1, 2, None), (3, 1, 8)], "k int, at int, value int")
    assert sorted(map(tuple, W.overlay(rows, changes, "k", "v").collect())) == [(1, None), (2, 6), (3, 8)]
    nested = spark.createDataFrame([(1, ("987-65-4321", [("4111 1111 1111 1111",), (None,)], None))], "k int, a struct<source_id:string,m:array<struct<t:string>>,empty:array<string>>")
    assert sorted((r.path, r.clean) for r in W.scrub_struct(nested, "a").collect()) == [("m.0.t", "[REDACTED:credit_card_pattern]"), ("source_id", "987-65-4321")]


def test_inverted_lists_find_what_the_exact_lane_finds(spark, sf_dir):
    from corvane.plans import registry

    sweep = {r.probes: r for r in registry.QUERIES["index_sweep"](spark, sf_dir).collect()}
    assert sweep[16].hit_at_30 == 1.0 and sweep[1].hit_at_30 <= sweep[4].hit_at_30 <= sweep[8].hit_at_30
    exact = {(r.qid, r.id) for r in registry.QUERIES["lane_vector_topk"](spark, sf_dir).where("rnk <= 30").collect()}
    found = {(r.qid, r.id) for r in registry.QUERIES["lane_ivf_topk"](spark, sf_dir).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_a_text_is_found_by_its_inner_words(spark):
    from corvane.operators import lanes as L

    asked = spark.createDataFrame([(1, "ree big words stand he"), (2, "hi"), (3, "a b  c d e"), (4, "no such words in any row")], "qid long, text string")
    rows = spark.createDataFrame([(10, "three big words stand here"), (11, "xhix"), (12, "z a b  c d e z"), (13, "a b c d e"), (14, None)], "id long, page string")
    assert sorted(map(tuple, L.holders(asked, rows).collect())) == [(1, 10), (2, 11), (3, 12)]


def test_chunks_cover_a_transcript_in_order():
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "[0:01:02] said ", "x" * rng.choice([1, 40, 1600]), "\n", " " * 700]) for _ in range(rng.randint(0, 400)))
        spans = ingest.chunk(text)
        assert all(lo < hi for lo, hi in spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        inside = "".join(text[lo:hi] for lo, hi in spans)
        assert "".join(inside.split()) == "".join(text.split())
        assert all(hi - lo <= ingest.MOST_CHARS + ingest.LEAST_CHARS for lo, hi in spans)
        assert all(hi - lo <= ingest.MOST_CHARS for lo, hi in spans[:-1])

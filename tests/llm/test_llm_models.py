"""Near duplicates, vector search, language identification and the pipeline, against brute force and held-out rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import inner_product, language, near_dups, queries
from corvane.llm.components import components


def brute_near(rows):
    sets, text = {}, dict(rows)
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    different = list({s for s in sets.values() if s})
    texts = {s: {text[i] for i in sets if sets[i] == s} for s in different}
    links = {s: [o for o in different if o != s and len(s & o) >= 0.8 * len(s | o) - 1e-9] for s in different}
    out = {}
    for i, s in sets.items():
        if not s:
            out[i] = (i, 0)
            continue
        seen, todo = {s}, [s]
        while todo:
            new = [o for o in links[todo.pop()] if o not in seen]
            seen.update(new)
            todo += new
        out[i] = (min(j for j, t in sets.items() if t in seen), len(texts[s]) - 1 + sum(len(texts[o]) for o in links[s]))
    return out


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(150)]

    def edited(n):
        b = list(base)
        for _ in range(n):
            b[rng.randrange(len(b))] = rng.choice(words)
        return " ".join(b)

    rows = [(i, edited(rng.randint(0, 6))) for i in range(90)] + [(1000 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(30)]
    return rows + [(2000, ""), (2001, None), (2002, "a b"), (2003, "A  b"), (2004, ""), (2005, "x " * 500), (2006, "x " * 501), (2007, rows[3][1] + " passage " * 200)]


@pytest.mark.parametrize("sizes", [{"small": 4, "block": 16}, {"small": 10_000}])
def test_near_dups_in_blocks_and_in_pairs(spark, near_rows, sizes):
    df = spark.createDataFrame([(i, t, 9) for i, t in near_rows], "doc_id long, text string, class_id int").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dups.near_dups(df, **sizes).collect()}
    assert got == brute_near(near_rows)


def test_near_dups_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "one two three four five six"), (7, "ONE two three four five six"), (7, "ONE two three four five six"), (7, "other text"), (None, "alone")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in near_dups.near_dups(df).collect())
    assert got == [("7", "7", 0), ("7", "7", 1), ("7", "7", 1), ("None", "7", 1), ("None", "None", 0)]
    assert near_dups.near_dups(df.limit(0)).count() == 0
    assert sorted((str(r.doc_id), r.text) for r in near_dups.keep_one(df).collect()) == [("7", "ONE two three four five six"), ("7", "other text"), ("None", "alone")]


def test_keep_one_loses_no_text_of_a_repeated_id(spark):
    a = " ".join(f"w{i}" for i in range(40))
    rows = [(3, a, "x"), (7, a + " more", "x"), (7, "a wholly different text of seven words", "x"), (None, a + " again", "x"), (None, "", "x"), (9, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_number string").repartition(3)
    out = near_dups.keep_one(df)
    assert out.columns == df.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, df.where("text is null or text = '' or doc_id = 3 or text like 'a wholly%'").collect()))
    assert near_dups.keep_one(df.limit(0)).count() == 0
    as_text = near_dups.keep_one(df.where("doc_id is not null and text is not null").dropDuplicates(["doc_id"]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert "d3" in {r.doc_id for r in as_text.collect()}


def test_crowded_group_of_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_BYTES", 200_000)
    base = " ".join(f"w{i % 977}x{i}" for i in range(6000))
    rows = [(i, base + " tail" * (i % 3) + f" end{i}") for i in range(70)] + [(500 + i, f"w{i} alone {i} of five words {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_dups.near_dups(df, small=4).collect()}
    assert got == brute_near(rows)


def test_crowded_pairs_are_pruned_before_they_are_verified():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 62, 300, np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 62, n, np.uint64)])) for n in (10, 12, 700, 800)]

    def cell(of):
        c = near_dups.Cell.__new__(near_dups.Cell)
        c.sizes, c.shingles, c.nodes = np.array([len(s) for s in of]), np.concatenate(of), np.arange(len(of))
        c.signatures = np.stack([near_dups.signature(s) for s in of])
        c.owner, c.crowded = np.repeat(c.nodes, c.sizes), np.ones((len(of), near_dups.BANDS), np.int64)
        return c

    x = cell(sets)
    p, q = near_dups._candidates(x, x, True)
    assert list(zip(p, q)) == [(0, 1)]
    every = np.nonzero(np.ones((4, 4)))
    assert near_dups._shared(x, x, *every).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(*every)]
    x.crowded = np.arange(4 * near_dups.BANDS).reshape(4, -1)
    assert len(near_dups._candidates(x, x, True)[0]) == 0


def test_pruning_keeps_pairs_at_the_threshold():
    least = near_dups.least_matches()
    assert all(0.4 < least[n] / n < 0.8 for n in least if n >= 60)
    rng = np.random.default_rng(0)
    common, own = rng.integers(0, 1 << 62, 800, np.uint64), rng.integers(0, 1 << 62, (2, 100), np.uint64)
    a, b = (near_dups.signature(np.unique(np.concatenate([common, o]))) for o in own)
    assert near_dups.may_reach(a[None], b[None]).tolist() == [0]
    assert near_dups.may_reach(a[None], near_dups.signature(own[1])[None]).tolist() == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


def test_search_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 24))
    x[40:80] = x[39]  # ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(20_000, None, 0), (20_020, [0.0] * 24, 0), (20_040, [float("nan")] * 24, 0), (20_060, [None] * 24, 0), (20_080, [1.0] * 3, 0), (None, [1.0] * 24, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3)
    got = inner_product.search(df).toPandas()
    hit = 0
    for i in range(0, 1500, 20):
        s = x @ x[i]
        order = [j for j in np.lexsort((np.arange(1500), -s)) if j != i][:20]
        mine = got[got.query_id == i].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine.score, [s[j] for j in mine.vec_id], atol=1e-9)
        hit += len({*order} & {*mine.vec_id})
    assert hit / 1500 >= 0.9 and len(got) == 1500
    assert inner_product.search(df.limit(0)).count() == 0
    few = inner_product.search(df.where("vec_id < 3")).collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(0, 1), (0, 2)]


def test_search_counts_repeated_rows_once_and_lists_an_id_once(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 24))
    vectors_of = [[v] for v in x]
    vectors_of[7] = [x[0] * 3 + 0.01 * rng.standard_normal(24) for _ in range(300)]  # nearest to query 0, more than are scored again at first
    vectors_of[20].append(x[45])  # a query with two vectors
    rows = [(i, v.tolist()) for i, own in enumerate(vectors_of) for v in own]
    heavy = (9, (x[0] * 2).tolist())
    rows = rows * 2 + [heavy] * 50
    vectors_of[9].append(x[0] * 2)
    got = inner_product.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).toPandas()
    hit = 0
    for i in range(0, 300, 20):
        best = np.array([max(float(v @ q) for v in own for q in vectors_of[i]) for own in vectors_of])
        order = [j for j in np.lexsort((np.arange(300), -best)) if j != i][:20]
        mine = got[got.query_id == i].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and mine.vec_id.is_unique and np.allclose(mine.score, best[mine.vec_id], atol=1e-9)
        hit += len({*order} & {*mine.vec_id})
    assert hit / 300 >= 0.9 and len(got) == 300
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist()[:2] == [7, 9]


def test_search_in_many_blocks_and_slices_moves_only_kept_vectors(spark, monkeypatch):
    for name, value in (("ROW_BLOCK", 64), ("QUERY_BLOCK", 16), ("SLICE", 2), ("EXACT_BYTES", 40_000)):
        monkeypatch.setattr(inner_product, name, value)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1200, 16)).astype(np.float32) * rng.lognormal(0, 0.5, (1200, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, (x[100] * 2).tolist()), (5, (x[100] * 3).tolist())]
    y = np.concatenate([x, [x[100] * 2, x[100] * 3]]).astype(np.float64)
    ids = np.append(np.arange(1200), [5, 5])
    for data, vectors_, id_ in ((rows, y, ids), (rows[:1200], y[:1200], ids[:1200])):
        got = inner_product.search(spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3), rerank=60).toPandas()
        hit = 0
        for i in range(0, 1200, 20):
            best = np.full(1200, -np.inf)
            np.maximum.at(best, id_, vectors_ @ vectors_[i])
            order = [j for j in np.lexsort((np.arange(1200), -best)) if j != i][:20]
            mine = got[got.query_id == i].sort_values("rank")
            assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine.score, best[mine.vec_id], atol=1e-6)
            hit += len({*order} & {*mine.vec_id})
        assert hit / 1200 >= 0.9 and len(got) == 1200
    with pytest.raises(ValueError):
        inner_product.search(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))


def test_search_loses_no_neighbour_among_rows_that_codes_cannot_tell_apart(spark):
    rng = np.random.default_rng(6)
    tight = rng.standard_normal((2, 16))[rng.integers(0, 2, 900)] + 1e-3 * rng.standard_normal((900, 16))
    shifted = 50 + rng.standard_normal((400, 16))
    loud = rng.standard_normal((300, 16)) * 10.0 ** rng.integers(-3, 4, (300, 1))
    few = np.zeros((400, 16))
    few[np.arange(400), rng.integers(0, 16, 400)] = rng.standard_normal(400)
    for x in (tight, np.concatenate([shifted, tight]), loud, few):
        got = inner_product.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)).toPandas()
        for i in range(0, len(x), 20):
            s = np.einsum("ij,j->i", x, x[i])
            order = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:20]
            mine = got[got.query_id == i].sort_values("rank")
            assert np.allclose(mine.score, s[order], rtol=1e-12, atol=1e-15) and len(mine) == 20


def test_search_hands_on_what_a_task_cannot_hold(spark, monkeypatch):
    for name, value in (("ROW_BLOCK", 64), ("QUERY_BLOCK", 16), ("SLICE", 2), ("EXACT_BYTES", 40_000), ("HELD", 500)):
        monkeypatch.setattr(inner_product, name, value)
    x = np.random.default_rng(9).standard_normal((1, 8)) + 1e-7 * np.random.default_rng(10).standard_normal((500, 8))
    got = inner_product.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)).toPandas()
    for i in range(0, 500, 20):
        s = np.einsum("ij,j->i", x, x[i])
        order = [j for j in np.lexsort((np.arange(500), -s)) if j != i][:20]
        assert np.allclose(got[got.query_id == i].sort_values("rank").score, s[order], rtol=1e-14, atol=0)


def test_four_bit_codes_pay_more_for_the_parallel_error():
    x = np.random.default_rng(2).standard_normal((400, 16))
    centres = inner_product.fit(x)
    parallel = []
    for weight in (1.0, 6.0):
        codes = inner_product.assign(x, centres, weight)
        rest = (inner_product.paired(x) - centres[np.arange(codes.shape[1]), codes]).reshape(400, -1)
        parallel.append(np.mean(((rest * x).sum(1) / np.linalg.norm(x, axis=1)) ** 2))
    assert parallel[1] < parallel[0]


def test_language_held_out(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95


def test_language_learns_only_from_its_fold(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    wrong = df.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language.identify(x).collect()} for x in (df, wrong))
    assert a == b


def test_regression_is_sparse_and_calibrated(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(df)
    assert (model.weights != 0).sum() < 0.1 * language.DIMS * len(model.languages) and 0 < len(model.weights) < language.DIMS / 2
    rng = np.random.default_rng(0)
    logits = rng.standard_normal((4000, 3)) * 4
    for scale in (0.01, 0.3, 1.0, 30.0):
        p = language.softmax(logits)
        truth = (p.cumsum(1) < rng.random((4000, 1))).sum(1)
        assert language.calibrate(logits * scale, truth) == pytest.approx(scale, rel=0.15)
    sure = np.eye(3)[[0, 1, 2] * 20] * 0.001
    t = language.calibrate(sure, np.array([0, 1, 2] * 20))
    assert 0.998 < language.softmax(sure / t).max(1).min() < 1


def test_ftrl_equals_plain_formulas():
    """One language against another, weights worked out coordinate by coordinate from the sums of the published method."""
    rng = np.random.default_rng(1)
    fast, z, n = language.Ftrl(6, 2), np.zeros((6, 2)), np.zeros((6, 2))
    for _ in range(40):
        at, g = rng.choice(6, 3, replace=False), rng.standard_normal((3, 2))
        w = fast.weights(at)
        for i, k in enumerate(at):
            for c in range(2):
                plain = 0.0 if abs(z[k, c]) <= language.L1 else -(z[k, c] - np.sign(z[k, c]) * language.L1) / ((language.BETA + n[k, c] ** 0.5) / language.ALPHA + language.L2)
                assert w[i, c] == pytest.approx(plain)
                z[k, c] += g[i, c] - ((n[k, c] + g[i, c] ** 2) ** 0.5 - n[k, c] ** 0.5) / language.ALPHA * plain
                n[k, c] += g[i, c] ** 2
        fast.step(at, w, g)


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 2600)
    letters = [chr(0x4E00 + i) for i in range(260)]
    rows = [(1000 * i + k, c * 30, f"l{i:03d}") for i, c in enumerate(letters) for k in range(9)] + [(10**6 + k, letters[0] * 20, "l000") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = language.train(df, learnable=F.lit(True))
    assert len(model.languages) == 260 and sum(model.predict(c * 12)[0] == f"l{i:03d}" for i, c in enumerate(letters)) > 250


def test_language_edge_cases(spark):
    rows = [(i, "der die das und nicht " * 5 if i % 2 else "the and of to in " * 5, "de" if i % 2 else "en") for i in range(60)] + [(100, None, "en"), (101, "", None), (102, "123 !?", "de"), (103, "the and of " * 90_000, None), (None, "und nicht", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df).collect()}
    assert all(got[i] == ("und", 0.0) for i in (100, 101, 102)) and got[103][0] == "en" and got[None][0] == "de"
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(df.limit(0)).count() == 0
    assert language.predict(df.withColumn("score", F.lit(1)), language.train(df)).columns[-2:] == ["lang_pred", "_score"]


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        made[name] = docs
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir), name)
        if name != "byte_bpe":
            assert docs.columns == made["language_id"].columns
    of = lambda name: {r.doc_id: r.text for r in made[name].collect()}
    exact, near = of("ngram_jaccard_join"), of("source_mixing")
    blank = str.maketrans("", "", " \t\n\x0b\f\r")
    assert len({t.translate(blank) for t in exact.values()}) == len(exact) == len({t.translate(blank) for t in of("exact_dedup").values()})
    classes = brute_near(sorted(exact.items()))
    assert set(near) == {c for c, _ in classes.values()}
    mixed = made["byte_bpe"].collect()
    assert {r.doc_id for r in mixed} <= set(near)
    digests = {r.doc_id: r.decoded_sha256 for r in docs.collect()}
    assert digests == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in mixed} and docs.count() == len(mixed)


def test_pipeline_stages_on_odd_tables(spark, sf_dir):
    """Nulls in every column, empty and long texts, repeated ids with different texts, repeated rows, clashing names, no rows."""
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).collect()
    extra = "lang_pred score row_number copies copy_no gone_id digest_of_text".split()
    a, b = plain[0].text, next(r.text for r in plain if r.lang != plain[0].lang)
    odd = [(None, a, plain[0].lang, "s"), (7_000, a + " one more", None, None), (7_000, "completely other words stand here, and none of them is like the rest", None, "s"), (7_001, None, "en", None), (7_002, "", None, "s"), (7_003, b * 40, None, "s"), (7_003, b * 40, None, "s"), (7_004, "123 456", "en", "s")]
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in plain] + odd
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *range(len(extra))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in extra)).repartition(3)
    for table in (docs, docs.limit(0)):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            before, kept = kept, corpus_pipeline.cut(stage(spark, kept, sf_dir), name)
            if name != "byte_bpe":
                assert kept.columns == docs.columns
            if name == "ngram_jaccard_join":
                texts = {r.text for r in before.collect()}
                classes = brute_near(list(enumerate(sorted(texts))))
                assert kept.count() == len({c for c, _ in classes.values()})
                assert table is not docs or not texts or any("completely other words" in r.text for r in kept.collect())
            if name == "language_id" and table.columns and kept.count():
                assert not {None, "", "123 456"} & {r.text for r in kept.collect()} and kept.count() == len(rows) - 3
    assert kept.count() == 0


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) == {"op1_sharding", "op6_mixing", "op7_exact_dedup", "op10_url_rules"}

"""Sharding, mixing, exact deduplication and URL rules: small tables with nulls, ties, repeats and clashing names."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.llm import dedup, mixing, sharding, url_rules


def docs(spark, rows, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema)


def test_fill_gives_every_slot_an_owner_and_even_shares():
    names = [f"s{i}" for i in range(7)]
    owners = sharding.fill(names, 1009)
    counts = Counter(owners)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1


def test_fill_moves_few_slots_when_a_shard_goes():
    names = [f"s{i}" for i in range(10)]
    before, after = sharding.fill(names, 1009), sharding.fill(names[:-1], 1009)
    moved = sum(b != a for b, a in zip(before, after) if b != 9)
    assert moved < 0.25 * 1009


@pytest.mark.parametrize("names, slots", [([], 7), (["a", "a"], 7), (["a", "b"], 8)])
def test_fill_refuses(names, slots):
    with pytest.raises(ValueError):
        sharding.fill(names, slots)


def test_assign_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (2, None)], "k long, slot string")
    out = sharding.assign(df, ["k"], ["a", "b"], 101)
    assert out.columns == ["k", "slot", "_slot", "shard"]
    rows = out.collect()
    assert len(rows) == 4 and len({r.shard for r in rows if r.k == 1}) == 1 and all(r.shard in "ab" for r in rows)
    assert sharding.assign(df.limit(0), ["k"], ["a"], 101).count() == 0


def test_write_shards(spark, tmp_path):
    df = spark.range(200).withColumn("t", F.lit("x"))
    sharding.write_shards(df, ["id"], ["a", "b", "c"], f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 200 and {r.shard for r in back.select("shard").distinct().collect()} == {"a", "b", "c"}


def brute_dedup(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in rows}
    text = dict(rows)
    out = {}
    for i in norm:
        group = [j for j in norm if norm[j] == norm[i]]
        out[i] = (min(group, key=lambda j: (-len(text[j] or ""), j)), len(group))
    return out


def test_exact_dedup_against_brute_force(spark):
    rows = [(1, "a b"), (2, "ab"), (3, " a b "), (4, None), (5, ""), (6, "\t\n"), (7, "A b"), (8, "é e"), (9, "ée"), (10, "x" * 50_000), (11, "x" * 49_999 + " x"), (12, "a\x1fb"), (13, "a\x0bb"), (14, "😀 "), (15, " 😀")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in dedup.exact_dedup(docs(spark, [(i, t, "s") for i, t in rows]).repartition(5)).collect()}
    assert got == brute_dedup(rows)


def test_exact_dedup_hot_group_repeats_and_null_ids(spark):
    df = docs(spark, [(i, "same", "s") for i in range(300)] + [(0, "same", "s"), (None, "same", "s"), (None, "other", "s")]).repartition(7)
    out = dedup.exact_dedup(df).collect()
    hot = [r for r in out if r.group_size == 302]
    assert len(out) == 303 and len(hot) == 302 and {r.keep_id for r in hot} == {0} and sum(r.kept for r in hot) == 2
    assert [r.kept for r in out if r.group_size == 1] == [True]
    assert dedup.keep_unique(df).count() == 2
    assert dedup.exact_dedup(df.limit(0)).count() == 0


def test_runs_are_sorted_where_they_are_read_and_merged_in_rounds(spark):
    df = docs(spark, [(i, f"t{i % 50}" if i % 3 else "hot", "s") for i in range(2000)]).repartition(21)
    prints = dedup.cut(dedup.fingerprints(df), "prints")
    want = sorted(map(str, prints.groupBy(*dedup.KEY).agg(F.min_by("id", F.struct(-F.col("n"), "id")).alias("keep_id"), F.count(F.lit(1)).alias("group_size")).collect()))
    assert sorted(map(str, dedup.merge_runs(prints).collect())) == want
    for runs, rounds in ((64, 3), (1, 1), (1024, 5)):
        merged = dedup.merge_runs(prints, runs)
        assert sorted(map(str, merged.collect())) == want
        plan = merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning(lane") == rounds and plan.count("Exchange") == rounds
        assert plan.count("REPARTITION_BY_NUM") == rounds - 1  # later rounds deal by lane and run, and don't shuffle again to aggregate


def test_keep_unique_with_repeated_ids_keeps_one_row_of_each_text(spark):
    rows = [(5, "a b", "x"), (5, "ab", "x"), (5, "c", "x"), (6, "c", "y"), (None, "d", "z"), (None, "d ", "z"), (7, None, "w"), (7, "", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_number string").repartition(4)
    out = dedup.keep_unique(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == [("5", "a b"), ("5", "c"), ("7", ""), ("None", "d ")]
    assert dedup.keep_unique(df.limit(0)).count() == 0


def test_mix_expectation_and_determinism(spark):
    df = docs(spark, [(i, "t", "big" if i % 3 else "small") for i in range(3000)])
    out = mixing.mix(df, weights={"big": 1, "small": 1})
    a = [tuple(r) for r in out.collect()]
    counts = Counter(r[2] for r in a)
    assert abs(counts["big"] - 1500) < 160 and abs(counts["small"] - 1500) < 160
    assert sorted(a) == sorted(tuple(r) for r in mixing.mix(df.repartition(9), weights={"big": 1, "small": 1}).collect())
    keys = [r.order_key for r in out.collect()]
    assert keys == sorted(keys)


def test_mix_high_rate_nulls_zero_weights_and_names(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "b", 6), (None, "c", 7)], "doc_id long, source string, copies int")
    out = mixing.mix(df, weights={None: 1, "b": 1, "c": 0}, total=600)
    n = Counter(r.source for r in out.collect())
    assert out.columns[:3] == ["doc_id", "source", "copies"] and "_copies" in out.columns
    assert 200 < n[None] < 400 and 200 < n["b"] < 400 and "c" not in n
    assert mixing.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, weights={"b": 0})


def brute_judge(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_rules_against_brute_force(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.net", "/en/x/"), ("allow", "a.example.net", "/"), ("block", "org", ""), ("allow", "", "/ok")]
    urls = [None, "", "x", "http://", "http://net", "http://net/", "https://Example.NET/en/y", "http://a.example.net/en/x/1", "http://b.example.net/en/x/", "ftp://notexample.net/en/", "http://example.net?/en/", "http://org#x", "x.org", "http://q.org/a://b", "http://net./", "http://.net/", "/ok", "://x/ok", "http://ÀB.net/en/", "http://example.net/en/\U0010ffffz", "http://example.net/en/\n\x00"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(0, None, "z"), (None, "http://net/", "z")], "page_id long, url string, rule string").repartition(4)
    got = [tuple(r) for r in url_rules.judge(pages, url_rules.rule_table(spark, rules), spread=2, chunk=2).collect()]
    want = [(i, *brute_judge(u, rules)) for i, u in enumerate(urls)] + [(0, *brute_judge(None, rules)), (None, *brute_judge("http://net/", rules))]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r.verdict for r in url_rules.judge(pages, url_rules.rule_table(spark, [])).collect()} == {"allow"}
    assert url_rules.judge(pages.limit(0), url_rules.rule_table(spark, rules)).count() == 0


def test_url_rules_of_one_host_in_chunks(spark):
    rng = random.Random(4)
    some = lambda n: "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, n)))
    rules = [(rng.choice(["block", "allow"]), rng.choice(["x.org", "x.org", "y.x.org"]), some(7)) for _ in range(150)]
    rules = [(v, h, p) for v, h, p in rules if v == "block" or ("block", h, p) not in rules]
    urls = [f"http://{rng.choice(['x.org', 'y.x.org', 'z.y.x.org', 'x.com'])}{some(12)}" for _ in range(400)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(3)
    for chunk in (1, 4, 1000):
        got = [tuple(r) for r in url_rules.judge(pages, url_rules.rule_table(spark, rules), spread=50, chunk=chunk).collect()]
        assert sorted(got) == [(i, *brute_judge(u, rules)) for i, u in enumerate(urls)]


def test_url_rules_a_million_labels_and_a_million_rules(spark):
    long_host = "a." * 1_000_000 + "x.org"
    pages = spark.createDataFrame([(1, f"http://{long_host}/p/7/y"), (2, "http://x.org/" + "q" * 1_000_000), (3, "http://x.org/p/999999/deep"), (4, "q" * 2_000_000)], "page_id long, url string")
    rules = spark.range(1_000_000).select(F.when(F.col("id") % 2 == 0, "allow").otherwise("block").alias("verdict"), F.lit("x.org").alias("host"), F.concat(F.lit("/p/"), "id", F.lit("/")).alias("path"))
    got = {r.page_id: (len(r.host), r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()}
    assert got == {1: (len(long_host), "x.org/p/7/", "block"), 2: (5, None, "allow"), 3: (5, "x.org/p/999999/", "block"), 4: (0, None, "allow")}

"""Text, date, vector and redaction functions on hand-made values."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corvane.functions import dates as D
from corvane.functions import redact
from corvane.functions import text as T
from corvane.functions import udfs as U
from corvane.functions import vectors as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("word, stem", [
    ("cats", "cat"), ("stories", "story"), ("glass", "glass"), ("stopped", "stop"), ("running", "run"), ("falling", "fall"), ("happiness", "happy"), ("darkness", "dark"), ("quickly", "quick"), ("freed", "freed"),
    ("the", "the"), ("dog's", "dog"), ("bus", "bus"), ("agreed", "agreed"), ("king", "king"), ("buzzed", "buzz"),
])
def test_stem(spark, word, stem):
    assert one(spark, word, T.stem) == stem == T.stem_of(word)


def test_terms_phrases_content(spark):
    text = 'The kbz-4417 "Red Door" isn\'t in 2024 -x-'
    assert one(spark, text, T.terms) == ["the", "kbz-4417", "red", "door", "isn't", "in", "2024", "x"]
    assert one(spark, text, T.phrases) == ["red door"]
    assert one(spark, text, T.content_terms) == ["kbz-4417", "red", "door", "isn't", "x"]
    assert one(spark, None, T.terms) is None


def test_trigrams(spark):
    assert one(spark, "cat", T.trigrams) == ["  c", " ca", "cat", "at "]
    assert U.word_similarity_of("word", "two words") == pytest.approx(4 / 7)
    assert U.word_similarity_of("", "x") == 0.0


def test_titles_and_clips(spark):
    assert one(spark, " a \n b ", T.title_of) == "a b"
    assert one(spark, "x" * 130, T.title_of) == "x" * 117 + "..."
    assert one(spark, "abcdef", lambda c: T.clip(c, 3)) == "abc ..."
    assert one(spark, "a<x>b\nc</x>d<x>e</x>", lambda c: T.strip_tagged(c, ["x"])) == "ad"


@pytest.mark.parametrize("text, kind, lo, hi", [
    ("what in may 2021", "in-month-year", "2021-05-01", "2021-06-01"), ("in december 2021", "in-month-year", "2021-12-01", "2022-01-01"), ("that winter of 2020", "that-season-of-year", "2020-12-01", "2021-03-01"),
    ("before 2019", "before-year", None, "2019-01-01"), ("after 2019", "after-year", "2020-01-01", None), ("in 2019", "in-year", "2019-01-01", "2020-01-01"), ("last march", "last-month", "2025-03-01", "2025-04-01"),
    ("last february", "last-month", "2026-02-01", "2026-03-01"), ("around january", "around-month", "2025-12-01", "2026-03-01"), ("may i", None, None, None), ("within 2019x", None, None, None),
])
def test_date_phrases(spark, text, kind, lo, hi):
    r = one(spark, text, lambda c: D.date_range(c, F.lit("2026-03-10").cast("date")))
    assert (r.kind, r.from_date and str(r.from_date), r.to_date and str(r.to_date)) == (kind, lo, hi)


def test_bare_months_are_opt_in(spark):
    assert one(spark, "may i", lambda c: D.date_range(c, F.lit("2026-03-10").cast("date"), D.TEMPLATES)).kind == "bare-month"


def test_decay_and_fit(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    day = lambda s: F.lit(s).cast("date")
    row = spark.range(1).select(
        D.decay(F.lit(-1.0), 10.0).alias("a"), D.decay(F.lit(10.0), 10.0).alias("b"), D.date_fit(at("2020-01-01"), day("2020-01-01"), day("2021-01-01"), 365.25).alias("c"),
        D.date_fit(at("2022-01-01"), F.lit(None).cast("date"), day("2021-01-01"), 365.0).alias("d"), D.date_fit(at("2022-01-01"), F.lit(None).cast("date"), F.lit(None).cast("date"), 1.0).alias("e"),
        D.in_range(at("2021-01-01"), day("2020-01-01"), day("2021-01-01"), False).alias("f"), D.in_range(at("2021-01-01"), day("2020-01-01"), day("2021-01-01"), True).alias("g"),
    ).first()
    assert tuple(row) == (1.0, 0.5, 1.0, 0.5, 0.0, False, True)


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, -2.0, 0.0], [2.0, 1.0, 5.0])], "a array<double>, b array<double>").select(V.dot("a", "b").alias("d"), V.sign_words(F.col("a"), 3).alias("s"), V.hamming(V.sign_words(F.col("a"), 3), V.sign_words(F.col("b"), 3)).alias("h")).first()
    assert (row.d, row.s, row.h) == (0.0, [1], 2)


def test_redaction(spark):
    card = "4111 1111 1111 1111"
    assert one(spark, f"id 123-45-6789 and {card}.", redact.scrub) == "id [REDACTED:ssn_pattern] and [REDACTED:credit_card_pattern]."
    assert one(spark, "no 4111 1111 1111 1112", redact.reasons) == []
    assert one(spark, f"x {card}", redact.redact_quote) == "[REDACTED:credit_card_pattern]"
    assert one(spark, f"{card} 123-45-6789", redact.redact_quote) == "[REDACTED:ssn_pattern]"


def slow_excerpt(text, stems, limit):
    """Every window that ends with a match and reaches back as far as the limit lets it, one by one."""
    at = [0]
    for c in text:
        at.append(at[-1] + len(c.encode("utf-16-le")) // 2)
    hits = [(at[m.start()], at[m.end()], stems[m.group().lower()]) for m in re.finditer("(?ia)[a-z0-9]+", text) if m.group().lower() in stems]
    if at[-1] <= limit:
        return 0, text
    windows = []
    for k, (_, end, _) in enumerate(hits):
        inside = [h for h in hits[: k + 1] if h[0] >= end - limit]
        windows.append((-len({h[2] for h in inside}), end - inside[0][0], k, inside[0][0], end))
    begin = 0
    if windows:
        _, _, _, lo, hi = min(windows)
        begin = max(0, min(at[-1] - limit, (lo + hi) // 2 - limit // 2))
    start = min(i for i, u in enumerate(at) if u >= begin)
    stop = max(i for i, u in enumerate(at) if u <= at[start] + limit)
    return at[start], text[start:stop]


def test_excerpts(spark):
    text = "a " * 600 + "red door opened " + "b " * 600
    row = spark.createDataFrame([(text, "which red doors?"), (None, "x"), ("short", None), ("no match " * 200, "zebra")], "t string, q string").select(U.excerpt(F.col("t"), F.col("q")).alias("e")).collect()
    start, part = row[0].e
    assert "red door" in part and len(part) == 700 and start == text.index("red door") + 4 - 350
    assert [tuple(r.e) for r in row[1:]] == [(0, ""), (0, "short"), (0, ("no match " * 200)[:700])]
    start, part = U.excerpt_of("😀" * 600 + " door " + "😀" * 600, {"door": "door"})
    assert "door" in part and not any(0xD800 <= ord(c) < 0xE000 for c in part)


def test_excerpts_against_every_window():
    rng = random.Random(3)
    words = ["red", "reds", "door", "key", "x", "😀", "zz😀y", "longlonglong"]
    stems = {"red": "red", "reds": "red", "door": "door", "key": "key", "longlonglong": "l"}
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        limit = rng.randint(4, 60)
        assert U.excerpt_of(text, stems, limit) == slow_excerpt(text, {w: s for w, s in stems.items() if len(w) <= limit}, limit), (text, limit)


@pytest.mark.parametrize("text, due", [
    ("pay by 2026-04-01", "2026-04-01 23:59:59"), ("met 2026-05-01, due March 9, 2027", "2027-03-09 23:59:59"), ("no cue 2026-05-01", None), ("valid until 2020-01-01", None), ("due tomorrow", "2026-03-11 23:59:59"), ("due 2026-99-99", None), ("by 2026-05-01 or 2026-05-02", "2026-05-02 23:59:59"),
    ("seen 2026-05-01. it is valid until March 20", "2026-03-20 23:59:59"), ("due today", "2026-03-10 23:59:59"), ("expires in 10 days, then 2026-06-01", "2026-06-01 23:59:59"), ("expires in 10 days", "2026-03-20 23:59:59"),
])
def test_deadlines(text, due):
    got = U.deadline_of(text, datetime(2026, 3, 10))
    assert (str(got) if got else None) == due


def test_canonical_json(spark):
    assert one(spark, '{"b": ', U.canonical_json) is None and one(spark, None, U.canonical_json) is None
    assert one(spark, '{"b": [1, {"d": "é", "c": null}], "a": 2.5}', U.canonical_json) == '{"a":2.5,"b":[1,{"c":null,"d":"é"}]}'


def test_word_extents_against_every_extent():
    rng = random.Random(8)
    words = ["red", "reed", "door", "odor", "key", "keys", "a", "zebra"]
    grams = lambda ws: {f"  {w} "[i : i + 3] for w in ws for i in range(len(w) + 1)}
    for _ in range(300):
        q, t = ([rng.choice(words) for _ in range(rng.randint(0, n))] for n in (3, 9))
        a = grams(q)
        extents = [grams(t[i:j]) for i in range(len(t)) for j in range(i + 1, min(len(t), i + len(q) + U.EXTRA_WORDS) + 1)] if q else []
        want = max((len(a & e) / len(a | e) for e in extents), default=0.0)
        assert U.word_similarity_of(" ".join(q), " ".join(t)) == pytest.approx(want), (q, t)

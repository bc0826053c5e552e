"""Byte-level BPE, token files and section counts, against the libraries they must equal."""

import base64
import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from corvane.llm import bpe, queries, token_counts, token_files

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = ["", "a" * 3000, " " * 500, "\u0558abc", "x\u0558y 1\U00012550", "日本語テキスト" * 50, "'s't're", "\n\n \n x", "🏳️‍🌈" * 20, "\x00\x01", "a.. b", "x?. y", "İ ΣΑΣ σας", "a\x1cb c", "\xa0a\x85b", "<|endoftext|> x", "don't. 3.14, 5.\n"]


def texts(n=400):
    rng = random.Random(1)
    some = "aB éÉ.,\n's3_?\tßΣ\u0301日" + "the of and "
    return ODD + ["".join(rng.choice(some) for _ in range(rng.randint(1, 60))) for _ in range(n)] + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(20)) for _ in range(n)]


def table(spark, values):
    return spark.createDataFrame([(i, t, "z") for i, t in enumerate(values)] + [(None, None, "z"), (0, values[0], "z")], "doc_id long, text string, ids string").repartition(3)


def test_bpe_equals_tiktoken_and_round_trips(spark):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ours, theirs = bpe.coder(RANKS, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in texts():
        assert ours.encode(t) == theirs.encode_ordinary(t), repr(t)
        assert ours.decode(ours.encode(t)) == t.encode()
    rows = bpe.decode(bpe.encode(table(spark, ODD), RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted([t.encode() for t in ODD] + [b"", ODD[0].encode()])
    both = bpe.round_trip(table(spark, ODD), RANKS, P.PATTERN).collect()
    key = lambda r: (str(r.doc_id), r.ids, bytes(r.decoded))
    assert sorted(map(key, both)) == sorted(map(key, rows))
    assert bpe.encode(table(spark, ODD).limit(0), RANKS, P.PATTERN).count() == bpe.round_trip(table(spark, ODD).limit(0), RANKS, P.PATTERN).count() == 0


def test_long_text_in_pieces_and_full_memo(monkeypatch):
    ours = bpe.ByteBPE(RANKS, P.PATTERN)
    text = "the quick  brown fox\n" * 500
    want = ours.encode(text)
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    ours.packed.most = 3
    assert ours.encode(text) == want


def test_word_encoder_equals_tokenizers():
    ours, theirs = token_files.encoder(WORDS), Tokenizer.from_file(WORDS)
    values = texts()
    assert [np.frombuffer(x, "<u2").tolist() for x in ours.encode(values)] == [theirs.encode(t, add_special_tokens=False).ids for t in values]


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for dtype, terminals in ((np.uint16, 49408), (np.uint32, 70_000)):
        parts = [rng.integers(0, 6, n).astype(dtype) for n in (0, 1, 2, 500, 3000)] + [np.full(999, 2, dtype), np.arange(50, dtype=dtype)]
        n = np.array([len(p) for p in parts])
        payload = token_files.pack([1, None, 3, 4, 5, 6, 7], np.concatenate(parts), np.cumsum(n) - n, terminals)
        block = token_files.Block(payload)
        assert block.doc_ids == [1, None, 3, 4, 5, 6, 7]
        for k, p in enumerate(parts):
            assert block.ids(k).tolist() == p.tolist() == block.all_ids()[k].tolist()
        assert len(payload) < np.concatenate(parts).nbytes + 2000
        with pytest.raises(ValueError):
            token_files.Block(payload[:-9] + b"\0" * 9)


@pytest.mark.parametrize(("length", "terminals"), [(3000, 40_000), (20_000, 49_000), (50, 65_536)])
def test_pair_replacement_goes_on_until_no_pair_repeats(length, terminals):
    ids = np.tile(np.random.default_rng(6).integers(0, terminals, length), 20).astype("<u2")
    ids = np.concatenate([ids, np.zeros(5000, "<u2")])
    starts = np.array([0, 5 * length, 5 * length, len(ids)])  # two of them empty
    seq, at, _, _ = token_files.compress(ids, starts, terminals)
    inside = ~np.isin(np.arange(1, len(seq)), at)
    left = Counter(zip(seq[:-1][inside].tolist(), seq[1:][inside].tolist(), strict=True))
    assert max(left.values(), default=0) < token_files.LEAST
    block = token_files.Block(token_files.pack([1, 2, 3, 4], ids, starts, terminals))
    assert all(np.array_equal(block.ids(k), part) for k, part in enumerate(np.split(ids, starts[1:])))


def test_wide_symbols_only_where_they_may_pay(monkeypatch):
    """Random ids with few repeats stay narrow without a wide round; long copies that narrow symbols can't hold go wide, and are smaller for it."""
    rng = np.random.default_rng(9)
    frequent = np.repeat(rng.integers(0, 65_000, (3000, 2)), 5, axis=0)
    noise = rng.permutation(frequent).ravel().astype("<u2")
    seq, _, rules, _ = token_files.compress(noise, np.array([0]), 65_000)
    assert seq.dtype.itemsize == 2 and len(rules) <= 536
    copies = np.tile(rng.integers(0, 65_000, 4000), 12).astype("<u2")
    seq, _, rules, _ = token_files.compress(copies, np.array([0]), 65_000)
    assert seq.dtype.itemsize == 4 and len(seq) < 2000


def test_token_files_ascending_starts(spark):
    theirs = Tokenizer.from_file(WORDS)
    got = token_files.read(token_files.write(table(spark, ODD), WORDS, block_tokens=300)).collect()
    want = [(i, t) for i, t in sorted([*enumerate(ODD), (None, ""), (0, ODD[0])], key=lambda x: (-1 if x[0] is None else x[0]))]
    start = 0
    for r, (i, t) in zip(sorted(got, key=lambda r: r.start), want, strict=True):
        ids = theirs.encode(t, add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert token_files.read(token_files.write(table(spark, ODD).limit(0), WORDS)).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_counts_against_offsets(spark, rule):
    theirs = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    theirs.encode_special_tokens = True
    values = ["", "One. Two\n\n  three\n", "日本\n語 x. y", "a" * 40, "x\n \n y"] + texts(60)
    thirds = lambda t: np.unique([0, len(t) // 3, 2 * len(t) // 3])
    got = {}
    for r in token_counts.count_tokens(table(spark, values), RANKS, P.PATTERN, rule, thirds).collect():
        if r.doc_id:
            got[r.doc_id, r.section] = (r.start, r.end, r.n_tokens, r.crossing)
    for i, t in enumerate(values):
        if not i or not t:
            continue
        starts = thirds(t).tolist()
        ends = [*starts[1:], len(t)]
        want = {s: [0, 0] for s in range(len(starts))}
        for a, b in theirs.encode(t, add_special_tokens=False).offsets:
            held = [max(0, min(b, ends[s]) - max(a, starts[s])) for s in range(len(starts))]
            inside = [s for s, n in enumerate(held) if n]
            s = {"first": inside[0], "last": inside[-1], "most": max(inside, key=lambda s: (held[s], -s))}[rule]
            want[s][0] += 1
            want[s][1] += len(inside) > 1
        assert {s: tuple(w) for s, w in want.items()} == {s: got[i, s][2:] for s in want}, (i, t)


def test_title_and_lines():
    assert token_counts.title_and_lines("One. Two. \nthree\n\nfour").tolist() == [0, 5, 11, 17, 18]
    assert token_counts.title_and_lines("no stop\nOne. Two").tolist() == [0, 8] and token_counts.title_and_lines("x. \n").tolist() == [0, 3] and token_counts.title_and_lines("a\n").tolist() == [0]


def test_registered_section_counts_against_offsets(spark, sf_dir):
    """Every document of the query, its sections as the query cuts them, tokens by the library's own offsets."""
    theirs = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    theirs.encode_special_tokens = True
    got = {}
    for r in queries.op8_token_counts(spark, sf_dir).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        lines = d.text.splitlines(keepends=True) if d.text and not set(d.text) & set("\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029") else None
        if lines is None:
            continue
        at = lines[0].find(". ") + 2
        pieces = [lines[0][:at], lines[0][at:], *lines[1:]] if 2 <= at < len(lines[0]) else lines
        ends = np.cumsum([len(p) for p in pieces])
        held = np.bincount([int(np.searchsorted(ends, a, "right")) for a, _ in theirs.encode(d.text, add_special_tokens=False).offsets], minlength=len(pieces))
        assert sorted(got[d.doc_id]) == [(i, int(e) - len(p), int(e), int(n)) for i, (p, e, n) in enumerate(zip(pieces, ends, held))]


def test_registered_bpe_digests_against_tiktoken(spark, sf_dir):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def want(i, text):
        ids = theirs.encode_ordinary(text or "")
        return (i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode()))

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert sorted(map(tuple, queries.op2_byte_bpe(spark, sf_dir).collect())) == sorted(want(d.doc_id, d.text) for d in docs)
    odd = [(i, t) for i, t in enumerate([*ODD, None])]
    assert sorted(map(tuple, queries.bpe_digests(spark.createDataFrame(odd, "doc_id long, text string")).collect())) == sorted(want(*o) for o in odd)


def test_token_files_refuse_ids_that_are_no_integers(spark):
    with pytest.raises(ValueError):
        token_files.write(spark.createDataFrame([("a", "b")], "doc_id string, text string"), WORDS)


def test_section_counts_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in token_counts.count_tokens(df, RANKS, P.PATTERN).collect()) == [(1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0)]
    assert token_counts.count_tokens(df.limit(0), RANKS, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(df, RANKS, P.PATTERN, "half")

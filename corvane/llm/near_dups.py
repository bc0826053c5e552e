"""N-gram Jaccard join with Bayesian candidate pruning (operator 4).

Texts (lower case, cut at blanks) become sets of five-word shingles; texts with one set are one node from then on.
Candidates are nodes that agree on all values of a band of their MinHash signature: BANDS of ROWS values miss a pair
at the threshold once in ten million. Their signatures are then compared some values at a time. After n values with m
matches, the chance that the similarity reaches the threshold, under a uniform prior, is P(Binomial(n + 1, threshold)
<= m); a pair for which it falls below TOLERANCE is dropped. What is left is verified exactly on the shingle sets.

Buckets of up to SMALL nodes give pairs. Larger ones are crowded; they come from large groups of near copies, whose
pairs grow with the square. A node of crowded buckets lives in the largest of them, its home, and homes are cut into
blocks of about BLOCK nodes and BLOCK_BYTES of text. Two blocks meet, as compressed shingle sets, if nodes of both lie
in one crowded bucket; the task that compares them takes the pairs that share a crowded bucket, prunes them, verifies
the rest, and returns the number of links of each node and a spanning forest of the links, never the pairs. A pair
that shares a crowded bucket is left out of the small ones. No partner or candidate is capped.

Shingles are compared as 64-bit hashes: two sets of m and n shingles seem to share one more with a probability of
about m n / 2^64.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.bpe import Memo
from corvane.llm.common import bound_batches, cut, free_name, hold, without
from corvane.llm.components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
STEP, TOLERANCE = 20, 1e-7
SMALL, BLOCK, BLOCK_BYTES = 64, 512, 8 << 20

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, np.uint64)
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


@functools.cache
def _word_hashes() -> Memo:
    import xxhash

    return Memo(lambda word: xxhash.xxh3_64_intdigest(word))


def _forget() -> None:
    """At the end of each task that makes shingles: the worker lives on, and other stages need its memory."""
    _word_hashes().clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The set of five-word shingles as ascending 64-bit hashes; of fewer words, all of them together make one."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        total += h[j : len(h) - n + 1 + j] * _PLACES[j]
    return np.unique(_mix(total))


def signature(found: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(found), 512):
        x = (_A[:, None] * found[None, at : at + 512] + _B[:, None]) >> np.uint64(32)
        np.minimum(low, x.min(1).astype(np.uint32), out=low)
    return low


@functools.cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n compared values, the fewest matches with which a pair stays."""

    def chance(n: int, m: int) -> float:
        return sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))

    return {n: next(m for m in range(n + 1) if chance(n, m) >= tolerance) for n in range(STEP, HASHES + 1, STEP)}


def may_reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature matrices may belong to pairs that reach the threshold."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n, least in least_matches().items():
        matches = matches + (a[alive, n - STEP : n] == b[alive, n - STEP : n]).sum(1)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
    return alive


def reaches(both: np.ndarray, either: np.ndarray) -> np.ndarray:
    return both >= THRESHOLD * either - 1e-9


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def _key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (digest of the shingle set), text digest, signature; the last three null where a text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hold("near_dups", _forget)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                texts = [t.as_py() for t in batch.column(1)[at : at + 1024]]
                sets = [shingles(t) for t in texts]
                made = [(_key(s), xxhash.xxh3_128_digest(t), signature(s).tobytes()) if len(s) else (None, None, None) for s, t in zip(sets, texts, strict=True)]
                columns = [pa.array([m[k] for m in made], pa.binary()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 1024], *columns], ["id", "key", "digest", "signature"])
        _forget()

    binary = [T.StructField(c, T.BinaryType()) for c in ("key", "digest", "signature")]
    return df.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, T.StructType([T.StructField("id", df.schema[id_col].dataType), *binary]))


def _buckets(signatures: np.ndarray) -> np.ndarray:
    """The bucket of each signature (row) in each band."""
    values = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    total = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    for j in range(ROWS):
        total = _mix(total + values[:, :, j] * _PLACES[j])
    return total.view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            found = _buckets(_signatures(part.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], ["bucket", "node"])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            stay = pa.array(may_reach(_signatures(part.column(2)), _signatures(part.column(3))))
            yield pa.RecordBatch.from_arrays([part.column(0).take(stay), part.column(1).take(stay)], ["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = Memo(shingles, 64)
    for batch in batches:
        stay = []
        for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
            x, y = (shingles(t) if len(t) > 48 else sets[t] for t in (x.as_py(), y.as_py()))
            both = len(np.intersect1d(x, y, assume_unique=True))
            if reaches(np.array(both), np.array(len(x) + len(y) - both)):
                stay.append(i)
        yield batch.select(["a", "b", "texts_a", "texts_b"]).take(pa.array(stay, pa.int64()))
    _forget()


CELL = ["nodes", "texts", "crowded", "signatures", "sizes", "sets"]


def _pack(table: pa.Table) -> pa.Table:
    """One block as one row: its nodes, how many texts each stands for, their crowded buckets, signatures and shingle sets."""
    import zstandard

    signatures = _signatures(table.column("signature").combine_chunks())
    found = _buckets(signatures)
    found[~np.isin(found, table.column("buckets").combine_chunks().flatten().to_numpy())] = 0
    sets = [shingles(t.as_py()) for t in table.column("text")]
    _forget()
    packed = zstandard.ZstdCompressor(level=3).compress(np.concatenate(sets).tobytes())
    nodes, texts = (table.column(c).to_numpy() for c in ("node", "texts"))
    cell = [nodes.tobytes(), texts.tobytes(), found.tobytes(), signatures.tobytes(), np.array([len(s) for s in sets], np.int64).tobytes(), packed]
    return pa.table({"home": table.column("home")[:1], "block": table.column("block")[:1], **{c: pa.array([v], pa.binary()) for c, v in zip(CELL, cell, strict=True)}})


class Cell:
    def __init__(self, row: dict, side: str):
        import zstandard

        self.nodes, self.texts, found, signatures, self.sizes = (np.frombuffer(row[f"{c}_{side}"], t) for c, t in zip(CELL, (np.int64, np.int64, np.int64, np.uint32, np.int64)))
        self.crowded, self.signatures = found.reshape(-1, BANDS), signatures.reshape(-1, HASHES)
        self.shingles = np.frombuffer(zstandard.ZstdDecompressor().decompress(row[f"sets_{side}"], max_output_size=8 * int(self.sizes.sum()) + 1), np.uint64)
        self.owner = np.repeat(np.arange(len(self.nodes)), self.sizes)


def _candidates(x: Cell, y: Cell, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y that share a crowded bucket and that pruning leaves; of one block with itself each pair once."""
    share = np.zeros((len(x.nodes), len(y.nodes)), bool)
    for k in range(BANDS):
        a, b = x.crowded[:, k, None], y.crowded[None, :, k]
        share |= (a == b) & (a != 0)
    p, q = np.nonzero(np.triu(share, 1) if same else share)
    stay = [at + may_reach(x.signatures[p[at : at + 16_384]], y.signatures[q[at : at + 16_384]]) for at in range(0, len(p), 16_384)]
    stay = np.concatenate(stay) if stay else np.zeros(0, np.intp)
    return p[stay], q[stay]


def _shared(x: Cell, y: Cell, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many shingles the sets of each pair of rows have in common: bits of both sets, for some shingles at a time."""
    common, width = np.intersect1d(x.shingles, y.shingles), 1 << 15
    total = np.zeros(len(p), np.int64)
    places = []
    for cell in (x, y):
        at = np.minimum(np.searchsorted(common, cell.shingles), max(len(common) - 1, 0))
        hit = np.flatnonzero(common[at] == cell.shingles) if len(common) else np.zeros(0, np.intp)
        order = hit[np.argsort(at[hit], kind="stable")]
        places.append((at[order], cell.owner[order], len(cell.nodes)))
    for lo in range(0, len(common), width):
        bits = []
        for at, owner, n in places:
            first, last = np.searchsorted(at, (lo, lo + width))
            has = np.zeros((n, min(width, -(-(len(common) - lo) // 64) * 64)), bool)
            has[owner[first:last], at[first:last] - lo] = True
            bits.append(np.packbits(has, axis=1).view(np.uint64))
        for k in range(0, len(p), 2048):
            total[k : k + 2048] += np.bitwise_count(bits[0][p[k : k + 2048]] & bits[1][q[k : k + 2048]]).sum(1, dtype=np.int64)
    return total


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For two blocks (or one with itself): the number of texts each node is linked to between them, and its parent in a forest."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            same = row["nodes_a"] == row["nodes_b"]
            x = Cell(row, "a")
            y = x if same else Cell(row, "b")
            p, q = _candidates(x, y, same)
            both = _shared(x, y, p, q)
            linked = reaches(both, x.sizes[p] + y.sizes[q] - both)
            p, q = p[linked], q[linked]
            n = len(x.nodes)
            nodes, texts = (x.nodes, x.texts) if same else (np.concatenate([x.nodes, y.nodes]), np.concatenate([x.texts, y.texts]))
            a, b = p, q if same else q + n
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
            degree = np.bincount(a, texts[b], len(nodes)).astype(np.int64)
            root, was = np.arange(len(nodes)), None
            while was is None or (root != was).any():  # the smallest row that a row is joined to, until nothing changes
                was = root.copy()
                np.minimum.at(root, a, was[b])
            some = np.flatnonzero(degree)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]]), pa.array(degree[some])], ["node", "parent", "links"])


def _crowd(crowd: DataFrame, texts: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """crowd (bucket, node, n): members of crowded buckets -> node, parent, links, as often as blocks of the node met others."""
    parts = max(int(crowd.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    homes = crowd.groupBy("node").agg(F.max(F.struct("n", "bucket"))["bucket"].alias("home"), F.collect_list("bucket").alias("buckets"))
    living = cut(homes.join(texts, "node").join(nodes.select("node", "signature"), "node"), "living")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.octet_length("text")) / F.lit(BLOCK_BYTES))).cast("int")
    sizes = cut(living.groupBy("home").agg(blocks.alias("blocks")), "home_sizes")
    placed = living.join(sizes, "home").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.select("home", "block", "node", "texts", "buckets", "signature", "text").repartition(parts, "home", "block")  # not by home alone, whatever the join did
    cells = cut(dealt.groupBy("home", "block").applyInArrow(_pack, f"home long, block int, {', '.join(f'{c} binary' for c in CELL)}"), "cells")
    found = crowd.select("bucket", "node").join(placed.select("node", F.struct("home", "block").alias("cell")), "node").select("bucket", "cell").distinct()
    pairs = found.select("bucket", F.col("cell").alias("i")).join(found.select("bucket", F.col("cell").alias("j")), "bucket").where("i <= j").select("i", "j").distinct()
    side = lambda name, key: cells.select(F.struct("home", "block").alias(key), *[F.col(c).alias(f"{c}_{name}") for c in CELL])
    # Comparing takes long for its bytes: a number of partitions that adaptive execution leaves alone.
    met = pairs.join(side("a", "i"), "i").repartition(parts, "i", "j").join(side("b", "j"), "j")
    return met.select(*[f"{c}_{s}" for s in "ab" for c in CELL]).mapInArrow(_meet, "node long, parent long, links long")


def _classes(df: DataFrame, id_col: str, text_col: str, small: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows, and class_id and n_links by key."""
    prints = cut(fingerprints(bound_batches(df), id_col, text_col), "fingerprints")
    worded = prints.where("key is not null")
    groups = worded.groupBy("key").agg(F.min("id").alias("low"), F.any_value("signature").alias("signature"))
    texts_of_key = worded.select("key", "digest").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    nodes = cut(groups.join(texts_of_key, "key").withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = cut(nodes.select("node", "signature").mapInArrow(_bands, "bucket long, node long"), "bands")
    buckets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(bands.join(buckets, "bucket"), "bucket_members")

    crowd = members.where(F.col("n") > small)
    crowded = not crowd.isEmpty()
    in_small = members.where(F.col("n") <= small)
    if crowded:
        own = cut(crowd.groupBy("node").agg(F.collect_list("bucket").alias("buckets")), "crowded_nodes")
        in_small = in_small.join(own, "node", "left")
    else:
        in_small = in_small.withColumn("buckets", F.lit(None).cast("array<long>"))
    listed = in_small.groupBy("bucket").agg(F.collect_list(F.struct("node", "buckets")).alias("l")).select("l")

    def partners(x, i):
        later = F.filter(F.slice("l", i + 2, F.size("l")), lambda y: ~F.coalesce(F.arrays_overlap(x["buckets"], y["buckets"]), F.lit(False)))
        return F.transform(later, lambda y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")))

    pairs = listed.select(F.explode(F.flatten(F.transform("l", partners))).alias("p")).select("p.a", "p.b").distinct()
    of = lambda side: nodes.select(F.col("node").alias(side), F.col("signature").alias(f"signature_{side}"))
    near = cut(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "signature_a", "signature_b").mapInArrow(_prune, "a long, b long"), "pruned")

    wanted = near.select(F.explode(F.array("a", "b")).alias("node"))
    if crowded:
        wanted = wanted.unionByName(own.select("node"))
    wanted = nodes.join(wanted.distinct(), "node").select("node", "key", "low", "texts")
    texts = cut(texts_of(df, wanted, id_col, text_col), "texts")
    text = lambda side: texts.select(F.col("node").alias(side), F.col("texts").alias(f"texts_{side}"), F.col("text").alias(f"text_{side}"))
    both = near.join(text("a"), "a").join(text("b"), "b").select("a", "b", "texts_a", "texts_b", "text_a", "text_b")
    links = cut(both.mapInArrow(_verify, "a long, b long, texts_a long, texts_b long"), "links")

    ends = F.array(F.struct(F.col("a").alias("node"), F.col("texts_b").alias("links")), F.struct(F.col("b").alias("node"), F.col("texts_a").alias("links")))
    degrees = links.select(F.explode(ends).alias("e")).select("e.node", "e.links")
    edges = links.select("a", "b")
    if crowded:
        forest = cut(_crowd(crowd, texts, nodes, block), "forest")
        degrees = degrees.unionByName(forest.select("node", "links"))
        edges = edges.unionByName(forest.select(F.col("node").alias("a"), F.col("parent").alias("b")))

    classes = cut(components(edges), "classes")
    degrees = degrees.groupBy("node").agg(F.sum("links").alias("links"))
    ranked = nodes.select("node", "key", "low", "texts").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = ranked.groupBy("root").agg(F.min("low").alias("class_id"))
    n_links = F.col("texts") - 1 + F.coalesce("links", F.lit(0))
    return prints, ranked.join(lowest, "root").join(degrees, "node", "left").select("key", "class_id", n_links.alias("n_links"))


def near_dups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """One row per row of df: id, class_id, n_links.

    Two texts are linked if their shingle sets have a Jaccard similarity of THRESHOLD or more. class_id is the smallest
    id that can be reached over links; n_links is the number of other texts linked to the row's own (rows of one text
    count once, texts that differ but share a set are linked). A text without a word (null, empty) is a class of its
    own, with its own id; so is, with a null class_id, one with a null id and no other id in its class. A text of fewer
    than five words is one shingle. Ids of any type that has an order will do. An empty table gives no rows; other
    columns are ignored.
    """
    prints, known = _classes(df, id_col, text_col, small, block)
    worded = prints.where("key is not null").select("id", "key").join(known, "key").select("id", "class_id", "n_links")
    empty = prints.where("key is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return worded.unionByName(empty).select(F.col("id").alias(id_col), "class_id", "n_links")


def texts_of(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, texts, text for wanted (node, key, low, texts): a text of the node's shingle set, found by its smallest id, then by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key(shingles(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0)], ["key", "text"])
        _forget()

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    rows = rows.join(wanted.select("low").distinct(), F.col("id").eqNullSafe(F.col("low")), "left_semi").select("text")
    return rows.mapInArrow(run, "key binary, text string").join(wanted.select("node", "key", "texts"), "key").select("node", "texts", "text").dropDuplicates(["node"])


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of df, with df's columns: that with the smallest id, null last; rows without a word all stay.

    Where every row has an id of its own, the ids that go are enough. Else rows are numbered first, and of those that
    share the smallest id one stays, so that neither a repeated nor a null id loses a text.
    """
    unique = df.where(F.col(id_col).isNull()).isEmpty() and df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    if unique:
        found = near_dups(df.select(id_col, text_col), id_col, text_col)
        return without(df, id_col, found.where(F.col(id_col) != F.col("class_id")).select(id_col))
    number = free_name(df, "row_number")
    rows = cut(df.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = near_dups(rows.select(number, text_col), number, text_col)
    ids = rows.select(F.col(number).alias("n"), F.col(id_col).alias("id"))
    found = cut(found.select(F.col(number).alias("n"), F.col("class_id").alias("class")).join(ids, "n"), "numbered_classes")
    stays = found.groupBy("class").agg(F.min(F.struct(F.col("id").isNull(), "id", "n"))["n"].alias("n"))
    return without(rows, number, found.join(stays.select("n"), "n", "left_anti").select("n")).drop(number)

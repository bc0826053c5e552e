"""Maximum inner product search with score-aware quantisation (operator 5).

Vectors are cut into pairs of dimensions, each coded by one of 16 centres: four bits. Centres and codes minimise an
anisotropic error, in which the part of the residual parallel to the vector, the part that moves the scores that
matter, costs ETA times the rest; codes are chosen by coordinate descent and centres by solving the weighted least
squares over all of them together. The centres are fitted on a bounded SAMPLE; every row is coded and searched.

Rows are coded at unit length, with their norm beside the code; what the centres leave over is kept as 16-bit steps of
the row's own size, with the length of what is missing even then. Blocks of codes are made where rows are read; vectors
stay behind. A block of codes and a block of queries meet in a task, where the tables of inner products between a query
and all centres (joined two by two, so one byte of code is one look-up), and the steps, give every row a score that is
off by no more than a known bound. A query keeps each row whose score can reach the `rerank`-th best sure one, in the
task and then over all tasks, however many those are: no row that belongs to the nearest is lost, whatever the vectors
are like. Only then vectors move: those of rows that some query of a block has kept, once a block, to be scored exactly,
in double precision, against the original queries. The best k of a query come last.

The scan looks at all pairs of queries and codes: time grows with rows times queries. What moves: the codes once per
block of queries (QUERY_BYTES), the queries once per SLICE row blocks, a few numbers for each kept id, kept vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import bound_batches, cut, hash60

CENTRES, SAMPLE, ROUNDS = 16, 4096, 3
ROW_BLOCK, QUERY_BLOCK, SLICE = 8_192, 512, 32
#: Bytes of a block of queries at most, where there are more than 32 blocks of QUERY_BLOCK; of a block's vectors to be scored exactly.
QUERY_BYTES, EXACT_BYTES = 16 << 20, 64 << 20
#: Steps to which what the centres leave over is rounded; rows that a task holds at most before it hands them on.
STEPS, HELD = 32_767, 4_000_000
#: The columns of a block of coded rows.
BLOCK = ["rows", "ids", "codes", "steps", "sizes"]
#: Scores above this share of the norms' product are the ones to get right.
THRESHOLD = 0.2


def eta(dims: int) -> float:
    return max(1.0, (dims - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


def paired(x: np.ndarray) -> np.ndarray:
    """rows x subspaces x 2, with zeros for what an odd number of pairs lacks: codes come two to a byte."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % 4))).reshape(len(x), -1, 2)


def assign(x: np.ndarray, centres: np.ndarray, weight: float, codes: np.ndarray | None = None, sweeps: int = 2) -> np.ndarray:
    """Codes (rows x subspaces) that minimise |r|^2 + (weight - 1) (r . x/|x|)^2 by coordinate descent."""
    x = paired(x)
    unit = x / np.maximum(np.sqrt((x * x).sum((1, 2), keepdims=True)), 1e-30)
    subspaces = x.shape[1]
    if codes is None:
        codes = np.stack([((x[:, m, None, :] - centres[m]) ** 2).sum(-1).argmin(1) for m in range(subspaces)], 1)
    rest = x - centres[np.arange(subspaces), codes]
    along = (rest * unit).sum((1, 2))
    for _ in range(sweeps):
        for m in range(subspaces):
            others = along - (rest[:, m] * unit[:, m]).sum(1)
            r = x[:, m, None, :] - centres[m]
            parallel = (r * unit[:, m, None, :]).sum(-1)
            pick = ((r * r).sum(-1) + (weight - 1) * (others[:, None] + parallel) ** 2).argmin(1)
            codes[:, m] = pick
            at = np.arange(len(x))
            rest[:, m], along = r[at, pick], others + parallel[at, pick]
    return codes


def fit(sample: np.ndarray) -> np.ndarray:
    """Centres: subspaces x 16 x 2."""
    rng, weight = np.random.default_rng(3), eta(sample.shape[1])
    x = paired(sample.astype(np.float64))
    n, subspaces, _ = x.shape
    centres = x[rng.integers(0, n, (CENTRES, subspaces)), np.arange(subspaces)].transpose(1, 0, 2).copy()
    centres += 1e-6 * rng.standard_normal(centres.shape)
    for _ in range(8):  # plain k-means to begin with
        codes = np.stack([((x[:, m, None, :] - centres[m]) ** 2).sum(-1).argmin(1) for m in range(subspaces)], 1)
        for m in range(subspaces):
            size = np.bincount(codes[:, m], minlength=CENTRES)
            for d in (0, 1):
                total = np.bincount(codes[:, m], x[:, m, d], CENTRES)
                centres[m, size > 0, d] = total[size > 0] / size[size > 0]
    unit = x / np.maximum(np.sqrt((x * x).sum((1, 2), keepdims=True)), 1e-30)
    norm = (x * unit).sum((1, 2))
    for _ in range(ROUNDS):
        codes = assign(sample.astype(np.float64), centres, weight, codes, 1)
        place = (np.arange(subspaces) * CENTRES + codes) * 2  # of a row's centres among all coordinates
        size = subspaces * CENTRES * 2
        onto = np.zeros((n, size))
        for d in (0, 1):
            np.put_along_axis(onto, place + d, unit[:, :, d], 1)
        left = (weight - 1) * (onto.T @ onto)
        right = (weight - 1) * (onto.T @ norm)
        for d in (0, 1):
            left[np.arange(size), np.arange(size)] += np.bincount((place + d).ravel(), minlength=size)
            right += np.bincount((place + d).ravel(), x[:, :, d].ravel(), size)
        unused = np.diag(left) < 1e-9
        solved = np.linalg.solve(left + np.eye(size) * 1e-6, right).reshape(subspaces, CENTRES, 2)
        centres = np.where(unused.reshape(centres.shape), centres, solved)
    return centres


def scan(queries: np.ndarray, codes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Approximate scores, queries x rows. codes: packed, rows x bytes."""
    tables = np.einsum("qmd,mkd->qmk", paired(queries), centres).astype(np.float32)
    tables = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(queries), -1, CENTRES * CENTRES)
    total = np.zeros((len(queries), len(codes)), np.float32)
    for b in range(codes.shape[1]):
        total += np.take(tables[:, b], codes[:, b], axis=1)
    return total


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x at unit length and its norms, neither of which overflows or vanishes where squares would."""
    most = np.abs(x).max(1, keepdims=True)
    y = x / most
    length = np.sqrt((y * y).sum(1, keepdims=True))
    return y / length, (most * length)[:, 0]


def encode(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of unit length: packed codes, steps of what is left over, and (step, bound): how far a score over the norms may be off.

    The bound holds what is still missing and the rounding of the look-ups and sums, all in single precision.
    """
    codes = assign(x, centres, eta(x.shape[1]))
    near = centres[np.arange(codes.shape[1]), codes].reshape(len(x), -1)
    rest = x - near[:, : x.shape[1]]
    step = (np.maximum(np.abs(rest).max(1), 1e-30) / STEPS).astype(np.float32).astype(np.float64)
    steps = np.clip(np.rint(rest / step[:, None]), -STEPS - 1, STEPS).astype(np.int16)
    missing = rest - steps * step[:, None]
    length = lambda y: np.sqrt((y * y).sum(1))
    bound = length(missing) * (1 + 1e-6) + (x.shape[1] + 16) * 2.0**-23 * (length(near) + length(rest) + 1e-6)
    return (codes[:, 0::2] * CENTRES + codes[:, 1::2]).astype(np.uint8), steps, np.stack([step, bound], 1)


class Kept:
    """The rows that may be among the `most` best ids of each query of a block.

    A row's score lies between two numbers. Rows whose upper one is under the lower one of `most` other ids are dropped;
    the rest is held, or handed on once there are more than HELD. Scores are without the query's own norm.
    """

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, centres: np.ndarray, most: int, repeats: bool):
        self.query_ids, self.queries, self.centres, self.most, self.repeats = query_ids, unit(queries)[0], centres, most, repeats
        self.lists = [self.nothing()] * len(queries)
        self.sure = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries)
        self.least = np.full(len(queries), -np.inf)

    @staticmethod
    def nothing() -> tuple[np.ndarray, ...]:
        return np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, rows: np.ndarray, ids: np.ndarray, codes: np.ndarray, steps: np.ndarray, norms: np.ndarray, step: np.ndarray, bound: np.ndarray) -> None:
        steps = steps.astype(np.float32)
        for at in range(0, len(self.queries), 128):
            q = self.queries[at : at + 128]
            score = scan(q, codes, self.centres) + (q.astype(np.float32) @ steps.T) * step
            for i, one in enumerate(score, at):
                high = (one + bound) * norms
                pick = np.flatnonzero((high >= self.least[i]) & (ids != self.query_ids[i]))
                if not len(pick):
                    continue
                low, high = (one[pick] - bound[pick]) * norms[pick], high[pick]
                self._raise(i, low, ids[pick])
                held = tuple(map(np.concatenate, zip(self.lists[i], (low, high, rows[pick], ids[pick]), strict=True)))
                still = held[1] >= self.least[i]
                self.lists[i] = tuple(c[still] for c in held)

    def _raise(self, i: int, low: np.ndarray, ids: np.ndarray) -> None:
        """The lower numbers of the `most` best ids so far, and the least of them once there are as many."""
        low, ids = np.concatenate([self.sure[i][0], low]), np.concatenate([self.sure[i][1], ids])
        if self.repeats:
            order = np.argsort(-low, kind="stable")
            first = order[np.sort(np.unique(ids[order], return_index=True)[1])[: self.most]]
        else:
            first = np.argpartition(-low, self.most - 1)[: self.most] if len(low) > self.most else slice(None)
        self.sure[i] = low[first], ids[first]
        if len(self.sure[i][0]) >= self.most:
            self.least[i] = self.sure[i][0].min()

    def held(self) -> int:
        return sum(len(one[0]) for one in self.lists)

    def take(self) -> tuple[np.ndarray, ...]:
        """q, low, high, rows, ids of what is held, which is forgotten."""
        q = np.repeat(np.arange(len(self.lists), dtype=np.int32), [len(one[0]) for one in self.lists])
        out = (q, *(np.concatenate(c) for c in zip(*self.lists, strict=True)))
        self.lists = [self.nothing()] * len(self.lists)
        return out


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v of the rows that take part; v is an array of float where the column is one, else of double."""
    kind = "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def search(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by every, its k nearest other rows.

    Ties go to the smaller id; a query with fewer candidates gets them all. Rows with a null id, a null or zero vector,
    or a component that is null or not finite take no part; nor do vectors of another length than most. Rows that
    repeat a query's id count as its own. Rows alike in id and vector count once; of an id with different vectors each
    is searched and asked, and a query_id lists a vec_id once, with the best score of their vectors. Ids are integers,
    others are refused. An empty table gives no rows; other columns are ignored.
    """
    if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} must be an integer")
    spark = df.sparkSession
    base = cut(bound_batches(usable(df, id_col, vector_col)).distinct().withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = base.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).orderBy(F.desc("n"), "dims").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n, n_queries = sizes[0]
    base = base.where(F.size("v") == dims)
    repeats = not base.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    most = max(k, rerank or 0)
    order = hash60("fit:", F.col("id"))
    share = min(1.0, SAMPLE / n) * float(1 << 60)
    sample = base.where(order.cast("double") <= share).select(order.alias("order"), "v").orderBy("order").limit(2 * SAMPLE).toArrow()
    centres = fit(unit(vectors(sample.column("v"), dims).astype(np.float64))[0] if sample.num_rows else np.ones((1, dims)))

    query_blocks = max(1, min(32, -(-n_queries // QUERY_BLOCK)), -(-n_queries * dims * 8 // QUERY_BYTES))
    slices = -(-n // (ROW_BLOCK * SLICE))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def index(batches):
        held = []
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                v, norms = unit(vectors(part.column(2), dims).astype(np.float64))
                codes, steps, sizes_ = encode(v, centres)
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), codes, steps, np.column_stack([norms, sizes_])))
                if sum(len(h[0]) for h in held) >= ROW_BLOCK:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    def block(held):
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(c).tobytes()], pa.binary()) for c in zip(*held, strict=True)], BLOCK)

    def plain(table: pa.Table) -> pa.Table:
        return pa.table({"query_block": table.column("query_block")[:1], "query_ids": [table.column("id").to_numpy().tobytes()], "q": [vectors(table.column("v"), dims).astype(np.float64).tobytes()]})

    def scanned(batches):
        kept, now = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("query_block", *BLOCK)}
                if row["query_block"] != now:
                    if kept:
                        yield from flush(kept, now)
                    now, query_ids, q = row["query_block"], batch.column("query_ids")[i].as_py(), batch.column("q")[i].as_py()
                    kept = Kept(np.frombuffer(query_ids, np.int64), np.frombuffer(q).reshape(-1, dims), centres, most, repeats)
                ids = np.frombuffer(row["ids"], np.int64)
                sizes_ = np.frombuffer(row["sizes"]).reshape(len(ids), 3).T
                kept.add(np.frombuffer(row["rows"], np.int64), ids, np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["steps"], np.int16).reshape(len(ids), dims), *sizes_)
                if kept.held() > HELD:
                    yield from flush(kept, now)
        if kept:
            yield from flush(kept, now)

    def flush(kept: Kept, query_block: int):
        q, low, high, rows, ids = kept.take()
        for at in range(0, len(q), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q[part]), query_block, np.int32)), *(pa.array(c[part]) for c in (q, rows, ids, low, high))], ["query_block", "q", "row", "id", "low", "high"])

    codes = cut(base.select("row", "id", "v").mapInArrow(index, ", ".join(f"{c} binary" for c in BLOCK)).withColumn("slice", F.pmod(F.monotonically_increasing_id(), F.lit(slices)).cast("int")), "vector_index")
    deal = F.pmod(F.xxhash64("row", F.lit("query")), F.lit(query_blocks)).cast("int")
    asked = cut(base.where(F.col("id") % every == 0).withColumn("query_block", deal).groupBy("query_block").applyInArrow(plain, "query_block int, query_ids binary, q binary"), "queries")
    every_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    met = codes.withColumn("query_block", every_of(query_blocks)).repartition(max(parts, query_blocks * slices), "query_block", "slice").sortWithinPartitions("query_block", "slice")
    met = met.join(asked.withColumn("slice", every_of(slices)), ["query_block", "slice"]).select("query_block", *BLOCK, "query_ids", "q")
    kept = cut(met.mapInArrow(scanned, "query_block int, q int, row long, id long, low double, high double"), "kept")
    # A task hands on rows before it has seen all of them, and a query's rows come from as many tasks as there are slices.
    sure = kept.groupBy("query_block", "q", "id").agg(F.max("low").alias("low"))
    sure = sure.withColumn("place", F.row_number().over(Window.partitionBy("query_block", "q").orderBy(F.desc("low")))).where(F.col("place") <= most)
    sure = sure.groupBy("query_block", "q").agg(F.when(F.count(F.lit(1)) >= most, F.min("low")).alias("least"))
    kept = cut(kept.join(sure, ["query_block", "q"]).where(F.col("least").isNull() | (F.col("high") >= F.col("least"))).select("query_block", "q", "row"), "sure")
    largest = kept.groupBy("query_block").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    rest = max(1, -(-largest * (dims * 8 + 64) // EXACT_BYTES))

    def exact(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        v, ids, q_of = vectors(rows.column("v"), dims).astype(np.float64), rows.column("id").to_numpy(), rows.column("qs").combine_chunks()
        query_ids, q = np.frombuffer(queries.column("query_ids")[0].as_py(), np.int64), np.frombuffer(queries.column("q")[0].as_py()).reshape(-1, dims)
        at, of = np.repeat(np.arange(len(v)), q_of.value_lengths().to_numpy()), q_of.flatten().to_numpy()
        score = np.concatenate([np.einsum("ij,ij->i", v[at[i : i + 65_536]], q[of[i : i + 65_536]]) for i in range(0, len(at), 65_536)])
        query, vec = query_ids[of], ids[at]
        order = np.lexsort((vec, -score, query))
        order = order[np.sort(np.unique(np.stack([query[order], vec[order]]), axis=1, return_index=True)[1])] if repeats else order
        first = np.searchsorted(query[order], query[order])
        order = order[np.arange(len(order)) - first < k]
        return pa.table({"query_id": query[order], "vec_id": vec[order], "score": score[order]})

    needed = kept.groupBy("query_block", "row").agg(F.collect_list("q").alias("qs")).join(base, "row")
    needed = needed.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(rest)).cast("int")).select("query_block", "part", "id", "v", "qs").groupBy("query_block", "part")
    scored = needed.cogroup(asked.withColumn("part", every_of(rest)).groupBy("query_block", "part")).applyInArrow(exact, "query_id long, vec_id long, score double")
    found = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def vectors(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

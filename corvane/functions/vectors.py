"""Vector expressions on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def sign_words(v: Column, dims: int) -> Column:
    """The signs of a vector, 32 to a long: bit i of word j is set if dimension 32 j + i is over 0."""
    def word(j: int) -> Column:
        bits = [F.when(F.element_at(v, 32 * j + i + 1) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(min(32, dims - 32 * j))]
        return sum(bits[1:], bits[0])

    return F.array(*[word(j) for j in range(-(-dims // 32))])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    return F.transform(F.array(F.struct(v.alias("v"), norm(v).alias("n"))), lambda p: F.transform(p["v"], lambda x: x / p["n"]))[0]


def layer_norm(v: Column, epsilon: float = 1e-5) -> Column:
    """Mean 0 and variance 1 over a vector's own components."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    centred = F.transform(F.array(F.struct(v.alias("v"), (total(v) / F.size(v)).alias("m"))), lambda p: F.transform(p["v"], lambda x: x - p["m"]))[0]
    return F.transform(F.array(F.struct(centred.alias("c"), F.sqrt(dot(centred, centred) / F.size(centred) + epsilon).alias("sd"))), lambda p: F.transform(p["c"], lambda x: x / p["sd"]))[0]


def mean_pool(rows: DataFrame, by: str, vector: str, mask: str, dims: int) -> DataFrame:
    """by, v, n: the mean of a group's vectors where the mask is set. One sum a dimension, so no group is gathered."""
    sums = [F.sum(F.when(F.col(mask), F.col(vector)[i])) for i in range(dims)]
    n = F.count_if(F.col(mask))
    return rows.groupBy(by).agg(F.array(*[s / F.greatest(n, F.lit(1)) for s in sums]).alias("v"), n.alias("n"))


def seeded_gaussian(seed: str, i: Column, dims: int) -> Column:
    """Independent standard normal numbers from digests of (seed, i, place), by the polar form of two uniform ones."""

    def uniform(stream: str, k: int) -> Column:
        text = F.concat(F.lit(f"{seed}/{stream}/"), i.cast("string"), F.lit(f"/{k}"))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")

    return F.array(*[F.sqrt(-2 * F.log((uniform("a", k) + 1) / F.lit(float((1 << 52) + 1)))) * F.cos(2 * F.pi() * uniform("b", k) / F.lit(float(1 << 52))) for k in range(dims)])

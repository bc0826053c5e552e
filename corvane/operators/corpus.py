"""A seeded question corpus, certificates, and weights fitted to ranks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The families of questions and a stream per purpose.
FAMILIES = ["paraphrase_nolex", "rare_token", "entity_swap", "near_dup", "date_filter", "partial_ref", "typo_noisy"]


def draw(seed: str, label: str, i: Column, n: int) -> Column:
    """A number in [0, n) from a named stream: the same whatever else is drawn."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/{label}/"), i.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long") % n


def spread_ids(rows: DataFrame, key: str, space: int) -> DataFrame:
    """rows (key) -> id, key: rows in the order of their key take evenly spread ids of a larger space."""
    n = rows.count()
    numbered = rows.select(key, (F.row_number().over(Window.orderBy(key)) - 1).alias("k"))  # as few as the structured rows
    return numbered.select(F.floor(F.col("k").cast("long") * space / F.lit(n)).alias("id"), key)


def generate(spark: SparkSession, n: int, seed: str, words: list[str]) -> DataFrame:
    """id, family, title, body, occurred_at, rare_token of n memories, row by row from their number: no state, any order."""
    i = F.col("id")
    word = lambda label: F.element_at(F.array(*map(F.lit, words)), (draw(seed, label, i, len(words)) + 1).cast("int"))
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), (draw(seed, "family", i, len(FAMILIES)) + 1).cast("int"))
    rows = spark.range(n).select("id", family.alias("family"), F.concat_ws(" ", word("t1"), word("t2")).alias("title"), F.concat_ws(" ", *[word(f"b{k}") for k in range(8)]).alias("body"))
    rows = rows.withColumn("occurred_at", F.date_add(F.lit("2015-01-01").cast("date"), draw(seed, "day", i, 3652).cast("int")).cast("string"))
    token = F.concat(F.substring(F.md5(F.concat(F.lit(seed), i.cast("string")).cast("binary")), 1, 3), F.lit("-"), draw(seed, "rare", i, 9000) + 1000)
    return rows.withColumn("rare_token", F.when(F.col("family") == "rare_token", token))


def questions_of(memories: DataFrame, seed: str) -> DataFrame:
    """memories of generate() with a question each, made by the builder of the memory's family."""
    word = lambda c, i: F.get(F.split(c, " "), i)
    a, b, c = word("title", 0), word("title", 1), word("body", 0)
    token = F.concat(F.substring(F.md5(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary")), 1, 3), F.lit("-"), draw(seed, "rare", F.col("id"), 9000) + 1000)
    text = {
        "rare_token": F.concat(F.lit("what was "), token), "entity_swap": F.concat_ws(" ", b, a), "near_dup": F.concat_ws(" ", a, b, c), "date_filter": F.concat(a, F.lit(" in "), F.year(F.col("occurred_at").cast("date"))),
        "partial_ref": F.concat(F.lit("the "), a), "typo_noisy": F.concat_ws(" ", with_typo(a, F.lit(1)), b),
    }
    question = F.concat(F.lit("something like "), c)
    for family, made in text.items():
        question = F.when(F.col("family") == family, made).otherwise(question)
    return memories.withColumn("question", question)


def shuffled(rows: DataFrame, seed: str, key: str = "id") -> DataFrame:
    """key, place: a seeded order. Places are counted in two steps, by the digest's first byte and within it, so no task holds all rows."""
    digest = F.md5(F.concat(F.lit(f"{seed}/shuffle/"), F.col(key).cast("string")).cast("binary"))
    rows = rows.select(key, digest.alias("digest")).withColumn("lead", F.substring("digest", 1, 2))
    sizes = rows.groupBy("lead").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("lead", F.coalesce(F.sum("n").over(Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # 256 rows
    within = F.row_number().over(Window.partitionBy("lead").orderBy("digest", key)) - 1
    return rows.withColumn("within", within).join(before, "lead").select(key, (F.col("before") + F.col("within")).alias("place"))


def retarget(rows: DataFrame, space: int, seed: str, rounds: int) -> DataFrame:
    """rows (id, family) -> id, target, rounds: the first target, of one drawn a round, that is another row of the same family; null if none is."""
    tried = rows.select("id", "family", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r"))
    label = F.concat(F.lit(f"{seed}/retarget/"), "r", F.lit("/"), "id")
    tried = tried.withColumn("target", F.conv(F.substring(F.md5(label.cast("binary")), 1, 15), 16, 10).cast("long") % space)
    fits = tried.join(rows.select(F.col("id").alias("target"), "family"), ["target", "family"]).where("target <> id")
    first = fits.groupBy("id").agg(F.min(F.struct("r", "target")).alias("f"))
    return rows.join(first, "id", "left").select("id", F.col("f.target").alias("target"), F.coalesce(F.col("f.r") + 1, F.lit(rounds)).alias("rounds"))


def with_typo(word: Column, at: Column) -> Column:
    """Two neighbouring characters swapped, from place `at` (1-based)."""
    return F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.lit(1)), F.substring(word, at, F.lit(1)), F.substring(word, at + 2, F.length(word)))


def descend(features: np.ndarray, groups: np.ndarray, is_target: np.ndarray, start: np.ndarray, grid: np.ndarray, k: int = 10, rounds: int = 6) -> tuple[np.ndarray, float]:
    """Coordinate descent over feature weights for recall at k; a weight moves only for a strict improvement.

    Takes the candidates of a labelled question set: 25 rows a question, so it is as small as that set.
    """
    starts = np.concatenate(([0], np.flatnonzero(np.diff(groups)) + 1, [len(groups)]))

    def recall(w: np.ndarray) -> float:
        score = features @ w
        hits = [is_target[a:b][np.argsort(-score[a:b], kind="stable")[:k]].any() for a, b in zip(starts, starts[1:], strict=False)]
        return float(np.mean(hits)) if hits else 0.0

    w, best = start.astype(float).copy(), recall(start)
    for _ in range(rounds):
        before = best
        for j in range(len(w)):
            for value in grid:
                tried = w.copy()
                tried[j] = value
                if (got := recall(tried)) > best:
                    w, best = tried, got
        if best == before:
            break
    return w, best

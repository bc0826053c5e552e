"""Retrieval lanes: each takes questions and rows and returns qid, id, score, rnk, at most k rows a question.

Filters belong on the rows given to a lane, so that what they drop never takes a place among the k.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.llm.common import bound_batches
from corvane.operators.postings import MATRIX_ENTRIES

#: Question sets up to this many rows may be broadcast.
BROADCAST_QUESTIONS = 10_000
#: Question sets up to this many rows may be a matrix in every task.
MATRIX_QUESTIONS = 2_000
#: Vocabularies up to this many terms may be a matrix in every task, if they have few enough trigrams.
MATRIX_TERMS = 10_000
#: Words whose trigrams a task remembers: some 10 MB.
KNOWN_WORDS = 50_000


def top_k(hits: DataFrame, k: int, dense: bool = False, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Ordinal ranks break ties by id; dense ranks share them, and the k places are still given by id."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id"))
    cut = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    if not dense:
        return cut.withColumnRenamed("place", "rnk")
    return cut.withColumn("rnk", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc("score")))).drop("place")


def text_lanes(hits: DataFrame, k: int, weights: dict[str, float], dense: bool = False) -> DataFrame:
    """qid, lane, id, score, rnk, weight of the exact and the fragment lane, ranked in one pass over the hits."""
    some = F.col("matched") >= F.least(F.lit(2), F.col("n_terms"))
    lane = F.explode(F.when(F.col("matched") == F.col("n_terms"), F.array(F.lit("and"), F.lit("or"))).when(some, F.array(F.lit("or"))))
    ranked = top_k(hits.select("qid", lane.alias("lane"), "id", "score"), k, dense, ("qid", "lane"))
    return ranked.withColumn("weight", F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("lane")])


def and_lane(hits: DataFrame, k: int) -> DataFrame:
    return top_k(hits.where("matched = n_terms").select("qid", "id", "score"), k)


def or_lane(hits: DataFrame, k: int) -> DataFrame:
    """At least two of the question's terms, or its only one."""
    return top_k(hits.where("matched >= least(2, n_terms)").select("qid", "id", "score"), k)


def exact_title(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """qid, id where the whole question, outer quotes stripped, is the title."""
    asked = questions.select("qid", F.lower(F.regexp_replace("text", '^"(.*)"$', "$1")).alias("wanted"))
    return asked.join(rows.select("id", F.lower("title").alias("wanted")), "wanted").select("qid", "id")


def pairwise(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """Every question with every row, in blocks of questions: few are broadcast, many are dealt to tasks by block."""
    n = questions.count()
    blocks = max(1, -(-n // BROADCAST_QUESTIONS))
    asked = questions.withColumn("q_block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    spread = rows.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.join(F.broadcast(asked) if blocks == 1 else asked, "q_block").drop("q_block")


#: Words of the run by which a text is looked for in others.
ANCHOR = 3


def holders(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """questions (qid, text), rows (id, page) -> qid, id of the rows that hold a question's text word for word.

    Words between blanks, but for the first and last, stand whole in whatever holds a text: a run of ANCHOR of them is
    joined with the runs of all rows, and only what meets is searched. Questions too short for that meet every row.
    Up to MATRIX_QUESTIONS questions go to every task instead, and rows are read once where they are: a text is looked
    for in rows that have its longest such word, and no run and no text moves.
    """
    if questions.count() <= MATRIX_QUESTIONS:
        return _held_texts(questions, rows)
    words = lambda c: F.split(c, " ")
    run = lambda w, i: F.xxhash64(*[F.get(w, i + j) for j in range(ANCHOR)])
    asked = questions.withColumn("w", words("text"))
    long = F.size("w") >= ANCHOR + 2
    anchors = asked.where(long).select("qid", run(F.col("w"), F.floor(F.size("w") / 2).cast("int") - 1).alias("anchor"))
    runs = rows.select("id", words("page").alias("w")).where(long)
    runs = runs.select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - ANCHOR - 1), lambda i: run(F.col("w"), i)))).alias("anchor"))
    met = runs.join(anchors, "anchor").select("qid", "id").distinct().join(rows, "id").join(questions, "qid")
    short = pairwise(asked.where(~long).select("qid", "text"), rows)
    return met.select("qid", "id", "page", "text").unionByName(short.select("qid", "id", "page", "text")).where(F.contains("page", "text")).select("qid", "id")


def _held_texts(questions: DataFrame, rows: DataFrame) -> DataFrame:
    asked = [r for r in questions.select("qid", "text").collect() if r.text is not None]
    by_word: dict[str, list[int]] = {}
    everywhere = []
    for i, r in enumerate(asked):
        inner = r.text.split(" ")[1:-1]
        (by_word.setdefault(max(inner, key=len), []) if any(inner) else everywhere).append(i)
    words, texts, qids = frozenset(by_word), [r.text for r in asked], [r.qid for r in asked]
    qid_type, id_type = questions.schema["qid"].dataType, rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(qids, to_arrow_type(qid_type))
        for batch in batches:
            q, row = [], []
            for i, page in enumerate(batch.column(1)):
                page = page.as_py()
                if page is None:
                    continue
                maybe = everywhere + [j for w in words.intersection(page.split(" ")) for j in by_word[w]]
                found = [j for j in maybe if texts[j] in page]
                q += found
                row += [i] * len(found)
            yield pa.RecordBatch.from_arrays([labels.take(pa.array(q, pa.int64())), batch.column(0).take(pa.array(row, pa.int64()))], ["qid", "id"])

    return bound_batches(rows.select("id", "page")).mapInArrow(run, f"qid {qid_type.simpleString()}, id {id_type.simpleString()}")


def vector_lane(questions: DataFrame, rows: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """questions (qid, qv), rows (id, v): exact cosine; rows without a vector are invisible here."""
    scored = pairwise(questions, rows.where("v is not null")).select("qid", "id", F.round(V.cosine(F.col("qv"), F.col("v")), 6).alias("score"))
    return top_k(scored if floor is None else scored.where(F.col("score") >= floor), k)


def binary_lane(questions: DataFrame, rows: DataFrame, dims: int, k: int, oversample: int) -> DataFrame:
    """The k * oversample nearest by Hamming distance of sign bits, then the k best of those by exact cosine."""
    packed = lambda df, v, name: df.withColumn(name, V.sign_words(F.col(v), dims))
    near = pairwise(packed(questions, "qv", "qb"), packed(rows.where("v is not null"), "v", "b")).select("qid", "id", (-V.hamming(F.col("qb"), F.col("b"))).alias("score"))
    near = top_k(near, k * oversample).select("qid", "id")
    exact = near.join(rows, "id").join(questions, "qid").select("qid", "id", F.round(V.cosine(F.col("qv"), F.col("v")), 6).alias("score"))
    return top_k(exact, k)


def trigram_hits(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """qid, id, shared, n_q, n_row: trigrams in common, through postings of trigrams."""
    asked = questions.select("qid", T.text_trigrams(F.col("text")).alias("g")).select("qid", F.size("g").alias("n_q"), F.explode("g").alias("gram"))
    held = rows.select("id", T.text_trigrams(F.col("text")).alias("g")).select("id", F.size("g").alias("n_row"), F.explode("g").alias("gram"))
    held = held.join(asked.select("gram").distinct(), "gram", "left_semi")
    return held.join(asked, "gram").groupBy("qid", "id", "n_q", "n_row").agg(F.count(F.lit(1)).alias("shared"))


def trigram_lane(questions: DataFrame, rows: DataFrame, k: int, threshold: float) -> DataFrame:
    """Share of the question's trigrams that the row has: the upper bound of word similarity, which never misses a row.

    Up to MATRIX_QUESTIONS questions go to every task as a matrix, and each task returns its own k best of a question;
    common trigrams would otherwise join nearly every row with every question. More questions meet rows by postings.
    """
    asked = questions.select("qid", T.text_trigrams(F.col("text")).alias("g")).where(F.size("g") > 0)
    if asked.count() <= MATRIX_QUESTIONS:
        hits = _matrix_hits(asked, rows, k, threshold)
    else:
        hits = trigram_hits(questions, rows)
    hits = hits.withColumn("score", F.round(F.col("shared") / F.col("n_q"), 6))
    return top_k(hits.where(F.col("score") >= threshold).select("qid", "id", "score"), k)


def _matrix_hits(asked: DataFrame, rows: DataFrame, k: int, threshold: float) -> DataFrame:
    """qid, id, shared, n_q by products of incidence matrices; rows below the threshold or a task's k best don't come."""
    collected = asked.collect()
    grams = [r.g for r in collected]
    kinds = {name: df.schema[name].dataType.simpleString() for name, df in (("qid", asked), ("id", rows))}
    qids = [r.qid for r in collected]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {g: i for i, g in enumerate(sorted({g for one in grams for g in one}))}
        wanted = np.zeros((len(place), len(grams)), np.float32)
        for q, one in enumerate(grams):
            wanted[[place[g] for g in one], q] = 1
        n_q = np.array([len(one) for one in grams])
        least = np.maximum(1, np.ceil(threshold * n_q - 1e-6))
        by_word: dict[str, np.ndarray] = {}
        found: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []

        def best() -> tuple[np.ndarray, pa.Array, np.ndarray]:
            q, ids, shared = np.concatenate([f[0] for f in found]), pa.concat_arrays([f[1] for f in found]), np.concatenate([f[2] for f in found])
            order = np.lexsort((pc.rank(ids, tiebreaker="dense").to_numpy(), -shared, q))
            first = np.searchsorted(q[order], q[order])
            order = order[np.arange(len(order)) - first < k]
            return q[order], ids.take(pa.array(order)), shared[order]

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                has = np.zeros((part.num_rows, len(place)), np.float32)
                for i, text in enumerate(part.column(1)):
                    for w in set(re.findall("[a-z0-9]+", (text.as_py() or "").lower())):
                        if w not in by_word:
                            if len(by_word) > KNOWN_WORDS:
                                by_word.clear()
                            padded = f"  {w} "
                            by_word[w] = np.array([place[g] for g in {padded[j : j + 3] for j in range(len(w) + 1)} if g in place], np.int32)
                        has[i, by_word[w]] = 1
                shared = has @ wanted
                row, q = np.nonzero(shared >= least)
                found.append((q, part.column(0).take(pa.array(row)), shared[row, q].astype(np.int64)))
            if sum(len(f[0]) for f in found) > 100_000:
                found = [best()]
        if found:
            q, ids, shared = best()
            yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in q], asked_type), ids, pa.array(shared), pa.array(n_q[q])], ["qid", "id", "shared", "n_q"])

    asked_type = to_arrow_type(asked.schema["qid"].dataType)
    return bound_batches(rows.select("id", "text")).mapInArrow(run, f"qid {kinds['qid']}, id {kinds['id']}, shared long, n_q long")


def edge_lane(hits: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """hits (qid, edge id, score) on the reasons of edges (id, source, target): both ends, at the edge's rank, repeats kept."""
    ranked = top_k(hits, k)
    return ranked.join(edges, "id").select("qid", F.col("id").alias("edge"), "rnk", F.explode(F.array("source", "target")).alias("node"))


def scale_anchors(terms: DataFrame, most: int = 3, budget: int = 300) -> DataFrame:
    """qid, term, df -> the rarest terms of each question while their frequencies add up to the budget; the first always.

    The walk stops at the first term that goes over, so a smaller one after it isn't reconsidered.
    """
    order = Window.partitionBy("qid").orderBy("df", "term")
    run = terms.withColumn("k", F.row_number().over(order)).withColumn("total", F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    over = F.max(F.when((F.col("k") > 1) & (F.col("total") > budget), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return run.withColumn("over", over).where((F.col("over") == 0) & (F.col("k") <= most)).select("qid", "term", "df", "k")


def capped(hits: DataFrame, cap: int) -> DataFrame:
    """The first rows by id, before any ranking: the reference point of a candidate cap, made deterministic."""
    return hits.withColumn("c", F.row_number().over(Window.partitionBy("qid").orderBy("id"))).where(F.col("c") <= cap).drop("c")


def nearest_terms(words: DataFrame, vocabulary: DataFrame, least: float = 0.3) -> DataFrame:
    """word, term, similarity: the vocabulary term with the most trigrams in common for each word.

    A vocabulary small enough to be a matrix goes to every task, where a word's trigrams pick and add up its rows; a
    word would otherwise meet most of the vocabulary through common trigrams. Larger ones are joined by trigram.
    """
    listed = vocabulary.select("term", T.trigrams(F.col("term")).alias("g")).where("term is not null").limit(MATRIX_TERMS + 1).collect()
    if len(listed) <= MATRIX_TERMS and len(listed) * len({g for r in listed for g in r.g}) <= MATRIX_ENTRIES:
        both = _term_overlaps(words, sorted((r.term, r.g) for r in listed), least)
        return both.select("word", "term", F.round(F.col("n") / F.col("of"), 6).alias("similarity")).where(F.col("similarity") >= least)
    w = words.select("word", T.trigrams(F.col("word")).alias("g")).select("word", F.size("g").alias("n_w"), F.explode("g").alias("gram"))
    v = vocabulary.select("term", T.trigrams(F.col("term")).alias("g")).select("term", F.size("g").alias("n_t"), F.explode("g").alias("gram"))
    both = v.join(w, "gram").groupBy("word", "term", "n_w", "n_t").agg(F.count(F.lit(1)).alias("n"))
    scored = both.withColumn("similarity", F.round(F.col("n") / (F.col("n_w") + F.col("n_t") - F.col("n")), 6)).where(F.col("similarity") >= least)
    best = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("similarity"), "term"))
    return scored.withColumn("k", best).where("k = 1").select("word", "term", "similarity")


def _term_overlaps(words: DataFrame, listed: list[tuple[str, list[str]]], least: float) -> DataFrame:
    """word, term, n, of: trigrams in common and in all of the most similar term, the first of equals, if it may reach `least`."""
    terms, grams = [t for t, _ in listed], [g for _, g in listed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {g: i for i, g in enumerate(sorted({g for one in grams for g in one}))}
        has = np.zeros((len(place) + 1, len(terms)), np.int32)
        for t, one in enumerate(grams):
            has[[place[g] for g in one], t] = 1
        n_t = np.array([len(one) for one in grams], np.int64)
        for batch in batches:
            at, best, shared, total = [], [], [], []
            for i, word in enumerate(batch.column(0)):
                if (word := word.as_py()) is None or not terms:
                    continue
                padded = f"  {word.lower()} "
                own = {padded[j : j + 3] for j in range(len(padded) - 2)}
                n = has[[place.get(g, -1) for g in own]].sum(0)
                some = np.flatnonzero(n)
                if len(some):
                    both = n[some].astype(np.int64)
                    of = len(own) + n_t[some] - both
                    k = np.argmax((2_000_000 * both + of) // (2 * of))  # to six places, halves up; the first of the greatest
                    if both[k] >= (least - 1e-6) * of[k]:
                        at.append(i), best.append(terms[some[k]]), shared.append(both[k]), total.append(of[k])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(best, pa.string()), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], ["word", "term", "n", "of"])

    return bound_batches(words.select("word")).mapInArrow(run, "word string, term string, n long, of long")


def rank_of_target(questions: DataFrame, rows: DataFrame, targets: DataFrame) -> DataFrame:
    """qid, id, exact_rank: one more than the number of rows that are nearer to the question than its target."""
    scored = pairwise(questions, rows).select("qid", "id", F.round(V.cosine(F.col("qv"), F.col("v")), 6).alias("score"))
    own = scored.join(targets, ["qid", "id"]).select("qid", F.col("id").alias("target"), F.col("score").alias("own"))
    return scored.join(own, "qid").groupBy("qid", "target").agg((F.sum((F.col("score") > F.col("own")).cast("long")) + 1).alias("exact_rank"))


def similarity_bounds(query_text: Column, row_text: Column) -> Column:
    """struct(lower, upper) of word similarity: the plain trigram similarity, and the share of the query's trigrams."""
    a, b = T.text_trigrams(query_text), T.text_trigrams(row_text)
    shared = F.size(F.array_intersect(a, b))
    return F.struct((shared / F.greatest(F.lit(1), F.size(a) + F.size(b) - shared)).alias("lower"), (shared / F.greatest(F.lit(1), F.size(a))).alias("upper"))

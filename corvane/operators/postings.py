"""Inverted index as DataFrames: questions are rows, and so are postings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.functions import text as T
from corvane.llm.common import bound_batches

#: Entries (terms times questions) up to which a question set goes to every task as a matrix: 64 MB of it.
MATRIX_ENTRIES = 16_000_000
#: Hits that a task holds before it drops those that are not among its best.
HELD = 200_000


def query_terms(questions: DataFrame, most: int = 32, qid: str = "qid", text: str = "text") -> DataFrame:
    """qid, term, n_terms: the first `most` distinct content terms of each question, in order of appearance."""
    first = questions.select(F.col(qid).alias("qid"), F.posexplode(T.content_terms(F.col(text))).alias("pos", "term")).groupBy("qid", "term").agg(F.min("pos").alias("pos"))
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).where(F.col("k") <= most)
    return ranked.withColumn("n_terms", F.count(F.lit(1)).over(Window.partitionBy("qid"))).select("qid", "term", "n_terms")


def postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """id, len, term, tf. With a vocabulary, other terms are dropped before anything is shuffled."""
    rows = docs.select(F.col(id_col).alias("id"), T.terms(F.col(text_col)).alias("t")).select("id", F.size("t").alias("len"), F.explode("t").alias("term"))
    if vocabulary is not None:
        rows = rows.join(vocabulary, "term", "left_semi")
    return rows.groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(docs: DataFrame, text_col: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """term, df: in how many rows a term stands. Terms are made distinct inside a row, so only terms and partial counts move."""
    rows = docs.select(F.explode(F.array_distinct(T.terms(F.col(text_col)))).alias("term"))
    if vocabulary is not None:
        rows = rows.join(vocabulary, "term", "left_semi")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_hits(posted: DataFrame, terms: DataFrame) -> DataFrame:
    """qid, id, n_terms, matched, score: distinct matched terms, and their occurrences over the document's length."""
    hits = posted.join(terms, "term").groupBy("qid", "id", "len", "n_terms").agg(F.count(F.lit(1)).alias("matched"), F.sum("tf").alias("tf"))
    return hits.select("qid", "id", "n_terms", "matched", (F.col("tf") / F.col("len")).alias("score"))


class Questions:
    """A question set as a matrix of terms and questions, for functions that run in tasks."""

    def __init__(self, asked: list):
        self.place = {t: i for i, t in enumerate(sorted({r.term for r in asked}))}
        qids = {q: i for i, q in enumerate(dict.fromkeys(r.qid for r in asked))}
        self.names, self.n_terms = list(qids), np.zeros(len(qids), np.int64)
        self.wanted = np.zeros((len(self.place), len(qids)), np.float32)
        for r in asked:
            self.wanted[self.place[r.term], qids[r.qid]], self.n_terms[qids[r.qid]] = 1, r.n_terms

    def counts(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Of (id, text): 256 rows at a time, how often each term stands in them, and how many terms they have."""
        term, column = re.compile(T.TERM).findall, self.place.get
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            count, size = np.zeros((part.num_rows, len(self.place)), np.float32), np.zeros(part.num_rows, np.int64)
            for i, text in enumerate(part.column(1)):
                found = term((text.as_py() or "").lower())
                size[i] = len(found)
                known = [c for c in map(column, found) if c is not None]
                count[i] = np.bincount(known, minlength=len(self.place)) if known else 0
            yield part, count, size


def fits_matrix(terms: DataFrame) -> bool:
    return terms.select("term").distinct().count() * terms.select("qid").distinct().count() <= MATRIX_ENTRIES


def best_of(q: np.ndarray, ids: pa.Array, score: np.ndarray, k: int, full: np.ndarray | None = None) -> np.ndarray:
    """Places of the k best of each q, by score and then by id; with full also of the k best for which it is set."""
    order = np.lexsort((pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy(), -score, q))
    first = np.searchsorted(q[order], q[order])
    keep = np.arange(len(order)) - first < k
    if full is not None and len(order):
        sure = full[order]
        so_far = np.cumsum(sure)
        keep |= sure & (so_far - (so_far[first] - sure[first]) <= k)
    return order[keep]


def question_hits(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, best: int | None = None) -> DataFrame:
    """As term_hits, for rows with at least two of a question's terms, or its only one.

    With `best`, for lanes of at most that many rows: a task returns the best of each question only, of all its hits and
    of those with every term. Without it hits grow with documents times questions.

    A common term would join most documents with most questions. Where the question set is small enough to be a matrix
    in every task, a batch of documents is multiplied with it instead: no postings are shuffled, and what comes out is
    at most a row per document and question. Larger question sets meet documents by postings.
    """
    if not fits_matrix(terms):
        return term_hits(postings(docs, id_col, text_col, terms.select("term").distinct()), terms).where("matched >= least(2, n_terms)")
    asked = Questions(terms.collect())
    qid_type, id_type = terms.schema["qid"].dataType, docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, n_terms = pa.array(asked.names, to_arrow_type(qid_type)), asked.n_terms
        held: list[tuple] = []  # q, ids, matched, tf, len

        def cut() -> tuple:
            q, ids, *numbers = [pa.concat_arrays(c) if isinstance(c[0], pa.Array) else np.concatenate(c) for c in zip(*held, strict=True)]
            keep = best_of(q, ids, numbers[1] / numbers[2], best, numbers[0] == n_terms[q])
            return q[keep], ids.take(pa.array(keep)), *(c[keep] for c in numbers)

        def out(q, ids, matched, tf, size) -> pa.RecordBatch:
            columns = [labels.take(pa.array(q)), ids, n_terms[q], matched, tf, size]
            return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["qid", "id", "n_terms", "matched", "tf", "len"])

        for batch in batches:
            for part, count, size in asked.counts(batch):
                matched, total = (count > 0).astype(np.float32) @ asked.wanted, count @ asked.wanted
                row, q = np.nonzero(matched >= np.maximum(1, np.minimum(2, n_terms)))
                found = (q, part.column(0).take(pa.array(row)), matched[row, q].astype(np.int64), total[row, q].astype(np.int64), size[row])
                if best is None:
                    yield out(*found)
                    continue
                held.append(found)
                if sum(len(h[0]) for h in held) > HELD:
                    held[:] = [cut()]
        if held:
            yield out(*cut())

    schema = f"qid {qid_type.simpleString()}, id {id_type.simpleString()}, n_terms long, matched long, tf long, len long"
    hits = bound_batches(docs.select(id_col, text_col)).mapInArrow(run, schema)
    return hits.select("qid", "id", "n_terms", "matched", (F.col("tf") / F.col("len")).alias("score"))


def repeated(docs: DataFrame, id_col: str) -> bool:
    """Whether several rows share an id: their terms then count as one row's, which no task sees whole."""
    return not docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def term_reach(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """qid, rarest (the document frequency of its rarest term that stands anywhere, else null), full (whether a row has all its terms).

    A task returns a count for each term and the questions that it has seen whole, so what moves doesn't grow with the rows.
    """
    names = terms.select("qid").distinct()
    if not fits_matrix(terms) or repeated(docs, id_col):
        vocabulary = terms.select("term").distinct()
        rare = terms.join(document_frequency(docs, text_col, vocabulary), "term").groupBy("qid").agg(F.min("df").alias("rarest"))
        whole = term_hits(postings(docs, id_col, text_col, vocabulary), terms).where("matched = n_terms").select("qid").distinct().withColumn("full", F.lit(True))
        return names.join(rare, "qid", "left").join(whole, "qid", "left").select("qid", "rarest", F.coalesce("full", F.lit(False)).alias("full"))
    asked = Questions(terms.collect())
    qid_type = terms.schema["qid"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, whole = np.zeros(len(asked.place), np.int64), np.zeros(len(asked.names), bool)
        for batch in batches:
            for _, count, _ in asked.counts(batch):
                has = count > 0
                df += has.sum(0)
                whole |= (has.astype(np.float32) @ asked.wanted == asked.n_terms).any(0)
        seen, q = np.flatnonzero(df), np.flatnonzero(whole)
        words, labels = list(asked.place), pa.array(asked.names, to_arrow_type(qid_type))
        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in seen] + [None] * len(q), pa.string()), pa.array([*df[seen], *[0] * len(q)], pa.int64()), pa.concat_arrays([pa.nulls(len(seen), labels.type), labels.take(pa.array(q))])], ["term", "df", "whole"])

    seen = bound_batches(docs.select(id_col, text_col)).mapInArrow(run, f"term string, df long, whole {qid_type.simpleString()}").groupBy("term", "whole").agg(F.sum("df").alias("df"))
    found = seen.join(F.broadcast(terms.select("qid", "term")), "term", "left").groupBy(F.coalesce("whole", "qid").alias("qid"))
    found = found.agg(F.min(F.when(F.col("term").isNotNull(), F.col("df"))).alias("rarest"), F.bool_or(F.col("whole").isNotNull()).alias("full"))
    return names.join(found, "qid", "left").select("qid", "rarest", F.coalesce("full", F.lit(False)).alias("full"))


def words_held(docs: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame) -> DataFrame:
    """id, terms: the distinct words of the vocabulary (term) that stand in each row; rows without any are left out."""
    words = frozenset(r.term for r in vocabulary.select("term").distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term = re.compile(T.TERM).findall
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [list(words.intersection(term((text.as_py() or "").lower()))) or None for text in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.string()))], ["id", "terms"])

    return bound_batches(docs.select(id_col, text_col)).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, terms array<string>").where("terms is not null")


def stemmed(vocabulary: DataFrame) -> DataFrame:
    """vocabulary (term, ...) with the stem of each term; meant for distinct terms, not for a text's."""
    # Never null, so that no join makes the stems a second time to see whether they are.
    return vocabulary.withColumn("stem", F.coalesce(T.stem(F.col("term")), F.lit("")))


def stem_frequency(docs: DataFrame, text_col: str) -> DataFrame:
    """stem, df: the largest document frequency of the surface forms that share a stem."""
    return stemmed(document_frequency(docs, text_col)).groupBy("stem").agg(F.max("df").alias("df"))

"""Query syntax: quoted phrases, excluded words and alternatives, matched by positions; cover-density ranks."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.functions import text as T
from corvane.llm.common import bound_batches
from corvane.operators.lanes import MATRIX_QUESTIONS, top_k
from corvane.operators.postings import best_of, repeated

#: Fixed value: what a match in the body weighs.
BODY_WEIGHT = 0.1


def clauses(questions: DataFrame) -> DataFrame:
    """questions (qid, text) -> qid, alt, clause, negated, i, word, n_words: the words of each clause with their places in it.

    Alternatives are parted by the word "or"; within one, every clause has to match, and none with a minus before it
    may. A clause is a quoted phrase or a word; stopwords go, but keep their place in a phrase. One of stopwords only counts
    for nothing.
    """
    piece = F.regexp_extract_all(F.lower("text"), F.lit(r'-?"[^"]*"|[^\s"]+'), F.lit(0))
    parts = questions.select("qid", F.posexplode(piece).alias("clause", "piece"))
    bare = F.col("piece") == "or"
    alt = F.sum(bare.cast("int")).over(Window.partitionBy("qid").orderBy("clause"))
    parts = parts.withColumn("alt", alt).where(~bare)
    words = parts.select("qid", "alt", "clause", F.startswith("piece", F.lit("-")).alias("negated"), F.posexplode(T.terms(F.col("piece"))).alias("i", "word"))
    words = words.where(~T.is_stopword(F.col("word")))
    return words.withColumn("n_words", F.count(F.lit(1)).over(Window.partitionBy("qid", "clause")))


def positions(docs: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame) -> DataFrame:
    """id, pos, word of the words that some question asks for; all others go before anything is shuffled."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(T.terms(F.col(text_col))).alias("pos", "word"))
    return rows.join(vocabulary, "word", "left_semi")


def matches(docs: DataFrame, id_col: str, text_col: str, asked: DataFrame) -> DataFrame:
    """qid, id of the rows that one of a question's alternatives matches. asked: of clauses().

    Up to MATRIX_QUESTIONS questions go to every task, where a row is matched whole: a common word would otherwise join
    every place that it has in any row with every question that asks for it. More questions meet rows by positions.
    """
    if asked.select("qid").distinct().count() <= MATRIX_QUESTIONS and not repeated(docs, id_col):
        return _matched_rows(docs, id_col, text_col, asked)
    placed = positions(docs, id_col, text_col, asked.select("word").distinct())
    held = placed.join(asked, "word").groupBy("qid", "alt", "clause", "negated", "n_words", "id", (F.col("pos") - F.col("i")).alias("at")).agg(F.count_distinct("i").alias("n"))
    held = held.where("n = n_words").select("qid", "alt", "clause", "negated", "id").distinct()
    found = held.groupBy("qid", "alt", "id").agg(F.count_if(~F.col("negated")).alias("n"), F.bool_or("negated").alias("bad")).where("not bad")
    needed = asked.where("not negated").groupBy("qid", "alt").agg(F.count_distinct("clause").alias("needed"))
    return found.join(needed, ["qid", "alt"]).where("n = needed").select("qid", "id").distinct()


def _matched_rows(docs: DataFrame, id_col: str, text_col: str, asked: DataFrame) -> DataFrame:
    by_clause: dict = defaultdict(lambda: defaultdict(list))
    for r in asked.collect():
        by_clause[r.qid, r.alt][r.clause, r.negated].append((r.i, r.word))
    alternatives = []  # qid, words that have to be there, phrases that have to be there, clauses that must not match
    for (qid, _), own in by_clause.items():
        needed, barred = ([c for (_, negated), c in own.items() if negated == n] for n in (False, True))
        if needed:
            alternatives.append((qid, frozenset(w for c in needed for _, w in c), [c for c in needed if len(c) > 1], barred))
    vocabulary = frozenset(w for own in by_clause.values() for c in own.values() for _, w in c)
    popular = defaultdict(int)
    for one in alternatives:
        for w in one[1]:
            popular[w] += 1
    by_word = defaultdict(list)  # every alternative by the one of its words that the fewest others need
    for k, one in enumerate(alternatives):
        by_word[min(one[1], key=lambda w: (popular[w], -len(w), w))].append(k)
    keys, by_word = frozenset(by_word), dict(by_word)
    qid_type, id_type = asked.schema["qid"].dataType, docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term = re.compile(T.TERM).findall
        for batch in batches:
            q, row = [], []
            for at, text in enumerate(batch.column(1)):
                found = term((text.as_py() or "").lower())
                there, places = vocabulary.intersection(found), None
                matched = set()
                for k in (k for w in keys & there for k in by_word[w]):
                    qid, words, phrases, barred = alternatives[k]
                    if qid in matched or not words <= there:
                        continue
                    if places is None and (phrases or barred):
                        places = defaultdict(set)
                        for p, w in enumerate(found):
                            if w in there:
                                places[w].add(p)
                    if all(_stands(c, places) for c in phrases) and not any(_stands(c, places) for c in barred):
                        matched.add(qid)
                q += matched
                row += [at] * len(matched)
            yield pa.RecordBatch.from_arrays([pa.array(q, to_arrow_type(qid_type)), batch.column(0).take(pa.array(row, pa.int64()))], ["qid", "id"])

    return bound_batches(docs.select(id_col, text_col)).mapInArrow(run, f"qid {qid_type.simpleString()}, id {id_type.simpleString()}")


def _stands(clause: list[tuple[int, str]], places: dict[str, set[int]]) -> bool:
    """Whether the words of a clause stand somewhere at their distances."""
    starts = None
    for i, word in sorted(clause, key=lambda c: len(places.get(c[1], ()))):
        here = {p - i for p in places.get(word, ())}
        starts = here if starts is None else starts & here
        if not starts:
            return False
    return True


def cover_density(places: list[tuple[int, int]], n_terms: int) -> float:
    """Sum over the shortest extents that hold all terms of BODY_WEIGHT / (1 + words in between).

    places: ascending (position, term) of every match. An extent ends at a match and reaches back to the latest place from
    which all terms are inside; of those with one beginning the first is the shortest.
    """
    last, begun, total = {}, -1, 0.0
    inside: list[int] = []
    for pos, term in places:
        last[term] = pos
        inside.append(pos)
        if len(last) == n_terms and (start := min(last.values())) > begun:
            begun = start
            inside = inside[inside.index(start) :]
            total += BODY_WEIGHT / (1 + (pos - start) - (len(inside) - 1))
    return total


def density(places: Column, n_terms: Column) -> Column:
    """places: array of struct(pos, k), in any order."""

    def run(pos: pd.Series, k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([cover_density(list(zip(p, t, strict=True)), m) for p, t, m in zip(pos, k, n, strict=True)], dtype="float64")

    places = F.array_sort(places)
    part = lambda name: F.transform(places, lambda x: x[name])
    return F.pandas_udf(run, "double")(part("pos"), part("k"), n_terms)


def cover_lane(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, k: int) -> DataFrame:
    """terms (qid, term, n_terms) -> qid, id, score, rnk of rows with all terms, by cover density over the row's length.

    Up to MATRIX_QUESTIONS questions go to every task, which reads a row once and returns its own k best of a question.
    """
    if terms.select("qid").distinct().count() <= MATRIX_QUESTIONS and not repeated(docs, id_col):
        return top_k(_dense_rows(docs, id_col, text_col, terms, k), k)
    asked = terms.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("term")).cast("int")).withColumnRenamed("term", "word")
    placed = positions(docs.select(id_col, text_col), id_col, text_col, asked.select("word").distinct())
    held = placed.join(asked, "word").groupBy("qid", "id", "n_terms").agg(F.collect_list(F.struct("pos", "k")).alias("places"), F.count_distinct("k").alias("n")).where("n = n_terms")
    sizes = docs.select(F.col(id_col).alias("id"), F.size(T.terms(F.col(text_col))).alias("len"))
    scored = held.join(sizes, "id").select("qid", "id", F.round(density(F.col("places"), F.col("n_terms")) / F.col("len"), 9).alias("score"))
    return top_k(scored, k)


def _dense_rows(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, k: int) -> DataFrame:
    """qid, id, score of the k best rows of a question in each task."""
    words: dict = defaultdict(list)
    for r in terms.collect():
        words[r.qid].append(r.term)
    qids, sets = list(words), [frozenset(w) for w in words.values()]
    popular = defaultdict(int)
    for one in sets:
        for w in one:
            popular[w] += 1
    by_word = defaultdict(list)
    for i, one in enumerate(sets):
        by_word[min(one, key=lambda w: (popular[w], -len(w), w))].append(i)
    vocabulary, keys, by_word = frozenset(popular), frozenset(by_word), dict(by_word)
    qid_type, id_type = terms.schema["qid"].dataType, docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, labels = re.compile(T.TERM).findall, pa.array(qids, to_arrow_type(qid_type))
        held: list[tuple] = []

        def cut() -> tuple:
            q, ids, score = np.concatenate([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held])
            keep = best_of(q, ids, score, k)
            return q[keep], ids.take(pa.array(keep)), score[keep]

        for batch in batches:
            q, row, scores = [], [], []
            for at, text in enumerate(batch.column(1)):
                found = term((text.as_py() or "").lower())
                there, places = vocabulary.intersection(found), None
                for i in (i for w in keys & there for i in by_word[w]):
                    if not sets[i] <= there:
                        continue
                    if places is None:
                        places = defaultdict(list)
                        for p, w in enumerate(found):
                            if w in there:
                                places[w].append(p)
                    here = sorted((p, w) for w in sets[i] for p in places[w]) if len(sets[i]) > 1 else [(p, "") for w in sets[i] for p in places[w]]
                    score = cover_density(here, len(sets[i])) / len(found)
                    q.append(i), row.append(at), scores.append(float(Decimal(repr(score)).quantize(Decimal("1e-9"), ROUND_HALF_UP)))
            held.append((np.array(q, np.int64), batch.column(0).take(pa.array(row, pa.int64())), np.array(scores, np.float64)))
            if sum(len(h[0]) for h in held) > 100_000:
                held[:] = [cut()]
        if held:
            q, ids, score = cut()
            yield pa.RecordBatch.from_arrays([labels.take(pa.array(q)), ids, pa.array(score)], ["qid", "id", "score"])

    rows = bound_batches(docs.where(F.col(id_col).isNotNull()).select(id_col, text_col))
    return rows.mapInArrow(run, f"qid {qid_type.simpleString()}, id {id_type.simpleString()}, score double")


def weighted_postings(rows: DataFrame, id_col: str, fields: dict[str, str], vocabulary: DataFrame | None = None) -> DataFrame:
    """id, term, weight, tf over several fields, each with a letter for its weight (A, B, C)."""
    found = F.concat(*[F.transform(T.terms(F.coalesce(F.col(c), F.lit(""))), lambda t: F.struct(F.lit(letter).alias("weight"), t.alias("term"))) for c, letter in fields.items()])  # noqa: B023
    out = rows.select(F.col(id_col).alias("id"), F.explode(found).alias("p")).select("id", "p.term", "p.weight")
    if vocabulary is not None:
        out = out.join(vocabulary, "term", "left_semi")
    return out.groupBy("id", "term", "weight").agg(F.count(F.lit(1)).alias("tf"))

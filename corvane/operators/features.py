"""Query understanding: features of a question and the lane weights they lead to, with the two configurations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.postings import stemmed

LANES = ["and", "or", "vector", "trigram"]


@dataclass(frozen=True)
class Weighting:
    """Fixed values of the product's configuration; BENCH has those of the benchmark's."""

    base: dict = field(default_factory=lambda: {"and": 1.0, "or": 1.0, "vector": 1.0, "trigram": 0.0})
    rare_term_boost: dict = field(default_factory=lambda: {"and": 1.8, "trigram": 0.0})
    paraphrase_boost: dict = field(default_factory=lambda: {"vector": 1.6, "or": -1.3, "and": -0.7})
    typo_boost: dict = field(default_factory=lambda: {"trigram": 1.5, "and": -0.8})
    entity_boost: dict = field(default_factory=lambda: {"and": 2.0})
    date_boost: dict = field(default_factory=lambda: {"vector": 0.2})
    rare_idf_floor: float = 5.0
    oov_ratio_floor: float = 0.34
    paraphrase_min_terms: int = 8
    paraphrase_oov_floor: float = 0.6
    typo_max_terms: int = 6


PRODUCT = Weighting()
BENCH = Weighting(base={"and": 1.0, "or": 1.3, "vector": 1.0, "trigram": 0.0}, rare_term_boost={"and": 1.8, "trigram": 0.2}, rare_idf_floor=9.5, paraphrase_min_terms=16, paraphrase_oov_floor=0.5, typo_max_terms=8)
LEARNED = Weighting(
    base={"and": 2.6, "or": 0.2, "vector": -1.4, "trigram": 0.0}, rare_term_boost={"and": 1.8, "trigram": 0.2}, typo_boost={"trigram": 0.2, "and": -0.8}, rare_idf_floor=9.5,
    paraphrase_min_terms=16, paraphrase_oov_floor=0.5, typo_max_terms=8,
)
#: Profiles with weights that don't depend on the question.
FIXED_PROFILES = {"naive": {"vector": 1.0}, "fixedRrf": {"and": 1.0, "or": 1.0, "vector": 1.0}}
#: An alias is ambiguous if more documents hold it than this many times those tagged with the person.
AMBIGUOUS_RATIO = 1.25


def term_features(questions: DataFrame, frequency: DataFrame, total_docs: int, w: Weighting, confident: DataFrame | None = None) -> DataFrame:
    """questions (qid, text), frequency (stem, df), confident (qid: those that surely name someone) -> qid, n_terms, n_stems, max_idf, mean_idf, rare_terms, oov_ratio, looks_paraphrase, typo_suspect."""
    asked = questions.select("qid", F.size(T.terms(F.col("text"))).alias("n_terms"), F.explode_outer(T.content_terms(F.col("text"))).alias("term"))
    known = stemmed(asked.select("term").where("term is not null").distinct()).join(frequency, "stem", "left")
    idf = F.when(F.col("df") > 0, F.log(F.lit(float(max(1, total_docs))) / F.col("df")))
    per_term = asked.join(known.select("term", "stem", idf.alias("idf")), "term", "left")
    out = per_term.groupBy("qid", "n_terms").agg(
        F.count("stem").alias("n_stems"), F.coalesce(F.greatest(F.max("idf"), F.lit(0.0)), F.lit(0.0)).alias("max_idf"), F.coalesce(F.avg("idf"), F.lit(0.0)).alias("mean_idf"),
        F.sort_array(F.collect_set(F.when(F.col("idf") >= w.rare_idf_floor, F.col("stem")))).alias("rare_terms"),
        F.count_if(F.col("stem").isNotNull() & F.col("idf").isNull()).alias("n_oov"),
    )
    out = out.withColumn("oov_ratio", F.when(F.col("n_stems") > 0, F.col("n_oov") / F.col("n_stems")).otherwise(0.0))
    paraphrase = (F.col("n_terms") >= w.paraphrase_min_terms) & (F.col("oov_ratio") >= w.paraphrase_oov_floor)
    if confident is not None:  # who names a person doesn't paraphrase
        out = out.join(confident.select("qid", F.lit(True).alias("named")).distinct(), "qid", "left")
        paraphrase = paraphrase & F.col("named").isNull()
    typo = (F.col("oov_ratio") >= w.oov_ratio_floor) & (F.col("n_terms") <= w.typo_max_terms)
    return out.withColumn("looks_paraphrase", paraphrase).withColumn("typo_suspect", typo).drop("n_oov", "named")


def lane_weights(w: Weighting, max_idf: Column, looks_paraphrase: Column, typo_suspect: Column, has_person: Column, has_date: Column) -> dict[str, Column]:
    """One weight per lane: base and boosts are added up, then clamped once to [0, 3]."""
    rules = [(max_idf >= w.rare_idf_floor, w.rare_term_boost), (looks_paraphrase, w.paraphrase_boost), (typo_suspect, w.typo_boost), (has_person, w.entity_boost), (has_date, w.date_boost)]
    out = {}
    for lane in LANES:
        total = F.lit(float(w.base.get(lane, 0.0)))
        for when, boost in rules:
            if lane in boost:
                total = total + F.when(when, float(boost[lane])).otherwise(0.0)
        out[lane] = F.least(F.lit(3.0), F.greatest(F.lit(0.0), total))
    return out


def ambiguous_aliases(aliases: DataFrame, frequency: DataFrame, tagged: DataFrame) -> DataFrame:
    """aliases (slug, alias), frequency (alias, df), tagged (slug, tagged): with ambiguous, if an alias stands in many more rows than its slug tags."""
    rows = aliases.join(frequency, "alias", "left").join(tagged, "slug", "left")
    known = (F.col("tagged") > 0) & (F.col("df") > F.col("tagged") * AMBIGUOUS_RATIO)
    return rows.select("slug", "alias", F.coalesce(known, F.lit(False)).alias("ambiguous"))


def resolve_filters(questions: DataFrame, filters: bool = True) -> DataFrame:
    """questions (qid, declared: struct(date_from, date_to, people) or null, inferred: the same) -> qid, date_from, date_to, people.

    Declared filters, where there are any, win as a whole: what they leave out isn't inferred. A profile may have none at all.
    """
    if not filters:
        nothing = {"date_from": F.lit(None).cast("date"), "date_to": F.lit(None).cast("date"), "people": F.array().cast("array<string>")}
        return questions.select("qid", *[c.alias(n) for n, c in nothing.items()])
    pick = lambda n: F.when(F.col("declared").isNotNull(), F.col(f"declared.{n}")).otherwise(F.col(f"inferred.{n}"))
    return questions.select("qid", pick("date_from").alias("date_from"), pick("date_to").alias("date_to"), F.coalesce(pick("people"), F.array().cast("array<string>")).alias("people"))


def merged(base: dict, override: dict) -> dict:
    """A configuration with values of another laid over it, table by table; what isn't a table is replaced whole."""
    return {**base, **{k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in override.items()}}


def distinct_texts(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """questions (qid, text) -> texts to be embedded (key, text), each once, and qid, key: blanks and case don't make another text."""
    plain = F.lower(T.squeeze(F.col("text")))
    keyed = questions.select("qid", F.sha2(plain, 256).alias("key"), plain.alias("text"))
    return keyed.groupBy("key").agg(F.min("text").alias("text")), keyed.select("qid", "key")


def entities(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """questions (qid, text), aliases (slug, alias, ambiguous) -> qid, slug, place, ambiguous, by earliest mention.

    An alias of several words is found through its first word, then by its whole text at word borders.
    """
    known = aliases.select("slug", F.lower(F.trim("alias")).alias("alias"), "ambiguous").where(F.col("alias") != "").where(~T.is_stopword(F.col("alias")))
    known = known.withColumn("word", F.element_at(T.terms(F.col("alias")), 1))
    words = questions.select("qid", F.lower("text").alias("text")).withColumn("word", F.explode(F.array_distinct(T.terms(F.col("text")))))
    padded = lambda c: F.regexp_replace(c, "[^a-z0-9_]", " ")
    place = F.instr(F.concat(F.lit(" "), padded(F.col("text")), F.lit(" ")), F.concat(F.lit(" "), padded(F.col("alias")), F.lit(" ")))
    found = words.join(known, "word").withColumn("place", place).where("place > 0")
    return found.groupBy("qid", "slug").agg(F.min("place").alias("place"), F.bool_or("ambiguous").alias("ambiguous"))

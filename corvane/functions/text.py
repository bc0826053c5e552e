"""Text expressions: terms, stopwords, stems, character trigrams. All are built-in expressions, so they stay in codegen."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that carry no weight in retrieval.
STOPWORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an",
    "and", "any", "are", "aren't", "as", "at", "be", "because", "been",
    "before", "being", "below", "between", "both", "but", "by", "can", "did",
    "do", "does", "doing", "don't", "down", "during", "each", "few", "for",
    "from", "further", "had", "has", "have", "having", "he", "her", "here",
    "hers", "herself", "him", "himself", "his", "how", "i", "if", "in",
    "into", "is", "it", "its", "itself", "just", "me", "more", "most", "my",
    "myself", "no", "nor", "not", "now", "of", "off", "on", "once", "only",
    "or", "other", "our", "ours", "ourselves", "out", "over", "own", "s",
    "same", "she", "should", "so", "some", "such", "t", "than", "that",
    "the", "their", "theirs", "them", "themselves", "then", "there", "these",
    "they", "this", "those", "through", "to", "too", "under", "until", "up",
    "very", "was", "we", "were", "what", "when", "where", "which", "while",
    "who", "whom", "why", "will", "with", "won't", "would", "you", "your",
    "yours", "yourself", "yourselves",
]
#: Fixed value: a term is a run of letters and digits, held together by inner hyphens and apostrophes.
TERM = "[a-z0-9]+(?:[-'][a-z0-9]+)*"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def is_stopword(term: Column) -> Column:
    return term.isin(STOPWORDS)


def content_terms(text: Column) -> Column:
    """Terms without stopwords and bare numbers, repeats kept."""
    return F.filter(terms(text), lambda t: ~is_stopword(t) & ~t.rlike("^[0-9]+$"))


def phrases(text: Column) -> Column:
    """What stands in double quotes, trimmed, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)), lambda p: F.lower(F.trim(p)))


#: The suffix rules, which have to give the stems that an index was built with. Each is tried once, in this
#: order; END marks a word that a rule of its group has changed, so that no later rule of the group applies.
END = "\u0001"
SUFFIX_RULES = [
    ("'s$", ""),
    ("^(.{3,})ies$", "$1y"),
    ("([^siu])s$", "$1"),
    ("^(.{3,})ing$", f"$1{END}"),
    (f"^(.{{2,}}[^e{END}])ed$", f"$1{END}"),
    (rf"([bcdfghjkmnpqrtvwxy])\1{END}$", f"$1{END}"),
    (f"{END}$", ""),
    ("^(.{2,})iness$", f"$1y{END}"),
    ("^(.{2,})ness$", f"$1{END}"),
    ("^(.{3,})ly$", "$1"),
    (f"{END}$", ""),
]


def stem(word: Column) -> Column:
    """A careful suffix stripper: possessive, plural, -ing/-ed (and then a doubled consonant), -iness/-ness/-ly; short words stay.

    Every rule is one regular expression over the result of the one before, so the whole stays in codegen.
    """
    stripped = word
    for pattern, put in SUFFIX_RULES:
        stripped = F.regexp_replace(stripped, pattern, put)
    return F.when(F.length(word) < 4, word).otherwise(stripped)


def trigrams(word: Column) -> Column:
    """Distinct character trigrams of one word, with two blanks before it and one after."""
    padded = F.concat(F.lit("  "), F.lower(word), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def text_trigrams(text: Column) -> Column:
    """Distinct trigrams of all words of a text; words are runs of letters and digits."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(words, trigrams)))


def clip(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(" ..."))).otherwise(text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title_of(text: Column) -> Column:
    """One line of at most 120 characters; longer ones end in an ellipsis after 117."""
    line = squeeze(text)
    return F.when(F.length(line) > 120, F.concat(F.substring(line, 1, 117), F.lit("..."))).otherwise(line)


def is_remember_command(text: Column) -> Column:
    return text.rlike(r"(?i)^\s*(please\s+)?(remember|save|note)\b")


def is_complete_command(text: Column) -> Column:
    return text.rlike(r"(?i)^\s*(please\s+)?(mark|complete|finish)\b")


def strip_tagged(text: Column, tags: list[str]) -> Column:
    """Without the blocks between paired tags, shortest first."""
    for tag in tags:
        text = F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>", "")
    return text


@functools.lru_cache(maxsize=100_000)
def stem_of(word: str) -> str:
    """stem() of one word, by the same rules, for functions that run in Python anyway."""
    stripped = word
    for pattern, put in SUFFIX_RULES:
        stripped = re.sub(pattern, put.replace("$1", r"\1"), stripped)
    return word if len(word) < 4 else stripped


def certificate_terms(text: Column) -> Column:
    """The words that certificates are made of: another tokenizer than that of retrieval."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))
    return F.filter(words, lambda w: ~is_stopword(w) & (F.length(w) > 1))


def certificate_stem(word: Column) -> Column:
    """The coarser stemmer of certificates, kept apart from stem(). Endings, the lengths they need, what is cut and put."""
    rules = [("ies", 5, 3, "y"), ("es", 5, 2, ""), ("ing", 5, 3, ""), ("ed", 5, 2, ""), ("ly", 4, 2, ""), ("s", 4, 1, "")]
    out = word
    for end, least, cut, put in reversed(rules):
        fits = F.endswith(word, F.lit(end)) & (F.length(word) >= least)
        fits = fits & ~F.endswith(word, F.lit("ss")) if end == "s" else fits
        out = F.when(fits, F.concat(F.substring(word, F.lit(1), F.length(word) - cut), F.lit(put))).otherwise(out)
    return out

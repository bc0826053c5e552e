"""Arrow-batched functions for what built-in expressions can't say: extents, excerpts, canonical JSON, deadlines.

They run over few rows (candidates of a question, archives, new nodes), never over a whole corpus.
"""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.dates import MONTHS
from corvane.functions.text import STOPWORDS, TERM, stem_of

#: Characters of an excerpt, and how many of a question's terms it looks for.
EXCERPT, QUERY_STEMS = 700, 32
_TERM = re.compile(TERM, re.I | re.A)
#: Extents of word similarity have at most this many words more than the query.
EXTRA_WORDS = 4


def _grams(words: list[str]) -> set[str]:
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def word_similarity_of(query: str, text: str) -> float:
    """The best trigram similarity of the query and a run of neighbouring words of the text."""
    asked, words = re.findall("[a-z0-9]+", query.lower()), re.findall("[a-z0-9]+", text.lower())
    a, best = _grams(asked), 0.0
    if not a:
        return 0.0
    grams = {w: _grams([w]) for w in set(words)}
    for lo, word in enumerate(words):
        if not grams[word] & a:
            continue  # a better extent begins later
        extent: set[str] = set()
        both = 0
        for hi in range(lo, min(len(words), lo + len(asked) + EXTRA_WORDS)):
            new = grams[words[hi]] - extent
            extent |= new
            both += len(new & a)
            best = max(best, both / (len(a) + len(extent) - both))
    return best


def word_similarity(query: Column, text: Column) -> Column:
    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if q is None or t is None else word_similarity_of(q, t) for q, t in zip(query, text, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(query, text)


def excerpt_of(text: str, stems: dict[str, str], limit: int = EXCERPT) -> tuple[int, str]:
    """Offset and text of the window that holds the most different stems of a question, then the tightest, then the first.

    stems: the words of the text that count, with their stems. Offsets count UTF-16 code units; no surrogate pair is cut.
    """
    units = np.concatenate(([0], np.cumsum(1 + (np.frombuffer(text.encode("utf-32-le"), np.uint32) > 0xFFFF)))).astype(np.int64)
    if units[-1] <= limit:
        return 0, text
    found = [(m.start(), m.end(), stems[w]) for m in _TERM.finditer(text) if (w := m.group().lower()) in stems]
    starts, ends = (units[np.array([f[k] for f in found], np.int64)] for k in (0, 1))
    fits = np.flatnonzero(ends - starts <= limit)
    begin = 0
    if len(fits):
        starts, ends, kinds = starts[fits], ends[fits], np.unique([found[i][2] for i in fits], return_inverse=True)[1]
        # Each match closes a window that reaches back as far as it may. A stem counts once: by its last match inside.
        after = np.full(len(kinds), len(kinds))
        by_kind = np.lexsort((np.arange(len(kinds)), kinds))
        same = kinds[by_kind][1:] == kinds[by_kind][:-1]
        after[by_kind[:-1][same]] = by_kind[1:][same]
        first = np.searchsorted(starts, ends - limit)
        different = np.array([np.count_nonzero(after[lo : hi + 1] > hi) for hi, lo in enumerate(first)])
        best = np.lexsort((ends - starts[first], -different))[0]
        begin = min(max((starts[first[best]] + ends[best]) // 2 - limit // 2, 0), units[-1] - limit)
    lo = int(np.searchsorted(units, begin))
    hi = int(np.searchsorted(units, units[lo] + limit, "right")) - 1
    return int(units[lo]), text[lo:hi]


def stems_of(text: str, question: str) -> dict[str, str]:
    """The words of a text that share a stem with one of a question's first terms. Stems differ from words in the end only: others needn't be made."""
    asked = {stem_of(t) for t in [t for t in _TERM.findall(question.lower()) if t not in STOPWORDS][:QUERY_STEMS]}
    begins = {s[:2] for s in asked}
    return {w: s for w in set(_TERM.findall(text.lower())) if w[:2] in begins and (s := stem_of(w)) in asked}


def excerpt(text: Column, question: Column) -> Column:
    """struct(start, excerpt)"""

    def run(text: pd.Series, question: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(0, "") if t is None else excerpt_of(t, stems_of(t, q or "")) for t, q in zip(text, question, strict=True)], columns=["start", "excerpt"])

    return F.pandas_udf(run, "start long, excerpt string")(text, question)


def canonical_json_of(value: str | None) -> str | None:
    try:
        return None if value is None else json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def canonical_json(value: Column) -> Column:
    """JSON with keys in order at every level, without blanks: what digests are taken of. Null for what isn't JSON."""

    def run(value: pd.Series) -> pd.Series:
        return value.map(canonical_json_of)

    return F.pandas_udf(run, "string")(value)


#: What announces a deadline, how far it may stand from a date (before it, around it), and what counts how much.
CUE = r"\b(?:by|deadline|due|expires?|expiration|through|until|valid\s+until|lasts?\s+(?:for|until))\b"
BEFORE, AROUND = 36, (24, 12)
CUE_BEFORE, CUE_AROUND, SAYS_YEAR, LIES_AHEAD = 8, 4, 2, 1
#: The dates that are read: 2026-03-05; March 5[, 2026]; today; tomorrow; in 9 days.
_NUMERIC, _WORDED, _RELATIVE = r"(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})", rf"(?P<month>{'|'.join(MONTHS)})\s+(?P<day>\d{{1,2}})(?:,?\s+(?P<year>\d{{4}}))?", r"(?P<near>today|tomorrow)|in\s+(?P<n>\d{1,3})\s+days?"
_DATE, _CUES = re.compile(rf"\b(?:{_NUMERIC}|{_WORDED}|{_RELATIVE})\b", re.I), re.compile(f"(?={CUE.replace('(?:by', '(by', 1)})", re.I)


def _day_of(found: dict[str, str | None], as_of: datetime) -> datetime | None:
    """Midnight of the day that a match of _DATE names, None for a day that no calendar has."""
    today = datetime(as_of.year, as_of.month, as_of.day)
    if found["near"] or found["n"]:
        return today + timedelta(days=int(found["n"] or 0) if found["n"] else ("today", "tomorrow").index(found["near"].lower()))
    month = int(found["m"]) if found["m"] else MONTHS.index(found["month"].lower()) + 1
    try:
        return datetime(int(found["y"] or found["year"] or as_of.year), month, int(found["d"] or found["day"]))
    except ValueError:
        return None


def deadline_of(text: str, as_of: datetime) -> datetime | None:
    """The likeliest deadline of a text, by a bounded grammar of dates.

    Where no cue stands anywhere there is none. Points are given for a cue that lies wholly before the date or around
    it, for a year and for lying ahead; of equals the later in the text wins, and without a point none does. A day ends
    at its last second; what is past is no deadline.
    """
    cues = [m.span(1) for m in _CUES.finditer(text)]

    def points(m: re.Match, day: datetime) -> int:
        lo, hi = m.span()
        near = CUE_BEFORE if any(lo - BEFORE <= a and b <= lo for a, b in cues) else CUE_AROUND if any(lo - AROUND[0] <= a and b <= hi + AROUND[1] for a, b in cues) else 0
        return near + SAYS_YEAR * bool(m["y"] or m["year"]) + LIES_AHEAD * (day >= as_of)

    dated = [(points(m, day), m.start(), day + timedelta(days=1, seconds=-1)) for m in _DATE.finditer(text) if (day := _day_of(m.groupdict(), as_of))] if cues else []
    score, _, due = max(dated, default=(0, 0, as_of))
    return due if score and due >= as_of else None


def deadline(text: Column, as_of: datetime) -> Column:
    def run(t: pd.Series) -> pd.Series:
        return pd.to_datetime(t.map(lambda x: None if x is None else deadline_of(x, as_of)))

    return F.pandas_udf(run, "timestamp")(text)

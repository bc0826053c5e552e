"""Token counts by section (operator 8).

A document is encoded once and whole; the character spans of its tokens are joined with the spans of its sections, and
a token that reaches over a border is given to one section by a stated rule: "first", the section of its first
character; "last", that of its last; "most", the one that holds most of its characters, ties to the earlier. So the
counts of a document's sections always add up to its own count, which counting section by section wouldn't.

Only matches of the tokenizer's pattern that reach over a border are looked at token by token; of all others the
number of tokens is enough. Both sides are in order, so the join is a binary search of borders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.bpe import ByteBPE, coder
from corvane.llm.common import bound_batches, hold

RULES = ("first", "last", "most")
FIELDS = ["section", "start", "end", "n_tokens", "crossing"]


def lines(text: str) -> np.ndarray:
    """Where each line starts; a line holds its own line feed."""
    ends = np.array([i + 1 for i in _places(text, "\n")], np.int64)
    return np.concatenate(([0], ends[ends < len(text)]))


def title_and_lines(text: str) -> np.ndarray:
    """As lines, and the first sentence of the first line apart; the blank after its full stop is part of it."""
    starts, at = lines(text), text.find(". ") + 2
    return np.insert(starts, 1, at) if 2 <= at < (starts[1] if len(starts) > 1 else len(text)) else starts


def _places(text: str, what: str) -> Iterator[int]:
    at = text.find(what)
    while at >= 0:
        yield at
        at = text.find(what, at + 1)


def token_spans(bpe: ByteBPE, piece: str) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token, and the one after its last; a token of part of a character's bytes has all of it."""
    char_of = np.repeat(np.arange(len(piece)), [len(c.encode()) for c in piece])
    ends = np.cumsum([bpe.length[i] for i in np.frombuffer(bpe.packed[piece], np.uint32)])
    return char_of[np.concatenate(([0], ends[:-1]))], char_of[ends - 1] + 1


def attribute(bpe: ByteBPE, text: str, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens given to each section, and how many of them reach over its borders. starts: ascending from 0."""
    pieces = list(chain.from_iterable(bpe.matches(text)))
    n = np.fromiter(map(len, map(bpe.packed.__getitem__, pieces)), np.int64, len(pieces)) // 4
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    begins = np.concatenate(([0], ends[:-1]))
    first, last = (np.searchsorted(starts, x, "right") - 1 for x in (begins, ends - 1))
    inside = first == last
    counts = np.bincount(first[inside], n[inside], len(starts)).astype(np.int64)
    crossing = np.zeros(len(starts), np.int64)
    for i in np.flatnonzero(~inside):
        a, b = (x + begins[i] for x in token_spans(bpe, pieces[i]))
        lo, hi = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b - 1, "right") - 1
        to = {"first": lo, "last": hi}.get(rule)
        if to is None:
            borders = np.append(starts, len(text))
            to = np.array([max(range(p, q + 1), key=lambda s: (min(y, borders[s + 1]) - max(x, borders[s]), -s)) for x, y, p, q in zip(a, b, lo, hi, strict=True)])
        np.add.at(counts, to, 1)
        np.add.at(crossing, to, lo != hi)
    return counts, crossing


def count_tokens(df: DataFrame, rank_file: str, pattern: str, rule: str = "first", sections: Callable[[str], np.ndarray] = title_and_lines, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, section (from 0), start, end (characters), n_tokens, crossing: one row per section of each row of df.

    sections gives the ascending starts of a text's sections, the first one 0. A text that is null or empty is one
    section of no characters and no tokens. Repeated rows are counted each; an empty table gives no rows; other
    columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("bpe", coder.cache_clear)
        bpe = coder(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = batch.column(0).slice(at, 256), batch.column(1).slice(at, 256)
                parts, rows = [], []
                for text in texts:
                    text = text.as_py() or ""
                    starts = sections(text) if text else np.zeros(1, np.int64)
                    counts, crossing = attribute(bpe, text, starts, rule) if text else (np.zeros(1, np.int64),) * 2
                    rows.append(len(starts))
                    parts.append((np.arange(len(starts)), starts, np.append(starts[1:], len(text)), counts, crossing))
                columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)]
                of = pa.array(np.repeat(np.arange(len(rows)), rows))
                yield pa.RecordBatch.from_arrays([ids.take(of), *columns], [id_col, *FIELDS])

    kind = df.schema[id_col].dataType.simpleString()
    return bound_batches(df).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{f} long" for f in FIELDS))

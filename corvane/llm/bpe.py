"""Byte-level BPE encoding and decoding (operator 2).

A text is split by the tokenizer's pattern; each match is encoded by itself. Its bytes, read as Latin-1 so that one
character is one byte, run once through an Aho-Corasick automaton of the whole vocabulary, which gives the longest
token that starts at each place. From those the encoder goes forward, and steps back to a shorter token, or to the
token before, whenever two neighbours are not what the merges would have left next to each other. That test undoes
merges on both sides of the border until one of them would have crossed it; its results are kept. No place is left
twice with the same verdict, so the time is linear in the length, even for one word of a million letters.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.common import bound_batches, hold

#: Entries of each memo; a full memo is emptied, which bounds a worker's memory and changes no result.
MEMO = 300_000
#: Matches longer than this are encoded afresh each time; texts longer than LONG_TEXT are split piece by piece.
MEMO_PIECE, LONG_TEXT = 48, 4_000_000

#: Code points that the installed regex package counts as letters or numbers, and Unicode 16 (which
#: tiktoken's splitter follows) doesn't. First and last of each range.
NEWER_LETTERS = (
    "0558-0558 058B-058C 088F-088F 0C5C-0C5C 0CDC-0CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2 A7F1-A7F1 AB6C-AB6D "
    "107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DF1-11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE "
    "1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
NEWER_NUMBERS = "11DE0-11DE9 1246F-1246F 12475-1247F 12550-12686 16FF4-16FF6"


def _members(ranges: str) -> set[str]:
    return {chr(c) for a, b in (r.split("-") for r in ranges.split()) for c in range(int(a, 16), int(b, 16) + 1)}


def _as_ranges(chars: set[str]) -> str:
    codes = sorted(map(ord, chars))
    starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


def _spelled_out(pattern: str, most: int) -> re.Pattern:
    """The pattern with its classes as ranges of code points below most, for the faster re module."""
    import regex

    every = "".join(chr(c) for c in range(most) if not 0xD800 <= c < 0xE000)
    letters = _as_ranges(set(regex.findall(r"\p{L}", every)) - _members(NEWER_LETTERS))
    numbers = _as_ranges(set(regex.findall(r"\p{N}", every)) - _members(NEWER_NUMBERS))
    blanks = _as_ranges(set(regex.findall(r"\s", every)))
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return re.compile(pattern.replace(r"\S", f"[^{blanks}]").replace(r"\s", f"[{blanks}]"))


class Memo(dict):
    """A dict that computes what it lacks, and starts over when full."""

    def __init__(self, f, most: int = MEMO):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, key):
        value = self.f(key)
        if len(key) <= MEMO_PIECE:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class ByteBPE:
    """Encoder and decoder for a rank file (base64 token, rank) and a splitting pattern."""

    def __init__(self, rank_file: str, pattern: str):
        import ahocorasick
        import regex

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(ranks.values()) + 1
        self.by_bytes = {t.decode("latin-1"): r for t, r in ranks.items()}
        self.token: list[bytes | None] = [None] * size
        for t, r in ranks.items():
            self.token[r] = t
        self.length = [len(t or b"") for t in self.token]
        self.automaton = ahocorasick.Automaton()
        for s, r in self.by_bytes.items():
            self.automaton.add_word(s, r)
        self.automaton.make_automaton()
        self.shorter = [self._longest_prefix_token(s) for s in ((t or b"").decode("latin-1") for t in self.token)]
        self.joined: dict[tuple[int, int], int] = {}
        self.halves = [(r, r) for r in range(size)]
        for r in range(size):
            if self.length[r] > 1:
                self._find_halves(r)
        self.fits = Memo(self._fits)
        self.packed = Memo(lambda piece: array("I", self._encode_piece(piece)).tobytes())  # bytes are small, and the garbage collector skips them
        self.astral = re.compile("[^\0-\uffff]").search
        self.near, self.far = _spelled_out(pattern, 0x10000), None
        self.pattern = pattern

    def _longest_prefix_token(self, s: str) -> int | None:
        return next((self.by_bytes[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.by_bytes), None)

    def _find_halves(self, r: int) -> None:
        """The two tokens whose merge makes token r."""
        whole = self.token[r].decode("latin-1")
        left = self.shorter[r]
        while left is not None:
            right = self.by_bytes.get(whole[self.length[left] :])
            if right is not None and left < r and right < r and self._fits((left, right)):
                self.joined[left, right] = r
                self.halves[r] = (left, right)
                return
            left = self.shorter[left]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether merging the bytes of both leaves exactly these two tokens."""
        a, b = pair
        before = len(self.halves)  # merges of this rank and above come too late to cross the border
        while True:
            if self.joined.get((a, b), before) < before:
                return False
            left_first = a > b
            for left in (left_first, not left_first):  # undo the later of the two merges; of a single byte, the other
                if left and self.halves[a][0] != a:
                    before, a = a, self.halves[a][1]
                    break
                if not left and self.halves[b][0] != b:
                    before, b = b + 1, self.halves[b][0]
                    break
            else:
                return True

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        s = piece.encode().decode("latin-1")
        whole = self.by_bytes.get(s)
        if whole is not None:
            return (whole,)
        length, shorter, fits = self.length, self.shorter, self.fits
        longest: list[int] = [0] * len(s)
        for end, r in self.automaton.iter(s):
            longest[end + 1 - length[r]] = r  # ends ascend, so the last one to start here is the longest
        alive = bytearray(b"\1") * (len(s) + 1)
        out: list[int] = []
        at, r, size = 0, longest[0], len(s)
        while True:
            while r is not None and not (alive[at + length[r]] and (not out or fits[out[-1], r])):
                r = shorter[r]
            if r is None:  # nothing can follow here: give this place up, and shorten the token before
                alive[at] = 0
                r = out.pop()
                at -= length[r]
                continue
            out.append(r)
            at += length[r]
            if at == size:
                return tuple(out)
            r = longest[at]

    def matches(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, in lists."""
        if text.isascii() or not self.astral(text):
            split = self.near
        else:
            self.far = split = self.far or _spelled_out(self.pattern, 0x110000)
        if len(text) <= LONG_TEXT:
            yield split.findall(text)
        else:
            found = (m.group() for m in split.finditer(text))
            while part := list(islice(found, 100_000)):
                yield part

    def encode_packed(self, text: str) -> bytes:
        """The ids as unsigned 32-bit integers, one after the other."""
        return b"".join(chain.from_iterable(map(self.packed.__getitem__, part) for part in self.matches(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.uint32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def coder(rank_file: str, pattern: str) -> ByteBPE:
    """One coder per worker process and vocabulary."""
    return ByteBPE(rank_file, pattern)


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) of each row's whole text; null counts as empty, an empty text has no ids.

    Rows are independent: repeated rows give repeated results, an empty table an empty one, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("bpe", coder.cache_clear)
        bpe = coder(rank_file, pattern)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 256):  # small result batches: ids of few texts at a time
                packed = [bpe.encode_packed(t.as_py() or "") for t in texts[at : at + 256]]
                offsets = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 256], ids], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return bound_batches(df).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ids, decoded (binary): the bytes behind the ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("bpe", coder.cache_clear)
        bpe = coder(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                decoded = pa.array([bpe.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], [id_col, "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return bound_batches(df).select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def round_trip(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, decoded: encode() and then decode() in one worker, for those who want both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("bpe", coder.cache_clear)
        bpe = coder(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids = [np.frombuffer(bpe.encode_packed(t.as_py() or ""), np.int32) for t in batch.column(1)[at : at + 256]]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                decoded = pa.array([bpe.decode(x.tolist()) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 256], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))), decoded], [id_col, "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return bound_batches(df).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")

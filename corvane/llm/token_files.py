"""Token ids in grammar-compressed files (operator 3).

Documents are dealt to tasks by ranges of their id and sorted there; each task encodes its documents, appends the end
id, and closes a block at BLOCK_TOKENS ids. A block is compressed by Re-Pair: the frequent pairs of neighbouring ids
are replaced by new symbols (nonterminals), again and again, until no pair within documents occurs LEAST times. Where
16-bit symbols run out it goes on with 32-bit ones, and the smaller of both results is kept; it stops there if that is
sure to be the narrow one: a symbol whose pairs with both neighbours are rare stays for good, since replacing others
makes no pair more frequent, so the number of such symbols tells how short the wide result can get at best. A block holds its rules, the
length to which each expands, where each document starts among symbols, and the symbols, so one document is decoded
without the others. Blocks are the rows of a Parquet table (part, block, payload), which any store can hold; part and
block put them in ascending order of ids.

Payload, little-endian: MAGIC; then as unsigned 64-bit: symbol width in bytes, terminals, documents, rules, symbols,
tokens; then document ids (int64), a byte per document that is 1 for a null id, first symbol of each document (u32),
rules (two symbols each), expansion length of each rule (u32), symbols; then the CRC-32 of all before it (u32).
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import bound_batches, cut, hold

MAGIC = b"CVRP0001"
END_ID = 2
BLOCK_TOKENS = 1 << 20
#: How often a pair must occur for a rule to pay.
LEAST = 4
MEMO, LONG_TEXT = 800_000, 4_000_000
HASH_BITS = 16


class WordEncoder:
    """tokenizers' encode() of whole texts, by way of a bounded memo from blank-delimited chunks to their ids.

    Blanks end every match of the tokenizer's pattern, so chunks are encoded independently. str.split() takes the
    tokenizer's blanks and U+001C to U+001F; a text with one of those is cut at the six ASCII blanks only.
    """

    odd_blanks = re.compile("[\x1c-\x1f]").search
    not_latin1 = re.compile("[^\0-\xff]").search
    #: A full stop or comma that follows another mark belongs to that mark's token.
    mark_run = re.compile("[^a-z\xe0-\xff0-9 \t\n\x0b\f\r][.,](?: |\n)").search
    chunks = re.compile("[^ \t\n\x0b\f\r]+").finditer

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.terminals = self.tokenizer.get_vocab_size()
        self.code = "H" if self.terminals <= 1 << 16 else "I"
        self.ends_word = np.zeros(self.terminals, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")
        self.memo: dict[str, bytes] = {}

    def _lists(self, text: str) -> Iterator[list[str]]:
        if len(text) > LONG_TEXT or self.odd_blanks(text):
            found = (m.group() for m in self.chunks(text))
            while part := list(islice(found, 100_000)):
                yield part
            return
        if text.isascii() or not self.not_latin1(text):  # folding case early makes more chunks alike
            text = text.lower()
            if not self.mark_run(text):
                text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ").replace(",\n", " , ")
        yield text.split()

    def _learn(self, parts: list[list[str]]) -> None:
        missing = set().union(*parts).difference(self.memo)
        if len(self.memo) + len(missing) > MEMO:
            self.memo.clear()
            missing = set().union(*parts)
        words = [c for c in missing if c.isalpha()]
        if words and self._learn_words(words):
            missing.difference_update(words)
        missing, code = list(missing), self.code
        for chunk, e in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False), strict=True):
            self.memo[chunk] = array(code, e.ids).tobytes()

    def _learn_words(self, words: list[str]) -> bool:
        """Encode chunks of letters in one text: each is one match, so its last id, and no other, ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            return False
        packed, width = ids.astype(np.dtype(self.code)).tobytes(), array(self.code).itemsize
        at = 0
        for word, stop in zip(words, (stops * width).tolist(), strict=True):
            self.memo[word] = packed[at:stop]
            at = stop
        return True

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as packed unsigned integers. The memo holds this many texts' chunks at once: give few."""
        out: list[bytes] = []
        lists = [self._lists(t) for t in texts]
        if all(len(t) <= LONG_TEXT for t in texts):
            parts = [[c for part in it for c in part] if self.odd_blanks(t) else next(it) for it, t in zip(lists, texts, strict=True)]
            known, later = self.memo.__getitem__, []
            for i, part in enumerate(parts):
                try:
                    out.append(b"".join(map(known, part)))
                except KeyError:  # some chunk is new: those of all such texts are learned together
                    out.append(b"")
                    later.append(i)
            if later:
                self._learn([parts[i] for i in later])
                for i in later:
                    out[i] = b"".join(map(known, parts[i]))
            return out
        for it in lists:
            pieces = []
            for part in it:
                self._learn([part])
                pieces.append(b"".join(map(self.memo.__getitem__, part)))
            out.append(b"".join(pieces))
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def compress(ids: np.ndarray, starts: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """symbols, first symbol of each document, rules (n x 2), expansion lengths. starts: first id of each document.

    Symbols may come out wider than ids.
    """
    wide = ids.dtype.itemsize > 2
    room = (1 << 31 if wide else 1 << 16) - terminals
    seq, starts = ids, starts.astype(np.int64)
    rules, lengths = [], np.ones(terminals, np.uint32)
    narrow, gone_wide = None, False
    size = lambda seq, lengths: len(seq) * seq.itemsize + (len(lengths) - terminals) * (2 * seq.itemsize + 4)
    while len(seq) > 1:
        if room <= 0:
            if wide:
                break
            narrow, wide, room = (seq, starts, list(rules), lengths), True, (1 << 31) - len(lengths)
            seq = seq.astype("<u4")
        pair = (seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:]) if wide else (seq[:-1].astype(np.uint32) << np.uint32(16) | seq[1:])
        inside = np.ones(len(pair), bool)
        inside[starts[1:][(starts[1:] > 0) & (starts[1:] <= len(pair))] - 1] = False  # never across two documents
        ordered = np.sort(pair[inside])
        if not len(ordered):
            break
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        times = np.diff(np.append(first, len(ordered)))
        often = np.flatnonzero(times >= LEAST)
        if not len(often):
            break
        floor = max(LEAST, int(times.max()) // 64)  # the most frequent first: what is rarer may be part of a longer pair later
        factor, shift = (np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - HASH_BITS)) if wide else (np.uint32(0x9E3779B1), np.uint32(32 - HASH_BITS))
        spread = lambda p: (p * factor >> shift).astype(np.intp)
        if narrow and not gone_wide:
            gone_wide = True
            repeated = np.zeros(1 << HASH_BITS, bool)
            repeated[spread(ordered[first[often]])] = True  # pairs that share a slot with one count as repeated: the bound only gets weaker
            moves = repeated[spread(pair)] & inside
            for_good = len(seq) - np.count_nonzero(np.append(moves, False) | np.insert(moves, 0, False))
            if 4 * for_good + 12 * (len(lengths) - terminals) >= size(narrow[0], narrow[3]):
                break
        often = often[times[often] >= floor]
        often = often[np.argsort(-times[often], kind="stable")][: 1 << (HASH_BITS - 2)]
        chosen = ordered[first[often]]
        slot = spread(chosen)
        _, at = np.unique(slot, return_index=True)  # of pairs in one slot the most frequent; the others have later rounds
        at = np.sort(at)[:room]
        chosen, slot = chosen[at], slot[at]
        table_pair = np.full(1 << HASH_BITS, np.iinfo(pair.dtype).max, pair.dtype)
        table_at = np.zeros(1 << HASH_BITS, np.int64)
        table_pair[slot], table_at[slot] = chosen, np.arange(len(chosen))
        where = spread(pair)
        hit = np.flatnonzero((table_pair[where] == pair) & inside)
        if not len(hit):
            break
        run = np.concatenate(([True], np.diff(hit) > 1))
        hit = hit[(hit - np.maximum.accumulate(np.where(run, hit, 0))) % 2 == 0]  # neighbours overlap: every other one
        used, rule = np.unique(table_at[where[hit]], return_inverse=True)
        new = chosen[used]
        left, right = (new >> 32, new & np.uint64(0xFFFFFFFF)) if wide else (new >> 16, new & np.uint32(0xFFFF))
        rules.append(np.stack([left, right], 1))
        symbol = len(lengths) + rule
        lengths = np.concatenate([lengths, lengths[left] + lengths[right]])
        room -= len(used)
        seq = seq.copy()
        seq[hit] = symbol
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq = seq[keep]
        starts = starts - np.searchsorted(hit, starts)
    if narrow and size(narrow[0], narrow[3]) <= size(seq, lengths):
        seq, starts, rules, lengths = narrow
    return seq, starts, np.concatenate(rules).astype(seq.dtype) if rules else np.zeros((0, 2), seq.dtype), lengths[terminals:]


def pack(doc_ids: list[int | None], ids: np.ndarray, starts: np.ndarray, terminals: int) -> bytes:
    seq, at, rules, lengths = compress(ids, starts, terminals)
    head = struct.pack("<6Q", seq.dtype.itemsize, terminals, len(doc_ids), len(rules), len(seq), len(ids))
    nulls = np.array([i is None for i in doc_ids], np.uint8)
    body = MAGIC + head + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + nulls.tobytes() + at.astype("<u4").tobytes() + rules.tobytes() + lengths.astype("<u4").tobytes() + seq.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A payload, opened. ids(k) decodes document k alone; all_ids() every document."""

    def __init__(self, payload: bytes):
        if payload[:8] != MAGIC or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("not a token block, or damaged")
        width, self.terminals, docs, n_rules, symbols, self.tokens = struct.unpack_from("<6Q", payload, 8)
        kind, at = f"<u{width}", 56

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(payload, dtype, n, at)
            at += got.nbytes
            return got

        doc_ids, nulls = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(doc_ids, nulls, strict=True)]
        self.starts = np.append(take("<u4", docs).astype(np.int64), symbols)
        rules = take(kind, 2 * n_rules).reshape(-1, 2)
        self.lengths = np.concatenate([np.ones(self.terminals, np.int64), take("<u4", n_rules).astype(np.int64)])
        self.seq = take(kind, symbols)
        # Each rule's expansion, one after the other: a rule only names symbols before it.
        self.at = np.concatenate([np.arange(self.terminals), self.terminals + np.cumsum(self.lengths[self.terminals :]) - self.lengths[self.terminals :]])
        self.flat = np.empty(self.terminals + int(self.lengths[self.terminals :].sum()), np.uint32)
        self.flat[: self.terminals] = np.arange(self.terminals)
        sides = rules.astype(np.int64).T
        known, left = np.arange(self.terminals + n_rules) < self.terminals, np.arange(n_rules)
        while len(left):  # all rules whose symbols are expanded by now, at once
            ready = known[sides[0, left]] & known[sides[1, left]]
            if not ready.any():
                raise ValueError("rules that name each other")
            rule = left[ready]
            to = self.at[self.terminals + rule]
            for side in sides[:, rule]:
                n = self.lengths[side]
                within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                self.flat[np.repeat(to, n) + within] = self.flat[np.repeat(self.at[side], n) + within]
                to = to + n
            known[self.terminals + rule] = True
            left = left[~ready]

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        n = self.lengths[seq]
        return self.flat[np.repeat(self.at[seq] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def ids(self, k: int) -> np.ndarray:
        return self._expand(self.seq[self.starts[k] : self.starts[k + 1]])

    def all_ids(self) -> list[np.ndarray]:
        n = np.concatenate(([0], np.cumsum(self.lengths[self.seq])))
        return np.split(self._expand(self.seq), n[self.starts[1:-1]])


def write(df: DataFrame, tokenizer_file: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The table of blocks, written to the shared folder and read back: part, block, docs, tokens, payload.

    A null text counts as empty (just the end id). Ids ascend with nulls first; rows that repeat an id are ordered by a
    hash of the text. Ids are integers, others are refused. An empty table gives no blocks; other columns are ignored.
    """
    if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} must be an integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        hold("token_files", encoder.cache_clear)
        words = encoder(tokenizer_file)
        end = array(words.code, [end_id]).tobytes()
        doc_ids, packed, tokens = [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(packed), f"<u{len(end)}")
            n = np.array([len(p) // len(end) for p in packed])
            row = [part, block, len(doc_ids), tokens, pack(doc_ids, ids, np.cumsum(n) - n, words.terminals)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "block", "docs", "tokens", "payload"])

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                ids_of, texts = (c.slice(at, 128).to_pylist() for c in batch.columns)
                for doc_id, ids in zip(ids_of, words.encode([t or "" for t in texts]), strict=True):
                    packed.append(ids + end)
                    doc_ids.append(doc_id)
                    tokens += len(packed[-1]) // len(end)
                    if tokens >= block_tokens:
                        yield close()
                        doc_ids, packed, tokens, block = [], [], 0, block + 1
        if packed:
            yield close()

    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    key, tie = F.col(id_col).asc_nulls_first(), F.xxhash64(text_col)
    placed = bound_batches(df).select(F.col(id_col).cast("long"), text_col).repartitionByRange(parts, key, tie).sortWithinPartitions(key, tie)
    return cut(placed.mapInArrow(run, "part int, block int, docs long, tokens long, payload binary"), "token_blocks")


def read(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start (ids of all documents before), n_tokens, ids_crc32 of each document, decoded from the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, payload in zip(*batch.columns, strict=True):
                block = Block(payload.as_py())
                docs = block.all_ids()
                n = np.array([len(d) for d in docs], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block.doc_ids, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n),
                        pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in docs], pa.int64()),
                        pa.array([part.as_py()] * len(n), pa.int32()), pa.array([number.as_py()] * len(n), pa.int32()),
                    ],
                    [id_col, "at", "n_tokens", "ids_crc32", "part", "block"],
                )

    rows = blocks.select("part", "block", "payload").mapInArrow(run, f"`{id_col}` long, at long, n_tokens long, ids_crc32 long, part int, block int")
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of the writer
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_at"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "block", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("block_at")).join(parts, "part")
    return rows.join(starts, ["part", "block"]).select(id_col, (F.col("part_at") + F.col("block_at") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

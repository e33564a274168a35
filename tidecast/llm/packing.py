"""Packing documents into training sequences along a space-filling curve.

A document's hashed token vector is projected to three numbers, its place on a Hilbert curve through that
cube is the sort key, and documents that are neighbours on the curve share sequences.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import Chunked, Held, Remembered, lasting, mapped, mixed, tasks

DIMENSIONS, BITS = 3, 10
SCALE = 1 << 24  # directions are whole multiples of its inverse
SPREAD = 4.0  # scale of the projected means before they are squashed into the unit cube


class Tokens:
    """Ids of whole texts. Chunks between blanks and line feeds are encoded apart and remembered.

    The tokenizer drops white space, and no rule of it reaches across. It lower-cases letters one by one and
    parts them from marks, so `Word,` has the ids of `word` and of `,` where `word` is made of composed letters
    that stay letters; every other chunk goes through the tokenizer as a whole.
    """

    MARKS = ".,;:!?#$%&*()=+-/\"@"

    def __init__(self, raw: bytes, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.size = self.tokenizer.get_vocab_size(True)
        self.merge = self.tokenizer.model.tokenize
        # the byte-level alphabet: visible Latin-1 bytes stand for themselves, the rest follow from 256 on
        seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = (b for b in range(256) if b not in seen)
        self.letters = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.marks = Remembered(self._whole, 1000)
        self.chunks = Chunked(self._chunks, self._whole, most, " ", marked=False, marks=self.MARKS, same=self._same)

    def _whole(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def _same(words: pa.Array) -> pa.Array:
        return pc.if_else(pc.ascii_is_alpha(words), pc.ascii_lower(words), words)

    def _chunks(self, new: list[str], known: dict) -> None:
        merge, letters, marks = self.merge, self.letters, self.marks
        for chunk in new:
            word = chunk.rstrip(self.MARKS)
            plain = word.isalpha()
            if plain and not word.isascii():
                # letters up to Latin Extended-B, in both cases one composed character each: no dotted capital I
                plain = max(word) < "\u0250" and "\u0130" not in word and unicodedata.is_normalized("NFC", word)
            if not plain:
                known[chunk] = self._whole(chunk)
                continue
            low = word.lower()
            ids = known.get(low)
            if ids is None:  # composed small letters are one piece: straight to the merges
                name = low if low.isascii() else "".join(map(letters.__getitem__, low.encode()))
                ids = known[low] = array("I", [t.id for t in merge(name)]).tobytes()
            if chunk != low:
                known[chunk] = ids if len(word) == len(chunk) else ids + marks[chunk[len(word) :]]

    def encode(self, texts: pa.Array, end: int) -> list[bytes]:
        """Little-endian 32-bit ids of each text, closed by the id `end`."""
        closing = array("I", [end]).tobytes()
        return [ids + closing for ids in self.chunks.encode(texts)]


def tokens_of(held: Held) -> Tokens:
    return lasting("tokens", held, lambda: Tokens(held.raw))


@functools.lru_cache(maxsize=2)
def directions(vocabulary: int) -> np.ndarray:
    """A hashed direction in the cube for every token id."""
    cells = np.arange(vocabulary * DIMENSIONS, dtype=np.uint64) + np.uint64(0x5EED)
    unit = (mixed(mixed(cells)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return ((unit * 2.0 - 1.0) * SCALE).astype(np.int32).reshape(vocabulary, DIMENSIONS)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each row of integer coordinates on the Hilbert curve (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    fix, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        fix = np.where(x[n - 1] & q, fix ^ (q - 1), fix)
        q >>= 1
    x ^= fix
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def curve_keys(ids: np.ndarray, counts: np.ndarray, vocabulary: int, step: int = 1 << 20) -> np.ndarray:
    """Hilbert key of each document's mean direction; `ids` are those of all documents, `counts` of each (at least 1).

    A direction is a whole number, so sums are exact and do not depend on the documents beside it.
    """
    table, sums = directions(vocabulary), np.zeros((len(counts), DIMENSIONS), np.int64)
    ends = np.cumsum(counts)
    low = 0
    while low < len(counts):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - counts[low] + step, "right")))
        first = ends[low:high] - counts[low:high]
        sums[low:high] = np.add.reduceat(table[ids[first[0] : ends[high - 1]]], first - first[0], axis=0, dtype=np.int64)
        low = high
    means = sums / counts[:, None] / SCALE
    cells = np.minimum((np.tanh(means * SPREAD) * 0.5 + 0.5) * (1 << BITS), (1 << BITS) - 1)
    return hilbert(cells.astype(np.int64))


def tokenized(
    docs: DataFrame, vocabulary_path: str, end: int, id_column: str = "doc_id", text: str = "text",
    cuts: np.ndarray = np.zeros(0, np.int64),
) -> DataFrame:
    """(id, place, part, n_tokens, ids); `part` counts the cuts at or below a place.

    `place` is the curve key with a hash of the row below it, which parts equal texts, of one id too.
    """
    held = Held.read(vocabulary_path)

    def run(batches):
        own = tokens_of(held)
        for batch in batches:
            if not batch.num_rows:
                continue
            made = own.encode(batch.column(2), end)
            counts = np.fromiter(map(len, made), np.int64, len(made)) // 4
            ids = np.frombuffer(b"".join(made), np.uint32)
            tie = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            place = curve_keys(ids, counts, max(own.size, end + 1)) << 32 | (tie & 0xFFFFFFFF)
            part = np.searchsorted(cuts, place, side="right").astype(np.int32)
            stored = ids.astype(np.uint16) if own.size <= 65536 else ids
            edges = np.append(0, np.cumsum(counts)) * stored.itemsize
            blobs = pa.Array.from_buffers(
                pa.binary(), len(counts), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(stored)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(place), pa.array(part), pa.array(counts), blobs],
                [id_column, "place", "part", "n_tokens", "ids"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    row = F.xxhash64(id_column, F.monotonically_increasing_id())
    chosen = docs.select(id_column, row.alias("tie"), F.coalesce(F.col(text), F.lit("")).alias(text))
    return chosen.transform(mapped, run, f"`{id_column}` {kind}, place bigint, part int, n_tokens bigint, ids binary")


def borders(sample: DataFrame, parts: int) -> np.ndarray:
    """Places that cut the curve into parts of about equally many tokens; `sample` is bounded by its maker."""
    rows = sorted((r.place, r.n_tokens) for r in sample.select("place", "n_tokens").collect())
    if not rows or parts < 2:
        return np.zeros(0, np.int64)
    places, share = np.array([r[0] for r in rows], np.int64), np.cumsum([r[1] for r in rows], dtype=np.float64)
    cuts = np.searchsorted(share, share[-1] * np.arange(1, parts) / parts)
    return places[np.minimum(cuts, len(places) - 1)]


def cut(batches, width: int, id_column: str, narrow: bool):
    """Fill sequences with the sorted documents of one task; what is left at its end fills powers of two."""
    part, made = TaskContext.get().partitionId(), 0
    open_, used = [], 0  # pieces of the sequence under way

    def finish(pieces, sequence):
        at = 0
        for doc, start, total, ids in pieces:
            yield doc, start, len(ids), total, (part << 40) + sequence, at, ids.tobytes()
            at += len(ids)

    def batch_of(rows):
        names = [id_column, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        kinds = [kind, *[pa.int64()] * 5, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    rows, held, kind = [], 0, None
    for batch in batches:
        kind = batch.schema.field(0).type
        docs, blobs = batch.column(0).to_pylist(), batch.column(1)
        for doc, raw in zip(docs, blobs):
            ids = np.frombuffer(raw.as_buffer(), np.uint16 if narrow else np.uint32).astype("<u4")
            start = 0
            while start < len(ids):
                take = ids[start : start + width - used]
                open_.append((doc, start, len(ids), take))
                start, used = start + len(take), used + len(take)
                if used == width:
                    rows += finish(open_, made)
                    made, held, open_, used = made + 1, held + width, [], 0
                    if held >= 1 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
    while used:
        size, room, now = 1 << (used.bit_length() - 1), 1 << (used.bit_length() - 1), []
        while room:
            doc, start, total, ids = open_.pop(0)
            now.append((doc, start, total, ids[:room]))
            if len(ids) > room:
                open_.insert(0, (doc, start + room, total, ids[room:]))
            room -= len(now[-1][3])
        rows += finish(now, made)
        made, used = made + 1, used - size
    if rows:
        yield batch_of(rows)


def pack(
    docs: DataFrame, vocabulary_path: str, end: int = 2, width: int = 4096,
    id_column: str = "doc_id", text: str = "text", per_part: int = 40,
) -> DataFrame:
    """(id, start, length, doc_tokens, sequence_id, offset, ids): one row per piece, ids as little-endian uint32.

    Every sequence but a task's last is full; the rest of a task is cut into sequences whose lengths are
    powers of two, which need no padding. A null or empty text is one piece that holds `end`. Repeated rows
    are packed each; an empty table gives no rows. A sample of `per_part` documents per part, chosen by
    a hash of the row, only places the borders between tasks; hot groups of equal texts or rows are cut by it.
    """
    spark = docs.sparkSession
    parts = tasks(spark)
    every = max(1, docs.count() // (per_part * parts))
    keyed = docs.select(id_column, text)
    sample = keyed.where(F.pmod(F.xxhash64(F.lit(7), F.monotonically_increasing_id()), F.lit(every)) == 0)
    cuts = borders(tokenized(sample, vocabulary_path, end, id_column, text), parts)
    narrow = tokens_of(Held.read(vocabulary_path)).size <= 65536
    whole = tokenized(keyed, vocabulary_path, end, id_column, text, cuts)
    kind = docs.schema[id_column].dataType.simpleString()
    dealt = whole.repartitionById(len(cuts) + 1, F.col("part"))
    ordered = dealt.sortWithinPartitions("place", id_column).select(id_column, "ids")
    schema = f"`{id_column}` {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return ordered.transform(mapped, lambda b: cut(b, width, id_column, narrow), schema)

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import hashlib
import itertools
import re
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a session without one gets a folder in its warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and outlives executors."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")  # its own shuffle files are of no use once the table is written
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def blob(text: str) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def tasks(spark: SparkSession) -> int:
    """Tasks for a shuffle that is dealt out by this library."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """`mapInArrow` with batches of at most 8 MB: long texts would make a batch of many rows very large.

    The limit is a setting of the session, which is lowered if it is larger.
    """
    conf = df.sparkSession.conf
    plain = re.fullmatch(r"(\d+)b", conf.get(BATCH))
    if plain and not 0 < int(plain[1]) <= BATCH_BYTES:
        conf.set(BATCH, f"{BATCH_BYTES}b")
    return df.mapInArrow(function, schema)


def by_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """A `mapInArrow` function that turns each batch into one batch, and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = make(batch)
                if made is not None and made.num_rows:
                    yield made

    return run


def lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow list column of `counts[i]` values each, over one flat array."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit integers (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word -> 64-bit hash, remembered for at most `most` words at a time."""

    def __init__(self, most: int = 150_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_kept: dict[str, tuple] = {}


def kept(kind: str, key, make: Callable):
    """One value per task: what was made for the last operator goes when the next one asks.

    The package travels by value, so each task has a copy of this module's variables; see `lasting`.
    """
    now = _kept.get(kind)
    if now is None or now[0] != key:
        _kept.clear()
        _process().clear()
        now = _kept[kind] = (key, make())
    return now[1]


def _process() -> dict:
    """A table of the process itself, which all copies of this module share and which does not travel."""
    return sys.modules.setdefault("tidecast_lasting", types.ModuleType("tidecast_lasting")).__dict__.setdefault("values", {})


def lasting(kind: str, key, make: Callable):
    """One value per worker, over all of its tasks: made once, and no old ones wait for the garbage collector.

    A value may hold itself in a cycle, so old ones are collected before another is made, and Arrow gives back
    the memory that it keeps for later batches.
    """
    values = _process()
    now = values.get(kind)
    if now is None or now[0] != key:
        now = None
        values.clear()
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        now = values[kind] = (key, make())
    return now[1]


def word_hashes() -> WordHashes:
    return lasting("words", None, WordHashes)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n neighbouring values; fewer values give none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        total = (total * np.uint64(0x9E3779B97F4A7C15)) + hashes[i : len(hashes) - n + 1 + i]
    return mixed(total)


class Held:
    """File contents that a worker's caches tell apart by their digest."""

    def __init__(self, raw: bytes):
        self.raw, self.digest = raw, hashlib.sha256(raw).hexdigest()

    @classmethod
    def read(cls, path: str) -> Held:
        """Read once by the driver; the contents travel with the task."""
        with open(path, "rb") as file:
            return cls(file.read())

    def __eq__(self, other) -> bool:
        return self.digest == other.digest

    def __hash__(self) -> int:
        return hash(self.digest)


class Remembered(dict):
    """The last `most` values made, and those before them that were needed again."""

    def __init__(self, make, most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key, self)
        if value is self:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class BatchMemory:
    """Values of words, made for a whole batch of texts at a time.

    `make` adds the values of new words to the table that it is given. Words of one batch are fresh until a
    later batch holds them again. Over `most` values the fresh ones go; if those met again are most of them, only
    those of the batch under way stay. So there are at most `most` values and those of one batch.
    """

    def __init__(self, make: Callable[[list, dict], None], most: int):
        self.make, self.most, self.often, self.fresh = make, most, {}, {}

    def of(self, words: list) -> list:
        """The value of each of these words, which are all different."""
        often, fresh, new = self.often, self.fresh, []
        values = list(map(often.get, words, itertools.repeat(self)))
        for i in [i for i, value in enumerate(values) if value is self]:
            word = words[i]
            value = fresh.pop(word, self)
            if value is self:
                new.append(i)
            else:
                often[word] = values[i] = value
        if new:
            self.make([words[i] for i in new], fresh)
            for i in new:
                values[i] = fresh[words[i]]
        if len(often) + len(fresh) > self.most:
            self.fresh = {}
            if len(often) > self.most * 4 // 5:
                self.often = {word: often[word] for word in words if word in often}
        return values


FIRST = "\ue000"  # stands before the first word of a text


def runs(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of n[i] values from start[i], one after the other."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((start - (ends - n)).astype(kind), n)
    at += np.arange(total, dtype=kind)
    return flat[at]


class Chunked:
    """Encodes texts by their words between blanks: each word that a batch holds is encoded once.

    `make(words, table)` puts the ids of words into a table, as bytes of 32-bit numbers, or None where a word
    can't be told apart from its neighbours; texts with such a word, or that `odd` finds, go through `whole`.
    A line feed is replaced by `feed` first. With `marked`, the first word of a text begins with FIRST.
    `marks` behind a digit or a letter of ASCII or Latin-1 are encoded apart from their word, by `whole`; `same`
    gives words in a form that has the same ids.
    """

    PLAIN = np.array([chr(b).isalnum() if b < 128 else False for b in range(256)])

    def __init__(
        self, make, whole: Callable[[str], bytes], most: int, feed: str = "\n", odd: str | None = None, marked: bool = True,
        marks: str = "", same: Callable[[pa.Array], pa.Array] | None = None,
    ):
        self.memory, self.whole, self.feed, self.odd, self.marked = BatchMemory(make, most), whole, feed, odd, marked
        self.marks, self.same, self.tails = marks, same, Remembered(whole, 1000)

    def encode(self, texts: pa.Array, most: int = 4 << 20) -> list:
        """Ids of each text as bytes of 32-bit numbers; no text is null. About `most` bytes go at a time."""
        return list(self.encoded(texts, most))

    def encoded(self, texts: pa.Array, most: int = 4 << 20) -> Iterator[bytes]:
        """The same, of which only those of the bytes under way are held."""
        low = 0
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        while low < len(texts):
            begin = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, begin + most, "right")))
            yield from self._encode(texts.slice(low, high - low))
            low = high

    def _parted(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words without the marks at their ends, and these marks."""
        raw, bodies = np.frombuffer(words.buffers()[2] or b"", np.uint8), pc.utf8_rtrim(words, self.marks)
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset :][1 : len(words) + 1].astype(np.int64)
        size, kept = pc.binary_length(words).to_numpy(), pc.binary_length(bodies).to_numpy()
        at = np.flatnonzero((kept < size) & (kept > 0))
        last = ends[at] - size[at] + kept[at] - 1
        # a letter of Latin-1 is the byte C3 and another; two of these are signs
        before = np.where(kept[at] > 1, raw[last - 1], 0)
        letter = (before == 0xC3) & (raw[last] != 0x97) & (raw[last] != 0xB7)
        cut = np.zeros(len(words), bool)
        cut[at[self.PLAIN[raw[last]] | letter]] = True
        n = np.where(cut, size - kept, 0).astype(np.int64)
        places = np.append(0, np.cumsum(n)).astype(np.int32)
        tails = pa.StringArray.from_buffers(len(words), pa.py_buffer(places), pa.py_buffer(runs(raw, ends - n, n)))
        return pc.if_else(pa.array(cut), bodies, words), tails

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words, one after the other; how many each has; which can't be told apart."""
        bodies, tails = self._parted(words) if self.marks else (words, None)
        named = (self.same(bodies) if self.same else bodies).dictionary_encode()
        values = self.memory.of(named.dictionary.to_numpy(zero_copy_only=False).tolist())
        tied = np.fromiter((v is None for v in values), bool, len(values))
        if tied.any():
            values = [v or b"" for v in values]
        index = named.indices.to_numpy()
        order, tied = index[:, None], tied[index]
        if tails is not None:
            ends = tails.dictionary_encode()
            order = np.column_stack([index, ends.indices.to_numpy() + len(values)])
            values += map(self.tails.__getitem__, ends.dictionary.to_pylist())
        size = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        flat, start, n = np.frombuffer(b"".join(values), np.uint32), np.cumsum(size) - size, size[order]
        return runs(flat, start[order.ravel()], n.ravel()), n.sum(axis=1), tied

    def _encode(self, texts: pa.Array) -> list:
        parts = texts if self.feed == "\n" else pc.replace_substring(texts, "\n", self.feed)
        parts = pc.binary_join_element_wise(FIRST, parts, "") if self.marked else parts
        words = pc.split_pattern(parts, " ")
        edges, named = words.offsets.to_numpy(), words.values.dictionary_encode()
        index, (flat, size, tied) = named.indices.to_numpy(), self._ids(named.dictionary)
        n = size[index]
        raw = runs(flat, (np.cumsum(size) - size)[index], n).tobytes()
        places = np.append(0, np.cumsum(n) * 4)[edges].tolist()
        made = [raw[a:b] for a, b in zip(places, places[1:])]
        alone = np.diff(np.append(0, np.cumsum(tied[index]))[edges]) > 0
        if self.odd:
            alone |= pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(alone).tolist():
            made[i] = self.whole(texts[i].as_py())
        return made

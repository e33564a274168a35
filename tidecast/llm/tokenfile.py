"""Token files: ids of whole documents, bit-packed to the width that the vocabulary needs.

A file is a run of blocks and a directory. A block holds whole documents:

    header     8 little-endian 64-bit numbers: magic, bits, documents, ids, documents and ids of the file before it, 0, 0
    documents  their ids (64 bits each), then where each ends among the block's ids (64 bits each)
    ids        `bits` bits each, low bit first, without gaps, to a whole number of bytes

After each block, and after the directory, stands one line feed. The directory has three 64-bit numbers a block
(byte, documents, ids before it), and ends with its number of blocks, the file's documents, its ids, and
magic. So the i-th document or id of a file is found by two binary searches, and read alone.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.llm.common import FIRST, Chunked, Held, Remembered, lasting, mapped, shared_folder, stored, tasks

MAGIC = int.from_bytes(b"tokbits1", "little")
HEADER = 64


def width(vocabulary: int) -> int:
    """Bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """Ids as runs of `bits` bits, low bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpacked(raw, bits: int, low: int, high: int) -> np.ndarray:
    """Ids low to high (excluded) of packed ones; only their own bytes are read."""
    n = high - low
    if n <= 0:
        return np.zeros(0, np.uint32)
    if bits == 16:
        return np.frombuffer(raw, "<u2", n, low * 2).astype(np.uint32)
    first, last = low * bits // 8, -(-high * bits // 8)
    own = np.frombuffer(raw, np.uint8, last - first, first)
    padded = np.zeros(len(own) + 8, np.uint8)
    padded[: len(own)] = own
    at = np.arange(n, dtype=np.int64) * bits + low * bits - first * 8
    # an id lies within 8 bytes from its first one (up to 32 bits, shifted by up to 7)
    wide = np.zeros(n, np.uint64)
    for i in range((bits + 14) // 8):
        wide |= padded[(at >> 3) + i].astype(np.uint64) << np.uint64(8 * i)
    return ((wide >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """Bytes of one file, block by block; a block closes at `most` ids and never cuts a document."""

    def __init__(self, bits: int, most: int = 1 << 17):
        self.bits, self.most = bits, most
        self.docs, self.parts, self.held = [], [], 0
        self.directory, self.at, self.n_docs, self.n_ids = [], 0, 0, 0

    def add(self, doc: int, ids: np.ndarray) -> bytes | None:
        """One more document; the bytes of a block if it closes one."""
        self.docs.append(doc)
        self.parts.append(ids)
        self.held += len(ids)
        return self.block() if self.held >= self.most else None

    def block(self) -> bytes | None:
        if not self.docs:
            return None
        sizes = np.array([len(x) for x in self.parts], np.int64)
        head = np.array([MAGIC, self.bits, len(sizes), self.held, self.n_docs, self.n_ids, 0, 0], "<i8")
        made = b"".join([
            head.tobytes(), np.array(self.docs, "<i8").tobytes(), np.cumsum(sizes).astype("<i8").tobytes(),
            packed(np.concatenate(self.parts), self.bits),
        ])
        self.directory.append((self.at, self.n_docs, self.n_ids))
        self.at, self.n_docs, self.n_ids = self.at + len(made) + 1, self.n_docs + len(sizes), self.n_ids + self.held
        self.docs, self.parts, self.held = [], [], 0
        return made

    def close(self) -> bytes:
        """The directory; `block` comes before it."""
        end = np.array([len(self.directory), self.n_docs, self.n_ids, MAGIC], "<i8")
        return np.array(self.directory, "<i8").tobytes() + end.tobytes()


class File:
    """Random access into the bytes of one file."""

    def __init__(self, raw):
        self.raw = memoryview(raw)
        n, self.n_docs, self.n_ids, magic = np.frombuffer(self.raw, "<i8", 4, len(self.raw) - 33).tolist()
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = len(self.raw) - 33 - 24 * n
        self.bytes, self.docs_before, self.ids_before = np.frombuffer(self.raw, "<i8", 3 * n, at).reshape(n, 3).T

    def _block(self, i: int) -> tuple[int, np.ndarray, np.ndarray, memoryview]:
        at = int(self.bytes[i])
        magic, bits, docs, ids = np.frombuffer(self.raw, "<i8", 4, at).tolist()
        if magic != MAGIC:
            raise ValueError("not a block of a token file")
        names = np.frombuffer(self.raw, "<i8", docs, at + HEADER)
        ends = np.frombuffer(self.raw, "<i8", docs, at + HEADER + 8 * docs)
        low = at + HEADER + 16 * docs
        return bits, names, ends, self.raw[low : low + -(-ids * bits // 8)]

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids low to high (excluded) of the whole file."""
        low, high = max(0, low), min(high, self.n_ids)
        made, i = [], int(np.searchsorted(self.ids_before, low, "right")) - 1
        while low < high:
            bits, _, ends, raw = self._block(i)
            before = int(self.ids_before[i])
            stop = min(high, before + int(ends[-1]))
            made.append(unpacked(raw, bits, low - before, stop - before))
            low, i = stop, i + 1
        return np.concatenate(made) if made else np.zeros(0, np.uint32)

    def document(self, i: int) -> tuple[int, int, np.ndarray]:
        """The i-th document: its id, the ids of the file before it, its own ids."""
        block = int(np.searchsorted(self.docs_before, i, "right")) - 1
        bits, names, ends, raw = self._block(block)
        j = i - int(self.docs_before[block])
        low = int(ends[j - 1]) if j else 0
        return int(names[j]), int(self.ids_before[block]) + low, unpacked(raw, bits, low, int(ends[j]))

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per block: document ids, where each starts in the file, its length, and all ids of the block."""
        for i in range(len(self.bytes)):
            bits, names, ends, raw = self._block(i)
            starts = np.append(0, ends[:-1])
            yield names, starts + self.ids_before[i], ends - starts, unpacked(raw, bits, 0, int(ends[-1]))


class Tokens:
    """Ids of whole texts by the tokenizers library; what stands between white space is encoded apart and remembered.

    The pattern cuts a run of white space before its last sign, and that sign opens the next piece if it is a
    blank, else it is a piece of its own. A blank with letters is one piece, and marks behind it another,
    so these go to the merges without a search for pieces. Texts that may hold added tokens go whole.
    """

    MARKS = ".,;:!?"
    SPACE = re.compile(r"(\s+)")
    RUNS = re.compile(" ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+")  # pieces of printable ASCII without apostrophes
    ODD = f"<[|]|[\x1c-\x1f{FIRST}]"  # added tokens, signs that not every library takes for white space, FIRST itself

    def __init__(self, raw: bytes, most: int = 120_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.size = self.tokenizer.get_vocab_size(True)
        self.merge = self.tokenizer.model.tokenize
        # the byte-level alphabet: visible Latin-1 bytes stand for themselves, the rest follow from 256 on
        seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = (b for b in range(256) if b not in seen)
        self.letters = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.ends = Remembered(self.whole, 1000)
        self.chunks = Chunked(self._chunks, self.spaced, most, " \n", self.ODD, marks=self.MARKS)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        return self.chunks.encoded(texts, 2 << 20)

    def _chunks(self, new: list[str], known: dict) -> None:
        """Ids of words behind a blank, a line feed or nothing."""
        merge, letters, marks, ends, feed = self.merge, self.letters, self.MARKS, self.ends, self.ends["\n"]
        runs = self.RUNS.findall
        for word in new:
            before = word[:1]
            inner = word[1:] if before == "\n" or before == FIRST else word
            bare = inner.rstrip(marks)
            if bare.isalpha() and (bare.isascii() or max(bare) < "\u0250"):
                name = bare if bare.isascii() else "".join(map(letters.__getitem__, bare.encode()))
                ids = array("I", [t.id for t in merge(name if inner is not word else "\u0120" + name)]).tobytes()
                if len(bare) < len(inner):
                    ids += ends[inner[len(bare) :]]
            elif not inner or inner[0].isspace() or inner[-1].isspace():
                known[word] = None
                continue
            elif inner.isascii() and inner.isprintable() and "'" not in inner:
                pieces = runs(inner if inner is not word else " " + word)
                ids = b"".join([array("I", [t.id for t in merge(x.replace(" ", "\u0120"))]).tobytes() for x in pieces])
            else:
                ids = self.whole(inner if inner is not word else " " + word)
            known[word] = feed + ids if before == "\n" else ids

    def spaced(self, text: str) -> bytes:
        """Ids of a text with any white space between its words."""
        if re.search(self.ODD, text):
            return self.whole(text)
        first, *rest = self.SPACE.split(text)
        made, words = [self.whole(first)] if first else [], []
        for space, word in zip(rest[::2], rest[1::2]):
            if not word:  # at the end nothing is cut off
                words.append(space)
            else:
                words += [space[:-1], (FIRST if space[-1] != " " else "") + word, space[-1]]
        wanted = {w for w in words if w and not w.isspace()}
        known = dict(zip(wanted, self.chunks.memory.of(list(wanted))))
        for space, word in zip(rest[::2], rest[1::2]):
            if not word:
                made.append(self.ends[space])
                continue
            if len(space) > 1:
                made.append(self.ends[space[:-1]])
            made += [known[word]] if space[-1] == " " else [self.ends[space[-1]], known[FIRST + word]]
        return b"".join(made)


def tokens_of(held: Held) -> Tokens:
    return lasting("token files", held, lambda: Tokens(held.raw))


def write(
    docs: DataFrame, vocabulary_path: str, path: str | None = None, end: int = 2, id_column: str = "doc_id", text: str = "text",
    block: int = 1 << 17, part_bytes: int = 64 << 20, blocks: int = 8,
) -> str:
    """Encode whole texts, close each with the id `end`, and write token files in ascending id order; returns their folder.

    Files are named by their place in that order. A task has about `part_bytes` of text, and a file at most `blocks`
    blocks, which keeps it small: Spark holds a file several times over while it is read. Ids of documents are
    integers; a null id is kept as the smallest 64-bit number, so it comes first. A null text is empty and holds
    `end` alone; repeated rows are documents each, rows of one id stand by hash and length of their text; an
    empty table makes a folder without documents.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tokens/{uuid.uuid4().hex}"
    held = Held.read(vocabulary_path)
    bits = width(max(tokens_of(held).size, end + 1))

    def run(batches):
        own, writer, closing = tokens_of(held), Writer(bits, block), np.array([end], np.uint32).tobytes()
        one = lambda made: pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["bytes"])
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1))):
                made = writer.add(doc, np.frombuffer(ids + closing, np.uint32))
                if made:
                    yield one(made)
                if len(writer.directory) == blocks:
                    yield one(writer.close())
                    writer = Writer(bits, block)
        last = writer.block()
        if last:
            yield one(last)
        if writer.n_docs:
            yield one(writer.close())

    key = F.coalesce(F.col(id_column).cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    rows = docs.select(key.alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumns({"size": F.length("text"), "tie": F.xxhash64("text")})
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(tasks(spark), -(-size // part_bytes))
    # the last key parts rows that are alike in all others: a group of copies is spread over tasks
    dealt = rows.repartitionByRange(parts, "id", "size", "tie", F.monotonically_increasing_id())
    ordered = dealt.sortWithinPartitions("id", "size", "tie").select("id", "text")
    made = ordered.transform(mapped, run, "bytes binary")
    value = F.col("bytes").cast("string").alias("value")
    made.select(value).write.option("maxRecordsPerFile", blocks + 1).text(path)  # with the directory
    return path


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the token files of a folder."""
    found = spark.read.format("binaryFile").load(f"{path}/part-*")
    return found.where(F.col("length") > 33).select("path", "content")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_docs, n_ids, docs_before, ids_before): one row per file, in the order of the folder."""

    def run(batches):
        for batch in batches:
            own = [File(x.as_buffer()) for x in batch.column(1)]
            n = [pa.array([getattr(x, name) for x in own], pa.int64()) for name in ("n_docs", "n_ids")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *n], ["path", "n_docs", "n_ids"])

    return _placed(files(spark, path).transform(mapped, run, "path string, n_docs bigint, n_ids bigint"))


def _placed(rows: DataFrame) -> DataFrame:
    """Documents and ids of all files before each one, by the numbers of task and file in their names."""
    numbers = [F.regexp_extract("path", f"{sign}(\\d+)[^/]*$", 1).cast("int") for sign in ("part-", "-c")]
    before = Window.orderBy(*numbers).rowsBetween(Window.unboundedPreceding, -1)  # one small row per file
    return rows.withColumns({
        f"{x}_before": F.coalesce(F.sum(f"n_{x}").over(before), F.lit(0).cast("bigint")) for x in ("docs", "ids")
    })


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document; `start` counts the ids of all files before it.

    `ids` are little-endian unsigned 32-bit numbers, their crc32 is unsigned. Without them the rows are small: they
    are stored, and the files are opened once.
    """
    names = ["path", "doc_id", "at", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for docs, starts, sizes, ids in File(content.as_buffer()).documents():
                    raw, at = ids.astype("<u4").tobytes(), np.append(0, np.cumsum(sizes) * 4).tolist()
                    own = [raw[a:b] for a, b in zip(at, at[1:])]
                    columns = [
                        pa.array([name] * len(own)), pa.array(docs, mask=docs == -(1 << 63)), pa.array(starts), pa.array(sizes),
                        pa.array(map(zlib.crc32, own), pa.int64()), *[pa.array(own, pa.binary())] * with_ids,
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "path string, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    rows = files(spark, path).transform(mapped, run, kinds)
    if with_ids:
        totals = directory(spark, path)
    else:
        rows = stored(rows)
        totals = _placed(rows.groupBy("path").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids")))
    placed = rows.join(totals.select("path", "ids_before"), "path")
    return placed.select("doc_id", (F.col("ids_before") + F.col("at")).alias("start"), *names[3:])

"""Removal of passages that a document with a smaller id also holds, by a compressed index per shard.

Equal windows pick the same word run in them as their anchor: the leftmost of the runs with the smallest
hash. Neighbouring windows with one anchor form a context. Contexts meet by anchor, and anchors that only
one document has are left behind, so what is indexed is the repeated part of the corpus. Equal contexts are
one. A shard holds whole anchors, indexes their contexts (see `fmindex`) and streams them through the
index: from `window` matching words on, the interval of the backward search names the smallest document.
An anchor with more contexts than `crowd` would fill its shard alone; its windows are compared one by one
through their hashes instead, in an aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import blob, by_batch, grams, lists, mapped, mixed, stored, word_hashes
from tidecast.llm.fmindex import Index

GRAM = 16
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value in every run of `width` values."""
    best, at = values, np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        left, right = slice(0, len(best) - step), slice(step, None)
        first = best[left] <= best[right]
        best, at = np.where(first, best[left], best[right]), np.where(first, at[left], at[right])
        span += step
    return at


def powers(factor: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))


def spans_of(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of the word runs [start, start + length); equal runs have equal hashes wherever they stand."""
    up = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers(FACTOR, len(hashes)), dtype=np.uint64)])
    back = powers(INVERSE, len(hashes) + 1)
    return mixed((up[starts + lengths] - up[starts]) * back[starts] + lengths.astype(np.uint64))


def contexts_of(hashes: np.ndarray, window: int):
    """(anchor, content, start, n): runs of n neighbouring windows that share an anchor."""
    n = len(hashes) - window + 1
    if n < 1:
        return None
    runs = grams(hashes, GRAM)
    anchor = least_of(runs, window - GRAM + 1)
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    counts = np.diff(np.concatenate([starts, [n]]))
    return runs[anchor[starts]], spans_of(hashes, starts, counts + window - 1), starts, counts


def contexts(rows: DataFrame, window: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        made, owner = [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            found = contexts_of(word_hashes().of(text.split()), window)
            if found is not None:
                made.append(found)
                owner.append(np.full(len(found[2]), i))
        if not made:
            return None
        anchor, content, start, n = (np.concatenate(x) for x in zip(*made))
        owner = pa.array(np.concatenate(owner))
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(owner),
             batch.column(1).take(owner), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
            ["anchor", "content", "row", "doc", "start", "n"],
        )

    return rows.transform(mapped, by_batch(run), "anchor bigint, content bigint, row bigint, doc bigint, start int, n int")


def words_of(wanted: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """(anchor, content, doc, crowded, n, words, windows): word hashes of a context, or its windows' hashes."""

    def run(batches):
        for batch in batches:
            out = []
            for text, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = word_hashes().of(text.split())
                for e in entries:
                    start, n, words, windows = e["start"], e["n"], None, None
                    if e["crowded"]:
                        at = np.arange(start, start + n)
                        own = hashes[start : start + n + window - 1]
                        windows = spans_of(own, at - start, np.full(n, window)).view(np.int64).tolist()
                    else:
                        words = hashes[start : start + n + window - 1].tobytes()
                    out.append((e["anchor"], e["content"], e["doc"], e["crowded"], n, words, windows))
                if len(out) > 5000:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.list_(pa.int64())]

    def made(out):
        names = ["anchor", "content", "doc", "crowded", "n", "words", "windows"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    entries = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "content", "doc", "start", "n", "crowded")).alias("entries"))
    one_each = rows.select("row", "words").join(entries, "row").dropDuplicates(["row"])
    return one_each.select("words", "entries").transform(
        mapped, run, "anchor bigint, content bigint, doc bigint, crowded boolean, n int, words binary, windows array<bigint>"
    )


def indexed(plain: DataFrame, shards: int, window: int) -> DataFrame:
    """(anchor, content, owners): per window of a context the smallest document that holds it."""

    def run(table: pa.Table) -> pa.Table:
        sequences = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("words").combine_chunks()]
        owners = Index(sequences, table.column("doc").to_numpy(), window).least_owners()
        flat = np.concatenate(owners)
        return pa.table({
            "anchor": table.column("anchor"), "content": table.column("content"),
            "owners": lists(flat, np.array([len(x) for x in owners])),
        })

    sharded = plain.select("anchor", "content", "doc", "words", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    return sharded.groupBy("shard").applyInArrow(run, "anchor bigint, content bigint, owners array<bigint>")


def compared(crowded: DataFrame) -> DataFrame:
    """The same for contexts of crowded anchors, window by window."""
    each = crowded.select("anchor", "content", "doc", F.posexplode("windows").alias("i", "window"))
    least = each.groupBy("window").agg(F.min("doc").alias("owner"))
    back = each.select("anchor", "content", "i", "window").join(least, "window")
    listed = back.groupBy("anchor", "content").agg(F.sort_array(F.collect_list(F.struct("i", "owner"))).alias("o"))
    return listed.select("anchor", "content", F.col("o.owner").alias("owners"))


def remove(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = 50,
    crowd: int = 2000, shard_words: int = 200_000,
) -> DataFrame:
    """`docs` with `text` cleaned and two more columns, `_n_words` and `_n_removed`.

    Words are runs of bytes other than ASCII white space. A word goes if a window of `window` words covers
    it whose words also start in a document with a smaller id, judged on the input. Texts that lose words
    are joined by one blank; others stay as they are, null stays null (no words). Rows without an id are
    neither compared nor cut. Rows that repeat an id do not count as another document, so both lose the
    same words. All rows and all other columns stay; an empty table stays empty.
    """
    rows = docs.select(
        F.xxhash64(id_column, text).alias("row"), F.col(id_column).cast("long").alias("doc"), blob(text).alias("words")
    )
    runs = stored(contexts(rows.where("doc IS NOT NULL"), window))
    unique = runs.groupBy("anchor", "content").agg(
        F.min("doc").alias("doc"), F.max("doc").alias("last"), F.min(F.struct("doc", "row", "start")).alias("rep"), F.min("n").alias("n"),
    )
    unique = stored(unique.select("anchor", "content", "doc", "last", F.col("rep.row").alias("row"), F.col("rep.start").alias("start"), "n"))
    shared = unique.groupBy("anchor").agg(
        F.min("doc").alias("lo"), F.max("last").alias("hi"), (F.count("*") > crowd).alias("crowded")
    ).where("lo < hi").select("anchor", "crowded")
    found = stored(words_of(unique.join(shared, "anchor"), rows, window))
    size = found.agg(F.sum(F.length("words") / 8)).first()[0] or 0
    owners = stored(
        indexed(found.where("NOT crowded"), 1 + int(size // shard_words), window).union(compared(found.where("crowded")))
    )
    flagged = runs.join(owners, ["anchor", "content"]).select(
        "row", F.col("start"), F.transform("owners", lambda o: o < F.col("doc")).alias("gone")
    ).where(F.exists("gone", lambda g: g))
    cuts = stored(flagged.groupBy("row").agg(F.collect_set(F.struct("start", "gone")).alias("cuts")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, sizes, removed = [], [], []
        for value, cuts_ in zip(batch.column(-2).to_pylist(), batch.column(-1).to_pylist()):
            words = (value or b"").split()
            cover = np.zeros(len(words) + 1, np.int64)
            for cut in cuts_ or ():
                at = cut["start"] + np.flatnonzero(cut["gone"])
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            count = int(gone.sum())
            if count:
                value = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
            texts.append(value)
            sizes.append(len(words))
            removed.append(count)
        names = [*batch.schema.names[:-2], text, "_n_words", "_n_removed"]
        made = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], names)

    others = [c for c in docs.columns if c != text]
    joined = docs.withColumns({"_row": F.xxhash64(id_column, text), "_words": F.col(text).cast("binary")})
    joined = joined.join(cuts.withColumnRenamed("row", "_row"), "_row", "left").select(*others, "_words", "cuts")
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]
    made = joined.transform(mapped, by_batch(run), ", ".join([*kinds, f"`{text}` string", "_n_words bigint", "_n_removed bigint"]))
    return made.select(*docs.columns, "_n_words", "_n_removed")

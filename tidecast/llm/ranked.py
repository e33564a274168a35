"""Ranked lexical search: all documents against a stated set of items, by masks of matched terms.

Documents are cut into blocks that keep, per term, only what the items can match. In a block each term has a
bitmap of its documents; the bitmaps of an item's terms, read across, give every document its presence mask.
Documents with equal masks are one group with one highest possible score: the sum of the best contributions
of the mask's terms in the block. Groups are scored from the highest possible score down, until the
next one lies below the score that the last of the best documents has for certain.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import WordHashes, kept, lists, mapped, mixed, stored, tasks

# Bytes of terms: A-Z become small, digits, small letters and all bytes of other characters stay, the rest parts terms.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 0x80 else 32 for b in range(256))
FILTER_BITS = 23  # a bit table of 1 MB says which terms can belong to an item; its false alarms match no item
LAST = np.iinfo(np.int64).max  # stands for a null id: it comes after all others


def term_counts(text: str) -> Counter:
    return Counter(text.encode("utf-8", "replace").translate(TERMS).split())


def hashed(words) -> np.ndarray:
    return kept("terms", None, lambda: WordHashes(200_000)).of(list(words))


def places(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def item_terms(items: DataFrame, id_column: str, text: str) -> DataFrame:
    """(item_id, term, n): hashed terms of each item with their repeats; texts of one id are pooled, repeated rows count once."""

    def run(batches):
        for batch in batches:
            counts = [term_counts(x or "") for x in batch.column(1).to_pylist()]
            sizes = np.array([len(c) for c in counts], np.int64)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            terms = np.concatenate([hashed(c) for c in counts]).view(np.int64) if len(counts) else np.zeros(0, np.int64)
            n = np.fromiter((k for c in counts for k in c.values()), np.int64, len(terms))
            yield pa.RecordBatch.from_arrays([ids, pa.array(terms), pa.array(n)], ["item_id", "term", "n"])

    rows = items.select(F.col(id_column).alias("item_id"), F.col(text).alias("text")).distinct()
    kind = items.schema[id_column].dataType.simpleString()
    terms = rows.transform(mapped, run, f"item_id {kind}, term bigint, n bigint")
    return terms.groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def bit_table(terms: DataFrame) -> np.ndarray:
    """The bits of all terms, as rows of 62 bits at most 1 MB together whatever the number of terms."""

    def run(batches):
        for batch in batches:
            at = places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(at)], ["at"])

    bits = terms.select("term").transform(mapped, run, "at bigint")
    words = bits.groupBy(F.expr("at div 62").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 62 as int))")).alias("bits"))
    table = np.zeros(1 << FILTER_BITS, bool)
    for row in words.collect():
        held = np.arange(62)[(np.int64(row.bits) >> np.arange(62)) & 1 == 1]
        table[row.word * 62 + held] = True
    return np.packbits(table)


def blocks_of(docs: DataFrame, table: np.ndarray, id_column: str, text: str, most: int) -> DataFrame:
    """Blocks of documents: (docs, lengths, sizes, terms, counts), the last two as flat lists over documents.

    A document without terms is left out. A block has at most `most` documents.
    """
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        bits = sent.value
        for whole in batches:
            for batch in (whole.slice(i, most) for i in range(0, whole.num_rows, most)):
                ids, lengths, terms, counts = [], [], [], []
                for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = term_counts(value) if value else None
                    if not found:
                        continue
                    own = hashed(found)
                    at = places(own)
                    held = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                    n = np.fromiter(found.values(), np.int64, len(own))
                    ids.append(LAST if key is None else key)
                    lengths.append(int(n.sum()))
                    terms.append(own[held])
                    counts.append(n[held])
                if ids:
                    sizes = np.array([len(x) for x in terms], np.int64)
                    flat, n = np.concatenate(terms).view(np.int64), np.concatenate(counts)
                    one = lambda values: lists(np.asarray(values, np.int64), np.array([len(values)]))
                    columns = [one(ids), one(lengths), one(sizes), one(flat), one(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["docs", "lengths", "sizes", "terms", "counts"])

    chosen = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text"))
    names = ("docs", "lengths", "sizes", "terms", "counts")
    return chosen.transform(mapped, run, ", ".join(f"{x} array<bigint>" for x in names))


class Block:
    """One block of documents against items: contributions and bitmaps by term."""

    def __init__(self, row: dict, vocabulary: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.docs, lengths = row["docs"], row["lengths"]
        doc = np.repeat(np.arange(len(self.docs)), row["sizes"])
        at = np.minimum(np.searchsorted(vocabulary, row["terms"]), len(vocabulary) - 1)
        held = vocabulary[at] == row["terms"]
        doc, term, tf = doc[held], at[held], row["counts"][held]
        order = np.argsort(term, kind="stable")
        self.doc, term, tf = doc[order], term[order], tf[order]
        m = 75 + (25 * lengths * n_docs) // n_terms
        self.worth = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[self.doc]))
        self.edges = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        self.best = np.zeros(len(vocabulary), np.int64)
        np.maximum.at(self.best, term, self.worth)
        present = np.zeros((len(vocabulary), len(self.docs)), bool)
        present[term, self.doc] = True
        self.bitmaps = np.packbits(present, axis=1)

    def masks(self, terms: np.ndarray) -> np.ndarray:
        """Presence mask of each document as a row of 64-bit words, one bit per term."""
        across = np.packbits(np.unpackbits(self.bitmaps[terms], axis=1, count=len(self.docs)), axis=0, bitorder="little")
        wide = np.zeros((len(self.docs), -(-len(terms) // 64) * 8), np.uint8)
        wide[:, : len(across)] = across.T
        return wide.view("<u8")

    def scores(self, docs: np.ndarray, terms: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """Exact scores of some documents, given in ascending order."""
        total = np.zeros(len(docs), np.int64)
        for term, n in zip(terms.tolist(), repeats.tolist()):
            low, high = self.edges[term], self.edges[term + 1]
            if low < high:
                at = low + np.minimum(np.searchsorted(self.doc[low:high], docs), high - low - 1)
                total += np.where(self.doc[at] == docs, n * self.worth[at], 0)
        return total

    def top(self, terms: np.ndarray, repeats: np.ndarray, best: tuple[np.ndarray, np.ndarray], floor: int, k: int, step: int = 64):
        """The k best of `best` (scores, ids) and this block; nothing below `floor` is needed."""
        masks = self.masks(terms)
        if masks.shape[1] == 1:
            groups, of = np.unique(masks[:, 0], return_inverse=True)
            groups = groups.reshape(-1, 1)
        else:
            groups, of = np.unique(masks, axis=0, return_inverse=True)
        bits = np.unpackbits(np.ascontiguousarray(groups).view(np.uint8), axis=1, bitorder="little", count=len(terms))
        highest = bits.astype(np.int64) @ (repeats * self.best[terms])
        order = np.argsort(-highest, kind="stable")
        members = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=len(groups)))
        scores, ids = best
        at = 0
        while at < len(order):
            need = max(floor, int(scores[k - 1]) if len(scores) >= k else 1, 1)
            chosen, n = [], 0
            while at < len(order) and n < step and highest[order[at]] >= need:  # an equal score may have a smaller id
                g = order[at]
                chosen.append(members[ends[g - 1] if g else 0 : ends[g]])
                n += len(chosen[-1])
                at += 1
            if not chosen:
                break
            docs = np.sort(np.concatenate(chosen))
            new = self.scores(docs, terms, repeats)
            good = new >= need
            scores, ids = np.append(scores, new[good]), np.append(ids, self.docs[docs[good]])
            first = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[first], ids[first]
        return scores, ids


def searched(blocks: DataFrame, groups: DataFrame, n_docs: int, n_terms: int, k: int, small: bool) -> DataFrame:
    """(item, doc_id, score): per task and item the k best; `groups` are blocks of items with their floors.

    Items that are known to be `small` are sent to every task; else blocks of documents and copies of the
    items are dealt by a salt.
    """
    salts = 1 if small else tasks(blocks.sparkSession)
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = blocks.withColumn("salt", F.pmod(F.xxhash64("docs"), F.lit(salts)).cast("int"))
    pairs = keyed.join(F.broadcast(spread) if small else spread.hint("merge"), "salt").drop("salt")
    names = pairs.columns

    def run(batches):
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def emptied():
            sizes = [len(x[0]) for x in found.values()]
            item = np.repeat(np.fromiter(found, np.int64, len(found)), sizes)
            scores, ids = (np.concatenate([x[i] for x in found.values()]) for i in (0, 1))
            found.clear()
            columns = [pa.array(item), pa.array(ids, mask=ids == LAST), pa.array(scores)]
            return pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {x: batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j, x in enumerate(names)}
                vocabulary, at = np.unique(row["item_terms"], return_index=True)
                block = Block(row, vocabulary, row["weights"][at], n_docs, n_terms)
                own = np.searchsorted(vocabulary, row["item_terms"])
                ends = np.cumsum(row["item_sizes"])
                for j, item in enumerate(row["items"].tolist()):
                    part = slice(ends[j] - row["item_sizes"][j], ends[j])
                    best = block.top(own[part], row["repeats"][part], found.get(item, none), int(row["floors"][j]), k)
                    if len(best[0]):
                        found[item] = best
                if len(found) >= 1 << 16:
                    yield emptied()
        if found:
            yield emptied()

    return pairs.transform(mapped, run, "item bigint, doc_id bigint, score bigint")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k first rows of each item: (item, rank, doc_id, score)."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_column: str = "doc_id", text: str = "text",
    item_column: str = "item_id", item_text: str = "text", block: int = 4096, item_block: int = 256, sampled: int = 64,
    broadcast_bytes: int = 8 << 20,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents with the highest score above 0, equal ones by id.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased; a text's terms are told
    apart by 64-bit hashes. Ids of documents are integers. A null or empty text has no terms and is no document;
    a null id comes after all others; rows that repeat an id are documents of their own. Repeated rows of
    `items` count once, texts of one item id are pooled, an item without terms or matches has no rows.

    About `sampled` blocks are searched first: an item's k-th score there is a floor that every later block
    may skip below. Items travel in blocks of `item_block`: to every task if all their terms, which are counted
    first, take at most `broadcast_bytes`, else dealt by a salt, as blocks of documents are.
    """
    terms = stored(item_terms(items, item_column, item_text))
    small = 40 * terms.count() <= broadcast_bytes
    table = bit_table(terms.select("term").distinct())
    blocks = stored(blocks_of(docs, table, id_column, text, block))
    length = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    total = blocks.agg(
        F.count("*").alias("blocks"), F.sum(F.size("docs")).alias("docs"), F.sum(length).alias("terms")
    ).first()
    n_docs, n_terms = int(total["docs"] or 0), int(total["terms"] or 1)
    held = blocks.select(F.explode("terms").alias("term")).join(terms.select("term").distinct(), "term")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0)))
    weighed = terms.join(df, "term").withColumn("weight", weight)
    of_item = F.struct("term", "n", "weight")
    made = weighed.groupBy("item_id").agg(F.sort_array(F.collect_list(of_item)).alias("terms"))
    numbered = stored(made.withColumn("item", F.monotonically_increasing_id()))
    groups = max(1, -(-numbered.count() // item_block))

    def grouped(floors: DataFrame | None) -> DataFrame:
        """Items in blocks, dealt by hash, of about `item_block` items each."""
        rows = numbered.withColumn("floor", F.lit(1).cast("bigint"))
        if floors is not None:
            rows = numbered.join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("bigint")))
        each = F.struct("item", "floor", "terms")
        own = rows.groupBy(F.pmod(F.xxhash64("item"), F.lit(groups)).alias("group")).agg(F.sort_array(F.collect_list(each)).alias("own"))
        flat = lambda name: F.flatten(F.transform("own", lambda x: x["terms"][name]))
        return own.select(
            F.col("own.item").alias("items"), F.col("own.floor").alias("floors"),
            F.transform("own", lambda x: F.size(x["terms"]).cast("bigint")).alias("item_sizes"),
            flat("term").alias("item_terms"), flat("n").alias("repeats"), flat("weight").alias("weights"),
        )

    every = max(1, int(total["blocks"]) // sampled)
    some = blocks.where(F.pmod(F.xxhash64("docs", F.lit(5)), F.lit(every)) == 0)
    first = best_of(searched(some, grouped(None), n_docs, n_terms, k, small), k)
    floors = stored(first.where(F.col("rank") == k).select("item", F.col("score").alias("floor")))
    found = best_of(searched(blocks, grouped(floors), n_docs, n_terms, k, small), k)
    return found.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")

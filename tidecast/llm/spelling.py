"""Spelling variants: words of a corpus that lie one edit apart, and the frequent form each one leads to.

The vocabulary is sorted, and neighbours in that order share prefixes. The rows of the banded edit matrix
between a word and a prefix hold for all words below that prefix, so each row is computed once per longest
common prefix (LCP) and reused by the words that share it; a range of the list whose shared prefix is
already more than one edit away is left as a whole.

Two words one edit apart, the shorter with m code points, agree in their first m // 2 code points or in
their last ones. So each word is listed by the start of its text and by the start of its reversed text, once
per length m that a pair with it can have, and lists meet no words beyond their own start.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import mapped, stored, tasks

# A-Z become small, small letters and U+00C0 to U+00FF stay, all else parts words (Latin-1 bytes).
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
PAD = 3  # zero bytes after each word: the band reads at most so far beyond it


def seen(text: str, start: int, least: int, every: int) -> Iterator[tuple[bytes, int]]:
    """(word, count) of one text as Latin-1 bytes; `start` is the crc32 of what stands before each word."""
    for word, n in Counter(text.encode("latin-1", "replace").translate(LETTERS).split(b" ")).items():
        if len(word) >= least:
            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
            if h % every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < least:
                    continue
            yield word, n


def counted(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = 5, every: int = 97, most: int = 300_000
) -> DataFrame:
    """(word, n) over whole texts, words of at least `least` code points.

    A run of letters whose crc32 (of `<id>:<run>`) is divisible by `every` loses one code point. Counts are
    summed per task in a table of at most `most` words before they are shuffled. A null text has no words, a
    null id counts as an empty one, repeated rows count each.
    """

    def run(batches):
        total: Counter = Counter()

        def emptied():
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            made = pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in seen(value or "", zlib.crc32(f"{key}:".encode()), least, every):
                    total[word] += n
                if len(total) >= most:
                    yield emptied()
        if total:
            yield emptied()

    chosen = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    parts = chosen.transform(mapped, run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def common_prefixes(flat: np.ndarray, start: np.ndarray, size: np.ndarray, border: np.ndarray) -> np.ndarray:
    """LCP of each row with the row before it; -1 where `border` says that they do not belong together."""
    lcp = np.full(len(start), -1, np.int64)
    live = np.flatnonzero(~border)
    lcp[live] = 0
    d = 0
    while len(live):
        same = flat[start[live] + d] == flat[start[live - 1] + d]
        live = live[same & (size[live] > d) & (size[live - 1] > d)]
        d += 1
        lcp[live] = d
    return lcp


def one_edit(
    flat: np.ndarray, start: np.ndarray, size: np.ndarray, lcp: np.ndarray, queries: np.ndarray,
    low: np.ndarray, high: np.ndarray, depth: int,
) -> tuple[np.ndarray, np.ndarray]:
    """(query row, list row) of words at most one edit apart.

    Rows low[i]:high[i] are the sorted list that query i meets; all of it shares the query's first `depth`
    code points. A range of list rows with a common prefix has one band: edit distances between that prefix
    and the query's prefixes that are one shorter, as long and one longer.
    """
    found_q, found_w = [], []
    q, p0, p1, p2 = queries, *(np.full(len(queries), x, np.int8) for x in (1, 0, 1))
    if not len(q):
        return q, q
    base, end, d = int(low.min()), int(high.max()), depth
    cuts = lcp[base:end]
    low, high = low - base, high - base
    while len(q):
        border = cuts <= d
        border[0] = True
        child = np.cumsum(border) - 1  # runs of rows that share d + 1 code points
        first = np.flatnonzero(border)
        last = np.append(first[1:], len(cuts))
        n = child[high - 1] - child[low] + 1
        of = np.repeat(np.arange(len(q)), n)
        run = np.repeat(child[low] - (np.cumsum(n) - n), n) + np.arange(len(of))
        row = first[run] + base
        longer = size[row] > d  # a word that ends here was met one step before
        of, run, row = of[longer], run[longer], row[longer]
        letter, q = flat[start[row] + d], q[of]
        at = start[q] + d
        b0, b1, b2 = p0[of], p1[of], p2[of]
        p0 = np.minimum(b0 + (flat[at - 1] != letter), b1 + 1)
        p1 = np.minimum(np.minimum(b1 + (flat[at] != letter), b2 + 1), p0 + 1)
        p2 = np.minimum(b2 + (flat[at + 1] != letter), p1 + 1)
        d += 1
        close = np.minimum(np.minimum(p0, p1), p2) <= 1
        q, p0, p1, p2, row, run = q[close], p0[close], p1[close], p2[close], row[close], run[close]
        low, high = first[run], last[run]
        more = size[q] - d
        whole = (size[row] == d) & (np.abs(more) <= 1) & (row != q)
        whole &= np.where(more < 0, p0, np.where(more > 0, p2, p1)) <= 1
        found_q.append(q[whole])
        found_w.append(row[whole])
    return np.concatenate(found_q), np.concatenate(found_w)


def starts_alike(flat, start, size, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Do two reversed words agree in the first n code points of what they spell?"""
    alike = np.ones(len(a), bool)
    for j in range(int(n.max(initial=0))):
        x, y = flat[start[a] + size[a] - 1 - j], flat[start[b] + size[b] - 1 - j]
        alike &= (x == y) | (j >= n)
    return alike


def meet(group: np.ndarray, back: np.ndarray, m: np.ndarray, own: np.ndarray, texts: list[str], n: np.ndarray, again: int, block: int):
    """Per row from `again` on with near words in its group's list: (row, their number, row of the first by n and spelling)."""
    raw = ("\0" * PAD).join(["", *texts, ""]).encode("latin-1")
    flat, size = np.frombuffer(raw, np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size + PAD) - size
    fresh = np.append(True, group[1:] != group[:-1])
    of = np.cumsum(fresh) - 1
    low = np.flatnonzero(fresh)
    listed = np.add.reduceat(own.astype(np.int64), low)  # a group's list stands before its other queries
    lcp = common_prefixes(flat, start, size, fresh | ~own)
    depth = m // 2
    pairs = []
    for d in np.unique(depth).tolist():
        rows = again + np.flatnonzero((depth[again:] == d) & (listed[of[again:]] > 0))
        for i in range(0, len(rows), block):
            part = rows[i : i + block]
            pairs.append(one_edit(flat, start, size, lcp, part, low[of[part]], low[of[part]] + listed[of[part]], d))
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*pairs))
    right = np.minimum(size[a], size[b]) == m[a]  # else the pair belongs to another length
    a, b = a[right], b[right]
    twice = back[a]  # reversed lists leave pairs to the plain ones, where these hold them
    twice[twice] = starts_alike(flat, start, size, a[twice], b[twice], depth[a[twice]])
    a, b = a[~twice], b[~twice]
    rank = np.arange(len(texts))
    if back.any():
        words = [x[::-1] if r else x for x, r in zip(texts, back.tolist())]
        rank[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(texts))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    rows, first, count = np.unique(a, return_index=True, return_counts=True)
    return rows, count, b[first]


def near(words: DataFrame, least: int = 5, slice_rows: int = 50_000, chunk: int = 32_768, block: int = 8192) -> DataFrame:
    """(word, n, n_near, best): words with their number of near words and the first of them, (n, word).

    `words` is (word, n) with distinct words. A start that more than `slice_rows` list rows share is cut
    into slices by hash; its words then meet each slice, so no task holds more of a list than a slice.
    """
    spelled = F.struct(F.lit(False).alias("back"), F.col("word").alias("text"))
    turned = F.struct(F.lit(True).alias("back"), F.reverse("word").alias("text"))
    length = F.length("word")
    rows = words.where(length >= least).select(
        "word", "n", F.explode(F.filter(F.array(length, length - 1), lambda m: m >= least)).alias("m")
    )
    rows = rows.select("word", "n", "m", F.explode(F.array(spelled, turned)).alias("side"))
    rows = rows.select("word", "n", "m", "side.back", "side.text", F.expr("substring(side.text, 1, m div 2)").alias("opening"))
    key = ["back", "m", "opening"]
    crowded = rows.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > slice_rows)
    rows = rows.join(crowded.withColumn("slices", F.ceil(F.col("size") / slice_rows)).drop("size"), key, "left")
    slices = F.coalesce("slices", F.lit(1))
    rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), slices) == F.col("slice"))
    dealt = rows.repartition(tasks(words.sparkSession), *key, "slice")
    order = ["back", "m", "opening", "slice", F.col("own").desc(), "text"]
    lists = dealt.sortWithinPartitions(*order).select(F.xxhash64(*key, "slice").alias("g"), "back", "m", "own", "text", "n")

    def run(batches):
        for part, again in chunks(batches, chunk):
            column = lambda i: part.column(i).to_numpy(zero_copy_only=False)
            texts, back, n = part.column(4).to_pylist(), column(1).astype(bool), column(5)
            args = (column(0), back, column(2).astype(np.int64), column(3).astype(bool), texts, n, again, block)
            rows, count, best = meet(*args)
            spell = lambda i: texts[i][::-1] if back[i] else texts[i]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(map(spell, rows.tolist()), pa.string()), pa.array(count, pa.int64()),
                    pa.array(n[best], pa.int64()), pa.array(map(spell, best.tolist()), pa.string()),
                ],
                ["word", "n_near", "best_n", "best"],
            )

    found = lists.transform(mapped, run, "word string, n_near bigint, best_n bigint, best string")
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    both = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast(found_type()).alias("first"))
    both = both.unionByName(found.select("word", F.lit(None).cast("bigint").alias("n"), "n_near", best.alias("first")))
    return both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("first").alias("first")).select(
        "word", "n", "n_near", F.struct((-F.col("first.less")).alias("n"), F.col("first.word").alias("word")).alias("best")
    )


def found_type() -> str:
    return "struct<less:bigint,word:string>"


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, int]]:
    """Sorted rows in pieces of whole groups. A longer group is cut behind its list, which every piece of it
    gets; the number says how many leading rows are such a list whose words were queries before."""
    held, again = None, 0
    for batch in batches:
        fresh = pa.Table.from_batches([batch])
        held = fresh if held is None else pa.concat_tables([held, fresh])
        if held.num_rows < most:
            continue
        group = held.column(0).to_numpy()
        borders = np.flatnonzero(group[1:] != group[:-1]) + 1
        if len(borders):
            yield held.slice(0, borders[-1]).combine_chunks(), again
            held, again = held.slice(borders[-1]), 0
            continue
        listed = int(held.column(3).to_numpy(zero_copy_only=False).sum())
        if held.num_rows >= max(most, 2 * listed) + again:
            yield held.combine_chunks(), again
            held, again = held.slice(0, listed), listed
    if held is not None and held.num_rows > again:
        yield held.combine_chunks(), again


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root): `forms` is (word, form) without nulls; a form is more frequent, so there are no cycles.

    Roots double their distance in every round; a chain is no longer than the binary logarithm of the
    largest count, so a few rounds do. Rounds are written tables.
    """
    now = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(further, "root", "left")
        now = stored(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return now.select("word", "root")


def variants(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = 5, often: int = 3, times: int = 2, every: int = 97
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words that occur at least `often` times.

    A word's form is its near word with the largest n (ties: the first in code-point order) if that is at
    least `times` the word's own; forms lead to the root. Empty tables give no rows; see `counted` for nulls.
    """
    words = stored(counted(docs, id_column, text, least, every).where(F.col("n") >= often))
    has: Column = F.col("best.n") >= times * F.col("n")
    made = stored(near(words, least).select(
        "word", "n", "n_near", F.when(has, F.col("best.word")).alias("form"), F.when(has, F.col("best.n")).alias("form_n")
    ))
    roots = rooted(made.where("form is not null").select("word", "form"))
    return made.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

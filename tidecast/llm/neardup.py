"""Near-duplicate groups by an LSH forest over MinHash signatures.

Documents with the same shingle set are one class from the start. A class has `MINIMA` minima of 16 bits.
A tree sorts all classes by `DEPTH` minima of its own, so classes whose keys share a long prefix stand
side by side. A region is a run of classes that share a prefix of at least `LEAST` minima; its depth
adapts: a region of more than `CROWD` classes is cut one minimum deeper, again and again. In a region that
is small enough all classes are candidates of each other, and neighbours in sorted order always are. The
signatures drop candidates that are clearly too far apart, and the rest is confirmed on full sets unless
confirmed links already connect the two.

Classes in regions that were too crowded to compare all with all get a second search, a prefix join: two
linked sets share one of their first shingles, in any order of the shingles, here from rare to common ones.
Lists of classes with such a shingle in common are compared with their most typical member first, and what
is still apart in a list then is compared all with all, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import blob, by_batch, grams, mapped, mixed, stored, tasks, word_hashes
from tidecast.llm.components import some_components

TREES, MINIMA, DEPTH, LEAST, CROWD, NEAR = 16, 96, 16, 2, 6, 2
BUCKETS, BLOCK = 1 << 17, 512  # counters of shingles by hash; classes of a list that are compared together
SLACK = 7.0  # standard deviations by which an estimate may lie below the threshold: a true pair does once in 1e9


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of word runs; a shorter text is one run, a text without words none."""
    own = word_hashes().of(text.lower().split())
    if not len(own):
        return np.zeros(0, np.uint64)
    return np.unique(grams(own, min(words, len(own))))


def minima(joined: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The low 16 bits of `MINIMA` minima of each run of `joined`, as (runs, MINIMA)."""
    values = (joined >> np.uint64(32)).astype(np.uint32)
    seeds = mixed(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64)).astype(np.uint32)
    out = np.empty((len(starts), MINIMA), np.uint16)
    for i in range(MINIMA):
        drawn = values * (seeds[2 * i] | np.uint32(1))
        drawn ^= drawn >> np.uint32(15)
        drawn *= seeds[2 * i + 1] | np.uint32(1)
        out[:, i] = np.minimum.reduceat(drawn ^ (drawn >> np.uint32(16)), starts)
    return out


def signatures(docs: DataFrame, id_column: str, text: str, words: int, keep: list[str]) -> DataFrame:
    """(id, kept columns, n_shingles, key_1, key_2, signature); the keys name the set, signature is null without words."""

    def run(batches):
        for batch in batches:
            sizes, keys, made = [], [], []
            texts, at = batch.column(batch.num_columns - 1).to_pylist(), 0
            while at < len(texts):
                sets, held = [], 0
                while at < len(texts) and held < 500_000:
                    sets.append(shingles(texts[at], words))
                    held, at = held + len(sets[-1]), at + 1
                keys += zip(*(x.tolist() for x in set_keys(sets)))
                filled = [x for x in sets if len(x)]
                flat = iter(minima(np.concatenate(filled), np.cumsum([len(x) for x in filled]) - [len(x) for x in filled]) if filled else ())
                for x in sets:
                    sizes.append(len(x))
                    made.append(next(flat).tobytes() if len(x) else None)
            first, second = zip(*keys)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(x, pa.int64()) for x in (sizes, first, second)), pa.array(made, pa.binary())],
                [*own, "n_shingles", "key_1", "key_2", "signature"],
            )

    own = [id_column, *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own)
    return docs.select(*own, blob(text)).transform(
        mapped, run, f"{kinds}, n_shingles bigint, key_1 bigint, key_2 bigint, signature binary"
    )


def neighbours(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of places in one sorted block of keys (rows of `DEPTH` minima)."""
    n = len(keys)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    differs = keys[1:] != keys[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), keys.shape[1])
    crowd = np.zeros((keys.shape[1] + 1, n), np.int32)  # size of the region of each depth around a place
    for depth in range(LEAST, keys.shape[1] + 1):
        border = np.flatnonzero(np.concatenate([[True], shared < depth, [True]]))
        crowd[depth] = np.repeat(np.diff(border), np.diff(border))
    left, right, low = [], [], shared
    for step in range(1, min(CROWD, n)):
        if step > 1:
            low = np.minimum(low[:-1], shared[step - 1 :])
        at = np.flatnonzero(low >= LEAST)
        if step > NEAR:
            at = at[crowd[low[at], at] <= CROWD]
        left.append(at)
        right.append(at + step)
    return np.concatenate(left), np.concatenate(right)


def crowded(keys: np.ndarray) -> np.ndarray:
    """Whether the region of a place has more than `CROWD` classes, or reaches an end of the block."""
    alike = (keys[1:, :LEAST] == keys[:-1, :LEAST]).all(axis=1)
    sizes = np.diff(np.flatnonzero(np.concatenate([[True], ~alike, [True]])))
    large = sizes > CROWD
    large[[0, -1]] = True
    return np.repeat(large, sizes)


def forest(nodes: DataFrame) -> DataFrame:
    """(a, b, chained) with a <= b: candidates of all trees; chained if neighbours in the first tree.

    A row with a = b says that the class has a place in a crowded region, where candidates are missing.
    """

    def keys_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(1)])
        offsets = np.arange(TREES) * (MINIMA // TREES)
        places = (offsets[:, None] + np.arange(DEPTH)[None, :]) % MINIMA
        keys = flat[:, places].byteswap().reshape(-1, DEPTH)  # big-endian bytes sort like the numbers
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(flat))),
                pa.array([x.tobytes() for x in keys], pa.binary()),
                pa.array(np.repeat(batch.column(0).to_numpy(), TREES)),
            ],
            ["tree", "key", "node"],
        )

    def pairs_of(batches):
        held: list[tuple[int, bytes, int]] = []

        def paired(rows):
            trees = np.array([r[0] for r in rows], np.int64)
            keys = np.frombuffer(b"".join(r[1] for r in rows), np.uint16).reshape(len(rows), DEPTH)
            nodes_ = np.array([r[2] for r in rows], np.int64)
            a, b = neighbours(keys)
            good = trees[a] == trees[b]
            a, b = a[good], b[good]
            x, y, many = nodes_[a], nodes_[b], np.unique(nodes_[crowded(keys)])
            chained = (trees[a] == 0) & (b - a == 1) & (x != y)
            x, y, chained = (np.concatenate(z) for z in ((x, many), (y, many), (chained, np.zeros(len(many), bool))))
            good = np.arange(len(x)) >= len(x) - len(many)
            good |= x != y
            return pa.RecordBatch.from_arrays(
                [pa.array(z[good]) for z in (np.minimum(x, y), np.maximum(x, y), chained)], ["a", "b", "chained"],
            )

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            if len(held) > 200_000:
                yield paired(held)
                held = held[-CROWD:]
        if held:
            yield paired(held)

    spark = nodes.sparkSession
    keyed = nodes.select("node", "signature").transform(mapped, by_batch(keys_of), "tree int, key binary, node bigint")
    ordered = keyed.repartitionByRange(tasks(spark), "tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    pairs = ordered.transform(mapped, pairs_of, "a bigint, b bigint, chained boolean")
    return pairs.groupBy("a", "b").agg(F.max("chained").alias("chained"))


def estimated(pairs: DataFrame, nodes: DataFrame, floor: float) -> DataFrame:
    """Pairs whose signatures agree on at least a share of `floor`, with that share."""
    sides = [nodes.select(F.col("node").alias(x), F.col("signature").alias(f"sign_{x}")) for x in "ab"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = (
            np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(i)]) for i in (3, 4)
        )
        share = (left == right).mean(axis=1)
        made = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(share)], ["a", "b", "chained", "share"])
        return made.filter(pa.array(share >= floor))

    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "chained", "sign_a", "sign_b")
    return joined.transform(mapped, by_batch(run), "a bigint, b bigint, chained boolean, share double")


MARKS = 1 << 23


def marked(ids: DataFrame) -> np.ndarray:
    """A fixed 1 MB of bits with the hashed ids set; the driver reads 131,072 words at most."""
    words = ids.selectExpr(f"pmod(xxhash64(id), {MARKS}L) AS b").groupBy(F.expr("shiftright(b, 6) AS word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(b % 64 AS int))) AS bits")
    ).toArrow()
    bits = np.zeros(MARKS // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(bits.view(np.uint8), bitorder="little")


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that name each set of shingles; 0 for an empty one."""
    filled = np.array([len(x) > 0 for x in sets], bool)
    keys = np.zeros((2, len(sets)), np.int64)
    if filled.any():
        full = [x for x in sets if len(x)]
        scattered = mixed(np.concatenate(full))
        starts = np.cumsum([len(x) for x in full]) - [len(x) for x in full]
        keys[0, filled] = np.add.reduceat(scattered, starts).view(np.int64)
        keys[1, filled] = np.bitwise_xor.reduceat(mixed(scattered), starts).view(np.int64)
    return keys[0], keys[1]


def node_of(row_id: Column, repeated: Column) -> Column:
    """Number of a class by the smallest id it stands under: the id, or a hash with the set if the id has several texts."""
    return F.when(repeated, F.xxhash64(row_id, "key_1", "key_2")).otherwise(row_id)


def shingle_sets(docs: DataFrame, id_column: str, text: str, words: int, ids: DataFrame, repeated: DataFrame) -> DataFrame:
    """(node, shingles) of the documents under `ids`, and of some others whose hashed ids are marked too.

    The marks keep most texts out of what follows; where very many documents are near copies they keep out
    less, and nothing else changes. Texts are read and hashed once for all that comes after.
    """
    # sent once to each executor, not with every plan that holds this function
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(marked(ids)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        at, marks = batch.column(2).to_numpy(), sent.value
        batch = batch.filter(pa.array((marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
        if not batch.num_rows:
            return None
        sets = [shingles(x, words) for x in batch.column(1).to_pylist()]
        columns = [batch.column(0), *map(pa.array, set_keys(sets)), pa.array([x.tobytes() for x in sets], pa.binary())]
        made = pa.RecordBatch.from_arrays(columns, ["id", "key_1", "key_2", "shingles"])
        return made.filter(pa.array([len(x) > 0 for x in sets]))  # an id may also stand on a text without words

    known = docs.select(F.col(id_column).cast("long").alias("id"), blob(text).alias("words")).where("id IS NOT NULL")
    chosen = known.withColumn("mark", F.pmod(F.xxhash64("id"), F.lit(MARKS)))
    made = chosen.transform(mapped, by_batch(run), "id bigint, key_1 bigint, key_2 bigint, shingles binary")
    flagged = made.join(repeated.withColumn("again", F.lit(True)), "id", "left")
    return flagged.select(node_of(F.col("id"), F.col("again")).alias("node"), "shingles").dropDuplicates(["node"])


def rarity(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket of shingles its rank from rare to common and the logarithm of its count.

    The driver reads `BUCKETS` counters at most. Shingles that share a bucket have a common count; the order
    is then less good, but any order finds the same links.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
        counts = np.bincount((flat & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "rows"])

    counted = sets.select("shingles").transform(mapped, by_batch(run), "bucket bigint, rows bigint")
    found = counted.groupBy("bucket").agg(F.sum("rows").alias("rows")).toArrow()
    counts = np.ones(BUCKETS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("rows").to_numpy()
    rank = np.unique(counts, return_inverse=True)[1].reshape(-1)
    return (rank * 65535 // max(1, rank.max())).astype(np.uint16), np.log(counts).astype(np.float32)


def first_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(shingle, place, node, n, typical): of each set so many of its rarest shingles that linked sets share one.

    Sets of n shingles can only be linked if they share percent * n / 100, so one is among the first
    n - ceil(percent * n / 100) + 1 of both. `place` counts them from 0; `typical` is the mean logarithm of the counts of all its shingles.
    """
    sent = sets.sparkSession.sparkContext.broadcast(rarity(sets))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ranks, logs = sent.value
        own_sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
        first, counts, means = [], [], []
        for own in own_sets:
            buckets = (own & np.uint64(BUCKETS - 1)).astype(np.int64)
            order = np.argsort(ranks[buckets], kind="stable")  # equal ranks stay in the order of their hashes
            first.append(own[order[: len(own) + (-percent * len(own)) // 100 + 1]] if len(own) else own)
            counts.append(len(first[-1]))
            means.append(float(logs[buckets].mean()) if len(own) else 0.0)
        sizes = np.array([len(own) for own in own_sets], np.int64)
        places = np.concatenate([np.arange(count) for count in counts])
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate(first).view(np.int64)), pa.array(places), pa.array(np.repeat(batch.column(0).to_numpy(), counts)),
            pa.array(np.repeat(sizes, counts)), pa.array(np.repeat(np.array(means), counts)),
        ], ["shingle", "place", "node", "n", "typical"])

    schema = "shingle bigint, place bigint, node bigint, n bigint, typical double"
    return sets.select("node", "shingles").transform(mapped, by_batch(run), schema)


def open_lists(firsts: DataFrame, crowd: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (shingle, place, node, n, typical, root) and lists (shingle, rows, pivot): lists in more than one component."""
    own = crowd.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    members = firsts.join(own, "node")
    lists = members.groupBy("shingle").agg(
        F.count("*").alias("rows"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.max(F.struct("typical", -F.col("node"), "n", "root")).alias("pivot"),
    ).where("low <> high")
    pivot = F.struct((-F.col("pivot")["col2"]).alias("node"), F.col("pivot")["n"].alias("n"), F.col("pivot")["root"].alias("root"))
    return members, lists.select("shingle", "rows", pivot.alias("pivot"))


def with_pivots(members: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """(a, b, chained): members of a list and its most typical one, as far as sizes allow a link."""
    far = members.join(lists, "shingle").where("root <> pivot.root").where(
        f"100 * least(n, pivot.n) >= {percent} * greatest(n, pivot.n)"
    )
    return far.select(
        F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b"), F.lit(False).alias("chained")
    ).distinct()


def apart(members: DataFrame, lists: DataFrame, nodes: DataFrame, percent: int, floor: float) -> DataFrame:
    """(a, b, chained, share): members of one list in different components whose signatures agree on `floor`.

    A list is dealt to blocks of about `BLOCK` members, and each two blocks meet in one place. Where the list
    is that of the first shingle two sets share, they share no more than what follows its places in them.
    """

    def compared(columns):
        shingle, i, j, block, node, root, n, place, signs = columns
        out, at = [], np.arange(len(node))
        for step in range(1, len(node)):
            at = at[at < len(node) - step]
            to = at + step
            at = at[(shingle[at] == shingle[to]) & (i[at] == i[to]) & (j[at] == j[to])]
            if not len(at):
                break
            a, b = at, at + step
            good = (root[a] != root[b]) & ((i[a] == j[a]) | (block[a] != block[b]))
            good &= (100 + percent) * np.minimum(n[a] - place[a], n[b] - place[b]) >= percent * (n[a] + n[b])
            a, b = a[good], b[good]
            if len(a):
                share = (signs[a] == signs[b]).mean(axis=1)
                good = share >= floor
                a, b = node[a[good]], node[b[good]]
                out.append((np.minimum(a, b), np.maximum(a, b), share[good]))
        if not out:
            return None
        a, b, share = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), pa.array(np.zeros(len(a), bool)), pa.array(share)], ["a", "b", "chained", "share"]
        )

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy() for k in range(8)]
            new.append(np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint16).reshape(-1, MINIMA))
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            key = np.stack(held[:3])
            border = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
            if len(border):
                cut = border[-1] + 1
                made, held = compared([x[:cut] for x in held]), [x[cut:] for x in held]
                if made is not None:
                    yield made
        if held is not None:
            made = compared(held)
            if made is not None:
                yield made

    blocks = F.ceil(F.col("rows") / BLOCK).cast("long")
    own = members.join(lists.select("shingle", blocks.alias("blocks")), "shingle").withColumn(
        "block", F.expr("pmod(xxhash64(node), blocks)")
    )
    met = own.join(nodes.select("node", "signature"), "node").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "shingle", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root",
        "n", "place", "signature",
    )
    dealt = met.repartition(tasks(nodes.sparkSession), "shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    found = dealt.transform(mapped, run, "a bigint, b bigint, chained boolean, share double")
    return found.groupBy("a", "b").agg(F.max("chained").alias("chained"), F.max("share").alias("share"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, y, a, b) those whose sets a and b are linked: 100 * intersection >= percent * union."""
    sides = [sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        linked = []
        for left, right in zip(batch.column(2), batch.column(3)):
            left, right = (np.frombuffer(x.as_buffer(), np.uint64) for x in (left, right))
            both = len(left) + len(right)
            common = both - len(np.unique(np.concatenate([left, right])))
            linked.append(100 * common >= percent * (both - common))
        made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"])
        return made.filter(pa.array(linked))

    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("x", "y", "set_a", "set_b")
    return joined.transform(mapped, by_batch(run), "x bigint, y bigint")


def rooted(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs with the components x and y of their ends, as far as these differ."""
    if roots is None:
        return pairs.withColumns({"x": F.col("a"), "y": F.col("b")})
    for end, own in (("x", "a"), ("y", "b")):
        named = roots.select(F.col("node").alias(own), F.col("root").alias(end))
        pairs = pairs.join(named, own, "left").withColumn(end, F.coalesce(end, own))
    return pairs.where("x <> y")


def groups(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 3, percent: int = 85,
    keep: list[str] | None = None,
) -> DataFrame:
    """(id, columns `keep`, n_shingles, component_id, kept) per row of `docs`.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. A text with fewer words
    than a shingle has is one shingle; null texts and texts without words have none and link with nothing.
    `component_id` is the smallest id that links reach, `kept` marks it. Ids are whole numbers; rows
    that repeat an id and a text fall into one component, an id on several texts is in the component of each of
    them, row by row, and rows without an id have a null component and are kept. Other columns are ignored; an
    empty table gives no rows.
    """
    signed = stored(signatures(docs, id_column, text, words, keep or []))
    keys = ["n_shingles", "key_1", "key_2"]
    row_id = F.col(id_column).cast("long")
    classes = signed.where(F.col("signature").isNotNull() & row_id.isNotNull())
    many = classes.groupBy(row_id.alias("id")).agg(F.min(F.struct(*keys)).alias("low"), F.max(F.struct(*keys)).alias("high"))
    repeated = stored(many.where("low <> high").select("id"))
    first = Window.partitionBy(*keys).orderBy(id_column)
    picked = classes.withColumn("_row", F.row_number().over(first)).where("_row = 1").select(row_id.alias("id"), *keys, "signature")
    flagged = picked.join(repeated.withColumn("again", F.lit(True)), "id", "left")
    nodes = stored(flagged.select(node_of(F.col("id"), F.col("again")).alias("node"), "id", *keys, "signature"))
    share = percent / 100
    floor = share - SLACK * (share * (1 - share) / MINIMA) ** 0.5
    candidates = stored(estimated(forest(nodes), nodes, floor))
    pairs, crowd = candidates.where("a < b"), candidates.where("a = b").select(F.col("a").alias("node")).distinct()

    # neighbours in the first tree, then the best pair of any two components, then every pair that is left
    best = Window.partitionBy(F.least("x", "y"), F.greatest("x", "y")).orderBy(F.desc("share"), "a", "b")
    chained, single, every = (
        lambda p: p.where("chained"),
        lambda p: p.withColumn("_row", F.row_number().over(best)).where("_row = 1"),
        lambda p: p,
    )

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(crowd).distinct()
    sets = stored(shingle_sets(docs, id_column, text, words, ends.join(nodes, "node").select("id"), repeated))

    def joined(roots, pairs, picks):
        if pairs.isEmpty():  # a round without links leaves the components as they are, and costs no plans
            return roots
        for pick in picks:
            open_ = pick(rooted(pairs, roots)).select("x", "y", "a", "b")
            found = some_components(confirmed(open_, sets, percent))
            if roots is None:
                roots = found
            elif found is not None:
                moved = found.select(F.col("node").alias("root"), F.col("root").alias("to"))
                kept = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
                roots = stored(kept.union(found.join(roots, "node", "left_anti").select("node", "root")))
        return roots

    roots = joined(None, pairs, (chained, single, every))
    if roots is None:
        roots = nodes.select("node", F.col("node").alias("root")).limit(0)
    if not crowd.isEmpty():
        firsts = stored(first_shingles(sets, percent))
        typical = stored(estimated(with_pivots(*open_lists(firsts, crowd, roots), percent), nodes, floor))
        roots = joined(roots, typical, (every,))
        left = stored(apart(*open_lists(firsts, crowd, roots), nodes, percent, floor))
        roots = joined(roots, left, (single, every))

    placed_nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed_nodes.groupBy("root").agg(F.min("id").alias("component_id"))
    component = placed_nodes.join(least, "root").select(*keys, "component_id")
    placed = signed.select(id_column, *(keep or []), *keys, F.col("signature").isNotNull().alias("_filled")).join(component, keys, "left")
    named = F.when(F.col("_filled"), F.col("component_id")).otherwise(F.col(id_column).cast("long"))
    named = F.when(F.col(id_column).isNotNull(), named)
    return placed.select(
        id_column, *(keep or []), "n_shingles", named.alias("component_id"), F.coalesce(named == F.col(id_column), F.lit(True)).alias("kept")
    )

"""Toxicity scores from a factorization machine over hashed terms.

Terms are words and the first letters of words, each counted once per text and hashed to a bucket. The
score is a bias, a weight per bucket and, for every pair of buckets, the inner product of their factors:
an insult together with the mention of a group can weigh more than both do alone. Weights and factors are
learned with per-coordinate step sizes and an L1 pull, so buckets that carry nothing end at zero and drop out.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import Held, Remembered, blob, by_batch, lasting, lists, mapped, stored

BUCKETS = 1 << 22
LETTERS = 4  # length of the prefix terms
FACTORS = 4
LEAST_ROWS, LEAST_Z, COMMON = 4, 5.0, 0.02  # what a bucket needs to enter the machine
MARKS = bytes(b for b in range(128) if not chr(b).isalnum() and b not in b" \t\n\r\x0b\x0c")


def terms(word: bytes) -> tuple[int, ...]:
    """Buckets of a lower-cased word: the word without marks, and its first letters."""
    whole = word.translate(None, MARKS)
    if not whole:
        return ()
    start = whole[: LETTERS * 4].decode("utf-8", "ignore")[:LETTERS].encode()
    return tuple(
        int.from_bytes(hashlib.blake2b(kind + value, digest_size=4).digest(), "little") % BUCKETS
        for kind, value in ((b"w", whole), (b"p", start))
    )


def known_terms() -> Remembered:
    return lasting("terms", None, lambda: Remembered(terms, 60_000))


def buckets(text: bytes) -> np.ndarray:
    """Sorted distinct buckets of a whole text."""
    known = known_terms()
    return np.array(sorted({b for word in set(text.lower().split()) for b in known[word]}), np.int32)


class Machine:
    """A fitted machine over the buckets that kept a weight or factors."""

    def __init__(self, bias: float, names: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.names, self.weights, self.factors = bias, names, weights, factors

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probability per row of places in `names`."""
        out = np.full(len(rows), self.bias)
        for i, at in enumerate(rows):
            if len(at):
                own = self.factors[at]
                total = own.sum(axis=0)
                out[i] += self.weights[at].sum() + 0.5 * float((total * total - (own * own).sum(axis=0)).sum())
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def fit(
    rows: list[np.ndarray], labels: np.ndarray, least_rows: int = LEAST_ROWS, least_z: float = LEAST_Z, common: float = COMMON,
    epochs: int = 15, batch: int = 256, step: float = 0.5, pull: float = 0.01, seed: int = 7,
) -> Machine:
    """Learn from rows of buckets and 0/1 labels; without both labels the machine is its bias alone.

    Buckets enter if their labels differ from the rest by `least_z` standard deviations, or if they are in a
    share `common` of the rows: those can matter together with others though not alone.
    """
    total = int(labels.sum())
    prior = (total + 0.5) / (len(labels) + 1.0)
    empty = Machine(float(np.log(prior / (1 - prior))), np.zeros(0, np.int32), np.zeros(0), np.zeros((0, FACTORS)))
    if not 0 < total < len(labels):
        return empty
    names, counts = np.unique(np.concatenate(rows), return_counts=True)
    own, times = np.unique(np.concatenate([row for row, y in zip(rows, labels) if y]), return_counts=True)
    bad = np.zeros(len(names))
    bad[np.searchsorted(names, own)] = times
    z = np.abs(bad - counts * prior) / np.sqrt(counts * prior * (1 - prior))
    names = names[(counts >= least_rows) & ((z >= least_z) | (counts >= common * len(rows)))]
    if not len(names):
        return empty
    places = []
    for row in rows:
        at = np.searchsorted(names, row)
        row, at = row[at < len(names)], at[at < len(names)]
        places.append(at[names[at] == row].astype(np.int32))
    rng = np.random.default_rng(seed)
    n = len(names)
    weights, factors = np.zeros(n), rng.normal(0, 0.02, (n, FACTORS))
    sum_w, sum_v, bias, sum_b = np.full(n, 1e-3), np.full((n, FACTORS), 1e-3), empty.bias, 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), batch):
            chosen = [places[i] for i in order[begin : begin + batch]]
            y = labels[order[begin : begin + batch]]
            sizes = np.array([len(x) for x in chosen])
            flat = np.concatenate(chosen)
            owner = np.repeat(np.arange(len(chosen)), sizes)
            touched, at = np.unique(flat, return_inverse=True)
            w, v = weights[touched], factors[touched]
            sums = np.stack([np.bincount(owner, v[at, f], len(chosen)) for f in range(FACTORS)], axis=1)
            squares = np.bincount(owner, (v * v).sum(axis=1)[at], len(chosen))
            z = bias + np.bincount(owner, w[at], len(chosen)) + 0.5 * ((sums * sums).sum(axis=1) - squares)
            error = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y
            grad_w = np.bincount(at, error[owner], len(touched))
            seen = np.bincount(at, minlength=len(touched))
            grad_v = np.stack(
                [np.bincount(at, error[owner] * (sums[owner, f] - v[at, f]), len(touched)) for f in range(FACTORS)], axis=1
            )
            sum_w[touched] += grad_w**2
            sum_v[touched] += grad_v**2
            sum_b += error.sum() ** 2
            bias -= step * error.sum() / np.sqrt(sum_b)
            move_w, move_v = step / np.sqrt(sum_w[touched]), 0.2 * step / np.sqrt(sum_v[touched])
            w, v = w - move_w * grad_w, v - move_v * grad_v
            weights[touched] = np.sign(w) * np.maximum(np.abs(w) - move_w * pull * seen, 0)
            factors[touched] = np.sign(v) * np.maximum(np.abs(v) - move_v * pull * seen[:, None], 0)
    used = (np.abs(weights) > 1e-3) | (np.abs(factors).max(axis=1) > 1e-2)
    return Machine(float(bias), names[used], weights[used], factors[used])


def featured(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The given columns and `buckets array<int>`."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [buckets(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        flat = np.concatenate(made) if made else np.zeros(0, np.int32)
        names = [*columns, "buckets"]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], lists(flat, np.array([len(x) for x in made]))], names)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, blob(text)).transform(mapped, by_batch(run), f"{kinds}, buckets array<int>")


def held_out(id_column: str) -> Column:
    """True for rows that learning must not see: crc32 of the id as text, modulo 5, is 0."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(5)) == 0


def telling(rows: DataFrame, label: str) -> DataFrame:
    """`rows` (doc_id, label, buckets) with only those buckets that `fit` can take in.

    Counted and chosen in Spark, by the conditions of `fit` with a little room for rounding; so the driver
    reads what the machine keeps, however long the texts are.
    """
    seen = rows.agg(F.count("*").alias("n"), F.sum(label).alias("bad")).first()
    if not 0 < (seen["bad"] or 0) < seen["n"]:
        return rows.withColumn("buckets", F.array().cast("array<int>"))
    prior = (seen["bad"] + 0.5) / (seen["n"] + 1.0)
    each = rows.select("doc_id", label, F.explode("buckets").alias("bucket"))
    n, bad = F.count("*"), F.sum(label)
    z = F.abs(F.col("bad") - F.col("n") * prior) / F.sqrt(F.col("n") * (prior * (1 - prior)))
    strong = (F.col("n") >= LEAST_ROWS) & ((z >= LEAST_Z - 1e-6) | (F.col("n") >= COMMON * seen["n"]))
    names = each.groupBy("bucket").agg(n.alias("n"), bad.alias("bad")).where(strong).select("bucket")
    left = each.join(names, "bucket").groupBy("doc_id").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))
    return rows.drop("buckets").join(left, "doc_id", "left").withColumn("buckets", F.coalesce("buckets", F.array().cast("array<int>")))


def learned(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 12_000) -> Machine:
    """Fit on at most `most` labelled documents that are not held out, those with the smallest hashed ids.

    The bound is on what the join sends to every task, so many ids, and on the rows that the driver reads, each
    with those of its buckets that can enter the machine. Of several labels of an id the larger counts;
    null labels do not.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(label).alias(label))
    chosen = known.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    chosen = telling(stored(featured(rows, ["doc_id", label], "text")), label)
    table = chosen.select("doc_id", label, "buckets").toArrow().sort_by("doc_id").combine_chunks()
    targets = table.column(label).to_numpy().astype(np.float64)
    found = [x.values.to_numpy() for x in table.column("buckets").combine_chunks()]
    return fit(found, targets) if found else fit([], np.zeros(0))


def places_of(held: Held) -> tuple[Machine, Remembered]:
    return lasting("places", held, lambda: loaded(held))


def loaded(held: Held) -> tuple[Machine, Remembered]:
    machine: Machine = pickle.loads(held.raw)
    place = {int(name): i for i, name in enumerate(machine.names)}
    return machine, Remembered(lambda word: tuple(place[b] for b in terms(word) if b in place), 120_000)


def score(
    docs: DataFrame, machine: Machine, text: str = "text", column: str = "score", keep: list[str] | None = None
) -> DataFrame:
    """`docs`, or its columns `keep`, with a probability from 0 to 1 for every row.

    Whole texts count; empty and null texts get the bias. All rows and columns stay, repeated rows get
    equal scores, and an empty table stays empty. A column of the same name as `column` is replaced.
    """
    held = Held(pickle.dumps(machine))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, known = places_of(held)
        rows = []
        for value in batch.column(batch.num_columns - 1).to_pylist():
            found = {p for places in map(known.__getitem__, set(value.lower().split())) for p in places}
            rows.append(np.array(sorted(found), np.int64))
        names = [*batch.schema.names[:-1], column]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own.scores(rows))], names)

    others = [c for c in (docs.columns if keep is None else keep) if c != column]
    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), f"`{column}` double"])
    return docs.select(*others, blob(text).alias("_bytes")).transform(mapped, by_batch(run), kinds)

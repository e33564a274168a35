"""Scoring with interval type-2 fuzzy models: many models per table, one evaluation for any number of rules.

Rows are packed into chunks per model key where they stand, without a shuffle, so a chunk meets its model
once; each chunk is scored in one Arrow call.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions import fuzzy
from tidecast.functions.scalars import clip
from tidecast.operators.fuzzy_trie import Model, crisp

MODEL_COLUMNS = ["feature_columns", "mfs", "memberships", "rules", "fallback"]
CELLS = 1 << 20  # rows x rules that are held at a time


def literal_model(
    spark: SparkSession, features: list[str], memberships: list[tuple], rules: list[tuple], fallback: float
) -> DataFrame:
    """One model as a one-row table; rules get the order of their consequents."""
    mfs = 1 + max(m[1] for m in memberships)
    schema = f"feature_columns array<string>, mfs int, memberships {fuzzy.MEMBERSHIP_TYPE}, rules {fuzzy.RULE_TYPE}, fallback double"
    ordered = sorted(rules, key=lambda rule: rule[2])
    return spark.createDataFrame([(features, mfs, sorted(memberships), ordered, fallback)], schema)


def check_features(expected: list[str], given: list[str]) -> None:
    if list(given) != list(expected):
        raise ValueError(f"Feature contract mismatch: model expects {list(expected)}, got {list(given)}")


def chunked(rows: DataFrame, features: list[str], keep: list[str], keys: list[str]) -> DataFrame:
    """(keys, kept array<struct>, x array<double>): the rows of each Arrow batch by key; inputs are clipped to [0, 1]."""
    inputs = F.array(*[clip(F.col(name).cast("double")) for name in features])
    flat = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*keep).alias("kept"), inputs.alias("x"))
    width = len(features)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, np.int64)
            for i in range(len(keys)):
                named = pc.dictionary_encode(batch.column(i), null_encoding="encode")
                code = np.unique(code * len(named.dictionary) + named.indices.to_numpy(), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
            edges = np.append(first, batch.num_rows)
            given = batch.take(pa.array(order))
            values = given.column(len(keys) + 1).flatten()
            lists = [
                pa.ListArray.from_arrays(pa.array(edges * n, pa.int32()), x)
                for n, x in ((1, given.column(len(keys))), (width, values))
            ]
            own = [given.column(i).take(pa.array(first)) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, *lists], names)

    names = [*[f"_{k}" for k in keys], "kept", "x"]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema if f.name not in ("kept", "x")]
    kept = f"kept array<{flat.schema['kept'].dataType.simpleString()}>"
    return flat.mapInArrow(run, ", ".join([*kinds, kept, "x array<double>"]))


def model_of(batch: pa.RecordBatch, i: int) -> Model:
    """The model in row i."""
    def fields(name: str, wanted: list[str]) -> dict[str, np.ndarray]:
        values = batch.column(name)[i].values
        return {k: values.field(k).to_numpy(zero_copy_only=False) for k in wanted}

    memberships = fields("memberships", ["feature", "center", "sigma", "lower_scale", "lower_lag"])
    rules = fields("rules", ["rule_id", "consequent", "weight"])
    antecedents = batch.column("rules")[i].values
    flat = antecedents.field("antecedent").flatten().to_numpy(zero_copy_only=False)
    rules["antecedent"] = flat.reshape(len(antecedents), -1) if len(antecedents) else flat.reshape(0, 0)
    return Model(batch.column("mfs")[i].as_py(), memberships, rules, batch.column("fallback")[i].as_py())


def scored(
    rows: DataFrame, features: list[str], keep: list[str], models: DataFrame, keys: list[str],
    evaluate: Callable[[Model, np.ndarray], tuple[int, list[pa.Array]]], made: list[tuple[str, str]],
) -> DataFrame:
    """Keep columns and what `evaluate` makes of a model and a block of inputs: the rows it makes per input, and its columns.

    `keys` name the columns by which rows and models meet; without any, all rows meet the one model.
    """
    parts = chunked(rows, features, keep, keys)
    chosen = models.select(*[F.col(k).alias(f"_{k}") for k in keys], *MODEL_COLUMNS)
    on = [f"_{k}" for k in keys]
    if not keys:
        parts, chosen, on = parts.withColumn("_one", F.lit(1)), chosen.withColumn("_one", F.lit(1)), ["_one"]
    joined = parts.join(chosen, on).select("kept", "x", *MODEL_COLUMNS)
    names = [*keep, *[name for name, _ in made]]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                check_features(batch.column("feature_columns")[i].as_py(), features)
                model, kept = model_of(batch, i), batch.column("kept")[i].values
                x = batch.column("x")[i].values.to_numpy(zero_copy_only=False).reshape(-1, len(features))
                step = max(1, CELLS // max(1, len(model.rule_id)))
                for at in range(0, len(x), step):
                    each, columns = evaluate(model, x[at : at + step])
                    own = kept.slice(at, step)
                    if each != 1:
                        own = own.take(pa.array(np.repeat(np.arange(len(own)), each)))
                    yield pa.RecordBatch.from_arrays([*own.flatten(), *columns], names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*keep).schema}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"{name} {kind}" for name, kind in made])
    return joined.mapInArrow(run, schema)


def doubles(values: np.ndarray) -> pa.Array:
    """A double column, row by row; NaN is NULL."""
    flat = np.ascontiguousarray(values, np.float64).ravel()
    return pa.array(flat, mask=np.isnan(flat))


def tiled(values: np.ndarray, times: int, kind: pa.DataType) -> pa.Array:
    return pa.array(np.tile(values, times), kind)


def membership_table(rows: DataFrame, features: list[str], keep: list[str], models: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Lower and upper degree of every membership: one row per input row and membership."""

    def evaluate(model: Model, x: np.ndarray):
        lower, upper = model.degrees(x)
        feature = model.memberships["feature"]
        mf = np.concatenate([np.arange(n) for n in np.unique(feature, return_counts=True)[1]]) if len(feature) else feature
        names = [tiled(v, len(x), pa.int32()) for v in (feature, mf)]
        return len(feature), [*names, doubles(lower), doubles(upper)]

    made = [("feature", "int"), ("mf", "int"), ("lower", "double"), ("upper", "double")]
    return scored(rows, features, keep, models, list(keys), evaluate, made)


def firing_table(rows: DataFrame, features: list[str], keep: list[str], models: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Lower and upper firing of every rule: one row per input row and rule."""

    def evaluate(model: Model, x: np.ndarray):
        lower, upper = model.firing(x)
        own = [tiled(model.consequent, len(x), pa.float64()), tiled(model.rule_id, len(x), pa.int32())]
        return len(model.rule_id), [*own, doubles(lower), doubles(upper)]

    made = [("consequent", "double"), ("rule_id", "int"), ("lower", "double"), ("upper", "double")]
    return scored(rows, features, keep, models, list(keys), evaluate, made)


def type_reduce(rows: DataFrame, features: list[str], keep: list[str], models: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Both ends of the type-reduced set; NULL where no rule fires."""

    def evaluate(model: Model, x: np.ndarray):
        left, right, _ = model.interval(x)
        return 1, [doubles(left), doubles(right)]

    return scored(rows, features, keep, models, list(keys), evaluate, [("y_left", "double"), ("y_right", "double")])


def it2_predict(rows: DataFrame, features: list[str], keep: list[str], models: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Prediction on the normalised scale (NULL of a NULL input) and whether no rule fired."""

    def evaluate(model: Model, x: np.ndarray):
        value, silent = crisp(*model.interval(x), model.fallback)
        return 1, [doubles(value), pa.array(silent)]

    made = [("prediction_norm", "double"), ("no_rule_fired", "boolean")]
    return scored(rows, features, keep, models, list(keys), evaluate, made)


def rule_activations(rows: DataFrame, features: list[str], keep: list[str], models: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Long activations, the geometric mean of both firings: one row per input row and rule."""

    def evaluate(model: Model, x: np.ndarray):
        lower, upper = model.firing(x)
        return len(model.rule_id), [tiled(model.rule_id, len(x), pa.int32()), doubles(np.sqrt(lower * upper))]

    return scored(rows, features, keep, models, list(keys), evaluate, [("rule_id", "int"), ("activation", "double")])


def activations_wide(activations: DataFrame, keys: list[str], rules: int) -> DataFrame:
    """Export form: one column per rule. The rule count is given, so no pass looks for it."""
    cells = [
        F.max(F.when(F.col("rule_id") == i, F.col("activation"))).alias(f"rule_{i}")
        for i in range(1, rules + 1)
    ]
    return activations.groupBy(*keys).agg(*cells)


def predict_saved(
    models: DataFrame, rows: DataFrame, features: list[str], keys: tuple[str, ...] = ("date",)
) -> DataFrame:
    """Score one saved model: the features must be the model's, in its order.

    `keys` are the columns that tell rows apart, such as series and date. Row-local, so `rows` may be a
    stream. Only the model's feature names come to the driver.
    """
    found = models.select("feature_columns").take(2)
    if len(found) != 1:
        raise ValueError(f"Expected one model to score with, found {'more' if found else 'none'}")
    check_features(found[0]["feature_columns"], features)
    return it2_predict(rows, features, list(keys), models)

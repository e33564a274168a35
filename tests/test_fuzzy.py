from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidecast.functions import labels
from tidecast.operators import explain, fuzzy_infer, fuzzy_train
from tidecast.operators.fuzzy_score import chunk_errors
from tidecast.operators.fuzzy_trie import Trie, crisp, ends
from tidecast.operators.rounds import pack_rows
from tidecast.plans.config import FuzzyConfig

MEMBERSHIPS = [(0, 0, 0.25, 0.2, 0.8, 0.05), (0, 1, 0.75, 0.2, 0.7, 0.0)]


def predict(lower, upper, level, fallback=0.4):
    lower, upper = np.asarray(lower, float), np.asarray(upper, float)
    return crisp(*ends(lower, upper, np.asarray(level, float)), upper.sum(axis=1), fallback)


def test_degenerate_interval_is_a_weighted_average():
    firing = [[0.2, 0.8], [0.5, 0.5]]
    value, silent = predict(firing, firing, [0, 1])
    assert value.round(12).tolist() == [0.8, 0.5] and not silent.any()


def test_fallback_without_firing_or_rules():
    for firing, level in (([[0.0]], [0.7]), (np.zeros((1, 0)), [])):
        value, silent = predict(firing, firing, level)
        assert value.tolist() == [0.4] and silent.all()


def iterate(lower, upper, level, left):
    """Plain switch-point iteration as an independent check."""
    value = np.average(level, weights=(lower + upper) / 2)
    for _ in range(100):
        low_side = level <= value
        weights = np.where(low_side == left, upper, lower)
        moved = np.average(level, weights=weights)
        if abs(moved - value) < 1e-14:
            break
        value = moved
    return value


def test_ends_equal_the_iteration():
    rng = np.random.default_rng(7)
    found, expected = [], []
    for _ in range(120):
        size = rng.integers(1, 9)
        level = np.sort(rng.random(size))
        upper = rng.random(size)
        lower = upper * rng.random(size)
        left, right = ends(lower[None, :], upper[None, :], level)
        found.append([left[0], right[0]])
        expected.append([iterate(lower, upper, level, side) for side in (True, False)])
    assert np.allclose(found, expected, atol=1e-10)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 3), st.integers(2, 3))
def test_chunk_scores_equal_brute_force(seed, features, mfs):
    rng = np.random.default_rng(seed)
    width, rules = features * mfs, mfs**features
    x, y = rng.random((5, features)), rng.random(5)
    shape = np.concatenate([rng.random(width), rng.uniform(0.25, 0.6, width), rng.uniform(0.1, 1, width), rng.uniform(-0.2, 0.2, width)])
    weight = np.where(rng.random(rules) < 0.4, 0, rng.uniform(0.05, 1, rules))
    level = rng.random(rules)
    center, sigma, scale, lag = shape.reshape(4, features, mfs)
    expected = 0.0
    for row, wanted in zip(x, y, strict=True):
        lower, upper = weight.copy(), weight.copy()
        for g in range(rules):
            for f in range(features):
                m = g // mfs ** (features - 1 - f) % mfs
                high = np.exp(-0.5 * ((row[f] - center[f, m]) / sigma[f, m]) ** 2)
                lower[g] *= min(high, scale[f, m] * np.exp(-0.5 * ((row[f] - center[f, m] - lag[f, m]) / sigma[f, m]) ** 2))
                upper[g] *= high
        on = weight > 0
        if upper.sum() <= 1e-12:
            expected += abs(0.4 - wanted)
        else:
            ends = [iterate(lower[on], upper[on], level[on], side) for side in (True, False)]
            expected += abs(np.clip(sum(ends) / 2, 0, 1) - wanted)
    found = chunk_errors(x.ravel(), y, np.arange(features), mfs, 0.4, [np.concatenate([shape, weight, level])])
    assert abs(found[0] - expected) < 1e-7


def plain_prediction(x, memberships, rules, fallback):
    """One row, one rule after the other."""
    lower, upper = np.ones(len(rules)), np.ones(len(rules))
    shapes = {(f, m): rest for f, m, *rest in memberships}
    for i, (_, antecedent, _, weight) in enumerate(rules):
        for feature, mf in enumerate(antecedent):
            center, sigma, scale, lag = shapes[feature, mf]
            high = np.exp(-0.5 * ((x[feature] - center) / sigma) ** 2)
            lower[i] *= max(0.0, min(high, scale * np.exp(-0.5 * ((x[feature] - center - lag) / sigma) ** 2)))
            upper[i] *= high
        lower[i], upper[i] = lower[i] * weight, upper[i] * weight
    if upper.sum() <= 1e-12:
        return fallback
    level = np.array([r[2] for r in rules])
    return float(np.clip(sum(iterate(lower, upper, level, side) for side in (True, False)) / 2, 0, 1))


@pytest.mark.parametrize("features,mfs,count", [(1, 2, 2), (1, 4, 4), (3, 4, 64), (5, 4, 1024), (5, 4, 700), (2, 3, 0)])
def test_any_number_of_rules_equals_the_plain_evaluation(spark, features, mfs, count):
    rng = np.random.default_rng(count)
    names = [f"x{i}" for i in range(features)]
    memberships = [(f, m, (m + 0.5) / mfs, 0.3, 0.8, 0.03) for f in range(features) for m in range(mfs)]
    every = [list(map(int, np.unravel_index(i, (mfs,) * features))) for i in range(mfs**features)]
    chosen = rng.permutation(len(every))[:count]
    rules = [(i + 1, every[g], float(rng.random()), float(rng.random()) + 0.1) for i, g in enumerate(chosen)]
    inputs = rng.random((60, features)) * 1.1
    rows = spark.createDataFrame([(i, i % 3, *map(float, x)) for i, x in enumerate(inputs)], f"id int, key int, {', '.join(n + ' double' for n in names)}")
    one = fuzzy_infer.literal_model(spark, names, memberships, rules, 0.4)
    expected = [plain_prediction(np.minimum(x, 1), memberships, rules, 0.4) for x in inputs]
    alone = {r["id"]: r["prediction_norm"] for r in fuzzy_infer.it2_predict(rows, names, ["id"], one).collect()}
    keyed = one.crossJoin(spark.range(2).selectExpr("cast(id as int) as key"))
    by_key = {r["id"]: r["prediction_norm"] for r in fuzzy_infer.it2_predict(rows, names, ["id"], keyed, ("key",)).collect()}
    assert set(by_key) == {i for i in range(60) if i % 3 < 2}
    for i in range(60):
        assert alone[i] == pytest.approx(expected[i], abs=1e-9) and by_key.get(i, alone[i]) == alone[i]


def test_shared_prefixes_are_one_node():
    grid = np.array(np.unravel_index(np.arange(4**5), (4,) * 5)).T
    trie = Trie(grid, 4)
    assert [level.shape[1] for level in trie.levels] == [4, 16, 64, 256, 1024]
    degrees = np.random.default_rng(1).random((7, 20))
    plain = np.prod([degrees[:, f * 4 + grid[:, f]] for f in range(5)], axis=0)
    assert np.allclose(trie.products(degrees), plain, rtol=1e-14)


def test_null_inputs_have_no_prediction(spark):
    models = fuzzy_infer.literal_model(spark, ["x"], MEMBERSHIPS, [(1, [0], 0.2, 0.9), (2, [1], 0.8, 1.0)], 0.4)
    rows = spark.createDataFrame([(0, None, "a"), (1, 0.5, None), (2, 9.0, "a"), (3, 1.0, None)], "id int, x double, key string")
    found = fuzzy_infer.it2_predict(rows, ["x"], ["id"], models).orderBy("id").collect()
    assert found[0]["prediction_norm"] is None and found[0]["no_rule_fired"] is False
    assert found[2]["prediction_norm"] == found[3]["prediction_norm"]  # inputs are clipped to 1
    firing = fuzzy_infer.firing_table(rows, ["x"], ["id"], models).filter("id = 0").collect()
    assert [(r["lower"], r["upper"]) for r in firing] == [(0.0, None)] * 2
    keyed = models.withColumn("key", F.lit("a"))
    assert {r["id"] for r in fuzzy_infer.it2_predict(rows, ["x"], ["id"], keyed, ("key",)).collect()} == {0, 2}
    assert fuzzy_infer.it2_predict(rows.limit(0), ["x"], ["id"], models).count() == 0


def test_feature_contract(spark):
    models = fuzzy_infer.literal_model(spark, ["x"], MEMBERSHIPS, [(1, [0], 0.2, 0.9)], 0.4)
    with pytest.raises(ValueError, match="Feature contract mismatch"):
        fuzzy_infer.predict_saved(models, spark.range(1), ["y"])
    with pytest.raises(ValueError, match="Expected one model"):
        fuzzy_infer.predict_saved(models.limit(0), spark.range(1), ["x"])


def test_stream_scoring_equals_batch(spark, tmp_path):
    from tidecast.streaming.score import score_stream

    models = fuzzy_infer.literal_model(spark, ["x"], MEMBERSHIPS, [(1, [0], 0.2, 0.9), (2, [1], 0.8, 1.0)], 0.4)
    rows = spark.range(20).select(F.date_add(F.lit("2017-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
                                  (F.col("id") / 20).alias("x"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = score_stream(models, stream, ["x"]).writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    batch = fuzzy_infer.predict_saved(models, rows, ["x"])
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, batch.collect()))


def test_labels(spark):
    values = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0, 1.2, -0.1]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    rows = frame.select(labels.consequent_label(F.col("v")).alias("a"), labels.closed_consequent_label(F.col("v")).alias("b")).collect()
    assert [r["a"] for r in rows] == ["critical_low", "low", "medium", "high", "peak", "peak", "peak", "critical_low"]
    assert [r["b"] for r in rows] == ["Critical_Low", "Critical_Low", "Low", "Medium", "High", "Peak", "Outside_Range", "Outside_Range"]


def test_signed_text_with_more_levels(spark):
    frame = spark.createDataFrame([(1, ["a", "b"], [3, -1]), (2, ["a", "b"], [0, 0])],
                                  "rule_id int, feature_columns array<string>, antecedent array<int>")
    rows = explain.signed_rule_text(frame, [], 3).orderBy("rule_id").collect()
    assert [r["antecedent"] for r in rows] == ["a is Level_3 AND NOT b is Level_1", ""]


def test_repeated_labels_are_numbered(spark):
    rules = [(i + 1, [0], c, 1.0) for i, c in enumerate([0.1, 0.15, 0.3, 0.18])]
    models = fuzzy_infer.literal_model(spark, ["x"], MEMBERSHIPS, rules, 0.4)
    found = {r["rule_id"]: r["consequent"] for r in explain.closed_consequent_labels(models, []).collect()}
    assert found == {1: "Critical_Low", 2: "Critical_Low_2", 4: "Critical_Low_3", 3: "Low"}


def test_candidate_rules(spark):
    row = spark.range(1).select(fuzzy_train.candidate_rules(2, 3).alias("r")).first()
    assert row["r"] == [[a, b] for a in range(3) for b in range(3)]
    assert fuzzy_train.rule_count(13, 2) == 8192
    cells = spark.range(1).select(fuzzy_train.initial_memberships(1, 4).alias("m")).first()["m"]
    assert [(c["center"], c["sigma"]) for c in cells] == [(0.125, 0.1375), (0.375, 0.1375), (0.625, 0.1375), (0.875, 0.1375)]


def training_frame(spark, partitions=4):
    rows = []
    for i in range(24):
        first, second = i / 23, max(0.0, float(np.sin(np.pi * i / 23)))
        target = min(1.0, 0.65 * first + 0.25 * second)
        for category in ("tea", "water"):
            rows.append((category, "train", date(2016, 1, 1) + timedelta(days=i), i + 1, target, first, min(second, 1.0)))
    schema = "category string, split string, date date, pos int, target_norm double, sales_lag_1 double, humidity double"
    return spark.createDataFrame(rows, schema).repartition(partitions)


SMOKE = FuzzyConfig(population_size=6, max_generations=2, pattern_max_iterations=2, ga_stall_generations=2)
VARIANTS = {"target_weather": ["sales_lag_1", "humidity"]}


@pytest.fixture(scope="module")
def trained(spark):
    return fuzzy_train.train_it2(training_frame(spark), VARIANTS, [42, 43], SMOKE).orderBy("category", "seed").collect()


def test_training_locks_upper_parameters_and_improves(trained):
    assert len(trained) == 4
    for row in trained:
        assert row["upper_parameters_locked"] and row["upper_parameter_max_delta"] == 0
        assert 1 <= len(row["rules"]) <= 4
        assert [r["consequent"] for r in row["rules"]] == sorted(r["consequent"] for r in row["rules"])
        for stage in ("stage_1", "stage_2", "stage_3"):
            history = row[stage]["history"]
            assert history == sorted(history, reverse=True)
        assert row["stage_2"]["history"][0] <= row["stage_1"]["history"][0]
        assert row["training_mae_norm"] == row["stage_3"]["best_objective"]


def test_training_does_not_depend_on_names_or_partitions(spark, trained):
    again = fuzzy_train.train_it2(training_frame(spark, 1), VARIANTS, [42, 43], SMOKE).orderBy("category", "seed").collect()
    assert again == trained
    by_key = {(r["category"], r["seed"]): r["rules"] for r in trained}
    assert by_key["tea", 42] == by_key["water", 42] and by_key["tea", 42] != by_key["tea", 43]


def test_inference_reproduces_the_training_error(spark, trained):
    models = fuzzy_train.train_it2(training_frame(spark), VARIANTS, [42], SMOKE)
    found = fuzzy_infer.it2_predict(training_frame(spark), VARIANTS["target_weather"], ["category", "target_norm"], models, ("category",))
    mae = found.filter("category = 'tea'").agg(F.avg(F.abs(F.col("prediction_norm") - F.col("target_norm")))).first()[0]
    assert abs(mae - trained[0]["training_mae_norm"]) < 1e-12


def test_chunked_scores_equal_whole_ones(spark, monkeypatch):
    frame, genomes = fuzzy_train.training_rows(training_frame(spark), VARIANTS), [[0.6, 0.2, 0.9, 0.5] + [1.0] * 4 + [0.1, 0.4, 0.5, 0.9]]
    whole = fuzzy_train.score_population(frame, VARIANTS["target_weather"], genomes, SMOKE).orderBy("category").collect()
    monkeypatch.setattr("tidecast.operators.rounds.CHUNK_ROWS", 5)
    assert pack_rows(frame, ["category"], ["humidity"], F.col("pos")).count() == 10
    parts = fuzzy_train.score_population(frame, VARIANTS["target_weather"], genomes, SMOKE).orderBy("category").collect()
    assert np.allclose([r["mae"] for r in whole], [r["mae"] for r in parts], atol=1e-12)


def test_training_refuses_inputs_outside_the_unit_interval(spark):
    frame = training_frame(spark).withColumn("humidity", F.col("humidity") + 1)
    with pytest.raises(Exception, match="must be finite and in"):
        fuzzy_train.training_rows(frame, VARIANTS).collect()


def test_small_activations_keep_their_weight(spark):
    from tidecast.functions.scalars import exact_sum

    one = spark.createDataFrame([(3e-12, 0.5)], "a double, t double")
    sums = one.agg(exact_sum(F.col("a")).alias("a"), exact_sum(F.col("a") * F.col("t")).alias("w")).first()
    assert sums["w"] / sums["a"] == pytest.approx(0.5, rel=1e-5)


def test_rules_without_samples_fail_the_support_check(spark):
    from tidecast.operators.verify import support_checks

    rules = spark.createDataFrame([("x", 1, 1), ("x", 2, 0), ("x", 3, 9)], "category string, rule_id int, support int")
    seen = spark.createDataFrame([("x", 1, 0.5), ("x", 3, 0.5)], "category string, rule_id int, activation double")
    assert support_checks(rules, seen, ["category"]).first()["outside"] == 2

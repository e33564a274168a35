from datetime import date

import pytest
from conftest import demand_rows
from pyspark.sql import functions as F

from tidecast.functions.scalars import safe_name, scale_col, unscale_col
from tidecast.operators import evaluate, features, naive, report, summaries
from tidecast.operators.contract import DEMAND_SCHEMA

LAGS, COVARIATES = [1, 3], ["avg_temp", "rainfall"]


def prepared_of(spark, rows):
    return features.prepare_features(spark.createDataFrame(rows, DEMAND_SCHEMA), 2016, 2017, COVARIATES)


def by_date(df):
    return {r["date"]: r for r in df.collect()}


def replaced(day, **changes):
    names = DEMAND_SCHEMA.names
    return [
        tuple(changes.get(n, v) if row[0] == day else v for n, v in zip(names, row, strict=True))
        for row in demand_rows()
    ]


def test_scales_come_from_the_training_year(demand):
    prepared = features.prepare_features(demand, 2016, 2017, COVARIATES)
    row = prepared.first()
    assert (row["sales_max"], row["avg_temp_max"]) == (5.0, 14.0)
    rows = by_date(features.make_supervised(prepared, LAGS, COVARIATES))
    test = rows[date(2017, 3, 4)]
    assert test["avg_temp"] == 1.0 and test["target_norm"] > 1


def test_alignment_of_lags_and_covariates(demand):
    rows = by_date(features.make_supervised(features.prepare_features(demand, 2016, 2017, COVARIATES), LAGS, COVARIATES))
    first = rows[min(rows)]
    assert first["date"] == date(2016, 3, 4)
    assert (first["sales_lag_1"], first["sales_lag_3"], first["avg_temp"]) == (0.5, 0.0, 0.75)


def test_missing_target_is_left_out_but_feeds_history(spark):
    prepared = prepared_of(spark, replaced(date(2016, 3, 4), sales=None))
    rows = by_date(features.make_supervised(prepared, LAGS, COVARIATES))
    assert date(2016, 3, 4) not in rows and rows[date(2016, 3, 5)]["sales_lag_1"] is not None


def test_filling_stops_at_the_year_border(spark):
    prepared = prepared_of(spark, replaced(date(2017, 3, 1), sales=None))
    row = by_date(prepared)[date(2017, 3, 1)]
    assert row["sales"] == 3.0 and row["target_observed"] is False


def test_unusable_series_raise_with_their_reason(spark):
    with pytest.raises(Exception, match="both 2016 and 2017 data are required"):
        prepared_of(spark, demand_rows()[:5]).collect()
    empty = [tuple(None if n == "rainfall" else v for n, v in zip(DEMAND_SCHEMA.names, r, strict=True)) for r in demand_rows()]
    with pytest.raises(Exception, match="training column rainfall has no usable values"):
        prepared_of(spark, empty).collect()
    with pytest.raises(Exception, match="duplicate date/category rows"):
        prepared_of(spark, [*demand_rows(), demand_rows()[0]]).collect()


def test_unusable_series_can_be_dropped_and_listed(spark):
    rows = [*demand_rows(), (date(2016, 3, 1), "ice", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    demand = spark.createDataFrame(rows, DEMAND_SCHEMA)
    kept = features.prepare_features(demand, 2016, 2017, COVARIATES, on_error="drop")
    assert {r["category"] for r in kept.select("category").collect()} == {"water"}
    problems = features.series_problems(demand, 2016, 2017, COVARIATES).collect()
    assert [(r["category"], r["reason"]) for r in problems] == [("ice", "ice: both 2016 and 2017 data are required")]


def test_listed_categories(demand):
    assert [r["category"] for r in features.absent_categories(demand, ["water", "tea"]).collect()] == ["tea"]
    assert features.select_categories(demand, ["tea"]).count() == 0


def test_prepared_needs_one_shuffle_by_category(demand):
    prepared = features.make_supervised(features.prepare_features(demand, 2016, 2017, COVARIATES), LAGS, COVARIATES)
    plan = prepared._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_scale_round_trip(spark):
    frame = spark.range(5).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("lo"), F.lit(3.0).alias("hi"))
    back = unscale_col(scale_col(F.col("x"), F.col("lo"), F.col("hi")), F.col("lo"), F.col("hi"))
    assert all(abs(r["x"] - r["b"]) < 1e-12 for r in frame.withColumn("b", back).collect())


def test_safe_name(spark):
    row = spark.createDataFrame([("#ice cream/π!",)], "x string").select(safe_name(F.col("x")).alias("x")).first()
    assert row["x"] == "ice_cream_π"


ALIGNED = (
    "category string, model string, variant string, backend string, seed long, date date, predicted double, "
    "predicted_norm double, target double, target_norm double, mase_scale double"
)


def aligned_row(day, predicted, target, pn=0.0, tn=0.0, scale=1.0, model="m", seed=None):
    return ("water", model, "sales_only", "spark", seed, date(2017, 1, day), predicted, pn, target, tn, scale)


def test_metrics_on_known_errors(spark):
    rows = [aligned_row(1, 12.0, 10.0, 0.2, 0.0), aligned_row(2, 18.0, 20.0, 0.8, 1.0)]
    row = evaluate.metrics_table(spark.createDataFrame(rows, ALIGNED)).first()
    assert (row["rmse"], row["mae"], row["mase"], row["n"]) == (2.0, 2.0, 2.0, 2)
    assert abs(row["rmse_norm"] - 0.2) < 1e-12 and abs(row["mae_norm"] - 0.2) < 1e-12


def test_metrics_skip_what_is_not_finite(spark):
    rows = [aligned_row(1, float("nan"), 10.0), aligned_row(2, 0.0, 0.0, scale=None), aligned_row(3, float("inf"), 1.0)]
    row = evaluate.metrics_table(spark.createDataFrame(rows, ALIGNED)).first()
    assert (row["n"], row["rmse"], row["smape"]) == (1, 0.0, 0.0)
    with pytest.raises(Exception, match="No finite prediction pairs"):
        evaluate.metrics_table(spark.createDataFrame(rows[:1], ALIGNED)).collect()


def test_mase_scale_is_null_without_change(spark):
    rows = [(d, c, 7.0, *rest) for d, c, _, *rest in demand_rows()]
    prepared = prepared_of(spark, rows)
    assert evaluate.mase_scale(prepared, 2).first()["mase_scale"] is None
    assert evaluate.mase_scale(prepared, 7).first()["mase_scale"] is None


def test_seasonal_naive_equals_its_shortcut(demand):
    prepared = features.prepare_features(demand, 2016, 2017, COVARIATES)
    rows = naive.seasonal_naive(prepared, 2).orderBy("date").collect()
    assert [r["predicted"] for r in rows] == [100.0, 110.0, 120.0]
    truth = evaluate.truth_table(prepared, 1, 2, 2)
    joined = evaluate.align(naive.seasonal_naive(prepared, 2), truth)
    names = sorted(joined.columns)
    direct = evaluate.naive_aligned(truth).select(*names).orderBy("date").collect()
    assert joined.select(*names).orderBy("date").collect() == direct


METRICS_SCHEMA = (
    "category string, model string, variant string, seed long, rmse double, mae double, mase double, "
    "smape double, rmse_norm double, mae_norm double"
)


def test_ablation_without_backend_and_with_null_seed(spark):
    base = [10.0, 8.0, 1.0, 20.0, 0.5, 0.4]
    rows = []
    for seed in (42, None):
        rows.append(("water", "efs", "sales_only", seed, *base))
        rows.append(("water", "efs", "target_weather", seed, *[v * 0.8 for v in base]))
    rows.append(("ice", "efs", "sales_only", 42, *base))
    ablation = summaries.covariate_ablation(spark.createDataFrame(rows, METRICS_SCHEMA))
    found = ablation.collect()
    assert len(found) == 2 and {r["seed"] for r in found} == {42, None}
    assert all(abs(r[f"{m}_improvement_pct"] - 20) < 1e-9 for r in found for m in evaluate.METRICS)
    assert found[0]["backend"] == "unspecified"
    summary = {r["measure"]: r for r in summaries.ablation_summary(ablation).collect()}
    assert len(summary) == 18 and abs(summary["mae_improvement_pct"]["mean"] - 20) < 1e-9


def test_single_seed_has_no_deviation(spark):
    rows = [("water", "lstm", "sales_only", 42, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    row = summaries.macro_summary(spark.createDataFrame(rows, METRICS_SCHEMA)).first()
    assert row["rmse_mean"] == 1.0 and row["rmse_std"] is None


def test_forecast_pivot_of_one_category(spark):
    rows = [("water", "a", "v", "spark", None, date(2017, 1, 1), 5.0, 3.0, 0.0, 0.0),
            ("tea", "a", "v", "spark", None, date(2017, 1, 1), 5.0, 4.0, 0.0, 0.0)]
    schema = "category string, model string, variant string, backend string, seed long, date date, actual double, predicted double, actual_norm double, predicted_norm double"
    table = report.forecast_pivot(spark.createDataFrame(rows, schema), ["a:v:spark", "b:v:spark"], "water").collect()
    assert len(table) == 1 and table[0]["a:v:spark"] == 3.0 and table[0]["b:v:spark"] is None

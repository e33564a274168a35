"""Registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import fuzzy_inputs as fx
from catalog.inputs import (
    COVARIATES,
    LAGS,
    PERIOD,
    TEST_YEAR,
    TRAIN_YEAR,
    derived_demand,
    holdout_demand,
    prepared_demand,
    raw_demand,
    table,
    wide_demand,
)
from catalog.rounding import rounded
from tidecast.operators import (
    arima,
    contract,
    evaluate,
    explain,
    features,
    fuzzy_infer,
    fuzzy_train,
    lstm,
    naive,
    report,
    reshape,
    summaries,
    verify,
)
from tidecast.operators.rounds import durable
from tidecast.plans.benchmark import preprocessing_table
from tidecast.plans.config import MODELS, FuzzyConfig, make_config
from tidecast.plans.forecasting import fuzzy_predictions, unavailable_models
from tidecast.plans.jobs import training_jobs
from tidecast.sources import merkle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    """Register a query under its function name; its doubles are rounded for comparison."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
    return fn


def bitwise(fn: Callable[[SparkSession, str], DataFrame]):
    """Register a query whose doubles are equal in both engines to the last bit: nothing is rounded."""
    QUERIES[fn.__name__] = fn
    return fn


# ---- contract and reshape

@query
def coerce_demand(spark, sf_dir):
    return contract.coerce(raw_demand(spark, sf_dir))


@query
def validation_report(spark, sf_dir):
    return contract.validation_report(contract.coerce(raw_demand(spark, sf_dir)))


@query
def demand_violations(spark, sf_dir):
    broken = contract.violations(contract.coerce(raw_demand(spark, sf_dir)))
    return broken.select("date", "category", "sales", F.concat_ws("; ", "violations").alias("violations"))


@query
def wide_to_long(spark, sf_dir):
    return reshape.wide_to_long(wide_demand(spark, sf_dir))


# ---- leakage-safe features

@query
def split_years(spark, sf_dir):
    holdout = features.split_years(derived_demand(spark, sf_dir), TRAIN_YEAR, TEST_YEAR)
    return holdout.groupBy("category", "split").agg(
        F.count(F.lit(1)).alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
    )


@query
def fit_medians(spark, sf_dir):
    stats = features.feature_stats(prepared_demand(spark, sf_dir), COVARIATES)
    return stats.select("category", "feature", "median")


@query
def fit_scales(spark, sf_dir):
    stats = features.feature_stats(prepared_demand(spark, sf_dir), COVARIATES)
    return stats.select("category", "feature", "minimum", "maximum")


@query
def fill_forward(spark, sf_dir):
    return prepared_demand(spark, sf_dir).select(
        "category", "split", "date", "target_observed", "sales", *COVARIATES
    )


@query
def lag_features(spark, sf_dir):
    rows = features.make_supervised(prepared_demand(spark, sf_dir), LAGS, COVARIATES)
    return rows.select(
        "category", "split", "date", "target", "target_norm", *[f"sales_lag_{k}" for k in LAGS], *COVARIATES
    )


@query
def unscale_targets(spark, sf_dir):
    from tidecast.functions.scalars import unscale_col

    rows = features.make_supervised(prepared_demand(spark, sf_dir), LAGS, [])
    back = unscale_col(F.col("target_norm"), F.col("sales_min"), F.col("sales_max"))
    return rows.select("category", "date", back.alias("target"))


@query
def evaluation_dates(spark, sf_dir):
    return features.evaluation_dates(prepared_demand(spark, sf_dir), PERIOD)


@query
def select_categories(spark, sf_dir):
    demand = derived_demand(spark, sf_dir)
    chosen = features.select_categories(demand, ["Brand#3", "Brand#11", "Brand#25"])
    return chosen.groupBy("category").agg(F.count(F.lit(1)).alias("days"), F.sum("sales").alias("sales"))


@query
def series_problems(spark, sf_dir):
    """Brands on the 1997 against 2001 holdout, without the second year for part of them."""
    demand = derived_demand(spark, sf_dir)
    number = F.regexp_extract("category", r"(\d+)$", 1).cast("int")
    cut = demand.filter(~((number > 20) & (F.year("date") == 2001)))
    blank = F.when(~((number < 4) & (F.year("date") == 1997)), F.col("rainfall"))
    return features.series_problems(cut.withColumn("rainfall", blank), 1997, 2001, COVARIATES)


# ---- seasonal naive, alignment, metrics

def naive_aligned(spark, sf_dir):
    prepared = prepared_demand(spark, sf_dir)
    truth = evaluate.truth_table(prepared, max(LAGS), PERIOD, PERIOD)
    return evaluate.naive_aligned(truth)


@query
def seasonal_naive(spark, sf_dir):
    return naive.seasonal_naive(prepared_demand(spark, sf_dir), PERIOD)


@query
def align_forecasts(spark, sf_dir):
    """Forecasts against the supervised rows, kept to the common dates by a semi-join."""
    prepared = prepared_demand(spark, sf_dir)
    supervised = features.make_supervised(prepared, LAGS, [])
    truth = supervised.filter(F.col("split") == "test").select("category", "date", "target", "target_norm")
    aligned = evaluate.align(
        naive.seasonal_naive(prepared, PERIOD), truth, features.evaluation_dates(prepared, PERIOD)
    )
    return aligned.select("category", "date", "target", "target_norm", "predicted", "predicted_norm")


@query
def mase_scale(spark, sf_dir):
    return evaluate.mase_scale(prepared_demand(spark, sf_dir), PERIOD)


@query
def predictions_table(spark, sf_dir):
    return evaluate.predictions_table(naive_aligned(spark, sf_dir))


@query
def seasonal_naive_metrics(spark, sf_dir):
    return evaluate.metrics_table(naive_aligned(spark, sf_dir))


# ---- summaries: a fixture of seeded and covariate-shifted forecasts made from the naive one

def seeded_aligned(spark, sf_dir):
    """Fixture: `efs` rows for three seeds and two variants, each a shifted naive forecast."""
    naive_rows = naive_aligned(spark, sf_dir)
    cells = [
        F.struct(F.lit(v).alias("variant"), F.lit(s).cast("long").alias("seed"),
                 F.lit(factor).alias("factor"))
        for v, shift in (("sales_only", 0.0), ("target_weather", 0.03))
        for s in (42, 43, 44)
        for factor in (1 + (s - 43) * 0.01 - shift,)
    ]
    fuzzy = naive_rows.drop("variant", "seed", "model").select("*", F.inline(F.array(*cells)))
    fuzzy = fuzzy.select(
        "category", "date", "target", "target_norm", "mase_scale", F.lit("efs").alias("model"),
        "variant", "backend", "seed", (F.col("predicted") * F.col("factor")).alias("predicted"),
        (F.col("predicted_norm") * F.col("factor")).alias("predicted_norm"),
    )
    return naive_rows.unionByName(fuzzy)


def seeded_metrics(spark, sf_dir):
    return evaluate.metrics_table(seeded_aligned(spark, sf_dir))


@query
def metrics_table(spark, sf_dir):
    return seeded_metrics(spark, sf_dir)


@bitwise
def category_summary(spark, sf_dir):
    return summaries.category_summary(seeded_metrics(spark, sf_dir))


@bitwise
def macro_metrics(spark, sf_dir):
    return summaries.macro_metrics(seeded_metrics(spark, sf_dir))


@bitwise
def macro_summary(spark, sf_dir):
    return summaries.macro_summary(seeded_metrics(spark, sf_dir))


@query
def covariate_ablation(spark, sf_dir):
    return summaries.covariate_ablation(seeded_metrics(spark, sf_dir))


@bitwise
def ablation_summary(spark, sf_dir):
    return summaries.ablation_summary(summaries.covariate_ablation(seeded_metrics(spark, sf_dir)))


@query
def forecast_lines(spark, sf_dir):
    return report.forecast_lines(evaluate.predictions_table(seeded_aligned(spark, sf_dir)))


@query
def actual_line(spark, sf_dir):
    return report.actual_line(evaluate.predictions_table(seeded_aligned(spark, sf_dir)))


SERIES_LABELS = ["efs:sales_only:spark", "efs:target_weather:spark", "seasonal_naive:sales_only:spark"]


@query
def forecast_pivot(spark, sf_dir):
    return report.forecast_pivot(evaluate.predictions_table(seeded_aligned(spark, sf_dir)), SERIES_LABELS)


@query
def preview_demand(spark, sf_dir):
    return report.preview(derived_demand(spark, sf_dir), 100)


@query
def safe_series_names(spark, sf_dir):
    from tidecast.functions.scalars import safe_name

    demand = derived_demand(spark, sf_dir)
    return demand.groupBy(safe_name(F.concat(F.lit("#"), "category", F.lit(" / daily."))).alias("name")).agg(
        F.count(F.lit(1)).alias("days")
    )


# ---- fuzzy scoring with a fixed model, over every order

def on_orders(evaluate, spark, sf_dir):
    return evaluate(fx.order_inputs(spark, sf_dir), fx.ORDER_FEATURES, ["sample_id"], fx.fixed_model(spark))


@query
def membership_bounds(spark, sf_dir):
    return on_orders(fuzzy_infer.membership_table, spark, sf_dir)


@query
def firing_bounds(spark, sf_dir):
    return on_orders(fuzzy_infer.firing_table, spark, sf_dir)


@query
def type_reduce(spark, sf_dir):
    return on_orders(fuzzy_infer.type_reduce, spark, sf_dir)


@query
def it2_predict(spark, sf_dir):
    return on_orders(fuzzy_infer.it2_predict, spark, sf_dir)


@query
def predict_between_rules(spark, sf_dir):
    """Memberships so narrow that some orders fire no rule and get the fallback."""
    return fuzzy_infer.it2_predict(fx.order_inputs(spark, sf_dir), fx.ORDER_FEATURES, ["sample_id"], fx.narrow_model(spark))


@query
def predict_saved(spark, sf_dir):
    """A saved model on a table with dates; the features must be the model's."""
    days = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_orderdate").cast("date").alias("date"))
    rows = fx.order_inputs(spark, sf_dir).join(days, "sample_id")
    return fuzzy_infer.predict_saved(fx.fixed_model(spark), rows, fx.ORDER_FEATURES, ("sample_id", "date"))


def order_activations(spark, sf_dir):
    return on_orders(fuzzy_infer.rule_activations, spark, sf_dir)


@query
def rule_activations(spark, sf_dir):
    return order_activations(spark, sf_dir)


@query
def activations_wide(spark, sf_dir):
    return fuzzy_infer.activations_wide(order_activations(spark, sf_dir), ["sample_id"], len(fx.RULES))


@query
def rule_stats(spark, sf_dir):
    return explain.rule_stats(order_activations(spark, sf_dir), [])


# ---- rule learning and explanation, one model per series and variant

@query
def weighted_consequents(spark, sf_dir):
    found = fuzzy_train.weighted_consequents(fx.training_rows(spark, sf_dir), fx.variants(), fx.MFS)
    return found.select("category", "variant", "rule_id", "activation", "consequent")


@query
def candidate_rules(spark, sf_dir):
    """The candidate rule base of each series with its text, before any learning."""
    models = fx.series_models(spark, sf_dir)
    return explain.rule_text(models, ["category", "variant"])


@query
def strongest_rules(spark, sf_dir):
    consequents = fuzzy_train.weighted_consequents(fx.training_rows(spark, sf_dir), fx.variants(), fx.MFS)
    ranked = fuzzy_train.strongest_rules(consequents, fx.variants())
    return ranked.filter("strong").select("category", "variant", "rule_id", "activation", "consequent")


@query
def initial_memberships(spark, sf_dir):
    return fx.series_models(spark, sf_dir).select("category", "variant", F.inline("memberships"))


@query
def signed_rule_text(spark, sf_dir):
    """Signed antecedents on the first three candidate rules of each series."""
    signed = F.create_map(*[
        part for i, a in fx.SIGNED.items() for part in (F.lit(i), F.array(*[F.lit(v) for v in a]))
    ])
    rules = explain.rule_rows(fx.series_models(spark, sf_dir), ["category", "variant"]).select(
        "category", "variant", "rule_id", F.array(F.lit("sales"), F.lit("rainfall")).alias("feature_columns"),
        F.coalesce(F.try_element_at(signed, F.pmod("rule_id", F.lit(4))),
                   F.array(F.lit(1), F.lit(2))).alias("antecedent"),
    )
    return explain.signed_rule_text(rules, ["category", "variant"], 2)


@query
def consequent_labels(spark, sf_dir):
    return explain.consequent_labels(fx.series_models(spark, sf_dir), ["category", "variant"])


@query
def closed_consequent_labels(spark, sf_dir):
    return explain.closed_consequent_labels(fx.series_models(spark, sf_dir), ["category", "variant"])


def series_scored(evaluate, spark, sf_dir):
    """Test rows through the untrained model of their series, for each variant."""
    models = fx.series_models(spark, sf_dir)
    test = fx.supervised(spark, sf_dir).filter(F.col("split") == "test")
    parts = [
        evaluate(test, names, ["category", "date"], models.filter(F.col("variant") == v), ("category",)).withColumn("variant", F.lit(v))
        for v, names in fx.variants().items()
    ]
    return reduce(DataFrame.unionByName, parts)


MODEL = ["category", "variant"]


def series_activations(spark, sf_dir):
    return series_scored(fuzzy_infer.rule_activations, spark, sf_dir)


@query
def series_predictions(spark, sf_dir):
    return series_scored(fuzzy_infer.it2_predict, spark, sf_dir)


@query
def explain_rules(spark, sf_dir):
    return explain.explain(fx.series_models(spark, sf_dir), series_activations(spark, sf_dir), MODEL)


@query
def activation_matrix(spark, sf_dir):
    return explain.activation_matrix(series_activations(spark, sf_dir), MODEL)


@query
def score_population(spark, sf_dir):
    return fuzzy_train.score_population(
        fx.training_rows(spark, sf_dir), fx.SALES_FEATURES, fx.GENOMES, FuzzyConfig())


# ---- fitted forecasters

@query
def ar_ols(spark, sf_dir):
    return arima.ar_ols(prepared_demand(spark, sf_dir))


@query
def arima_ar_fits(spark, sf_dir):
    """The grid's AR(1) candidates, which are least-squares fits on the common sample."""
    fits = arima.regression_candidates(prepared_demand(spark, sf_dir), "smoke")
    return fits.filter("p = 1 and q = 0").select(
        "category", "d", "aic", "constant", F.get("ar", F.lit(0)).alias("ar"))


@query
def arima_select(spark, sf_dir):
    """Best order per series over the full grid."""
    best = arima.arima_select(prepared_demand(spark, sf_dir), "full")
    return best.select("category", "p", "d", "q", "aic")


@query
def arima_forecast(spark, sf_dir):
    """Rolling one-step forecasts with the selected orders, scored on the common dates."""
    prepared = durable(prepared_demand(spark, sf_dir))
    forecast = arima.arima_roll(arima.arima_select(prepared, "full"), prepared)
    truth = evaluate.truth_table(prepared, max(LAGS), PERIOD, PERIOD)
    return evaluate.metrics_table(evaluate.align(forecast, truth))


@query
def arima_fixed_roll(spark, sf_dir):
    """Rolling one-step forecasts of one ARIMA(2, 1, 2) with given parameters for every series, in short chunks."""
    prepared = durable(prepared_demand(spark, sf_dir))
    fit = prepared.select("category").distinct().select(
        "category", F.lit(2).alias("p"), F.lit(1).alias("d"), F.lit(2).alias("q"), F.lit(0.02).alias("constant"),
        F.array(F.lit(0.5), F.lit(-0.2)).alias("ar"), F.array(F.lit(0.4), F.lit(0.3)).alias("ma"))
    return arima.arima_roll(fit, prepared, chunk=64).select("category", "date", "predicted", "predicted_norm")


@query
def lstm_forecast(spark, sf_dir):
    """Short-profile training and test metrics of the neural baseline."""
    prepared = durable(prepared_demand(spark, sf_dir))
    rows = features.make_supervised(prepared, LAGS, [])
    networks = lstm.train_lstm(rows, LAGS, [42], "smoke")
    truth = evaluate.truth_table(prepared, max(LAGS), PERIOD, PERIOD)
    return evaluate.metrics_table(evaluate.align(lstm.lstm_forecast(rows, networks, LAGS), truth))


@query
def train_it2(spark, sf_dir):
    """Short-profile fuzzy training of all series and both variants, scored on the test year."""
    smoke = make_config({"profile": "smoke"}).efs
    rows = durable(fx.supervised(spark, sf_dir))
    models = fuzzy_train.train_it2(rows, fx.variants(), [42], smoke)
    scored = fuzzy_predictions(rows.filter(F.col("split") == "test"), models, fx.variants())
    return scored.groupBy("category", "variant", "seed").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("prediction_norm").alias("mean_prediction"),
        F.count_if("no_rule_fired").alias("no_rule_samples"))


# ---- records and checks of a run

@query
def preprocessing_record(spark, sf_dir):
    """Scales and medians per series and variant, as recorded for each training job."""
    config = make_config({"train_year": TRAIN_YEAR, "test_year": TEST_YEAR})
    table_ = preprocessing_table(prepared_demand(spark, sf_dir), config)
    return table_.select(
        "category", "variant", F.array_join("feature_columns", ",").alias("feature_columns"), "input_policy",
        F.col("scales")["sales"]["minimum"].alias("sales_minimum"),
        F.col("scales")["sales"]["maximum"].alias("sales_maximum"),
        F.col("scales")["rainfall"]["maximum"].alias("rainfall_maximum"),
        F.col("training_medians")["humidity"].alias("humidity_median"),
    )


@query
def training_jobs_identity(spark, sf_dir):
    """Identity hash of each training job, from order-free fingerprints of its rows."""
    return training_jobs(fx.supervised(spark, sf_dir), fx.variants(), [42, 43, 44], FuzzyConfig())


@query
def demand_tree(spark, sf_dir):
    """Digests of all demand series, of their buckets and of the table."""
    days = merkle.leaves(derived_demand(spark, sf_dir), ["category"], "date", ["sales", "rainfall"])
    nodes = merkle.series(days, ["category"])
    own = nodes.select(F.lit(9).alias("level"), F.col("category").alias("path"), F.col("days").alias("nodes"), "digest")
    return own.unionByName(merkle.tree(nodes, ["category"]))


@query
def changed_days(spark, sf_dir):
    """Demand against a later version of it: one value moved, one day lost and one added in some series."""
    old = derived_demand(spark, sf_dir).filter("not (day(date) = 3 and right(category, 1) = '1')")
    new = derived_demand(spark, sf_dir).filter("not (day(date) = 7 and right(category, 1) = '2')")
    moved = F.when((F.dayofmonth("date") == 20) & (last_sign() == "3"), F.col("sales") + 1).otherwise(F.col("sales"))
    keys, columns = ["category"], ["sales", "rainfall"]
    before, after = (merkle.leaves(t, keys, "date", columns) for t in (old, new.withColumn("sales", moved)))
    return merkle.changed_days(before, after, keys)


@query
def unavailable_records(spark, sf_dir):
    metrics = seeded_metrics(spark, sf_dir)
    config = make_config({"train_year": TRAIN_YEAR, "test_year": TEST_YEAR})
    return unavailable_models(metrics.select("category").distinct(), metrics, config)


@query
def required_models(spark, sf_dir):
    return verify.present_models(seeded_metrics(spark, sf_dir), MODELS)


@query
def fuzzy_variant_check(spark, sf_dir):
    """Of two expected variants one is stored under another name."""
    named = F.when(F.col("variant") == "target_weather", "weather").otherwise(F.col("variant"))
    return verify.fuzzy_variants(seeded_metrics(spark, sf_dir).withColumn("variant", named))


def last_sign():
    return F.substring("category", -1, 1)


@query
def activation_checks(spark, sf_dir):
    """Activations as stored: by the last sign of the series whole, out of range, constant or with gaps."""
    value, sign = F.col("activation"), last_sign()
    stored = F.when(sign == "1", value + 1).when(sign == "2", 0.5).when(
        sign == "3", F.when(F.dayofmonth("date") > 20, value)).otherwise(value)
    return verify.activation_checks(series_activations(spark, sf_dir).withColumn("activation", stored), MODEL)


@query
def support_checks(spark, sf_dir):
    """Rule tables against activations: some supports too large, some rules without samples."""
    activations = series_activations(spark, sf_dir)
    rules = explain.explain(fx.series_models(spark, sf_dir), activations, MODEL)
    extra = F.when((last_sign() == "1") & (F.col("rule_id") <= 2), 9999).otherwise(0)
    present = activations.filter((last_sign() != "2") | (F.col("rule_id") > 3))
    return verify.support_checks(rules.withColumn("support", F.col("support") + extra), present, MODEL)


@query
def missing_outputs(spark, sf_dir):
    """Training jobs of the seeded fixture without metrics of their variant and seed."""
    jobs = training_jobs(fx.supervised(spark, sf_dir), fx.variants(), [42, 45], FuzzyConfig())
    return verify.missing_outputs(jobs.drop("identity"), seeded_metrics(spark, sf_dir), ["category", "variant", "seed"])

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import arima, arma, features, lstm
from tidecast.operators.contract import DEMAND_SCHEMA


def demand_of(spark, **series):
    """One category per keyword: its values run through both years, half of them in each."""
    rows = []
    for category, values in series.items():
        half = len(values) // 2
        for year, part in ((2016, values[:half]), (2017, values[half:])):
            rows += [(date(year, 1, 1) + timedelta(days=i), category, None if v is None else float(v), *[1.0] * 5)
                     for i, v in enumerate(part)]
    return spark.createDataFrame(rows, DEMAND_SCHEMA)


def simulated(seed, ar=0.0, ma=0.0, size=700, level=100.0):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=size)
    y = np.zeros(size)
    for t in range(1, size):
        y[t] = ar * y[t - 1] + e[t] + ma * e[t - 1]
    return level + 5 * y


@pytest.fixture(scope="module")
def prepared(spark):
    demand = demand_of(spark, ar=simulated(0, ar=0.7), ma=simulated(2, ma=0.6), walk=np.cumsum(simulated(3, level=0)) + 500)
    return features.prepare_features(demand, 2016, 2017, []).cache()


def test_grid_recovers_simulated_orders(prepared):
    fits = {(r["category"], r["p"], r["d"], r["q"]): r for r in arima.arima_candidates(prepared, "smoke").collect()}
    assert abs(fits["ar", 1, 0, 0]["ar"][0] - 0.7) < 0.1
    assert abs(fits["ma", 0, 0, 1]["ma"][0] - 0.6) < 0.12
    best = {r["category"]: r for r in arima.arima_select(prepared, "smoke").collect()}
    assert best["walk"]["d"] == 1 and best["ar"]["p"] == 1
    assert {k[1:] for k in fits} <= {(p, d, q) for p in (0, 1) for d in (0, 1) for q in (0, 1)} - {(0, 0, 0)}


def test_autoregression_fit_is_least_squares(prepared):
    fits = {r["category"]: r for r in arima.regression_candidates(prepared, "smoke").filter("p = 1 and d = 0 and q = 0").collect()}
    rows = prepared.filter("split = 'train'").orderBy("date").collect()
    for name, fit in fits.items():
        own = [r for r in rows if r["category"] == name]
        y = np.array([(r["sales"] - r["sales_min"]) / (r["sales_max"] - r["sales_min"]) for r in own])
        y, x = y[6:], y[5:-1]
        slope, constant = np.polyfit(x, y, 1)
        assert np.allclose([fit["ar"][0], fit["constant"]], [slope, constant], atol=1e-8)


def test_deviance_of_an_ar1_is_the_closed_form():
    y, phi, mean = simulated(11, ar=0.6, size=300) / 100, 0.55, 1.01
    w, n = y - mean, len(y)
    rest = (1 - phi**2) * w[0] ** 2 + ((w[1:] - phi * w[:-1]) ** 2).sum()
    theta = np.zeros((1, arma.WIDTH))
    theta[0, :2] = mean, phi
    closed = n * (np.log(2 * np.pi * rest / n) + 1) - np.log(1 - phi**2)
    assert arma.deviance(y[None], np.array([n]), theta)[0] == pytest.approx(closed, abs=1e-8)
    fitted, aic = arma.fits(y[None], np.array([[1, 0]]), np.array([True]))
    assert aic[0] == pytest.approx(arma.deviance(y[None], np.array([n]), fitted)[0] + 6, abs=1e-9) and aic[0] <= closed + 6


@pytest.mark.parametrize("ar,ma", [([0.5, -0.3], [1.7]), ([], [0.4, 2.0, -0.3]), ([0.9], [-1.0]), ([0.2, 0.1, 0.3], [0.5, 0.5, 0.1])])
def test_deviance_equals_the_dense_normal_density(ar, ma):
    """Non-invertible and borderline moving averages too; series of several lengths go together."""
    psi = [1.0]
    for k in range(1, 3000):
        psi.append((ma[k - 1] if k <= len(ma) else 0.0) + sum(a * psi[k - 1 - i] for i, a in enumerate(ar) if k > i))
    psi, theta = np.array(psi), np.zeros((1, arma.WIDTH))
    theta[0, 0], theta[0, 1 : 1 + len(ar)], theta[0, 4 : 4 + len(ma)] = 0.3, ar, ma
    sizes, y = [5, 60, 120], np.full((3, 120), np.nan)
    expected = []
    for row, n in zip(y, sizes):
        row[:n] = np.random.default_rng(n).normal(size=n)
        cover = np.array([psi[: len(psi) - h] @ psi[h:] for h in range(n)])[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
        w = row[:n] - 0.3
        expected.append(n * (np.log(2 * np.pi * (w @ np.linalg.solve(cover, w)) / n) + 1) + np.linalg.slogdet(cover)[1])
    assert np.allclose(arma.deviance(y, np.array(sizes), np.repeat(theta, 3, axis=0)), expected, atol=1e-6)


def test_larger_orders_never_fit_worse():
    y = simulated(13, ar=0.5, ma=0.4, size=150) / 100
    orders = np.array([(p, q) for p in range(4) for q in range(4)])
    _, aic = arma.fits(np.repeat(y[None], 16, axis=0), orders, np.ones(16, bool))
    own = (aic - 2 * (orders.sum(axis=1) + 2)).reshape(4, 4)
    assert (np.diff(own, axis=0) < 0.05).all() and (np.diff(own, axis=1) < 0.05).all()


def test_short_series_get_a_model(spark):
    demand = demand_of(spark, short=[5.0, 7, 6, 9, 8, 11, 10, 12] * 2, tiny=[1.0, 2.0] * 2)
    prepared = features.prepare_features(demand, 2016, 2017, [])
    best = {r["category"]: r for r in arima.arima_select(prepared, "full").collect()}
    assert np.isfinite(best["short"]["aic"]) and len(best["short"]["ar"]) == best["short"]["p"]
    assert arima.arima_roll(arima.arima_select(prepared, "full"), prepared).filter("category = 'short'").count() == 8


@pytest.mark.parametrize("chunk", [1, 2, 7, 512])
def test_chunked_scan_equals_the_plain_recursion(spark, chunk):
    values = simulated(14, ar=0.3, ma=0.5, size=90)
    prepared = features.prepare_features(demand_of(spark, a=values, b=values[::-1]), 2016, 2017, [])
    fit = spark.createDataFrame([(c, -1.0, 1, 0, 3, 0.1, [0.3], [0.4, -0.9, 1.2]) for c in "ab"],
                                "category string, aic double, p int, d int, q int, constant double, ar array<double>, ma array<double>")
    found = {(r["category"], r["date"]): r["predicted_norm"] for r in arima.arima_roll(fit, prepared, chunk=chunk).collect()}
    for name, own in (("a", values), ("b", values[::-1])):
        low, high = own[:45].min(), own[:45].max()
        y, e, expected = (own - low) / (high - low), [0.0] * 3, []
        for t in range(1, 90):
            guess = 0.1 + 0.3 * y[t - 1] + 0.4 * e[-1] - 0.9 * e[-2] + 1.2 * e[-3]
            e.append(y[t] - guess)
            expected.append(guess)
        mine = [v for (c, _), v in sorted(found.items()) if c == name]
        assert np.allclose(mine, expected[44:], rtol=1e-7)


def test_rolling_forecast_uses_only_the_past(spark, prepared):
    best = arima.arima_select(prepared, "smoke")
    rows = arima.arima_roll(best, prepared).collect()
    assert len(rows) == prepared.filter("split = 'test'").count()
    cut = prepared.filter((F.col("split") == "train") | (F.col("pos") <= 100))
    early = {(r["category"], r["date"]): r["predicted"] for r in arima.arima_roll(best, cut).collect()}
    late = {(r["category"], r["date"]): r["predicted"] for r in rows}
    assert early and all(abs(late[k] - v) < 1e-9 for k, v in early.items())


def test_rolling_forecast_equals_a_hand_recursion(spark):
    values = simulated(4, ma=0.5, size=80)
    prepared = features.prepare_features(demand_of(spark, a=values), 2016, 2017, [])
    fit = spark.createDataFrame([("a", -1.0, 1, 0, 1, 0.3, [0.2], [0.4])],
                                "category string, aic double, p int, d int, q int, constant double, ar array<double>, ma array<double>")
    found = [r["predicted_norm"] for r in arima.arima_roll(fit, prepared).orderBy("date").collect()]
    low, high = values[:40].min(), values[:40].max()
    y, e, expected = (values - low) / (high - low), 0.0, []
    for t in range(1, 80):
        guess = 0.3 + 0.2 * y[t - 1] + 0.4 * e
        e = y[t] - guess
        expected.append(guess)
    assert np.allclose(found, expected[39:], atol=1e-9)


def test_constant_series_has_no_arima_fit(spark):
    prepared = features.prepare_features(demand_of(spark, flat=[3.0] * 80), 2016, 2017, [])
    assert arima.arima_select(prepared, "smoke").count() == 0


def test_unobserved_targets_are_masked_at_the_end(spark):
    values = list(simulated(5, ar=0.5, size=120))
    values[70] = None
    prepared = features.prepare_features(demand_of(spark, a=values), 2016, 2017, [])
    assert arima.arima_roll(arima.arima_select(prepared, "smoke"), prepared).count() == 59


def test_lstm_gradient_against_differences():
    rng = np.random.default_rng(0)
    theta = rng.uniform(-0.3, 0.3, lstm.PARAMETERS)
    x, y = rng.random((6, 3)), rng.random(6)
    _, gradient = lstm.lstm_pass(theta, x, lambda out: 2 * (out - y))

    def loss(parameters):
        return np.sum((lstm.lstm_pass(parameters, x) - y) ** 2)

    for i in [*rng.integers(0, lstm.PARAMETERS, 40), 0, 130, lstm.PARAMETERS - 1]:
        step = np.zeros(lstm.PARAMETERS)
        step[i] = 1e-5
        assert abs((loss(theta + step) - loss(theta - step)) / 2e-5 - gradient[i]) < 1e-6


@pytest.fixture(scope="module")
def supervised(spark):
    demand = demand_of(spark, a=simulated(6, ar=0.8, size=160), b=simulated(7, size=160))
    return features.make_supervised(features.prepare_features(demand, 2016, 2017, []), [1, 2, 3], []).cache()


def test_lstm_is_repeatable_and_learns(spark, supervised, monkeypatch):
    first = lstm.train_lstm(supervised, [1, 2, 3], [42, 43], "smoke").orderBy("category", "seed").collect()
    again = lstm.train_lstm(supervised.repartition(1), [1, 2, 3], [42, 43], "smoke").orderBy("category", "seed").collect()
    assert first == again and len(first) == 4
    assert first[0]["epochs"] <= 5 and first[0]["best"] != first[1]["best"]


def test_lstm_epochs_equal_a_plain_adam_loop(spark, supervised):
    found = lstm.train_lstm(supervised, [1, 2, 3], [42], "smoke").filter("category = 'a'").first()
    rows = lstm.numbered(supervised, "train").filter("category = 'a'").orderBy("date").collect()
    x = np.array([[r["sales_lag_3"], r["sales_lag_2"], r["sales_lag_1"]] for r in rows])
    y = np.array([r["target_norm"] for r in rows])
    split = int(len(x) * 0.8)
    start = lstm.first_state(lstm.numbered(supervised, "train"), [42]).filter("category = 'a'").first()
    theta, m, v, losses = np.array(start["theta"]), 0.0, 0.0, []
    for t in range(1, found["epochs"] + 1):
        _, g = lstm.lstm_pass(theta, x[:split], lambda out: 2 * (out - y[:split]) / split)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 1e-3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        losses.append(np.mean((lstm.lstm_pass(theta, x[split:]) - y[split:]) ** 2))
    assert start["split"] == split and abs(min(losses) - found["best_loss"]) < 1e-9


def test_lstm_forecast_covers_the_test_rows(supervised):
    models = lstm.train_lstm(supervised, [1, 2, 3], [42], "smoke")
    rows = lstm.lstm_forecast(supervised, models, [1, 2, 3])
    assert rows.count() == supervised.filter("split = 'test'").count()
    assert rows.filter("predicted_norm is null or predicted is null").count() == 0

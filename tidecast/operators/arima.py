"""ARIMA: order search by exact likelihood, rolling forecasts as a scan, and a regression form of the grid.

`arima_candidates` fits every order of a series by the exact likelihood of `arma`: one row per (series,
order) with the values of the training year, at most 366, so a search is spread over tasks by series and order.

`regression_candidates` is the two-step least-squares form (Hannan-Rissanen) for series of any length: a
long autoregression estimates the innovations, then one matrix of cross products per (series, d) holds every
(p, q) candidate as a sub-block. Rows are never gathered there.

The forecast recursion with moving-average terms is an affine map of the last innovations. Chunks of a
series are walked from zero, their maps are composed in time order, and each chunk is then corrected for the
innovations it really starts from; so a long series is many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.scalars import scale_col
from tidecast.operators import arma
from tidecast.operators.features import TRAIN
from tidecast.operators.forecasts import tagged, to_both_scales
from tidecast.operators.rounds import durable, task_count

FIT_TYPE = "array<struct<p:int,d:int,q:int,aic:double,constant:double,ar:array<double>,ma:array<double>>>"


def order_bound(profile: str) -> int:
    return 1 if profile == "smoke" else 3


def in_time():
    """Both years of a series, the training year first: positional time."""
    return Window.partitionBy("category", "d").orderBy("turn", "date")


def differenced(prepared: DataFrame) -> DataFrame:
    """Scaled series for d = 0 and d = 1: (category, d, split, date, pos, turn, y, w), w the differenced y."""
    y = scale_col(F.col("sales"), F.col("sales_min"), F.col("sales_max"))
    both = prepared.select(
        "category", "split", "date", "pos", F.when(F.col("split") == TRAIN, 0).otherwise(1).alias("turn"),
        y.alias("y"), F.explode(F.array(F.lit(0), F.lit(1))).alias("d"),
    )
    return both.withColumn("w", F.when(F.col("d") == 0, F.col("y")).otherwise(F.col("y") - F.lag("y").over(in_time())))


def cross_products(columns: list[str]) -> list[Column]:
    """Aggregates of the upper triangle of X'X."""
    return [
        F.sum(F.col(a) * F.col(b)).alias(f"s_{i}_{j}")
        for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j
    ]


def triangle(width: int) -> Column:
    return F.array(*[F.col(f"s_{i}_{j}") for i in range(width) for j in range(i, width)])


def square(cells, width: int):
    full = np.zeros((width, width))
    full[np.triu_indices(width)] = cells
    return full + np.triu(full, 1).T


def least_squares(gram, used: list[int]):
    """Coefficients and residual sum of squares of column 0 on `used`; None if they are dependent."""
    block, moment = gram[np.ix_(used, used)], gram[used, 0]
    if not used:
        return np.zeros(0), gram[0, 0]
    if not np.isfinite(block).all() or np.linalg.cond(block) > 1e12:
        return None
    found = np.linalg.solve(block, moment)
    return found, gram[0, 0] - found @ moment


def long_autoregression(lags: int) -> Column:
    """array<double>: constant and lag coefficients of the first regression, NULL if unsolvable."""

    def solve(cells: pd.Series, d: pd.Series) -> pd.Series:
        answers = []
        for row, order in zip(cells, d, strict=True):
            # Columns: w, constant, lags. A differenced series has no constant.
            used = list(range(1 if order == 0 else 2, lags + 2))
            fit = least_squares(square(row, lags + 2), used)
            answers.append(None if fit is None else [0.0] * (lags + 1 - len(used)) + list(fit[0]))
        return pd.Series(answers)

    solve.__annotations__ = {"cells": pd.Series, "d": pd.Series, "return": pd.Series}
    return F.pandas_udf(solve, "array<double>")(triangle(lags + 2), F.col("d"))


def order_fits(bound: int) -> Column:
    """All (p, q) fits of one (series, d) that solve, are invertible and have a finite AIC."""
    width = 2 + 2 * bound

    def solve(cells: pd.Series, d: pd.Series, rows: pd.Series) -> pd.Series:
        answers = []
        for row, order, n in zip(cells, d, rows, strict=True):
            gram, fits = square(row, width), []
            for p in range(bound + 1):
                for q in range(bound + 1):
                    constant = 1 - int(order)
                    if p == q == 0 and constant:
                        continue
                    used = [1] * constant + [2 + i for i in range(p)] + [2 + bound + i for i in range(q)]
                    fit = least_squares(gram, used)
                    if fit is None or fit[1] <= 1e-12 * max(n, 1) or n <= len(used) + 1:
                        continue
                    ma = fit[0][constant + p :]
                    if q and np.max(np.abs(np.roots([1.0, *ma]))) >= 0.999:
                        continue
                    aic = n * (np.log(2 * np.pi * fit[1] / n) + 1) + 2 * (len(used) + 1)
                    fits.append({"p": p, "d": int(order), "q": q, "aic": float(aic),
                                 "constant": float(fit[0][0]) if constant else 0.0,
                                 "ar": [float(v) for v in fit[0][constant : constant + p]], "ma": [float(v) for v in ma]})
            answers.append(fits)
        return pd.Series(answers)

    solve.__annotations__ = {"cells": pd.Series, "d": pd.Series, "rows": pd.Series, "return": pd.Series}
    return F.pandas_udf(solve, FIT_TYPE)(triangle(width), F.col("d"), F.col("rows"))


def innovations(train: DataFrame, lags: int) -> DataFrame:
    """Training rows with `e`, the residual of a long autoregression per (category, d)."""
    names = [f"w_{k}" for k in range(1, lags + 1)]
    lagged = train.select("*", *[F.lag("w", k).over(in_time()).alias(f"w_{k}") for k in range(1, lags + 1)])
    complete = lagged.filter(F.col(names[-1]).isNotNull()).withColumn("one", F.lit(1.0))
    columns = ["w", "one", *names]
    grams = complete.groupBy("category", "d").agg(*cross_products(columns))
    coefficients = grams.select("category", "d", long_autoregression(lags).alias("long"))
    fitted = F.get("long", F.lit(0))
    for i, name in enumerate(names):
        fitted = fitted + F.col(name) * F.get("long", F.lit(i + 1))
    # Coefficients are joined back by series, one row per (category, d).
    return complete.join(coefficients, ["category", "d"]).withColumn("e", F.col("w") - fitted)


def arima_candidates(prepared: DataFrame, profile: str = "full", batch: int = 128) -> DataFrame:
    """Every usable fit by exact likelihood: (category, p, d, q, aic, constant, ar, ma), on the training scale.

    A series without differencing has a mean, a differenced one has none; `constant` is the intercept of the
    recursion. Candidates need more rows than parameters and a residual that is not zero; moving-average parts
    may be non-invertible.
    """
    bound = order_bound(profile)
    orders = [(p, d, q) for p in range(bound + 1) for d in range(2) for q in range(bound + 1) if p or d or q]
    train = differenced(prepared).filter((F.col("split") == TRAIN) & F.col("w").isNotNull())
    # one group is the training year of a series, which the contract keeps to 366 days
    series = train.groupBy("category", "d").agg(F.sort_array(F.collect_list(F.struct("date", "w"))).alias("rows"))
    listed = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("of_d"), F.lit(q).alias("q")) for p, d, q in orders])
    each = series.select("category", "d", F.col("rows.w").alias("w"), F.inline(listed)).filter("d = of_d")
    tasks = task_count(prepared.sparkSession)
    each = each.select("category", "p", "d", "q", "w").repartition(tasks, "category", "p", "d", "q")

    def run(batches):
        for whole in batches:
            for i in range(0, len(whole), batch):
                part = whole.iloc[i : i + batch]
                y = np.full((len(part), max(map(len, part["w"]))), np.nan)
                for row, values in zip(y, part["w"]):
                    row[: len(values)] = values
                orders_, level = part[["p", "q"]].to_numpy(), part["d"].to_numpy() == 0
                theta, aic = arma.fits(y, orders_, level)
                rows = part["w"].map(len).to_numpy() > orders_.sum(axis=1) + level + 1
                good = rows & np.isfinite(aic) & (np.nanvar(y, axis=1) > 1e-24)
                yield pd.DataFrame({
                    "category": part["category"], "p": part["p"], "d": part["d"], "q": part["q"], "aic": aic,
                    "constant": theta[:, 0] * (1 - theta[:, 1 : 1 + arma.BOUND].sum(axis=1)),
                    "ar": [list(t[1 : 1 + p]) for t, p in zip(theta, part["p"])],
                    "ma": [list(t[1 + arma.BOUND : 1 + arma.BOUND + q]) for t, q in zip(theta, part["q"])],
                })[good]

    schema = "category string, p int, d int, q int, aic double, constant double, ar array<double>, ma array<double>"
    return each.mapInPandas(run, schema)


def regression_candidates(prepared: DataFrame, profile: str = "full") -> DataFrame:
    """Every usable fit of the two-step regressions: (category, p, d, q, aic, constant, ar, ma), on the training scale."""
    bound = order_bound(profile)
    series = differenced(prepared)
    train = series.filter(F.col("split") == TRAIN)
    rows = innovations(train, 2 * bound + 2).select("category", "d", "turn", "date", "pos", "w", "e")
    lagged = rows.select(
        "*", F.lit(1.0).alias("one"),
        *[F.lag(c, k).over(in_time()).alias(f"{c}_{k}") for c in ("w", "e") for k in range(1, bound + 1)],
    )
    # A sample common to d = 0 and d = 1, whose first difference is missing.
    first = 2 * bound + 2 + bound + 1
    sample = lagged.filter(F.col("pos") > first)
    columns = ["w", "one", *[f"w_{k}" for k in range(1, bound + 1)], *[f"e_{k}" for k in range(1, bound + 1)]]
    grams = sample.groupBy("category", "d").agg(F.count(F.lit(1)).alias("rows"), *cross_products(columns))
    return grams.select("category", F.inline(order_fits(bound)))


def arima_select(prepared: DataFrame, profile: str = "full") -> DataFrame:
    """Best fit per series: least AIC, the first in p, d, q order among equals."""
    fit = F.struct("aic", "p", "d", "q", "constant", "ar", "ma")
    best = arima_candidates(prepared, profile).groupBy("category").agg(
        F.min_by(fit, F.struct("aic", "p", "d", "q")).alias("fit"))
    return best.select("category", "fit.*")


def ar_ols(prepared: DataFrame) -> DataFrame:
    """AR(1) with a constant by least squares on the training rows, and its one-step test forecast."""
    turn = F.when(F.col("split") == TRAIN, 0).otherwise(1)
    by_time = Window.partitionBy("category").orderBy(turn, "date")
    lagged = prepared.withColumn("before", F.lag("sales").over(by_time))
    in_train = (F.col("split") == TRAIN) & F.col("before").isNotNull()
    fits = lagged.filter(in_train).groupBy("category").agg(
        F.regr_slope("sales", "before").alias("slope"), F.regr_intercept("sales", "before").alias("intercept"))
    test = lagged.filter((F.col("split") != TRAIN) & F.col("target_observed"))
    return test.join(fits, "category").select(
        "category", "date", "slope", "intercept", (F.col("intercept") + F.col("slope") * F.col("before")).alias("predicted"))


def shocks(u: np.ndarray, ma: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Innovations e[t] = u[t] - ma[0] e[t-1] - ma[1] e[t-2] ..., after the innovations `before`, newest first."""
    e, last = np.zeros(len(u)), list(before)
    for t, value in enumerate(u.tolist()):
        now = value - float(np.dot(ma, last)) if len(ma) else value
        e[t] = now
        last = [now, *last[:-1]] if len(ma) else last
    return e


def carried(ma: np.ndarray, steps: int) -> np.ndarray:
    """What becomes of the innovations before a chunk after so many steps, as a matrix on (newest, ..., oldest)."""
    move = np.eye(len(ma), k=-1)
    if len(ma):
        move[0] = -ma
    return np.linalg.matrix_power(move, steps)


def newest(e: np.ndarray, q: int) -> list[float]:
    """The last q innovations, newest first; those before the chunk count as 0."""
    own = e[::-1][:q].tolist()
    return own + [0.0] * (q - len(own))


def arima_roll(best: DataFrame, prepared: DataFrame, chunk: int = 512) -> DataFrame:
    """One-step test forecasts: each filled observation enters the history after its forecast.

    Parameters stay as fitted. Unobserved targets are masked at the end only. A series is cut into chunks of
    `chunk` rows; only one row per chunk, of q numbers and a q x q map, is brought into time order.
    """
    tasks = task_count(prepared.sparkSession)
    lags = [F.coalesce(F.lag("w", k).over(in_time()), F.lit(0.0)).alias(f"w_{k}") for k in range(1, arma.BOUND + 1)]
    at = (F.row_number().over(in_time()) - 1).alias("at")
    rows = differenced(prepared).select("*", *lags, at).join(best, ["category", "d"])
    w = F.coalesce("w", F.lit(0.0))
    expected = F.col("constant")
    for k in range(1, arma.BOUND + 1):
        expected = expected + F.coalesce(F.get("ar", F.lit(k - 1)), F.lit(0.0)) * F.col(f"w_{k}")
    begun = F.col("at") >= F.greatest(F.size("ar") + F.col("d"), F.lit(1))
    rows = rows.withColumn("u", F.when(begun, w - expected).otherwise(F.lit(0.0))).withColumn("chunk", F.expr(f"at div {chunk}"))
    packed = rows.groupBy("category", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("at", "date", "y", "u", begun.alias("begun")))).alias("rows"), F.first("ma").alias("ma"),
    )

    def mapped(cells: pd.Series, ma: pd.Series) -> pd.Series:
        made = []
        for own, coefficients in zip(cells, ma, strict=True):
            coefficients = np.asarray(coefficients, float)
            e = shocks(np.asarray(own, float), coefficients, np.zeros(len(coefficients)))
            made.append([*newest(e, len(coefficients)), *carried(coefficients, len(own)).ravel()])
        return pd.Series(made)

    def composed(maps: pd.Series, ma: pd.Series) -> pd.Series:
        """Innovations before each chunk: the maps of all chunks before it, one after the other."""
        made = []
        for own, coefficients in zip(maps, ma, strict=True):
            q, state, before = len(coefficients), np.zeros(len(coefficients)), []
            for cell in own:
                before.append(state.tolist())
                cell = np.asarray(cell, float)
                state = cell[:q] + cell[q:].reshape(q, q) @ state
            made.append(before)
        return pd.Series(made)

    def corrected(cells: pd.Series, ma: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([
            shocks(np.asarray(u, float), np.asarray(m, float), np.asarray(b, float)).tolist()
            for u, m, b in zip(cells, ma, before, strict=True)
        ])

    for fn, names in ((mapped, ["cells", "ma"]), (composed, ["maps", "ma"]), (corrected, ["cells", "ma", "before"])):
        fn.__annotations__ = {**{n: pd.Series for n in names}, "return": pd.Series}
    packed = durable(packed.repartition(tasks, "category", "chunk"))
    maps = packed.select("category", "chunk", "ma", F.pandas_udf(mapped, "array<double>")(F.col("rows.u"), F.col("ma")).alias("map"))
    ordered = maps.groupBy("category").agg(
        F.sort_array(F.collect_list(F.struct("chunk", "map"))).alias("maps"), F.first("ma").alias("ma"))
    starts = ordered.select(
        "category", F.arrays_zip(F.col("maps.chunk").alias("chunk"), F.pandas_udf(composed, "array<array<double>>")(
            F.col("maps.map"), F.col("ma")).alias("before")).alias("cells"),
    ).select("category", F.inline("cells")).toDF("category", "chunk", "before")
    walked = packed.join(starts, ["category", "chunk"]).withColumn(
        "e", F.pandas_udf(corrected, "array<double>")(F.col("rows.u"), F.col("ma"), F.col("before")))
    one = walked.select("category", F.inline(F.arrays_zip("rows", "e"))).select("category", "rows.*", "e")
    forecast = one.filter("begun").select("category", "date", (F.col("y") - F.col("e")).alias("predicted_norm"))
    kept = prepared.filter((F.col("split") != TRAIN) & F.col("target_observed")).select("category", "date", "sales_min", "sales_max")
    return tagged(to_both_scales(kept.join(forecast, ["category", "date"])), "arima")


def arima_details() -> Column:
    order = F.concat_ws(",", "p", "d", "q")
    return F.create_map(F.lit("order"), order, F.lit("aic"), F.col("aic").cast("string"),
                        F.lit("protocol"), F.lit("rolling_one_step"))

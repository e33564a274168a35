"""SQL counterparts of the registered queries, for the DuckDB views of the same tables."""

from __future__ import annotations

import json
from dataclasses import asdict

from catalog import fuzzy_inputs as fx
from catalog.inputs import COVARIATES, LAGS, PERIOD, PRICE_UNIT, TEST_YEAR, TRAIN_YEAR, WIDE_BRANDS, WIDE_YEARS
from catalog.rounding import r, rs
from tidecast.plans.config import FuzzyConfig

ORACLES: dict[str, str] = {}

METRICS = ["rmse", "mae", "mase", "smape", "rmse_norm", "mae_norm"]
WEATHER = ["avg_temp", "max_temp", "min_temp", "humidity", "rainfall"]
FEATURES = ["sales", *COVARIATES]

# ---- derived tables as common table expressions: name -> (names it needs, body)

CTES: dict[str, tuple[list[str], str]] = {}

CTES["demand"] = ([], f"""
select s.date, s.category, case when day(s.date) = 13 then null else s.sales end as sales,
       {", ".join("w." + c for c in WEATHER)}
from (select p_brand as category, cast(l_shipdate as date) as date, sum(l_quantity) as sales
      from lineitem join part on l_partkey = p_partkey group by p_brand, cast(l_shipdate as date)) s
left join (select cast(o_orderdate as date) as date,
                  avg(o_totalprice) / {PRICE_UNIT} as avg_temp, max(o_totalprice) / {PRICE_UNIT} as max_temp,
                  min(o_totalprice) / {PRICE_UNIT} as min_temp,
                  cast(100 as double) * avg(cast(o_orderstatus = 'F' as integer)) as humidity,
                  cast(count(*) filter (where o_orderpriority = '1-URGENT') as double) as rainfall
           from orders group by cast(o_orderdate as date)) w on s.date = w.date""")

CTES["holdout"] = (["demand"], f"""
select *, case year(date) when {TRAIN_YEAR} then 'train' else 'test' end as split
from demand where year(date) in ({TRAIN_YEAR}, {TEST_YEAR})""")

CTES["located"] = (["holdout"], f"""
select category, split, date, sales is not null as target_observed,
       row_number() over w as pos, {", ".join(FEATURES)},
       {", ".join(f"last_value({c} ignore nulls) over (w rows between unbounded preceding and current row) as {c}_forward" for c in FEATURES)}
from holdout window w as (partition by category, split order by date)""")

CTES["medians"] = (["holdout"], f"""
select category, {", ".join(f"median({c}) as {c}_median" for c in FEATURES)}
from holdout where split = 'train' group by category""")

CTES["filled"] = (["located", "medians"], f"""
select category, split, date, pos, target_observed,
       {", ".join(f"coalesce({c}_forward, {c}_median) as {c}" for c in FEATURES)}
from located join medians using (category)""")

CTES["scales"] = (["filled"], f"""
select category, {", ".join(f"min({c}) as {c}_min, max({c}) as {c}_max" for c in FEATURES)}
from filled where split = 'train' group by category""")

CTES["prepared"] = (["filled", "scales"], "select * from filled join scales using (category)")


def scaled(value: str, name: str) -> str:
    return f"(({value}) - {name}_min) / greatest({name}_max - {name}_min, cast(1e-12 as double))"


def clipped(value: str) -> str:
    return f"greatest(cast(0 as double), least(cast(1 as double), {value}))"


CTES["supervised"] = (["prepared"], f"""
select * from (
  select category, split, date, pos, target_observed, sales as target, {scaled("sales", "sales")} as target_norm,
         {", ".join(f"{clipped(scaled(f'lag(sales, {k}) over w', 'sales'))} as sales_lag_{k}" for k in LAGS)},
         {", ".join(f"{clipped(scaled(c, c))} as {c}" for c in COVARIATES)}, sales_min, sales_max
  from prepared window w as (partition by category, split order by date)) x
where pos > {max(LAGS)} and target_observed""")

CTES["naive"] = (["prepared"], f"""
select category, 'seasonal_naive' as model, 'sales_only' as variant, 'spark' as backend,
       cast(null as bigint) as seed, date, predicted, {scaled("predicted", "sales")} as predicted_norm
from (select *, lag(sales, {PERIOD}) over (partition by category order by date) as predicted
      from prepared where split = 'test') x
where target_observed and pos > {PERIOD}""")

CTES["mase"] = (["prepared"], f"""
select category, nullif(avg(abs(sales - earlier)), 0) as mase_scale
from (select category, sales, lag(sales, {PERIOD}) over (partition by category order by date) as earlier
      from prepared where split = 'train') x group by category""")

CTES["aligned"] = (["supervised", "naive", "mase"], f"""
select n.*, s.target, s.target_norm, m.mase_scale
from supervised s join naive n on s.category = n.category and s.date = n.date
join mase m on m.category = s.category
where s.split = 'test' and s.pos > {PERIOD}""")

CTES["seeded"] = (["aligned"], """
select * from aligned
union all by name
select category, 'efs' as model, variant, backend, seed, date, predicted * factor as predicted,
       predicted_norm * factor as predicted_norm, target, target_norm, mase_scale
from (select a.category, a.backend, a.date, a.predicted, a.predicted_norm, a.target, a.target_norm,
             a.mase_scale, v.variant, v.seed, 1 + (v.seed - 43) * cast(0.01 as double) - v.shift as factor
      from aligned a cross join (
        select variant, shift, cast(seed as bigint) as seed
        from (values ('sales_only', cast(0 as double)), ('target_weather', cast(0.03 as double))) t(variant, shift)
        cross join (values (42), (43), (44)) u(seed)) v) x""")

KEYS = "category, model, variant, backend, seed"

ERRORS = """
sqrt(avg((predicted - target) * (predicted - target))) as rmse,
avg(abs(predicted - target)) as mae,
avg(abs(predicted - target)) / max(mase_scale) as mase,
100 * avg(case when abs(target) + abs(predicted) > 0
          then abs(predicted - target) / ((abs(target) + abs(predicted)) / 2) else 0 end) as smape,
count(*) as n,
sqrt(avg((predicted_norm - target_norm) * (predicted_norm - target_norm))) as rmse_norm,
avg(abs(predicted_norm - target_norm)) as mae_norm"""

CTES["metrics"] = (["seeded"], f"select {KEYS}, {ERRORS} from seeded group by {KEYS}")

CTES["predictions"] = (["seeded"], f"""
select {KEYS}, date, target as actual, predicted, target_norm as actual_norm, predicted_norm from seeded""")



def billionths(value: str) -> str:
    """A double as a whole number of billionths."""
    return f"cast(floor({value} * cast(1e9 as double) + cast(0.5 as double)) as hugeint)"


def fixed_mean(value: str) -> str:
    """Mean from the exact sum of billionths, in the operations of the query."""
    return f"cast(sum({billionths(value)}) as double) / cast(1e9 as double) / count({value})"


def fixed_std(value: str) -> str:
    """Sample deviation from exact sums: s = m * n + r leaves (q - m * (s + r)) - r * r / n."""
    u, n = billionths(value), f"nullif(cast(count({value}) as hugeint), 1)"
    s, q = f"cast(sum({u}) as hugeint)", f"cast(sum({u} * {u}) as hugeint)"
    r = f"cast({s} % {n} as double)"
    whole, half = f"({q} - ({s} // {n}) * ({s} + {s} % {n}))", f"cast({10**19} as hugeint)"
    rest = f"cast({whole} // {half} as double) * cast(1e19 as double) + cast({whole} % {half} as double)"
    spread = f"({rest} - {r} * {r} / count({value})) / (count({value}) - 1)"
    return f"case when count({value}) > 1 then sqrt(greatest({spread}, 0)) / cast(1e9 as double) end"


CTES["macro"] = (["metrics"], f"""
select model, variant, backend, seed, {", ".join(f"{fixed_mean(m)} as {m}" for m in METRICS)}
from metrics group by model, variant, backend, seed""")


def pair_columns() -> list[str]:
    cells = []
    for m in METRICS:
        cells += [f"s.{m} as {m}_sales_only", f"w.{m} as {m}_target_weather",
                  f"case when s.{m} <> 0 then 100 * (s.{m} - w.{m}) / s.{m} end as {m}_improvement_pct"]
    return cells


ABLATION_COLUMNS = [f"{m}_{x}" for m in METRICS for x in ("sales_only", "target_weather", "improvement_pct")]

CTES["ablation"] = (["metrics"], f"""
select s.category, s.backend, s.seed, {", ".join(pair_columns())}
from metrics s join metrics w on s.category = w.category and s.model = w.model and s.backend = w.backend
     and s.seed is not distinct from w.seed
where s.model = 'efs' and s.variant = 'sales_only' and w.variant = 'target_weather'""")

CTES["raw"] = (["demand"], """
select case when day(date) = 8 then 'day ' || cast(date as varchar) else cast(date as varchar) end as date,
       case when day(date) = 5 then '  ' || category || ' ' when day(date) = 6 then '   ' else category end as category,
       case when day(date) = 5 then 'NA' when day(date) = 7 then '-1' else cast(sales as varchar) end as sales,
       cast(avg_temp as varchar) as avg_temp, cast(max_temp as varchar) as max_temp,
       cast(min_temp as varchar) as min_temp,
       case when day(date) = 9 then '101' else cast(humidity as varchar) end as humidity,
       case when day(date) = 10 then '-0.5' else cast(rainfall as varchar) end as rainfall
from demand cross join (values (1), (2)) t(copy) where copy = 1 or day(date) = 28""")

CTES["coerced"] = (["raw"], f"""
select try_cast(date as date) as date, trim(category) as category,
       {", ".join(f"try_cast({c} as double) as {c}" for c in ["sales", *WEATHER])} from raw""")


def needed(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            needed(CTES[name][0], seen)
            seen.append(name)
    return seen


# Date columns of the results, given as ISO text like those of the queries.
DATES = {"split_years": ["first_day", "last_day"]}
DATES |= {name: ["date"] for name in (
    "coerce_demand", "demand_violations", "wide_to_long", "fill_forward", "lag_features", "unscale_targets",
    "evaluation_dates", "seasonal_naive", "align_forecasts", "predictions_table", "forecast_lines", "actual_line",
    "forecast_pivot", "preview_demand", "predict_saved", "series_predictions", "ar_ols", "arima_fixed_roll")}


def oracle(name: str, uses: list[str], select: str) -> None:
    parts = ",\n".join(f"{n} as ({CTES[n][1]})" for n in needed([u for u in uses if u != "recursive"], []))
    if name in DATES:
        texts = ", ".join(f"cast({d} as varchar) as {d}" for d in DATES[name])
        select = f"select * replace ({texts}) from ({select}) typed"
    ORACLES[name] = f"with {'recursive ' if 'recursive' in uses else ''}{parts}\n{select}"


# ---- contract and reshape

oracle("coerce_demand", ["coerced"], f"select date, category, {rs(['sales', *WEATHER])} from coerced")

oracle("validation_report", ["coerced"], f"""
select 'total' as section, 'rows' as item, count(*) as value from coerced
union all select 'total', 'invalid_dates', count(*) from coerced where date is null
union all select 'total', 'empty_categories', count(*) from coerced where category is null or category = ''
union all select 'total', 'duplicate_rows', cast(coalesce(sum(n - 1), 0) as bigint)
  from (select count(*) as n from coerced group by date, category) d
union all select 'broken', 'sales values must be non-negative', cast(coalesce(max(cast(sales < 0 as integer)), 0) as bigint) from coerced
union all select 'broken', 'humidity must be between 0 and 100', cast(coalesce(max(cast(humidity not between 0 and 100 as integer)), 0) as bigint) from coerced
union all select 'broken', 'rainfall must be non-negative', cast(coalesce(max(cast(rainfall < 0 as integer)), 0) as bigint) from coerced
{" ".join(f"union all select 'missing', '{c}', count(*) from coerced where {c} is null" for c in ["date", "category", "sales", *WEATHER])}
union all select 'year', cast(year(date) as varchar), count(*) from coerced where date is not null group by year(date)
union all select 'few_years', 'years', count(distinct year(date)) from coerced having count(distinct year(date)) < 2
union all select 'category', category, count(*) from coerced where category is not null group by category
union all select 'short_category', category, count(*) from coerced group by category having count(*) < 10""")

oracle("demand_violations", ["coerced"], f"""
select date, category, {r("sales", "sales")}, violations from (
  select date, category, sales, concat_ws('; ',
    case when date is null then 'invalid date' end,
    case when category is null or category = '' then 'empty category' end,
    case when sales < 0 then 'sales values must be non-negative' end,
    case when humidity < 0 or humidity > 100 then 'humidity must be between 0 and 100' end,
    case when rainfall < 0 then 'rainfall must be non-negative' end) as violations
  from coerced) x where violations <> ''""")

CTES["wide_cells"] = (["demand"], f"""
select d, m, y, brand, name
from (select distinct day(date) as d, month(date) as m from demand) k
cross join (values {", ".join(f"({y})" for y in WIDE_YEARS)}) t(y)
cross join (values {", ".join(f"('{b}', '{n.replace('insecticide control', 'insect repellent')}')" for b, n in WIDE_BRANDS.items())}) u(brand, name)""")
oracle("wide_to_long", ["wide_cells"], f"""
select try_cast(y || '-' || lpad(cast(m as varchar), 2, '0') || '-' || lpad(cast(d as varchar), 2, '0') as date) as date,
       name as category, {r("s.sales", "sales")}, {", ".join(r("w." + c, c) for c in WEATHER[:-1])},
       {r("case when y <> 1997 then w.rainfall end", "rainfall")}
from wide_cells c
left join demand s on s.category = brand and day(s.date) = d and month(s.date) = m and year(s.date) = y
left join (select date, {", ".join(f"max({c}) as {c}" for c in WEATHER)} from demand group by date) w
  on day(w.date) = d and month(w.date) = m and year(w.date) = y""")

# ---- features

oracle("split_years", ["holdout"], """
select category, split, count(*) as days, min(date) as first_day, max(date) as last_day
from holdout group by category, split""")

oracle("fit_medians", ["medians"], " union all ".join(
    f"select category, '{c}' as feature, {r(f'{c}_median', 'median')} from medians" for c in FEATURES))

oracle("fit_scales", ["scales"], " union all ".join(
    f"select category, '{c}' as feature, {r(f'{c}_min', 'minimum')}, {r(f'{c}_max', 'maximum')} from scales"
    for c in FEATURES))

oracle("fill_forward", ["filled"],
       f"select category, split, date, target_observed, {rs(FEATURES)} from filled")

oracle("lag_features", ["supervised"], f"""
select category, split, date, {rs(['target', 'target_norm', *[f'sales_lag_{k}' for k in LAGS], *COVARIATES])}
from supervised""")

oracle("unscale_targets", ["supervised"], f"""select category, date, {rs(["target"])} from supervised""")

oracle("evaluation_dates", ["prepared"],
       f"select category, date from prepared where split = 'test' and pos > {PERIOD}")

oracle("select_categories", ["demand"], f"""
select category, count(*) as days, {r("sum(sales)", "sales")} from demand
where category in ('Brand#3', 'Brand#11', 'Brand#25') group by category""")

oracle("series_problems", ["demand"], """
select * from (
select category, case
    when count(*) filter (where year(date) = 1997) = 0 or count(*) filter (where year(date) = 2001) = 0
      then category || ': both 1997 and 2001 data are required'
    when count(sales) filter (where year(date) = 1997) = 0 then category || ': training column sales has no usable values'
    when count(avg_temp) filter (where year(date) = 1997) = 0 then category || ': training column avg_temp has no usable values'
    when count(humidity) filter (where year(date) = 1997) = 0 then category || ': training column humidity has no usable values'
    when count(rainfall) filter (where year(date) = 1997 and not num < 4) = 0 then category || ': training column rainfall has no usable values'
  end as reason
from (select *, cast(regexp_extract(category, '(\\d+)$', 1) as integer) as num from demand) d
where year(date) in (1997, 2001) and not (num > 20 and year(date) = 2001)
group by category) x where reason is not null""")

# ---- naive, alignment, metrics

FORECAST = f"{KEYS}, date, {rs(['predicted', 'predicted_norm'])}"
oracle("seasonal_naive", ["naive"], f"select {FORECAST} from naive")
oracle("align_forecasts", ["aligned"], f"""
select category, date, {rs(["target", "target_norm", "predicted", "predicted_norm"])} from aligned""")
oracle("mase_scale", ["mase"], f"select category, {rs(['mase_scale'])} from mase")
PREDICTION = f"{KEYS}, date, {rs(['actual', 'predicted', 'actual_norm', 'predicted_norm'])}"
oracle("predictions_table", ["predictions"], f"select {PREDICTION} from predictions where model = 'seasonal_naive'")
METRIC_ROW = f"{KEYS}, {rs(['rmse', 'mae', 'mase', 'smape'])}, n, {rs(['rmse_norm', 'mae_norm'])}"
oracle("seasonal_naive_metrics", ["metrics"], f"select {METRIC_ROW} from metrics where model = 'seasonal_naive'")
oracle("metrics_table", ["metrics"], f"select {METRIC_ROW} from metrics")

# ---- summaries and report tables

MEAN_STD = ", ".join(
    f"{fixed_mean(m)} as {m}_mean, {fixed_std(m)} as {m}_std" for m in METRICS)
oracle("category_summary", ["metrics"], f"""
select category, model, variant, backend, {MEAN_STD} from metrics group by category, model, variant, backend""")
oracle("macro_metrics", ["macro"], f"select model, variant, backend, seed, {', '.join(METRICS)} from macro")
oracle("macro_summary", ["macro"], f"""
select model, variant, backend, {MEAN_STD} from macro group by model, variant, backend""")
oracle("covariate_ablation", ["ablation"],
       f"select category, backend, seed, {rs(ABLATION_COLUMNS)} from ablation")
oracle("ablation_summary", ["ablation"], " union all ".join(
    f"select {i} as position, '{c}' as measure, {fixed_mean(c)} as mean, {fixed_std(c)} as std from ablation"
    for i, c in enumerate(ABLATION_COLUMNS)))
oracle("forecast_lines", ["predictions"], f"""
select category, date, model, variant, backend, {r("avg(predicted)", "predicted")}
from predictions group by category, date, model, variant, backend""")
oracle("actual_line", ["predictions"], f"""
select category, date, {r("min(actual)", "actual")} from predictions group by category, date""")


def pivot_cell(model: str, variant: str) -> str:
    picked = f"avg(predicted) filter (where model = '{model}' and variant = '{variant}')"
    return r(picked, f"{model}:{variant}:spark")


oracle("forecast_pivot", ["predictions"], f"""
select category, date, {r("min(actual)", "actual")}, {pivot_cell("efs", "sales_only")},
       {pivot_cell("efs", "target_weather")}, {pivot_cell("seasonal_naive", "sales_only")}
from predictions group by category, date""")
oracle("preview_demand", ["demand"], f"""
select date, category, {rs(["sales", *WEATHER])} from demand order by category nulls last, date nulls last limit 100""")
oracle("safe_series_names", ["demand"], """
select replace(category, '#', '_') || '___daily' as name, count(*) as days from demand group by 1""")

# ---- fuzzy scoring with the fixed model

def values(rows: list[tuple]) -> str:
    def lit(v):
        return f"cast({v!r} as double)" if isinstance(v, float) else repr(v)

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


CTES["inputs"] = ([], f"""
select l_orderkey as sample_id, {clipped("avg(l_discount) * 10")} as x1, {clipped("avg(l_quantity) / 50")} as x2
from lineitem group by l_orderkey""")
CTES["mfs"] = ([], f"""
select * from (values {values(fx.MEMBERSHIPS)}) t(feature, mf, center, sigma, lower_scale, lower_lag)""")
CTES["rules"] = ([], f"""
select * from (values {values([(i, a[0], a[1], c, w) for i, a, c, w in fx.RULES])}) t(rule_id, mf0, mf1, consequent, weight)""")
CTES["bounds"] = (["inputs", "mfs"], """
select sample_id, feature, mf, upper, least(upper, lower_scale * exp(-0.5 * pow((x - (center + lower_lag)) / sigma, 2))) as lower
from (select sample_id, feature, mf, center, sigma, lower_scale, lower_lag, x, exp(-0.5 * pow((x - center) / sigma, 2)) as upper
      from (select sample_id, feature, mf, center, sigma, lower_scale, lower_lag,
                   case feature when 0 then x1 else x2 end as x from inputs cross join mfs) a) b""")
CTES["firing"] = (["bounds", "rules"], """
select a.sample_id, r.rule_id, r.consequent, a.lower * b.lower * r.weight as lower, a.upper * b.upper * r.weight as upper
from rules r join bounds a on a.feature = 0 and a.mf = r.mf0
join bounds b on b.feature = 1 and b.mf = r.mf1 and b.sample_id = a.sample_id""")


def reduced(firing: str, keys: str) -> str:
    """Switch-point form of the type-reduced ends over a firing table."""
    return f"""
select {keys}, min(case when wl > 1e-12 then nl / wl end) as y_left, max(case when wr > 1e-12 then nr / wr end) as y_right,
       max(total) as upper_sum
from (
  select {keys}, u.k,
         sum(case when not asc_raised then lower else upper end) as wl,
         sum(case when not asc_raised then lower else upper end * consequent) as nl,
         sum(case when not desc_raised then lower else upper end) as wr,
         sum(case when not desc_raised then lower else upper end * consequent) as nr, sum(upper) as total
  from (select f.*, up <= k as asc_raised, down <= k as desc_raised, k
        from (select *, row_number() over (partition by {keys} order by consequent, rule_id) as up,
                     row_number() over (partition by {keys} order by consequent desc, rule_id desc) as down,
                     count(*) over (partition by {keys}) as rules
              from {firing}) f, unnest(range(0, rules + 1)) t(k)) u
  group by {keys}, u.k) z
group by {keys}"""


CTES["interval"] = (["firing"], reduced("firing", "sample_id"))


def crisp(fallback: str) -> str:
    return f"case when upper_sum <= 1e-12 then {fallback} else {clipped('(y_left + y_right) / 2')} end"


oracle("membership_bounds", ["bounds"], f"select sample_id, feature, mf, {rs(['lower', 'upper'])} from bounds")
oracle("firing_bounds", ["firing"],
       f"select sample_id, rule_id, {rs(['consequent', 'lower', 'upper'])} from firing")
oracle("type_reduce", ["interval"], f"select sample_id, {rs(['y_left', 'y_right'])} from interval")
oracle("it2_predict", ["interval"], f"""
select sample_id, {r(crisp(str(fx.FALLBACK)), "prediction_norm")}, upper_sum <= 1e-12 as no_rule_fired from interval""")
oracle("predict_saved", ["interval"], f"""
select sample_id, cast(o_orderdate as date) as date, {r(crisp(str(fx.FALLBACK)), "prediction_norm")},
       upper_sum <= 1e-12 as no_rule_fired from interval join orders on sample_id = o_orderkey""")
# The same rules with memberships a tenth as wide: between them no rule fires.
CTES["narrow_mfs"] = (["mfs"], "select feature, mf, center, sigma / 10 as sigma, lower_scale, lower_lag / 10 as lower_lag from mfs")
CTES["narrow_bounds"] = (["inputs", "narrow_mfs"], CTES["bounds"][1].replace("cross join mfs", "cross join narrow_mfs"))
CTES["narrow_firing"] = (["narrow_bounds", "rules"], CTES["firing"][1].replace("join bounds", "join narrow_bounds"))
CTES["narrow_interval"] = (["narrow_firing"], reduced("narrow_firing", "sample_id"))
oracle("predict_between_rules", ["narrow_interval"], f"""
select sample_id, {r(crisp(str(fx.FALLBACK)), "prediction_norm")}, upper_sum <= 1e-12 as no_rule_fired from narrow_interval""")
oracle("rule_activations", ["firing"],
       f"select sample_id, rule_id, {r('sqrt(lower * upper)', 'activation')} from firing")
oracle("activations_wide", ["firing"], "select sample_id, " + ", ".join(
    r(f"max(sqrt(lower * upper)) filter (where rule_id = {i})", f"rule_{i}") for i in (1, 2, 3)
) + " from firing group by sample_id")
STATS = f"""count(*) filter (where sqrt(lower * upper) > 0.01) as support,
  {r("avg(sqrt(lower * upper))", "mean_activation")}, {r("max(sqrt(lower * upper))", "max_activation")}"""
oracle("rule_stats", ["firing"], f"select rule_id, {STATS} from firing group by rule_id")

# ---- rule learning: all candidate rules on the training rows of each series

VARIANTS = fx.variants()


def long_inputs(split: str) -> str:
    return " union all ".join(
        f"select category, date, target_norm, '{v}' as variant, {i} as feature, {c} as x from supervised where split = '{split}'"
        for v, names in VARIANTS.items() for i, c in enumerate(names)
    )


CTES["candidates"] = ([], " union all ".join(
    f"""select '{v}' as variant, g + 1 as rule_id, f as feature, (g // cast(pow(2, {len(n) - 1} - f) as bigint)) % 2 as mf
        from range(0, {2 ** len(n)}) a(g), range(0, {len(n)}) b(f)""" for v, n in VARIANTS.items()))
CTES["candidate_firing"] = (["supervised", "candidates"], f"""
select category, date, variant, rule_id, any_value(target_norm) as target_norm, product(0.8 * degree) as lower, product(degree) as upper
from (select i.category, i.date, i.target_norm, c.variant, c.rule_id, exp(-0.5 * pow((i.x - (c.mf + 0.5) / 2) / 0.275, 2)) as degree
      from ({long_inputs("train")}) i join candidates c on c.variant = i.variant and c.feature = i.feature) d
group by category, date, variant, rule_id""")
CTES["fallback"] = (["supervised"], f"""
select category, {clipped("median(target_norm)")} as fallback from supervised where split = 'train' group by category""")
CTES["consequents"] = (["candidate_firing", "fallback"], """
select category, variant, rule_id, activation, coalesce(case when activation > 1e-12 then weighted / activation end, fallback) as consequent
from (select category, variant, rule_id, sum(sqrt(lower * upper)) as activation, sum(sqrt(lower * upper) * target_norm) as weighted
      from candidate_firing group by category, variant, rule_id) s join fallback using (category)""")
CTES["series_rules"] = (["consequents"], f"""
select category, variant, rule_id as candidate, {clipped("consequent")} as consequent,
       row_number() over (partition by category, variant order by consequent, rule_id) as rule_id
from consequents""")
CTES["rule_texts"] = (["series_rules", "candidates"], f"""
select s.category, s.variant, s.rule_id, string_agg(n.name || ' is ' || case c.mf when 0 then 'low' else 'high' end, ' AND ' order by c.feature) as antecedent
from series_rules s join candidates c on c.variant = s.variant and c.rule_id = s.candidate
join (values {values([(v, i, c) for v, names in VARIANTS.items() for i, c in enumerate(names)])}) n(variant, feature, name)
  on n.variant = c.variant and n.feature = c.feature
group by s.category, s.variant, s.rule_id""")
HALF_OPEN = """case least(floor(greatest(0, least(1, consequent)) * 5), 4)
  when 0 then 'critical_low' when 1 then 'low' when 2 then 'medium' when 3 then 'high' else 'peak' end"""

oracle("weighted_consequents", ["consequents"],
       f"select category, variant, rule_id, {rs(['activation', 'consequent'])} from consequents")
oracle("candidate_rules", ["rule_texts"], "select category, variant, rule_id, antecedent from rule_texts")
oracle("strongest_rules", ["consequents"], f"""
select category, variant, rule_id, {rs(["activation", "consequent"])} from (
  select *, row_number() over (partition by category, variant order by activation desc, rule_id) as nth
  from consequents) x where nth <= case variant when 'sales_only' then 6 else 12 end""")
oracle("initial_memberships", ["fallback"], " union all ".join(
    f"""select category, '{v}' as variant, f as feature, m as mf, {r("(m + 0.5) / 2", "center")}, {r("0.55 / 2", "sigma")},
        {r("0.8", "lower_scale")}, {r("0", "lower_lag")} from fallback, range(0, {len(n)}) a(f), range(0, 2) b(m)"""
    for v, n in VARIANTS.items()))
oracle("signed_rule_text", ["series_rules"], """
select category, variant, rule_id, case rule_id % 4 when 1 then 'NOT rainfall is Low' when 2 then 'sales is High'
  when 3 then 'NOT sales is High AND rainfall is Low' else 'sales is Low AND rainfall is High' end as antecedent
from series_rules""")
oracle("consequent_labels", ["series_rules"],
       f"select category, variant, rule_id, {HALF_OPEN} as consequent from series_rules")
oracle("closed_consequent_labels", ["series_rules"], """
select category, variant, rule_id, case when nth > 1 then label || '_' || nth else label end as consequent
from (select *, row_number() over (partition by category, variant, label order by rule_id) as nth
      from (select *, case when consequent <= 0.2 then 'Critical_Low' when consequent <= 0.4 then 'Low'
                           when consequent <= 0.6 then 'Medium' when consequent <= 0.8 then 'High' else 'Peak' end as label
            from series_rules) a) b""")

CTES["series_firing"] = (["supervised", "candidates", "series_rules"], f"""
select d.category, d.variant, d.date, s.rule_id, s.consequent, product(0.8 * degree) as lower, product(degree) as upper
from (select i.category, i.variant, i.date, i.feature, c.rule_id as candidate,
             exp(-0.5 * pow((i.x - (c.mf + 0.5) / 2) / 0.275, 2)) as degree
      from ({long_inputs("test")}) i join candidates c on c.variant = i.variant and c.feature = i.feature) d
join series_rules s on s.category = d.category and s.candidate = d.candidate and s.variant = d.variant
group by d.category, d.variant, d.date, s.rule_id, s.consequent""")
CTES["series_interval"] = (["series_firing"], reduced("series_firing", "category, variant, date"))
oracle("series_predictions", ["series_interval", "fallback"], f"""
select category, variant, date, {r(crisp("fallback"), "prediction_norm")}, upper_sum <= 1e-12 as no_rule_fired
from series_interval join fallback using (category)""")
oracle("explain_rules", ["series_firing", "rule_texts"], f"""
select category, variant, rule_id, antecedent, {HALF_OPEN} as consequent, {r("consequent", "consequent_value_norm")},
       {r("1", "weight")}, support, mean_activation, max_activation
from (select category, variant, rule_id, consequent, {STATS} from series_firing group by category, variant, rule_id, consequent) s
join (select category, variant, rule_id, antecedent from rule_texts) t using (category, variant, rule_id)""")
oracle("activation_matrix", ["series_firing"], f"""
select category, variant, row_number() over (partition by category, variant, rule_id order by date) - 1 as sample_index, rule_id,
       {r("sqrt(lower * upper)", "activation")} from series_firing""")

GENE_ROWS = [
    (k, i + 1, max(0.05, min(1.0, float(g[8 + i]))), max(0.0, min(1.0, float(g[16 + i]))))
    for k, g in enumerate(fx.GENOMES)
    for i in range(8)
    if g[i] >= 0.5 or (max(g[:8]) < 0.5 and i == g.index(max(g[:8])))
]
CTES["genes"] = ([], f"select * from (values {values(GENE_ROWS)}) t(genome, rule_id, weight, consequent)")
CTES["genome_firing"] = (["candidate_firing", "genes"], """
select f.category, f.date, g.genome, f.rule_id, g.consequent, f.target_norm, f.lower * g.weight as lower, f.upper * g.weight as upper
from candidate_firing f join genes g on f.rule_id = g.rule_id where f.variant = 'sales_only'""")
CTES["genome_interval"] = (["genome_firing"], reduced("genome_firing", "category, date, genome, target_norm"))
oracle("score_population", ["genome_interval", "fallback", "genes"], f"""
select category, genome, {rs(["mae", "active_share"])}, {r("mae + 0.002 * active_share", "fitness")}
from (select category, genome, avg(abs({crisp("fallback")} - target_norm)) as mae
      from genome_interval join fallback using (category) group by category, genome) m
join (select genome, count(*) / cast(8 as double) as active_share from genes group by genome) a using (genome)""")

# ---- fitted forecasters: the parts that are plain least squares

CTES["timeline"] = (["prepared"], """
select *, lag(sales) over (partition by category order by date) as before from prepared""")
oracle("ar_ols", ["timeline"], f"""
select t.category, t.date, {r("slope", "slope")}, {r("intercept", "intercept")}, {r("intercept + slope * before", "predicted")}
from timeline t join (select category, regr_slope(sales, before) as slope, regr_intercept(sales, before) as intercept
                      from timeline where split = 'train' and before is not null group by category) f using (category)
where split = 'test' and target_observed""")

CTES["steps"] = (["prepared"], f"""
select category, pos, y, y1, y2 from (
  select category, split, pos, y, lag(y) over w as y1, lag(y, 2) over w as y2
  from (select *, {scaled("sales", "sales")} as y from prepared) a
  window w as (partition by category order by date)) b where split = 'train' and pos > 6""")
AIC = "n * (ln(2 * pi() * rss / n) + 1) + 2 * (k + 1)"
oracle("arima_ar_fits", ["steps"], f"""
select category, d, {r(AIC, "aic")}, {rs(["constant", "ar"])} from (
  select category, 0 as d, regr_intercept(y, y1) as constant, regr_slope(y, y1) as ar, count(*) as n, 2 as k,
         regr_syy(y, y1) - regr_slope(y, y1) * regr_sxy(y, y1) as rss from steps group by category
  union all
  select category, 1, 0, sum((y - y1) * (y1 - y2)) / sum(pow(y1 - y2, 2)), count(*), 1,
         sum(pow(y - y1, 2)) - pow(sum((y - y1) * (y1 - y2)), 2) / sum(pow(y1 - y2, 2)) from steps group by category) f""")

# ARIMA with fixed parameters, walked row by row.
CTES["scaled_days"] = (["prepared"], f"""
select *, row_number() over w - 1 as nth, {scaled("sales", "sales")} as y from prepared
window w as (partition by category order by case split when 'train' then 0 else 1 end, date)""")
CTES["changes"] = (["scaled_days"], """
select *, y - lag(y) over (partition by category order by nth) as w from scaled_days""")
CTES["unexplained"] = (["changes"], """
select *, case when nth >= 3 then w - (0.02 + 0.5 * coalesce(lag(w) over o, 0) - 0.2 * coalesce(lag(w, 2) over o, 0)) else 0 end as u
from changes window o as (partition by category order by nth)""")
CTES["walk"] = (["unexplained"], """
select category, nth, cast(0 as double) as e1, cast(0 as double) as e2 from unexplained where nth = 0
union all select n.category, n.nth, n.u - 0.4 * walk.e1 - 0.3 * walk.e2, walk.e1
from walk join unexplained n on n.category = walk.category and n.nth = walk.nth + 1""")
oracle("arima_fixed_roll", ["recursive", "walk"], f"""
select category, date, {r("(y - e1) * greatest(sales_max - sales_min, cast(1e-12 as double)) + sales_min", "predicted")},
       {r("y - e1", "predicted_norm")}
from walk join unexplained using (category, nth) where split = 'test' and target_observed""")

# ---- identity of series and jobs

def digest_cell(value: str) -> str:
    return f"coalesce(cast({billionths(value)} as varchar), 'null')"


def digest_leaf(columns: list[str]) -> str:
    return "sha256(concat_ws('|', cast(date as varchar), " + ", ".join(map(digest_cell, columns)) + "))"


def digest_of(split: str, columns: list[str]) -> str:
    leaf = digest_leaf(columns)
    return f"sha256(coalesce(string_agg({leaf}, '' order by date, {leaf}) filter (where split = '{split}'), ''))"


CTES["job_digests"] = (["supervised"], " union all ".join(
    f"select category, '{v}' as variant, '{json.dumps(names)}' as features, {digest_of('train', [*names, 'target_norm'])} as train, "
    f"{digest_of('test', [*names, 'target_norm'])} as test, count(*) filter (where split = 'train') as train_rows "
    f"from supervised group by category" for v, names in VARIANTS.items()))
SETTINGS = json.dumps(asdict(FuzzyConfig()), sort_keys=True)
oracle("training_jobs_identity", ["job_digests"], f"""
select category, variant, cast(seed as bigint) as seed,
       sha256(concat_ws('|', '1', features, 'target_norm', cast(seed as varchar), '{SETTINGS}', train, test)) as identity
from job_digests cross join (values (42), (43), (44)) s(seed) where train_rows > 0""")
CTES["demand_leaves"] = (["demand"], f"""
select category, date, {digest_leaf(["sales", "rainfall"])} as digest from demand""")
CTES["series_nodes"] = (["demand_leaves"], """
select category, count(*) as nodes, sha256(string_agg(digest, '' order by date, digest)) as digest from demand_leaves group by category""")
CTES["level_5"] = (["series_nodes"], """
select sha256(length(category) || ':' || category) as path, cast(1 as bigint) as nodes, digest from series_nodes""")
for level in range(4, -1, -1):
    CTES[f"level_{level}"] = ([f"level_{level + 1}"], f"""
select substr(path, 1, {level}) as path, cast(sum(nodes) as bigint) as nodes, sha256(string_agg(digest, '' order by path)) as digest
from level_{level + 1} group by 1""")
oracle("demand_tree", [f"level_{i}" for i in range(5)], "select 9 as level, category as path, nodes, digest from series_nodes" + "".join(
    f" union all select {i}, path, nodes, digest from level_{i}" for i in range(5)))
oracle("changed_days", ["demand"], """
select category, cast(date as varchar) as day, case right(category, 1) when '1' then 'added' when '2' then 'removed' else 'changed' end as change
from demand where day(date) = 3 and right(category, 1) = '1' or day(date) = 7 and right(category, 1) = '2'
   or day(date) = 20 and right(category, 1) = '3' and sales is not null""")

# ---- records and checks of a run

oracle("preprocessing_record", ["scales", "medians"], f"""
select category, v.variant, v.feature_columns, 'training_minmax_then_clip_0_1' as input_policy,
       {r("sales_min", "sales_minimum")}, {r("sales_max", "sales_maximum")}, {r("rainfall_max", "rainfall_maximum")},
       {r("humidity_median", "humidity_median")}
from scales join medians using (category)
cross join (values {values([(v, ",".join(n)) for v, n in VARIANTS.items()])}) v(variant, feature_columns)""")
oracle("unavailable_records", ["metrics"], """
select category, w.model, 'spark' as backend, w.reason from (select distinct category from metrics) c
cross join (values ('arima', 'ARIMA search did not produce a valid fitted model'),
                   ('lstm', 'LSTM needs at least two training rows')) w(model, reason)
where not exists (select 1 from metrics m where m.category = c.category and m.model = w.model)""")
oracle("required_models", ["metrics"], """
select 'required_model' as "check", cast(null as varchar) as model_key, w.model in (select model from metrics) as ok, w.model as detail
from (values ('seasonal_naive'), ('arima'), ('lstm'), ('efs')) w(model)""")
oracle("fuzzy_variant_check", ["metrics"], """
select 'fuzzy_variant' as "check", cast(null as varchar) as model_key,
       variant = 'sales_only' as ok, variant as detail
from (select distinct variant from metrics where model = 'efs' union all select 'weather') m""")
# Stored activations as the checks must see them: whole, out of range, constant and with gaps.
CTES["stored_activations"] = (["series_firing"], """
select category, variant, date, rule_id, case right(category, 1)
  when '1' then sqrt(lower * upper) + 1 when '2' then 0.5
  when '3' then case when day(date) > 20 then sqrt(lower * upper) end else sqrt(lower * upper) end as activation
from series_firing""")
CTES["rule_facts"] = (["stored_activations"], """
select category, variant, rule_id, count(*) as samples, bool_and(activation is not null) as finite, min(activation) as low,
       max(activation) as high, stddev_pop(activation) as spread from stored_activations group by category, variant, rule_id""")
CTES["facts"] = (["rule_facts"], """
select category, variant, max(samples) as samples, bool_and(finite) as finite, min(low) as low, max(high) as high,
       max(spread) as spread from rule_facts group by category, variant""")
oracle("activation_checks", ["facts"], f"""
select category, variant, 'activation_finite' as "check", finite as ok, {r("cast(samples as double)", "value")} from facts
union all select category, variant, 'activation_range', low >= 0 and high <= 1, {r("high", "value")} from facts
union all select category, variant, 'activation_responds', spread > 1e-12, {r("spread", "value")} from facts""")
oracle("support_checks", ["series_firing"], """
select category, variant, count(*) filter (where support > samples or samples is null) as outside
from (select category, variant, rule_id,
             count(*) filter (where sqrt(lower * upper) > 0.01) + case when right(category, 1) = '1' and rule_id <= 2 then 9999 else 0 end as support,
             case when right(category, 1) <> '2' or rule_id > 3 then count(*) end as samples
      from series_firing group by category, variant, rule_id) s group by category, variant""")
oracle("missing_outputs", ["supervised"], """
select distinct category, variant, cast(45 as bigint) as seed
from supervised cross join (values ('sales_only'), ('target_weather')) v(variant) where split = 'train'""")

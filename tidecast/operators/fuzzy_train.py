"""Three-stage training of interval type-2 fuzzy models, all series, variants and seeds at once.

1. rule learning: a genetic search over selection, weight and consequent of every candidate rule;
2. a pattern search over centers, sigmas and consequents;
3. a pattern search over lower scales and lower lags, with the upper parameters locked.

Each generation and each poll is one Spark job (see `rounds`): candidates are scored by chunk on
the executors, and the next generation is built by column expressions on one row per job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions import fuzzy
from tidecast.functions.binding import bind
from tidecast.functions.draws import choice, normal, uniform
from tidecast.functions.scalars import clip, exact_sum, is_finite
from tidecast.operators.features import TRAIN, series
from tidecast.operators.fuzzy_score import JOB_KEYS, score_jobs
from tidecast.operators.rounds import durable, pack_rows, run_rounds, task_count
from tidecast.plans.config import FuzzyConfig

SERIES_VARIANT = ["category", "variant"]


# ---- candidate rules and first memberships

def rule_count(features: int, mfs: int) -> int:
    """Candidate rules of a model: every choice of one membership per feature."""
    return mfs**features


def candidate_rules(features: int, mfs: int) -> Column:
    """array<array<int>>: all antecedents in product order, the digits of 0 .. mfs^features - 1.

    The array is a constant: Catalyst folds it once, and no row builds it again.
    """
    rules = [
        "array(" + ",".join(str(g // mfs ** (features - 1 - f) % mfs) for f in range(features)) + ")"
        for g in range(rule_count(features, mfs))
    ]
    return F.expr("array(" + ",".join(rules) + ")")


def initial_cells(features: int, mfs: int) -> list[tuple]:
    """(feature, mf, center, sigma, lower_scale, lower_lag): evenly spaced centers on [0, 1]."""
    return [(f, m, (m + 0.5) / mfs, 0.55 / mfs, 0.8, 0.0) for f in range(features) for m in range(mfs)]


def initial_memberships(features: int, mfs: int) -> Column:
    """The first memberships in the membership array type, as a constant."""
    names = ["feature", "mf", "center", "sigma", "lower_scale", "lower_lag"]
    cells = [
        "named_struct(" + ",".join(f"'{n}',{v}{'' if isinstance(v, int) else 'D'}" for n, v in zip(names, c, strict=True)) + ")"
        for c in initial_cells(features, mfs)
    ]
    return F.expr("array(" + ",".join(cells) + ")")


def initial_shape(features: int, mfs: int) -> Column:
    """Centers, sigmas, lower scales and lags of the first memberships, one after the other."""
    cells = initial_cells(features, mfs)
    return F.expr("array(" + ",".join(f"{c[i]}D" for i in range(2, 6) for c in cells) + ")")


def by_variant(variants: dict[str, list[str]], value) -> Column:
    """`value(features)` of the row's variant."""
    names = list(variants)
    chosen = value(variants[names[-1]])
    for name in names[-2::-1]:
        chosen = F.when(F.col("variant") == name, value(variants[name])).otherwise(chosen)
    return chosen


def feature_union(variants: dict[str, list[str]]) -> list[str]:
    return list(dict.fromkeys(f for names in variants.values() for f in names))


def training_rows(supervised: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """Training rows checked to be finite and inside [0, 1] on every input.

    `fallback` is the series' clipped median training target and `rows` its row count; both are
    windows over the partitioning that the features already have.
    """
    features = feature_union(variants)
    usable = is_finite(F.col("target_norm"))
    for name in features:
        usable = usable & is_finite(F.col(name)) & F.col(name).between(-1e-12, 1 + 1e-12)
    checked = F.when(usable, True).otherwise(
        F.raise_error(F.concat(F.col("category"), F.lit(": fuzzy training data must be finite and in [0,1]")))
        .cast("boolean")
    )
    rows = supervised.filter(F.col("split") == TRAIN).filter(checked)
    return rows.select(
        "category", "split", "date", "pos", "target_norm", *features,
        clip(F.median("target_norm").over(series())).alias("fallback"),
        F.count(F.lit(1)).over(series()).alias("rows"),
    )


def candidate_activations(rows: DataFrame, variants: dict[str, list[str]], mfs: int) -> DataFrame:
    """(category, variant, rule_id, target_norm, fallback, rows, activation) of every candidate rule.

    The activation sqrt(lower * upper) of a rule with weight 1 is the product of its memberships'
    activations, so these are computed once per row as plain columns and each exploded rule
    multiplies its own: the rules of all variants come out of one pass inside generated code.
    """
    features, degree = feature_union(variants), {}
    for f, m, center, sigma, scale, lag in initial_cells(len(features), mfs):
        lower, upper = fuzzy.membership_pair(F.col(features[f]), *map(F.lit, (center, sigma, scale, lag)))
        degree[f, m] = F.sqrt(lower * upper).alias(f"degree_{f}_{m}")
    sizes = {variant: rule_count(len(names), mfs) for variant, names in variants.items()}
    exploded = rows.select("category", "target_norm", "fallback", "rows", *degree.values()).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(sum(sizes.values()) - 1))).alias("number"))
    g, label, activation, start = F.col("number"), None, None, 0
    for variant, names in reversed(list(variants.items())):
        start = sum(sizes[v] for v in list(variants)[: list(variants).index(variant)])
        product = F.lit(1.0)
        for place, name in enumerate(names):
            f, digit = features.index(name), F.expr(f"((number - {start}) div {mfs ** (len(names) - 1 - place)}) % {mfs}")
            own = F.col(f"degree_{f}_{mfs - 1}")
            for m in range(mfs - 1):
                own = F.when(digit == m, F.col(f"degree_{f}_{m}")).otherwise(own)
            product = product * own
        rule = F.struct(F.lit(variant).alias("variant"), (g - start + 1).alias("rule_id"))
        inside = g < start + sizes[variant]
        label = rule if label is None else F.when(inside, rule).otherwise(label)
        activation = product if activation is None else F.when(inside, product).otherwise(activation)
    return exploded.select("category", label.alias("rule"), "target_norm", "fallback", "rows",
                           activation.alias("activation")).select(
        "category", "rule.variant", "rule.rule_id", "target_norm", "fallback", "rows", "activation")


def weighted_consequents(rows: DataFrame, variants: dict[str, list[str]], mfs: int) -> DataFrame:
    """First consequent per (series, variant, candidate rule): the activation-weighted mean target.

    The fallback stands in where a rule is never active. Sums are combined map-side, in fixed
    point, so that training does not depend on the partitioning.
    """
    sums = candidate_activations(rows, variants, mfs).groupBy(*SERIES_VARIANT, "rule_id").agg(
        exact_sum(F.col("activation")).alias("activation"),
        exact_sum(F.col("activation") * F.col("target_norm")).alias("weighted"),
        F.max("fallback").alias("fallback"), F.max("rows").alias("rows"),
    )
    mean = F.when(F.col("activation") > fuzzy.NO_FIRING, F.col("weighted") / F.col("activation"))
    return sums.select(*SERIES_VARIANT, "rule_id", "activation",
                       F.coalesce(mean, "fallback").alias("consequent"), "fallback", "rows")


def strongest_rules(consequents: DataFrame, variants: dict[str, list[str]]) -> DataFrame:
    """Mark the first `max(2, 2 x features)` rules by activation; a tie goes to the lower rule id.

    A group is the candidate rules of one series, whose number is limited.
    """
    by_strength = Window.partitionBy(*SERIES_VARIANT).orderBy(F.col("activation").desc(), "rule_id")
    many = by_variant(variants, lambda names: F.lit(max(2, 2 * len(names))))
    return consequents.withColumn("strong", F.row_number().over(by_strength) <= many)


def initial_models(rows: DataFrame, variants: dict[str, list[str]], mfs: int) -> DataFrame:
    """Untrained models per (series, variant): every candidate rule with weight 1."""
    # One group is the candidate rules of one series, whose number is limited.
    listed = weighted_consequents(rows, variants, mfs).groupBy(*SERIES_VARIANT).agg(
        F.sort_array(F.collect_list(F.struct("consequent", "rule_id"))).alias("cells"),
        F.max("fallback").alias("fallback"),
    ).withColumn("antecedents", by_variant(variants, lambda names: candidate_rules(len(names), mfs)))
    ordered = F.transform("cells", lambda c, i: F.struct(
        (i + 1).cast("int").alias("rule_id"), F.get("antecedents", c["rule_id"] - 1).alias("antecedent"),
        clip(c["consequent"]).alias("consequent"), F.lit(1.0).alias("weight"),
    ))
    return listed.select(
        *SERIES_VARIANT,
        by_variant(variants, lambda names: F.array(*[F.lit(f) for f in names])).alias("feature_columns"),
        F.lit(mfs).alias("mfs"),
        by_variant(variants, lambda names: initial_memberships(len(names), mfs)).alias("memberships"),
        ordered.alias("rules"), "fallback",
    )


# ---- stage 1: genetic rule learning; a genome is selection, weight, consequent per candidate rule

def first_state(
    rows: DataFrame, variants: dict[str, list[str]], feature_order: list[str], seeds: list[int],
    cfg: FuzzyConfig,
) -> DataFrame:
    """One row per (series, variant, seed) with the first population."""
    mfs = cfg.num_input_mfs
    ranked = strongest_rules(weighted_consequents(rows, variants, mfs), variants)
    listed = ranked.groupBy(*SERIES_VARIANT).agg(
        F.sort_array(F.collect_list(F.struct("rule_id", "consequent", "strong"))).alias("cells"),
        F.max("fallback").alias("fallback"), F.max("rows").alias("rows"),
    )
    jobs = listed.select(
        *SERIES_VARIANT, "fallback", "rows",
        by_variant(variants, lambda names: F.array(*[F.lit(feature_order.index(f)) for f in names])).alias("used"),
        by_variant(variants, lambda names: F.lit(rule_count(len(names), mfs))).alias("total"),
        by_variant(variants, lambda names: initial_shape(len(names), mfs)).alias("shape"),
        F.transform("cells", lambda c: clip(c["consequent"])).alias("consequents"),
        F.transform("cells", lambda c: F.when(c["strong"], 0.8).otherwise(0.2)).alias("selection"),
        F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])).alias("seed"),
    )

    def gene(k: Column, i: Column) -> Column:
        at, seed, total = (F.lit("start"), k, i), F.col("seed"), F.col("total")
        own = F.get("consequents", i - 2 * total)
        first = F.when(i < total, F.get("selection", i)).when(i < 2 * total, 1.0).otherwise(own)
        drawn = (
            F.when(i < total, uniform(seed, *at)).when(i < 2 * total, uniform(seed, *at) * 0.65 + 0.35)
            .otherwise(clip(own + normal(seed, *at) * 0.12))
        )
        return F.when(k == 0, first).otherwise(drawn)

    genes = F.sequence(F.lit(0), F.col("total") * 3 - 1)
    population = F.transform(
        F.sequence(F.lit(0), F.lit(cfg.population_size - 1)),
        lambda k: F.transform(genes, lambda i: gene(k, i)),
    )
    return jobs.select(
        *JOB_KEYS, "used", "total", "shape", "fallback", "rows", population.alias("population"),
        F.lit(None).cast("array<double>").alias("best"), F.lit(None).cast("double").alias("best_score"),
        F.lit(0).alias("stalled"), F.lit(0).alias("generations"),
        F.array().cast("array<double>").alias("history"), F.lit(False).alias("done"),
    )


def genome_rules(genome: Column, total: Column) -> Column:
    """Weight (0 = not selected) and consequent per candidate rule; the best one if none is selected."""
    selection = F.slice(genome, 1, total)
    top = bind(selection, lambda s: F.array_position(s, F.array_max(s)) - 1)

    def weights(pick: Column) -> Column:
        return F.transform(selection, lambda s, i: F.when(
            (s >= 0.5) | ((pick["peak"] < 0.5) & (i == pick["top"])), clip(F.get(genome, i + total), 0.05, 1.0),
        ).otherwise(0.0))

    chosen = bind(F.struct(top.alias("top"), F.array_max(selection).alias("peak")), weights)
    return F.concat(chosen, F.transform(F.slice(genome, total * 2 + 1, total), lambda c: clip(c)))


def generation_step(chunks: DataFrame, cfg: FuzzyConfig, tasks: int):
    """One generation: score the population, keep the best genome, breed the next population.

    The generation number is read from the state, so every round has the same plan and reuses the
    code generated for the first one.
    """
    size = cfg.population_size
    elite = max(1, size // 10)
    stall_limit = max(5, min(cfg.ga_stall_generations, cfg.max_generations))
    total, seed, generation = F.col("total"), F.col("seed"), F.col("generations")

    whole = F.flatten(F.transform("population", lambda g: F.concat(F.col("shape"), genome_rules(g, total))))
    job_columns = [
        *JOB_KEYS, "used", "fallback", whole.alias("base"),
        F.array().cast("array<int>").alias("coords"), F.array().cast("array<double>").alias("values"),
    ]
    share = F.transform("population", lambda g: F.greatest(
        F.size(F.filter(F.slice(g, 1, total), lambda s: s >= 0.5)), F.lit(1)) / total)
    fitness = F.zip_with("errors", share, lambda e, s: e + s * cfg.complexity_penalty)
    ranked = F.array_sort(F.transform(fitness, lambda f, i: F.struct(f.alias("score"), i.alias("index"))))

    leader = F.get("ranked", F.lit(0))
    better = F.col("best").isNull() | (leader["score"] < F.col("best_score") - 1e-8)
    best_score = F.when(better, leader["score"]).otherwise(F.col("best_score"))
    stalled = F.when(better, 0).otherwise(F.col("stalled") + 1)
    judged_columns = [
        *JOB_KEYS, "used", "total", "shape", "fallback", "rows", "population", "ranked", "generations",
        F.when(better, F.get("population", leader["index"])).otherwise(F.col("best")).alias("best"),
        best_score.alias("best_score"), stalled.alias("stalled"),
        F.concat("history", F.array(best_score)).alias("history"),
        ((stalled >= stall_limit) | (generation >= cfg.max_generations)).alias("done"),
    ]

    spread = (1 - generation / max(cfg.max_generations - 1, 1)) * 0.18 + 0.025
    by_index = F.array_sort(F.transform(
        "ranked", lambda r: F.struct(r["index"].alias("index"), r["score"].alias("score"))))

    def parent(scores: Column, k: Column, side: str) -> Column:
        drawn = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)),
                            lambda j: F.get(scores, choice(size, seed, "fight", generation, side, k, j)))
        winner = F.array_min(F.transform(drawn, lambda d: F.struct(d["score"].alias("s"), d["index"].alias("i"))))
        return F.get("population", winner["i"])

    def child(scores: Column, k: Column) -> Column:
        at = (seed, "breed", generation, k)
        parents = F.struct(
            parent(scores, k, "first").alias("first"), parent(scores, k, "second").alias("second"),
            (uniform(*at, "cross") < cfg.crossover_fraction).alias("cross"),
        )

        def gene(p: Column, value: Column, i: Column) -> Column:
            mixed = F.when(p["cross"] & (uniform(*at, "mix", i) >= 0.5), F.get(p["second"], i)).otherwise(value)
            moved = F.when(uniform(*at, "hit", i) < 0.08, mixed + normal(*at, "move", i) * spread)
            return clip(F.coalesce(moved, mixed))

        return bind(parents, lambda p: F.transform(p["first"], lambda v, i: gene(p, v, i)))

    kept = F.transform(F.slice("ranked", 1, elite), lambda r: F.get("population", r["index"]))
    bred = bind(by_index, lambda scores: F.transform(
        F.sequence(F.lit(0), F.lit(size - elite - 1)), lambda k: child(scores, k)))
    following = F.when(F.col("done"), F.col("population")).otherwise(F.concat(kept, bred))
    next_columns = [
        *JOB_KEYS, "used", "total", "shape", "fallback", "rows", following.alias("population"),
        (generation + F.when(F.col("done"), 0).otherwise(1)).alias("generations"),
        "best", "best_score", "stalled", "history", "done",
    ]

    def step(state: DataFrame) -> DataFrame:
        scores = score_jobs(chunks, state.select(*job_columns), cfg.num_input_mfs, tasks)
        scored = state.join(scores, JOB_KEYS).withColumn("ranked", ranked)
        return scored.select(*judged_columns).select(*next_columns)

    return step


# ---- stages 2 and 3: pattern search on the whole parameter array

def element_rules(index: Column, width: Column, mfs: int) -> dict[str, Column]:
    """Step and bounds of one element of a candidate array, by its block."""
    block = F.floor(index / width)
    cell = F.pmod(index, F.lit(mfs)) / F.lit(float(mfs))

    def by_block(center, sigma, scale, lag, rule):
        return (F.when(block == 0, center).when(block == 1, sigma).when(block == 2, scale)
                .when(block == 3, lag).otherwise(rule))

    return {
        "step": by_block(0.06, 0.05, 0.06, 0.025, 0.06),
        "low": by_block(cell + 0.02, F.lit(0.04), F.lit(0.1), F.lit(-0.2), F.lit(0.0)),
        "high": by_block(cell + (1 / mfs - 0.02), F.lit(0.6), F.lit(1.0), F.lit(0.2), F.lit(1.0)),
    }


def search_state(state: DataFrame, stage: int) -> DataFrame:
    """Search columns for a stage: the elements it may move, their bounds and steps."""
    width, total = F.size("shape") / 4, F.col("total")
    if stage == 2:
        active = F.filter(F.sequence(F.lit(0), total - 1),
                          lambda g: F.get("parameters", F.size("shape") + g) > 0)
        moved = F.concat(F.sequence(F.lit(0), (2 * width).cast("int") - 1),
                         F.transform(active, lambda g: (g + F.size("shape") + total).cast("int")))
    else:
        moved = F.sequence((2 * width).cast("int"), F.size("shape") - 1)
    return state.select(
        *JOB_KEYS, "used", "total", "shape", "fallback", "parameters", moved.alias("moved"),
        F.lit(1.0).alias("shrink"), F.lit(None).cast("double").alias("score"),
        F.lit(0).alias("iterations"), F.lit(1).cast("long").alias("evaluations"),
        F.array().cast("array<double>").alias("history"), F.lit(False).alias("done"),
    )


def poll_step(chunks: DataFrame, cfg: FuzzyConfig, stage: int, tasks: int):
    """One poll: score a move up and down of every element, take the first better one.

    Elements are polled in a drawn order; all moves of a poll start from the same point, so scoring
    them together and taking the first better one is the sequential first-improvement rule.
    """
    top_step, mfs, iteration = 0.06, cfg.num_input_mfs, F.col("iterations")
    width = F.size("shape") / 4
    order = F.array_sort(F.transform("moved", lambda c: F.struct(
        uniform(F.col("seed"), "poll", stage, iteration, c).alias("key"), c.alias("coord"))))

    def moves(o: Column) -> Column:
        rule = element_rules(o["coord"], width, mfs)
        value, size = F.get("parameters", o["coord"]), rule["step"] * F.col("shrink")
        return F.array(*[
            F.struct(o["coord"].alias("coord"),
                     F.greatest(rule["low"], F.least(rule["high"], value + size * sign)).alias("value"))
            for sign in (1.0, -1.0)
        ])

    polls = F.flatten(F.transform(order, moves))
    job_columns = [*JOB_KEYS, "used", "fallback", F.col("parameters").alias("base"),
                   F.col("polls.coord").alias("coords"), F.col("polls.value").alias("values")]
    now = F.get("errors", F.lit(0))
    gains = F.transform(F.slice("errors", 2, F.size("polls")), lambda e: e < now - 1e-9)
    first = F.array_position(gains, F.lit(True)).cast("int")
    hit = F.col("first") > 0
    pick = F.get("polls", F.col("first") - 1)
    score = F.when(hit, F.get("errors", F.col("first"))).otherwise(now)
    parameters = F.when(hit, F.transform(
        "parameters", lambda v, i: F.when(i == pick["coord"], pick["value"]).otherwise(v)
    )).otherwise(F.col("parameters"))
    shrink = F.when(hit, F.col("shrink")).otherwise(F.col("shrink") / 2)
    history = F.when(F.size("history") == 0, F.array(now, score)).otherwise(F.concat("history", F.array(score)))
    next_columns = [
        *JOB_KEYS, "used", "total", "shape", "fallback", parameters.alias("parameters"), "moved",
        shrink.alias("shrink"), score.alias("score"), (iteration + 1).alias("iterations"),
        (F.col("evaluations") + F.when(hit, F.col("first")).otherwise(F.size("polls"))).alias("evaluations"),
        history.alias("history"),
        ((shrink * top_step < 1e-3) | (iteration + 1 >= cfg.pattern_max_iterations)).alias("done"),
    ]

    def step(state: DataFrame) -> DataFrame:
        polled = state.withColumn("polls", polls)
        scores = score_jobs(chunks, polled.select(*job_columns), mfs, tasks)
        return polled.join(scores, JOB_KEYS).withColumn("first", first).select(*next_columns)

    return step


def pattern_stage(chunks: DataFrame, state: DataFrame, cfg: FuzzyConfig, stage: int, tasks: int) -> DataFrame:
    step = poll_step(chunks, cfg, stage, tasks)
    return run_rounds(search_state(state, stage), step, cfg.pattern_max_iterations, tasks)


# ---- the whole training

def model_columns(variants: dict[str, list[str]], mfs: int) -> dict[str, Column]:
    """Model arrays out of a candidate array: active rules only, ordered by consequent."""
    size, total = F.size("shape"), F.col("total")
    width = (size / 4).cast("int")
    features = by_variant(variants, lambda names: F.array(*[F.lit(f) for f in names]))
    value = lambda i: F.get("parameters", i)
    memberships = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.struct(
        F.floor(i / mfs).cast("int").alias("feature"), F.pmod(i, F.lit(mfs)).alias("mf"),
        value(i).alias("center"), value(i + width).alias("sigma"),
        value(i + 2 * width).alias("lower_scale"), value(i + 3 * width).alias("lower_lag"),
    ))
    places = F.transform("used", lambda _, f: F.pow(F.lit(float(mfs)), F.size("used") - 1 - f))
    active = F.array_sort(F.transform(
        F.filter(F.sequence(F.lit(0), total - 1), lambda g: value(size + g) > 0),
        lambda g: F.struct(value(size + total + g).alias("consequent"), g.alias("g"), value(size + g).alias("weight")),
    ))
    rules = F.transform(active, lambda r, i: F.struct(
        (i + 1).cast("int").alias("rule_id"),
        F.transform(places, lambda p: F.pmod(F.floor(r["g"] / p), F.lit(mfs)).cast("int")).alias("antecedent"),
        r["consequent"].alias("consequent"), r["weight"].alias("weight"),
    ))
    return {"feature_columns": features, "mfs": F.lit(mfs), "memberships": memberships, "rules": rules}


def train_it2(
    supervised: DataFrame, variants: dict[str, list[str]], seeds: list[int], cfg: FuzzyConfig,
    only: DataFrame | None = None,
) -> DataFrame:
    """One trained model per (category, variant, seed), with the record of its three stages.

    `only` (job keys) leaves out jobs that need no training.
    """
    feature_order = feature_union(variants)
    rows = durable(training_rows(supervised, variants))
    chunks = durable(pack_rows(rows, ["category"], feature_order, F.col("pos")))

    jobs = first_state(rows, variants, feature_order, seeds, cfg)
    jobs = jobs if only is None else jobs.join(only, JOB_KEYS, "left_semi")
    # Every chunk meets every variant and seed of its series.
    tasks = task_count(chunks.sparkSession, chunks.count() * len(variants) * len(seeds))
    learned = run_rounds(jobs, generation_step(chunks, cfg, tasks), cfg.max_generations + 1, tasks)
    started = learned.select(
        "*", F.concat("shape", genome_rules(F.col("best"), F.col("total"))).alias("parameters"))
    tuned = pattern_stage(chunks, started, cfg, 2, tasks)
    locked = pattern_stage(chunks, tuned, cfg, 3, tasks)

    def searched(stage: str) -> Column:
        return F.struct(
            F.lit("normalized_mae").alias("objective"), F.col("score").alias("best_objective"), "iterations",
            "evaluations", (F.col("shrink") * 0.06).alias("final_max_step"), "history",
        ).alias(stage)

    stage_1 = learned.select(*JOB_KEYS, "rows", F.struct(
        F.lit("normalized_mae_plus_rule_complexity").alias("objective"),
        F.col("best_score").alias("best_objective"), "generations",
        F.lit(cfg.population_size).alias("population_size"), F.col("total").alias("candidate_rules"),
        F.size(F.filter(F.slice(genome_rules(F.col("best"), F.col("total")), 1, F.col("total")),
                        lambda w: w > 0)).alias("selected_rules"),
        "history",
    ).alias("stage_1"))
    stage_2 = tuned.select(*JOB_KEYS, searched("stage_2"), F.col("parameters").alias("upper_before"))
    upper = F.slice("upper_before", 1, (F.size("shape") / 2).cast("int"))
    moved = F.array_max(F.zip_with(
        upper, F.slice("parameters", 1, (F.size("shape") / 2).cast("int")), lambda a, b: F.abs(a - b)))
    models = locked.select("*", searched("stage_3")).join(stage_1, JOB_KEYS).join(stage_2, JOB_KEYS)
    return models.select(
        *JOB_KEYS, *[c.alias(n) for n, c in model_columns(variants, cfg.num_input_mfs).items()],
        "fallback", F.col("rows").alias("training_rows"), F.col("score").alias("training_mae_norm"),
        moved.alias("upper_parameter_max_delta"), (moved <= 1e-12).alias("upper_parameters_locked"),
        "stage_1", "stage_2", "stage_3",
    )


def score_population(
    rows: DataFrame, features: list[str], genomes: list[list[float]], cfg: FuzzyConfig
) -> DataFrame:
    """Fitness of each genome on each series: mean absolute error plus a price per active rule."""
    total = rule_count(len(features), cfg.num_input_mfs)
    chunks = pack_rows(rows, ["category"], features, F.col("pos"))
    shape = initial_shape(len(features), cfg.num_input_mfs)
    listed = F.array(*[F.array(*[F.lit(float(v)) for v in g]) for g in genomes])
    decoded = F.transform(listed, lambda g: genome_rules(g, F.lit(total)))
    jobs = rows.groupBy("category").agg(F.max("fallback").alias("fallback")).select(
        "category", F.lit("scored").alias("variant"), F.lit(0).cast("long").alias("seed"),
        F.sequence(F.lit(0), F.lit(len(features) - 1)).alias("used"), "fallback",
        F.flatten(F.transform(decoded, lambda g: F.concat(shape, g))).alias("base"),
        F.array().cast("array<int>").alias("coords"), F.array().cast("array<double>").alias("values"),
    )
    active = F.size(F.filter(F.slice(F.get(decoded, F.col("genome")), 1, total), lambda w: w > 0)) / total
    scored = score_jobs(chunks, jobs, cfg.num_input_mfs).select("category", F.posexplode("errors").alias("genome", "mae"))
    return scored.select(
        "category", "genome", "mae", active.alias("active_share"),
        (F.col("mae") + active * cfg.complexity_penalty).alias("fitness"),
    )

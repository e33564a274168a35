import hashlib

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tidecast.operators.verify import activation_checks, verify_run
from tidecast.plans.benchmark import run_benchmark
from tidecast.plans.config import load_config, make_config
from tidecast.plans.jobs import fit_or_reuse
from tidecast.sources import demand as sources
from tidecast.sources import fingerprints, models, paths, runs


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    from catalog.inputs import holdout_demand

    base = tmp_path_factory.mktemp("run")
    table = holdout_demand(spark, SF_DIR).filter(F.col("category").isin("Brand#1", "Brand#2"))
    sources.write_table(table, str(base / "demand"), "csv")
    config = make_config({
        "data_path": str(base / "demand"), "artifact_root": str(base / "artifacts"), "train_year": 1996,
        "test_year": 1997, "profile": "smoke", "efs": {"population_size": 6, "pattern_max_iterations": 2},
    })
    return config, run_benchmark(spark, config)


def table(spark, run, name):
    return runs.run_table(spark, run[0].artifact_root, name, run[1])


def test_run_is_complete_and_verified(spark, run):
    config, run_id = run
    manifest = runs.list_runs(spark, config.artifact_root).first()
    assert manifest["run_id"] == run_id and manifest["status"] == "complete" and len(manifest["data_sha256"]) == 64
    assert manifest["metric_rows"] == table(spark, run, "metrics").count() == 10
    assert '"status":"complete"' in runs.inspect_run(spark, config.artifact_root, run_id).first()["manifest"]
    checks = verify_run(spark, config.artifact_root, strict=True).collect()
    assert checks and all(r["ok"] for r in checks)


def test_run_scores_all_models_on_the_same_dates(spark, run):
    counts = table(spark, run, "predictions").groupBy("category", "model", "variant").count().collect()
    assert len(counts) == 10
    per_category = {}
    for r in counts:
        per_category.setdefault(r["category"], set()).add(r["count"])
    assert all(len(v) == 1 for v in per_category.values())
    assert {r["seed"] for r in table(spark, run, "metrics").filter("model = 'arima'").collect()} == {None}


def test_run_tables_agree(spark, run):
    rules, activations = table(spark, run, "rules"), table(spark, run, "activations")
    fitted = table(spark, run, "models")
    assert rules.count() == fitted.select(F.sum(F.size("rules"))).first()[0]
    samples = table(spark, run, "fuzzy_predictions").groupBy("category", "variant").count()
    joined = activations.groupBy("category", "variant", "rule_id").count().withColumnRenamed("count", "n").join(samples, ["category", "variant"])
    assert joined.filter("n != count").count() == 0
    details = {r["model"]: r["details"] for r in table(spark, run, "fit_details").collect()}
    assert details["arima"]["protocol"] == "rolling_one_step" and details["lstm"]["hidden_units"] == "32"
    assert table(spark, run, "weather_ablation").count() == 2
    assert table(spark, run, "preprocessing").count() == 4
    assert table(spark, run, "unavailable").count() == 0
    assert table(spark, run, "training_summary").filter("upper_parameters_locked").count() == 4
    for row in table(spark, run, "training_summary").collect():
        assert row["elapsed_seconds"] > 0 and 0 <= row["training_no_rule_samples"] <= row["training_rows"]
        assert row["test_no_rule_samples"] >= 0


def test_models_are_reused_by_identity(spark, run, monkeypatch, tmp_path):
    from tidecast.operators import features
    from tidecast.plans import jobs

    config, _ = run
    cache = table(spark, run, "models")
    prepared = features.prepare_features(sources.read_demand(spark, config.data_path), 1996, 1997, config.weather_features)
    supervised = features.make_supervised(prepared, config.lags, config.weather_features)
    variants = features.feature_variants(config.lags, config.weather_features)
    original = jobs.train_it2
    asked = []

    def spied(*args, only, **kwargs):
        asked.append(only.count())
        return original(*args, only=only, **kwargs)

    monkeypatch.setattr(jobs, "train_it2", spied)
    part = cache.filter("not (category = 'Brand#1' and variant = 'sales_only')")
    found = fit_or_reuse(supervised, variants, config.seeds, config.efs, part)
    assert asked == [1]
    keys = ["category", "variant", "model_sha256", "identity"]
    assert sorted(map(tuple, found.select(*keys).collect())) == sorted(map(tuple, cache.select(*keys).collect()))
    other = supervised.withColumn("target_norm", F.col("target_norm") * 0.5)
    with pytest.raises(Exception, match="identity mismatch"):
        fit_or_reuse(other, variants, config.seeds, config.efs, cache).collect()
    with pytest.raises(Exception, match="incomplete"):
        fit_or_reuse(supervised, variants, config.seeds, config.efs,
                     cache.withColumn("rules", F.lit(None).cast(cache.schema["rules"].dataType))).collect()


def test_a_changed_day_refits_one_series(spark, run, monkeypatch):
    """One training day of one series moves: only the jobs of this series are asked for, all others are reused."""
    from tidecast.operators import features
    from tidecast.plans import jobs
    from tidecast.sources import merkle

    config, _ = run
    cache = table(spark, run, "models")
    prepared = features.prepare_features(sources.read_demand(spark, config.data_path), 1996, 1997, config.weather_features)
    supervised = features.make_supervised(prepared, config.lags, config.weather_features)
    variants = features.feature_variants(config.lags, config.weather_features)
    day = supervised.filter("category = 'Brand#1' and split = 'train'").agg(F.min("date")).first()[0]
    moved = (F.col("category") == "Brand#1") & (F.col("date") == F.lit(day))
    other = supervised.withColumn("target_norm", F.when(moved, F.col("target_norm") + 0.01).otherwise(F.col("target_norm")))
    before, after = (merkle.leaves(t, ["category"], "date", ["target_norm"]) for t in (supervised, other))
    assert [tuple(r) for r in merkle.changed_days(before, after, ["category"]).collect()] == [("Brand#1", day, "changed")]
    original, asked = jobs.train_it2, []

    def spied(*args, only, **kwargs):
        asked.extend(sorted((r["category"], r["variant"]) for r in only.collect()))
        return original(*args, only=only, **kwargs)

    monkeypatch.setattr(jobs, "train_it2", spied)
    found = fit_or_reuse(other, variants, config.seeds, config.efs, cache, on_change="refit")
    assert asked == [("Brand#1", "sales_only"), ("Brand#1", "target_weather")]
    kept = {(r["category"], r["variant"]): r["model_sha256"] for r in cache.collect()}
    again = {(r["category"], r["variant"]): r["model_sha256"] for r in found.collect()}
    assert set(kept) == set(again) and all(again[k] == v for k, v in kept.items() if k[0] != "Brand#1")


def test_of_two_writers_one_finishes_a_run(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "runs")
    with ThreadPoolExecutor(4) as pool:
        opened = list(pool.map(lambda _: runs.open_run(spark, root, "x", {"a": 1}, "f", "0" * 64), range(4)))
    assert len(set(opened)) == 4 and runs.list_runs(spark, root).count() == 4

    def finish(rows):
        try:
            runs.finish_manifest(spark, root, opened[0], 1, rows, 0)
        except runs.RunConflict:
            return None
        return rows

    with ThreadPoolExecutor(4) as pool:
        done = [x for x in pool.map(finish, range(1, 5)) if x]
    assert len(done) == 1
    latest = {r["run_id"]: r for r in runs.list_runs(spark, root).collect()}
    assert latest[opened[0]]["status"] == "complete" and latest[opened[0]]["metric_rows"] == done[0]
    assert latest[opened[1]]["status"] == "running"
    with pytest.raises(runs.RunConflict):
        runs.write_manifest(spark, root, opened[1], {}, "f", "0" * 64)


def test_tree_digests_follow_content_only(spark):
    from datetime import date, timedelta

    from tidecast.sources import merkle

    rows = [(f"s{i}", date(2016, 1, 1) + timedelta(days=d), float(i * d), None if d == 3 else "a|b") for i in range(30) for d in range(5)]
    frame = spark.createDataFrame(rows, "name string, day date, x double, note string")

    def root(df):
        nodes = merkle.series(merkle.leaves(df, ["name"], "day", ["x", "note"]), ["name"])
        return {(r["level"], r["path"]): (r["nodes"], r["digest"]) for r in merkle.tree(nodes, ["name"]).collect()}

    whole = root(frame)
    assert whole[0, ""][0] == 30 and sum(n for (level, _), (n, _) in whole.items() if level == 4) == 30
    assert root(frame.orderBy(F.desc("x")).repartition(7)) == whole
    for changed in (
        frame.withColumn("x", F.when((F.col("name") == "s4") & (F.col("x") == 8), 8.5).otherwise(F.col("x"))),
        frame.withColumn("note", F.when(F.col("name") == "s4", F.lit("a")).otherwise(F.col("note"))),
        frame.filter("not (name = 's4' and x = 8)"), frame.union(frame.filter("name = 's4' and x = 8")),
    ):
        other = root(changed)
        assert other[0, ""] != whole[0, ""]
        assert sum(other[k] != whole[k] for k in whole if k[0] == 4) == 1
        days = merkle.changed_days(*(merkle.leaves(t, ["name"], "day", ["x", "note"]) for t in (frame, changed)), ["name"])
        assert {r["name"] for r in days.collect()} == {"s4"}
    assert root(frame.limit(0)) == {}


def test_changed_models_are_refused(spark, run, tmp_path):
    models.save_models(table(spark, run, "models"), str(tmp_path / "models"))
    loaded = models.load_models(spark, str(tmp_path / "models"))
    assert loaded.count() == 4
    changed = loaded.withColumn("fallback", F.col("fallback") + 0.1)
    with pytest.raises(Exception, match="hash mismatch"):
        models.checked(changed).collect()
    with pytest.raises(Exception, match="Not a model of this backend"):
        models.checked(loaded.withColumn("backend", F.lit("other"))).collect()


def test_missing_toolbox_is_recorded(spark, run, tmp_path):
    config, _ = run
    other = make_config({**config.to_dict(), "efs": {"backend": "matlab"}, "artifact_root": str(tmp_path),
                         "models": ["seasonal_naive", "efs"]})
    run_id = run_benchmark(spark, other)
    lost = runs.run_table(spark, str(tmp_path), "unavailable", run_id).collect()
    assert {(r["model"], r["backend"]) for r in lost} == {("efs:sales_only", "matlab"), ("efs:target_weather", "matlab")}
    assert runs.list_runs(spark, str(tmp_path)).first()["status"] == "partial"
    with pytest.raises(RuntimeError, match="manifest_complete"):
        verify_run(spark, str(tmp_path), strict=True)


def test_missing_models_are_named(spark, run):
    from tidecast.operators.verify import fuzzy_variants, present_models

    metrics = table(spark, run, "metrics").filter("model = 'seasonal_naive'")
    lost = [r["detail"] for r in present_models(metrics, ["seasonal_naive", "arima", "lstm", "efs"]).filter("not ok").collect()]
    assert sorted(lost) == ["arima", "efs", "lstm"]
    assert fuzzy_variants(metrics).filter("not ok").count() == 2


def test_flat_activations_fail(spark):
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.5), ("b", 1, 1.5), ("b", 1, float("nan"))],
                                 "key string, rule_id int, activation double")
    found = {(r["key"], r["check"]): r["ok"] for r in activation_checks(rows, ["key"]).collect()}
    assert found["a", "activation_range"] and not found["a", "activation_responds"]
    assert not found["b", "activation_finite"] and not found["b", "activation_range"]


def test_config_rules(tmp_path):
    with pytest.raises(ValueError, match="lags: "):
        make_config({"lags": [2, 1]})
    with pytest.raises(ValueError, match="test_year: "):
        make_config({"train_year": 2016, "test_year": 2016})
    for bad in ({"num_input_mfs": 1}, {"population_size": 3}, {"crossover_fraction": 2}, {"pattern_max_iterations": 0},
                {"complexity_penalty": -1}, {"backend": "x"}):
        with pytest.raises(ValueError):
            make_config({"efs": bad})
    path = tmp_path / "run.yaml"
    path.write_text("profile: smoke\nseeds: [1, 2]\nefs:\n  backend: python-it2\n")
    config = load_config(str(path))
    with pytest.MonkeyPatch.context() as patch:
        patch.setenv("TIDECAST_FUZZY_BACKEND", "matlab")
        assert load_config(str(path)).efs.backend == "matlab"
    assert config.seeds == [1] and config.efs.population_size == 10 and config.efs.max_generations == 2


def test_private_source_and_file_digest(spark, tmp_path, monkeypatch):
    (tmp_path / "demand.csv").write_text("a,b\n1,2\n")
    expected = hashlib.sha256(b"a,b\n1,2\n").hexdigest()
    assert fingerprints.fingerprint(spark, str(tmp_path / "demand.csv")) == expected
    with pytest.raises(FileNotFoundError):
        paths.resolve_source(spark, "elsewhere/demand.csv")
    monkeypatch.setenv(paths.PRIVATE_ROOT_VARIABLE, str(tmp_path))
    assert paths.resolve_source(spark, "elsewhere/demand.csv") == str(tmp_path / "demand.csv")


def test_table_fingerprint_ignores_order(spark):
    frame = spark.range(100).withColumn("x", F.col("id") % 7)
    same = fingerprints.fingerprint_df(frame.orderBy(F.col("id").desc()).repartition(5))
    assert fingerprints.fingerprint_df(frame) == same
    assert fingerprints.fingerprint_df(frame.union(frame.limit(1))) != same


def test_table_fingerprint_sees_where_a_null_stands(spark):
    left, right = (spark.createDataFrame([row], "a double, b double") for row in ((1.0, None), (None, 1.0)))
    assert fingerprints.fingerprint_df(left) != fingerprints.fingerprint_df(right)


def test_prepare_writes_iso_dates_once(spark, tmp_path):
    columns = {"Date": ["1/3", "2/3"], "2016 tea sales": ["1", "2"], "2017 tea sales": ["3", "4"]}
    wide = spark.createDataFrame(list(zip(*columns.values(), strict=True)), list(columns))
    sources.prepare(wide, str(tmp_path / "out"))
    back = sources.read_demand(spark, str(tmp_path / "out"))
    assert back.count() == 4 and back.filter("sales is null").count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        sources.prepare(wide, str(tmp_path / "out"))

"""Run tables: `<root>/<table>/run_id=<id>/`, and manifests as numbered versions.

A version is a folder `<root>/manifest/run_id=<id>/version=<n>/`. It is written aside and moved to its place in one
step, which only succeeds where no such version is yet. So of two writers that read the same version
one can write the next, and a run is opened once and finished once.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.sources.demand import write_table
from tidecast.sources.paths import file_system, moved_if_absent, path_exists

MANIFEST_SCHEMA = (
    "run_id string, schema_version int, status string, created_at string, updated_at string, "
    "data_file string, data_sha256 string, config string, categories_completed long, "
    "metric_rows long, unavailable_models long"
)


def now() -> str:
    return datetime.now(UTC).isoformat()


def table_path(root: str, table: str, run_id: str) -> str:
    return f"{root.rstrip('/')}/{table}/run_id={run_id}"


def new_run_id(spark: SparkSession, root: str, label: str = "benchmark") -> str:
    """`<UTC time>-<label>`, with -1, -2, ... while that run exists."""
    base = f"{datetime.now(UTC):%Y%m%dT%H%M%SZ}-{label}"
    run_id, suffix = base, 1
    while path_exists(spark, table_path(root, "manifest", run_id)):
        run_id, suffix = f"{base}-{suffix}", suffix + 1
    return run_id


def write_run_table(df: DataFrame, root: str, table: str, run_id: str) -> DataFrame:
    """Write a run table and return it as read back, so later steps start from the stored rows."""
    path = table_path(root, table, run_id)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_table(spark: SparkSession, root: str, table: str, run_id: str) -> DataFrame:
    return spark.read.parquet(table_path(root, table, run_id))


def has_table(spark: SparkSession, root: str, table: str, run_id: str) -> bool:
    return path_exists(spark, table_path(root, table, run_id))


class RunConflict(RuntimeError):
    """Another writer has written this version of the manifest."""


def commit_manifest(spark: SparkSession, root: str, values: dict[str, object], version: int) -> None:
    """Write a version of a run's manifest; refused if it exists."""
    base, run_id = root.rstrip("/"), values["run_id"]
    aside = f"{base}/_manifest_aside/{uuid.uuid4().hex}"
    spark.createDataFrame([values], MANIFEST_SCHEMA).drop("run_id").coalesce(1).write.parquet(aside)
    if not moved_if_absent(spark, aside, f"{base}/manifest/run_id={run_id}/version={version}"):
        system, location = file_system(spark, aside)
        system.delete(location, True)
        raise RunConflict(f"Manifest version {version} of run {run_id} was written by another writer")


def write_manifest(
    spark: SparkSession, root: str, run_id: str, config: dict[str, object], data_file: str, data_sha256: str
) -> None:
    """Open a run: its first manifest version."""
    created = now()
    commit_manifest(spark, root, {
        "run_id": run_id, "schema_version": 1, "status": "running", "created_at": created,
        "updated_at": created, "data_file": data_file, "data_sha256": data_sha256,
        "config": json.dumps(config, sort_keys=True), "categories_completed": None,
        "metric_rows": None, "unavailable_models": None,
    }, 1)


def open_run(
    spark: SparkSession, root: str, label: str, config: dict[str, object], data_file: str, data_sha256: str
) -> str:
    """A new run with its first manifest; a name that another writer takes meanwhile is left to it."""
    while True:
        run_id = new_run_id(spark, root, label)
        try:
            write_manifest(spark, root, run_id, config, data_file, data_sha256)
        except RunConflict:
            continue
        return run_id


def versions(spark: SparkSession, root: str) -> DataFrame:
    """All manifest versions."""
    return spark.read.schema(f"{MANIFEST_SCHEMA}, version int").parquet(f"{root.rstrip('/')}/manifest")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """The latest manifest version of each run."""
    found = versions(spark, root)
    fields = [f for f in found.columns if f not in ("run_id", "version")]
    latest = found.groupBy("run_id").agg(F.max_by(F.struct(*fields), "version").alias("latest"))
    return latest.select("run_id", "latest.*")


def finish_manifest(
    spark: SparkSession, root: str, run_id: str, categories: int, metric_rows: int, unavailable: int
) -> None:
    """Close a run: the version after the one that opened it, `partial` if any model was unavailable."""
    opened = versions(spark, root).filter((F.col("run_id") == run_id) & (F.col("version") == 1)).drop("version").first()
    commit_manifest(spark, root, {
        **opened.asDict(), "status": "partial" if unavailable else "complete", "updated_at": now(),
        "categories_completed": categories, "metric_rows": metric_rows, "unavailable_models": unavailable,
    }, 2)


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs, newest first."""
    return manifests(spark, root).orderBy(F.col("created_at").desc(), F.col("run_id").desc())


def inspect_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """One row: the run's manifest as JSON."""
    found = manifests(spark, root).filter(F.col("run_id") == run_id)
    return found.select("run_id", F.to_json(F.struct(*[c for c in found.columns if c != "run_id"])).alias("manifest"))

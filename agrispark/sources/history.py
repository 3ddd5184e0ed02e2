"""Metrics history (S11) and model bundles.

History is a long table ``(generated_at, artifact, metric, value)`` kept as an
append-only log: an append writes its own rows and one manifest entry, both
under names of their own, so it costs what the snapshot costs and two writers
never touch the same file. Old snapshots go only when the caller says how
many to ``keep``: a cut is one more entry, and readers open only the files that
the manifest says hold a newer time. A
bundle is an MLlib ``PipelineModel`` directory plus parquet side tables
(feature list, rule tables, metrics); a missing or broken bundle reads as
"unavailable" with the error text instead of failing the caller.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_SCHEMA = "generated_at timestamp_ntz, artifact string, metric string, value double"


def metrics_append(history: DataFrame | None, snapshot: DataFrame, keep: int | None = None) -> DataFrame:
    """Union the new snapshot; with ``keep``, only the newest ``keep`` snapshot times stay.

    A missing history (``None``) starts empty. The keep-set is a top-k over
    the **distinct snapshot times**, semi-joined back.
    """
    allrows = snapshot if history is None else history.unionByName(snapshot)
    if keep is None:
        return allrows
    newest = allrows.select("generated_at").distinct().orderBy(F.col("generated_at").desc()).limit(keep)
    return allrows.join(newest, "generated_at", "left_semi")


def read_history(spark: SparkSession, path: str) -> DataFrame | None:
    """The history at ``path``, ``None`` if there is none; a failing read raises (it must not restart the history)."""
    from .files import path_exists
    if not path_exists(spark, path):
        return None
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


#: One manifest entry: an appended file with the snapshot times in it, or (no file) a time before which all snapshots are dropped.
MANIFEST_SCHEMA = "file string, n_rows long, times array<timestamp_ntz>, dropped_before timestamp_ntz"


def append_snapshot(base: str, snapshot: DataFrame) -> str:
    """Add a snapshot's rows to the log at ``base``; returns the new file's name.

    The rows are written first, then the entry that makes them part of the
    log: a reader sees all of an append or nothing, and a writer that dies in
    between leaves only a file that no entry names. An empty snapshot adds nothing.
    """
    name = uuid.uuid4().hex
    path = posixpath.join(base, "data", name)
    rows = snapshot.select("generated_at", "artifact", "metric", "value")
    rows.write.parquet(path)
    back = snapshot.sparkSession.read.schema(HISTORY_SCHEMA).parquet(path)
    seen = back.groupBy("generated_at").agg(F.count(F.lit(1)).alias("n"))
    entry = seen.agg(F.lit(name).alias("file"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.array_sort(F.collect_set("generated_at")).alias("times"),
                     F.lit(None).cast("timestamp_ntz").alias("dropped_before")).where("n_rows > 0")
    _enter(base, entry)
    return name


def _enter(base: str, entry: DataFrame) -> None:
    entry.coalesce(1).write.parquet(posixpath.join(base, "manifest", uuid.uuid4().hex))


def manifest(spark: SparkSession, base: str) -> DataFrame | None:
    """Every entry of the log, ``None`` if there is no log."""
    from .files import path_exists
    path = posixpath.join(base, "manifest")
    if not path_exists(spark, path):
        return None
    return spark.read.schema(MANIFEST_SCHEMA).option("recursiveFileLookup", "true").parquet(path)


def drop_snapshots(spark: SparkSession, base: str, keep: int) -> None:
    """Only the newest ``keep`` snapshot times stay; one entry, no rows are read or written."""
    from datetime import datetime
    entries = manifest(spark, base)
    if entries is None:
        return
    times = entries.select(F.explode("times").alias("t")).distinct().orderBy(F.desc("t")).limit(keep)
    first = times.agg(F.min("t").alias("t")).first()["t"]
    cut = first if keep > 0 and first is not None else datetime(9999, 12, 31)
    _enter(base, spark.createDataFrame([(None, 0, [], cut)], MANIFEST_SCHEMA))


def read_log(spark: SparkSession, base: str) -> DataFrame | None:
    """The history of the log at ``base``, ``None`` if there is none.

    The manifest alone tells which files hold a snapshot that is not
    dropped; only those are opened. Rows without a time stay until something is dropped.
    """
    entries = manifest(spark, base)
    if entries is None:
        return None
    cut = entries.agg(F.max("dropped_before").alias("t")).first()["t"]
    live = entries.where(F.col("file").isNotNull())
    if cut is not None:
        live = live.where(F.array_max("times") >= F.lit(cut).cast("timestamp_ntz"))
    files = [posixpath.join(base, "data", r["file"]) for r in live.select("file").toLocalIterator()]
    if not files:
        return spark.createDataFrame([], HISTORY_SCHEMA)
    rows = spark.read.schema(HISTORY_SCHEMA).parquet(*files)
    return rows if cut is None else rows.where(F.col("generated_at") >= F.lit(cut).cast("timestamp_ntz"))


def write_history_version(df: DataFrame, base: str, version: int) -> str:
    """Write a whole history as a new immutable version (an export; the log is what is appended to)."""
    path = posixpath.join(base, f"v{version:06d}")
    df.write.mode("errorifexists").parquet(path)
    return path


@dataclass
class Bundle:
    available: bool
    path: str
    model: object = None
    features: list = field(default_factory=list)
    metrics: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    error: str | None = None


def save_model_bundle(spark: SparkSession, path: str, model, features: list, metrics: dict,
                      tables: dict[str, DataFrame] | None = None) -> str:
    """Persist model + feature list + side tables + metrics."""
    model.write().overwrite().save(posixpath.join(path, "model"))
    meta = spark.createDataFrame([(json.dumps({"features": features, "metrics": metrics}),)], "meta string")
    meta.write.mode("overwrite").json(posixpath.join(path, "meta"))
    for name, t in (tables or {}).items():
        t.write.mode("overwrite").parquet(posixpath.join(path, "tables", name))
    return path


def load_model_bundle(spark: SparkSession, path: str, table_names: tuple = ()) -> Bundle:
    """Load a bundle; failures become ``available=False`` with the error text."""
    from pyspark.ml import PipelineModel
    from .files import path_exists
    try:
        if not path_exists(spark, posixpath.join(path, "model")):
            return Bundle(False, path, error=None)
        model = PipelineModel.load(posixpath.join(path, "model"))
        meta = json.loads(spark.read.json(posixpath.join(path, "meta")).first()["meta"])
        tables = {n: spark.read.parquet(posixpath.join(path, "tables", n)) for n in table_names}
        return Bundle(True, path, model, meta.get("features", []), meta.get("metrics", {}), tables)
    except Exception as e:  # broken bundle: report, do not fail the caller
        return Bundle(False, path, error=f"{type(e).__name__}: {e}"[:500])

"""File scans and sinks.

Scans declare their schema (no inference pass over the data); column pruning
and filters reach the parquet reader as ``ReadSchema`` / ``PushedFilters``.
"""

from __future__ import annotations

import posixpath
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _reader(spark: SparkSession, fmt: str, schema: T.StructType | str | None, header: bool = True):
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", header).option("mode", "PERMISSIVE")
    return r


def scan_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Scan a table; a missing path is a ``FileNotFoundError`` (not an empty frame)."""
    try:
        return _reader(spark, fmt, schema).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(path) from e
        raise


def scan_columns(spark: SparkSession, path: str, cols: Sequence[str], fmt: str = "parquet",
                 schema: T.StructType | str | None = None) -> DataFrame:
    """Column-pruned scan (only ``cols`` are read from columnar files)."""
    return scan_table(spark, path, schema, fmt).select(*cols)


def scan_skip_tag_row(spark: SparkSession, path: str, typed: Mapping[str, str]) -> DataFrame:
    """S3: CSV whose files carry a tag row under the header (e.g. '#date,#value').

    Everything is read as text, then rows whose typed columns do not all
    parse are dropped and the rest are cast. Unlike "skip line 2", this is
    correct for split and multi-file inputs, where the tag row can sit in any
    split.
    """
    names = list(typed)
    raw = _reader(spark, "csv", T.StructType([T.StructField(n, T.StringType()) for n in names])).load(path)
    cols = {}
    for n, t in typed.items():
        if t in ("timestamp", "timestamp_ntz"):
            cols[n] = F.try_to_timestamp(F.trim(F.col(n))).cast("timestamp_ntz")
        elif t == "date":
            cols[n] = F.try_to_date(F.trim(F.col(n)))
        else:
            cols[n] = F.trim(F.col(n)).try_cast(t)
    parsed = raw.select(*[c.alias(n) for n, c in cols.items()])
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull()
    return parsed.where(ok)


def scan_directory(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet") -> DataFrame:
    """Every file of a directory as one frame keyed by file name.

    One scan per file schema; ``_metadata.file_name`` tags each row and
    ``unionByName(allowMissingColumns=True)`` aligns differing schemas.
    """
    out = None
    for name in sorted(paths):
        df = _reader(spark, fmt, None).load(paths[name])
        df = df.select("*", F.col("_metadata.file_name").alias("file_name"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the cluster file system (HDFS, object stores, local)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def first_available_source(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists (primary dataset, then fallbacks)."""
    for p in paths:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(f"none of the sources exist: {list(paths)}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> str:
    """Write a result table (directories are created by the writer)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_schema_report(profiles: DataFrame, path: str) -> str:
    """The column profile table (P1 output, with a ``table`` column) as JSON lines."""
    profiles.write.mode("overwrite").json(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a machine-local temp dir)."""
    import uuid
    base = spark.sparkContext.getCheckpointDir()
    if not base:
        from ..session import ensure_checkpoint_dir
        base = ensure_checkpoint_dir(spark)
    return posixpath.join(base, f"{name}-{uuid.uuid4().hex[:12]}")

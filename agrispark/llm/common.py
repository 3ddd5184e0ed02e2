"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

#: Bytes of text that one vectorised step looks at (its arrays take about 40 times as much).
STEP_BYTES = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Shared scratch folder and package for the Python workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder that the cluster names in ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


#: Tables written inside open ``scratch`` blocks, innermost last.
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the tables that ``materialize`` writes inside the block when it ends well, except those taken off the yielded list.

    For steps whose result has been written elsewhere by then. After an error
    everything stays, and nothing outside the shared folder is touched.
    """
    _OPEN.append(made := [])
    try:
        yield made
    except BaseException:
        made.clear()
        raise
    finally:
        _OPEN.pop()
        remove(spark, made)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``materialize`` wrote."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    base = ensure_checkpoint_dir(spark).rstrip("/") + "/llm-"
    for path in paths:
        if path.startswith(base):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back (cuts lineage, survives lost executors)."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so other columns of the input can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def text_slices(batch: pa.RecordBatch, column: int, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch's string column into runs of rows of about ``step`` bytes.

    Yields (first row, last row + 1, bytes, offsets): the rows' UTF-8 bytes in
    one array, without a copy, and where each row starts and ends in it.
    A null text counts as empty. A row longer than ``step`` is a run of its own.
    """
    arr = batch.column(column)
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    if not wide and not pa.types.is_string(arr.type):
        arr, wide = arr.cast(pa.large_string()), True
    n = len(arr)
    if not n:
        return
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[arr.offset:arr.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + step, side="right")) - 1)
        last = min(last, n)
        yield first, last, whole[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def cut_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of a slice of texts, the maximal runs of bytes that the table ``inside`` marks: (start of each in the bytes, first word of each text, words).

    ``inside`` must hold all bytes over 127 or none, so that characters stay whole.
    """
    held = inside[data]
    head = held.copy()
    head[1:] &= ~held[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    head[firsts] = held[firsts]  # a text's first word starts with the text
    start = np.flatnonzero(head)
    letters = data[held]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(held, out=before[1:])
    ends = np.append(before[start], len(letters))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    return start, np.searchsorted(start, offsets), words


def hash_order(spark: SparkSession, *cols: str):
    """(bucket, order): a fixed pseudo-random order of rows by the hash of ``cols``.

    The bucket is a prefix of the hash, fine enough for the session's shuffle
    partitions, so a running count can be split by it without changing the order.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(6, (4 * parts - 1).bit_length())
    h = F.xxhash64(*cols)
    return F.shiftrightunsigned(h, 64 - bits).cast("int"), h


def gapless(df: DataFrame, group: list[str], order: list, out: str, by: tuple[str, ...]) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... within ``group`` in the hash order of ``by``, then ``order``.

    Two levels: counts per (group, hash bucket) and their running sum, then a
    row number inside one bucket only, so no task gets a whole group. Its
    input must be materialised: it is read twice.
    """
    from pyspark.sql import Window
    bucket, h = hash_order(df.sparkSession, *by)
    d = df.withColumn("__bucket", bucket).withColumn("__hash", h)
    counts = d.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*group, "__bucket", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(*group, "__bucket").orderBy("__hash", *order)
    ranked = d.withColumn("__rank", F.row_number().over(inner))
    return (ranked.join(base, [*group, "__bucket"])
            .withColumn(out, F.col("__base") + F.col("__rank").cast("long") - 1)
            .drop("__bucket", "__hash", "__base", "__rank"))


def keep_rows(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``decisions`` (id, sha, kept) keeps: one for each kept (id, SHA-256 of the text).

    A row is known by its id and its text, so null and repeated ids are told
    apart. Rows that repeat both are one kept row; the extra step that picks
    it runs only if there are any.
    """
    own = uuid.uuid4().hex  # names that no column of the input has
    key_id, key_sha, n, text_sha = (f"{own}_{x}" for x in ("id", "sha", "n", "text"))
    keys = (decisions.groupBy("id", "sha").agg(F.count(F.lit(1)).alias(n), F.max("kept").alias("kept")).where("kept")
            .select(F.col("id").alias(key_id), F.col("sha").alias(key_sha), n))
    keys = materialize(keys, "kept-keys")
    tagged = docs.withColumn(text_sha, F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256))
    hit = tagged.join(keys, F.col(f"`{id_col}`").eqNullSafe(F.col(key_id)) & (F.col(text_sha) == F.col(key_sha)))
    out = hit.where(F.col(n) == 1)
    if keys.where(F.col(n) > 1).limit(1).count():
        out = out.unionByName(hit.where(F.col(n) > 1).dropDuplicates([key_id, key_sha]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

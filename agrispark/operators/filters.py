"""Projections, filters and predicates.

All narrow; simple comparisons reach the parquet scan as ``PushedFilters``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import climate_zone, coerce_double, is_finite


def select_ordered(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """project and fix the column order."""
    return df.select(*cols)


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """keep rows whose listed columns are all non-null (NaN counts as null)."""
    cond = F.lit(True)
    for c in subset:
        col = F.col(c)
        ok = col.isNotNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            ok = ok & ~F.isnan(col)
        cond = cond & ok
    return df.where(cond)


def drop_blank(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """trimmed text must be non-empty (null also fails)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.trim(F.col(c)) != "")
    return df.where(cond)


def keep_labelled(df: DataFrame, target: str) -> DataFrame:
    """keep rows whose target coerces to a number; the target becomes double."""
    return df.withColumn(target, coerce_double(target)).where(F.col(target).isNotNull())


def finite_only(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """reject rows with null / NaN / +-inf in any listed column."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & is_finite(c)
    return df.where(cond)


def in_box(df: DataFrame, lat: str, lon: str, lat_lo: float, lat_hi: float,
           lon_lo: float, lon_hi: float) -> DataFrame:
    """F8: closed bounding box."""
    return df.where(F.col(lat).between(lat_lo, lat_hi) & F.col(lon).between(lon_lo, lon_hi))


def allowed_labels(scores: DataFrame, rules: DataFrame, row_key: str, label: str,
                   group: str, rule_group: str = "zone", rule_label: str = "crop") -> DataFrame:
    """keep a label only if listed for the row's group; if none survive, keep all.

    ``scores`` has one row per (row, label). The membership flag comes from a
    left join to the (small, fixed) rule table on ``(group, lower(label))``;
    ``max(flag) over (partition by row)`` tells whether anything survived.
    The window partitions by row key only, so no group can be hot beyond the
    number of labels. Adds ``allowed`` and ``fallback`` columns.
    """
    r = rules.select(F.col(rule_group).alias("__g"), F.lower(F.col(rule_label)).alias("__l"),
                     F.lit(True).alias("__allowed")).distinct()
    from .joins import bounded_broadcast
    j = scores.join(bounded_broadcast(r, what="zone rules"),
                    (F.col(group) == F.col("__g")) & (F.lower(F.col(label)) == F.col("__l")), "left")
    flag = F.coalesce(F.col("__allowed"), F.lit(False))
    from pyspark.sql import Window
    any_allowed = F.max(flag.cast("int")).over(Window.partitionBy(row_key)) == 1
    return (j.withColumn("allowed", flag)
             .withColumn("fallback", ~any_allowed)
             .where(F.col("allowed") | F.col("fallback"))
             .drop("__g", "__l", "__allowed"))


def with_zone(df: DataFrame, rain: str = "rainfall", out: str = "zone", default: str | None = None) -> DataFrame:
    """X3 as a column step."""
    return df.withColumn(out, climate_zone(rain, default))

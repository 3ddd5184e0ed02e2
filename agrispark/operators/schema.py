"""Schema, profiling and request-contract operators.

Everything here is either a metadata-only step (renames, checks; no job) or
a single-pass aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# --------------------------------------------------------------------------
# P1 profile_columns
# --------------------------------------------------------------------------

# fixed values: case-insensitive substrings that assign a column to a role
ROLE_PATTERNS = {
    "label": ("crop", "label", "yield"),
    "time": ("date", "time", "year", "month", "season"),
    "location": ("country", "state", "region", "location", "city", "lat", "lon"),
}


def column_roles(columns: Iterable[str], patterns: Mapping[str, Sequence[str]] = ROLE_PATTERNS) -> dict:
    """Role -> columns whose lower-cased name contains one of the substrings."""
    out = {}
    for role, subs in patterns.items():
        out[role] = [c for c in columns if any(s in c.lower() for s in subs)]
    return out


def profile_columns(df: DataFrame, patterns: Mapping[str, Sequence[str]] = ROLE_PATTERNS,
                    approx_distinct: bool = False) -> DataFrame:
    """One row per column: roles, row count, null share, distinct, min, max.

    Counts, nulls and extremes come from one aggregation. Exact distinct counts
    come from a second one for all columns together: each row gives its
    columns' (column, 128-bit hash) pairs, equal pairs fold in the task that makes them, and what is
    shuffled is 16 bytes per different value (no ``Expand`` per column).
    ``approx_distinct=True`` counts with HyperLogLog++ in the first pass instead.
    Arrays, maps and structs have neither distinct count nor extremes.
    """
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        col = F.col(f"`{c}`")
        dt = df.schema[c].dataType
        is_null = col.isNull()
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            is_null = is_null | F.isnan(col)
        aggs.append(F.count_if(is_null).alias(f"__nulls{i}"))
        if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
            aggs += [F.lit(None).cast("long").alias(f"__dist{i}"),
                     F.lit(None).cast("string").alias(f"__min{i}"),
                     F.lit(None).cast("string").alias(f"__max{i}")]
        else:
            dist = F.approx_count_distinct(col) if approx_distinct else F.lit(None).cast("long")
            aggs += [dist.alias(f"__dist{i}"),
                     F.min(col).cast("string").alias(f"__min{i}"),
                     F.max(col).cast("string").alias(f"__max{i}")]
    wide = df.agg(*aggs)
    roles = column_roles(cols, patterns)
    pieces = []
    for i, c in enumerate(cols):
        rl = ",".join(r for r in patterns if c in roles[r])
        pieces.append(F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"),
            F.lit(str(df.schema[c].dataType.simpleString())).alias("data_type"),
            F.lit(rl).alias("roles"),
            F.col("__n").alias("n_rows"),
            F.col(f"__nulls{i}").alias("n_null"),
            F.col(f"__dist{i}").alias("n_distinct"),
            F.col(f"__min{i}").alias("min_value"),
            F.col(f"__max{i}").alias("max_value")))
    out = wide.select(F.inline(F.array(*pieces)))
    plain = [i for i, c in enumerate(cols) if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]
    if plain and not approx_distinct:
        found = distinct_counts(df, [cols[i] for i in plain]).select(F.element_at(F.array(*[F.lit(i) for i in plain]), F.col("position") + 1).alias("position"), F.col("n_distinct").alias("__d"))
        exact = F.when(F.col("position").isin(plain), F.coalesce("__d", F.lit(0))).cast("long")
        out = out.join(found, "position", "left").withColumn("n_distinct", exact).drop("__d")
    return out.withColumn("null_share", F.try_divide(F.col("n_null").cast("double"),
                                                      F.col("n_rows").cast("double")))


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(position, n_distinct) of each column that has a value: different non-null values, told apart by two 64-bit hashes."""
    pairs = []
    for i, c in enumerate(cols):
        col = F.col(f"`{c}`")
        pairs.append(F.struct(F.lit(i).alias("position"), F.when(col.isNotNull(), F.struct(F.xxhash64(col).alias("a"), F.xxhash64(F.lit("#"), col).alias("b"))).alias("h")))
    values = df.select(F.inline(F.array(*pairs))).where(F.col("h").isNotNull())
    return values.groupBy("position", "h").agg(F.lit(1)).groupBy("position").agg(F.count(F.lit(1)).alias("n_distinct"))


# --------------------------------------------------------------------------
# Metadata-only helpers (no Spark job)
# --------------------------------------------------------------------------

def _squash(name: str) -> str:
    return "".join(name.lower().split())


def resolve_alias(df: DataFrame, aliases: Sequence[str]) -> str | None:
    """First existing column matching any alias, case/space-insensitive."""
    index = {_squash(c): c for c in df.columns}
    for a in aliases:
        hit = index.get(_squash(a))
        if hit is not None:
            return hit
    return None


def rename_aliases(df: DataFrame, alias_map: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename to canonical names using ``canonical -> [aliases]``."""
    ren = {}
    for canon, als in alias_map.items():
        hit = resolve_alias(df, [canon, *als])
        if hit is not None and hit != canon:
            ren[hit] = canon
    return df.withColumnsRenamed(ren) if ren else df


def rename_present(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename only the columns that exist."""
    ren = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(ren) if ren else df


def normalise_headers(df: DataFrame, label_from: str = "label", label_to: str = "crop_type") -> DataFrame:
    """Strip + lower every name; ``label`` -> ``crop_type`` unless present."""
    names = [c.strip().lower() for c in df.columns]
    if label_from in names and label_to not in names:
        names = [label_to if n == label_from else n for n in names]
    return df.toDF(*names)


def require_columns(df: DataFrame, cols: Sequence[str], what: str = "input") -> DataFrame:
    """P5: raise naming **all** missing columns; checked before any action."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
    return df


def infer_feature_kinds(df: DataFrame, target: str | None = None) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature names, target excluded.

    Booleans count as numeric (the pandas dtype rule the reference relies on).
    """
    num, cat = [], []
    for f in df.schema.fields:
        if f.name == target:
            continue
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            num.append(f.name)
        else:
            cat.append(f.name)
    return num, cat


def drop_columns_strict(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """drop; an unknown name is an error (plain ``drop`` ignores it)."""
    unknown = [c for c in cols if c not in df.columns]
    if unknown:
        raise ValueError(f"cannot drop unknown columns: {unknown}")
    return df.drop(*cols)


# --------------------------------------------------------------------------
# P9 conform: typed request contract with defaults, aliases, forbidden extras
# --------------------------------------------------------------------------

class Field:
    """One contract field: Spark type, default, aliases, min string length."""

    def __init__(self, name: str, dtype: str = "double", default=None, required: bool = False,
                 aliases: Sequence[str] = (), min_length: int | None = None, nullable: bool = False):
        self.name, self.dtype, self.default = name, dtype, default
        self.required, self.aliases, self.min_length = required, tuple(aliases), min_length
        self.nullable = nullable

    @property
    def keys(self) -> tuple[str, ...]:
        return (self.name, *self.aliases)


def conform(df: DataFrame, json_col: str, fields: Sequence[Field], extras: str = "forbid",
            id_col: str | None = None) -> DataFrame:
    """Parse a JSON request column against a contract.

    Returns the input columns plus one column per field and
    ``accepted boolean`` / ``reason string``. Rejections: invalid JSON, an
    unknown key (``extras="forbid"``), a missing required field, a value of the
    wrong type, a string shorter than ``min_length``. Narrow: no shuffle.
    """
    j = F.col(json_col)
    keys = F.json_object_keys(j)
    allowed = F.array(*[F.lit(k) for f in fields for k in f.keys])
    out = df
    reasons = [F.when(keys.isNull(), F.lit("invalid json"))]
    if extras == "forbid":
        extra = F.array_except(keys, allowed)
        reasons.append(F.when(F.size(extra) > 0,
                              F.concat(F.lit("unknown field: "), F.array_join(F.array_sort(extra), ","))))
    values = {}
    for f in fields:
        raw = F.coalesce(*[F.get_json_object(j, f"$.{k}") for k in f.keys])
        present = raw.isNotNull()
        if f.dtype == "string":
            typed = raw
            bad = F.lit(False)
            if f.min_length:
                bad = present & (F.length(F.trim(raw)) < f.min_length)
                reasons.append(F.when(bad, F.lit(f"{f.name}: too short")))
        else:
            typed = raw.try_cast(f.dtype)
            bad = present & typed.isNull() & (F.lower(raw) != "null")
            reasons.append(F.when(bad, F.lit(f"{f.name}: not a {f.dtype}")))
        if f.required:
            reasons.append(F.when(~present & keys.isNotNull(), F.lit(f"{f.name}: required")))
        default = F.lit(f.default).cast(f.dtype)
        values[f.name] = F.when(present, typed).otherwise(default)
    reason = F.coalesce(*reasons)
    out = out.withColumns(values)
    return out.withColumns({"reason": reason, "accepted": reason.isNull()})


# --------------------------------------------------------------------------
# P10 fill_missing_columns, P12 missing_count
# --------------------------------------------------------------------------

def fill_missing_columns(df: DataFrame, defaults: Mapping[str, object], order: Sequence[str] | None = None) -> DataFrame:
    """P10: an **absent** column gets a constant; present-but-null is kept.

    ``order`` (e.g. a model's feature list) fixes the output column order.
    """
    add = {}
    for c, v in defaults.items():
        if c not in df.columns:
            add[c] = F.lit(v) if v is not None else F.lit(None).cast("double")
    out = df.withColumns(add) if add else df
    return out.select(*order) if order else out


def missing_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: per-column missing count (null, or NaN for floats) + total."""
    cols = list(cols or df.columns)
    aggs = []
    for c in cols:
        col = F.col(f"`{c}`")
        miss = col.isNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(col)
        aggs.append(F.count_if(miss).alias(c))
    wide = df.agg(*aggs)
    total = None
    for c in cols:
        total = F.col(f"`{c}`") if total is None else total + F.col(f"`{c}`")
    return wide.withColumn("total_missing", total)

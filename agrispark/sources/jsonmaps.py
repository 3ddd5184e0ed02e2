"""JSON-shaped inputs.

The service received daily weather as nested JSON maps and parallel
arrays; here each document is a row and the shaping is done with
``from_json`` and higher-order functions, so nothing leaves the executors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP_OF_DOUBLES = "map<string,double>"


def keyed_maps_to_rows(df: DataFrame, key: str, json_col: str, params: Mapping[str, str],
                       path: str = "properties.parameter") -> DataFrame:
    """Several date -> value maps -> one row per (key, date).

    ``params`` maps JSON parameter names to output columns. The union of the
    date keys is taken, 'yyyymmdd' becomes 'yyyy-mm-dd', and dates where
    every parameter is null are dropped. Plan: ``from_json`` -> one
    ``explode`` per parameter (unioned) -> ``groupBy(key, date)`` with one
    conditional max per parameter.
    """
    schema = "struct<" + ",".join(f"`{p}`:{MAP_OF_DOUBLES}" for p in params) + ">"
    nested = F.from_json(F.get_json_object(F.col(json_col), "$." + path), schema)
    parts = None
    for p in params:
        e = df.select(key, F.lit(p).alias("__param"), F.explode(nested[p]).alias("__k", "__v"))
        parts = e if parts is None else parts.unionByName(e)
    g = parts.groupBy(key, "__k").agg(*[F.max(F.when(F.col("__param") == p, F.col("__v"))).alias(o)
                                         for p, o in params.items()])
    any_val = F.coalesce(*[F.col(o) for o in params.values()]).isNotNull()
    iso = F.concat_ws("-", F.substring("__k", 1, 4), F.substring("__k", 5, 2), F.substring("__k", 7, 2))
    return g.where(any_val & (F.length("__k") >= 8)).select(key, iso.alias("date"), *params.values())


def parallel_arrays_reduce(json_col: Column, fields: Sequence[tuple[str, str, float]]) -> Column:
    """Struct of reductions over arrays in one JSON object; null elements skipped.

    ``fields`` = [(array name, 'mean' | 'sum', default when empty), ...].
    Uses ``filter`` + ``aggregate`` (no explode, no shuffle).
    """
    schema = "struct<" + ",".join(f"`{n}`:array<double>" for n, _, _ in fields) + ">"
    parsed = F.from_json(json_col, schema)
    out = []
    for n, how, dflt in fields:
        vals = F.filter(parsed[n], lambda x: x.isNotNull())
        total = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x)
        cnt = F.size(vals)
        v = total / cnt if how == "mean" else total
        out.append(F.when(F.coalesce(cnt, F.lit(0)) > 0, v).otherwise(F.lit(float(dflt))).alias(n))
    return F.struct(*out)


def climatology_extract(json_col: Column, params: Sequence[tuple[str, str, float, float]],
                        period: str = "ANN", path: str = "properties.parameter") -> Column:
    """Nested per-parameter value for one period key (annual 'ANN' or a date key).

    ``params`` = [(parameter, output, default, multiplier), ...]; a missing
    parameter gives ``default`` (before the multiplier, as the service did:
    rain = daily mean x 365, default 2.0 x 365).
    """
    schema = "struct<" + ",".join(f"`{p}`:{MAP_OF_DOUBLES}" for p, _, _, _ in params) + ">"
    nested = F.from_json(F.get_json_object(json_col, "$." + path), schema)
    cols = []
    for p, out, dflt, mult in params:
        v = F.coalesce(F.element_at(nested[p], F.lit(period)), F.lit(float(dflt)))
        cols.append((v * F.lit(float(mult)) if mult != 1 else v).alias(out))
    return F.struct(*cols)


def source_fallback(primary: DataFrame, secondary: DataFrame, key: str, fields: Sequence[str],
                    defaults: Mapping[str, float], tags=("live_api", "fallback", "default")) -> DataFrame:
    """Whole-row fallback: the first source with any value wins, else constants.

    Returns key, the fields and a ``source`` tag. Missing single fields of the
    winning source get the default constants.
    """
    p = primary.select(key, *[F.col(f).alias(f"__p_{f}") for f in fields])
    s = secondary.select(key, *[F.col(f).alias(f"__s_{f}") for f in fields])
    j = p.join(s, key, "left")
    p_any = F.coalesce(*[F.col(f"__p_{f}") for f in fields]).isNotNull()
    s_any = F.coalesce(*[F.col(f"__s_{f}") for f in fields]).isNotNull()
    out = [F.col(key)]
    for f in fields:
        d = F.lit(float(defaults[f]))
        out.append(F.when(p_any, F.coalesce(F.col(f"__p_{f}"), d))
                   .when(s_any, F.coalesce(F.col(f"__s_{f}"), d)).otherwise(d).alias(f))
    out.append(F.when(p_any, tags[0]).when(s_any, tags[1]).otherwise(tags[2]).alias("source"))
    return j.select(*out)


def to_geojson_features(df: DataFrame, id_col: str, props: Mapping[str, Column | str],
                        lon: str = "lng", lat: str = "lat") -> DataFrame:
    """One GeoJSON point feature per row (``id`` is an explicit ordinal column)."""
    prop_cols = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in props.items()]
    feat = F.struct(F.lit("Feature").alias("type"), F.col(id_col).alias("id"),
                    F.struct(*prop_cols).alias("properties"),
                    F.struct(F.lit("Point").alias("type"),
                             F.array(F.col(lon), F.col(lat)).alias("coordinates")).alias("geometry"))
    return df.select(F.col(id_col), F.to_json(feat).alias("feature"))

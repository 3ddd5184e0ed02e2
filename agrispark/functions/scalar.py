"""Narrow ``Column`` expressions: no Python UDFs, all inside whole-stage codegen.

Each function takes column names or ``Column`` objects and returns a
``Column``; none of them adds a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


# --------------------------------------------------------------------------
# Coercion (P7, P8, P11) and keys
# --------------------------------------------------------------------------

def coerce_double(c) -> Column:
    """Text or number -> double; unparsable text and NaN -> null.

    ``try_cast`` keeps ANSI mode from raising; NaN is turned into null right
    after parsing because pandas treats it as missing (trap T2).
    """
    parsed = F.trim(_c(c).cast("string")).try_cast("double")
    return F.when(F.isnan(parsed), F.lit(None).cast("double")).otherwise(parsed)


def coerce_double_in(df, c: str) -> Column:
    """P7 with the schema at hand: numeric columns are cast directly (no text
    round trip per row); text and other types take the ``try_cast`` path."""
    from pyspark.sql import types as T
    dt = df.schema[c].dataType
    if isinstance(dt, (T.NumericType, T.BooleanType)):
        v = F.col(c).cast("double")
        return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)
    return coerce_double(c)


def coerce_int_in(df, c: str) -> Column:
    """Integer coercion with the schema at hand (``try_cast`` only for text)."""
    from pyspark.sql import types as T
    dt = df.schema[c].dataType
    if isinstance(dt, T.IntegralType):
        return F.col(c).cast("int")
    return F.trim(F.col(c).cast("string")).try_cast("int")


def coerce_timestamp(c, fmt: str | None = None) -> Column:
    """Unparsable text -> null (``to_timestamp`` would raise under ANSI)."""
    col = _c(c).cast("string")
    ts = F.try_to_timestamp(col, F.lit(fmt)) if fmt else F.try_to_timestamp(col)
    return ts.cast("timestamp_ntz")


def fill_null(c, default) -> Column:
    """Null (or unparsable) value -> default."""
    return F.coalesce(coerce_double(c), F.lit(float(default)))


def norm_key(c) -> Column:
    """Trim + lower, the join/grouping form of a label."""
    return F.lower(F.trim(_c(c)))


def year_start_ts(y) -> Column:
    """Year -> Jan 1 00:00 timestamp (no zone); bad year -> null."""
    col = _c(y)
    yr = F.trim(col.cast("string")).try_cast("int") if not isinstance(y, int) else F.lit(y)
    return F.try_make_timestamp_ntz(yr, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def year_start_ts_int(y) -> Column:
    """X2 for an integer year column (no text round trip)."""
    return F.try_make_timestamp_ntz(_c(y), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def date_key_iso(k) -> Column:
    """X20a: 'yyyymmdd' -> 'yyyy-mm-dd'."""
    s = _c(k).cast("string")
    return F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))


def geo_key_part(x) -> Column:
    """Coordinate rounded to 3 decimals as an exact integer key (milli-degrees).

    Integer keys avoid float-equality joins; ``round`` is HALF_UP on the
    decimal value.
    """
    return F.round(_c(x) * 1000).cast("long")


# --------------------------------------------------------------------------
# Climate rules
# --------------------------------------------------------------------------

def climate_zone(rain, default: str | None = None) -> Column:
    """<250 arid, <=800 temperate, >800 tropical; null rain -> ``default``.

    Training code says temperate for a missing value and serving says tropical
    (trap T4); the caller picks with ``default``.
    """
    r = _c(rain)
    return (F.when(r.isNull() | F.isnan(r), F.lit(default))
            .when(r < 250, F.lit("arid"))
            .when(r <= 800, F.lit("temperate"))
            .otherwise(F.lit("tropical")))


def climate_score(t, h, r) -> Column:
    """0.4*t + 0.3*h + 0.3*r."""
    return _c(t) * 0.4 + _c(h) * 0.3 + _c(r) * 0.3


def climate_weight(t, r, tmin, tmax, rmin, rmax) -> Column:
    """0 beyond t+-5 / r+-300 of the band, 0.45 outside the band, else 1.

    A row whose rule columns are null (crop without a rule) gets 1.0.
    """
    t, r, tmin, tmax, rmin, rmax = map(_c, (t, r, tmin, tmax, rmin, rmax))
    return (F.when(tmin.isNull(), F.lit(1.0))
            .when((t < tmin - 5) | (t > tmax + 5), F.lit(0.0))
            .when((r < rmin - 300) | (r > rmax + 300), F.lit(0.0))
            .when((t < tmin) | (t > tmax), F.lit(0.45))
            .when((r < rmin) | (r > rmax), F.lit(0.45))
            .otherwise(F.lit(1.0)))


def rice_boost(crop, rain, label: str = "rice", above: float = 1200.0,
               factor: float = 1.2) -> Column:
    """Multiplier ``factor`` for one label when rain > ``above``, else 1."""
    return F.when((F.lower(_c(crop)) == label) & (_c(rain) > above), F.lit(factor)).otherwise(F.lit(1.0))


def weather_score(t, r) -> Column:
    """int(max(0, 100 - min(3|t-24|, 50) - min(|r-900|/25, 50))), truncating."""
    tp = F.least(F.abs(_c(t) - 24.0) * 3.0, F.lit(50.0))
    rp = F.least(F.abs(_c(r) - 900.0) / 25.0, F.lit(50.0))
    return F.greatest(F.lit(0.0), F.lit(100.0) - tp - rp).cast("int")


def risk_from_probability(p) -> Column:
    """>0.6 low, >=0.4 medium, else high."""
    p = _c(p)
    return F.when(p > 0.6, "low").when(p >= 0.4, "medium").otherwise("high")


def risk_from_change(pct) -> Column:
    """<=-25 high, <=-10 medium, else low."""
    pct = _c(pct)
    return F.when(pct <= -25, "high").when(pct <= -10, "medium").otherwise("low")


def risk_from_sign(y) -> Column:
    """>0 low else high."""
    return F.when(_c(y) > 0, "low").otherwise("high")


def pct_change(y, base) -> Column:
    """X11: (y-b)/b*100, 0 when b = 0 (or null)."""
    return F.coalesce(F.try_divide(_c(y) - _c(base), _c(base)) * 100.0, F.lit(0.0))


# --------------------------------------------------------------------------
# Place rules
# --------------------------------------------------------------------------

def box_province(lat, lon, outer: tuple, boxes: Sequence[tuple]) -> Column:
    """Outside ``outer`` -> null; first matching box -> its name; else 'Unknown'.

    ``outer`` = (lat_lo, lat_hi, lon_lo, lon_hi); ``boxes`` = [(name, lat_lo,
    lat_hi, lon_lo, lon_hi), ...] in priority order. Closed intervals.
    """
    la, lo = _c(lat), _c(lon)
    a0, a1, o0, o1 = outer
    expr = F.when(~(la.between(a0, a1) & lo.between(o0, o1)) | la.isNull() | lo.isNull(),
                  F.lit(None).cast("string"))
    for name, b0, b1, c0, c1 in boxes:
        expr = expr.when(la.between(b0, b1) & lo.between(c0, c1), F.lit(name))
    return expr.otherwise(F.lit("Unknown"))


def region_fallback(country, region, lat, lon, outer, boxes, box_country: str) -> Column:
    """Keep a known region; else the box province; the box's country is implied.

    Returns struct(country, region).
    """
    reg = F.trim(_c(region).cast("string"))
    known = reg.isNotNull() & ~F.lower(reg).isin("unknown", "none", "")
    prov = box_province(lat, lon, outer, boxes)
    out_region = F.when(known, reg).otherwise(F.coalesce(prov, F.lit("Unknown")))
    out_country = (F.when(known, _c(country))
                   .when(prov.isNotNull() & (prov != "Unknown"), F.lit(box_country))
                   .otherwise(F.coalesce(_c(country), F.lit("Unknown"))))
    return F.struct(out_country.alias("country"), out_region.alias("region"))


def default_by_substring(text, rules: Sequence[tuple], default: float) -> Column:
    """First rule whose substring occurs in lower(text) gives the value."""
    t = F.lower(_c(text))
    expr = None
    for needle, value in rules:
        cond = F.contains(t, F.lit(needle))
        expr = F.when(cond, F.lit(float(value))) if expr is None else expr.when(cond, F.lit(float(value)))
    return F.lit(float(default)) if expr is None else expr.otherwise(F.lit(float(default)))


def first_address_part(js, keys: Sequence[str], default: str = "Unknown") -> Column:
    """First non-empty (trimmed) value among ``keys`` of a JSON object."""
    vals = [F.nullif(F.trim(F.get_json_object(_c(js), f"$.{k}")), F.lit("")) for k in keys]
    return F.coalesce(*vals, F.lit(default))


# --------------------------------------------------------------------------
# Derived numbers
# --------------------------------------------------------------------------

def delta(a, b) -> Column:
    """A - b."""
    return _c(a) - _c(b)


def safe_ratio(a, b) -> Column:
    """A / b, zero divisor -> null."""
    return _c(a) / F.nullif(_c(b), F.lit(0.0))


def log_target(y) -> Column:
    """log1p before fitting."""
    return F.log1p(_c(y))


def exp_target(y) -> Column:
    """expm1 after predicting."""
    return F.expm1(_c(y))


def clamp_nonneg(y) -> Column:
    """max(0, y)."""
    return F.greatest(F.lit(0.0), _c(y))


def is_finite(x) -> Column:
    """F6 helper: not null, not NaN, not +-inf."""
    x = _c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


# --------------------------------------------------------------------------
# Text (X21, X22, X24, X25)
# --------------------------------------------------------------------------

def nutrient_advice(values: dict, lows: dict, highs: dict) -> Column:
    """Fertiliser advice from per-feature (low, high) thresholds.

    ``values`` maps N/P/K/rainfall/temperature to value columns; ``lows`` and
    ``highs`` map the same names to threshold columns (null -> rule skipped).
    """
    # fixed values: advice phrases and the default sentence
    parts = []
    for n in ("N", "P", "K"):
        if n in values:
            v, lo, hi = _c(values[n]), _c(lows[n]), _c(highs[n])
            parts.append(F.when(v < lo, F.lit(f"increase {n}")).when(v > hi, F.lit(f"reduce {n}")))
    if "rainfall" in values:
        v, lo, hi = _c(values["rainfall"]), _c(lows["rainfall"]), _c(highs["rainfall"])
        parts.append(F.when(v < lo, F.lit("consider irrigation / moisture retention"))
                     .when(v > hi, F.lit("consider drainage / split fertilizer applications")))
    if "temperature" in values:
        v, lo, hi = _c(values["temperature"]), _c(lows["temperature"]), _c(highs["temperature"])
        parts.append(F.when(v < lo, F.lit("use cold-tolerant practices"))
                     .when(v > hi, F.lit("use heat-stress mitigation practices")))
    actions = F.concat_ws("; ", *parts)
    return F.when(actions == "", F.lit(
        "Maintain balanced NPK; apply fertilizer based on soil test and local guidelines."
    )).otherwise(F.concat(F.lit("Fertilizer suggestion: "), actions, F.lit(".")))


def title_case(s) -> Column:
    """Python ``str.title`` for labels: ``initcap`` on the lower-cased text."""
    return F.initcap(F.lower(_c(s)))


def insight_text(top_label, rain, low_rain: float = 300.0) -> Column:
    """struct(summary, warnings)."""
    summary = F.when(_c(top_label).isNull(), F.lit("No crop recommendation")).otherwise(
        F.concat(F.lit("Ideal for "), title_case(top_label), F.lit(" due to moderate rainfall")))
    warnings = F.when(_c(rain) < low_rain, F.array(F.lit("Low rainfall"))).otherwise(
        F.array().cast("array<string>"))
    return F.struct(summary.alias("summary"), warnings.alias("warnings"))


def metric_label(acc_holdout, f1_holdout, acc, f1) -> Column:
    """Display string by the first available metric, two decimals."""
    fmt = lambda x: F.format_string("%.2f", _c(x))
    return (F.when(_c(acc_holdout).isNotNull(),
                   F.concat(F.lit("Acc "), fmt(acc_holdout), F.lit(" | F1 "),
                            F.format_string("%.2f", F.coalesce(_c(f1_holdout), F.lit(0.0)))))
            .when(_c(acc).isNotNull(),
                  F.concat(F.lit("Acc "), fmt(acc), F.lit(" | F1 "),
                           F.format_string("%.2f", F.coalesce(_c(f1), F.lit(0.0)))))
            .otherwise(F.lit("Metrics tracked")))


def availability_label(present, available, error) -> Column:
    """Online / Error / Missing / Unknown."""
    return (F.when(~F.coalesce(_c(present), F.lit(False)), F.lit("Unknown"))
            .when(F.coalesce(_c(available), F.lit(False)), F.lit("Online"))
            .when(F.coalesce(F.length(_c(error)), F.lit(0)) > 0, F.lit("Error"))
            .otherwise(F.lit("Missing")))


def confidence_gate(model_label, rule_label, conf, threshold: float = 0.40) -> Column:
    """struct(label, selection): rule label when confidence is null or low."""
    use_rule = _c(conf).isNull() | (_c(conf) < threshold)
    return F.struct(F.when(use_rule, _c(rule_label)).otherwise(_c(model_label)).alias("label"),
                    F.when(use_rule, F.lit("rule_based")).otherwise(F.lit("trained_model")).alias("selection"))

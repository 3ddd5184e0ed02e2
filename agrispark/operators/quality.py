"""Data quality: guards and check tables.

Guards raise on the driver after a bounded action; check tables are one
aggregation pass each, unioned into ``(check, column, metric, passed)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import norm_key
from .schema import missing_count


def text_fingerprint(c: Column) -> Column:
    """128-bit fingerprint of a text (two independent 64-bit hashes); null stays null.

    Distinct counts and duplicate detection shuffle 16 bytes per row instead
    of whole documents; a collision needs both 64-bit hashes to agree.
    """
    return F.when(c.isNotNull(), F.struct(F.xxhash64(c).alias("h1"),
                                          F.xxhash64(F.lit("#"), c).alias("h2")))


class DataQualityError(ValueError):
    pass


def assert_no_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Q1: one row (total_missing, passed); ``require_no_nulls`` raises instead."""
    mc = missing_count(df, cols)
    return mc.select(F.col("total_missing"), (F.col("total_missing") == 0).alias("passed"))


def require_no_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> None:
    row = assert_no_nulls(df, cols).first()
    if not row["passed"]:
        raise DataQualityError(f"{row['total_missing']} missing values")


def min_classes(df: DataFrame, label: str, minimum: int = 5) -> DataFrame:
    """Q3: (n_classes, passed) with passed = n_classes >= minimum."""
    return df.agg(F.count_distinct(label).alias("n_classes")).withColumn(
        "passed", F.col("n_classes") >= minimum)


def require_min_classes(df: DataFrame, label: str, minimum: int = 5) -> None:
    n = min_classes(df, label, minimum).first()["n_classes"]
    if n < minimum:
        raise DataQualityError(f"need at least {minimum} classes, found {n}")


def min_history(split_df: DataFrame, key: str = "series_key", split: str = "split",
                min_train: int = 24, min_test: int = 6) -> DataFrame:
    """Q4: per series (n_train, n_test, passed)."""
    g = split_df.groupBy(key).agg(F.count_if(F.col(split) == "train").alias("n_train"),
                                  F.count_if(F.col(split) == "test").alias("n_test"))
    return g.withColumn("passed", (F.col("n_train") >= min_train) & (F.col("n_test") >= min_test))


def require_non_empty(df: DataFrame, what: str = "result") -> DataFrame:
    """Q5: raise if nothing valid remains (``isEmpty`` reads at most one row)."""
    if df.isEmpty():
        raise DataQualityError(f"no valid rows left in {what}")
    return df


def forbidden_label_check(scored: DataFrame, zone: str, label: str, rules: DataFrame,
                          fallback: str = "fallback", rule_zone: str = "zone", rule_label: str = "crop") -> DataFrame:
    """Q6: rows whose label is not allowed in their zone yet survived a zone filter.

    Returns (zone, label, n_violations); an empty result means the check passed.
    Fallback rows (no allowed label at all) are exempt.
    """
    allowed = rules.select(F.col(rule_zone).alias(zone), F.lower(rule_label).alias("__l")).distinct()
    s = scored.where(~F.col(fallback)).withColumn("__l", F.lower(label))
    from .joins import bounded_broadcast
    bad = s.join(bounded_broadcast(allowed, what="zone rules"), [zone, "__l"], "left_anti")
    return bad.groupBy(zone, label).agg(F.count(F.lit(1)).alias("n_violations"))


def reject_counts(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Q7: rows entering and leaving each cleaning step, from one aggregation pass.

    ``steps`` = [(name, keep_condition), ...] applied in order.
    """
    aggs = [F.count(F.lit(1)).alias("__n0")]
    cum = F.lit(True)
    for i, (_, cond) in enumerate(steps):
        cum = cum & F.coalesce(cond, F.lit(False))
        aggs.append(F.count_if(cum).alias(f"__n{i + 1}"))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("rule"),
                     F.col(f"__n{i}").alias("rows_in"), F.col(f"__n{i + 1}").alias("rows_out"))
            for i, (name, _) in enumerate(steps)]
    return wide.select(F.inline(F.array(*rows))).withColumn("rejected", F.col("rows_in") - F.col("rows_out"))


#: What a text must look like to count as a number or a date.
NUMBER_LIKE = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
DATE_LIKE = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?\s*$"


def type_census(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n_number, n_date, n_word, n_blank) of text columns: what their non-null values look like, in one pass."""
    aggs, rows = [], []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`").cast("string")
        number, date, blank = v.rlike(NUMBER_LIKE), v.rlike(DATE_LIKE), F.trim(v) == ""
        aggs += [F.count_if(number).alias(f"n{i}"), F.count_if(date).alias(f"d{i}"), F.count_if(blank).alias(f"b{i}"), F.count(v).alias(f"all{i}")]
        rest = F.col(f"all{i}") - F.col(f"n{i}") - F.col(f"d{i}") - F.col(f"b{i}")
        rows.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_number"), F.col(f"d{i}").alias("n_date"), rest.alias("n_word"), F.col(f"b{i}").alias("n_blank")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def associations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n, association) of each pair of categorical columns: Cramer's V from their contingency table.

    The tables of all pairs are one aggregation (rows where both have a value);
    totals and the statistic come from the tables, a row per occurring combination. A pair of which
    one side has a single category has no association (0).
    """
    from .joins import written
    pairs = [F.struct(F.lit(f"{a}|{b}").alias("column"), F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b"))
             for i, a in enumerate(cols) for b in cols[i + 1:]]
    cells = written(df.select(F.inline(F.array(*pairs))).where(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy("column", "a", "b").agg(F.count(F.lit(1)).alias("n")))
    by_a = cells.groupBy("column", "a").agg(F.sum("n").alias("na"))
    by_b = cells.groupBy("column", "b").agg(F.sum("n").alias("nb"))
    sides = by_a.groupBy("column").agg(F.sum("na").alias("total"), F.count(F.lit(1)).alias("ka")).join(by_b.groupBy("column").agg(F.count(F.lit(1)).alias("kb")), "column")
    share = F.col("n") * F.col("n") / (F.col("na").cast("double") * F.col("nb"))
    phi = cells.join(by_a, ["column", "a"]).join(by_b, ["column", "b"]).groupBy("column").agg((F.sum(share) - 1).alias("phi2"))
    least = F.least("ka", "kb") - 1
    v = F.when(least > 0, F.sqrt(F.greatest(F.col("phi2"), F.lit(0.0)) / least)).otherwise(0.0)
    return sides.join(phi, "column").select("column", F.col("total").alias("n"), v.alias("association"))


def integrity_report(df: DataFrame, text_cols: Sequence[str], label: str | None = None,
                     numeric_cols: Sequence[str] = (), dup_cols: Sequence[str] | None = None,
                     special_max: float = 0.1, outlier_max: float = 0.05, corr_max: float = 0.95,
                     categorical_cols: Sequence[str] = (), mixed_max: float = 0.01) -> DataFrame:
    """Q2: integrity checks as one table ``(check, column, metric, passed)``; warns, never fails.

    Checks: single-value columns, mixed null spellings ('null', 'nan', ''),
    mixed types (share of values that don't look like the column's commonest kind:
    number, date or word), special-character-only share, string variants after trim/lower,
    duplicate rows, string-length outliers (IQR rule), conflicting labels for
    identical rows, feature-feature / feature-label correlations, and the
    association (Cramer's V) of each pair of ``categorical_cols``. Each
    family is one aggregation (partial + final), unioned at the end. Texts
    are compared through 128-bit fingerprints, so documents are never
    shuffled whole.
    """
    parts = []

    def row(check, column, metric, passed):
        return F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"),
                        metric.cast("double").alias("metric"), passed.alias("passed"))

    aggs, structs = [], []
    for i, c in enumerate(text_cols):
        col = F.col(c)
        low = F.lower(F.trim(col))
        aggs += [F.count_distinct(text_fingerprint(col)).alias(f"d{i}"),
                 F.count_if(low.isin("null", "nan", "")).alias(f"mn{i}"),
                 F.avg(F.when(col.isNotNull(), (~col.rlike(r"[\p{L}\p{N}]")).cast("double"))).alias(f"sp{i}"),
                 F.count_distinct(text_fingerprint(norm_key(col))).alias(f"dn{i}")]
        structs += [row("single_value", c, F.col(f"d{i}"), F.col(f"d{i}") > 1),
                    row("mixed_nulls", c, F.col(f"mn{i}"), F.col(f"mn{i}") == 0),
                    row("special_characters", c, F.coalesce(F.col(f"sp{i}"), F.lit(0.0)),
                        F.coalesce(F.col(f"sp{i}"), F.lit(0.0)) < special_max),
                    row("string_variants", c, F.col(f"d{i}") - F.col(f"dn{i}"), F.col(f"d{i}") == F.col(f"dn{i}"))]
    for j, c in enumerate(numeric_cols):
        aggs.append(F.count_distinct(c).alias(f"nd{j}"))
        structs.append(row("single_value", c, F.col(f"nd{j}"), F.col(f"nd{j}") > 1))
        if label is not None:
            aggs.append(F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(f"cl{j}"))
            m = F.abs(F.coalesce(F.col(f"cl{j}"), F.lit(0.0)))
            structs.append(row("feature_label_correlation", c, m, m < corr_max))
        for k in range(j + 1, len(numeric_cols)):
            c2 = numeric_cols[k]
            aggs.append(F.corr(F.col(c).cast("double"), F.col(c2).cast("double")).alias(f"cf{j}_{k}"))
            m = F.abs(F.coalesce(F.col(f"cf{j}_{k}"), F.lit(0.0)))
            structs.append(row("feature_feature_correlation", f"{c}|{c2}", m, m < corr_max))
    parts.append(df.agg(*aggs).select(F.inline(F.array(*structs))))

    # duplicate rows and conflicting labels: group by the row content once
    keys = list(dup_cols or text_cols)
    fp = [text_fingerprint(F.col(k)).alias(f"__fp{i}") if isinstance(df.schema[k].dataType, T.StringType)
          else F.col(k) for i, k in enumerate(keys)]
    g = df.groupBy(*fp).agg(F.count(F.lit(1)).alias("__n"),
                              *([F.count_distinct(label).alias("__nl")] if label else []))
    agg2 = [F.sum(F.col("__n") - 1).alias("dups")]
    st2 = [row("duplicate_rows", ",".join(keys), F.coalesce(F.col("dups"), F.lit(0)),
               F.coalesce(F.col("dups"), F.lit(0)) == 0)]
    if label:
        agg2.append(F.count_if(F.col("__nl") > 1).alias("conf"))
        st2.append(row("conflicting_labels", label, F.col("conf"), F.col("conf") == 0))
    parts.append(g.agg(*agg2).select(F.inline(F.array(*st2))))

    # string length outliers (IQR rule): lengths of all text columns unpivoted to
    # (column, length); one distributed quartile pass per quartile, keyed by column
    from .aggregates import quantiles
    stack = "stack({}, {}) as (__col, __len)".format(
        len(text_cols), ", ".join(f"'{c}', cast(length(`{c}`) as double)" for c in text_cols))
    lens = df.select(F.expr(stack))
    qq = quantiles(lens, ["__col"], "__len", [0.25, 0.75], ["__q1", "__q3"])
    bounds = qq.select("__col", (F.col("__q1") - 1.5 * (F.col("__q3") - F.col("__q1"))).alias("__lo"),
                                         (F.col("__q3") + 1.5 * (F.col("__q3") - F.col("__q1"))).alias("__hi"))
    flagged = lens.join(bounds, "__col", "left").groupBy("__col").agg(F.avg(F.when(
        F.col("__len").isNotNull(), ((F.col("__len") < F.col("__lo")) | (F.col("__len") > F.col("__hi"))).cast("double")))
        .alias("__s"))
    share = F.coalesce(F.col("__s"), F.lit(0.0))
    parts.append(flagged.select(F.lit("length_outliers").alias("check"), F.col("__col").alias("column"),
                                share.alias("metric"), (share < outlier_max).alias("passed")))
    census = type_census(df, text_cols)
    kinds = [F.col(c) for c in ("n_number", "n_date", "n_word")]
    odd = F.coalesce(F.try_divide((sum(kinds[1:], kinds[0]) - F.greatest(*kinds)).cast("double"), sum(kinds[1:], kinds[0]).cast("double")), F.lit(0.0))
    parts.append(census.select(F.lit("mixed_types").alias("check"), "column", odd.alias("metric"), (odd < mixed_max).alias("passed")))
    if len(categorical_cols) > 1:
        tied = associations(df, list(categorical_cols))
        parts.append(tied.select(F.lit("association").alias("check"), "column", F.col("association").alias("metric"), (F.col("association") < corr_max).alias("passed")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Feature preparation.

Every statistic is fit on the training rows only (trap T14) in **one**
aggregation pass and applied as literal values or scalar subqueries, so the
scoring side stays a narrow projection. Splits are md5-keyed: deterministic,
shuffle-free (M1) and reproducible in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import collect_bounded, join_measured, written, written_measured
from .ranking import sample_key

TWO32 = float(2 ** 32)


def random_split(df: DataFrame, key: str, test_frac: float = 0.2, seed: int = 42,
                 out: str = "dataset_split") -> DataFrame:
    """M1: hash of (key, seed) / 2^32 < test_frac -> 'test', else 'train'. No shuffle."""
    u = sample_key(key, seed).cast("double") / TWO32
    return df.withColumn(out, F.when(u < test_frac, "test").otherwise("train"))


def first_k_by_hash(df: DataFrame, group: str, key: str, k_per_group: DataFrame | float, seed: int = 42,
                    buckets: int = 65536, out: str = "__take") -> DataFrame:
    """Flag the first ``k`` rows per group in md5(key|seed) order; the rows themselves are not shuffled.

    ``k_per_group`` has columns (group, k), or is a share of each group's rows (rounded down). Equivalent to
    ``row_number() over (partition by group order by h, key) <= k`` for unique
    keys (rows of one key stand or fall together). It finds the k-th row's
    (hash, key) of each group and compares every row with it:

    1. counts per (group, hash bucket) and their running total give the one
       bucket that holds the k-th row;
    2. the rows of those buckets (one in ``buckets``) are written, counted per
       hash in the same way, and only rows of the one hash are ranked by key;
    3. the thresholds, a row per group, are joined to the rows by
       ``join_measured``.

    A null group is a group of its own; a group without ``k`` takes none.
    """
    g, h = F.struct(F.col(group).alias("g")).alias("__grp"), F.coalesce(sample_key(key, seed).cast("long"), F.lit(-1))
    bucket = F.floor(F.greatest(F.col("__h"), F.lit(0)) / F.lit(TWO32 / buckets))
    d = df.select(g, h.alias("__h"), F.col(key).alias("__key")).withColumn("__b", bucket)
    share = k_per_group if isinstance(k_per_group, float) else None

    def holder(counted: DataFrame, by: str) -> DataFrame:
        """(__grp, by, __k less what lies before): the place in the order of ``by`` that holds the k-th row."""
        w = Window.partitionBy("__grp").orderBy(by)
        to = counted.withColumn("__to", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(Window.partitionBy("__grp")))
        k = F.least("__k", "__all") if "__k" in counted.columns else F.floor(F.col("__all") * F.lit(share))
        at = (F.col("__to") >= k) & (F.col("__to") - F.col("__n") < k)
        return to.where(at).select("__grp", by, (k - F.col("__to") + F.col("__n")).alias("__k"))

    counted = d.groupBy("__grp", "__b").agg(F.count(F.lit(1)).alias("__n"))
    at = holder(counted if share is not None else counted.join(k_per_group.select(g, F.col("k").cast("long").alias("__k")), "__grp"), "__b")
    near = written(join_measured(d, at, ["__grp", "__b"], "inner"))
    at = holder(near.groupBy("__grp", "__h").agg(F.count(F.lit(1)).alias("__n"), F.first("__k").alias("__k")), "__h")
    keys = near.drop("__k").join(at, ["__grp", "__h"])
    nth = F.row_number().over(Window.partitionBy("__grp").orderBy("__key"))
    last = keys.withColumn("__nth", nth).where(F.col("__nth") == F.col("__k")).select("__grp", F.struct("__h", "__key").alias("__last"))
    j = join_measured(df.withColumn("__grp", g), last, ["__grp"])
    here = F.struct(h.alias("__h"), F.col(key).alias("__key"))
    return j.withColumn(out, F.coalesce(here <= F.col("__last"), F.lit(False))).drop("__grp", "__last")


def stratified_split(df: DataFrame, label: str, key: str, test_frac: float = 0.2, seed: int = 42,
                     out: str = "dataset_split", buckets: int = 65536) -> DataFrame:
    """M2: per class, the first floor(n_c * (1 - test_frac)) rows in md5(key|seed) order train.

    Equivalent to ``row_number() over (partition by label order by h, key)``
    but skew-safe (see ``first_k_by_hash``): a window partitioned by label
    would put a hot class into one task.
    """
    t = first_k_by_hash(df, label, key, 1.0 - test_frac, seed, buckets)
    return t.withColumn(out, F.when(F.col("__take"), "train").otherwise("test")).drop("__take")


def _is_train(split_col: str) -> Column:
    return F.col(split_col) == "train"


def impute_median(df: DataFrame, cols: Sequence[str], split_col: str = "dataset_split",
                  approx: bool = False) -> DataFrame:
    """M3: nulls -> medians fit on the train rows (exact ``percentile``; ``approx`` for huge data)."""
    from .aggregates import group_quantiles
    tr = df.where(_is_train(split_col))
    meds = group_quantiles(tr, [], list(cols), 0.5, "approx" if approx else "distributed")
    stats = collect_bounded(meds, 1, "median row")[0]
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(stats[c])) for c in cols})


def category_counts(df: DataFrame, cols: Sequence[str], split_col: str = "dataset_split") -> DataFrame:
    """(column, value, n) of the train rows' non-null values of text columns: all columns in one aggregation, written."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in cols])
    each = df.where(_is_train(split_col)).select(F.inline(pairs)).where(F.col("value").isNotNull())
    return written(each.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def _text_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]


def impute_mode(df: DataFrame, cols: Sequence[str], split_col: str = "dataset_split", counts: DataFrame | None = None) -> DataFrame:
    """M4: nulls -> most frequent train value (ties -> smallest). ``counts``: ``category_counts`` of the text columns, if there already."""
    text = _text_columns(df, cols)
    fills = {}
    if text:
        counts = category_counts(df, text, split_col) if counts is None else counts
        top = counts.where(F.col("column").isin(text)).groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("top"))
        found = {r["column"]: r["value"] for r in top.select("column", "top.value").collect()}  # a row per column
        fills = {c: F.coalesce(F.col(f"`{c}`"), F.lit(found[c])) for c in text if c in found}
    for c in cols:
        if c in text:
            continue
        # count per value (a distributed aggregation), then the top-1 by (count desc, value asc)
        top = (df.where(_is_train(split_col) & F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
                 .orderBy(F.col("__n").desc(), F.col(c).asc()).limit(1))
        rows = top.collect()
        fills[c] = F.coalesce(F.col(c), F.lit(rows[0][c])) if rows else F.col(c)
    return df.withColumns(fills) if fills else df


def standardise(df: DataFrame, cols: Sequence[str], split_col: str = "dataset_split",
                prefix: str = "") -> DataFrame:
    """M5: (x - mean) / population std fit on train; zero variance -> scale 1."""
    tr = df.where(_is_train(split_col))
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    st = collect_bounded(tr.agg(*aggs), 1, "scaler row")[0]
    out = {}
    for c in cols:
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        scale = 1.0 if (s is None or s == 0.0) else s
        out[prefix + c] = (F.col(c) - F.lit(m)) / F.lit(scale)
    return df.withColumns(out)


def one_hot(df: DataFrame, cols: Sequence[str], split_col: str = "dataset_split", prefix: str = "cat__",
            max_categories: int = 1000, counts: DataFrame | None = None) -> DataFrame:
    """M6: one 0/1 column per train category (sorted); unseen and null -> all zeros.

    Wide columns for export, for columns of at most ``max_categories``
    categories. A column with more becomes one sparse vector ``prefix + column``
    (``one_hot_sparse``), whatever their number. ``counts``: ``category_counts`` of the text columns, if there already.
    """
    text = _text_columns(df, cols)
    tr = df.where(_is_train(split_col))
    cats: dict[str, list] = {c: [] for c in cols}
    if text:
        counts = category_counts(df, text, split_col) if counts is None else counts
        sizes = {r["column"]: r["k"] for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
        few = [c for c in text if 0 < sizes.get(c, 0) <= max_categories]
        for r in collect_bounded(counts.where(F.col("column").isin(few)).select("column", "value"), max_categories * len(cols), "categories") if few else []:
            cats[r["column"]].append(r["value"])
        cats |= {c: None for c in text if sizes.get(c, 0) > max_categories}
    for c in cols:
        if c not in text:
            rows = tr.select(c).where(F.col(c).isNotNull()).distinct().limit(max_categories + 1).collect()
            cats[c] = [r[0] for r in rows] if len(rows) <= max_categories else None
    out = {f"{prefix}{c}_{v}": F.when(F.col(f"`{c}`") == F.lit(v), 1.0).otherwise(0.0) for c in cols if cats[c] is not None for v in sorted(cats[c])}
    df = df.withColumns(out)
    for c in cols:
        if cats[c] is None:
            own = None if c not in text else counts.where(F.col("column") == c).select(F.col("value").alias(c))
            df = one_hot_sparse(df, c, split_col, f"{prefix}{c}", own)
    return df


def sorted_codes(values: DataFrame, col: str, small: int = 10_000) -> DataFrame:
    """(col, code): distinct values numbered 0, 1, 2, ... in sorted order; null has none.

    Up to ``small`` values are sorted by the driver. More are range-partitioned:
    every range numbers its own values, after those that the ranges before
    hold (a count per range), so no task sorts all of them. Both give the same codes.
    """
    from .windows import segments
    classes = values.select(col).where(F.col(f"`{col}`").isNotNull()).distinct()
    spark, kind = values.sparkSession, T.StructType([values.schema[col], T.StructField("code", T.IntegerType())])
    first = classes.orderBy(col).limit(small + 1).collect()
    if len(first) <= small:
        return spark.createDataFrame([(r[0], i) for i, r in enumerate(first)], kind)
    cut = segments(classes, [], [col], int(spark.conf.get("spark.sql.shuffle.partitions")))
    offsets, before = [], 0
    for r in cut.groupBy("__seg").agg(F.count(F.lit(1)).alias("n")).orderBy("__seg").collect():  # a row per range
        offsets.append((r["__seg"], before))
        before += r["n"]
    place = F.row_number().over(Window.partitionBy("__seg").orderBy(col)) - 1
    starts = spark.createDataFrame(offsets, "__seg int, __before long")
    return cut.join(F.broadcast(starts), "__seg").select(col, (F.col("__before") + place).cast("int").alias("code"))


def one_hot_sparse(df: DataFrame, col: str, split_col: str = "dataset_split", out: str | None = None, values: DataFrame | None = None) -> DataFrame:
    """M6 for an open vocabulary: a sparse 0/1 vector per row, an entry per train category in sorted order.

    The dictionary is a table joined by its measured size, so the number of
    categories has no limit but that of an int. Unseen and null -> all zeros. ``values``: the distinct train values, if there already.
    """
    from pyspark.ml.feature import OneHotEncoder
    values = df.where(_is_train(split_col)).select(col) if values is None else values
    codes, size = written_measured(sorted_codes(values, col).select(F.col(f"`{col}`").alias("__value"), F.col("code").cast("double").alias("__code")))
    k = codes.count()
    keyed = join_measured(df.withColumn("__value", F.col(f"`{col}`")), codes, ["__value"], size=size)
    keyed = keyed.withColumn("__code", F.coalesce("__code", F.lit(float(k)))).drop("__value")
    # the category behind the last one stands for unseen and null, and is the one that the encoder leaves out
    sizes = df.sparkSession.createDataFrame([(float(max(k, 1)),)], "__code double")
    encoder = OneHotEncoder(inputCol="__code", outputCol="__hot", dropLast=True, handleInvalid="error").fit(sizes)
    return encoder.transform(keyed).withColumn(out or f"{col}_vec", F.col("__hot")).drop("__code", "__hot")


def label_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """M7: sorted distinct labels (train + test) -> 0..k-1, joined to the rows from the class table (null stays null).

    The class table, a row per label, is what is sorted (``sorted_codes``: no task sorts all of many labels), not the rows.
    """
    out = out or f"{col}_encoded"
    codes = sorted_codes(df, col).select(F.col(f"`{col}`").alias("__label"), F.col("code").alias("__code"))
    keyed = df.withColumn("__label", F.col(col))
    return join_measured(keyed, codes, ["__label"]).select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("__code").alias(out))


def quantile_bins(df: DataFrame, col: str, n_bins: int = 3, split_col: str = "dataset_split",
                  out: str | None = None, labels: Sequence[str] | None = None) -> DataFrame:
    """M9: bins at train quantiles; a value equal to an inner edge goes up; clipped; duplicate edges merge."""
    from .aggregates import quantiles
    tr = df.where(_is_train(split_col))
    qs = [i / n_bins for i in range(1, n_bins)]
    row = collect_bounded(tr.agg(F.min(col).alias("lo"), F.max(col).alias("hi")), 1, "edge row")[0]
    names = [f"e{i}" for i in range(len(qs))]
    er = collect_bounded(quantiles(tr, [], col, qs, names), 1, "edge row")[0]
    edges = [row["lo"], *[er[n] for n in names], row["hi"]]
    merged = [edges[0]]
    for e in edges[1:]:
        if e - merged[-1] > 1e-8:
            merged.append(e)
    inner = merged[1:-1]
    b = F.lit(0)
    for e in inner:
        b = b + F.when(F.col(col) >= F.lit(e), 1).otherwise(0)
    b = F.when(F.col(col).isNull(), F.lit(None).cast("int")).otherwise(b)
    res = b if labels is None else F.element_at(F.array(*[F.lit(x) for x in labels]), b + 1)
    return df.withColumn(out or f"{col}_bin", res)


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weights n / (k * n_c), attached per row (weightCol for MLlib)."""
    counts, size = written_measured(df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("__nc")))
    n = counts.agg(F.sum("__nc")).scalar().cast("double")
    k = counts.agg(F.count(F.lit(1))).scalar().cast("double")
    w = counts.select(label, (n / (k * F.col("__nc"))).alias(out))
    return join_measured(df, w, [label], size=size)


def preprocess_table(df: DataFrame, target: str, key: str, regression: bool = False, test_frac: float = 0.2,
                     seed: int = 42, drop: Sequence[str] = (), sample_n: int | None = None) -> DataFrame:
    """M8: P6 -> (L5) -> F2 -> M1/M2 -> M3/M4 -> M5/M6 -> U1 (+M7) as one output table.

    Output: ``key``, ``num__<col>`` (median-imputed, standardised),
    ``cat__<col>_<value>`` (mode-imputed, one-hot), ``dataset_split``, the
    target, and ``<target>_encoded`` for classification.
    """
    from .schema import drop_columns_strict, infer_feature_kinds
    from .ranking import sample_rows
    d = df
    if sample_n is not None:
        d = sample_rows(d, sample_n, key, seed)
    if drop:
        d = drop_columns_strict(d, drop)
    num, cat = infer_feature_kinds(d.drop(key), target)
    num = [c for c in num if c != key]
    ttype = d.schema[target].dataType
    stratify = (not regression) and not isinstance(ttype, (T.DoubleType, T.FloatType))
    if stratify:
        d = stratified_split(d, target, key, test_frac, seed)
    else:
        d = random_split(d, key, test_frac, seed)
    # the fit passes below all read the split table: written once, with the columns they need
    d = written(d.withColumns({c: F.col(c).cast("double") for c in num}))
    if num:
        d = impute_median(d, num)
        d = standardise(d, num, prefix="num__")
    if cat:
        text = _text_columns(d, cat)
        counts = category_counts(d, text) if text else None
        d = impute_mode(d, cat, counts=counts)
        d = one_hot(d, cat, counts=counts)
    feats = [c for c in d.columns if c.startswith("num__") or c.startswith("cat__")]
    out = d.select(key, *feats, "dataset_split", target)
    if not regression:
        out = label_encode(out, target)
    return out


def row_features_with_defaults(rows: DataFrame, feature_order: Sequence[str],
                               defaults: dict | None = None, zone_default: str | None = None) -> DataFrame:
    """Derive zone (X3) and climate score (X4); default N/P/K; model column order.

    Absent feature columns get 0.0 (P10); present-but-null N/P/K get the
    serving defaults 70/40/40 (P11).
    """
    from ..functions.scalar import climate_score, climate_zone
    dflt = {"N": 70.0, "P": 40.0, "K": 40.0}
    dflt.update(defaults or {})
    d = rows
    for c, v in dflt.items():
        d = d.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(v)) if c in d.columns else F.lit(v))
    d = d.withColumns({"region_type": climate_zone("rainfall", zone_default),
                       "climate_score": climate_score("temperature", "humidity", "rainfall")})
    for c in feature_order:
        if c not in d.columns:
            d = d.withColumn(c, F.lit(0.0))
    return d.select(*[c for c in rows.columns if c not in feature_order], *feature_order)

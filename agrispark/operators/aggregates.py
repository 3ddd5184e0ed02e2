"""Aggregations.

Every ``groupBy`` here runs as partial (map-side) + final aggregation, so
only one row per (partition, group) crosses the shuffle. Exact medians and
quantiles (``percentile``) keep the group's values in the partial buffer; for
very large groups pass ``approx=True`` to use ``percentile_approx`` (bounded
memory, mergeable sketch). Null group keys are dropped first (pandas rule,
trap T1).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import norm_key


def _not_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond)


# Quantile methods:
#   "distributed"  exact, skew-safe (``quantiles``): the default for data-sized inputs
#   "exact"        Spark ``percentile``: one aggregate, but a group's distinct values meet in one task
#   "approx"       ``percentile_approx`` (bounded sketch, rank error 1/accuracy)
DEFAULT_QUANTILE_METHOD = "distributed"


def _median(c: str, approx: bool):
    if approx:
        return F.percentile_approx(F.col(c), 0.5, 10000).cast("double")
    return F.percentile(F.col(c), F.lit(0.5))


def group_quantiles(df: DataFrame, keys: Sequence[str], cols: Sequence[str], q: float,
                    method: str = DEFAULT_QUANTILE_METHOD, suffix: str = "") -> DataFrame:
    """Quantile ``q`` of several columns per group, one row per group.

    ``distributed``: the columns are unpivoted with ``stack`` into
    (keys, column, value) and one distributed selection runs over
    (keys, column) groups, then the result is pivoted back (fixed column list).
    """
    keys = list(keys)
    cols = list(cols)
    if method != "distributed":
        if method == "approx":
            aggs = [F.percentile_approx(F.col(c), float(q), 10000).cast("double").alias(c + suffix) for c in cols]
        else:
            aggs = [F.percentile(F.col(c), F.lit(float(q))).alias(c + suffix) for c in cols]
        return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    stack = "stack({}, {}) as (__col, __v)".format(
        len(cols), ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols))
    long = df.select(*keys, F.expr(stack))
    qv = quantiles(long, [*keys, "__col"], "__v", [q], ["__q"])
    pv = qv.groupBy(*keys).pivot("__col", cols).agg(F.first("__q")) if keys else \
        qv.groupBy().pivot("__col", cols).agg(F.first("__q"))
    return pv.select(*keys, *[F.col(c).alias(c + suffix) for c in cols])


def group_median(df: DataFrame, key: str, cols: Sequence[str], normalise: bool = True,
                 approx: bool = False, suffix: str = "", method: str | None = None) -> DataFrame:
    """A1: median per group, nulls skipped; key optionally trim/lower-ed.

    Exact by default via distributed selection (skew-safe); ``approx=True``
    uses a bounded sketch; ``method="exact"`` uses Spark's ``percentile``.
    """
    k = norm_key(key) if normalise else F.col(key)
    d = df.select(k.alias(key), *cols)
    d = _not_null_keys(d, [key])
    m = "approx" if approx else (method or DEFAULT_QUANTILE_METHOD)
    return group_quantiles(d, [key], cols, 0.5, m, suffix)


def global_median(df: DataFrame, col: str, approx: bool = False, method: str | None = None) -> DataFrame:
    """A2: one-row median over rows (not over group medians)."""
    m = "approx" if approx else (method or DEFAULT_QUANTILE_METHOD)
    return group_quantiles(df, [], [col], 0.5, m)


def fill_with_global_median(df: DataFrame, col: str, default: float = 60.0,
                            approx: bool = False) -> DataFrame:
    """A2 + fill: nulls in ``col`` get the median over the rows; absent column -> default.

    The median is a scalar subquery: computed by its own job and inlined as
    a value (no join).
    """
    if col not in df.columns:
        return df.withColumn(col, F.lit(float(default)))
    med = global_median(df, col, approx).scalar()
    return df.withColumn(col, F.coalesce(F.col(col), med, F.lit(float(default))))


def group_mean(df: DataFrame, keys: Sequence[str], cols: Sequence[str], prefix: str = "") -> DataFrame:
    """A3: mean per group (null keys dropped)."""
    d = _not_null_keys(df, keys)
    return d.groupBy(*keys).agg(*[F.avg(c).alias(prefix + c) for c in cols])


def geo_centroid(df: DataFrame, key: str = "country", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """A4: mean lat / lon per key; rows with a null key, lat or lon dropped first."""
    d = df.where(F.col(key).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return d.groupBy(key).agg(F.avg(lat).alias(lat), F.avg(lon).alias(lon))


def label_centroids(df: DataFrame, label: str, feats: Sequence[str]) -> DataFrame:
    """A5: mean feature vector per label (scalar columns)."""
    d = _not_null_keys(df, [label])
    return d.groupBy(label).agg(*[F.avg(f).alias(f) for f in feats])


def label_centroids_array(df: DataFrame, label: str, vec: str, dim: int) -> DataFrame:
    """A5 for array features: element-wise mean per label, one pass.

    ``posexplode`` would multiply rows by the dimension before the shuffle;
    instead each element is averaged by its own partial aggregate.
    """
    d = _not_null_keys(df, [label])
    aggs = [F.avg(F.element_at(F.col(vec), i + 1).cast("double")).alias(f"m{i}") for i in range(dim)]
    g = d.groupBy(label).agg(*aggs)
    return g.select(label, F.array(*[F.col(f"m{i}") for i in range(dim)]).alias("centroid"))


def quantile_thresholds(df: DataFrame, feats: Sequence[str], qs: Sequence[float] = (0.25, 0.75),
                        names: Sequence[str] = ("low", "high"), approx: bool = False,
                        method: str | None = None) -> DataFrame:
    """Per-feature linear-interpolated quantiles, unpivoted to (feature, low, high)."""
    m = "approx" if approx else (method or DEFAULT_QUANTILE_METHOD)
    if m == "distributed":
        stack = "stack({}, {}) as (feature, __v)".format(
            len(feats), ", ".join(f"'{f}', cast(`{f}` as double)" for f in feats))
        return quantiles(df.select(F.expr(stack)), ["feature"], "__v", list(qs), list(names))
    aggs = []
    for f in feats:
        if approx:
            aggs.append(F.percentile_approx(F.col(f), list(qs), 10000).alias(f))
        else:
            aggs.append(F.percentile(F.col(f), F.array(*[F.lit(float(q)) for q in qs])).alias(f))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(f).alias("feature"),
                     *[F.col(f)[i].cast("double").alias(n) for i, n in enumerate(names)]) for f in feats]
    return wide.select(F.inline(F.array(*rows)))


def annualised_city_mean(df: DataFrame, city: str, temp: str, rain: str, hum: str,
                         days: float = 365.0) -> DataFrame:
    """Per-city means of snapshots; rainfall = mean daily value x 365.

    Rows with any null are dropped and means are taken per exact spelling.
    The key is ``trim/lower(city)``; when several spellings share a key, the
    last one in sorted order gives the row (trap T13). Two partial
    aggregations; the second sees one row per spelling.
    """
    d = df.select(city, temp, rain, hum).na.drop()
    per = d.groupBy(city).agg(
        F.avg(temp).alias("temperature"), (F.avg(rain) * days).alias("rainfall"),
        F.avg(hum).alias("humidity"), F.count(F.lit(1)).alias("n_snapshots"))
    last = F.max(F.struct(F.col(city).alias("city"), "temperature", "rainfall", "humidity", "n_snapshots")).alias("last")
    per = per.withColumn("city_key", norm_key(city)).where(F.col("city_key") != "")
    return per.groupBy("city_key").agg(last).select("city_key", "last.*")


def mean_of_means(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Mean per date over regions, **then** mean per month (not a flat mean).

    Two aggregation levels; the first collapses to one row per (key, date).
    """
    per_day = df.where(F.col(time).isNotNull()).groupBy(key, F.to_date(time).alias("day")).agg(
        F.avg(value).alias("day_mean"))
    return per_day.groupBy(key, F.trunc("day", "month").alias("month")).agg(
        F.avg("day_mean").alias("value"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per non-null value (ordering is applied only at output)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def top_class_ratio(df: DataFrame, label: str, warn_above: float = 0.5) -> DataFrame:
    """A10: largest class share, with a warning flag above ``warn_above``.

    Aggregates to one row per class first; the global max/sum then runs over
    the (tiny) class table only.
    """
    vc = value_counts(df, label)
    return vc.agg(F.max("n").alias("top_n"), F.sum("n").alias("total")).select(
        "top_n", "total", (F.col("top_n") / F.col("total")).alias("ratio"),
        ((F.col("top_n") / F.col("total")) > warn_above).alias("imbalanced"))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values (sort at output)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def group_mode(df: DataFrame, key: str, col: str) -> DataFrame:
    """Most frequent value per group, ties -> smallest.

    Counted per (key, value) first so a hot key becomes one row per value
    before the second aggregation; then ``max_by`` on (count, -rank) is
    replaced by ``min`` over (-count, value): deterministic and mergeable.
    """
    c = df.where(F.col(key).isNotNull() & F.col(col).isNotNull()).groupBy(key, col).agg(
        F.count(F.lit(1)).alias("__n"))
    best = c.groupBy(key).agg(F.min(F.struct((-F.col("__n")).alias("neg"), F.col(col).alias("v"))).alias("__b"))
    return best.select(key, F.col("__b.v").alias(col))


def confusion_matrix(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Counts by (actual, predicted)."""
    return pred.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def _class_counts(pred: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Per class (and ``by``): true positives, support, predictions, and rows of it with both labels known, from one confusion matrix.

    Every cell counts for its actual and for its predicted class, so the
    predictions are read once and nothing is joined.
    """
    cm = pred.groupBy(*by, actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    zero, n, a, p = F.lit(0).cast("long"), F.col("n"), F.col(actual), F.col(predicted)
    cells = F.array(
        F.struct(a.alias("cls"), F.when(a == p, n).otherwise(zero).alias("tp"), n.alias("support"), zero.alias("n_pred"),
                 F.when((a == p).isNotNull(), n).otherwise(zero).alias("known")),
        F.struct(p.alias("cls"), zero.alias("tp"), zero.alias("support"), n.alias("n_pred"), zero.alias("known")))
    return cm.select(*by, F.inline(cells)).groupBy(*by, "cls").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "n_pred", "known")])


def _class_measures(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    tp = F.col("tp").cast("double")
    prec = F.coalesce(F.try_divide(tp, F.col("n_pred").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, F.col("support").cast("double")), F.lit(0.0))
    f1 = F.when(prec + rec == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))
    return counts.select(*by, "cls", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), "support", "tp", "known")


def classification_report(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Per class precision / recall / F1 / support; zero division -> 0. One pass over the predictions.

    A null label is a class of its own without true positives.
    """
    return _class_measures(_class_counts(pred, actual, predicted)).drop("tp", "known")


def classification_metrics(pred: DataFrame, actual: str = "actual", predicted: str = "predicted",
                           positive=None, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, weighted F1, macro F1 (and binary F1 for ``positive``), all from one confusion matrix.

    Accuracy is over the rows with both labels. With ``by`` (columns of
    ``pred``, such as a model's name) a row for each of its values, still in one pass.
    """
    by = list(by)
    total = F.sum("support").cast("double")
    agg = [
        F.try_divide(F.sum("tp").cast("double"), F.sum("known").cast("double")).alias("accuracy"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), total).alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
    ]
    if positive is not None:
        agg.append(F.max(F.when(F.col("cls") == F.lit(positive), F.col("f1"))).alias("f1_binary"))
    return _class_measures(_class_counts(pred, actual, predicted, by), by).groupBy(*by).agg(*agg)


def regression_metrics(df: DataFrame, actual: str = "actual", pred: str = "prediction",
                       group: str | None = None) -> DataFrame:
    """RMSE and R^2 (optionally per group, e.g. train/test).

    One pass over the scored rows (actual and prediction not null): R^2 =
    1 - SSE / SST, and ``n`` counts the same rows.
    """
    e = F.col(actual) - F.col(pred)
    aggs = [F.avg(e * e).alias("mse"), F.sum(e * e).alias("sse"),
            F.var_pop(F.when(e.isNotNull(), F.col(actual))).alias("var_y"), F.count(e).alias("n")]
    g = df.groupBy(group).agg(*aggs) if group else df.agg(*aggs)
    out = g.withColumns({
        "rmse": F.sqrt("mse"),
        "r2": F.lit(1.0) - F.try_divide(F.col("sse"), F.col("var_y") * F.col("n")),
    })
    keep = ([group] if group else []) + ["rmse", "r2", "n"]
    return out.select(*keep)


def ordinal_label_rmse(pred: DataFrame, classes: Sequence[str], actual: str = "actual",
                       predicted: str = "predicted") -> DataFrame:
    """RMSE over alphabetical class indexes (J10 twice + A16), looked up per cell of the confusion matrix."""
    idx = {c: float(i) for i, c in enumerate(sorted(classes))}
    m = F.create_map(*[x for k, v in idx.items() for x in (F.lit(k), F.lit(v))])
    e2 = F.pow(F.element_at(m, F.col(actual)) - F.element_at(m, F.col(predicted)), 2)
    cells = confusion_matrix(pred, actual, predicted).select(e2.alias("e2"), "n").where("e2 IS NOT NULL")
    return cells.agg(F.sqrt(F.try_divide(F.sum(F.col("e2") * F.col("n")), F.sum("n"))).alias("rmse"))


def evaluation_matrix(metrics: DataFrame, model: str = "model", metric: str = "metric",
                      value: str = "value", order: Sequence[str] = ("accuracy", "f1", "rmse")) -> DataFrame:
    """Long (model, metric, value) rows -> model x fixed metric columns."""
    return metrics.groupBy(model).pivot(metric, list(order)).agg(F.first(value))


def worst_change(df: DataFrame, row_key: str, pct: str = "change_pct") -> DataFrame:
    """Minimum percent change per row -> risk band."""
    from ..functions.scalar import risk_from_change
    g = df.groupBy(row_key).agg(F.min(pct).alias("worst_change"))
    return g.withColumn("risk_level", risk_from_change("worst_change"))


def above_mean_flag(df: DataFrame, col: str, out: str = "risk") -> DataFrame:
    """A20: 'low' when above the global mean, else 'high' (scalar subquery form)."""
    m = df.agg(F.avg(col)).scalar()
    return df.withColumn(out, F.when(F.col(col) > m, "low").otherwise("high"))


def daily_to_point_climate(df: DataFrame, keys: Sequence[str], temp: str, rain: str, hum: str,
                           defaults=(25.0, 500.0, 60.0)) -> DataFrame:
    """Per point (and year): mean temp, **sum** rain, mean humidity; defaults."""
    g = df.groupBy(*keys).agg(F.avg(temp).alias("temperature"), F.sum(rain).alias("rainfall"),
                              F.avg(hum).alias("humidity"))
    return g.withColumns({
        "temperature": F.coalesce("temperature", F.lit(defaults[0])),
        "rainfall": F.coalesce("rainfall", F.lit(defaults[1])),
        "humidity": F.coalesce("humidity", F.lit(defaults[2])),
    })


def count_distinct_labels(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """Number of classes (exact, or HyperLogLog++ with ``approx``)."""
    f = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return df.agg(f.alias("n_classes"))


def series_summary(series: DataFrame, key: str = "series_key", time: str = "month") -> DataFrame:
    """Points, first and last month per series."""
    return series.groupBy(key).agg(F.count(F.lit(1)).alias("n_points"),
                                   F.min(time).alias("first_month"), F.max(time).alias("last_month"))


def counts_with_all_classes(df: DataFrame, col: str, classes: Sequence) -> DataFrame:
    """Class counts in a fixed class list; absent class -> 0.

    The class list is a literal (driver-known size) inlined as rows; the counts
    are aggregated before the join.
    """
    spark = df.sparkSession
    cls = spark.createDataFrame([(i, c) for i, c in enumerate(classes)], ["class_order", col])
    vc = value_counts(df, col)
    return F.broadcast(cls).join(vc, col, "left").select(
        "class_order", col, F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


# --------------------------------------------------------------------------
# Exact quantiles by distributed selection (skew-safe)
# --------------------------------------------------------------------------

#: Widths around a quantile, as shares of a group, from which each group takes the narrowest that surely holds it.
_WIDTHS = (1e-3, 1e-2, 1e-1)
#: Equal-width parts of a bracket; only those that hold a wanted rank are sorted.
_PARTS = 4096


def _brackets(d: DataFrame, qs: Sequence[float], accuracy: int) -> DataFrame:
    """(__grp, __n, __br): rows of each group and, per quantile, values between which its ranks lie.

    One mergeable sketch serves all quantiles. Its rank error is n / accuracy;
    a bracket reaches 4 / accuracy of the group and two rows further on each
    side, at the next of the fixed widths, or to the least and largest value.
    """
    widths = (8 / accuracy, *[w for w in _WIDTHS if w > 8 / accuracy])
    points = sorted({p for q in qs for w in widths for p in (q - w, q + w) if 0 < p < 1})
    # a value in the middle, so that there always is a point
    points = points or [0.5]
    st = d.groupBy("__grp").agg(F.count("__x").alias("__n"), F.min("__x").alias("__min"), F.max("__x").alias("__max"),
                                F.percentile_approx("__x", points, accuracy).alias("__sk"))
    need = F.lit(4 / accuracy) + F.lit(2.0) / F.greatest(F.col("__n"), F.lit(1))

    def end(q: float, sign: int, rest: str):
        out = F.col(rest)
        for w in reversed(widths):
            if 0 < q + sign * w < 1:
                out = F.when(F.lit(w) >= need, F.element_at("__sk", points.index(q + sign * w) + 1)).otherwise(out)
            else:
                out = F.when(F.lit(w) >= need, F.col(rest)).otherwise(out)
        return out

    br = [F.struct(F.lit(i).alias("i"), end(q, -1, "__min").alias("lo"), end(q, 1, "__max").alias("hi")) for i, q in enumerate(qs)]
    return st.select("__grp", "__n", F.array(*br).alias("__br"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, qs: Sequence[float],
                    outs: Sequence[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """Exact linear-interpolated quantiles per group, without holding a big group in one task.

    Spark's exact ``percentile`` merges all distinct values of a group in one
    task, so a group holding a third of the data would have to fit in one
    executor. Distributed selection instead, the same at every size and with
    two passes over the rows for any number of quantiles:

    1. one aggregation: the group's count and a ``percentile_approx`` sketch,
       which brackets the wanted ranks of each quantile between two values
       (``_brackets``; a row per group, written, joined by its measured size);
    2. one aggregation with map-side combine: per group and quantile the count
       of rows below the bracket and the counts of the values in it (about
       16 / ``accuracy`` of a big group), by equal-width part of the bracket.
       Running totals over the parts name the one or two parts that hold the
       wanted ranks, and only values of these are ranked.

    Equals ``percentile(col, q)`` (numpy / pandas linear rule). Null and NaN
    don't count; groups whose values are all null come back with nulls. A
    null key is a group of its own. It fails rather than return a value from outside a bracket.
    """
    from .joins import join_measured, written_measured
    keys = list(keys)
    qs = [float(q) for q in qs]
    outs = list(outs or [f"q{i}" for i in range(len(qs))])
    xv = F.col(col).cast("double")
    # without keys: one group, named by a value that is 0 for every row but no constant, so the joins stay equi-joins
    grp = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.pmod(F.xxhash64(xv), F.lit(1)).alias("__all"))
    d = df.select(grp.alias("__grp"), F.when(~F.isnan(xv), xv).alias("__x"))
    st, size = written_measured(_brackets(d, qs, accuracy))

    # rows below a bracket count under a null value in part -1; rows above it don't count
    at = join_measured(d.where(F.col("__x").isNotNull()), st.select("__grp", "__br"), ["__grp"], "inner", size=size)
    at = at.select("__grp", "__x", F.inline("__br")).where(F.col("__x") <= F.col("hi"))
    span = F.col("hi") - F.col("lo")
    cut = F.when((span > 0) & (span < float("inf")), F.least(F.floor((F.col("__x") - F.col("lo")) / span * _PARTS), F.lit(_PARTS - 1))).otherwise(F.lit(0))
    inside = F.col("__x") >= F.col("lo")
    counts = at.groupBy("__grp", "i", F.when(inside, cut).otherwise(F.lit(-1)).cast("int").alias("__part"), F.when(inside, F.col("__x")).alias("__x")).agg(F.count(F.lit(1)).alias("__c"))

    before = F.sum("__m").over(Window.partitionBy("__grp", "i").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = counts.groupBy("__grp", "i", "__part").agg(F.sum("__c").alias("__m")).withColumn("__before", F.coalesce(before, F.lit(0)))
    pos = F.element_at(F.array(*[F.lit(q) for q in qs]), F.col("i") + 1) * (F.col("__n") - 1)
    parts = parts.join(st.select("__grp", "__n"), "__grp").withColumn("__pos", pos)
    wanted = (F.col("__before") <= F.ceil("__pos")) & (F.col("__before") + F.col("__m") > F.floor("__pos"))
    parts = parts.where(wanted).select("__grp", "i", "__part", "__before", "__pos")

    running = F.sum("__c").over(Window.partitionBy("__grp", "i", "__part").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0))
    upto = F.col("__before") + F.col("__run")
    ranked = counts.join(parts, ["__grp", "i", "__part"]).withColumn("__run", running)
    got = ranked.groupBy("__grp", "i").agg(
        F.max("__pos").alias("p"), F.min("__part").alias("least"),
        F.min(F.when(upto > F.floor("__pos"), F.col("__x"))).alias("v0"), F.min(F.when(upto > F.ceil("__pos"), F.col("__x"))).alias("v1"))
    lo_r, hi_r = F.floor("p"), F.ceil("p")
    # the same interpolation form as Spark's percentile: (hi - pos) * lower + (pos - lo) * upper
    value = F.when(lo_r == hi_r, F.col("v0")).otherwise((hi_r - F.col("p")) * F.col("v0") + (F.col("p") - lo_r) * F.col("v1"))
    sound = (F.col("least") >= 0) & F.col("v0").isNotNull() & F.col("v1").isNotNull()
    got = got.select("__grp", "i", F.when(sound, value).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket"))).alias("v"))
    wide = got.groupBy("__grp").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"__v{i}") for i in range(len(qs))])
    res = st.select("__grp").join(wide, "__grp", "left")
    return res.select(*[F.col("__grp")[k].alias(k) for k in keys], *[F.col(f"__v{i}").alias(o) for i, o in enumerate(outs)])


def exact_quantile(df: DataFrame, keys: Sequence[str], col: str, q: float, accuracy: int = 10_000, out: str | None = None) -> DataFrame:
    """One exact quantile per group (see ``exact_quantiles``)."""
    return exact_quantiles(df, keys, col, [q], [out or col], accuracy)


#: Values of the largest group up to which ``percentile`` holds a group in one task (some ten MB).
WHOLE_GROUP = 200_000


def quantiles(df: DataFrame, keys: Sequence[str], col: str, qs: Sequence[float], outs: Sequence[str] | None = None,
              whole_group: int = WHOLE_GROUP) -> DataFrame:
    """Exact linear-interpolated quantiles per group, by the way that suits the largest group.

    The values of each group are counted first (partial sums; a row per group
    is shuffled). If the largest has at most ``whole_group``, Spark's ``percentile`` does all groups in one
    aggregation; else ``exact_quantiles`` selects them without a group in one
    task. Both give the same values: null and NaN don't count, a group without values has nulls.
    """
    keys, qs = list(keys), [float(q) for q in qs]
    outs = list(outs or [f"q{i}" for i in range(len(qs))])
    xv = F.col(col).cast("double")
    d = df.select(*keys, F.when(~F.isnan(xv), xv).alias("__x"))
    largest = d.groupBy(*keys).agg(F.count("__x").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if largest > whole_group:
        return exact_quantiles(df, keys, col, qs, outs)
    got = d.groupBy(*keys).agg(F.percentile("__x", F.array(*[F.lit(q) for q in qs])).alias("__p"))
    return got.select(*keys, *[F.col("__p")[i].alias(o) for i, o in enumerate(outs)])

"""Windows and time series.

Windows always partition by a series key; an un-partitioned window would pull
the whole table into one task. Where the reference works on one series, the
table form carries a ``series_key`` so many series run in parallel. W1 and W2
go through ``look_back``: one sort serves both, and a key with very many rows is
cut into segments that carry over the last rows of the one before. W4 and W5
number the rows of a long series segment by segment (``in_segments``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import DateType

from ..streaming import require_bounded


def _spec(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


#: Rows of one key from which its window is cut into segments.
SEGMENT_ROWS = 2_000_000


def look_back(df: DataFrame, keys: Sequence[str], order: Sequence[str], back: int, made: dict,
              segment_rows: int = SEGMENT_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Add window columns that look at a row and at most ``back`` rows before it, in ``order`` within ``keys``.

    ``made``: name -> function of the window spec. Rows with a null key keep
    their row and get null (trap T1). A window on the keys is one sorted task
    per key, so the rows of each key are counted first: if a key has more than ``segment_rows``, the
    table is range-split by (keys, order) into segments of about half as many rows, written,
    and each segment's window starts with the last ``back`` rows of the key before it.
    Equal order values must not be told apart by the result (give a tiebreak).
    ``counted``: a table with the same rows per key that is cheaper to count.
    """
    require_bounded(df)
    keys, order = list(keys), list(order)
    nk = F.lit(False)
    for k in keys:
        nk = nk | F.col(k).isNull()

    def add(d: DataFrame, spec) -> DataFrame:
        return d.withColumns({name: F.when(nk, F.lit(None)).otherwise(fn(spec)) for name, fn in made.items()})

    size = (df if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("rows")).first()
    if (size["top"] or 0) <= segment_rows:
        return add(df, _spec(keys, order))
    rows = segments(df, keys, order, -(-size["rows"] * 2 // segment_rows))
    tail = F.row_number().over(Window.partitionBy(*keys, "__seg").orderBy(*[F.col(c).desc() for c in order]))
    tails = rows.withColumn("__at", tail).where(F.col("__at") <= back)  # a few rows for each segment of a key
    held = F.collect_list(F.struct(*[F.col(f"`{c}`") for c in df.columns])).over(Window.partitionBy(*keys).orderBy("__seg", *order).rowsBetween(-back, -1))
    first = F.max("__at").over(Window.partitionBy(*keys, "__seg")) == F.col("__at")
    carried = tails.select("__seg", held.alias("__held"), first.alias("__first")).where("__first").select("__seg", F.inline("__held"))
    both = rows.withColumn("__own", F.lit(True)).unionByName(carried.withColumn("__own", F.lit(False)))
    return add(both, _spec([*keys, "__seg"], order)).where("__own").drop("__seg", "__own")


def segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int) -> DataFrame:
    """``df`` with ``__seg``: the range of (keys, order) that a row is in, in about ``parts`` ranges; written, so the ranges stay."""
    from .joins import written
    return written(df.repartitionByRange(max(1, int(parts)), *keys, *order).withColumn("__seg", F.spark_partition_id()))


def in_segments(df: DataFrame, key: str, order: str, segment_rows: int, known: str | None = None) -> DataFrame | None:
    """Rows of a series that is too long for one task, segment by segment; None if no series is.

    Adds ``__seg``, ``__pos`` (position in the whole series) and ``__n`` (rows of
    the series); with ``known`` also ``__pre`` and ``__post``: (position, value)
    of the last value of ``known`` in the segments before and of the first one in those after. Each
    segment is numbered by itself; what it takes from the others goes through a
    table with a row per series and segment. A series has one row for each
    value of ``order``, so one that is ordered by date is never that long and is not counted.
    """
    if isinstance(df.schema[order].dataType, DateType):
        return None
    size = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("rows")).first()
    if (size["top"] or 0) <= segment_rows:
        return None
    rows = segments(df, [key], [order], -(-size["rows"] * 2 // segment_rows))
    rows = rows.withColumn("__in", F.row_number().over(_spec([key, "__seg"], [order])))
    whole = Window.partitionBy(key).orderBy("__seg")
    before, after = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(1, Window.unboundedFollowing)
    aggs, ends = [F.count(F.lit(1)).alias("__rows")], []
    if known:
        at = F.when(F.col(known).isNotNull(), F.struct(F.col("__in").alias("pos"), F.col(known).alias("value")))
        aggs += [F.max(at).alias("__last"), F.min(at).alias("__first")]
    parts = rows.groupBy(key, "__seg").agg(*aggs).withColumns({
        "__off": F.coalesce(F.sum("__rows").over(before), F.lit(0)), "__n": F.sum("__rows").over(Window.partitionBy(key))})
    if known:
        def shifted(c: str):
            return F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.pos") + F.col("__off")).alias("pos"), F.col(f"{c}.value").alias("value")))
        parts = parts.withColumns({"__pre": F.last(shifted("__last"), ignorenulls=True).over(before), "__post": F.first(shifted("__first"), ignorenulls=True).over(after)})
        ends = ["__pre", "__post"]
    parts = parts.select(F.col(key).alias("__key"), F.col("__seg").alias("__part"), "__off", "__n", *ends)
    joined = rows.join(parts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__seg") == F.col("__part")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], "__seg", (F.col("__off") + F.col("__in")).alias("__pos"), "__n", *ends)


def lag_column(col: str, n: int = 1):
    return lambda w: F.lag(col, n).over(w)


def rolling_mean_column(col: str, n: int = 3):
    return lambda w: F.avg(col).over(w.rowsBetween(-(n - 1), 0))


def lag_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, n: int = 1,
           out: str | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Previous value in key order of time (order must include a tiebreak); hot keys in segments (``look_back``)."""
    return look_back(df, keys, order, n, {out or f"{col}_lag{n}": lag_column(col, n)}, segment_rows)


def rolling_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, n: int = 3,
                 out: str | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Mean over the current and n-1 previous rows, min_periods 1; hot keys in segments (``look_back``)."""
    return look_back(df, keys, order, n - 1, {out or f"{col}_trend{n}": rolling_mean_column(col, n)}, segment_rows)


def month_bucket(df: DataFrame, key: str, time: str, value: str, agg: str = "avg") -> DataFrame:
    """Month-start mean per series, **every** month from first to last.

    Aggregate to months first (partial agg), then each series' (min, max)
    span is expanded with ``sequence`` and left-joined to the monthly means.
    Missing months carry a null value (W4 fills them).
    """
    require_bounded(df)
    fn = {"avg": F.avg, "sum": F.sum}[agg]
    m = (df.where(F.col(time).isNotNull() & F.col(key).isNotNull())
           .groupBy(key, F.trunc(F.to_date(time), "month").alias("month"))
           .agg(fn(value).alias("value")))
    span = m.groupBy(key).agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    grid = span.select(key, F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    return grid.join(m, [key, "month"], "left")


def interpolate_linear(df: DataFrame, key: str, order: str, value: str, out: str | None = None,
                       segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Fill interior gaps linearly **by position**; edges stay null.

    Previous / next non-null value and their row positions come from
    ``last/first(ignoreNulls)`` windows in both directions (one sort per
    series key). A series of more than ``segment_rows`` rows is filled segment by
    segment; a gap over an end takes the value beyond it from the other segments.
    """
    require_bounded(df)
    out = out or value
    d = in_segments(df, key, order, segment_rows, known=value)
    if d is None:
        w = Window.partitionBy(key).orderBy(order)
        d = df.withColumn("__pos", F.row_number().over(w))
        end = {"__pre": F.lit(None), "__post": F.lit(None)}
    else:
        w = Window.partitionBy(key, "__seg").orderBy(order)
        end = {"__pre": F.col("__pre"), "__post": F.col("__post")}
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("__pos").cast("long").alias("pos"), F.col(value).alias("value")))
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    fwd = w.rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumns({
        "__p": F.coalesce(F.last(known, ignorenulls=True).over(back), end["__pre"]),
        "__q": F.coalesce(F.first(known, ignorenulls=True).over(fwd), end["__post"]),
    })
    frac = (F.col("__pos") - F.col("__p.pos")).cast("double") / (F.col("__q.pos") - F.col("__p.pos")).cast("double")
    filled = (F.when(F.col(value).isNotNull(), F.col(value))
              .when(F.col("__p").isNotNull() & F.col("__q").isNotNull(),
                    F.col("__p.value") + (F.col("__q.value") - F.col("__p.value")) * frac))
    return d.withColumn(out, filled).drop("__pos", "__n", "__seg", "__pre", "__post", "__p", "__q")


def chrono_split(df: DataFrame, key: str, order: str, frac: float = 0.8,
                 min_train: int = 24, min_test: int = 6, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """W5 (+Q4): first int(n*frac) points train, the rest test, per series.

    Adds ``split`` ('train' / 'test') and ``series_ok``; series that fail the
    24/6 rule are kept but flagged (callers route them to a rejected output
    or raise, see ``quality.min_history``). A series of more than
    ``segment_rows`` rows is numbered segment by segment.
    """
    require_bounded(df)
    d = in_segments(df, key, order, segment_rows)
    if d is None:
        w = Window.partitionBy(key).orderBy(order)
        d = df.withColumns({"__pos": F.row_number().over(w), "__n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    n_train = F.floor(F.col("__n") * F.lit(frac)).cast("long")
    return d.withColumns({
        "split": F.when(F.col("__pos") <= n_train, "train").otherwise("test"),
        "series_ok": (n_train >= min_train) & ((F.col("__n") - n_train) >= min_test),
    }).drop("__pos", "__n", "__seg")


def with_steps(df: DataFrame, key: str, steps: int | DataFrame) -> DataFrame:
    """Add ``__steps``: one number for all rows, or each key's own from a frame (key, steps)."""
    if isinstance(steps, DataFrame):
        return df.join(steps.select(key, F.col("steps").cast("int").alias("__steps")), key)
    return df.withColumn("__steps", F.lit(int(steps)))


def tail_mean_forecast(train: DataFrame, key: str, order: str, value: str, last: int = 6,
                       steps: int | DataFrame = 12) -> DataFrame:
    """Mean of the last ``last`` points repeated over the next ``steps`` months (a number, or a frame (key, steps))."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    t = train.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= last)
    g = with_steps(t.groupBy(key).agg(F.avg(value).alias("forecast"), F.max(order).alias("__last")), key, steps)
    g = g.where(F.col("__steps") > 0).select(key, "forecast", F.posexplode(F.sequence(
        F.add_months("__last", 1), F.add_months("__last", F.col("__steps")), F.expr("interval 1 month"))).alias("step0", "month"))
    return g.select(key, (F.col("step0") + 1).alias("step"), "month", "forecast")


def binary_above_median_eval(train: DataFrame, test: DataFrame, key: str, actual: str,
                             pred: str) -> DataFrame:
    """actual/pred >= the **train** median -> accuracy, F1 (positive=1); plus RMSE."""
    from .aggregates import quantiles
    med = quantiles(train, [key], actual, [0.5], ["__med"])
    d = test.join(med, key, "inner").select(
        key, (F.col(actual) >= F.col("__med")).cast("int").alias("y"),
        (F.col(pred) >= F.col("__med")).cast("int").alias("p"),
        (F.col(actual) - F.col(pred)).alias("e"))
    tp = F.sum(((F.col("y") == 1) & (F.col("p") == 1)).cast("double"))
    fp = F.sum(((F.col("y") == 0) & (F.col("p") == 1)).cast("double"))
    fn = F.sum(((F.col("y") == 1) & (F.col("p") == 0)).cast("double"))
    g = d.groupBy(key).agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"),
                           tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
                           F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return g.select(key, "accuracy", f1.alias("f1"), "rmse")


def trailing_days(df: DataFrame, time: str, n: int, end=None) -> DataFrame:
    """Rows in the last ``n`` whole days ending at ``end`` (inclusive).

    ``end`` is a date literal string / date; default: the max date in the data
    (a scalar subquery). ``n <= 0`` is an error; any other ``n`` is
    taken as it is.
    """
    if n <= 0:
        raise ValueError("days must be positive")
    d = F.to_date(F.col(time))
    if end is None:
        end_c = df.agg(F.max(d)).scalar()
        return df.where(d.between(F.date_sub(end_c, n - 1), end_c))
    e = F.to_date(F.lit(str(end)))
    return df.where(d.between(F.date_sub(e, n - 1), e))


def calendar_parts(df: DataFrame, time: str) -> DataFrame:
    """Month and quarter (null -> 1) and year."""
    return df.withColumns({
        "month": F.coalesce(F.month(time), F.lit(1)),
        "quarter": F.coalesce(F.quarter(time), F.lit(1)),
        "year_of": F.year(time),
    })


def metric_trend(history: DataFrame, model: str = "model", time: str = "generated_at",
                 metrics: Sequence[tuple] = (("rmse", "lower_better"), ("holdout_rmse", "lower_better"),
                                             ("holdout_accuracy", "higher_better"),
                                             ("accuracy", "higher_better"))) -> DataFrame:
    """Latest vs previous snapshot per model.

    ``history`` is wide: one row per (model, snapshot) with nullable metric
    columns. The metric is the first available of ``metrics`` in the latest
    snapshot; the previous value uses the same priority rule on the previous
    snapshot (the latest one when there is none). |delta| < 1e-9 is stable.
    """
    w = Window.partitionBy(model).orderBy(F.col(time).desc())
    ranked = history.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= 2)

    def pick(prefix):
        key = F.coalesce(*[F.when(F.col(f"{prefix}{m}").isNotNull(), F.lit(m)) for m, _ in metrics])
        val = F.coalesce(*[F.col(f"{prefix}{m}") for m, _ in metrics])
        dirn = F.coalesce(*[F.when(F.col(f"{prefix}{m}").isNotNull(), F.lit(d)) for m, d in metrics])
        return key, val, dirn

    names = [m for m, _ in metrics]
    latest = ranked.where(F.col("__rn") == 1).select(model, *[F.col(m).alias(f"c_{m}") for m in names])
    prev = ranked.where(F.col("__rn") == 2).select(model, F.lit(True).alias("__has_prev"),
                                                     *[F.col(m).alias(f"p_{m}") for m in names])
    j = latest.join(prev, model, "left")
    has_prev = F.coalesce(F.col("__has_prev"), F.lit(False))
    ck, cv, cd = pick("c_")
    pv_prev = F.coalesce(*[F.col(f"p_{m}") for m in names])
    pv_last = F.coalesce(*[F.col(f"c_{m}") for m in names])
    pv = F.when(has_prev, pv_prev).otherwise(pv_last)
    delta = cv - pv
    label = (F.when(ck.isNull() | cv.isNull() | pv.isNull(), "No trend")
             .when(F.abs(delta) < 1e-9, "Stable")
             .when(cd == "lower_better", F.when(delta < 0, "Improving").otherwise("Regressing"))
             .otherwise(F.when(delta > 0, "Improving").otherwise("Regressing")))
    return j.select(model, ck.alias("metric"), cv.alias("current"), pv.alias("previous"), label.alias("trend"))

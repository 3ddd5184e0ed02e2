"""Joins.

Broadcast policy
----------------
* Rule tables built from Python literals (zones, bands, scenarios, boxes)
  have a size known on the driver; they are broadcast explicitly or inlined
  as literal arrays (no join at all).
* A reduced side that meets a fact table on a few hot keys (per-label medians,
  class weights, quantile brackets) goes through ``join_measured``: it is
  written, its bytes are summed, and only then is it broadcast, so the fact
  rows never move; a larger one is joined on (key, salt).
* Other sides derived from data (per-country centroids, yearly means) are
  **not** hinted: AQE measures the shuffle output at runtime and turns the join
  into a broadcast only when the measured side is below
  ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
* Two tables that grow together (rows and their scores) meet in ``join_keyed``:
  always a shuffle on their key, as the file statistics of a well-packed table
  would have it broadcast through the driver.
* ``collect_bounded`` is the one place a small derived table is brought to the
  driver (model parameters such as centroids), and only after a bounded
  ``limit(n + 1)`` count proves the bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import norm_key, geo_key_part

#: Measured bytes up to which ``join_measured`` broadcasts a side.
BROADCAST_BYTES = 32 << 20
#: Parts into which it cuts each key of the fact side when the other side is larger.
SALTS = 32
#: Centroids that one expression compares a row with; more go in further blocks.
CENTROID_BLOCK = 10_000


def collect_bounded(df: DataFrame, max_rows: int, what: str = "table") -> list:
    """Collect a small derived table only after proving it has <= max_rows rows."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows; refusing to collect it")
    return rows


def bounded_broadcast(df: DataFrame, max_rows: int = 100_000, what: str = "rule table") -> DataFrame:
    """Broadcast a rule / dimension table only with a proven size bound.

    The rows are collected through ``collect_bounded`` (which refuses more
    than ``max_rows``) and re-created as a local relation, so the broadcast
    can never grow with the data.
    """
    rows = collect_bounded(df, max_rows, what)
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def join_keyed(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables that grow together on their key: a sort-merge join whatever Spark takes their sizes for.

    A Parquet file of a few MB can hold a million rows, so its size says little of what
    a broadcast of them takes on the driver.
    """
    return left.join(right.hint("merge"), on, how)


def written(df: DataFrame) -> DataFrame:
    """An intermediate as a Parquet table in the shared folder: cuts the lineage, survives lost executors, keeps its column statistics."""
    from ..session import scratch_path
    spark = df.sparkSession
    path = scratch_path(spark, "side")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def value_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values, about: text and binary by length, arrays by 64 an element, others 8; 8 more a value."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            n = F.octet_length(c)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            n = F.size(c) * 64
        elif isinstance(f.dataType, T.StructType):
            n = F.octet_length(F.to_json(c))
        else:
            n = F.lit(8)
        size = size + F.coalesce(n, F.lit(0)) + 8
    return size


def written_measured(df: DataFrame) -> tuple[DataFrame, int]:
    """``written(df)`` and the bytes of its values, summed from the written table.

    No ``Observation``: one of those stays registered with the session, and a
    fitted forest of two classes, whose training summary holds the session,
    can't be sent to tasks after that.
    """
    out = written(df)
    return out, out.agg(F.sum(value_bytes(out)).alias("size")).first()["size"] or 0


def join_measured(fact: DataFrame, side: DataFrame, on: Sequence[str], how: str = "left",
                  limit: int = BROADCAST_BYTES, salts: int = SALTS, size: int | None = None) -> DataFrame:
    """Join a reduced ``side`` (one row per key) to a fact table whose keys may be hot.

    The side is written and its bytes are summed (``size``: the side is written
    already and has that many). Up to ``limit`` it is broadcast and the fact
    rows stay where they are. Beyond that the side is copied ``salts`` times
    and the join is on (key, salt), the salt being a hash of the whole fact
    row, so no key's rows meet in one task. Both give the same rows (``how``:
    inner, left or left_semi).
    """
    on = list(on)
    if size is None:
        side, size = written_measured(side)
    if size <= limit:
        return fact.join(F.broadcast(side), on, how)
    row = [F.col(f"`{f.name}`") for f in fact.schema.fields if "map<" not in f.dataType.simpleString()]
    salted = fact.withColumn("__salt", F.pmod(F.xxhash64(*row), F.lit(salts)).cast("int"))
    copies = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


def join_priors(fact: DataFrame, priors: DataFrame, fact_key: str, prior_key: str) -> DataFrame:
    """Left join per-label priors on the normalised key; keep the original label.

    ``priors`` is keyed by ``prior_key`` (already normalised or not); unmatched
    rows get nulls. The priors are written, measured and broadcast
    (``join_measured``): the fact is not shuffled on its few labels.
    """
    p = priors.withColumn("__k", norm_key(prior_key)).drop(prior_key)
    return join_measured(fact.withColumn("__k", norm_key(fact_key)), p, ["__k"]).drop("__k")


def join_yearly(fact: DataFrame, yearly: DataFrame, keys: Sequence[str] = ("country", "year")) -> DataFrame:
    """Left join on two keys."""
    return fact.join(yearly, on=list(keys), how="left")


def join_centroid(fact: DataFrame, geo: DataFrame, key: str = "country") -> DataFrame:
    """Left join key -> mean lat/lon (one row per key on the right)."""
    return fact.join(geo, on=key, how="left")


def merge_by_key(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer join of several keyed frames; key = coalesce of the keys."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, on=key, how="full")
    return out


def zip_columns(left: DataFrame, right: DataFrame, row_key: str) -> DataFrame:
    """Column concatenation on an explicit row key (never positional)."""
    return left.join(right, on=row_key, how="inner")


def with_geo_key(df: DataFrame, lat: str, lon: str, day: Column | str) -> DataFrame:
    """Add (lat_key, lon_key, day_key) integer/text cache keys."""
    d = F.col(day) if isinstance(day, str) else day
    return df.withColumns({"lat_key": geo_key_part(lat), "lon_key": geo_key_part(lon),
                           "day_key": F.date_format(d, "yyyyMMdd")})


def lookup_cached(points: DataFrame, cache: DataFrame,
                  keys: Sequence[str] = ("lat_key", "lon_key", "day_key")) -> DataFrame:
    """Left join on computed keys; a null key part gives null outputs."""
    return points.join(cache, on=list(keys), how="left")


def cache_misses(points: DataFrame, cache: DataFrame,
                 keys: Sequence[str] = ("lat_key", "lon_key", "day_key")) -> DataFrame:
    """Distinct keys not in the cache: the rows that would need fetching.

    ``distinct`` before the anti join shrinks the probe side (partial
    aggregation on every partition).
    """
    k = list(keys)
    need = points.select(*k).where(F.greatest(*[F.col(c).isNull().cast("int") for c in k]) == 0).distinct()
    return need.join(cache.select(*k), on=k, how="left_anti")


def apply_scenarios(rows: DataFrame, scenarios: Sequence[tuple],
                    temp: str = "temperature", rain: str = "rainfall", hum: str = "humidity") -> DataFrame:
    """Every row x each scenario transform, without a join.

    ``scenarios`` = [(name, d_temp, f_rain, f_hum, hum_floor or None), ...]
    (small, known on the driver). They are inlined as a literal array and
    ``inline``-d, a narrow generator: no cartesian product, no shuffle, and
    the fan-out is exactly ``len(scenarios)``.
    """
    arr = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(dt)).alias("d_temp"),
                             F.lit(float(fr)).alias("f_rain"), F.lit(float(fh)).alias("f_hum"),
                             F.lit(None if fl is None else float(fl)).cast("double").alias("hum_floor"))
                    for n, dt, fr, fh, fl in scenarios])
    x = rows.select("*", F.inline(arr))
    new_h = F.col(hum) * F.col("f_hum")
    return x.withColumns({
        temp: F.col(temp) + F.col("d_temp"),
        rain: F.col(rain) * F.col("f_rain"),
        hum: F.when(F.col("hum_floor").isNull(), F.col(hum)).otherwise(F.greatest(F.col("hum_floor"), new_h)),
    }).drop("d_temp", "f_rain", "f_hum", "hum_floor")


def _nearest(rows: DataFrame, centroids: DataFrame, label: str, dist, known: Column, block: int) -> DataFrame:
    """Nearest centroid of every row by a loop over the centroids, held as one array per ``block`` of them.

    ``dist(c)`` is the distance of the row to a centroid struct, null if there is none.
    """
    cents = written(centroids)
    n_blocks = max(1, -(-cents.count() // block))
    held, bests = {}, []
    for i in range(n_blocks):
        part = cents if n_blocks == 1 else cents.where(F.pmod(F.xxhash64(label), F.lit(n_blocks)) == i)
        held[f"__cents{i}"] = part.agg(F.collect_list(F.struct(F.col(label).alias("lab"), F.struct(*[c for c in cents.columns if c != label]).alias("c")))).scalar()
        near = F.transform(f"__cents{i}", lambda s: F.struct(dist(s["c"]).alias("dist"), s["lab"].alias("lab")))
        bests.append(F.array_min(F.filter(near, lambda s: s["dist"].isNotNull())))
    best = F.when(known, F.least(*bests) if n_blocks > 1 else bests[0])
    return (rows.withColumns(held).withColumn("__best", best).withColumns({"rule_label": F.col("__best.lab"), "rule_distance": F.col("__best.dist")})
            .drop("__best", *held))


def nearest_centroid(rows: DataFrame, centroids: DataFrame, feats: Sequence[str],
                     label: str = "label", block: int = CENTROID_BLOCK) -> DataFrame:
    """Nearest centroid label (Euclidean, raw feature space) and its distance.

    Centroids are model parameters (one row per class): they reach the rows as
    one array (a scalar subquery) for each ``block`` of them, so scoring is a
    plain projection whose code does not grow with the centroids: no join, no
    shuffle, no limit on their number. Ties go to the first label
    (``array_min`` compares (distance, label)). Rows with a null feature get
    null; a centroid with a null value is at no distance and is left out.
    """
    feats = list(feats)
    cents = centroids.select(label, *[F.col(f).cast("double").alias(f) for f in feats])

    def dist(c):
        d2 = None
        for f in feats:
            diff = F.col(f) - c[f]
            d2 = diff * diff if d2 is None else d2 + diff * diff
        return F.sqrt(d2)

    known = F.lit(True)
    for f in feats:
        known = known & F.col(f).isNotNull()
    return _nearest(rows, cents, label, dist, known, block)


def nearest_centroid_vec(rows: DataFrame, centroids: DataFrame, vec: str, centroid: str = "centroid",
                         label: str = "label", block: int = CENTROID_BLOCK) -> DataFrame:
    """J9 for array features (embeddings): same plan, distances via higher-order functions.

    A centroid of another length than the row's vector, or with a null in it,
    has no distance and never wins; without any distance the label is null.
    """
    cents = centroids.select(label, F.col(centroid).cast("array<double>").alias("v"))

    def dist(c):
        sq = F.zip_with(F.col(vec), c["v"], lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
        return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))

    return _nearest(rows, cents, label, dist, F.col(vec).isNotNull(), block)


def map_label(df: DataFrame, col: str, mapping: dict, out: str | None = None) -> DataFrame:
    """Dictionary replacement: a hash join with the dictionary, which lies on the driver already (its size is known).

    A value without an entry, and a null, become null; a null key of the dictionary is ignored.
    """
    first = next((v for v in mapping.values() if v is not None), None)
    small = isinstance(first, int) and not isinstance(first, bool) and all(v is None or -2**31 <= v < 2**31 for v in mapping.values())
    kind = T.BooleanType() if isinstance(first, bool) else T.IntegerType() if small else T.LongType() if isinstance(first, int) else T.DoubleType() if isinstance(first, float) else T.StringType()
    schema = T.StructType([T.StructField("__from", df.schema[col].dataType), T.StructField("__to", kind)])
    table = df.sparkSession.createDataFrame([(k, v) for k, v in mapping.items() if k is not None], schema)
    names = df.columns if (out or col) in df.columns else [*df.columns, out or col]
    j = df.join(F.broadcast(table), F.col(f"`{col}`") == F.col("__from"), "left")
    return j.select(*[F.col("__to").alias(n) if n == (out or col) else F.col(f"`{n}`") for n in names])


def range_rule_weight(df: DataFrame, rules: DataFrame, crop: str, temp: str, rain: str,
                      out: str = "weight") -> DataFrame:
    """Per-label band rule as a broadcast left join on lower(crop) + CASE.

    ``rules`` columns: crop, tmin, tmax, rmin, rmax (a fixed small table).
    """
    from ..functions.scalar import climate_weight
    r = rules.select(F.lower("crop").alias("__rc"), "tmin", "tmax", "rmin", "rmax")
    j = df.join(bounded_broadcast(r, what="band rules"), F.lower(F.col(crop)) == F.col("__rc"), "left")
    return j.withColumn(out, climate_weight(temp, rain, "tmin", "tmax", "rmin", "rmax")).drop(
        "__rc", "tmin", "tmax", "rmin", "rmax")


def _grams(text: Column, short: bool) -> Column:
    """Different character trigrams of a text; with ``short`` also its single characters, pairs and the empty text."""
    n = F.length(text)
    if not short:
        return F.when(n < 3, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))))
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array(*[F.substring(text, i, F.lit(w)) for w in (1, 2, 3)]))
    return F.array_union(F.array(F.lit("")), F.flatten(each))


def tiered_match(queries: DataFrame, places: DataFrame, q_key: str, q_text: str,
                 name_cols: Sequence[str], ordinal: str) -> DataFrame:
    """Best place per query: exact name, else prefix, else substring.

    An inverted index of the names' character trigrams (and shorter grams,
    for query texts under three characters), of which only grams that some
    query holds are kept. Each distinct query text probes its rarest gram, so the
    names to verify are those with that gram, and a text that holds a gram of
    no name costs nothing. The probes go to the index by measured size
    (``join_measured``), hot grams stay where they are; the lowest (tier,
    ordinal) per text is a mergeable minimum. Queries without any match are
    absent (callers use a left-anti join to report them); null texts and empty names match nothing.
    """
    names = None
    for c in name_cols:
        s = places.select(F.col(ordinal).alias("__ord"), F.lower(F.col(c)).alias("__nm"))
        names = s if names is None else names.unionByName(s)
    names = names.where(F.col("__nm").isNotNull() & (F.length("__nm") > 0))
    q = queries.select(F.col(q_key), F.lower(F.trim(F.col(q_text))).alias("__key"))
    probes = written(q.select("__key").where(F.col("__key").isNotNull()).distinct().select("__key", F.explode(_grams(F.col("__key"), False)).alias("__gram")))
    grams = names.select("__ord", "__nm", F.explode(_grams(F.col("__nm"), True)).alias("__gram"))
    index = written(join_measured(grams, probes.select("__gram").distinct(), ["__gram"], "left_semi"))
    counts = index.groupBy("__gram").agg(F.count(F.lit(1)).alias("__n"))
    rarest = probes.join(counts, "__gram", "left").groupBy("__key").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__gram").alias("g"))).alias("__p"))
    rarest = rarest.where("__p.n > 0").select("__key", F.col("__p.g").alias("__gram"))
    tier = F.when(F.col("__nm") == F.col("__key"), 1).when(F.startswith("__nm", "__key"), 2).otherwise(3)
    hits = join_measured(index, rarest, ["__gram"], "inner").where(F.contains("__nm", "__key"))
    first = hits.groupBy("__key").agg(F.min(F.struct(tier.alias("__tier"), "__ord")).alias("__b"))
    best = q.join(first, "__key").groupBy(q_key).agg(F.min("__b").alias("__b"))
    return best.select(q_key, F.col("__b.__tier").alias("tier"), F.col("__b.__ord").alias(ordinal))

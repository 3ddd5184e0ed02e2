"""SMOTE-style oversampling until every class has the majority size.

1. The ``k`` nearest of the same class, by distance on standardised features,
   come from ``nearest_neighbours``: exact for classes that fit in a leaf, by
   several projection trees for larger ones. Classes of the majority size make
   no copies and are not searched.
2. A class with ``n_c`` rows needs ``m_c = n_max - n_c`` synthetic rows: every
   row makes ``m_c div n_c`` copies and exactly ``m_c mod n_c`` rows (first in
   hash order, skew-safe ``first_k_by_hash``) make one more.
3. Copy ``j`` of a row interpolates towards a hash-chosen neighbour with a
   hash-derived gap in [0, 1): reproducible for a seed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import TWO32, first_k_by_hash
from .joins import join_measured, written_measured
from .neighbours import LEAF, nearest_neighbours
from .ranking import sample_key


def smote(df: DataFrame, label: str, key: str, feats: Sequence[str], k: int = 5, seed: int = 42,
          rows_per_bucket: int = LEAF, **search) -> DataFrame:
    """``df``'s labelled rows (key, label, features) and the synthetic ones (null key), told apart by ``synthetic``.

    ``rows_per_bucket`` (rows of a class that are compared with each other) and
    ``search`` go to ``nearest_neighbours``. A row without another of its class is copied as it is.
    """
    feats = list(feats)
    d = df.where(F.col(label).isNotNull()).select(key, label, *[F.col(f).cast("double").alias(f) for f in feats])
    counts = d.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n_max = counts.agg(F.max("n_c")).scalar()
    need, size = written_measured(counts.select(label, "n_c", (n_max - F.col("n_c")).alias("m_c")).where("m_c > 0"))

    # 1. neighbours on standardised features, so no unit of measure decides
    st = d.agg(*[F.avg(f).alias(f"m_{f}") for f in feats], *[F.stddev_pop(f).alias(f"s_{f}") for f in feats]).first()
    z = [(F.col(f) - F.lit(st[f"m_{f}"])) / F.lit(st[f"s_{f}"] or 1.0) for f in feats]
    few = join_measured(d, need, [label], "inner", size=size).withColumns({"__v": F.array(*feats), "__z": F.array(*z)})
    near = nearest_neighbours(few, label, key, "__z", k, seed, leaf=rows_per_bucket, **search)

    # 2. exact copy counts per class
    extra = need.select(label, (F.col("m_c") % F.col("n_c")).alias("k"))
    few = first_k_by_hash(few, label, key, extra, seed + 1, out="__extra")
    copies = (F.floor(F.col("m_c") / F.col("n_c")) + F.col("__extra").cast("long")).cast("int")
    syn = few.where(copies > 0).select(label, key, "__v", copies.alias("__copies")).join(near, [label, key], "left")
    syn = syn.select("*", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy"))

    # 3. interpolation towards a hash-chosen neighbour
    hk = F.concat(F.col(key).cast("string"), F.lit("#"), F.col("__copy").cast("string"))
    pick = F.pmod(sample_key(hk, seed), F.greatest(F.size("neighbours"), F.lit(1))).cast("int") + 1
    gap = sample_key(hk, seed + 7).cast("double") / F.lit(TWO32)
    syn = syn.select(label, "__v", gap.alias("__gap"), F.try_element_at("neighbours", pick)["key"].alias("__other"))
    others = few.select(label, F.col(key).alias("__other"), F.col("__v").alias("__w"))
    syn = syn.join(others, [label, "__other"], "left")
    new = F.zip_with("__v", F.coalesce("__w", "__v"), lambda a, b: a + F.col("__gap") * (b - a))
    syn = syn.withColumn("__new", new).select(F.lit(None).cast(df.schema[key].dataType).alias(key), label, *[F.col("__new")[i].alias(f) for i, f in enumerate(feats)], F.lit(True).alias("synthetic"))
    return d.select(key, label, *feats, F.lit(False).alias("synthetic")).unionByName(syn)

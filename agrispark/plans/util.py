"""Small helpers shared by the registered demo queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bround(c, digits: int = 6):
    """Round half away from zero on the binary value: ``round(x * 10^d) / 10^d``.

    Spark's ``round(x, d)`` rounds the shortest decimal text of ``x``
    (2.675 -> 2.68) while most engines, the SQL oracle included, round
    ``x * 10^d`` in binary (2.675 -> 2.67). Rounding the scaled value to an
    integer first makes both agree whenever the inputs are the same double.
    """
    col = F.col(c) if isinstance(c, str) else c
    m = float(10 ** digits)
    return F.round(col * F.lit(m)) / F.lit(m)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column at the output of a demo query (see ``bround``).

    Sums and means are order-dependent in the last bits; the oracle rounds the
    same columns so both engines report the same values. Library operators
    themselves return unrounded values.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            cols.append(bround(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)

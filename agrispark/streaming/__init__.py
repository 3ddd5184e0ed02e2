"""Streaming.

The reference has no streaming code: no watermarks, sessions, stateful or
late-data handling. Nothing is built here beyond a guard: the window and
series operators need the whole of each series (lags, interpolation,
chronological splits), so they accept bounded DataFrames only and say so
instead of failing deep inside the planner.
"""

from pyspark.sql import DataFrame


def require_bounded(df: DataFrame) -> DataFrame:
    if df.isStreaming:
        raise ValueError("this operator needs a bounded (batch) DataFrame; "
                         "apply it inside foreachBatch for a stream")
    return df

"""The metrics log: appends write their own rows, writers don't lose each other's, cuts read no rows."""

import os
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from agrispark.sources import history as H


def snapshot(spark, day, rows=2):
    return spark.createDataFrame([(datetime(2024, 1, day), f"a{i}", "m", float(day)) for i in range(rows)], H.HISTORY_SCHEMA)


def files(base):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(base) for f in fs}


def days(log):
    return sorted((r["generated_at"].day, r["artifact"]) for r in log.collect())


def test_an_append_leaves_what_is_there_alone(spark, tmp_path):
    base = str(tmp_path / "log")
    assert H.read_log(spark, base) is None
    H.append_snapshot(base, snapshot(spark, 1))
    before = files(base)
    H.append_snapshot(base, snapshot(spark, 2, rows=3))
    after = files(base)
    assert all(after[f] == t for f, t in before.items())
    new = spark.read.schema(H.HISTORY_SCHEMA).parquet(*{os.path.dirname(f) for f in set(after) - set(before) if "/data/" in f})
    assert new.count() == 3  # only the snapshot's rows were written
    assert days(H.read_log(spark, base)) == [(1, "a0"), (1, "a1"), (2, "a0"), (2, "a1"), (2, "a2")]


def test_writers_at_the_same_time_do_not_lose_a_snapshot(spark, tmp_path):
    base = str(tmp_path / "log")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda d: H.append_snapshot(base, snapshot(spark, d)), range(1, 9)))
    assert {d for d, _ in days(H.read_log(spark, base))} == set(range(1, 9))


def test_dropped_snapshots_are_pruned_by_the_manifest(spark, tmp_path):
    base = str(tmp_path / "log")
    for d in (3, 1, 2, 5):
        H.append_snapshot(base, snapshot(spark, d))
    H.drop_snapshots(spark, base, keep=2)
    log = H.read_log(spark, base)
    assert {d for d, _ in days(log)} == {3, 5} and len(log.inputFiles()) <= 2 * 8
    opened = {os.path.dirname(f) for f in log.inputFiles()}
    assert len(opened) == 2  # two of four files
    H.append_snapshot(base, snapshot(spark, 4))
    assert {d for d, _ in days(H.read_log(spark, base))} == {3, 4, 5}
    H.drop_snapshots(spark, base, keep=0)
    assert H.read_log(spark, base).count() == 0


def test_empty_snapshot_and_dead_writer(spark, tmp_path):
    base = str(tmp_path / "log")
    H.append_snapshot(base, snapshot(spark, 1))
    H.append_snapshot(base, snapshot(spark, 2).limit(0))
    snapshot(spark, 9).write.parquet(os.path.join(base, "data", "left-by-a-dead-writer"))
    assert {d for d, _ in days(H.read_log(spark, base))} == {1}

"""Every registered query with an SQL twin equals DuckDB on the same tables (sf0.001)."""

import math

import pytest

from agrispark.plans.registry import load_all
from conftest import SF_SMALL

REG = load_all()
NAMES = sorted(n for n, e in REG.items() if e.sql)


def _norm(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return "0" if v == 0 else f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, duck, name):
    e = REG[name]
    df = e.fn(spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(e.sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _canon(df.columns, srows) == _canon(dcols, drows)


def test_registry_is_large_and_named_by_survey_ids():
    assert len(REG) >= 120
    for n in REG:
        assert n.split("_")[0][0] in "SPFJAWLUXMQ" or n.startswith("ML"), n

import corpus_pipeline
import duckdb
import pytest
import test_decontaminate
import test_exact_dedup
import test_packing
import test_simhash
from agrispark.llm import decontaminate, language, queries
from agrispark.llm.common import materialize, scratch_path
from helpers import SF, awkward, docs


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """A data folder whose documents hold every awkward case beside the given rows."""
    path = scratch_path(spark, "pipeline-data")
    base = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(None if i is None else i + 10_000, t, "en") for i, t in awkward()]
    base.unionByName(docs(spark, more).select(base.columns)).write.parquet(f"{path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_each_stage_against_brute_force(spark, table):
    docs0 = spark.read.parquet(f"{table}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    step = lambda name, d: materialize(stages[name](spark, d, table), "step")

    one = step("language_id", docs0)
    found = {(r["id"], r["lang_pred"]) for r in language.identify(docs0).where(f"score >= {corpus_pipeline.MIN_LANGUAGE} AND lang_pred <> 'und'").collect()}
    assert {i for i, _ in rows(one)} == {i for i, _ in found} and one.columns == docs0.columns
    assert all(t and any(map(str.isalpha, t)) for _, t in rows(one))

    two = step("exact_dedup", one)
    assert sorted((i for i, _ in rows(two)), key=str) == sorted((r[0] for r in test_exact_dedup.slow(rows(one)) if r[3]), key=str) and two.columns == docs0.columns

    three = step("near_dedup", two)
    before = rows(two)
    _, least, comp = test_simhash.slow_components(before)
    assert sorted((i for i, _ in rows(three)), key=str) == sorted(dict(zip(comp, least, strict=True)).values(), key=str) and three.columns == docs0.columns

    four = step("decontamination", three)
    items = [decontaminate.normalise(r["text"]) for r in spark.read.parquet(f"{table}/benchmark.parquet").collect()]
    left = {i for i, _ in rows(four)}
    for i, t in rows(three):
        norm = decontaminate.normalise(t)
        if i in left:
            assert not any(p in norm for p in items)
        else:
            assert any(p in norm for p in items) or any(test_decontaminate.distance(p, norm)[0] <= int(len(p) * decontaminate.ERRORS) for p in items)
    assert four.columns == docs0.columns

    test_packing.check(rows(four), decode(spark, stages["packing"](spark, four, table), four), 2048)


def decode(spark, pieces, df):
    """The pieces with their ids, which the stage leaves out: by the operator itself, checked to be the same pieces."""
    from agrispark.llm import packing
    whole = packing.pack(df, queries.tokenizer_path(), queries.SEQUENCE)
    same = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert same(pieces) == same(whole.drop("ids"))
    return whole.collect()


def test_run_is_the_stages_in_turn(spark, table):
    got = corpus_pipeline.run(spark, table)
    d = spark.read.parquet(f"{table}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = materialize(stage(spark, d, table), "step")
    want = corpus_pipeline.STAGES[-1][1](spark, d, table)
    key = lambda x: sorted(map(tuple, x.collect()), key=str)
    assert key(got) == key(want)


def test_scratch_of_the_stages_is_deleted(spark, table):
    import glob
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(glob.glob(f"{base}/llm-*"))
    out = corpus_pipeline.run(spark, table)
    left = set(glob.glob(f"{base}/llm-*")) - before
    stages = [x for x in left if "/llm-stage-" in x]
    assert len(stages) == 1 and "decontamination" in stages[0]
    last = {p.split("/llm-")[1].split("/")[0] for p in out.inputFiles()}
    assert last <= {x.split("/llm-")[1] for x in left} and not [x for x in left if any(t in x for t in ("fingerprints", "kept-keys", "groups"))]
    assert out.count() > 0


def test_empty_tables(spark):
    path = scratch_path(spark, "empty-data")
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []


def test_registered():
    import __spark_entry__
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(queries.SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)

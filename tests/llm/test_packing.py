import zlib

import numpy as np
import pytest
from agrispark.llm import packing
from agrispark.llm.queries import tokenizer_path
from helpers import SF, awkward, docs
from tokenizers import Tokenizer

ODD = ["", " ", "  ", "\n", "a\n", "\na", " a", "a ", "a  b", "a\n\nb", "a \nb", "a\n b", "it's we'll I'M 12 34a", "tab\tand\r\nreturn", "nbsp x  y", "zwj‍x   y", "a\x1c b", "a\x00 b c",
       "<|endoftext|> plain <|endoftext|>", "ünï çödé ¿qué? 日本語 テスト 😀😀 x", "!!! $$$ ### a.b,c", "Ǆ ٣٤ ½ x²", "end."]


def test_ids_equal_the_library():
    enc, whole = packing.Encoder(tokenizer_path(), cache=50), Tokenizer.from_file(tokenizer_path())
    import itertools
    for text in [*ODD, *[a + b for a, b in itertools.product(ODD, ODD)], *[f"{a} {b}\n{a}" for a, b in itertools.product(ODD, ODD)]]:
        assert np.frombuffer(enc.encode(text), enc.kind).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_key_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.hilbert_key(cells, bits)
    assert sorted(keys.tolist()) == list(range(1 << bits * dims))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def check(rows, got, length):
    tok = Tokenizer.from_file(tokenizer_path())
    want = sorted(([*tok.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows))
    pieces = {}
    for r in got:
        pieces.setdefault(r["sequence_id"], []).append(r)
    last = max(pieces, default=-1)
    assert sorted(pieces) == list(range(last + 1))
    flat = []
    for s in range(last + 1):
        at = 0
        for r in sorted(pieces[s], key=lambda r: r["offset"]):
            ids = np.frombuffer(r["ids"], "<u4")
            assert r["offset"] == at and r["length"] == len(ids) > 0 and r["ids_crc32"] == zlib.crc32(r["ids"])
            flat.append((r, ids))
            at += len(ids)
        assert at == length or s == last and at <= length
    made, whole = [], []
    for r, ids in flat:  # pieces in order: a document's follow one another
        if r["start"] == 0:
            made.append([])
            whole.append((r["id"], r["doc_tokens"]))
        assert len(made[-1]) == r["start"] and whole[-1] == (r["id"], r["doc_tokens"])
        made[-1] += ids.tolist()
    assert [len(m) for m in made] == [n for _, n in whole] and sorted(made) == want
    assert sorted((i for i, _ in whole), key=str) == sorted((i for i, _ in rows), key=str)


@pytest.mark.parametrize("length", [2048, 7])
def test_awkward_rows(spark, length):
    rows = [r for r in awkward() if length > 100 or len(r[1] or "") < 1000] + list(enumerate(ODD, 100))
    check(rows, packing.pack(docs(spark, rows), tokenizer_path(), length).collect(), length)


def test_whole_table_and_empty_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    check([(r["doc_id"], r["text"]) for r in df.collect()], packing.pack(df, tokenizer_path()).collect(), 2048)
    assert packing.pack(docs(spark, []), tokenizer_path()).collect() == []


def hashed_one(raw):
    """Hashed vector of one text, run by run."""
    out = np.zeros(packing.FEATURES)
    for i in range(len(raw) - 3):
        out[(int.from_bytes(raw[i:i + 4], "big") * 2654435761 & 0xFFFFFFFF) >> 24] += 1
    return out / max(len(raw) - 3, 1)


@pytest.mark.parametrize("shift", range(4))
def test_hashed_vectors_equal_those_made_run_by_run(shift):
    raws = [b"x" * shift, b"", b"abc", b"abcd", b"the same words here", "日本語 テスト".encode(), b"a", bytes(range(32, 127))]
    data, offsets = np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])
    assert (packing.hashed_vectors(data, offsets) == np.array([hashed_one(r) for r in raws])).all()
    for n in range(6):  # fewer bytes than a run needs, and just enough
        assert (packing.hashed_vectors(data[4:4 + n], np.array([0, n])) == hashed_one(data[4:4 + n].tobytes())).all()


def test_sequences_follow_the_curve(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    key = {r["doc_id"]: int(packing.hilbert_key(packing.project(hashed_one((r["text"] or "").encode())[None]))[0]) for r in df.collect()}
    pieces = packing.pack(df, tokenizer_path()).orderBy("sequence_id", "offset").collect()
    along = [key[r["id"]] for r in pieces]
    assert along == sorted(along) and len({r["id"] for r in pieces}) == len(key)


def test_ranges_grow_with_the_bytes(spark, monkeypatch):
    least, most = packing.LEAST_BYTES, packing.MOST_BYTES
    assert [packing.ranges(n, 48) for n in (0, 1, least, least + 1, 48 * least, 48 * most, 48 * most + 1)] == [1, 1, 1, 2, 48, 48, 49]
    assert packing.ranges(100 * 10 ** 12, 4000) * most >= 100 * 10 ** 12
    df = spark.read.parquet(f"{SF}/documents.parquet")
    whole = packing.pack(df, tokenizer_path()).drop("ids").collect()
    monkeypatch.setattr(packing, "LEAST_BYTES", 10_000)
    monkeypatch.setattr(packing, "MOST_BYTES", 10_000)
    assert packing.curve_order(df).rdd.getNumPartitions() > 8  # more than the session's
    assert sorted(packing.pack(df, tokenizer_path()).drop("ids").collect()) == sorted(whole)  # the layout is the same


def test_ranges_are_even_in_bytes_with_long_texts_and_a_hot_key(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(packing, "LEAST_BYTES", 2_000)
    monkeypatch.setattr(packing, "MOST_BYTES", 2_000)
    rng = np.random.default_rng(3)
    rows = [(i, "one text many times over") for i in range(600)]
    rows += [(1000 + i, rng.integers(97, 123, int(n)).astype(np.uint8).tobytes().decode()) for i, n in enumerate(rng.integers(1, 60, 300))]
    rows += [(2000 + i, rng.integers(97, 101, 1500).astype(np.uint8).tobytes().decode()) for i in range(8)]
    got = packing.curve_order(docs(spark, rows)).select("id", "key", F.octet_length("text").alias("n"), F.spark_partition_id().alias("p")).collect()
    assert sorted(r["id"] for r in got) == sorted(i for i, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r["p"], []).append(r)
    assert max(sum(r["n"] + 1 for r in v) for v in by.values()) <= 2 * 2_000 + 1501
    assert len({r["p"] for r in got if r["id"] < 600}) >= 7  # the copies are not in one task
    along = [r["key"] for p in sorted(by) for r in by[p]]
    assert along == sorted(along)
    check(rows, packing.pack(docs(spark, rows), tokenizer_path(), 100).collect(), 100)


def test_copies_are_neighbours_on_the_curve():
    raws = [b"the same words here " * 9, b"completely different 12345", b"the same words here " * 9 + b"x"]
    data, offsets = np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])
    cells = packing.project(packing.hashed_vectors(data, offsets))
    assert np.abs(cells[0] - cells[2]).max() < np.abs(cells[0] - cells[1]).max()
    alone = packing.hashed_vectors(np.frombuffer(raws[1], np.uint8), np.array([0, len(raws[1])]))
    assert (alone[0] == packing.hashed_vectors(data, offsets)[1]).all()

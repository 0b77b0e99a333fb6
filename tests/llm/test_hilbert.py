"""Operator 5: the curve, the cuts, and the files that a filter can skip."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import hilbert
from tests.llm.util import documents


@pytest.mark.parametrize("dimensions,bits", [(1, 4), (2, 1), (2, 4), (3, 3), (4, 2), (5, 2), (7, 1)])
def test_curve_visits_every_cell_by_single_steps(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    index = hilbert.hilbert_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("dimensions,bits", [(1, 8), (2, 5), (3, 6), (7, 8)])
def test_columns_give_the_same_index(spark, dimensions, bits):
    points = np.random.default_rng(dimensions).integers(0, 1 << bits, (300, dimensions))
    df = spark.createDataFrame([tuple(int(x) for x in p) for p in points], ", ".join(f"c{i} int" for i in range(dimensions)))
    got = [r["h"] for r in df.select(hilbert.curve_index([F.col(f"c{i}") for i in range(dimensions)], bits).alias("h")).collect()]
    assert got == hilbert.hilbert_index(points, bits).tolist() and max(got) > 1 << (bits * dimensions - 4)


def test_too_many_dimensions_are_an_error(spark):
    with pytest.raises(ValueError):
        hilbert.curve_index([F.lit(1)] * 9, 7)


def corpus(n=400):
    return [(i, "x" * (1 + i * 37 % 500)) for i in range(n)], [["en", "de", None, "fr"][i % 4] for i in range(n)], [f"s{i * i % 13}" for i in range(n)]


def sharded(spark, texts, langs, sources, **kw):
    return hilbert.shard(documents(spark, texts, langs, sources), ["n_chars", "source", "lang"], F.octet_length("text"), **kw)


def test_every_row_once_in_runs_of_the_curve(spark):
    texts, langs, sources = corpus()
    rows = sharded(spark, texts, langs, sources, shard_bytes=5_000).collect()
    assert sorted(r["doc_id"] for r in rows) == [i for i, _ in texts]
    spans = {}
    for r in rows:
        spans.setdefault(r["shard"], []).append(r["curve"])
    ordered = [spans[s] for s in sorted(spans)]
    assert all(max(a) < min(b) for a, b in zip(ordered, ordered[1:]))
    assert all(c == sorted(c) for c in ordered)


def test_shards_are_of_about_the_size(spark):
    texts, langs, sources = corpus()
    rows = sharded(spark, texts, langs, sources, shard_bytes=5_000).collect()
    weight = {}
    for r in rows:
        weight[r["shard"]] = weight.get(r["shard"], 0) + len(r["text"])
    assert max(weight.values()) <= 5_000 and len(weight) <= 2 * sum(weight.values()) / 5_000 + 1


def test_a_shard_is_a_partition(spark):
    texts, langs, sources = corpus()
    rows = sharded(spark, texts, langs, sources, shard_bytes=5_000).withColumn("p", F.spark_partition_id()).collect()
    assert len({(r["p"], r["shard"]) for r in rows}) == len({r["p"] for r in rows}) == len({r["shard"] for r in rows})


def test_filters_skip_shards(spark):
    """A filter on any dimension needs fewer shards than in the order of arrival."""
    texts, langs, sources = corpus(4_000)
    df = sharded(spark, texts, langs, sources, shard_bytes=20_000).cache()
    total = df.select("shard").distinct().count()
    for condition in ("n_chars < 60", "source = 's3'", "lang = 'de'"):
        assert df.where(condition).select("shard").distinct().count() < 0.75 * total
    df.unpersist()


def test_one_cell_that_outweighs_a_shard(spark):
    rows = sharded(spark, [(i, "y" * 100) for i in range(300)], ["en"] * 300, ["s"] * 300, shard_bytes=3_000).collect()
    assert len({r["curve"] for r in rows}) == 1 and len({r["shard"] for r in rows}) > 5 and len(rows) == 300


def test_coordinates_are_shares_of_lesser_rows(spark):
    texts, langs, sources = corpus()
    df = documents(spark, texts, langs, sources)
    for column, values in (("n_chars", [len(t) for _, t in texts]), ("source", sources), ("lang", langs)):
        known = [v for v in values if v is not None]
        want = [0 if v is None else sum(x < v for x in known) * 64 // len(known) for v in values]
        got = {r["doc_id"]: r[f"{column}_cell"] for r in hilbert.cells(df, [column], 6).collect()}
        assert [got[i] for i, _ in texts] == want


def test_names_that_begin_alike_and_other_types(spark):
    """Values are told apart however far on they differ; dates, decimals and booleans are ordered as they are."""
    df = spark.range(300).selectExpr("id as doc_id", "concat(repeat('same ', 40), lpad(id, 4, '0')) as name", "date_add(date'2020-01-01', cast(id as int)) as day", "cast(id as decimal(10,2)) as price", "id % 2 = 0 as flag", "'x' as text")
    for c in ("name", "day", "price"):
        assert len({r[f"{c}_cell"] for r in hilbert.cells(df, [c], 6).collect()}) == 64
    assert len({r["flag_cell"] for r in hilbert.cells(df, ["flag"], 6).collect()}) == 2
    out = hilbert.shard(df, ["name", "day", "price", "flag", "doc_id", "text"], F.lit(10), shard_bytes=300)
    assert out.count() == 300 and out.select("shard").distinct().count() > 5


def test_files_and_their_bounds(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    texts, langs, sources = corpus(4_000)
    df = documents(spark, texts, langs, sources)
    files = hilbert.ShardFiles.write(df, str(tmp_path / "out"), ["n_chars", "source", "lang"], F.octet_length("text"), shard_bytes=20_000)
    everything = files.shards("n_chars").count()
    for name, low, high, condition in (("n_chars", None, 60, "n_chars <= 60"), ("source", "s3", "s3", "source = 's3'"), ("lang", "de", "de", "lang = 'de'")):
        assert files.read(name, low, high).exceptAll(df.where(condition)).count() == 0 == df.where(condition).exceptAll(files.read(name, low, high)).count()
        some = files.shards(name, low, high)
        assert 0 < some.count() < 0.75 * everything
    few = [f for f in glob.glob(str(tmp_path / "out/data/*.parquet")) if any(pq.ParquetFile(f).metadata.row_group(g).column(4).statistics.min <= 60 for g in range(pq.ParquetFile(f).metadata.num_row_groups))]
    assert len(few) <= files.shards("n_chars", None, 60).count()  # the files' own statistics skip as much
    assert files.spark.read.parquet(f"{files.path}/shards").agg(F.sum("rows")).first()[0] == 4_000


def test_many_values_of_a_name(spark):
    texts = [(i, "z" * 50) for i in range(500)]
    df = documents(spark, texts, None, [f"site-{i:04d}" for i in range(500)])
    rows = hilbert.shard(df, ["source"], F.octet_length("text"), shard_bytes=2_500).collect()
    first = {}
    for r in rows:
        first.setdefault(r["shard"], []).append(r["source"])
    spans = sorted((min(x), max(x)) for x in first.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and len(spans) > 5


def test_nulls_empty_repeated_rows_and_clashing_names(spark):
    texts = [(1, None), (None, ""), (2, "abc"), (2, "abc"), (3, None)]
    df = documents(spark, texts, [None] * 5, [None, "a", "b", "b", None]).selectExpr("*", "1 as curve", "2 as SHARD", "3 as value", "4 as w", "5 as part", "6 as before")
    out = hilbert.shard(df, ["n_chars", "source", "lang"], F.octet_length("text"))
    assert out.columns == [*df.columns, "curve_", "shard_"]
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "2", "2", "3", "None"]


def test_empty_table(spark):
    out = hilbert.shard(documents(spark, []), ["n_chars", "source", "lang"], F.octet_length("text"))
    assert out.collect() == [] and out.columns[-2:] == ["curve", "shard"]


def test_very_long_text(spark):
    texts = [(i, "w" * (3_000_000 if i == 7 else 10)) for i in range(50)]
    rows = hilbert.shard(documents(spark, texts), ["n_chars", "source"], F.octet_length("text"), shard_bytes=1_000_000).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(50))
    assert {len({r["shard"] for r in rows if (r["doc_id"] == 7) == own}) for own in (True, False)} == {1}  # no row is split


def test_query(spark):
    from lexigrove.llm.queries import op5_hilbert

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = op5_hilbert(spark, sf)
    assert out.drop("curve", "shard").columns == docs.columns
    assert out.drop("curve", "shard").exceptAll(docs).count() == docs.exceptAll(out.drop("curve", "shard")).count() == 0

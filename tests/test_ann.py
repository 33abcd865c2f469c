import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import ann, search
from docloom.plans import catalogue
from docloom.scratch import new_path


def recall(exact, found):
    """Of the distances, as copies tie."""
    want, hits = {}, 0
    for r in exact:
        want.setdefault(r.query_id, []).append(r.distance)
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append(r.distance)
    for q, d in want.items():
        last = max(d) + 1e-6
        hits += min(len(d), sum(x <= last for x in got.get(q, [])))
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_every_fiftieth_row(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    qs = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = search.top_chunks_batch(e, qs, 5).collect()
    index = ann.IvfIndex.build(e, new_path(spark, "ivf"), "vec_id")
    found = index.search_batch(qs, 5, "vec_id").collect()
    assert recall(exact, found) >= 0.9
    assert recall(exact, index.search_batch(qs, 5, "vec_id", probes=10**6).collect()) == 1
    assert sorted(index.cells.groupBy("vec_id").count().select("count").distinct().collect()) == [(1,)] and index.cells.count() == e.count()


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.2 * rng.normal(size=16)).tolist(), i % 4) for i in range(6000)]
    odd = [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [1.0, 2.0], 0), (9003, [float("nan")] * 16, 0), (9004, [None] + [1.0] * 15, 0)]
    chunks = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, part int")
    return chunks, ann.IvfIndex.build(chunks, new_path(spark, "ivf"), "vec_id"), rows


def test_few_cells_hold_near_vectors(spark, clustered, monkeypatch):
    chunks, index, rows = clustered
    assert index.probes <= len(index.centres) / 4
    qs = chunks.filter("vec_id % 50 = 0 AND vec_id < 6000").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = search.top_chunks_batch(chunks.filter("vec_id < 6000"), qs, 5).collect()
    assert recall(exact, index.search_batch(qs, 5, "vec_id").collect()) >= 0.9
    monkeypatch.setattr(ann, "PIECE_ROWS", 50)
    monkeypatch.setattr(ann, "PIECE_QUERIES", 3)
    split = index.search_batch(qs, 5, "vec_id").collect()
    assert recall(exact, split) >= 0.9 and max(r["rank"] for r in split) == 5
    one = index.search_batch(qs, 5, "vec_id", where=F.col("part") == 1, keep=("part",)).collect()
    assert {r.part for r in one} == {1} and len(one) == 5 * 120  # these lie in other clusters than the queries
    want = search.top_chunks_batch(chunks.filter("vec_id < 6000 AND part = 1"), qs, 5).collect()
    assert recall(want, one) == 1


def test_one_query_reads_its_cells_only(spark, clustered):
    chunks, index, rows = clustered
    q = rows[7][1]
    near = index._near(index.nearest_cells(q, 2), q, 5, "vec_id", None)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    got = index.top_chunks(q, 5, "vec_id").collect()
    want = search.top_chunks(chunks.filter("vec_id < 6000"), search.literal_vector(q), 5, "vec_id").collect()
    assert len({r.vec_id for r in got} & {r.vec_id for r in want}) >= 4 and [r["rank"] for r in got] == [1, 2, 3, 4, 5]


def test_filters_run_before_the_cut_and_too_few_hits_are_answered_exactly(spark, clustered):
    chunks, index, rows = clustered
    q, rare = rows[0][1], F.col("vec_id").isin(3, 1001, 2002, 3003, 4004)  # of other clusters
    got = index.top_chunks(q, 5, "vec_id", where=rare, probes=1).collect()
    want = search.top_chunks(chunks, search.literal_vector(q), 5, "vec_id", rare).collect()
    assert [r.vec_id for r in got] == [r.vec_id for r in want] and len(got) == 5
    assert all(math.isclose(a.distance, b.distance, abs_tol=1e-6) for a, b in zip(got, want, strict=True))
    exact = index.top_chunks(q, 7, "vec_id", exact=True).collect()
    assert [r.vec_id for r in exact] == [r.vec_id for r in search.top_chunks(chunks.filter("vec_id < 6000"), search.literal_vector(q), 7, "vec_id").collect()]


def test_index_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/e")
    index = ann.IvfIndex.build(spark.read.parquet(f"{tmp_path}/e"), f"file://{tmp_path}/i", "vec_id")
    assert index.top_chunks([1.0, 2.0], 3, "vec_id").count() == 0
    qs = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    assert index.search_batch(qs, 3, "vec_id").count() == 0


def test_query(spark, sf):
    got = catalogue.search_ivf(spark, sf).collect()
    n = spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 50 = 0").count()
    assert len(got) == 5 * n and random.choice(got).similarity <= 1

"""What Python workers are given at once is bounded by bytes, not by rows alone."""

import pyarrow as pa
from pyspark.sql import functions as F

from docloom.functions.chunking import with_chunks
from docloom.functions.embedding import CharBucketEmbedder, embedded
from docloom.plans import catalogue
from docloom.shipping import BATCH_BYTES, SMALL_BYTES, ship


def test_batches_are_bounded_by_bytes(spark):
    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    before = spark.conf.get(BATCH_BYTES)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "m": [b.nbytes]})

    def largest():
        found = rows.mapInArrow(sizes, "n long, m long").agg(F.sum("n"), F.max("m")).first()
        assert found[0] == 3000
        return found[1]

    try:
        spark.conf.unset(BATCH_BYTES)
        ship(spark)
        assert largest() <= SMALL_BYTES + 20_000
        spark.conf.set(BATCH_BYTES, str(8 << 20))
        ship(spark)  # a session's own bound stays
        assert SMALL_BYTES + 20_000 < largest() <= (8 << 20) + 20_000
    finally:
        spark.conf.set(BATCH_BYTES, before)


def test_embedded_texts_come_in_small_batches(spark):
    before = spark.conf.get(BATCH_BYTES)
    try:
        spark.conf.unset(BATCH_BYTES)
        embedded(F.col("t"), CharBucketEmbedder(4))
        assert spark.conf.get(BATCH_BYTES) == str(SMALL_BYTES)
    finally:
        spark.conf.set(BATCH_BYTES, before)


def test_texts_are_counted_and_split_by_one_worker(spark, sf):
    plan = catalogue.chunk_by_tokens(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_counter_keeps_splits_and_falls_back(spark):
    rows = [(0, None), (1, " \n"), (2, "a " * 9000), (3, "b " * 600), (4, "Z " * 600), (5, "Z" * 12000), (6, " c ")]
    got = with_chunks(spark.createDataFrame(rows, "id int, text string"), count_tokens=catalogue.words_as_tokens).collect()
    assert {(r.id, r.n_tokens, r.n_chunks) for r in got} == {(2, 108000, 21), (3, 7200, 1), (4, 1000, 1), (5, 10001, 14), (6, 12, 1)}
    assert [r.document for r in got if r.id == 6] == ["c"] and all(len(r.document) <= 1000 for r in got if r.n_chunks > 1)

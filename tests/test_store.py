import json

import pytest
from pyspark.sql import functions as F

from docloom.sources.store import ChunkStore, ConcurrentChange


def chunks(spark, paths, tag="a"):
    return spark.createDataFrame([(f"{p}::0", p, 0, 1, tag) for p in paths], "chunk_id string, source_path string, chunk_index int, n_chunks int, content_hash string")


def test_counts_come_from_the_pointer(spark, tmp_path):
    s = ChunkStore(spark, f"file://{tmp_path}", buckets=8)
    s.write("c", chunks(spark, [f"c/{i}" for i in range(40)]))
    s.upsert("c", chunks(spark, ["c/3", "c/100"], "b"))
    assert s.remove_document("c", "c/7") == 1 and s.remove_document("c", "c/none") == 0
    assert s.delete_where("c", F.col("source_path").isin("c/8", "c/9")) == 2
    s.reset("empty")
    assert s.count("c") == 38 == s.read("c").count() and s.count("none") == 0
    for f in (tmp_path / "c").glob("snapshot=*/bucket=*/*.parquet"):  # no chunk is read for a count
        f.rename(str(f) + ".away")
    assert {r.collection: r.chunks for r in s.counts().collect()} == {"c": 38, "empty": 0}


def test_removing_a_document_reads_its_bucket_alone(spark, tmp_path):
    s = ChunkStore(spark, f"file://{tmp_path}", buckets=8)
    s.write("c", chunks(spark, [f"c/{i}" for i in range(40)]))
    mine = s.touched("c", chunks(spark, ["c/5"]))
    for f in (tmp_path / "c").glob("snapshot=*/bucket=*/*.parquet"):
        if f.parent.name != f"bucket={mine[0]}":
            f.write_bytes(b"not to be read")
    assert s.remove_document("c", "c/5") == 1 and s.count("c") == 39


def test_the_second_of_two_writers_fails(spark, tmp_path):
    one, two = (ChunkStore(spark, f"file://{tmp_path}", buckets=4) for _ in range(2))
    one.write("c", chunks(spark, ["c/1", "c/2"]))
    since = one.current("c")
    two.upsert("c", chunks(spark, ["c/3"]))
    with pytest.raises(ConcurrentChange):
        one.write("c", chunks(spark, ["c/9"]), None, since)
    assert {r.source_path for r in one.read("c").collect()} == {"c/1", "c/2", "c/3"}
    one.upsert("c", chunks(spark, ["c/4"]))
    assert two.count("c") == 4
    now = one.current("c")["snapshot"]
    one.files.create_new(f"file://{tmp_path}/c/commits/{now}")  # a writer that died while it published
    with pytest.raises(ConcurrentChange):
        two.upsert("c", chunks(spark, ["c/5"]))
    two.release("c")
    two.upsert("c", chunks(spark, ["c/5"]))
    assert two.count("c") == 5


def test_a_pointer_without_counts_is_counted(spark, tmp_path):
    s = ChunkStore(spark, f"file://{tmp_path}", buckets=4)
    s.write("c", chunks(spark, ["c/1", "c/2"]))
    pointer = tmp_path / "c" / "CURRENT"
    old = {k: v for k, v in json.loads(pointer.read_text()).items() if k != "rows"}
    s.files.replace(f"file://{tmp_path}/c/CURRENT", json.dumps(old))
    assert s.count("c") == 2
    s.upsert("c", chunks(spark, ["c/3"]))
    assert s.count("c") == 3


def rows_of(spark, ids, **cols):
    df = spark.createDataFrame([(f"c/{i}::0", f"c/{i}", i) for i in ids], "chunk_id string, source_path string, i long")
    df = df.withColumn("source_id", F.concat(F.lit("s"), F.col("i") % 10)).withColumn("operation_id", F.concat(F.lit("o"), F.col("i"))).withColumn("revision", F.col("i"))
    return df.withColumns({k: F.lit(v) for k, v in cols.items()}).drop("i")


def test_a_change_writes_in_proportion_to_itself(spark, tmp_path):
    s = ChunkStore(spark, f"file://{tmp_path}", buckets=4)
    text = "".join(chr(97 + i * i % 26) for i in range(300))
    long = spark.range(20000).select(F.concat(F.lit("c/"), "id", F.lit("::0")).alias("chunk_id"), F.concat(F.lit("c/"), "id").alias("source_path"), F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit(text)).alias("document"))
    s.write("c", long)
    size = lambda: {str(f): f.stat().st_size for f in (tmp_path / "c").rglob("part-*")}
    base = size()
    s.upsert("c", long.filter("chunk_id LIKE '%99::0'").withColumn("document", F.lit("new")))  # one row in a hundred, in all buckets
    made = {f: n for f, n in size().items() if f not in base}
    assert sum(made.values()) < 0.1 * sum(base.values()) and base.keys() <= size().keys()
    assert s.count("c") == 20000 == s.read("c").count() and s.read("c").filter("document = 'new'").count() == 200
    assert s.delete_where("c", F.col("document") == "new") == 200 and s.read("c").count() == 19800 == s.count("c")
    assert s.delete_where("c", F.lit(True)) == 19800 and s.count("c") == 0 == s.read("c").count()


def test_merge_on_read_equals_a_plain_dictionary(spark, tmp_path):
    s, plain = ChunkStore(spark, f"file://{tmp_path}", buckets=3, max_deltas=2, dead_share=0.3, dead_rows=5), {}
    for step in range(6):
        ids = [(7 * step + 3 * j) % 50 for j in range(12)]
        s.upsert("c", rows_of(spark, sorted(set(ids)), content_hash=f"h{step}"))
        plain |= {f"c/{i}::0": f"h{step}" for i in ids}
        assert s.remove_document("c", f"c/{ids[0]}") == 1
        plain.pop(f"c/{ids[0]}::0")
        assert {r.chunk_id: r.content_hash for r in s.read("c").collect()} == plain and s.count("c") == len(plain) == s.read("c").count()
    now = s.current("c")
    assert all(len(d) <= 2 for d in now["deltas"].values())
    s.compact("c")
    now = s.current("c")
    assert not now["deltas"] and not now["gone"] and not now["dead"] and s.count("c") == len(plain)
    assert {r.chunk_id: r.content_hash for r in s.read("c").collect()} == plain
    s.upsert("c", rows_of(spark, []))
    twice = rows_of(spark, [200]).unionByName(rows_of(spark, [200]))  # equal rows of a change both stay, as before
    s.upsert("c", twice)
    assert s.count("c") == len(plain) + 2 and s.remove_document("c", "c/200") == 2
    s.write("c", rows_of(spark, [1]))
    s.upsert("c", rows_of(spark, [2]))
    assert not list((tmp_path / "c").glob("gone=*/bucket=*"))  # what no pointer names is deleted by the change after the next


def test_predicates_read_the_buckets_that_can_match(spark, tmp_path):
    s = ChunkStore(spark, f"file://{tmp_path}", buckets=16)
    s.write("c", rows_of(spark, range(100)))
    s.upsert("c", rows_of(spark, [300], operation_id="late"))
    one = s.touched("c", rows_of(spark, [7]))
    assert s.candidates("c", {"source_path": "c/7"}) == one == s.candidates("c", {"operation_id": "o7"}) == s.candidates("c", {"operation_id": "o7", "source_id": {"$in": ["s7"]}})
    assert s.candidates("c", {"operation_id": "none"}) == [] and s.candidates("c", {"$and": [{"operation_id": "late"}, {"source_path": {"$in": ["c/300", "c/1"]}}]}) == s.touched("c", rows_of(spark, [300]))
    assert s.candidates("c", {"revision": {"$lt": 0}}) == [] and len(s.candidates("c", {"revision": {"$lte": 0}})) == 1 and s.candidates("c", {"title": "x"}) is None
    plan = s.read("c", where={"operation_id": "o7"})
    assert len({f.rsplit("/", 1)[0] for f in plan.inputFiles()}) == 1 and [r.chunk_id for r in plan.collect()] == ["c/7::0"]
    for f in (tmp_path / "c").glob("snapshot=*/bucket=*/*.parquet"):
        if f.parent.name != f"bucket={one[0]}":
            f.write_bytes(b"not to be read")
    assert s.discard_operation("c", "o7") == 1 and s.discard_operation("c", "o7") == 0 and s.discard_operation("none", "o7") == 0


def test_predicates_equal_plain_filters(spark, tmp_path):
    s = ChunkStore(spark, f"file://{tmp_path}", buckets=8)
    odd = rows_of(spark, [500], revision=None, source_id=None).withColumn("revision", F.col("revision").cast("long"))
    s.write("c", rows_of(spark, range(60)))
    s.upsert("c", odd)
    every = s.read("c").collect()
    for where, test in (
        ({"source_id": {"$in": ["s1", "s2"]}, "revision": {"$lt": 22}}, lambda r: r.source_id in ("s1", "s2") and r.revision < 22),
        ({"revision": {"$lte": 5}}, lambda r: r.revision is not None and r.revision <= 5),
        ({"revision": {"$in": [3, 59, 77]}}, lambda r: r.revision in (3, 59, 77)),
        ({"$and": [{"source_id": "s3"}, {"revision": 13}]}, lambda r: r.revision == 13),
        ({"operation_id": {"$eq": "o500"}}, lambda r: r.operation_id == "o500"),
        ({"source_id": None}, lambda r: False),
    ):
        assert sorted(r.chunk_id for r in s.read("c", where=where).collect()) == sorted(r.chunk_id for r in every if test(r)), where
    assert s.purge_revisions("c", "s4", 24) == 2 and s.purge_revisions("c", "s4", 24, inclusive=True) == 1 and s.count("c") == 58

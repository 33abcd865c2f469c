"""The ledger's folds and windows at scale: same results, without a cost for each source or a frame that is counted anew for each row."""

from pyspark.sql import functions as F

from docloom.operators import ledger
from docloom.plans import catalogue

RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_fold_streams_sources_over_batches(spark, sf):
    r = catalogue.every_kind(spark, sf)
    folded = ledger.fold(r, at_once=False)
    assert "FlatMapGroupsInPandas" not in plan(folded)  # which costs milliseconds for each source
    want = {}
    for (_,), part in r.toPandas().groupby(["source_id"]):
        for x in ledger.fold_source(part.assign(job=part["job"].astype("Int64")), False).to_dict("records"):
            want[x["seq"]] = (x["outcome"], x["revision_after"])
    before = spark.conf.get(RECORDS)
    try:
        spark.conf.set(RECORDS, "3")  # sources are cut by batches
        got = {x.seq: (x.outcome, x.revision_after) for x in folded.collect()}
    finally:
        spark.conf.set(RECORDS, before)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and (got[k][1] == want[k][1] or got[k][1] is None) for k in want)


def test_lockouts_count_within_buckets_of_time(spark):
    times = [0, 0, 1, 4_999_999, 5_000_000, 5_000_001, 9_999_999, 10_000_000, 14_999_999, 15_000_000, -1, -5_000_000, None, None]
    rows = [(i, u, t) for i, (u, t) in enumerate((u, t) for u in ("a", "b", None) for t in times)]
    df = spark.createDataFrame(rows, "id long, u string, t long").withColumn("ts", F.expr("timestamp_micros(t)"))
    out = ledger.lockouts(df, "u", limit=4, seconds=5)
    # windows that move at both ends are counted anew for each row
    assert "RangeFrame, -" not in plan(out) and out.columns == [*df.columns, "recent", "locked"]
    got = {r.id: (r.recent, r.locked) for r in out.collect()}
    for i, u, t in rows:
        n = sum(v == u and ((s is None) if t is None else s is not None and t - 5_000_000 < s <= t) for _, v, s in rows)
        assert got[i] == (n, n >= 4), (i, u, t)


def test_queue_counts_run_by_parts_of_a_service(spark, monkeypatch):
    monkeypatch.setattr(ledger, "PART", 4, raising=False)
    rows = [(i, s, "finish" if i % 5 == 0 else "index", "succeeded" if i % 5 == 0 else "accepted" if i % 3 else "stale", i - 1 if i % 5 == 0 else None) for i in range(1, 60) for s in [("a", None, "b")[i % 7 % 3]]]
    df = spark.createDataFrame(rows, "seq long, service_id string, kind string, outcome string, job_seq long")
    got = ledger.pending_before(df)
    assert "service_id, __part" in " ".join(x.strip() for x in __import__("re").sub(r"#\d+L?", "", plan(got)).split())  # a service is not one task
    service = {r[0]: r[1] for r in rows}
    began = {r[0] for r in rows if r[3] == "accepted"}
    steps = [(seq, s, 1) for seq, s, *_ in rows if seq in began] + [(r[0], service[r[4]], -1) for r in rows if r[2] == "finish" and r[4] in began]
    assert {r.seq: r.pending for r in got.collect()} == {seq: sum(n for at, v, n in steps if at < seq and v == s) for seq, s, kind, *_ in rows if kind != "finish"}

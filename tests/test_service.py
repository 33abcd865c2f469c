"""The managed service end to end on a stream, the counted queue cap, and verdicts on streams."""

import collections
import json
import time

import pytest
from pyspark.sql import functions as F

from docloom.functions.chunking import MAX_INPUT_TOKENS, with_chunks
from docloom.functions.embedding import CharBucketEmbedder
from docloom.operators import ledger, managed, search
from docloom.operators.kinds import MANAGED
from docloom.plans import catalogue
from docloom.sources.store import ChunkStore
from docloom.streaming import service

EMBEDDER = CharBucketEmbedder(16)


def ask(seq, kind="index", revision=1, key=None, version=None, text="some words of a page", source="doc", who="svc", enabled=None, **more):
    body = {"seq": seq, "service_id": who, "corpus": "easyflow", "source_id": source, "kind": kind, "revision": revision, "idempotency_key": key or f"k{seq}"}
    if kind == "index":
        body |= {"source_version_id": version or f"v{revision}", "title": "T", "pages": [{"page": 1, "text": text}, {"page": 2, "text": text + " again"}]}
    return body | ({"enabled": enabled} if enabled is not None else {}) | more


class Service:
    def __init__(self, spark, root, work=None):
        self.spark, self.root = spark, f"file://{root}"
        self.inbox, self.store, self.seen = root / "in", ChunkStore(spark, f"{self.root}/store", buckets=4), []
        self.inbox.mkdir()
        self.work = work or self.process

    def process(self, corpus, jobs, states):
        self.seen += [r["job"] for r in jobs.select("job").collect()]
        return managed.process(jobs, states, self.store, "easyflow_v1", corpus, EMBEDDER)

    def put(self, *requests):
        part = self.inbox / f".{requests[0]['seq']}.new"
        part.write_text("".join(json.dumps(r) + "\n" for r in requests))
        part.rename(self.inbox / f"r{requests[0]['seq']}.json")

    def start(self, **kw):
        return service.serve(service.paged_requests(self.spark, f"{self.root}/in"), f"{self.root}/in", f"{self.root}/ledger", f"{self.root}/cp", lambda *a: self.work(*a), **kw)

    def run(self, *requests):
        """Requests, then the ends of their jobs."""
        if requests:
            self.put(*requests)
        for _ in range(2):
            q = self.start(interval=None)
            q.awaitTermination(120)
            assert q.exception() is None

    def told(self):
        return self.spark.read.schema(service.TOLD + ", batch int").parquet(f"{self.root}/ledger/outcomes")

    def outcomes(self):
        return [(r.seq, r.outcome) for r in self.told().filter("kind <> 'finish'").orderBy("seq", "batch").collect()]

    def found(self, query="some words"):
        live = service.visible_operations(self.spark, f"{self.root}/ledger").select("operation_id")
        return [r.metadata.source_version_id for r in search.search(self.store.read("easyflow_v1"), MANAGED, EMBEDDER, query, 5, active_operations=live).collect()]


@pytest.fixture(autouse=True)
def one_partition(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_page_wise_requests_end_in_searchable_chunks(spark, tmp_path):
    s = Service(spark, tmp_path)
    s.run(ask(1), ask(2, key="k1"), ask(3, key="k1", text="other"))
    assert s.outcomes() == [(1, "accepted"), (2, "replay"), (3, "key_conflict")] and s.found() == ["v1"] and s.store.count("easyflow_v1") == 2
    # A version is immutable, a revision only rises, another service does not see the source.
    s.run(ask(4, revision=2, version="v1", text="not the same"), ask(5, revision=2), ask(6, revision=2, version="v9"), ask(7, revision=9, who="other"), ask(8, "state", 3, source="new", enabled=True))
    assert s.outcomes()[3:] == [(4, "version_conflict"), (5, "accepted"), (6, "stale"), (7, "not_found"), (8, "no_active_version")] and s.found() == ["v2"]
    assert {r.operation_id for r in s.store.read("easyflow_v1").collect()} == {"5"}  # the older version's chunks are gone
    s.put(ask(9, "state", 3, enabled=False))
    s.start(interval=None).awaitTermination(60)
    assert s.found() == []  # at once, before its job has ended
    s.run(ask(10, "state", 4, enabled=True), ask(11, "delete", 5, source="other"))
    assert s.found() == ["v2"]
    s.run(ask(12, "delete", 5))
    assert s.found() == [] and s.store.count("easyflow_v1") == 0
    status = {r.job: r.status for r in service.job_status(spark, f"{s.root}/ledger", "svc").collect()}
    assert status == dict.fromkeys((1, 5, 9, 10, 11, 12), "succeeded")
    audit = spark.read.parquet(f"{s.root}/ledger/audit")
    assert audit.filter("action = 'source.succeeded' AND target = 'easyflow/doc'").count() == 5


def test_a_failed_job_leaves_the_version_before(spark, tmp_path):
    class Broken(CharBucketEmbedder):
        def embed(self, texts):
            if any("poison" in t for t in texts):
                raise TimeoutError("late")
            return super().embed(texts)

    s = Service(spark, tmp_path)
    s.work = lambda corpus, jobs, states: managed.process(jobs, states, s.store, "easyflow_v1", corpus, Broken(16))
    s.run(ask(1), ask(2, source="b"))
    s.run(ask(3, revision=2, text="poison"), ask(4, source="b", revision=2))
    assert sorted(s.found()) == ["v1", "v2"]
    ends = {r.job_seq: (r.outcome, r.error) for r in s.told().filter("kind = 'finish'").collect()}
    assert ends[3] == ("failed", "EmbeddingUnavailable") and ends[4] == ("succeeded", None)


def test_requests_overtake_a_job_that_is_under_way(spark, tmp_path):
    s = Service(spark, tmp_path)
    held, s.work = [], lambda corpus, jobs, states: spark.createDataFrame([], "job string, state string, error string")
    s.put(ask(1))
    s.start(interval=None).awaitTermination(120)
    s.put(ask(2, "delete", 2))
    s.start(interval=None).awaitTermination(120)
    (s.inbox / "late.json").write_text(json.dumps({"seq": 3, "service_id": "svc", "corpus": "easyflow", "source_id": "doc", "kind": "finish", "job": 1}) + "\n")
    s.run()
    assert [r.outcome for r in s.told().filter("kind = 'finish'").collect()] == ["superseded"] and not held


def test_jobs_are_handed_out_again_after_their_lease(spark, tmp_path):
    """The first worker dies without a word."""
    s, calls = Service(spark, tmp_path), []

    def work(corpus, jobs, states):
        calls.append((time.time(), [r["job"] for r in jobs.select("job").collect()]))
        return spark.createDataFrame([], "job string, state string, error string") if len(calls) == 1 else s.process(corpus, jobs, states)

    s.work = work
    s.put(ask(1))
    q = s.start(lease=6, interval="1 second")
    try:
        end = time.time() + 90
        while time.time() < end and not (len(calls) > 1 and s.told().filter("kind = 'finish'").count()):
            assert q.exception() is None
            time.sleep(1)
    finally:
        q.stop()
    assert [c[1] for c in calls] == [["1"], ["1"]] and calls[1][0] > calls[0][0]
    assert [o for _, o in s.outcomes()] == ["accepted", "reclaimed"] and s.found() == ["v1"]


def test_a_batch_that_dies_runs_again(spark, tmp_path):
    s, calls = Service(spark, tmp_path), []

    def work(corpus, jobs, states):
        calls.append(1)
        out = s.process(corpus, jobs, states)
        if len(calls) == 1:
            raise RuntimeError("killed after the chunks were written")
        return out

    s.work = work
    s.put(ask(1))
    q = s.start(interval=None)
    with pytest.raises(Exception, match="killed"):
        q.awaitTermination(120)
    s.run()
    assert s.found() == ["v1"] and s.store.count("easyflow_v1") == 2 and len(calls) == 2
    assert s.outcomes() == [(1, "accepted")]


def plain_capped(rows, cap):
    """One request after the other; each service's jobs under way are looked up among all sources."""
    from tests.test_engine import plain_protocol

    sources, busy, out = collections.defaultdict(list), {}, {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        mine = sources[r["source_id"]]
        r = dict(r, queue_full=sum(v == r["service_id"] for v in busy.values()) >= cap)
        mine.append(r)
        answer = plain_protocol(mine)[0][-1][1]
        out[r["seq"]] = answer
        if answer == "accepted":
            busy[r["seq"]] = r["service_id"]
        elif answer in ("succeeded", "superseded", "failed"):
            busy.pop(r["job"], None)
    return out


@pytest.mark.parametrize("cap", [2, 12])
def test_counted_queue_cap_equals_plain_rules(spark, sf, cap):
    rows = [r.asDict() for r in catalogue.by_service(spark, sf).collect()]
    want = plain_capped(rows, cap)
    got = {r.seq: r.outcome for r in ledger.fold_capped(catalogue.by_service(spark, sf), cap).collect()}
    assert got == want and collections.Counter(want.values())["rate_limited"] > 5


def test_streamed_verdicts_equal_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    for i, (lo, hi) in enumerate([(0, 300), (300, 301), (301, 2000)]):  # in order of time
        part = e.withColumn("n", F.expr("row_number() OVER (ORDER BY ts, event_id)")).filter((F.col("n") > lo) & (F.col("n") <= hi)).drop("n")
        part.coalesce(1).write.parquet(f"{tmp_path}/e{i}")
    read = {}

    def streamed(name, make):
        rows = []
        for i in range(3):  # the query is stopped and started anew between the parts
            folder = tmp_path / f"in_{name}"
            folder.mkdir(exist_ok=True)
            for f in (tmp_path / f"e{i}").glob("*.parquet"):
                f_new = folder / f"{i}.parquet"
                f_new.write_bytes(f.read_bytes())
            s = make(spark.readStream.schema(e.schema).parquet(str(folder)))
            s.writeStream.foreachBatch(lambda df, n: rows.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp_{name}").trigger(availableNow=True).start().awaitTermination(120)
        read[name] = rows
        return rows

    got = streamed("rate", lambda s: service.rate_verdicts(s, 1, "user_id", "ts", "event_id"))
    want = ledger.rate_limited(e, 1, "user_id", "ts", "event_id").collect()
    assert sorted((r.seq, r.n, r.rejected, r.retry_after) for r in got) == sorted((r.event_id, r.n, r.rejected, r.retry_after) for r in want)
    ok = F.col("event_type") == "signup"
    got = streamed("lockout", lambda s: service.lockout_verdicts(s, "user_id", ok, "ts", "event_id", 3, 86_400 * 5))
    want = ledger.lockouts_cleared(e, "user_id", ok, "ts", "event_id", 3, 86_400 * 5).collect()
    assert sorted((r.seq, r.recent, r.locked) for r in got) == sorted((r.event_id, r.recent, r.locked) for r in want)
    assert any(r.locked for r in want)


def test_success_clears_a_lockout(spark):
    rows = [("u", i, 1000 + i, False) for i in range(8)] + [("u", 8, 1010, True), ("u", 9, 1011, False), ("u", 10, 1311, False), ("v", 11, 1000, False), ("v", 12, 1000, False)]
    df = spark.createDataFrame(rows, "user string, seq long, at long, ok boolean").withColumn("ts", F.timestamp_seconds("at"))
    got = {r.seq: (r.recent, r.locked) for r in ledger.lockouts_cleared(df, "user", F.col("ok")).collect()}
    assert got[7] == (8, True) and got[6] == (7, False) and got[8] == (0, False) and got[9] == (1, False) and got[10] == (1, False) and got[11] == (1, False) and got[12] == (2, False)


def test_a_counter_overrules_length_both_ways(spark):
    texts = ["short " * 300, "x" * 9000, "fails " * 1000, "fails short"]
    calls = []

    def count(batch):
        calls.append(len(batch))
        if any(t.startswith("fails") for t in batch):
            raise RuntimeError
        return [MAX_INPUT_TOKENS + 1 if t.startswith("short") else 5 for t in batch]

    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    n = {r.i: r.n for r in with_chunks(df, count_tokens=count).groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n[0] > 1 and n[1] == 1 and n[2] == 1 and n[3] == 1  # heuristic: 6,000 characters are 5,000 tokens

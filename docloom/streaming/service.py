"""The managed service as one stateful stream, and verdicts on streams of attempts.

Requests arrive page-wise as JSON files. Each source's state is in the state store by field: a small head, and maps of idempotency keys, versions and jobs under way, of which a
request reads and writes its own entries only. An accepted job is handed out with its outcome row and gets a lease; if no ``finish`` row has come back when the lease ends, a timer
hands it out again. Each batch runs the jobs it was handed and writes their ends as requests of kind ``finish`` into the folder that the stream reads, under the batch's number: a
batch that runs again after a crash makes the same chunks and the same file.

Keys, versions and jobs are kept as long as their source is (``keep``: how long idempotency keys and versions are kept after their last write, for ever by default).
Within a batch a source's requests go by seq; a request that comes in a later batch is later, whatever its seq.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from docloom.functions.text import canonical_checksum
from docloom.operators import ledger, managed
from docloom.shipping import ship
from docloom.sources.store import Files

EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PAGED = (
    "seq long, service_id string, corpus string, source_id string, kind string, revision long, idempotency_key string, source_version_id string, title string, "
    "pages array<struct<page:int,text:string>>, enabled boolean, queue_full boolean, job long, error string"
)
ASKED = ledger.REQUEST + ", payload string"
TOLD = ledger.OUTCOME + ", payload string"
REQUEST_NAMES, TOLD_NAMES = ([x.split()[0] for x in s.split(", ")] for s in (ASKED, TOLD))


def stateful(spark: SparkSession) -> None:
    """State by field needs the store that keeps it on disk."""
    spark.conf.set(PROVIDER, ROCKS)
    ship(spark)


def paged_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Page-wise requests that arrive as JSON files in a folder, with checksum, content hash and payload."""
    read = spark.readStream.schema(PAGED).option("maxFilesPerTrigger", 1000).json(folder)
    body = F.to_json(F.struct("revision", "source_version_id", "title", "pages", "enabled"))
    index = F.col("kind") == "index"
    hashed = managed.version_hash(F.coalesce("title", F.lit("")), F.coalesce("pages", F.array().cast("array<struct<page:int,text:string>>")))
    return read.select("*", canonical_checksum("kind", body).alias("checksum"), F.when(index, hashed).alias("content_hash"), F.when(index, F.to_json(F.struct("title", "pages"))).alias("payload")).select(*REQUEST_NAMES)


class Kept:
    """A mapping over a map in the state store: entries are read and written one by one."""

    def __init__(self, state, single: bool):
        self.state, self.single = state, single

    def _key(self, k) -> tuple:
        return k if isinstance(k, tuple) else (k,)

    def __contains__(self, k) -> bool:
        return self.state.containsKey(self._key(k))

    def get(self, k, default=None):
        if k not in self:
            return default
        v = tuple(self.state.getValue(self._key(k)))
        return v[0] if self.single else v

    def __setitem__(self, k, v) -> None:
        self.state.updateValue(self._key(k), (v,) if self.single else tuple(v))

    def setdefault(self, k, v):
        if k not in self:
            self[k] = v
        return self.get(k)

    def pop(self, k):
        v = self.get(k)
        self.state.removeKey(self._key(k))
        return v


class SourceProcessor(StatefulProcessor):
    """The protocol of ledger.Source over kept state, with leases."""

    HEAD = "owner string, revision long, enabled boolean, deleted boolean, active long"

    def __init__(self, lease: float, keep: timedelta | None):
        self.lease_ms, self.keep = int(lease * 1000), None if keep is None else int(keep.total_seconds() * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", self.HEAD)
        self.keys = handle.getMapState("keys", "service string, key string", "job long, checksum string", self.keep)
        self.versions = handle.getMapState("versions", "version string", "hash string", self.keep)
        self.open = handle.getMapState("open", "job long", "kind string, revision long")
        self.handed = handle.getMapState("handed", "job long", "until long, row string")

    def _source(self) -> ledger.Source:
        source = ledger.Source()
        if self.head.exists():
            source.owner, source.revision, source.enabled, source.deleted, source.active = self.head.get()
        source.keys, source.versions, source.open = Kept(self.keys, False), Kept(self.versions, True), Kept(self.open, False)
        return source

    def _told(self, r: dict, source: ledger.Source, outcome: str, job: int | None, payload: str | None) -> Row:
        after = {"outcome": outcome, "job_seq": job, "revision_after": source.revision, "enabled_after": source.enabled, "deleted_after": source.deleted, "active_job_after": source.active, "payload": payload}
        return Row(**{n: ({**r, **after}).get(n) for n in TOLD_NAMES})

    def _hand_out(self, r: dict, job: int, now: int) -> None:
        self.handed.updateValue((job,), (now + self.lease_ms, json.dumps(r)))
        self.handle.registerTimer(now + self.lease_ms)

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        source, now = self._source(), timerValues.getCurrentProcessingTimeInMs()
        for r in sorted((row.asDict() for row in rows), key=lambda r: r["seq"]):
            if r["kind"] == "finish":
                job = int(r["job"])
                outcome = source.finish(job, r["error"])
                if self.handed.containsKey((job,)):
                    self.handed.removeKey((job,))
                yield self._told(r, source, outcome, job, None)
                continue
            outcome, job = source.submit(r)
            handed = outcome == "accepted"
            if handed:
                self._hand_out(r, job, now)
            yield self._told(r, source, outcome, job, r["payload"] if handed else None)
        self.head.update((source.owner, source.revision, source.enabled, source.deleted, source.active))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        source, now = self._source(), timerValues.getCurrentProcessingTimeInMs()
        late = [(k[0], v) for k, v in self.handed.iterator() if v[0] <= expiredTimerInfo.getExpiryTimeInMs()]
        for job, (_, text) in late:
            r = json.loads(text)
            self._hand_out(r, job, now)
            yield self._told(r, source, "reclaimed", job, r["payload"])

    def close(self) -> None:
        pass


def outcomes(requests: DataFrame, lease: float = ledger.LEASE_SECONDS, keep: timedelta | None = None) -> DataFrame:
    """A row for each request, and one of outcome ``reclaimed`` for each job whose lease ended. Rows that hand a job out have its payload."""
    stateful(requests.sparkSession)
    return requests.groupBy("corpus", "source_id").transformWithState(SourceProcessor(lease, keep), TOLD, "Append", "ProcessingTime")


def handed_jobs(told: DataFrame) -> DataFrame:
    """managed.JOB rows of the jobs that a batch's outcomes hand out, with service and corpus."""
    body = F.from_json("payload", "title string, pages array<struct<page:int,text:string>>")
    jobs = told.filter("outcome IN ('accepted', 'reclaimed')").withColumn("b", body)
    return jobs.select(
        F.col("job_seq").cast("string").alias("job"), "source_id", "kind", "revision", "source_version_id", F.col("b.title").alias("title"), F.col("content_hash").alias("payload_hash"), F.col("b.pages").alias("pages"), "service_id", "corpus",
    )


def serve(
    requests: DataFrame, folder: str, ledger_path: str, checkpoint: str, work: Callable[[str, DataFrame, DataFrame], DataFrame],
    lease: float = ledger.LEASE_SECONDS, keep: timedelta | None = None, interval: str | None = "1 second",
) -> StreamingQuery:
    """Run the service over requests from folder. work(corpus, jobs, states) runs handed jobs and returns job, state, error, as managed.process does; jobs that it does not return are handed out again.

    Outcomes are appended to <ledger_path>/outcomes by batch, each finished job also as an audit row to <ledger_path>/audit.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        path = f"{ledger_path}/outcomes/batch={number}"
        df.write.mode("overwrite").parquet(path)
        told = spark.read.schema(TOLD).parquet(path)
        jobs = handed_jobs(told)
        ends = []
        for corpus in [r[0] for r in jobs.select("corpus").distinct().collect()]:
            mine = jobs.filter(F.col("corpus") == corpus)
            states = told.filter(F.col("corpus") == corpus).groupBy("source_id").agg(F.max("revision_after").alias("revision"))
            asked = {r["job"]: r for r in mine.drop("pages").collect()}  # bounded by the services' queues
            for r in work(corpus, mine.drop("service_id", "corpus"), states).collect():
                a = asked[r["job"]]
                ends.append({"seq": int(r["job"]), "service_id": a["service_id"], "corpus": corpus, "source_id": a["source_id"], "kind": "finish", "job": int(r["job"]), "error": r["error"]})
        files = Files(spark, folder)
        if ends:
            files.replace(f"{folder}/finish-{number}.json", "".join(json.dumps(e) + "\n" for e in ends))
        finished = told.filter("kind = 'finish'").select("service_id", F.concat(F.lit("source."), "outcome").alias("action"), F.concat_ws("/", "corpus", "source_id").alias("target"), F.col("job_seq").alias("job"), "error")
        finished.write.mode("overwrite").parquet(f"{ledger_path}/audit/batch={number}")

    writer = outcomes(requests, lease, keep).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint)
    if interval:
        return writer.trigger(processingTime=interval).start()
    # What has arrived, and no more: batches without rows would wait for leases to end, so these fire in later runs.
    conf, before = requests.sparkSession.conf, requests.sparkSession.conf.get(EMPTY_BATCHES)
    conf.set(EMPTY_BATCHES, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(EMPTY_BATCHES, before)


def visible_operations(spark: SparkSession, ledger_path: str) -> DataFrame:
    """corpus, operation_id of the versions that searches may see: each source's state after its newest batch."""
    told = spark.read.schema(TOLD + ", batch int").parquet(f"{ledger_path}/outcomes")
    at = F.struct("batch", (F.col("kind") == "finish").cast("int"), "seq")
    last = told.groupBy("corpus", "source_id").agg(F.max_by(F.struct("enabled_after", "deleted_after", "active_job_after"), at).alias("s")).select("corpus", "s.*")
    return last.filter("enabled_after AND NOT deleted_after AND active_job_after IS NOT NULL").select("corpus", F.col("active_job_after").cast("string").alias("operation_id"))


def job_status(spark: SparkSession, ledger_path: str, service_id: str) -> DataFrame:
    """job, corpus, source_id, status of a service's jobs: queued, or how they ended."""
    told = spark.read.schema(TOLD + ", batch int").parquet(f"{ledger_path}/outcomes").filter(F.col("service_id") == service_id)
    ended = F.when(F.col("kind") == "finish", F.struct(F.lit(1), F.col("outcome").alias("status"))).otherwise(F.struct(F.lit(0), F.lit("queued").alias("status")))
    return told.filter("outcome IN ('accepted', 'reclaimed', 'succeeded', 'superseded', 'failed')").groupBy(F.col("job_seq").alias("job"), "corpus", "source_id").agg(F.max(ended).alias("e")).select("job", "corpus", "source_id", F.col("e.status").alias("status"))


class LockoutProcessor(StatefulProcessor):
    """Failures of the last seconds since the last success, one user."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.span = limit, seconds * 1_000_000

    def init(self, handle) -> None:
        self.failures = handle.getListState("failures", "us long")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        held = [f[0] for f in self.failures.get()] if self.failures.exists() else []
        for r in sorted(rows, key=lambda r: (r.us, r.seq)):
            held = [] if r.success else [*held, r.us]
            held = [t for t in held if t > r.us - self.span]
            yield Row(user=r.user, seq=r.seq, recent=len(held), locked=len(held) >= self.limit)
        if held:
            self.failures.put([(t,) for t in held])
        else:
            self.failures.clear()

    def close(self) -> None:
        pass


def lockout_verdicts(attempts: DataFrame, user: str, success, ts: str = "ts", order: str = "seq", limit: int = ledger.LOCKOUT_FAILURES, seconds: int = ledger.LOCKOUT_SECONDS) -> DataFrame:
    """ledger.lockouts_cleared() of a stream: user, seq, recent, locked. A user's state holds failures within the window only."""
    stateful(attempts.sparkSession)
    rows = attempts.select(F.col(user).cast("string").alias("user"), F.col(order).cast("long").alias("seq"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.coalesce(success, F.lit(False)).alias("success"))
    return rows.groupBy("user").transformWithState(LockoutProcessor(limit, seconds), "user string, seq long, recent long, locked boolean", "Append", "None")


class MinuteProcessor(StatefulProcessor):
    """Requests of the last minutes of one service; buckets two behind the newest go."""

    def __init__(self, rpm: int):
        self.rpm = rpm

    def init(self, handle) -> None:
        self.counts = handle.getMapState("counts", "bucket long", "n long")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        held = {k[0]: v[0] for k, v in self.counts.iterator()}  # three at most
        for r in sorted(rows, key=lambda r: (r.us, r.seq)):
            seconds = r.us // 1_000_000
            bucket = seconds // 60
            n = held[bucket] = held.get(bucket, 0) + 1
            yield Row(service=r.service, seq=r.seq, n=n, rejected=n > self.rpm, retry_after=60 - seconds % 60 if n > self.rpm else None)
            if len(held) > 3:
                held = {b: c for b, c in held.items() if b >= bucket - 2}
        newest = max(held)
        for b in [k[0] for k in self.counts.keys()]:
            if b < newest - 2:
                self.counts.removeKey((b,))
        for b, c in held.items():
            if b >= newest - 2:
                self.counts.updateValue((b,), (c,))

    def close(self) -> None:
        pass


def rate_verdicts(log: DataFrame, rpm: int = ledger.DEFAULT_RPM, service: str = "service_id", ts: str = "ts", order: str = "seq") -> DataFrame:
    """ledger.rate_limited() of a stream: service, seq, n, rejected, retry_after, as requests come in; counts outlive restarts."""
    stateful(log.sparkSession)
    rows = log.select(F.col(service).cast("string").alias("service"), F.col(order).cast("long").alias("seq"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    return rows.groupBy("service").transformWithState(MinuteProcessor(rpm), "service string, seq long, n long, rejected boolean, retry_after long", "Append", "None")

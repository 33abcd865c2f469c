"""Idempotent, revision-fenced ingestion as folds over an append-only ledger of requests.

Where one rule alone can reject, window and aggregate forms are exact; the full protocol, in which a rejected request must
not advance state, is a sequential fold for each (corpus, source).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from docloom.scratch import new_path
from docloom.shipping import ship

# Fixed values.
PENDING_CAP = 100
LEASE_SECONDS = 300
LOCKOUT_FAILURES, LOCKOUT_SECONDS = 8, 300
DEFAULT_RPM = 120
PART = 1 << 16  # requests of a part, where numbers of requests have no gaps

REQUEST = (
    "seq long, service_id string, corpus string, source_id string, kind string, revision long, idempotency_key string, source_version_id string, checksum string, "
    "content_hash string, enabled boolean, queue_full boolean, job long, error string"
)
OUTCOME = REQUEST + ", outcome string, job_seq long, revision_after long, enabled_after boolean, deleted_after boolean, active_job_after long"


class Source:
    """One source's state, and what a request or the end of a job does to it."""

    def __init__(self):
        self.owner, self.revision, self.enabled, self.deleted, self.active = None, None, False, False, None  # keys, versions and open may be any mappings
        self.keys: dict[tuple, tuple] = {}
        self.versions: dict[str, str] = {}
        self.open: dict[int, tuple[str, int]] = {}  # job -> kind, revision

    def dumps(self) -> str:
        """All that later requests depend on, as JSON."""
        keys = [[*k, *v] for k, v in self.keys.items()]
        return json.dumps([self.owner, self.revision, self.enabled, self.deleted, self.active, keys, self.versions, [[j, *v] for j, v in self.open.items()]])

    @classmethod
    def loads(cls, text: str) -> Source:
        source = cls()
        source.owner, source.revision, source.enabled, source.deleted, source.active, keys, source.versions, open_ = json.loads(text)
        source.keys = {(service, key): (job, checksum) for service, key, job, checksum in keys}
        source.open = {job: (kind, revision) for job, kind, revision in open_}
        return source

    def submit(self, r: dict) -> tuple[str, int | None]:
        """(outcome, job). A refused request leaves the state as it was."""
        known = self.keys.get((r["service_id"], r["idempotency_key"]))
        if known:
            return ("replay", known[0]) if known[1] == r["checksum"] else ("key_conflict", None)
        refusal = self._refusal(r)
        if refusal:
            return refusal, None
        job, kind = r["seq"], r["kind"]
        self.owner, self.revision = r["service_id"], r["revision"]
        self.keys[r["service_id"], r["idempotency_key"]] = (job, r["checksum"])
        self.open[job] = (kind, r["revision"])
        if kind == "index":
            self.versions.setdefault(r["source_version_id"], r["content_hash"])
        else:  # visible at once; an old version stays while a new one is made
            self.enabled, self.deleted = kind == "state" and bool(r["enabled"]), kind == "delete"
        return "accepted", job

    def _refusal(self, r: dict) -> str | None:
        if self.owner is not None:
            if self.owner != r["service_id"]:
                return "not_found"
            if r["revision"] <= self.revision:
                return "stale"
        if r["queue_full"]:
            return "rate_limited"
        if r["kind"] == "index":
            return "version_conflict" if self.versions.get(r["source_version_id"], r["content_hash"]) != r["content_hash"] else None
        if r["kind"] == "state" and r["enabled"] and (self.active is None or self.deleted):
            return "no_active_version"
        return None

    def finish(self, job: int, error: str | None) -> str:
        """succeeded, superseded by a later request, failed, or unknown if no such job is under way."""
        if job not in self.open:
            return "unknown"
        kind, revision = self.open.pop(job)
        if error:
            return "failed"
        if revision != self.revision:
            return "superseded"
        if kind == "index":
            self.active, self.enabled, self.deleted = job, True, False
        return "succeeded"


def _answer(source: Source, r: dict, at_once: bool) -> tuple:
    """The outcome of a request, its job, and the source's state after it: the columns that OUTCOME adds to REQUEST."""
    if r["kind"] == "finish":
        outcome, job = source.finish(r["job"], r["error"]), r["job"]
    else:
        outcome, job = source.submit(r)
        if at_once and outcome == "accepted":
            source.finish(job, None)
    return outcome, job, source.revision, source.enabled, source.deleted, source.active


def fold_source(requests: pd.DataFrame, at_once: bool = True, source: Source | None = None) -> pd.DataFrame:
    """The outcome of each request of one source, in order of arrival, and the state after it.

    Rows of kind finish say that ``job`` ended, with an error's class name or none; with at_once, jobs need no such rows and end when they are accepted.
    source: what earlier requests left, which these go on from and change.
    """
    source, out = source or Source(), []
    nothing = lambda x: x is None or x is pd.NA or x != x
    for r in requests.sort_values("seq").to_dict("records"):
        r = {k: None if nothing(v) else v for k, v in r.items()}
        if r["kind"] == "finish":
            r["job"] = int(r["job"])
        out.append((*r.values(), *_answer(source, r, at_once)))
    names = [x.split()[0] for x in OUTCOME.split(", ")]
    return pd.DataFrame(out, columns=names).astype({c: "Int64" for c in ("revision", "job", "job_seq", "revision_after", "active_job_after")})


def _full(requests: DataFrame) -> DataFrame:
    ship(requests.sparkSession)
    have = set(requests.columns)
    return requests.select(*(F.col(n).cast(t).alias(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in REQUEST.split(", "))))


def _by_source(requests: DataFrame):
    return _full(requests).groupBy("corpus", "source_id")


def fold(requests: DataFrame, at_once: bool = True) -> DataFrame:
    """Columns of REQUEST that requests lacks are null: queue_full is pending_full() of the service when the request came.

    Sources are dealt over tasks and lie in each by source and seq, so that a task reads its rows as a stream and holds the state of one source at a time.
    """
    added = {"outcome": pa.string(), "job_seq": pa.int64(), "revision_after": pa.int64(), "enabled_after": pa.bool_(), "deleted_after": pa.bool_(), "active_job_after": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, source = None, Source()
        for b in batches:
            out = []
            for r in b.to_pylist():
                at = r["corpus"], r["source_id"]
                if at != last:
                    last, source = at, Source()
                out.append(_answer(source, r, at_once))
            columns = zip(*out, strict=True) if out else [()] * len(added)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(columns, added.values(), strict=True))], [*b.schema.names, *added])

    ordered = _full(requests).repartition("corpus", "source_id").sortWithinPartitions("corpus", "source_id", F.col("seq").asc_nulls_last())
    return ordered.mapInArrow(run, OUTCOME)


def fold_stream(requests: DataFrame, at_once: bool = True) -> DataFrame:
    """fold() of a stream: each source is kept in the state store, so a batch folds its own requests only.

    Within a batch requests go by seq; a request that comes in a later batch is later, whatever its seq.
    """

    def step(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        source = Source.loads(state.get[0]) if state.exists else Source()
        yield fold_source(pd.concat(list(parts)), at_once, source)
        state.update((source.dumps(),))

    return _by_source(requests).applyInPandasWithState(step, OUTCOME, "memory string", "append", "NoTimeout")


def latest_state(outcomes: DataFrame) -> DataFrame:
    """Of each source, its state after the last request."""
    last = F.max_by(F.struct("service_id", "revision_after", "enabled_after", "deleted_after", "active_job_after"), "seq").alias("s")
    return outcomes.groupBy("corpus", "source_id").agg(last).select("corpus", "source_id", "s.*")


def submissions(requests: DataFrame) -> DataFrame:
    """Per idempotency key: the job of the first request, replays of the same checksum, conflicts of others."""
    key = Window.partitionBy("service_id", "corpus", "source_id", "idempotency_key").orderBy("seq")
    first = F.first("checksum").over(key)
    job = F.first("seq").over(key)
    outcome = F.when(F.row_number().over(key) == 1, "accepted").when(F.col("checksum") == first, "replay").otherwise("conflict")
    return requests.withColumn("job_seq", job).withColumn("outcome", outcome)


def fence(requests: DataFrame) -> DataFrame:
    """accepted iff the revision is above all before it: where only staleness rejects, the running maximum is that of accepted rows."""
    before = Window.partitionBy("source_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("revision").over(before)
    return requests.withColumn("current", top).withColumn("accepted", top.isNull() | (F.col("revision") > top))


def version_conflicts(requests: DataFrame) -> DataFrame:
    """The first content of each version wins; later differing ones are conflicts."""
    first = requests.groupBy("source_id", "source_version_id").agg(F.min_by("content_hash", "seq").alias("first_hash"))
    return requests.join(first, ["source_id", "source_version_id"]).withColumn("conflict", F.col("content_hash") != F.col("first_hash"))


def rate_limited(log: DataFrame, rpm: int = DEFAULT_RPM, service: str = "service_id", ts: str = "ts", order: str = "seq") -> DataFrame:
    """Request n of a service's minute is rejected iff n > rpm; retry_after is the rest of the minute."""
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    log = log.withColumn("bucket", F.floor(seconds / 60))
    n = F.row_number().over(Window.partitionBy(service, "bucket").orderBy(ts, order))
    return log.withColumn("n", n).withColumn("rejected", F.col("n") > rpm).withColumn("retry_after", F.when(F.col("rejected"), 60 - seconds % 60))


def usage(log: DataFrame, service: str = "service_id", ts: str = "ts") -> DataFrame:
    """Requests per service and minute."""
    return log.groupBy(service, F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 60).alias("bucket")).agg(F.count(F.lit(1)).alias("requests"))


def lockouts(failures: DataFrame, user: str, ts: str = "ts", limit: int = LOCKOUT_FAILURES, seconds: int = LOCKOUT_SECONDS) -> DataFrame:
    """recent: failures in the last ``seconds`` (strictly less), this one included; locked once they reach limit.

    Time is cut into buckets of ``seconds``, and each bucket is given the one before it as well, which together hold every window that ends in it. Within a bucket two running
    counts are subtracted: a frame that moves at both ends is counted anew for each row, and a user's whole record would be one task. Rows without a time count each other.
    """
    width = seconds * 1_000_000
    df = failures.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")))
    df = df.withColumn("__bucket", F.expr(f"(__us - pmod(__us, {width}L)) div {width}L"))
    own = df.withColumn("__own", F.lit(True))
    past = df.filter("__us IS NOT NULL").select(F.col(user), "__us", (F.col("__bucket") + 1).alias("__bucket"), F.lit(False).alias("__own"))
    w = Window.partitionBy(user, "__bucket").orderBy("__us")
    n = F.count(F.lit(1))
    upto, gone = n.over(w.rangeBetween(Window.unboundedPreceding, 0)), n.over(w.rangeBetween(Window.unboundedPreceding, -width))
    both = own.unionByName(past, allowMissingColumns=True).withColumn("recent", F.when(F.col("__us").isNull(), upto).otherwise(upto - gone)).filter("__own")
    return both.withColumn("locked", F.col("recent") >= limit).drop("__us", "__bucket", "__own")


def lockouts_cleared(attempts: DataFrame, user: str, success: Column, ts: str = "ts", order: str = "seq", limit: int = LOCKOUT_FAILURES, seconds: int = LOCKOUT_SECONDS) -> DataFrame:
    """recent: failures in the last ``seconds`` since the user's last success, this attempt included; locked: whether they block the next one.

    A success clears what came before it: successes cut a user's attempts into segments, and the window runs within a segment. Null users share one record, as a name does.
    """
    df = attempts.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__ok", F.coalesce(success, F.lit(False)).cast("int"))
    df = df.withColumn("__segment", F.sum("__ok").over(Window.partitionBy(user).orderBy("__us", order).rowsBetween(Window.unboundedPreceding, 0)))
    # The window takes the rows before by time and place, so that attempts of one instant count in their order.
    place = F.row_number().over(Window.partitionBy(user, "__segment").orderBy("__us", order))
    df = df.withColumn("__at", F.sum(1 - F.col("__ok")).over(Window.partitionBy(user, "__segment").orderBy("__us", order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__place", place)
    gone = F.coalesce(F.max("__at").over(Window.partitionBy(user, "__segment").orderBy("__us").rangeBetween(Window.unboundedPreceding, -seconds * 1_000_000)), F.lit(0))
    df = df.withColumn("recent", F.col("__at") - gone)
    return df.withColumn("locked", F.col("recent") >= limit).drop("__us", "__ok", "__segment", "__at", "__place")


def pending_before(outcomes: DataFrame) -> DataFrame:
    """seq, pending: jobs of the request's service that were accepted before it and had not ended. outcomes: service_id, seq, outcome, job_seq, as fold() gives them."""
    began = outcomes.filter("outcome = 'accepted'").select("service_id", F.col("seq").alias("job"))
    ended = outcomes.filter("outcome IN ('succeeded', 'superseded', 'failed')").select("seq", F.col("job_seq").alias("job")).join(began, "job").select("service_id", "seq", F.lit(-1).alias("step"))
    asked = outcomes.filter("kind <> 'finish'").select("service_id", "seq", (F.col("outcome") == "accepted").cast("int").alias("step"))
    steps = asked.withColumn("asks", F.lit(True)).unionByName(ended.withColumn("asks", F.lit(False))).withColumn("__part", F.expr(f"seq div {PART}"))
    # Running sums by parts of a service, to which the sums of its earlier parts are added: no service is one task.
    sums = steps.groupBy("service_id", "__part").agg(F.sum("step").alias("__step"))
    earlier = Window.partitionBy("service_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("service_id").alias("__service"), F.col("__part").alias("__p"), F.coalesce(F.sum("__step").over(earlier), F.lit(0)).alias("__base"))
    before = Window.partitionBy("service_id", "__part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    within = steps.withColumn("__within", F.coalesce(F.sum("step").over(before), F.lit(0))).filter("asks")
    there = F.col("service_id").eqNullSafe(F.col("__service")) & F.col("__part").eqNullSafe(F.col("__p"))
    return within.join(base, there).select("seq", (F.col("__base") + F.col("__within")).alias("pending"))


def fold_capped(requests: DataFrame, cap: int = PENDING_CAP) -> DataFrame:
    """fold() with the queue's cap counted, not told: a request is refused while its service has ``cap`` jobs under way, over all its sources.

    Verdicts fold by source and counts run by service, so the two are brought to a fixed point: fold with the flags at hand, count each service's jobs from
    the outcomes, and fold again while a flag differs. A flag depends on earlier requests only, so every round settles at least the first request
    that was still wrong, and no result but the sequential one is fixed. Each round is a written table; services that never reach the cap settle in the first.
    """
    spark = requests.sparkSession
    path = new_path(spark, "capped")
    ship(spark)
    requests.drop("queue_full").write.parquet(f"{path}/requests")  # made once, not in each round
    requests = spark.read.schema(requests.drop("queue_full").schema).parquet(f"{path}/requests")
    flags, n = None, 0
    while True:
        told = requests.withColumn("queue_full", F.lit(False)) if flags is None else requests.join(flags, "seq", "left").withColumn("queue_full", F.coalesce("queue_full", F.lit(False)))
        n += 1
        fold(told, at_once=False).write.parquet(f"{path}/{n}")
        outcomes = spark.read.schema(OUTCOME).parquet(f"{path}/{n}")
        counted = pending_before(outcomes).select("seq", (F.col("pending") >= cap).alias("full"))
        wrong = outcomes.filter("kind <> 'finish'").select("seq", "queue_full").join(counted, "seq").filter("queue_full <> full")
        if wrong.isEmpty():
            return outcomes
        counted.filter("full").select("seq", F.col("full").alias("queue_full")).write.parquet(f"{path}/flags{n}")
        flags = spark.read.parquet(f"{path}/flags{n}")


def pending_full(jobs: DataFrame, cap: int = PENDING_CAP) -> DataFrame:
    """Pending jobs per service, and whether the next is refused."""
    return jobs.filter(F.col("status").isin("queued", "running")).groupBy("service_id").agg(F.count(F.lit(1)).alias("pending")).withColumn("full", F.col("pending") >= cap)


def claim(jobs: DataFrame, now: Column, n: int = 1, lease: int = LEASE_SECONDS) -> DataFrame:
    """The oldest queued jobs, and running ones whose lease has expired."""
    open_ = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_until") < now))
    return jobs.filter(open_).orderBy("created_at", "seq").limit(n).withColumn("status", F.lit("running")).withColumn("lease_until", now + lease)


def finish(job_revision: Column, current_revision: Column) -> Column:
    return F.when(job_revision == current_revision, "succeeded").otherwise("superseded")


def interrupted(jobs: DataFrame) -> DataFrame:
    """At a start, jobs that were under way are interrupted."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "interrupted").otherwise(F.col("status")))


def rebuild_jobs(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Jobs whose versions a rebuild keeps: active and not deleted (disabled ones survive)."""
    live = sources.filter("NOT deleted").select(F.col("active_job").alias("seq"))
    return jobs.join(live, "seq")


def active_jobs(sources: DataFrame) -> DataFrame:
    return sources.filter("enabled AND NOT deleted AND active_job IS NOT NULL")


def latest_active(jobs: DataFrame) -> DataFrame:
    """Of each corpus, its newest job that is queued or running."""
    return latest_by(jobs.filter(F.col("status").isin("queued", "running")), "corpus_id")


def recent(events: DataFrame, n: int, order: str = "seq") -> DataFrame:
    return events.orderBy(F.col(order).desc()).limit(n)


def latest_by(events: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Last write wins."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), order).alias("s")).select(key, "s.*")


def allowed(tokens: DataFrame, corpora: DataFrame, operation: str = "search") -> DataFrame:
    """Published corpora that each active token may use; managed corpora belong to the managed service alone.

    tokens: token_id, service_id, active, grants map<string,array<string>>.
    """
    each = tokens.filter("active").select("token_id", "service_id", F.explode("grants").alias("corpus_id", "operations")).filter(F.array_contains("operations", operation))
    domain = (F.col("kind") == "easyflow") == (F.col("service_id") == "easyflow")
    return each.join(corpora.filter(F.col("status") == "published"), "corpus_id").filter(domain)

"""Index jobs and the audit log: append-only tables on the driver's side, one job for each corpus at a time."""

from __future__ import annotations

import json
import logging
import threading
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import ledger
from docloom.sources.store import Files

# Fixed values.
STRIDE = 10
KINDS = ("incremental", "rebuild")

JOB = "seq long, job_id long, corpus_id string, kind string, status string, done long, total long, stats string, error string, actor string, at string"
AUDIT = "seq long, actor string, action string, target string, detail string, at string"
log = logging.getLogger(__name__)


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


class Log:
    """Rows with increasing seq, one writer."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema, self.files, self.lock, self.last = spark, path, schema, Files(spark, path), threading.Lock(), None

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path) if self.files.names(self.path) else self.spark.createDataFrame([], self.schema)

    def append(self, **row) -> int:
        with self.lock:
            if self.last is None:
                self.last = self.table().agg({"seq": "max"}).first()[0] or 0
            row["seq"] = seq = self.last + 1
            names = [x.split()[0] for x in self.schema.split(", ")]
            self.spark.createDataFrame([tuple(row.get(n) for n in names)], self.schema).coalesce(1).write.mode("append").parquet(self.path)
            self.last = seq
            return seq

    def append_all(self, rows: DataFrame, order: str) -> int:
        """All rows of a table in one write, numbered by order; returns how many."""
        with self.lock:
            if self.last is None:
                self.last = self.table().agg({"seq": "max"}).first()[0] or 0
            names = [x.split()[0] for x in self.schema.split(", ")]
            before = self.last
            numbered = rows.withColumn("seq", (F.row_number().over(Window.orderBy(order)) + before).cast("long")).select(*names)
            numbered.coalesce(1).write.mode("append").parquet(self.path)
            self.last = self.table().agg({"seq": "max"}).first()[0] or 0
            return self.last - before


class Audit:
    def __init__(self, spark: SparkSession, root: str):
        self.log = Log(spark, f"{root.rstrip('/')}/audit", AUDIT)

    def record(self, actor: str | None, action: str, target: str | None = None, **detail) -> None:
        """A failure to log never stops the work that is logged."""
        try:
            self.log.append(actor=actor, action=action, target=target, detail=json.dumps(detail, ensure_ascii=False) if detail else None, at=now())
        except Exception:
            log.exception("audit row lost: %s", action)

    def recent(self, n: int = 50) -> DataFrame:
        return ledger.recent(self.log.table(), n)


class JobError(RuntimeError):
    pass


class Jobs:
    """Runs index jobs, one after the other; work(corpus_id, kind, progress) -> statistics reads the corpus' settings when it starts."""

    def __init__(self, spark: SparkSession, root: str, work: Callable[[str, str, Callable[[int, int], None]], dict]):
        self.log, self.audit, self.work = Log(spark, f"{root.rstrip('/')}/jobs", JOB), Audit(spark, root), work

    def table(self) -> DataFrame:
        """Each job's last row."""
        return ledger.latest_by(self.log.table(), "job_id")

    def interrupt(self) -> int:
        """At a start: jobs that were under way are interrupted. Returns how many."""
        open_ = self.table().filter("status IN ('queued', 'running')").collect()
        for r in open_:
            self.log.append(**(r.asDict() | {"status": "interrupted", "at": now()}))
        return len(open_)

    def submit(self, corpus_id: str, kind: str, actor: str | None = None) -> int:
        if kind not in KINDS:
            raise JobError("kind")
        if ledger.latest_active(self.table()).filter(f"corpus_id = '{corpus_id}'").limit(1).count():
            raise JobError("a job of this corpus is under way")
        job = (self.log.last or self.log.table().agg({"seq": "max"}).first()[0] or 0) + 1
        self.log.append(job_id=job, corpus_id=corpus_id, kind=kind, status="queued", done=0, total=0, actor=actor, at=now())
        self.audit.record(actor, f"job.{kind}.started", corpus_id, job_id=job)
        return job

    def run(self, job: int) -> str:
        """Do a queued job; returns its last state."""
        row = self.table().filter(f"job_id = {job} AND status = 'queued'").first()
        if row is None:
            raise JobError("no such job in the queue")
        with Run(self, row) as this:
            this.outcome = {"status": "succeeded", "stats": self.work(row["corpus_id"], row["kind"], this.report)}
        return this.outcome["status"]


def steps(done: int, total: int, stride: int = STRIDE) -> int:
    """How many progress rows are due when documents 0 to done have been seen: one for each whole stride, and one for the end."""
    return (done + 1) // stride + (done >= total)


class Run:
    """The states of one job while it runs. An exception inside the block becomes the job's outcome and goes no further."""

    def __init__(self, jobs: Jobs, row):
        self.jobs, self.row, self.shown, self.outcome = jobs, row, 0, {}

    def state(self, **fields) -> None:
        self.jobs.log.append(**{k: self.row[k] for k in ("job_id", "corpus_id", "kind", "actor")}, at=now(), **({"done": 0, "total": 0} | fields))

    def report(self, done: int, total: int) -> None:
        due = steps(done, total)
        if due > self.shown:
            self.state(status="running", done=done, total=total)
        self.shown = max(due, self.shown)

    def __enter__(self) -> Run:
        self.state(status="running")
        return self

    def __exit__(self, kind, error, trace) -> bool:
        if error is not None and not isinstance(error, Exception):
            return False
        if error is not None:
            self.outcome = {"status": "failed", "error": f"{kind.__name__}: {error}"}
        told = self.outcome.get("stats") or {"error": self.outcome.get("error")}
        self.jobs.audit.record(self.row["actor"], f"job.{self.row['kind']}.{self.outcome['status']}", self.row["corpus_id"], job_id=self.row["job_id"], **told)
        self.state(**(self.outcome | {"stats": json.dumps(self.outcome.get("stats", {}))}))
        return True

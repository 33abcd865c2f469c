"""Managed sources: claimed jobs become chunks of a collection, in one plan for a batch of jobs and one snapshot.

A job that fails leaves nothing behind but the class name of its error; jobs beside it go on, and the version before keeps serving.
A batch that runs again after a crash writes the same chunk ids over the ones that are there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.chunking import with_page_chunks
from docloom.functions.embedding import Embedder, embedded_or_error
from docloom.operators import ledger
from docloom.operators.kinds import MANAGED
from docloom.scratch import new_path
from docloom.shipping import ship
from docloom.sources.store import ChunkStore

JOB = "job string, source_id string, kind string, revision long, source_version_id string, title string, payload_hash string, pages array<struct<page:int,text:string>>"
EMPTY = "ValueError"  # what a document without any chunk fails with


def version_hash(title: Column, pages: Column) -> Column:
    """Of title and pages as JSON with sorted keys: what makes a version immutable."""

    @F.pandas_udf("string")
    def digest(titles: pd.Series, all_pages: pd.Series) -> pd.Series:
        import hashlib

        plain = lambda ps: [{"page": int(p["page"]), "text": p["text"]} for p in ps]
        return pd.Series([hashlib.sha256(json.dumps({"title": t, "pages": plain(ps)}, sort_keys=True, ensure_ascii=False).encode()).hexdigest() for t, ps in zip(titles, all_pages, strict=True)])

    return digest(title, pages)


def _path(corpus: str, source_id: Column) -> Column:
    return X.source_path(F.lit(corpus), F.concat(source_id, F.lit(".md")))


def job_chunks(jobs: DataFrame, corpus: str, embedder: Embedder, prefix: str = "", **sizes: int) -> DataFrame:
    """The chunks of index jobs (JOB), with error where embedding failed. Ids and counts run over the whole document; no chunk spans pages."""
    ship(jobs.sparkSession)
    cut = with_page_chunks(jobs.filter("kind = 'index'"), "pages", **sizes)
    made = cut.withColumn("__e", embedded_or_error(MANAGED.embed_text(F.col("document")), embedder, prefix))
    return made.select(
        X.chunk_id(F.col("job"), F.col("chunk_index")).alias("chunk_id"), _path(corpus, F.col("source_id")).alias("source_path"),
        "chunk_index", "n_chunks", F.col("payload_hash").alias("content_hash"), "document", "__e.embedding", "title", "source_id", "source_version_id",
        F.col("job").alias("operation_id"), "revision", "page", "anchor", "__e.error",
    )


def process(jobs: DataFrame, states: DataFrame, store: ChunkStore, collection: str, corpus: str, embedder: Embedder, prefix: str = "", folder: str | None = None, **sizes: int) -> DataFrame:
    """Run claimed jobs: job, source_id, kind, revision, state (succeeded, superseded or failed), error.

    states: source_id, revision, the newest accepted revision of each source. A job of an older one is superseded and leaves no chunks. Succeeded index jobs
    replace their source's older revisions, deletes remove the source's chunks up to their own; all of it is published as one snapshot.
    """
    spark = jobs.sparkSession
    staged = new_path(spark, "job_chunks")
    # Written once: a lost executor does not embed again, and what is judged is what is published.
    job_chunks(jobs, corpus, embedder, prefix, **sizes).write.parquet(staged)
    made = spark.read.parquet(staged)
    try:
        told = made.groupBy(F.col("operation_id").alias("job")).agg(F.count(F.lit(1)).alias("n"), F.min("error").alias("error"))
        error = F.when((F.col("kind") == "index") & F.col("n").isNull(), EMPTY).when(F.col("kind") == "index", F.col("error"))
        now = states.select("source_id", F.col("revision").alias("current"))
        state = F.when(error.isNotNull(), "failed").otherwise(ledger.finish(F.col("revision"), F.coalesce("current", F.lit(-1))))
        ended = jobs.drop("pages").join(told, "job", "left").join(now, "source_id", "left").select("job", "source_id", "kind", "revision", state.alias("state"), error.alias("error"))
        ended = spark.createDataFrame(ended.collect(), ended.schema)  # a batch of claimed jobs, bounded by the queue's cap
        good = ended.filter("state = 'succeeded'")
        keep = made.join(good.select(F.col("job").alias("operation_id")), "operation_id", "left_semi").drop("error")
        cleared = good.filter("kind IN ('index', 'delete')").groupBy("source_id").agg(F.max(F.when(F.col("kind") == "index", F.col("revision") - 1).otherwise(F.col("revision"))).alias("__upto"))
        since = store.current(collection)
        touched = store.touched(collection, cleared.select(_path(corpus, F.col("source_id")).alias("source_path")))

        def replaced(fresh: DataFrame | None) -> DataFrame:
            old = store.located(collection, since, touched).join(F.broadcast(cleared), "source_id", "left")  # one row for each claimed job at most
            stale = F.coalesce("revision", F.lit(-1)) <= F.col("__upto")
            again = keep.select("chunk_id", F.lit(True).alias("__again")).distinct()
            return old.join(again, "chunk_id", "left").filter(stale | F.col("__again"))

        if touched:
            store.change(collection, keep, replaced, since)
        if folder:
            files = jobs.join(good.select("job"), "job", "left_semi")
            write_documents(files.filter("kind = 'index'"), folder).count()
            for r in good.filter("kind = 'delete'").select("source_id").collect():
                for suffix in (".md", ".json"):
                    store.files.delete(f"{folder}/{r['source_id']}{suffix}")
        return ended
    finally:
        store.files.delete(staged)


def write_documents(jobs: DataFrame, folder: str) -> DataFrame:
    """Write <source_id>.md and .json of each job to folder, a URI; returns the paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            paths = []
            for r in b.to_pylist():
                side = {k: r[k] for k in ("source_id", "source_version_id", "title", "revision", "pages")} | {"operation_id": r["job"]}
                for suffix, body in ((".md", r["markdown"]), (".json", json.dumps(side, ensure_ascii=False))):
                    path = f"{root}/{r['source_id']}{suffix}"
                    with fs.open_output_stream(path) as out:
                        out.write(body.encode())
                    paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    ship(jobs.sparkSession)
    return jobs.withColumn("markdown", X.pages_markdown(F.col("pages"))).mapInArrow(run, "path string")


def rebuild(jobs: DataFrame, states: DataFrame, store: ChunkStore, target: str, corpus: str, embedder: Embedder, prefix: str = "", **sizes: int) -> dict:
    """Embed the active versions again into target; disabled sources stay in, deleted ones do not. states: active_job, deleted."""
    live = states.filter("NOT deleted AND active_job IS NOT NULL").select(F.col("active_job").alias("job"))
    active = jobs.join(live, "job", "left_semi")
    made = job_chunks(active, corpus, embedder, prefix, **sizes)
    store.write(target, made.withColumn("embedding", F.when(F.col("error").isNull(), F.col("embedding")).otherwise(F.raise_error(F.col("error")).cast("array<float>"))).drop("error"))
    total = store.count(target)
    return {"indexed": active.count(), "skipped": 0, "failed": 0, "total_chunks": total, "embedded_chunks": total, "reused": 0, "lfs_pointer": 0}

"""Building a collection from parsed documents: incremental by content hash, and rebuilt under a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.chunking import HINT, OVERLAP, SIZE, with_chunks
from docloom.functions.embedding import Embedder, EmbeddingUnavailable, embedded_or_error
from docloom.operators.kinds import Kind
from docloom.scratch import new_path
from docloom.sources.store import ChunkStore


class RebuildError(RuntimeError):
    pass


def changes(docs: DataFrame, existing: DataFrame) -> DataFrame:
    """docs with change: new, reuse or replace, by the hash of the document's first chunk; skipped documents have none."""
    first = existing.groupBy("source_path").agg(F.min_by("content_hash", "chunk_index").alias("__old"), F.count(F.lit(1)).alias("__old_chunks"))
    change = F.when(F.col("__old").isNull(), "new").when(F.col("__old") == F.col("content_hash"), "reuse").otherwise("replace")
    return docs.join(first, "source_path", "left").withColumn("change", F.when(F.col("status") == "ok", change)).withColumnRenamed("__old_chunks", "old_chunks").drop("__old")


def statistics(changed: DataFrame, chunks: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row: indexed, skipped, failed, total_chunks, embedded_chunks, reused, lfs_pointer. failed: source_path of documents that could not be embedded; they are not indexed."""
    lost = F.lit(False)
    if failed is not None:
        changed = changed.join(failed.select("source_path", F.lit(True).alias("__lost")).distinct(), "source_path", "left")
        lost = F.coalesce("__lost", F.lit(False))
    docs = changed.agg(
        F.count_if((F.col("status") == "ok") & ~lost).alias("indexed"),
        F.count_if(F.col("status") != "ok").alias("skipped"),
        F.count_if(lost).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("change") == "reuse", F.col("old_chunks"))), F.lit(0)).alias("reused_chunks"),
        F.count_if(F.col("change") == "reuse").alias("reused"),
        F.count_if(F.col("status") == "lfs_pointer").alias("lfs_pointer"),
    )
    made = chunks.agg(F.count(F.lit(1)).alias("embedded_chunks"))
    both = docs.crossJoin(F.broadcast(made))  # one row each
    return both.select("indexed", "skipped", "failed", (F.col("reused_chunks") + F.col("embedded_chunks")).alias("total_chunks"), "embedded_chunks", "reused", "lfs_pointer")


def new_chunks(docs: DataFrame, kind: Kind, embedder: Embedder, prefix: str = "", size: int = SIZE, overlap: int = OVERLAP, hint: int = HINT) -> DataFrame:
    cut = with_chunks(docs, "text", size=size, overlap=overlap, hint=hint).withColumn("chunk_id", X.chunk_id(F.col("source_path"), F.col("chunk_index")))
    made = cut.withColumn("__e", embedded_or_error(kind.embed_text(F.col("document")), embedder, prefix))
    return made.withColumn("embedding", F.col("__e.embedding")).withColumn("error", F.col("__e.error")).drop("__e")


def build_index(docs: DataFrame, store: ChunkStore, collection: str, kind: Kind, embedder: Embedder, prefix: str = "", reset: bool = False, **sizes: int) -> dict:
    """Chunk and embed only new and changed documents, publish one snapshot, and return the statistics.

    The chunks are written to the shared folder first, each with its error if embedding failed, and everything else reads that table. A document with a chunk that failed is counted
    as failed and nothing of it is published; what the collection held of it stays, and the next run tries it again, as it tries all that is new or changed. If every document
    failed and none is reused, the service is taken to be down: EmbeddingUnavailable is raised and nothing is published. Chunks of files that vanished or that are skipped now stay, as orphans() shows.
    """
    spark = docs.sparkSession
    since = store.current(collection)
    new = reset or since is None
    existing = store.read(collection, [] if new else None)
    staged = new_path(spark, "index")
    try:
        changes(docs, existing).write.parquet(f"{staged}/documents")
        changed = spark.read.parquet(f"{staged}/documents")
        todo = changed.filter(F.col("change").isin("new", "replace"))
        new_chunks(todo, kind, embedder, prefix, **sizes).write.parquet(f"{staged}/chunks")
        made = spark.read.parquet(f"{staged}/chunks")
        failed = made.filter("error IS NOT NULL").select("source_path").distinct()
        good = made.join(failed, "source_path", "left_anti")
        stats = statistics(changed, good, failed).first().asDict()
        if stats["failed"] and not stats["embedded_chunks"] and not stats["reused"]:
            raise EmbeddingUnavailable("no document could be embedded")
        good = good.select(*[c for c in existing.columns if c in made.columns])
        if new:
            store.write(collection, good, None, since)
        else:
            store.replace_documents(collection, todo.select("source_path").join(failed, "source_path", "left_anti"), good, since)
    finally:
        store.files.delete(staged)
    return stats


def rebuild(docs: DataFrame, store: ChunkStore, active: str, kind: Kind, embedder: Embedder, prefix: str = "", keep: int = 1, **sizes: int) -> tuple[str, dict]:
    """Build the next version beside the active one; only a build with chunks takes over. Returns (active collection, statistics)."""
    base, _, version = active.rpartition("_v")
    target = f"{base}_v{int(version) + 1}" if base and version.isdigit() else f"{active}_v2"
    try:
        stats = build_index(docs, store, target, kind, embedder, prefix, reset=True, **sizes)
    except Exception:
        store.drop(target)
        raise
    if not store.count(target):
        store.drop(target)
        raise RebuildError("the new version has no chunks")
    store.prune(target.rpartition("_v")[0], target, keep)
    return target, stats

"""Filtered cosine top-k over chunks, aggregated to ranked documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions.embedding import Embedder, embed_query
from docloom.operators.kinds import Kind

# Fixed values.
OVERFETCH = 5
MAX_QUERY_CHARS = 10_000
MAX_TOP_K = 50
MAX_QUERIES = 10_000  # vectors, about, that a batch search broadcasts at a time
ROWS = 1_000  # chunks that a batch search multiplies at a time


def cosine_distance(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return 1 - F.when(size > 0, dot / size).otherwise(0.0)


def literal_vector(vector: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, vector))), ",").cast("array<double>")


def top_chunks(chunks: DataFrame, query: Column, k: int, id_col: str = "chunk_id", where: Column | None = None) -> DataFrame:
    """The k nearest chunks with distance and rank from 1; the filter runs before the limit."""
    if where is not None:
        chunks = chunks.filter(where)
    near = chunks.withColumn("distance", cosine_distance(F.col("embedding"), query)).orderBy("distance", id_col).limit(k)
    return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))


def rank_documents(hits: DataFrame, top_k: int, doc_col: str = "source_path", keep: tuple[str, ...] = (), length_c: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Hits (distance, rank, n_chunks) to documents: best similarity, mean over the hits as tie-breaker, first hit's rank last."""
    sim = X.similarity(F.col("distance"))
    first = F.struct(-sim, F.col("rank"))
    docs = hits.groupBy(*by, doc_col).agg(
        F.max(sim).alias("best"),
        F.avg(sim).alias("mean"),
        F.min("rank").alias("first_rank"),
        F.min_by("n_chunks", "rank").alias("n_chunks"),
        F.count(F.lit(1)).alias("hits"),
        *(F.min_by(c, first).alias(c) for c in keep),
    )
    docs = docs.withColumn("similarity", X.round4(X.length_score(F.col("best"), F.col("n_chunks"), length_c)))
    order = [F.col("similarity").desc(), F.col("mean").desc(), F.col("first_rank")]
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return docs.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= top_k)


def check_request(query: str, top_k: int) -> str:
    query = query.strip()
    if not query or len(query) > MAX_QUERY_CHARS:
        raise ValueError("query")
    if not 1 <= top_k <= MAX_TOP_K:
        raise ValueError("top_k")
    return query


def search(chunks: DataFrame, kind: Kind, embedder: Embedder, query: str, top_k: int = 5, options: dict | None = None, query_prefix: str = "", length_c: float = 0.0, active_operations: list[str] | DataFrame | None = None, still_active: Callable[[], DataFrame] | None = None) -> DataFrame:
    """document_id, title, source_path, similarity, snippet, metadata (public fields), position. May hold fewer than top_k.

    active_operations: the operations whose chunks are visible, a short list or a table with a column operation_id. still_active reads such a table anew
    once the hits are chosen: hits of operations that ended in between drop out, and nothing moves up in their place.
    """
    query = check_request(query, top_k)
    where = kind.where(options or {})
    visible = active_operations.select("operation_id") if isinstance(active_operations, DataFrame) else None
    if visible is not None:
        chunks = chunks.join(visible, "operation_id", "left_semi")
    elif active_operations is not None:
        live = F.col("operation_id").isin(active_operations)
        where = live if where is None else where & live
    if visible.isEmpty() if visible is not None else active_operations == []:
        chunks, vector = chunks.limit(0), [0.0]  # nothing is visible: no embedding call
    else:
        vector = embed_query(embedder, query, query_prefix)
    hits = top_chunks(chunks, literal_vector(vector), top_k * OVERFETCH, where=where)
    if still_active is not None:
        chosen = hits.collect()  # the limit bounds them; what is read afterwards is newer than they are
        hits = chunks.sparkSession.createDataFrame(chosen, hits.schema).join(still_active().select("operation_id"), "operation_id", "left_semi")
    fields = tuple(c for c in kind.metadata if c in chunks.columns)
    docs = rank_documents(hits, top_k, keep=("document", *fields), length_c=length_c)
    return docs.select(
        X.public_id(F.col("source_path")).alias("document_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        "source_path",
        "similarity",
        X.snippet(F.col("document")).alias("snippet"),
        kind.public_struct(docs.columns).alias("metadata"),
        "position",
    )


def top_chunks_batch(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", query_id: str = "query_id") -> DataFrame:
    """Many queries: one matrix product for each Arrow batch, k best of each task, then k best overall.

    The queries are collected and broadcast in blocks of about MAX_QUERIES, by a hash of the id.
    """
    blocks = max(1, -(-queries.count() // MAX_QUERIES))
    part = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    return reduce(DataFrame.unionByName, (_top_block(chunks, queries.filter(part == i), k, id_col, query_id) for i in range(blocks)))


def _top_block(chunks: DataFrame, queries: DataFrame, k: int, id_col: str, query_id: str) -> DataFrame:
    rows = queries.select(query_id, "embedding").collect()
    ids = [r[0] for r in rows]
    unit = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1)
    norms = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = np.divide(unit, norms, out=np.zeros_like(unit), where=norms > 0)
    shared = chunks.sparkSession.sparkContext.broadcast((ids, unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = shared.value
        if not ids:
            return
        best_d, best_i = [np.empty(0)] * len(ids), [np.empty(0, np.int64)] * len(ids)
        for b in (x.slice(i, ROWS) for x in batches for i in range(0, x.num_rows, ROWS)):
            key = b.column(0).to_numpy(zero_copy_only=False)
            m = np.array(b.column(1).to_pylist(), dtype=np.float64).reshape(len(key), -1)
            size = np.linalg.norm(m, axis=1, keepdims=True)
            d = 1 - np.divide(m, size, out=np.zeros_like(m), where=size > 0) @ unit.T
            for q in range(len(ids)):
                dist, at = np.concatenate([best_d[q], d[:, q]]), np.concatenate([best_i[q], key])
                order = np.lexsort((at, dist))[:k]
                best_d[q], best_i[q] = dist[order], at[order]
        n = [len(x) for x in best_i]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, dtype=np.int64), n)), pa.array(np.concatenate(best_i)), pa.array(np.concatenate(best_d))], ["query_id", id_col, "distance"])

    near = chunks.select(F.col(id_col).cast("long").alias(id_col), "embedding").mapInArrow(run, f"query_id long, {id_col} long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

"""Nearest chunks through an inverted file: chunks lie by cells of near vectors, and a query reads the cells nearest to it.

Cells are fitted by spherical k-means on a bounded sample (``sample`` vectors, picked by a hash of the id); every chunk is then assigned to its nearest cell in one pass
and written to the cell's partition, its vector scaled to length 1. A query ranks all cells by their centres, which are few, and reads only the partitions of the nearest
ones; filters run before the cut, and the cosine of every chunk read is exact. How many cells to read is measured when the index is built: queries from the sample are answered
by an exact scan of all chunks, and the fewest cells that hold ``recall`` of their answers are kept as the index's own number. On vectors without any
structure that number is large, and it is stored, not assumed. A query whose cells hold fewer than k chunks that pass the filter is answered by the exact scan of all cells.

Many queries at once are dealt to (cell, piece) groups, as chunks are: a group holds a bounded number of chunks and of queries, multiplies
them, and sends each query's k best on.

Layout: ``<path>/cells`` (partitions cell=<n>), ``<path>/centres`` (cell, centre, chunks, probes, dim), ``<path>/schema``. An index is built in a new folder and never changed: a new one is built beside it.
Vectors that are null, of another length than the sample's, zero, or hold null or non-finite components are in cell -1, which no query but an exact scan with their ids
reads; an exact scan of zero vectors has no meaning, so they are never found.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom.scratch import new_path
from docloom.shipping import ship

SAMPLE = 20_000  # vectors that cells are fitted on, about
PROBED = 200  # queries, about, that the number of cells to read is measured with
RECALL = 0.95
ROUNDS = 8
PIECE_ROWS, PIECE_QUERIES = 20_000, 500  # of a group: about 10 MB of vectors of 64 components, and 10 million products
ROWS = 5_000
NOWHERE = -1


def _with(fields: list[T.StructField], **more: T.DataType) -> T.StructType:
    return T.StructType([*fields, *(T.StructField(n, t) for n, t in more.items())])


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the sound vectors of this length."""
    size = pc.fill_null(pc.list_value_length(column), NOWHERE).to_numpy(zero_copy_only=False)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
    at = np.flatnonzero(size == dim)
    m = flat[start[at][:, None].astype(np.int64) + np.arange(dim)]
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], m[good] / norm[good, None]


def fit_cells(unit: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of at most so many cells, from evenly spaced vectors of the sample."""
    centres = unit[np.arange(cells) * len(unit) // cells]
    for _ in range(rounds):
        at = np.concatenate([(unit[i : i + ROWS] @ centres.T).argmax(1) for i in range(0, len(unit), ROWS)])
        sums = np.zeros_like(centres)
        np.add.at(sums, at, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def _sampled(chunks: DataFrame, id_col: str, vector_col: str, most: int) -> np.ndarray:
    """Unit vectors of about ``most`` chunks of the commonest length, picked by a hash of the id."""
    total = chunks.count()
    lowest = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) < int(min(1.0, most / max(total, 1)) * (1 << 30))
    column = chunks.filter(lowest & F.col(vector_col).isNotNull()).select(F.col(vector_col).alias("v")).limit(2 * most).toArrow().column(0).combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return np.empty((0, 0))
    n, count = np.unique(sizes, return_counts=True)
    return unit_rows(column, int(n[count.argmax()]))[1]


class IvfIndex:
    """An index at a path; ``build`` makes one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # one row for each cell
        self.centres = np.array([r["centre"] for r in rows], float).reshape(len(rows), rows[0]["dim"] if rows else 0)
        self.chunks = {r["cell"]: r["chunks"] for r in rows}
        self.probes, self.dim = (rows[0]["probes"], rows[0]["dim"]) if rows else (0, 0)
        schema = T.StructType.fromJson(json.loads(spark.read.parquet(f"{self.path}/schema").first()[0]))
        self.cells = spark.read.schema(schema).parquet(f"{self.path}/cells")

    @classmethod
    def build(cls, chunks: DataFrame, path: str, id_col: str = "chunk_id", vector_col: str = "embedding", cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL, k: int = 5) -> IvfIndex:
        """Columns of chunks are kept beside ``unit`` (array<float>), so that filters can use them. cells: the square root of the number of chunks unless given, but at most a tenth of the sample."""
        spark = chunks.sparkSession
        ship(spark)
        path = path.rstrip("/")
        unit = _sampled(chunks, id_col, vector_col, sample)
        n = max(1, min(cells or round(math.sqrt(chunks.count())), max(1, len(unit) // 10)))
        centres = fit_cells(unit, n) if len(unit) else np.empty((0, 0))
        dim = unit.shape[1]
        shared = spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (x.slice(i, ROWS) for x in batches for i in range(0, x.num_rows, ROWS)):
                cell, scaled = np.full(b.num_rows, NOWHERE), [None] * b.num_rows
                if dim:
                    at, m = unit_rows(b.column(b.schema.get_field_index(vector_col)), dim)
                    cell[at] = (m @ shared.value.T).argmax(1) if len(at) else []
                    for i, row in zip(at.tolist(), m.astype(np.float32), strict=True):
                        scaled[i] = row
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scaled, pa.list_(pa.float32())), pa.array(cell, pa.int32())], [*b.schema.names, "unit", "cell"])

        schema = _with(chunks.schema.fields, unit=T.ArrayType(T.FloatType()), cell=T.IntegerType())
        placed = chunks.mapInArrow(assign, schema)
        # Rows of a cell meet in few files; a cell too large for one task is split.
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/cells")
        spark.createDataFrame([(schema.json(),)], "schema string").coalesce(1).write.parquet(f"{path}/schema")
        sizes = {r["cell"]: r["n"] for r in spark.read.schema(schema).parquet(f"{path}/cells").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        write = lambda probes: spark.createDataFrame([(i, c.tolist(), sizes.get(i, 0), probes, dim) for i, c in enumerate(centres)], "cell int, centre array<double>, chunks long, probes int, dim int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        write(len(centres))
        index = cls(spark, path)
        probes = index._measured(chunks.select(id_col, vector_col), id_col, vector_col, unit[:: max(1, len(unit) // PROBED)], recall, k) if len(centres) > 1 else len(centres)
        write(probes)
        return cls(spark, path)

    def _measured(self, chunks: DataFrame, id_col: str, vector_col: str, queries: np.ndarray, recall: float, k: int) -> int:
        """The fewest cells that hold this share of the exact answers."""
        asked = self.spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "query_id long, embedding array<double>")
        found = self.search_batch(asked, k, id_col, probes=len(self.centres), keep=("cell",)).select("query_id", "cell").collect()  # k rows for each sampled query
        order = np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
        need = np.sort([place[r["query_id"], r["cell"]] for r in found])
        return int(need[max(0, math.ceil(recall * len(need)) - 1)]) + 1 if len(need) else len(self.centres)

    def nearest_cells(self, vector: list[float], probes: int | None = None) -> list[int]:
        return np.argsort(-(self.centres @ np.asarray(vector, float)), kind="stable")[: probes or self.probes].tolist()

    def _near(self, cells: list[int] | None, vector: list[float], k: int, id_col: str, where: Column | None) -> DataFrame:
        rows = self.cells.filter(F.col("cell").isin(cells) if cells is not None else F.col("cell") >= 0)
        if where is not None:
            rows = rows.filter(where)
        norm = math.sqrt(sum(x * x for x in vector)) or 1.0
        query = np.asarray(vector, float) / norm
        kept = [c for c in rows.columns if c != "unit"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The k nearest of each task, so that few rows leave it."""
            best = None
            for b in batches:
                m = b.column(b.schema.get_field_index("unit")).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                rest = pa.table([*(b.column(c) for c in kept), pa.array(1 - m.astype(np.float64) @ query)], names=[*kept, "distance"])
                best = rest if best is None else pa.concat_tables([best, rest])
                best = best.take(pc.select_k_unstable(best, k, [("distance", "ascending"), (id_col, "ascending")]))
            if best is not None:
                yield from best.combine_chunks().to_batches()

        schema = _with(rows.select(*kept).schema.fields, distance=T.DoubleType())
        near = rows.mapInArrow(run, schema).orderBy("distance", id_col).limit(k)
        return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)))

    def top_chunks(self, vector: list[float], k: int, id_col: str = "chunk_id", where: Column | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
        """Like search.top_chunks. exact, or too few chunks that pass the filter in the nearest cells: all cells are read."""
        ship(self.spark)
        if not exact and len(vector) == self.dim:
            near = self._near(self.nearest_cells(vector, probes), vector, k, id_col, where)
            rows = near.collect()  # k at most
            if len(rows) == k or (probes or self.probes) >= len(self.centres):
                return self.spark.createDataFrame(rows, near.schema)
        return self._near(None if len(vector) == self.dim else [], vector, k, id_col, where)

    def search_batch(self, queries: DataFrame, k: int, id_col: str = "chunk_id", query_id: str = "query_id", vector_col: str = "embedding", probes: int | None = None, where: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """query_id, the k nearest chunks' id, distance, rank and columns of keep, from the nearest cells of each query. Queries may be any number of rows.

        Queries whose cells hold fewer than k chunks that pass the filter are asked again of all cells.
        """
        first = self._from_cells(queries, k, id_col, query_id, vector_col, probes, where, keep)
        if (probes or self.probes) >= len(self.centres):
            return first
        path = new_path(self.spark, "hits")
        first.write.parquet(path)
        first = self.spark.read.parquet(path)
        full = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias(query_id))
        short = queries.join(full, query_id, "left_anti")
        if short.isEmpty():
            return first
        rest = self._from_cells(short, k, id_col, query_id, vector_col, len(self.centres), where, keep)
        return first.join(full.withColumnRenamed(query_id, "query_id"), "query_id", "left_semi").unionByName(rest)

    def _from_cells(self, queries: DataFrame, k: int, id_col: str, query_id: str, vector_col: str, probes: int | None, where: Column | None, keep: tuple[str, ...]) -> DataFrame:
        ship(self.spark)
        spark, dim, probes = self.spark, self.dim, min(probes or self.probes, max(1, len(self.centres)))
        shared = spark.sparkContext.broadcast(self.centres)
        # Of each cell: in how many pieces its chunks and its queries are dealt.
        pieces = spark.createDataFrame([(c, max(1, -(-n // PIECE_ROWS))) for c, n in self.chunks.items()] or [(NOWHERE, 1)], "cell int, pieces int")

        def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (x.slice(i, ROWS) for x in batches for i in range(0, x.num_rows, ROWS)):
                at, m = unit_rows(b.column(1), dim) if dim else (np.empty(0, np.int64), np.empty((0, 0)))
                if len(at):
                    cells = np.argsort(-(m @ shared.value.T), axis=1, kind="stable")[:, :probes]
                    again = np.repeat(np.arange(len(at)), cells.shape[1])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[again])), pa.array(cells.ravel(), pa.int32()), pa.array(list(m[again]), pa.list_(pa.float64()))], ["query_id", "cell", "q"])

        kind = queries.schema[query_id].dataType.simpleString()
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector_col)).mapInArrow(aimed, f"query_id {kind}, cell int, q array<double>")
        asked = asked.join(F.broadcast(pieces), "cell")  # a row for each cell, at most a tenth of the sample
        asked = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
        rows = self.cells.filter("cell >= 0")
        if where is not None:
            rows = rows.filter(where)
        rows = rows.select(F.col(id_col), "unit", "cell", *(c for c in keep if c != "cell")).join(F.broadcast(pieces), "cell")
        rows = rows.withColumn("piece", F.pmod(F.xxhash64(F.col(id_col)), F.col("pieces")).cast("int")).drop("pieces")
        own = [c for c in rows.columns if c not in ("unit", "piece")]

        def meet(chunks: pa.Table, asked: pa.Table) -> pa.Table:
            if not chunks.num_rows or not asked.num_rows:
                return empty
            m = chunks.column("unit").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(chunks.num_rows, -1).astype(np.float64)
            q = asked.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(asked.num_rows, -1)
            out, top = [], min(k, chunks.num_rows)
            for i in range(0, asked.num_rows, PIECE_QUERIES):
                d = 1 - q[i : i + PIECE_QUERIES] @ m.T
                at = np.argpartition(d, top - 1, axis=1)[:, :top]
                who = np.repeat(np.arange(len(d)), top)
                best = chunks.select(own).take(pa.array(at.ravel()))
                best = best.append_column("query_id", asked.column("query_id").slice(i, len(d)).take(pa.array(who)))
                out.append(best.append_column("distance", pa.array(d[who, at.ravel()])))
            return pa.concat_tables(out).select(names)

        schema = _with(rows.select(*own).schema.fields, query_id=asked.schema["query_id"].dataType, distance=T.DoubleType())
        names = schema.fieldNames()
        empty = to_arrow_schema(schema).empty_table()
        near = rows.groupBy("cell", "piece").cogroup(asked.groupBy("cell", "piece")).applyInArrow(meet, schema)
        w = Window.partitionBy("query_id").orderBy("distance", id_col)
        return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", id_col, "distance", "rank", *keep)

"""Near-duplicate vectors by random-hyperplane signs in several tables, exact cosines and connected components.

Only vectors of one label and length are compared. Equal vectors of a label are one class, with a weight. Each of L tables gives a class the signs of its dot products with B random
hyperplanes; classes with equal signs in a table share its bucket. B follows the number of classes of the largest label, so that unlike vectors seldom meet, and L follows B, so that at every size a pair of
exactly the least cosine is missed with the same probability (``miss``), nearer pairs with less. A few tables at a time are dealt out. Only buckets that several classes share are opened, found by counts of 64-bit codes of buckets, where a collision costs a comparison and nothing else: their vectors meet in tasks, sorted by bucket, and all pairs
of a bucket are compared by matrix products of doubles, without a row for a pair. A pair counts in the first table whose bucket it shares, which both signatures tell.
What leaves a task is each class's number of linked vectors and the edges of a spanning forest.

A bucket of more than ``block`` classes is dealt by hashes into blocks, and each pair of blocks is a group of its own. Links are counted by comparing all pairs of a bucket, so that
the work of a group of near, unequal copies grows with the square of its classes; copies that are equal cost nothing.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, and vectors without a label, link with nothing; -0.0 equals 0.0; null ids are never the smallest
unless alone, and are then kept; rows tied by id each have a row; classes rest on 128-bit hashes of label and vector; an empty table gives an empty one; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.running import starts
from docloom.llm.shared import discard, join_each, materialise
from docloom.llm.vectors import by_length, slices
from docloom.shipping import ship

MISS = 1e-5
AT_ONCE = 8  # tables whose buckets are dealt at a time: what is on disk at once does not grow with the number of tables
BLOCK = 1024
SMALL = 24  # groups up to this size are compared row by row
SEED = 20240229
ROWS = 2000


def plan(classes: int, least: float, miss: float = MISS) -> tuple[int, int]:
    """(signs in a table, tables) for so many classes."""
    bits = min(60, max(8, math.ceil(math.log2(max(2, classes))) + 4))
    meet = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-meet)))


def scaled(m: np.ndarray) -> np.ndarray:
    """Unit vectors. They are first scaled by powers of two, which is exact, so that no square leaves the range of doubles."""
    _, e = np.frexp(np.abs(m).max(1))
    m = np.ldexp(m, -e[:, None])
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, cls (null: links with nothing), label, v of every row."""
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    kind = named.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            labels, cls = b.column("label").to_pylist(), [None] * b.num_rows
            for at, m in by_length(b.column("v")):
                if m.shape[1]:
                    sound = np.isfinite(m).all(1) & (m != 0).any(1)
                    for i, row in zip(at[sound].tolist(), m[sound] + 0.0, strict=True):
                        if labels[i] is not None:
                            cls[i] = xxhash.xxh3_128_digest(f"{len(labels[i])}:{labels[i]}".encode("utf-8", "surrogatepass") + row.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.binary()), *b.columns[1:]], ["vec_id", "cls", "label", "v"])

    return named.mapInArrow(run, f"vec_id {named.schema['vec_id'].dataType.simpleString()}, cls binary, label string, v {kind}")


def _signed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """cls, label, dim, signs (a long for each table)."""
    place = (np.int64(1) << np.arange(bits, dtype=np.int64))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in slices(batches, ROWS):
            for at, m in by_length(b.column("v")):
                n = m.shape[1]
                if n not in planes:
                    planes[n] = np.random.default_rng([SEED, n]).standard_normal((n, tables * bits))
                signs = ((scaled(m) @ planes[n]) >= 0).reshape(len(m), tables, bits) @ place
                some = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([some.column("cls"), some.column("label"), pa.array(np.full(len(m), n)), pa.array(list(signs[:, :, 0]), pa.list_(pa.int64()))], ["cls", "label", "dim", "signs"])

    return classes.select("cls", "label", "v").mapInArrow(run, "cls binary, label string, dim long, signs array<long>")


BUCKET = ["label", "dim", "t", "sign"]
GROUP = [*BUCKET, "i", "j"]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches by links a-b."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        after = low.copy()
        np.minimum.at(after, a, m)
        np.minimum.at(after, b, m)
        after = after[after]
        if (after == low).all():
            return low
        low = after


def _compared(least: float):
    """An Arrow function over rows sorted by GROUP: cls, n (vectors linked with it), root (a class of the same component) of classes with links."""

    def linked(b: pa.RecordBatch) -> pa.RecordBatch | None:
        """For whole groups."""
        first = np.flatnonzero(starts(*(b.column(c) for c in GROUP)))
        sizes = np.diff([*first, b.num_rows])
        whole = lambda c: b.column(c).to_numpy(zero_copy_only=False)
        weight, t, side, cross = whole("weight"), whole("t"), whole("block"), whole("i") != whole("j")
        group = np.repeat(np.arange(len(first)), sizes)
        signs = b.column("signs").flatten().to_numpy().reshape(b.num_rows, -1)
        unit: list[np.ndarray | None] = [None] * b.num_rows
        for at, m in by_length(b.column("v")):
            for i, row in zip(at.tolist(), scaled(m), strict=True):
                unit[i] = row
        pairs = []

        def keep(x: np.ndarray, y: np.ndarray) -> None:
            """Pairs in reach: of two blocks where the group has two, and only if no earlier table has them together."""
            ok = ~cross[x] | (side[x] != side[y])
            x, y = x[ok], y[ok]
            for k in range(int(t[x].max()) if len(x) else 0):
                new = (signs[x, k] != signs[y, k]) | (t[x] <= k)
                x, y = x[new], y[new]
                if not len(x):
                    break
            pairs.append((x, y))

        small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
        for off in range(1, SMALL):
            small = small[small + off < b.num_rows]
            small = small[group[small] == group[small + off]]
            if not len(small):
                break
            dim = np.array([len(unit[i]) for i in small.tolist()])
            for n in np.unique(dim):
                x = small[dim == n]
                x = x[np.einsum("ij,ij->i", np.stack([unit[i] for i in x.tolist()]), np.stack([unit[i + off] for i in x.tolist()])) >= least]
                keep(x, x + off)
        for g in np.flatnonzero(sizes > SMALL).tolist():
            lo, n = int(first[g]), int(sizes[g])
            m = np.stack(unit[lo : lo + n])
            for r in range(0, n, 256):
                x, y = np.nonzero(m[r : r + 256] @ m[r:].T >= least)
                up = y > x
                keep(x[up] + lo + r, y[up] + lo + r)
        x, y = (np.concatenate([p[k] for p in pairs] or [np.empty(0, np.int64)]).astype(np.int64) for k in (0, 1))
        if not len(x):
            return None
        n = np.bincount(x, weight[y], b.num_rows).astype(np.int64) + np.bincount(y, weight[x], b.num_rows).astype(np.int64)
        some = np.flatnonzero(n)
        root = _roots(b.num_rows, x, y)
        cls = b.column("cls")
        return pa.RecordBatch.from_arrays([cls.take(pa.array(some)), pa.array(n[some]), cls.take(pa.array(root[some]))], ["cls", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in slices(batches, ROWS):
            if not b.num_rows:
                continue
            b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            last = int(np.flatnonzero(starts(*(b.column(c) for c in GROUP)))[-1])
            held = b.slice(last)
            if last and (out := linked(b.slice(0, last))) is not None:
                yield out
        if held is not None and (out := linked(held)) is not None:
            yield out

    return run


def _found(classes: DataFrame, signed: DataFrame, tables: range, least: float, block: int) -> DataFrame:
    """cls, n, root: links of pairs whose first common bucket is in one of these tables; a written table."""
    each = signed.select("cls", "label", "dim", F.posexplode(F.slice("signs", tables.start + 1, len(tables))).alias("k", "sign"))
    each = each.select("cls", (F.col("k") + tables.start).alias("t"), F.xxhash64("label", "dim", "k", "sign").alias("code"))
    shared = each.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialise(shared.drop("n"), "shared")
    spots = each.join(shared, "code").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spots = spots.withColumn("other", other).select("cls", "t", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    full = spots.join(signed, "cls").withColumn("sign", F.get("signs", F.col("t"))).join(classes.select("cls", "weight", "v"), "cls")
    dealt = full.repartition(*GROUP).sortWithinPartitions(*GROUP)
    found = materialise(dealt.mapInArrow(_compared(least), "cls binary, n long, root binary"), "found")
    discard(shared)
    return found


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: vectors of equal labels with a cosine of at least ``least`` are linked."""
    ship(vectors.sparkSession)
    rows = materialise(_classes(vectors, id_col, vector_col, label_col), "rows")
    some = rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("low"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = materialise(some, "classes")
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = plan(largest, least, miss)
    signed = materialise(_signed(classes, bits, tables), "signs")
    found = [_found(classes, signed, range(k, min(k + AT_ONCE, tables)), least, block) for k in range(0, tables, AT_ONCE)]
    discard(signed)
    edges = reduce(DataFrame.unionByName, found)

    roots = components(edges.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = edges.groupBy("cls").agg(F.sum("n").alias("n"))
    named = classes.select("cls", "weight", "low").join(links, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    named = materialise(named.select("cls", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "low", F.coalesce("root", "cls").alias("root")), "named")
    for t in (classes, *found):
        discard(t)
    lowest = materialise(named.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    placed = materialise(join_each(named, lowest, "root").select("cls", "n_links", "component_id"), "placed")
    discard(named)
    out = join_each(rows.select("vec_id", "cls"), placed, "cls")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def keep_one_of_each_component(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98) -> DataFrame:
    """The rows whose id is the smallest of their component, with all their columns; rows that repeat an id have no other way to be told apart, and stay or go together."""
    stay = near_vectors(vectors, id_col, vector_col, label_col, least).filter("kept").select(F.col("vec_id").alias("__i")).distinct()
    return vectors.join(stay, vectors[id_col].eqNullSafe(stay["__i"]), "left_semi")

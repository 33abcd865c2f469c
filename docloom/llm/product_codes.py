"""Vector codes of a few bytes: product quantisation with codebooks fitted by Yinyang Lloyd rounds, in integers.

A vector's components become integers floor(scale * x) and are cut into equal parts; each part has a codebook. The entries of a codebook form groups
of about ``GROUP_ENTRIES`` near ones. A row carries its entry and, for each group, a lower bound of the distance to the group's other entries. When entries have moved,
the bounds fall by the largest drift of their group; only groups whose bound does not exceed the distance to the row's own entry are scanned. Distances
come from matrix products of doubles; entries within their rounding error of the nearest one are compared in 64-bit integers, so that ties go to the lowest index.

Each round is one pass over a written table (vectors, codes, bounds), which writes the next one and discards the last, and one pass that adds up parts by
entry within tasks; Spark adds these sums, and only the codebooks (entries x dimension numbers) meet on the driver.

Defined results: vectors that are null or hold null or non-finite components are dropped; components beyond +-65536 count as that bound, so that errors fit
in a long; the dimension is that of the smallest id with a vector whose length is divisible by the number of parts and not 0; vectors of other lengths keep a row with null code and error, and
do not count; null ids are larger than all others, rows tied by id are ordered by their components; repeated rows each count and each have a row; with fewer rows than entries
the codebook is smaller; an empty table gives an empty one; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import discard, join_each, materialise
from docloom.llm.vectors import by_length, slices
from docloom.shipping import ship

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
GROUP_ENTRIES = 16
LIMIT = 1 << 26
UP, DOWN = 1 + 1e-12, 1 - 1e-12
COMPONENTS = 1 << 20  # components that are worked on together
FAR = np.iinfo(np.int64).max


def integers(m: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(m * scale), -LIMIT, LIMIT).astype(np.int64)


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", x, x)


@dataclass
class Codebook:
    """Entries (parts, entries, width) and each entry's group (parts, entries); drift is how far a group's entries moved at most in the last round."""

    entries: np.ndarray
    groups: np.ndarray
    drift: np.ndarray

    @classmethod
    def start(cls, rows: np.ndarray, parts: int) -> Codebook:
        entries = rows.reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()
        n = -(-len(rows) // GROUP_ENTRIES)
        return cls(entries, np.stack([_grouped(e.astype(float), n) for e in entries]), np.zeros((parts, n)))

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebook:
        """The entries that parts' counts and sums give; unused ones stay."""
        entries = self.entries.copy()
        for (p, k), (n, total) in sums.items():
            entries[p, k] = [t // n for t in total]
        far = np.sqrt(_squares((entries - self.entries).astype(float))) * UP
        drift = np.zeros_like(self.drift)
        for p, g in enumerate(self.groups):
            np.maximum.at(drift[p], g, far[p])
        return Codebook(entries, self.groups, drift)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _grouped(entries: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """A group for each entry: Lloyd rounds over the entries themselves, from evenly spaced ones."""
    centres = entries[np.arange(n) * len(entries) // n]
    for _ in range(rounds):
        at = ((entries[:, None] - centres) ** 2).sum(-1).argmin(1)
        centres = np.stack([entries[at == g].mean(0) if (at == g).any() else centres[g] for g in range(n)])
    return ((entries[:, None] - centres) ** 2).sum(-1).argmin(1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For integer rows x: place of the nearest entry of c (ties: the first), its exact squared distance, and a lower bound of the distance to all others."""
    xf, cf = x.astype(float), c.astype(float)
    size = _squares(xf)[:, None] + _squares(cf)
    d = size - 2 * (xf @ cf.T)
    error = size * ((x.shape[1] + 4) * 2.0**-52)
    low = d - error
    near = low <= (d + error).min(1)[:, None]
    best = near.argmax(1)
    doubt = np.flatnonzero(near.sum(1) > 1)
    if len(doubt):
        r, k = np.nonzero(near[doubt])
        exact = np.full((len(doubt), len(c)), FAR)
        exact[r, k] = _squares(x[doubt[r]] - c[k])
        best[doubt] = exact.argmin(1)
    low[np.arange(len(x)), best] = np.inf
    return best, _squares(x - c[best]), np.sqrt(np.maximum(low.min(1), 0)) * DOWN


def assign(x: np.ndarray, book: Codebook, codes: np.ndarray | None = None, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, squared distances, lower bounds by part and group) of integer rows x; codes and low are those of the round before."""
    parts, _, width = book.entries.shape
    n, groups = len(x), book.drift.shape[1]
    first = codes is None
    codes = np.full((n, parts), -1) if first else codes.astype(np.int64)
    low = np.zeros((n, parts, groups)) if first else np.maximum(low - book.drift, 0) * DOWN
    error = np.full((n, parts), FAR)
    for p in range(parts):
        xp, c, of, a, best, bound = x[:, p * width : (p + 1) * width], book.entries[p], book.groups[p], codes[:, p], error[:, p], low[:, p]
        if not first:
            best[:] = _squares(xp - c[a])
        for g in range(groups):
            members = np.flatnonzero(of == g)
            if not len(members):
                bound[:, g] = np.inf
                continue
            rows = np.flatnonzero(bound[:, g] <= np.sqrt(best) * UP)
            if not len(rows):
                continue
            at, exact, others = nearest(xp[rows], c[members])
            at = members[at]
            better = (exact < best[rows]) | ((exact == best[rows]) & (at < a[rows]))
            own = at == a[rows]
            bound[rows, g] = np.where(better | own, others, np.sqrt(exact) * DOWN)
            win = rows[better]
            left = win[a[win] >= 0]
            was = of[a[left]]
            bound[left, was] = np.minimum(bound[left, was], np.sqrt(best[left]) * DOWN)
            a[win], best[win] = at[better], exact[better]
    return codes, error, low


def _packed(low: np.ndarray) -> np.ndarray:
    """Upper halves of 32-bit floats: bounds only get lower."""
    return (np.nextafter(low.astype(np.float32), np.float32(0)).view(np.uint32) >> 16).astype("<u2")


def _unpacked(raw: np.ndarray) -> np.ndarray:
    return (raw.astype(np.uint32) << 16).view(np.float32).astype(float)


def _bytes(m: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in m]


STATE = "v binary, codes binary, low binary"


def _read(b: pa.RecordBatch, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, _, width = book.entries.shape
    whole = lambda name, kind: np.frombuffer(b"".join(b.column(name).to_pylist()), kind)
    return whole("v", "<i4").reshape(-1, parts * width).astype(np.int64), whole("codes", np.uint8).reshape(-1, parts), _unpacked(whole("low", "<u2")).reshape(-1, parts, book.drift.shape[1])


class Coder:
    """Codebooks of one table and the passes that fit and apply them."""

    def __init__(self, vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE):
        self.spark, self.parts, self.scale = vectors.sparkSession, parts, scale
        ship(self.spark)
        v = F.col("v").cast("array<double>")
        sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        named = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
        self.kept = named.filter(F.col("v").isNotNull() & sound)
        self.ids = f"vec_id {named.schema['vec_id'].dataType.simpleString()}, label {named.schema['label'].dataType.simpleString()}"
        fit = self.kept.filter((F.size("v") > 0) & (F.size("v") % parts == 0))
        smallest = fit.orderBy(F.col("vec_id").asc_nulls_last(), v)
        first = smallest.select(F.size("v").alias("n")).limit(1).collect()
        self.size = first[0]["n"] if first else 0
        rows = [r["v"] for r in smallest.filter(F.size("v") == self.size).select(v.alias("v")).limit(entries).collect()]
        self.book = Codebook.start(integers(np.array(rows, float).reshape(len(rows), self.size), scale), parts) if rows else None

    def first_pass(self) -> DataFrame:
        shared, size, scale = self.spark.sparkContext.broadcast(self.book), self.size, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, max(1, COMPONENTS // max(1, size))):
                for at, m in by_length(b.column("v")):
                    if m.shape[1] == size:
                        x = integers(m, scale)
                        codes, _, low = assign(x, shared.value)
                        some = b.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *(pa.array(_bytes(y), pa.binary()) for y in (x.astype("<i4"), codes.astype(np.uint8), _packed(low)))], ["vec_id", "label", "v", "codes", "low"])

        return self.kept.mapInArrow(run, f"{self.ids}, {STATE}")

    def next_pass(self, state: DataFrame) -> DataFrame:
        shared, rows = self.spark.sparkContext.broadcast(self.book), max(1, COMPONENTS // max(1, self.size))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, rows):
                x, codes, low = _read(b, shared.value)
                codes, _, low = assign(x, shared.value, codes, low)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(_bytes(codes.astype(np.uint8)), pa.binary()), pa.array(_bytes(_packed(low)), pa.binary())], b.schema.names)

        return state.mapInArrow(run, f"{self.ids}, {STATE}")

    def sums(self, state: DataFrame) -> dict[tuple[int, int], tuple[int, list[int]]]:
        """Counts and component sums of the parts that each entry has."""
        parts, k, width = self.book.entries.shape
        rows = max(1, COMPONENTS // max(1, self.size))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
            for b in slices(batches, rows):
                x = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4").reshape(-1, parts * width)
                codes = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, parts)
                for p in range(parts):
                    count[p] += np.bincount(codes[:, p], minlength=k)
                    for j in range(width):
                        total[p, :, j] += np.bincount(codes[:, p], x[:, p * width + j], k).astype(np.int64)
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        each = state.select("v", "codes").mapInArrow(run, "part int, entry int, n long, sums array<long>")
        added = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width)))
        return {(r["part"], r["entry"]): (r["n"], [r[f"s{j}"] for j in range(width)]) for r in added.collect()}

    def fit(self, rounds: int = ROUNDS) -> DataFrame:
        """The state after all rounds; self.book holds the entries as the last round leaves them."""
        state = materialise(self.first_pass(), "codes")
        for r in range(rounds):
            self.book = self.book.moved(self.sums(state))
            if r + 1 < rounds:
                after = materialise(self.next_pass(state), "codes")
                discard(state)
                state = after
        return state

    def coded(self, state: DataFrame) -> DataFrame:
        """vec_id, label, code (hexadecimal), error: nearest entries of the present codebooks."""
        shared, rows = self.spark.sparkContext.broadcast(self.book), max(1, COMPONENTS // max(1, self.size))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, rows):
                x, codes, low = _read(b, shared.value)
                codes, error, _ = assign(x, shared.value, codes, low)
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)]), pa.array(error.sum(1))], ["vec_id", "label", "code", "error"])

        return state.mapInArrow(run, f"{self.ids}, code string, error long")


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebook | None]:
    """(vec_id, label, code, error of every kept row; the codebooks), None if nothing could be fitted."""
    coder = Coder(vectors, id_col, vector_col, label_col, parts, entries, scale)
    other = coder.kept.filter(F.size("v") != coder.size) if coder.book else coder.kept
    other = other.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not coder.book:
        return other, None
    state = coder.fit(rounds)
    out = materialise(coder.coded(state).unionByName(other), "coded")
    discard(state)
    return out, coder.book


def code_digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row."""
    out, book = compress(vectors)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    rows = out.withColumn("__label", key)
    if book is None:
        return rows.select("vec_id", "code", "error", F.lit(None).cast("long").alias("label_error"), F.lit(None).cast("string").alias("codebooks_sha256"))
    labels = materialise(rows.groupBy("__label").agg(F.sum("error").alias("label_error")), "labels")
    return join_each(rows, labels, "__label").select("vec_id", "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))

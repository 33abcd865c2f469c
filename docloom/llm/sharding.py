"""Sharding over fixed virtual slots, balanced by bytes.

A record's virtual slot is a hash of its id, modulo a fixed number of slots; an id that repeats with more than an eighth of a shard's bytes is dealt by the text's crc32 as well. Bytes and rows are summed for
each slot, and a versioned table at a given path maps slots to shards. Version 1 deals the slots in turn; a rebalance loads the newest version, edits it and appends
the next: slots go from the fullest shard to the emptiest as long as that brings the two closer, all others stay. Records find their shard by a join with the newest
version. Only the map is planned on the driver; it has ``slots`` rows, however large the data. The law is ``bytes``: the shards' sizes are nearly equal.

Defined results: a null text has no bytes (crc32 0), a null id hashes as the word null; equal rows share a slot, each with
its own place; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.shared import new_path
from docloom.sources.store import Files

SLOTS = 4096
MAP = "slot int, shard int, bytes long, rows long, first long"
OVERHEAD = 16


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit("null"))


def virtual_slot(id_col: str, slots: int = SLOTS, hot: list[str] | None = None, salt: Column | None = None) -> Column:
    """Of the id; of id and salt for hot ids."""
    plain = F.xxhash64(_key(id_col))
    h = F.when(_key(id_col).isin(hot), F.xxhash64(_key(id_col), salt)).otherwise(plain) if hot else plain
    return F.pmod(h, F.lit(slots)).cast("int")


def hot_ids(docs: DataFrame, id_col: str, size: Column, slots: int, shards: int) -> list[str]:
    """Repeated ids with more than an eighth of a shard's bytes: fewer than 8 * shards."""
    sums = docs.groupBy(virtual_slot(id_col, slots).alias("slot")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    most = sum(r["bytes"] for r in sums) / (8 * shards)
    full = [r["slot"] for r in sums if r["bytes"] > most and r["rows"] > 1]
    if not full:
        return []
    ids = docs.filter(virtual_slot(id_col, slots).isin(full)).groupBy(_key(id_col).alias("id")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return sorted(r["id"] for r in ids.filter((F.col("bytes") > most) & (F.col("rows") > 1)).collect())


def initial_map(slots: int, shards: int) -> list[int]:
    return [s % shards for s in range(slots)]


def rebalance(slot_to_shard: list[int], slot_bytes: list[int], shards: int) -> list[int]:
    """The next version: moves, each of the slot nearest to half the gap between fullest and emptiest shard.

    A shard that holds no slot smaller than the gap is set aside until it is given one, and the next fullest gives.
    """
    out = list(slot_to_shard)
    held = [sorted((slot_bytes[s], s) for s in range(len(out)) if out[s] == k and slot_bytes[s]) for k in range(shards)]
    load = [sum(b for b, _ in h) for h in held]
    giving = set(range(shards))
    while giving:
        hi, lo = max(giving, key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        gap = load[hi] - load[lo]
        i = bisect.bisect_left(held[hi], (gap / 2, -1))
        near = [held[hi][j] for j in (i - 1, i) if 0 <= j < len(held[hi]) and held[hi][j][0] < gap]
        if not near:
            giving.remove(hi)
            continue
        b, s = min(near, key=lambda x: (abs(x[0] - gap / 2), x))
        held[hi].remove((b, s))
        bisect.insort(held[lo], (b, s))
        load[hi], load[lo], out[s] = load[hi] - b, load[lo] + b, lo
        giving.add(lo)
    return out


class SlotMap:
    """Versions of a map below a path: version=<n> with a row (slot, shard, bytes, rows, first) for each slot. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark, path)

    def version(self) -> int:
        """The newest whole version; 0 if there is none."""
        names = [n for n in self.files.names(self.path) if n.startswith("version=") and self.files.exists(f"{self.path}/{n}/_SUCCESS")]
        return max((int(n[8:]) for n in names), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema(MAP).parquet(f"{self.path}/version={version or self.version()}")

    def append(self, shard_of: list[int], n_bytes: list[int], n_rows: list[int]) -> int:
        filled, rows = defaultdict(int), []
        for slot, (shard, b, n) in enumerate(zip(shard_of, n_bytes, n_rows, strict=True)):
            rows.append((slot, shard, b, n, filled[shard]))
            filled[shard] += n
        version = self.version() + 1
        self.spark.createDataFrame(rows, MAP).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")
        return version

    def rebalance(self, sums: DataFrame, slots: int, shards: int) -> int:
        """Append the version that fits sums (slot, bytes, rows); slots of shards that are no more are dealt in turn first."""
        n_bytes, n_rows = [0] * slots, [0] * slots
        for r in sums.collect():  # one row for each slot at most
            n_bytes[r["slot"]], n_rows[r["slot"]] = int(r["bytes"]), int(r["rows"])
        if not self.version():
            self.append(initial_map(slots, shards), [0] * slots, [0] * slots)
        old = [r["shard"] for r in self.read().orderBy("slot").collect()]
        if len(old) != slots:
            raise ValueError("the stored map has another number of slots")
        old = [k if k < shards else slot % shards for slot, k in enumerate(old)]
        return self.append(rebalance(old, n_bytes, shards), n_bytes, n_rows)


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (the row's place in its shard, gapless from 0), grown_shard, virtual_slot, map_version.

    map_path: where the map's versions are kept from one call to the next; a new path if none is given.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + OVERHEAD
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    at = virtual_slot(id_col, slots, hot_ids(docs, id_col, size, slots, shards), crc)
    slot_map = SlotMap(spark, map_path or new_path(spark, "slot_map"))
    sums = docs.groupBy(at.alias("slot")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    version = slot_map.rebalance(sums, slots, shards)
    now = slot_map.read(version).select(F.col("slot").alias("virtual_slot"), "shard", "first")
    df = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), at.alias("virtual_slot"))
    # Places are counted within virtual slots, thousands of small windows, and start where the shard's slots before end.
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")) - 1
    df = df.withColumn("place", place).join(now, "virtual_slot")
    return df.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"),
    )

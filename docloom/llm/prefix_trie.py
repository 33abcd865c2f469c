"""The prefix trie of conversations, with sums over subtrees by pointer jumping.

A turn is a 128-bit digest of its role and text and the number of its code points; texts are read once and not shuffled. A prefix's digest is made of its depth and of
four running sums of 32-bit words of each (place, turn), so that a conversation of any length can be dealt over many tasks. Nodes are distinct digests, with
their members counted on the map side, and each has an edge to its parent's digest.

Sums over subtrees: after k rounds a node holds the sum over descendants less than 2^k deeper, and a pointer to its ancestor 2^k higher. A round
adds every node's sum to the node it points at, then follows the pointer's own pointer: as many rounds as the depth has binary digits.

Rebuilding (``shared_turns``): a conversation c takes the first h turns of conversation c - c % 100, and its own turns after its first h.

Defined results: null roles and texts are empty; turns are ordered with null first, ties by role and digest of the text; repeated rows are turns of their own;
rows without a conv_id are left out; an empty table has no nodes; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.running import running, starts
from docloom.llm.shared import discard, join_each, materialise
from docloom.shipping import ship

BASE, HEADS = 100, 6
WORDS = ["w0", "w1", "w2", "w3"]
CHUNK = 4096  # ids of one node that are joined to a piece of text


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, chars of every row, without texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    parts = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), F.unhex(F.substring(F.sha2(parts, 256), 1, 32)).alias("digest"), F.char_length(text).cast("long").alias("chars"))


def heads(conv: str = "conv_id"):
    """How many turns c takes from its base."""
    return F.crc32(F.col(conv).cast("string").cast("binary")) % HEADS


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, at, digest, chars of every rebuilt turn; c of every conversation)."""
    read = materialise(turns(conversations), "turns")
    own = running(read, "conv_id", [F.col("turn").asc_nulls_first(), "role", "digest"], [])
    discard(read)
    own = own.select("conv_id", F.col("__at").alias("at"), "digest", "chars")
    first = materialise(own.filter((F.col("at") < HEADS - 1) & (F.col("conv_id") % BASE == 0)).withColumnRenamed("conv_id", "base"), "first")
    there = first.groupBy("base").agg(F.count(F.lit(1)).alias("there"))
    convs = own.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % BASE).alias("base"), heads().alias("h"))
    convs = convs.join(there, "base", "left").withColumn("b", F.least("h", F.coalesce("there", F.lit(0)))).drop("there")
    convs = materialise(convs, "convs")
    shared = convs.join(first, "base").filter("at < b").select("conv_id", "at", "digest", "chars")
    later = own.join(convs, "conv_id").filter("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("b")).alias("at"), "digest", "chars")
    whole = materialise(shared.unionByName(later), "rebuilt")
    out = materialise(convs.select("conv_id"), "convs")
    for t in (own, first, convs):
        discard(t)
    return whole, out


def as_they_are(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Like rebuilt(), without rebuilding."""
    read = materialise(turns(conversations), "turns")
    own = running(read, "conv_id", [F.col("turn").asc_nulls_first(), "role", "digest"], [])
    discard(read)
    return own.select("conv_id", F.col("__at").alias("at"), "digest", "chars"), own.select("conv_id").distinct()


def _key(depth, words) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat_ws(",", depth.cast("string"), *(w.cast("string") for w in words)), 256), 1, 32))


def _root() -> Column:
    return _key(F.lit(0), [F.lit(0)] * len(WORDS))


def prefixes(whole: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent, chars: a row for each turn of each conversation; a written table."""
    mixed = F.sha2(F.concat(F.encode(F.concat(F.col("at").cast("string"), F.lit(":")), "utf-8"), F.col("digest")), 256)
    each = whole.withColumn("m", mixed)
    words = [F.conv(F.substring("m", 8 * i + 1, 8), 16, 10).cast("long").alias(w) for i, w in enumerate(WORDS)]
    each = materialise(each.select("conv_id", "at", "chars", *words), "words")
    summed = running(each, "conv_id", ["at"], WORDS)
    discard(each)
    upto = [F.col(f"__upto_{w}") for w in WORDS]
    before = [u - F.col(w) for u, w in zip(upto, WORDS, strict=True)]
    out = summed.select("conv_id", (F.col("at") + 1).alias("depth"), _key(F.col("at") + 1, upto).alias("key"), _key(F.col("at"), before).alias("parent"), "chars")
    out = materialise(out, "prefixes")
    discard(summed)
    return out


def ends_digest(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: SHA-256 of each key's decimal conv_ids, ascending, comma-joined. ends (key, conv_id) is a written table.

    Ids are sorted over all tasks and joined to pieces; then the pieces of a key, few as they are, pass through one hash in order.
    """
    ship(ends.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, CHUNK) for x in batches for i in range(0, x.num_rows, CHUNK)):
            k, ids = b.column(0), pc.cast(b.column(1), pa.string()).to_pylist()
            at = [*starts(k).nonzero()[0].tolist(), len(ids)]
            yield pa.RecordBatch.from_arrays([k.take(pa.array(at[:-1])), b.column(1).take(pa.array(at[:-1])), pa.array([",".join(ids[i:j]) for i, j in zip(at, at[1:], strict=False)])], ["key", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None
        for b in batches:
            done = []
            for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k == last:
                    h.update(b"," + ids.encode())
                    continue
                if h:
                    done.append((last, h.hexdigest()))
                last, h = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.binary(), pa.string()))], ["key", "ends_sha256"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([h.hexdigest()])], ["key", "ends_sha256"])

    kind = ends.schema["conv_id"].dataType.simpleString()
    cut = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pieces, f"key binary, first {kind}, ids string")
    return cut.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")


def rolled_up(nodes: DataFrame, values: list[str]) -> DataFrame:
    """key and, for each column of values, its sum over the node's subtree. nodes: key, parent (null at the root), depth and values."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    state, reach = materialise(nodes.select("key", F.col("parent").alias("ptr"), "depth", *values), "jump"), 1
    while reach <= deepest:
        given = state.filter("ptr IS NOT NULL").groupBy(F.col("ptr").alias("key")).agg(*(F.sum(v).alias(f"__{v}") for v in values))
        further = state.filter(f"depth >= {2 * reach}").join(state.select(F.col("key").alias("ptr"), F.col("ptr").alias("next")), "ptr").select("key", "next")
        added = state.join(given, "key", "left").join(further, "key", "left")
        after = materialise(added.select("key", F.col("next").alias("ptr"), "depth", *((F.col(v) + F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values)), "jump")
        discard(state)
        state, reach = after, 2 * reach
    return state.select("key", *values)


def trie(whole: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each distinct prefix. whole: conv_id, at, digest, chars of every turn; convs: conv_id of every conversation."""
    each = prefixes(whole)
    inner = each.groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("chars").alias("chars"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(_root().alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"))
    named = materialise(inner.unionByName(root), "nodes")
    children = named.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(named.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    discard(named)

    last = each.groupBy("conv_id").agg(F.max(F.struct("depth", "key")).alias("last"))
    ends = convs.join(last, "conv_id", "left").select(F.coalesce("last.key", _root()).alias("key"), "conv_id")
    ends = materialise(ends, "ends")
    discard(each)

    own = nodes.select("key", "parent", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    sums = rolled_up(own, ["n_leaves", "saved_tokens"])
    parents = materialise(nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parents")
    out = join_each(nodes, parents, "parent").join(sums, "key").join(ends_digest(ends), "key", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def trie_digest(conversations: DataFrame) -> DataFrame:
    return trie(*rebuilt(conversations))

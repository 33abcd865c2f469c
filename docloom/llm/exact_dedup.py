"""Exact dedup by deterministic block naming.

The normalised text is cut into blocks of fixed size. Sorted distinct blocks get integer names, then
adjacent pairs of names are named in the same way, again and again, until each document has one
name. Two documents are equal exactly if they have the same number of blocks and the same last name.

Blocks are sorted by (64-bit fingerprint, bytes). So that texts are shuffled once only, as distinct
blocks combined on the map side, the table of names is keyed by fingerprint; a fingerprint that
distinct blocks share is found by counting them, and those blocks are named by their bytes. No
identity rests on a hash being free of collisions. Hot blocks collapse before the shuffle, and joins
with the names are plain sort-merge joins of written tables, which AQE splits where a key is hot.

Defined results: a null text equals the empty one; a null id is the smallest; of rows tied at the
largest id, exactly one stays; every input row has one result row; an empty table gives an empty one;
other input columns are ignored (the filter below carries them along).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import discard, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BYTES = 4096
NONE = -(2**63)  # the second of a pair that has none


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; null is empty. lower() does just that to an ASCII text."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def _blocks(norm: Column, block_bytes: int) -> Column:
    b = norm.cast("binary")
    last = F.greatest(F.lit(0), F.floor((F.octet_length(b) - 1) / block_bytes)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(b, i * block_bytes + 1, F.lit(block_bytes)))


def _ranked(distinct: DataFrame) -> DataFrame:
    """Sorted rows with increasing integer names; written, so that a name never changes."""
    return materialise(distinct.orderBy(*distinct.columns).withColumn("name", F.monotonically_increasing_id()), "names")


def identities(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    fingerprint: Callable[[Column], Column] = F.xxhash64,
) -> tuple[DataFrame, DataFrame]:
    """(rows, identity): rid, doc_id, sha, n of every input row; rid, n, name. Equal (n, name): equal texts."""
    cut = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn("blocks", _blocks(F.col("norm"), block_bytes))
    prints = F.transform("blocks", lambda b: fingerprint(b))
    rows = materialise(
        cut.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("norm", 256).alias("sha"), F.size("blocks").alias("n"), prints.alias("prints")),
        "rows",
    )
    each = cut.select(F.explode("blocks").alias("block")).select(fingerprint(F.col("block")).alias("print"), "block")
    names = materialise(
        each.distinct().groupBy("print").agg(F.count(F.lit(1)).alias("blocks")).orderBy("print").withColumn("name", F.monotonically_increasing_id()), "names"
    )
    at = rows.select("rid", "n", F.posexplode("prints").alias("pos", "print"))
    level = at.join(names, "print").select("rid", "n", "pos", "name")
    if names.filter("blocks > 1").limit(1).count():
        level = _named_by_bytes(docs, id_col, text_col, block_bytes, fingerprint, rows, names, level)
    level = materialise(level, "level0")
    done = [level.filter("n = 1").select("rid", "n", "name")]
    most = rows.agg(F.max("n")).first()[0] or 1
    step, used = 0, [names]
    left = level.filter("n > 1").withColumn("len", F.col("n"))
    while most > 1:
        step, most = step + 1, (most + 1) // 2
        half = lambda r: F.max(F.when(F.col("pos") % 2 == r, F.col("name")))
        pairs = materialise(
            left.groupBy("rid", "n", "len", F.floor(F.col("pos") / 2).alias("at")).agg(half(0).alias("a"), F.coalesce(half(1), F.lit(NONE)).alias("b")), f"pairs{step}"
        )
        named = _ranked(pairs.select("a", "b").distinct())
        left = materialise(
            pairs.join(named, ["a", "b"]).select("rid", "n", F.ceil(F.col("len") / 2).cast("int").alias("len"), F.col("at").alias("pos"), "name"), f"level{step}"
        )
        used += [pairs, named]
        done.append(left.filter("len = 1").select("rid", "n", "name"))
        left = left.filter("len > 1")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    for t in used:
        discard(t)
    return rows.select("rid", "doc_id", "sha", "n"), out


def _named_by_bytes(docs, id_col, text_col, block_bytes, fingerprint, rows, names, level) -> DataFrame:
    """Blocks that share a fingerprint with another block: rank them by bytes; negative names, which no other block has."""
    clash = names.filter("blocks > 1").select("print")
    # rid comes from the same scan of the same splits as in rows, but is not relied on: a text is found by its sha.
    cut = docs.select(normalised(F.col(text_col)).alias("norm")).withColumn("blocks", _blocks(F.col("norm"), block_bytes))
    each = cut.select(F.sha2("norm", 256).alias("sha"), F.posexplode("blocks").alias("pos", "block")).withColumn("print", fingerprint(F.col("block")))
    each = each.join(clash, "print", "left_semi")
    ranked = _ranked(each.select("print", "block").distinct()).select("print", "block", (-1 - F.col("name")).alias("own"))
    own = each.join(ranked, ["print", "block"]).select("sha", "pos", "own").distinct()
    spots = rows.select("rid", "sha", "n", F.posexplode("prints").alias("pos", "print")).join(clash, "print", "left_semi")
    exact = spots.join(own, ["sha", "pos"]).select("rid", "pos", "own")
    return level.join(exact, ["rid", "pos"], "left").select("rid", "n", "pos", F.coalesce("own", "name").alias("name"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, identity = identities(docs, id_col, text_col, block_bytes, fingerprint)
    whole = materialise(rows.join(identity.drop("n"), "rid"), "whole")
    best = F.max(F.struct("doc_id", (-F.col("rid")).alias("r"))).alias("best")
    groups = materialise(whole.groupBy("n", "name").agg(best, F.count(F.lit(1)).alias("group_size")), "groups")
    return whole.join(groups, ["n", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == -F.col("best.r")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    key = lambda i, sha: F.concat_ws(":", F.coalesce(F.col(i).cast("string"), F.lit("-")), sha)
    stay = exact_groups(docs, id_col, text_col).filter("kept").select(key("doc_id", F.col("text_sha256")).alias("__key")).distinct()
    marked = docs.withColumn("__key", key(id_col, F.sha2(normalised(F.col(text_col)), 256)))
    return marked.join(stay, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")

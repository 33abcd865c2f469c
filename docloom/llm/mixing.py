"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash. Within a source, words are summed by the hash's leading bits; the bucket in which the running
sum passes the budget is the boundary, and only rows in boundary buckets are summed by the next bits, until a boundary holds a
single hash. A document is taken once more if its hash is below its source's threshold: no rows are sorted, and thresholds for
smaller budgets are nested in those for larger ones. Whole multiples of a source come as whole repeats of all its documents.

Targets: sources by code point, null last, weigh ``weights`` in turn and share all words; a target stops at ``most`` times
its source's size and the excess is shared by weight among the rest, which is filling up to a common level.

Defined results: null or blank texts have size 0 and are taken 0 words; a null source is a source of its own; null ids hash
as the word null; only rows equal in id and text share a hash and are taken together; an empty table gives an empty one; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.shared import discard, materialise

WEIGHTS = (1, 2, 3)
MOST = 3
BITS, LEVELS = 12, 5  # 60 bits of the hash, 12 at a time


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def hash60(id_col: str, text_col: str) -> Column:
    """60 bits of MD5 of id and text: the same in any engine."""
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def source_targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> also target. One row for each source, so a window over all of them is small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sums.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * most)
    # By rising cap/weight: a source is at its cap if the level that the others would share lies above that.
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    df = df.withColumn("total", F.sum("source_size").over(every))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    # cap/w < (total - capped) / open, in whole numbers
    df = df.withColumn("full", F.col("cap").cast("decimal(38,0)") * F.col("open") < (F.col("total") - F.col("capped")) * F.col("w"))
    df = df.withColumn("all_capped", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)).withColumn("all_open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every))
    level = (F.col("total") - F.col("all_capped")).cast("double") / F.col("all_open").cast("double")
    return df.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w").cast("double") * level).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """source, budget (words wanted) -> source, below: take rows with hash < below, whose words come nearest to the budget.

    sized: source, size, hash (below 2^(bits*levels)), a written table. budgets: source, budget, one row for each source.
    """
    total = bits * levels
    state = materialise(budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("got")), "budgets")
    for step in range(1, levels + 1):
        shift = total - bits * step
        # Only the boundary bucket of the level before; the join is with one row for each source.
        b = state.select(F.col("source").alias("s"), "prefix")
        rows = sized.join(b, sized["source"].eqNullSafe(b["s"]) & (F.shiftrightunsigned("hash", shift + bits) == F.col("prefix"))).select("source", "size", F.shiftrightunsigned("hash", shift).alias("bucket"), "hash")
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        st = state.withColumnRenamed("source", "s")
        run = Window.partitionBy("source").orderBy("bucket")
        sums = sums.join(st, sums["source"].eqNullSafe(st["s"])).drop("s").withColumn("upto", F.col("got") + F.sum("words").over(run))
        # The first bucket whose end reaches the budget (an empty source or a budget of all words has none: take all).
        hit = sums.filter(F.col("upto") >= F.col("budget")).groupBy("source").agg(F.min(F.struct("bucket", "words", "upto", "lo", "hi")).alias("m"))
        st = state.withColumnRenamed("source", "s")
        nxt = st.join(hit, st["s"].eqNullSafe(hit["source"]), "left").select(
            F.col("s").alias("source"), "budget", F.coalesce("m.bucket", F.lit(-1)).alias("prefix"),
            F.coalesce(F.col("m.upto") - F.col("m.words"), F.col("got")).alias("got"),
            F.col("m.words").alias("words"), F.col("m.lo").alias("lo"), F.col("m.hi").alias("hi"),
        )
        old, state = state, materialise(nxt, f"boundary{step}")
        if step == 1:
            discard(old)
        if not state.filter("lo < hi").limit(1).count():
            break
        # Sources that are settled keep their bucket: it holds one hash and is summed again at no cost.
        state = state.select("source", "budget", "prefix", "got", "words", "lo", "hi") if step == levels else state.drop("words", "lo", "hi")
    # One hash is left: taken if that comes nearer to the budget.
    last = F.when(F.col("got") + F.col("words") - F.col("budget") < F.col("budget") - F.col("got"), F.col("lo") + 1).otherwise(F.col("lo"))
    return state.select("source", F.when(F.col("lo").isNull(), F.lit(2**total)).otherwise(last).alias("below"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), hash60(id_col, text_col).alias("hash"))


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """s (the source), source_size, target, whole, below: each document goes in ``whole`` times, and once more if its hash is below ``below``.

    sized: source, size, hash, a written table. One row for each source.
    """
    targets = materialise(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("whole", whole)
    below = thresholds(sized, plan.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    below = below.withColumnRenamed("source", "s")
    return materialise(plan.join(below, plan["source"].eqNullSafe(below["s"])).drop("s"), "plan").withColumnRenamed("source", "s")


def _repeats(size: str, hash_: str, whole: str, below: str, most: int) -> Column:
    more = F.when((F.col(hash_) < F.col(below)) & (F.col(whole) < most), 1).otherwise(0)
    return F.when(F.col(size) > 0, F.col(whole) + more).otherwise(0).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, repeats: the mix holds each document ``repeats`` times."""
    sized = materialise(_sized(docs, id_col, text_col, source_col), "sized")
    plan = mix_plan(sized, weights, most)
    return (
        sized.join(plan, sized["source"].eqNullSafe(plan["s"]))
        .withColumn("repeats", _repeats("size", "hash", "whole", "below", most).cast("long"))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "source", "repeats")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken: a filter by its source's threshold, one row for each source being joined."""
    sized = materialise(_sized(docs, id_col, text_col, source_col), "sized")
    plan = mix_plan(sized, weights, most).select(*(F.col(c).alias(f"__{c}") for c in ("s", "whole", "below")))
    keyed = docs.withColumns({"__size": word_count(F.col(text_col)), "__hash": hash60(id_col, text_col)})
    kept = keyed.join(plan, F.col(source_col).cast("string").eqNullSafe(F.col("__s")))
    times = F.array_repeat(F.lit(1), _repeats("__size", "__hash", "__whole", "__below", most))
    return kept.withColumn("__c", F.explode(times)).select(*docs.columns)

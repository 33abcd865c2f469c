"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.scratch import new_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
HOT_SHARE = 1000  # a key is hot from this fraction of the rows on, so fewer keys than this are
SALTS = 64


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df once and read it back: later plans start from files that outlive a lost executor.

    Spark knows the written size, so its own threshold decides whether a join may broadcast it. The shuffle files
    of the write go when it has ended: nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table written by materialise() that no pending plan reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/docloom/" in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def join_each(rows: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Left join of rows with one, which has a row for each key at most. Rows of hot keys are dealt over SALTS tasks.

    rows must be a written table; its hot keys are fewer than HOT_SHARE, whatever its size.
    """
    total = rows.count()
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(SALTS, total // HOT_SHARE))
    hot = [r[key] for r in n.select(key).filter(F.col(key).isNotNull()).collect()]
    if not hot:
        return rows.join(one, key, "left")
    is_hot = F.col(key).isin([bytes(h) if isinstance(h, bytearray) else h for h in hot])
    dealt = rows.withColumn("__salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(one.withColumn("__salt", F.explode(copies)), [key, "__salt"], "left").drop("__salt")

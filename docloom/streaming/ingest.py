"""Structured Streaming forms: the request ledger, rate windows, and the publishing loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators import ledger


def request_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Requests as JSON files that arrive in a folder."""
    return spark.readStream.schema(ledger.REQUEST).option("maxFilesPerTrigger", 1000).json(folder)


def minute_usage(log: DataFrame, service: str = "service_id", ts: str = "ts") -> DataFrame:
    """Requests per service and minute; buckets two minutes behind the newest are closed."""
    return log.withWatermark(ts, "2 minutes").groupBy(service, F.window(ts, "1 minute")).agg(F.count(F.lit(1)).alias("requests")).select(service, F.col("window.start").alias("minute"), "requests")


def ingest(requests: DataFrame, ledger_path: str, checkpoint: str, publish: Callable[[DataFrame], None] | None = None, interval: str | None = None, at_once: bool = True) -> StreamingQuery:
    """Fold each batch's requests onto the kept states of their sources, append requests with their outcomes to the ledger, publish the new states.

    States live in the query's checkpoint; a batch costs what its own requests cost. A batch's folders are named by its number, so a batch that runs again
    after a failure replaces itself.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{ledger_path}/outcomes/batch={number}")
        states = ledger.latest_state(spark.read.schema(ledger.OUTCOME).parquet(f"{ledger_path}/outcomes/batch={number}"))
        states.write.mode("overwrite").parquet(f"{ledger_path}/states/batch={number}")
        if publish is not None:
            publish(spark.read.parquet(f"{ledger_path}/states/batch={number}"))

    writer = ledger.fold_stream(requests, at_once).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def current_states(spark: SparkSession, ledger_path: str) -> DataFrame:
    """Of each source, the state that the newest batch wrote."""
    all_ = spark.read.parquet(f"{ledger_path}/states")
    return all_.groupBy("corpus", "source_id").agg(F.max_by(F.struct("*"), "batch").alias("s")).select("s.*").drop("batch")

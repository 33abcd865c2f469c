"""Send this package to the executors, so that Python functions can be loaded there wherever they run, and bound the batches that they are given."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT_BYTES = ("67108864b", "64m", "64MB", "67108864")
SMALL_BYTES = 4 << 20

_shipped: set[str] = set()


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of about 4 MB where the session has Spark's default of 64 MB: 10,000 long texts at once fill a worker, and the executor beside it, several times over."""
    if spark.conf.get(BATCH_BYTES) in DEFAULT_BYTES:
        spark.conf.set(BATCH_BYTES, str(SMALL_BYTES))


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application, once; sessions get small batches."""
    small_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="docloom-")) / "docloom_sources.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)

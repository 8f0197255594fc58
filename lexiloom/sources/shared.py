"""What a session sets up: the folder that all executors share, the rows of an Arrow batch."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, or under a temporary folder where that is unset and Spark is local."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="lexiloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        top = "file://" + made
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch at most where results are many times larger than the texts.
BATCH_ROWS = 250


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))

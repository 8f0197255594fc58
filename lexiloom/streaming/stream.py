"""Identification of streams: the batch plan has no state, so that it serves as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identify import identify
from ..operators.options import IdentifyOptions
from ..sources.shared import shared_path


def identify_stream(stream: DataFrame, text_col: str = "text", options: IdentifyOptions = IdentifyOptions()) -> DataFrame:
    return identify(stream, text_col, options)


def language_mix(stream: DataFrame, time_col: str, text_col: str = "text", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Documents of each language and status in tumbling windows; rows later than the watermark are left out."""
    done = identify_stream(stream.withWatermark(time_col, late), text_col, IdentifyOptions(segments=False))
    return done.groupBy(F.window(time_col, window).alias("window"), "primary_language", "status").agg(F.count("*").alias("n"))


def run_to_table(spark: SparkSession, path: str, text_col: str = "text") -> DataFrame:
    """Read Parquet files as a stream, identify their rows, and return what the stream has written once it is through.

    path is a folder of files or one file.
    """
    batch = spark.read.parquet(path)
    folder, _, name = path.rpartition("/")
    single = any(f.rstrip("/").endswith(f"/{name}") for f in batch.inputFiles())
    reader = spark.readStream.schema(batch.schema)
    stream = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    done = identify_stream(stream, text_col, IdentifyOptions(segments=False)).select("doc_id", "status", "primary_language", "primary_variant")
    out = shared_path(spark, "stream")
    done.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{out}/rows")

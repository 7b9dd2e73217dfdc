"""The same aggregates over streams of run events and record blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.records import newest_block
from ..session import shared_dir


def event_stream(spark: SparkSession, folder: str, table: str, schema: T.StructType) -> DataFrame:
    """A table of a folder as a stream, whether it is one file or a folder of parts."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/{table}.parquet*")


def run_available(stream: DataFrame, apply, label: str, mode: str = "append") -> str:
    """Drive a stream over all that is there, handing each batch to ``apply``; returns its checkpoint folder."""
    at = f"{shared_dir(stream.sparkSession)}/{label}-{uuid.uuid4().hex}"
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(apply).start()
    run.awaitTermination()
    return at


def counted(stream: DataFrame, late: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """Events by day and type; state of a day is dropped once no event that late can come, which needs the output mode
    ``update`` or ``append``. Events later than that are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n_events"))


def upsert_newest(stream: DataFrame, keys: list[str], stamp: str, ord_col: str, label: str) -> DataFrame:
    """The newest block of every key after all batches: each batch keeps its own newest, the last step the newest of all.

    "Newest, then first read" can be merged in any grouping, so the batches may be cut anywhere and a batch run twice changes nothing.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        newest_block(batch, keys, stamp, ord_col).write.mode("overwrite").parquet(f"{at}/batch={epoch}")

    run_available(stream, keep, label)
    return newest_block(spark.read.parquet(at).drop("batch"), keys, stamp, ord_col)


def appended(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """What a stream emitted, as a table."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch={epoch}")

    run_available(stream, keep, label, mode)
    return spark.read.option("basePath", at).parquet(at)


def latest(emitted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The last value each key was emitted with, of a stream in update mode kept by :func:`appended`."""
    return emitted.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))

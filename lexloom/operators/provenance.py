"""Run events: what a run did, as an append-only table that is aggregated instead of a counter that is changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = "run_id string, ord long, event string, name string, detail string, count int"


def run_statistics(events: DataFrame) -> DataFrame:
    """(``run_id``, ``processed``, ``skipped``, ``inputs``, ``largest_output``): successes by document where they are logged,
    else the largest count of an output type; inputs default to processed and skipped."""
    outputs = events.where("event = 'output'").groupBy("run_id", "name").agg(F.sum(F.coalesce("count", F.lit(1))).alias("n"))
    largest = outputs.groupBy("run_id").agg(F.max("n").alias("largest_output"))
    seen = events.groupBy("run_id").agg(
        F.count_if(F.col("event") == "document").alias("documents"),
        F.count_if(F.col("event") == "skip").alias("skipped"),
        F.max(F.when(F.col("event") == "inputs", F.col("count"))).alias("given"),
    )
    done = F.coalesce(F.nullif("documents", F.lit(0)), "largest_output", F.lit(0))
    out = seen.join(largest, "run_id", "left").withColumn("processed", done)
    return out.select("run_id", "processed", "skipped", F.coalesce("given", F.col("processed") + F.col("skipped")).alias("inputs"), F.coalesce("largest_output", F.lit(0)).alias("largest_output"))


def used_components(events: DataFrame, components: DataFrame) -> DataFrame:
    """The components of every run that processed at least one document."""
    successful = events.where("event = 'document'").select("run_id").distinct()
    return components.join(successful, "run_id", "left_semi")


def quarantined(events: DataFrame) -> DataFrame:
    """(``run_id``, ``name``, ``detail``): inputs that were skipped and never processed later in the same run."""
    done = events.where("event = 'document'").select("run_id", "name", F.col("ord").alias("done_at"))
    skipped = events.where("event = 'skip'").select("run_id", "name", "detail", "ord")
    later = skipped.join(done, ["run_id", "name"]).where("done_at > ord").select("run_id", "name").distinct()
    return skipped.join(later, ["run_id", "name"], "left_anti").select("run_id", "name", "detail").distinct()

"""Run logs: counts, rates and merges."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_runs(runs: DataFrame) -> DataFrame:
    """One row a run; identical duplicates and rows without an id are dropped."""
    return runs.where("run_id is not null").dropDuplicates(["run_id"])


def output_counts(runs: DataFrame) -> DataFrame:
    """(``type``, ``n_outputs``, ``n_runs``): outputs by type over all runs."""
    return (
        runs.select(F.explode("statistics.output_counts_by_type").alias("type", "n"))
        .groupBy("type")
        .agg(F.sum("n").alias("n_outputs"), F.count("*").alias("n_runs"))
    )


def rates(runs: DataFrame) -> DataFrame:
    """(``run_id``, ``type``, ``n``, ``per_minute``): outputs a minute, 0 for runs without duration."""
    minutes = F.coalesce(F.col("duration_seconds"), F.lit(0.0)) / 60
    return runs.select("run_id", minutes.alias("m"), F.explode("statistics.output_counts_by_type").alias("type", "n")).select(
        "run_id", "type", "n", F.when(F.col("m") > 0, F.round(F.col("n") / F.col("m"), 4)).otherwise(0.0).alias("per_minute")
    )


def totals(runs: DataFrame) -> DataFrame:
    """Inputs and processed files of a run, derived where they are missing."""
    counts = F.map_values("statistics.output_counts_by_type")
    done = F.coalesce("statistics.successfully_processed", F.array_max(counts), F.lit(0))
    skipped = F.coalesce("statistics.skipped_files", F.size("skipped"), F.lit(0))
    return runs.select(
        "run_id",
        done.alias("processed"),
        F.greatest(skipped, F.lit(0)).alias("skipped"),
        F.coalesce("statistics.input_files_total", done + F.greatest(skipped, F.lit(0))).alias("inputs"),
    )


def merged(runs: DataFrame, keys: list[str], ord_col: str) -> DataFrame:
    """Stages of a group as one run: first inputs, last processed, sums, the earliest start and the latest end (as text), the
    outputs of all stages summed by type and all skips in the order of the stages. A group has as many stages as a pipeline."""
    entries = F.flatten(F.collect_list(F.map_entries("statistics.output_counts_by_type")))
    stages = F.sort_array(F.collect_list(F.struct(F.col(ord_col).alias("at"), F.coalesce("skipped", F.array().cast(runs.schema["skipped"].dataType)).alias("skipped"))))
    types = lambda e: F.array_sort(F.array_distinct(F.transform(e, lambda x: x["key"])))
    summed = lambda e, t: F.aggregate(F.filter(e, lambda x: x["key"] == t), F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x["value"], F.lit(0)))
    out = runs.groupBy(*keys).agg(
        F.count("*").alias("n_stages"),
        F.min_by("statistics.input_files_total", ord_col).alias("input_files_total"),
        F.max_by("statistics.successfully_processed", ord_col).alias("successfully_processed"),
        F.sum("statistics.skipped_files").alias("skipped_files"),
        F.round(F.sum("duration_seconds"), 3).alias("duration_seconds"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.min_by("tool_version", F.when(F.col("tool_version") != "", F.col(ord_col))).alias("tool_version"),
        entries.alias("_entries"),
        F.flatten(F.transform(stages, lambda s: s["skipped"])).alias("skipped"),
    )
    formats = F.map_from_entries(F.transform(types(F.col("_entries")), lambda t: F.struct(t.alias("type"), summed(F.col("_entries"), t).alias("n"))))
    return out.withColumn("formats", formats).drop("_entries")


def merged_steps(logs: DataFrame, keys: list[str], ord_col: str) -> DataFrame:
    """The logs of one input file as one: ``steps`` (program, version, run, duration, licence) in order, their number and the sum
    of their durations to three places. Their licences are united by ``licences``."""
    step = F.struct(F.col(ord_col).alias("ord"), "program", "tool_version", "run_id", "duration_seconds", "license")
    return logs.groupBy(*keys).agg(
        F.sort_array(F.collect_list(step)).alias("steps"),  # of one file
        F.count("*").alias("step_count"),
        F.round(F.sum(F.coalesce("duration_seconds", F.lit(0.0))), 3).alias("total_duration_seconds"),
    )


def repository(config: dict[str, str], program: str, table: dict[str, str], variable: str = "RUNNER_REPOSITORY", default: str = "") -> str:
    """Where the code of a program is: by the environment, the configuration, the table of programs, else ``default``."""
    return os.environ.get(variable) or config.get("repository_fallback") or table.get(program) or default


class RunLog:
    """A run's events, gathered by a driver and written once, also when the run fails; errors are never swallowed."""

    def __init__(self, run_id: str, program: str, write):
        self.run_id, self.program, self.write, self.events, self.done = run_id, program, write, [], False

    def __enter__(self):
        return self

    def __exit__(self, kind, error, trace) -> bool:
        if error is not None:
            self.log("error", name=kind.__name__, detail=str(error))
        self.finalise()
        return False

    def log(self, event: str, name: str | None = None, detail: str | None = None, count: int | None = None) -> None:
        self.events.append((self.run_id, len(self.events), event, name, detail, count))

    def finalise(self) -> None:
        if not self.done:
            self.done = True
            self.write(list(self.events))


def skips(runs: DataFrame) -> DataFrame:
    """(``reason``, ``n_skipped``, ``n_runs``): why files were left out."""
    return (
        runs.select("run_id", F.explode("skipped").alias("s"))
        .groupBy(F.col("s.reason").alias("reason"))
        .agg(F.count("*").alias("n_skipped"), F.count_distinct("run_id").alias("n_runs"))
    )

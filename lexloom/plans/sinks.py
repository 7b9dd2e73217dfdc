"""Queries over sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records
from ..session import load
from ..sinks import writers
from ..sources import xml_nodes
from .registry import query
from .sources import PREFIXES, _metadata_files


@query(
    """WITH u AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IS NOT NULL),
    n AS (SELECT user_id, event_type, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
    SELECT CAST(user_id AS VARCHAR) AS doc_id, '{' || string_agg('"' || event_type || '":' || props, ',' ORDER BY event_type) || '}' AS record FROM n GROUP BY user_id"""
)
def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest payload of every block as one document; none of these blocks is a known one, so they go by name."""
    events = load(spark, sf_dir, "events")
    newest = records.newest_block(events.withColumn("stamp", F.format_string("%012d", "event_id")), ["user_id", "event_type"], "stamp", "event_id")
    return writers.records(newest.select(F.col("user_id").cast("string").alias("doc_id"), F.col("event_type").alias("block"), F.col("props").alias("payload")))


@query("SELECT DISTINCT run_id || '_' || coalesce(program || '.json', '') AS name FROM runs WHERE run_id IS NOT NULL AND program IS NOT NULL")
def run_log_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.runs import distinct_runs

    return writers.run_logs(distinct_runs(load(spark, sf_dir, "runs")).where("program is not null")).select("name").distinct()


@query(
    """SELECT doc_id, 'EN:' || t AS text FROM (SELECT doc_id, replace(replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t
    FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(t, '\\S')"""
)
def metadata_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Described texts translated in place and read again from the rewritten files."""
    files = _metadata_files(spark, sf_dir).where("content is not null")
    hits = xml_nodes.fields(files, ["//amcr:dokument/amcr:popis"], PREFIXES)
    changes = hits.select("doc_id", "node_id", F.lit("text").alias("kind"), F.concat(F.lit("EN:"), "original").alias("value"), F.lit(0).alias("ord"))
    again = xml_nodes.fields(writers.rewritten(files, changes), ["//amcr:dokument/amcr:popis"], PREFIXES)
    return again.select("doc_id", F.col("original").alias("text"))

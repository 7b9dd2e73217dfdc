"""Queries over run events, fan-in and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import licences, provenance, records
from ..session import load
from ..sources import xml_nodes
from .records import _UNION, ORIGINS, _components
from .registry import query
from .sources import PREFIXES, _alto_files, _metadata_files

# Web events stand for run events: a user is a run, a purchase a processed document, an error a skip, a view an output.
_EVENTS = """SELECT CAST(user_id AS STRING) AS run_id, event_id AS ord,
    CASE event_type WHEN 'purchase' THEN 'document' WHEN 'error' THEN 'skip' WHEN 'view' THEN 'output' ELSE 'note' END AS event,
    props AS name, CAST(value AS STRING) AS detail, CAST(value AS INT) AS count FROM"""
_DUCK = _EVENTS.replace("AS STRING", "AS VARCHAR").replace("CAST(value AS INT)", "CAST(trunc(value) AS INTEGER)") + " events"


def _run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_EVENTS + " {events}", events=load(spark, sf_dir, "events"))


@query(
    f"""WITH e AS ({_DUCK}), o AS (SELECT run_id, name, sum(count) AS n FROM e WHERE event = 'output' GROUP BY ALL), l AS (SELECT run_id, max(n) AS largest FROM o GROUP BY ALL),
    s AS (SELECT run_id, count(*) FILTER (event = 'document') AS d, count(*) FILTER (event = 'skip') AS skipped FROM e GROUP BY run_id)
    SELECT run_id, CAST(CASE WHEN d > 0 THEN d ELSE coalesce(largest, 0) END AS BIGINT) AS processed, skipped,
           CAST(CASE WHEN d > 0 THEN d ELSE coalesce(largest, 0) END + skipped AS BIGINT) AS inputs, CAST(coalesce(largest, 0) AS BIGINT) AS largest_output
    FROM s LEFT JOIN l USING (run_id)"""
)
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.run_statistics(_run_events(spark, sf_dir))


@query(
    f"""WITH e AS ({_DUCK}), s AS (SELECT * FROM e WHERE event = 'skip')
    SELECT DISTINCT run_id, name FROM s WHERE NOT EXISTS (SELECT 1 FROM s x JOIN e d ON x.run_id = d.run_id AND x.name = d.name AND d.event = 'document' AND d.ord > x.ord
      WHERE x.run_id = s.run_id AND x.name = s.name)"""
)
def quarantined_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.quarantined(_run_events(spark, sf_dir)).select("run_id", "name").distinct()


@query(
    f"""WITH e AS ({_DUCK}), c AS (SELECT DISTINCT run_id, 'engine' AS name FROM e UNION ALL SELECT DISTINCT run_id, 'model' FROM e)
    SELECT run_id, name FROM c WHERE run_id IN (SELECT run_id FROM e WHERE event = 'document')"""
)
def run_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _run_events(spark, sf_dir)
    all_runs = events.select("run_id").distinct().withColumn("name", F.explode(F.array(F.lit("engine"), F.lit("model"))))
    return provenance.used_components(events, all_runs)


@query(
    """WITH p AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, CASE event_type WHEN 'click' THEN 'source' WHEN 'view' THEN 'derived_from' ELSE event_type END AS block,
      json_extract_string(props, '$.k') AS key, props AS payload, strftime(ts, '%Y-%m-%d') AS at, event_id AS ord FROM events),
    f AS (SELECT doc_id, block, key, payload FROM p WHERE block IN ('source', 'derived_from') AND payload IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY doc_id, block, key ORDER BY ord) = 1),
    n AS (SELECT doc_id, block, key, payload FROM p WHERE block NOT IN ('source', 'derived_from')
          QUALIFY row_number() OVER (PARTITION BY doc_id, block ORDER BY at DESC, ord) = 1)
    SELECT * FROM f UNION ALL SELECT * FROM n""".replace(" AS at,", " AS stamp,").replace("ORDER BY at DESC", "ORDER BY stamp DESC")
)
def record_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    block = F.when(F.col("event_type") == "click", "source").when(F.col("event_type") == "view", "derived_from").otherwise(F.col("event_type"))
    parts = events.select(
        F.col("user_id").cast("string").alias("doc_id"), block.alias("block"), F.get_json_object("props", "$.k").alias("key"),
        F.col("props").alias("payload"), F.date_format("ts", "yyyy-MM-dd").alias("updated_at"), F.col("event_id").alias("ord"),
    )
    return records.fan_in(parts)


@query("SELECT file, count(DISTINCT page) AS n_documents FROM scan_pages WHERE coalesce(page, '') <> '' GROUP BY file HAVING count(DISTINCT page) > 1")
def several_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.several_documents(load(spark, sf_dir, "scan_pages"), "file", "page")


@query(
    """WITH o AS (SELECT DISTINCT file AS doc_id, CASE WHEN ocr.engine IS NULL THEN 'digital-born-pdf' ELSE 'ocr:' || ocr.engine END AS origin FROM scan_pages),
    b AS (SELECT DISTINCT file AS doc_id, CASE WHEN category IS NULL THEN 'digital-convert' ELSE 'alto-postprocess' END AS program FROM scan_pages),
    asked AS (SELECT DISTINCT file AS doc_id FROM scan_pages WHERE needs_ocr)
    SELECT b.doc_id, program, origin FROM b JOIN o USING (doc_id) WHERE (program = 'digital-convert') <> (origin LIKE 'digital-born%')
      AND NOT (program = 'alto-postprocess' AND b.doc_id IN (SELECT doc_id FROM asked))"""
)
def originator_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "scan_pages")
    origin = F.when(F.col("ocr.engine").isNull(), "digital-born-pdf").otherwise(F.concat(F.lit("ocr:"), "ocr.engine"))
    origins = pages.select(F.col("file").alias("doc_id"), origin.alias("origin")).distinct()
    program = F.when(F.col("category").isNull(), "digital-convert").otherwise("alto-postprocess")
    blocks = pages.select(F.col("file").alias("doc_id"), program.alias("program")).distinct()
    asked = pages.where("needs_ocr").select(F.col("file").alias("doc_id"))
    return records.originator_audit(blocks, origins, ORIGINS, asked).select("doc_id", "program", "origin")


@query("SELECT doc_id, CASE WHEN trim(coalesce(file, '')) <> '' THEN file ELSE 'doc-' || doc_id END AS record_id FROM documents")
def inherited_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", records.inherited_id(F.col("file"), F.concat(F.lit("doc-"), "doc_id")).alias("record_id"))


@query(
    f"""WITH {_UNION}, e AS (SELECT file, arg_min(license, ord) FILTER (weight = worst) AS l FROM top GROUP BY file)
    SELECT file, l AS effective_license, l IN ('CC BY-NC 4.0', 'CC BY-NC-SA 4.0', 'glm-4') AS is_non_commercial,
    l IN ('CC BY-SA 4.0', 'CC BY-NC-SA 4.0', 'GPL-3.0', 'AGPL-3.0', 'LGPL-3.0', 'MPL 2.0') AS is_share_alike FROM e"""
)
def license_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = licences.distinct_components(_components(spark, sf_dir), ["file"])
    return licences.flagged(licences.effective(one, ["file"])).select("file", "effective_license", "is_non_commercial", "is_share_alike")


@query(
    """WITH k AS (SELECT run_id, map_keys(config) AS names FROM runs)
    SELECT DISTINCT run_id, coalesce(list_filter(names, lambda n: contains(lower(n), 'overlap'))[1], list_filter(names, lambda n: contains(lower(n), 'chunk'))[1]) AS field FROM k"""
)
def field_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the settings of every run the first that speaks of the overlap, else of chunks."""
    names = F.map_keys("config")
    return load(spark, sf_dir, "runs").select("run_id", fx.first_field(names, ["OVERLAP", "chunk"]).alias("field")).distinct()


@query(
    r"""WITH d AS (SELECT doc_id, trim(replace(replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS t FROM documents WHERE regexp_matches(text, '\S')),
    w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)
    SELECT 'f' || doc_id || '.alto.xml' AS file, 'alto' AS kind, 'block0' AS id, array_to_string(w, ' ') AS src FROM w WHERE len(w) > 0
    UNION ALL SELECT 'f' || doc_id || '.xml', 'metadata', 'field0', t FROM d"""
)
def evaluation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda suffix: F.concat(F.lit("f"), "doc_id", F.lit(suffix)).alias("name")
    files = _alto_files(spark, sf_dir).select(name(".alto.xml"), "content").unionByName(
        _metadata_files(spark, sf_dir).where("content is not null").select(name(".xml"), "content")
    )
    return xml_nodes.evaluation_segments(files, ["//amcr:dokument/amcr:popis"], PREFIXES)

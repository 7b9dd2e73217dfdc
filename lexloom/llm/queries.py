"""The queries of this package by name, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, materialize, release
from . import cut_off, language, leaks, packing, pairs, pieces, scans, visual_forms


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = visual_forms.lookalike_pairs(load(spark, sf_dir, "qa_log"), "seg_id", "text_auto", 40, materialize)
    return pairs.select(F.col("a").alias("seg_a"), F.col("b").alias("seg_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class of texts that look the same: its representative (the first row), its rows and its spellings."""
    rows = visual_forms.lookalike_classes(load(spark, sf_dir, "qa_log"), "seg_id", "text_auto", 40).distinct()
    by = rows.groupBy(F.hex("form_id").alias("form_id"), "text_id").agg(F.min("k").alias("k"), F.count("*").alias("n"))
    return by.groupBy("form_id").agg(F.min("k").alias("representative"), F.sum("n").alias("n_rows"), F.count("*").alias("n_spellings"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces.oversized_pieces(load(spark, sf_dir, "qa_log"), load(spark, sf_dir, "runs"), "seg_id", "text_auto")
    kind = F.when(F.col("cut.longest_stretch") > F.col("chunk_limit"), "solid").otherwise("plain")
    return cut.where(F.size("cut.pieces") > 1).select("seg_id", kind.alias("cut")).distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces.oversized_pieces(load(spark, sf_dir, "qa_log"), load(spark, sf_dir, "runs"), "seg_id", "text_auto")
    one = cut.dropDuplicates(["seg_id"]).select("seg_id", "chunk_limit", "chunk_overlap", F.inline("cut.pieces"))
    return one.withColumnRenamed("text", "piece_text")


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "scan_pages").select(
        "file", (F.col("page_index") + 1).alias("page_num"), F.col("page").alias("label")
    )
    return scans.repair(load(spark, sf_dir, "qa_log"), labels, "seg_id", "text_auto", "file", "page_num", materialize, release)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noise(_repaired(spark, sf_dir)).select(F.col("k").alias("seg_id"), "noise").distinct()


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).select(F.col("k").alias("seg_id"), F.col("text").alias("paragraphs")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.train(load(spark, sf_dir, "documents"))
    found = language.wrong_labels(load(spark, sf_dir, "qa_log"), model, "seg_id", "text_auto", "lang", 40)
    return found.select(F.col("k").alias("seg_id"), "lang")


def p4_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.train(load(spark, sf_dir, "documents"))
    found = language.stretches(load(spark, sf_dir, "qa_log"), model, "seg_id", "text_auto", "lang")
    return found.select(F.col("k").alias("seg_id"), "lang", "confidence", "start", "end", "n_languages").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "qa_log")
    found = pairs.defective(log, pairs.fit(log, "seg_id", "text_auto", "text_en"), "seg_id", "text_auto", "text_en")
    return found.select(F.col("k").alias("seg_id"), "defect").distinct()


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kinds = load(spark, sf_dir, "documents"), load(spark, sf_dir, "containers")
    return packing.pack(docs, kinds, "doc_id", "text", "source", materialize)


def p6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.mixtures(p6_pack(spark, sf_dir))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fills(p6_pack(spark, sf_dir))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_rows"), "doc_id", "text", "id", "src")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select(F.col("k").alias("doc_id"), "item_id").distinct()


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).withColumnRenamed("k", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_off.find_cut(load(spark, sf_dir, "documents"), "doc_id", "text", "source", materialize)
    return found.where("is_cut").select(F.col("k").alias("doc_id")).distinct()


def p8_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``p8_found`` with what tells that they are cut."""
    found = cut_off.find_cut(load(spark, sf_dir, "documents"), "doc_id", "text", "source", materialize)
    return found.where("is_cut").select(F.col("k").alias("doc_id"), "source", "reason").distinct()


def p8_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_off.cut_share(
        cut_off.find_cut(load(spark, sf_dir, "documents"), "doc_id", "text", "source", materialize)
    ).drop("field")


def p8_log_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share cut of each column of the log, by file: at spikes only."""
    log = load(spark, sf_dir, "qa_log").dropDuplicates(["seg_id"])
    return cut_off.cut_share(cut_off.find_cut(log, "seg_id", ["text_auto", "text_en"], "file", materialize, False))


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_paragraphs": p3_paragraphs,
    "p4_found": p4_found,
    "p4_stretches": p4_stretches,
    "p5_found": p5_found,
    "p6_pack": p6_pack,
    "p6_fill": p6_fill,
    "p6_mixture": p6_mixture,
    "p7_found": p7_found,
    "p7_spans": p7_spans,
    "p8_found": p8_found,
    "p8_share": p8_share,
    "p8_reasons": p8_reasons,
    "p8_log_share": p8_log_share,
}

#: SQL where DuckDB can state the same result over whole tables in reasonable time.
ORACLE_SQL = {
    "p2_found": r"""
        WITH lim AS (
          SELECT run_id, max(TRY_CAST(config['chunk_limit'] AS INTEGER)) AS l FROM runs WHERE run_id IS NOT NULL GROUP BY run_id
        ), rows AS (
          SELECT seg_id, text_auto, coalesce(l, 4000) AS l FROM qa_log LEFT JOIN lim USING (run_id)
        ), big AS (SELECT * FROM rows WHERE length(text_auto) > l)
        SELECT DISTINCT seg_id,
               CASE WHEN list_max(list_transform(
                      regexp_split_to_array(text_auto, '[\s\v\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'),
                      lambda x: length(x))) > l THEN 'solid' ELSE 'plain' END AS cut
        FROM big""",
}

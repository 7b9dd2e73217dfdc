"""Queries over document layout and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ws_split
from ..operators import chunk, layout
from ..session import load
from .oracles import BUCKETS, LINES, WS
from .registry import query


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.with_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line): every line with its words and its share of the block as the marking backend returns it."""
    blocks = _blocks(spark, sf_dir)
    tokens = ws_split(F.concat(F.lit("EN: "), layout.block_text(F.col("lines"))))
    dealt = blocks.select("doc_id", "lines", layout.proportional_buckets(F.col("lines"), tokens).alias("b"))
    return dealt.select("doc_id", F.inline(F.arrays_zip(F.col("lines"), F.col("b")))).select(
        "doc_id", F.col("lines.line_idx").alias("line_idx"), F.col("lines.words").alias("words"), F.col("b.tokens").alias("tokens")
    )


@query(
    f"""WITH {LINES} SELECT doc_id, array_to_string(flatten(list(words ORDER BY line_idx)), ' ') AS block_text,
    CAST(count(*) AS INTEGER) AS n_lines, CAST(sum(len(words)) AS INTEGER) AS n_words FROM lines GROUP BY doc_id"""
)
def block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.col("lines")
    n = F.aggregate(lines, F.lit(0), lambda a, x: a + F.size(x["words"]))
    return _blocks(spark, sf_dir).select("doc_id", layout.block_text(lines).alias("block_text"), F.size(lines).alias("n_lines"), n.alias("n_words"))


@query(
    f"""WITH {LINES} SELECT doc_id, line_idx, CAST(line_idx AS VARCHAR) AS line_id, CAST(len(words) AS INTEGER) AS n_words
    FROM lines"""
)
def line_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("doc_id", F.inline("lines")).select(
        "doc_id", "line_idx", F.col("line_idx").cast("string").alias("line_id"), F.size("words").alias("n_words")
    )


@query(f"WITH {BUCKETS} SELECT doc_id, line_idx, array_to_string(bucket, ' ') AS bucket FROM buckets")
def proportional_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _buckets(spark, sf_dir).select("doc_id", "line_idx", F.array_join("tokens", " ").alias("bucket"))


@query(
    f"""WITH {BUCKETS}, s AS (SELECT doc_id, line_idx, words, bucket, unnest(generate_series(1, len(words))) AS i FROM buckets)
    SELECT doc_id, line_idx, CAST(i AS INTEGER) AS str_idx,
           CASE WHEN i = len(words) THEN array_to_string(bucket[i:], ' ') ELSE coalesce(bucket[i], '') END AS content FROM s"""
)
def string_redistribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = _buckets(spark, sf_dir).select("doc_id", "line_idx", F.posexplode(layout.onto_strings(F.col("words"), F.col("tokens"))))
    return dealt.select("doc_id", "line_idx", (F.col("pos") + 1).cast("int").alias("str_idx"), F.col("col").alias("content"))


@query(
    f"""WITH {BUCKETS} SELECT 'doc-' || doc_id AS file, 1 AS page_num, CAST(line_idx AS VARCHAR) AS line_num,
    array_to_string(words, ' ') AS text_src, array_to_string(bucket, ' ') AS text_tgt
    FROM buckets WHERE len(words) > 0 OR len(bucket) > 0"""
)
def qa_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _buckets(spark, sf_dir)
        .where("size(words) > 0 or size(tokens) > 0")
        .select(
            F.concat(F.lit("doc-"), F.col("doc_id")).alias("file"),
            F.lit(1).alias("page_num"),
            F.col("line_idx").cast("string").alias("line_num"),
            F.array_join("words", " ").alias("text_src"),
            F.array_join("tokens", " ").alias("text_tgt"),
        )
    )


@query()
def anchored_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _blocks(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("EN: "), layout.block_text(F.col("lines"))).alias("block"),
        F.transform("lines", lambda x: F.array_join(x["words"], " ")).alias("anchors"),
    )
    return layout.anchored_buckets(lines, "doc_id", "block", "anchors")


def _chunk_sql(size: int, select: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    least = size // 4

    def rfind(mark: str) -> str:
        m = "chr(10)" if mark == "\n" else f"'{mark}'"
        r = "chr(10)" if mark == "\n" else f"'{mark[::-1]}'"
        return f"CASE WHEN contains(w, {m}) THEN length(w) - strpos(reverse(w), {r}) - {len(mark)} + 1 ELSE -1 END"

    def tier(*marks: str) -> str:
        return "greatest(" + ", ".join(f"CASE WHEN {rfind(m)} > {least} THEN {rfind(m)} + 1 ELSE -1 END" for m in marks) + ")"

    strip = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
    cut = f"""CASE WHEN {rfind(chr(10))} > {least} THEN {rfind(chr(10))} WHEN {tier(". ", "! ", "? ")} > 0 THEN {tier(". ", "! ", "? ")}
              WHEN {tier("; ", ", ")} > 0 THEN {tier("; ", ", ")} WHEN {rfind(" ")} > 0 THEN {rfind(" ")} ELSE {size} END"""
    return f"""WITH RECURSIVE step(k, i, chunk, rest) AS (
        SELECT {key}, -1, CAST(NULL AS VARCHAR), {strip(text)} FROM {table} WHERE {text} IS NOT NULL
        UNION ALL
        SELECT k, i + 1, {strip("substr(rest, 1, cut_at)")}, CASE WHEN cut_at >= length(rest) THEN '' ELSE regexp_replace(substr(rest, cut_at + 1), '^{WS}+', '') END
        FROM (SELECT k, i, rest, CASE WHEN length(rest) <= {size} THEN length(rest) ELSE {cut} END AS cut_at
              FROM (SELECT k, i, rest, substr(rest, 1, {size}) AS w FROM step WHERE rest <> '') a) b
    ), chunks AS (SELECT k AS {key}, CAST(i AS INTEGER) AS chunk_idx, chunk FROM step WHERE i >= 0 AND chunk <> '')
    {select}"""


@query(_chunk_sql(4000, "SELECT * FROM chunks"))
def chunk_text_4000(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunked(load(spark, sf_dir, "documents"), "doc_id", "text", 4000)


@query(_chunk_sql(400, "SELECT * FROM chunks"))
def chunk_text_400(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunked(load(spark, sf_dir, "documents"), "doc_id", "text", 400)


@query(
    _chunk_sql(
        400,
        """SELECT doc_id, CAST(count(*) AS BIGINT) AS n_chunks, CAST(max(length(chunk)) AS INTEGER) AS longest,
           CAST(sum(length(chunk)) AS BIGINT) AS n_chars FROM chunks GROUP BY doc_id""",
    )
)
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chunk.chunked(load(spark, sf_dir, "documents"), "doc_id", "text", 400)
    return parts.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.max(F.length("chunk")).alias("longest"), F.sum(F.length("chunk")).alias("n_chars")
    )



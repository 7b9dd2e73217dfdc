"""Queries over translation quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import evaluation, glossary
from ..session import load
from .language import _VOCAB
from .oracles import trim, words
from .registry import query


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "eval_rows").select("file", "id", "backend", "src", "tgt").distinct()
    return rows.withColumn("seg", F.concat_ws("|", "file", "id", "backend", F.md5(F.coalesce("tgt", F.lit("")))))


@query(
    r"""WITH n AS (SELECT DISTINCT seg_id, text_auto, text_en, regexp_extract_all(text_auto, '[0-9]+(?:[.,][0-9]+)*') AS nums FROM qa_log WHERE text_auto IS NOT NULL AND text_en IS NOT NULL)
    SELECT seg_id, CASE WHEN len(nums) > 0 THEN round(CAST(len(list_filter(nums, lambda x: contains(text_en, x))) AS DOUBLE) / len(nums), 4) END AS kept FROM n"""
)
def number_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "qa_log").where("text_auto is not null and text_en is not null")
    return log.select("seg_id", fx.number_preservation(F.col("text_auto"), F.col("text_en")).alias("kept")).distinct()


@query(
    f"""SELECT DISTINCT seg_id, CASE WHEN {trim("text_auto")} <> '' THEN round(CAST(length({trim("text_en")}) AS DOUBLE) / length({trim("text_auto")}), 4) END AS ratio
    FROM qa_log WHERE text_auto IS NOT NULL AND text_en IS NOT NULL"""
)
def length_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "qa_log").where("text_auto is not null and text_en is not null")
    return log.select("seg_id", fx.length_ratio(F.col("text_auto"), F.col("text_en")).alias("ratio")).distinct()


@query()
def char_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    return rows.select("file", "id", "backend", evaluation.char_similarity(F.col("src"), F.col("tgt")).alias("similarity"))


@query()
def pairwise_backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.pairwise(_segments(spark, sf_dir))


@query(
    f"""WITH {_VOCAB}, seg AS (SELECT DISTINCT file, id, backend, src, tgt FROM eval_rows)
    SELECT file, id, backend, CAST(count(*) FILTER (contains(lower(tgt), lower(target))) AS BIGINT) AS term_hits, count(*) AS term_expected
    FROM seg JOIN terms ON contains(lower(src), term) GROUP BY file, id, backend, tgt"""
)
def term_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _segments(spark, sf_dir)
    hits = evaluation.term_hits(segments, glossary.clean(load(spark, sf_dir, "vocab")), glossary.matches)
    return segments.join(hits, "seg").select("file", "id", "backend", "term_hits", "term_expected")


@query(
    f"""WITH s AS (SELECT *, regexp_extract_all(src, '[0-9]+(?:[.,][0-9]+)*') AS nums FROM eval_rows),
    k AS (SELECT *, CASE WHEN len(nums) > 0 THEN round(CAST(len(list_filter(nums, lambda x: contains(coalesce(tgt, ''), x))) AS DOUBLE) / len(nums), 4) END AS kept FROM s)
    SELECT backend, count(*) AS n_segments, CAST(sum(CASE WHEN coalesce({trim("tgt")}, '') = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_empty,
    CAST(sum(term_hits) AS BIGINT) AS term_hits, CAST(sum(term_expected) AS BIGINT) AS term_expected,
    round(CASE WHEN sum(term_expected) > 0 THEN CAST(sum(term_hits) AS DOUBLE) / sum(term_expected) END, 6) AS term_hit_rate,
    round(avg(kept), 6) AS number_preservation FROM k GROUP BY backend"""
)
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(load(spark, sf_dir, "eval_rows"))


@query(
    """WITH r AS (SELECT file || ':' || id AS file_id, min(tgt) AS reference FROM eval_rows WHERE backend = 'remote_nmt' GROUP BY 1),
    s AS (SELECT DISTINCT file, id, backend FROM eval_rows)
    SELECT s.file, s.id, s.backend, r.reference FROM s LEFT JOIN r ON s.file || ':' || s.id = r.file_id"""
)
def refs_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "eval_rows")
    key = F.concat(F.col("file"), F.lit(":"), F.col("id"))
    refs = rows.where("backend = 'remote_nmt'").groupBy(key.alias("file_id")).agg(F.min("tgt").alias("reference"))
    return rows.select("file", "id", "backend").distinct().join(refs, key == F.col("file_id"), "left").select("file", "id", "backend", "reference")


_SCORED = """
    seg AS (SELECT DISTINCT file, id, backend, src, tgt FROM eval_rows),
    refs AS (SELECT file, id, min(tgt) AS reference FROM seg WHERE backend = 'remote_nmt' GROUP BY ALL),
    pairs AS MATERIALIZED (SELECT row_number() OVER () AS i, file, id, backend, coalesce(tgt, '') AS h, coalesce(reference, '') AS r FROM seg JOIN refs USING (file, id))"""


def _against_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir)
    refs = rows.where("backend = 'remote_nmt'").groupBy("file", "id").agg(F.min("tgt").alias("reference"))
    return rows.join(refs, ["file", "id"]).withColumns({"h": F.coalesce("tgt", F.lit("")), "r": F.coalesce("reference", F.lit(""))})


@query(
    f"""WITH {_SCORED},
    bare AS (SELECT i, array_to_string({words("h")}, '') AS h, array_to_string({words("r")}, '') AS r FROM pairs),
    sides AS (SELECT i, 'h' AS side, h AS t FROM bare UNION ALL SELECT i, 'r', r FROM bare),
    places AS (SELECT i, side, t, n, unnest(generate_series(1, length(t) - n + 1)) AS k FROM sides, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS n)),
    grams AS (SELECT i, n, substr(t, k, n) AS g, count(*) FILTER (side = 'h') AS a, count(*) FILTER (side = 'r') AS b FROM places GROUP BY i, n, substr(t, k, n)),
    ratios AS (SELECT i, n, sum(least(a, b)) / sum(a) AS p, sum(least(a, b)) / sum(b) AS q FROM grams GROUP BY i, n HAVING sum(a) > 0 AND sum(b) > 0),
    means AS (SELECT i, avg(p) AS p, avg(q) AS q FROM ratios GROUP BY i)
    SELECT file, id, backend, CASE WHEN p + q > 0 THEN round(100 * 5 * p * q / (4 * p + q), 2) ELSE 0.0 END AS chrf FROM pairs LEFT JOIN means USING (i)"""
)
def chrf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character n-gram F-score of every backend's translation against the first backend's."""
    return _against_first(spark, sf_dir).select("file", "id", "backend", evaluation.chrf(F.col("h"), F.col("r")).alias("chrf"))


_MT = r"""string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    ' ' || replace(replace(replace(replace(replace(replace(replace({0}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ',
    '([\{{-~\[-` -&(-+:-@/])', ' \1 ', 'g'), '([^0-9])([.,])', '\1 \2 ', 'g'), '([.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'),
    '[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')), ' ')"""


@query(
    f"""WITH {_SCORED},
    tokens AS (SELECT i, list_filter({_MT.format("h")}, lambda x: x <> '') AS h, list_filter({_MT.format("r")}, lambda x: x <> '') AS r FROM pairs),
    sides AS (SELECT i, 'h' AS side, h AS t FROM tokens UNION ALL SELECT i, 'r', r FROM tokens),
    places AS (SELECT i, side, t, n, unnest(generate_series(1, len(t) - n + 1)) AS k FROM sides, (SELECT unnest([1, 2, 3, 4]) AS n)),
    grams AS (SELECT i, n, t[k : k + n - 1] AS g, count(*) FILTER (side = 'h') AS a, count(*) FILTER (side = 'r') AS b FROM places GROUP BY i, n, t[k : k + n - 1]),
    hits AS (SELECT i, n, sum(least(a, b)) AS m, sum(a) AS total FROM grams GROUP BY i, n HAVING sum(a) > 0),
    smooth AS (SELECT *, count(*) FILTER (m = 0) OVER (PARTITION BY i ORDER BY n) AS misses FROM hits),
    logs AS (SELECT i, avg(ln(CASE WHEN m > 0 THEN m / total ELSE 1 / (pow(2, misses) * total) END)) AS l, sum(m) AS m FROM smooth GROUP BY i)
    SELECT file, id, backend, CASE WHEN m > 0 THEN round(100 * exp(l + CASE WHEN len(t.h) < len(t.r) THEN 1 - len(t.r) / len(t.h) ELSE 0 END), 2) ELSE 0.0 END AS bleu
    FROM pairs JOIN tokens t USING (i) LEFT JOIN logs USING (i)"""
)
def bleu_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence BLEU of every backend's translation against the first backend's."""
    return _against_first(spark, sf_dir).select("file", "id", "backend", evaluation.bleu(F.col("h"), F.col("r")).alias("bleu"))

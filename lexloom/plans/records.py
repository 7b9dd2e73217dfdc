"""Queries over records, licences and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_doc_id as canonical_name
from ..functions.text import record_doc_id
from ..operators import licences, records, runs
from ..session import load
from .registry import query

_NAME = "'/data/in/' || coalesce(file, source) || CASE kind WHEN 'report' THEN '.alto.xml' WHEN 'note' THEN '.Document.JSON' WHEN 'catalogue' THEN '.page.bin' ELSE '' END"


@query(
    f"""SELECT doc_id, regexp_replace({_NAME}, '^.*/', '') AS name,
    CASE WHEN kind IN ('report', 'note') THEN coalesce(file, source) ELSE split_part(coalesce(file, source), '.', 1) END AS canonical
    FROM documents"""
)
def canonical_doc_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.expr(_NAME).alias("path"))
    return docs.select("doc_id", F.substring_index("path", "/", -1).alias("name"), canonical_name(F.col("path")).alias("canonical"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'r' || doc_id WHEN 1 THEN 's' || doc_id ELSE '' END AS record_id FROM documents")
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of records that name them in one way, the other, both or none."""
    n = F.pmod("doc_id", F.lit(3))
    r, s = F.concat(F.lit("r"), "doc_id"), F.concat(F.lit("s"), "doc_id")
    record = F.to_json(F.struct(F.when(n == 0, r).alias("doc_id"), F.when(n < 2, s).alias("id"), F.col("kind").alias("kind")))
    return load(spark, sf_dir, "documents").select("doc_id", record_doc_id(record).alias("record_id"))


_PAGES_E = "SELECT DISTINCT file, page, category, quality_score FROM scan_pages"
_PAGES_I = "SELECT DISTINCT file, page, 'TEXT' AS category, CAST(NULL AS DOUBLE) AS quality_score FROM scan_pages WHERE needs_ocr OR category IS NULL"


@query(
    f"""WITH e AS ({_PAGES_E}), i AS ({_PAGES_I} UNION ALL SELECT DISTINCT file, 'cover', 'COVER', 0.5 FROM scan_pages)
    SELECT coalesce(e.file, i.file) AS file, coalesce(e.page, i.page) AS page,
           CASE WHEN i.file IS NOT NULL THEN i.category ELSE e.category END AS category,
           CASE WHEN i.page = 'cover' THEN i.quality_score ELSE e.quality_score END AS quality_score
    FROM e FULL JOIN i ON e.file = i.file AND e.page IS NOT DISTINCT FROM i.page"""
)
def merge_block_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier sets the category of pages that need recognition or have none, and adds a cover page to every file."""
    pages = load(spark, sf_dir, "scan_pages")
    existing = pages.select("file", "page", "category", "quality_score").distinct()
    none = F.lit(None).cast("double")
    change = pages.where("needs_ocr or category is null").select("file", "page", F.lit("TEXT").alias("category"), none.alias("quality_score")).distinct()
    cover = pages.select("file", F.lit("cover").alias("page"), F.lit("COVER").alias("category"), F.lit(0.5).alias("quality_score")).distinct()
    incoming = change.withColumn("present", F.array(F.lit("category"))).unionByName(
        cover.withColumn("present", F.array(F.lit("category"), F.lit("quality_score")))
    )
    return records.upserted(existing, incoming, ["file", "page"], ["category", "quality_score"])


# Who may write which block, and which fields of the pages block.
OWNERS = [
    ("pages", "alto-postprocess"), ("pages", "digital-convert"), ("content", "alto-postprocess"), ("content", "digital-convert"),
    ("lines", "alto-postprocess"), ("lines", "digital-convert"), ("tables", "alto-postprocess"), ("tables", "digital-convert"),
    ("page_categories", "page-classification"), ("translations", "translator"), ("entities", "nlp-enrich"),
    ("enrichment", "llm-enrich"), ("forms", "llm-enrich"),
]
GRANTS = [
    ("alto-postprocess", "pages", f)
    for f in ("page_index", "quality_score", "quality_band", "needs_ocr", "needs_ocr_reason", "ocr", "canvas")
] + [("page-classification", "pages", f) for f in ("category", "category_confidence")]
ORIGINS = [
    ("digital-born", "digital-convert"), ("docx", "digital-convert"), ("pdf", "digital-convert"),
    ("ABBYY-ALTO", "alto-postprocess"), ("ocr:", "alto-postprocess"), ("vlm:", "alto-postprocess"),
]

_FIELDS = ("quality_score", "category", "canvas", "teitok_surface")
_LONG = " UNION ALL ".join(
    f"SELECT DISTINCT file, page, '{p}' AS program, 'pages' AS block, '{f}' AS field FROM scan_pages"
    for p in ("alto-postprocess", "page-classification")
    for f in _FIELDS
)
_GRANTED = ", ".join(f"('{p}', '{b}', '{f}')" for p, b, f in GRANTS)


def _page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    programs = F.array(F.lit("alto-postprocess"), F.lit("page-classification"))
    pages = load(spark, sf_dir, "scan_pages").select("file", "page").distinct()
    return pages.withColumn("program", F.explode(programs)).withColumn("block", F.lit("pages")).withColumn(
        "field", F.explode(F.array(*[F.lit(f) for f in _FIELDS]))
    )


def _grants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRANTS, "program string, block string, field string")


_SHOWN = ["file", "page", "program", "field"]


@query(f"WITH g(program, block, field) AS (VALUES {_GRANTED}), l AS ({_LONG}) SELECT file, page, program, field FROM l SEMI JOIN g USING (program, block, field)")
def field_grant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.granted_fields(_page_fields(spark, sf_dir), _grants(spark)).select(*_SHOWN)


@query(f"WITH g(program, block, field) AS (VALUES {_GRANTED}), l AS ({_LONG}) SELECT file, page, program, field FROM l ANTI JOIN g USING (program, block, field)")
def dropped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.dropped_fields(_page_fields(spark, sf_dir), _grants(spark)).select(*_SHOWN)


_WRITES = """SELECT event_id, CASE event_type WHEN 'view' THEN 'pages' WHEN 'click' THEN 'translations' WHEN 'purchase' THEN 'forms'
    WHEN 'signup' THEN 'summary' ELSE 'lines' END AS block,
    CASE WHEN value < 50 THEN 'translator' WHEN value < 100 THEN 'alto-postprocess' ELSE 'llm-enrich' END AS program"""


@query(
    f"""WITH o(block, program) AS (VALUES {", ".join(f"('{b}', '{p}')" for b, p in OWNERS)}), w AS ({_WRITES} FROM events)
    SELECT event_id, block, program FROM w WHERE block IN (SELECT block FROM o)
      AND NOT EXISTS (SELECT 1 FROM o WHERE o.block = w.block AND o.program = w.program)"""
)
def owner_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = spark.sql(_WRITES + " FROM {events}", events=load(spark, sf_dir, "events"))
    owners = spark.createDataFrame(OWNERS, "block string, program string")
    return records.owner_violations(writes, owners).select("event_id", "block", "program")


@query(
    f"""WITH o(block, program) AS (VALUES {", ".join(f"('{b}', '{p}')" for b, p in OWNERS)}), g(program, block, field) AS (VALUES {_GRANTED}),
    w AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'assembled' ELSE block END AS block, program FROM ({_WRITES} FROM events))
    SELECT event_id, block, program, block = 'assembled' AS is_reserved,
      EXISTS (SELECT 1 FROM o WHERE o.block = w.block) AND NOT EXISTS (SELECT 1 FROM o WHERE o.block = w.block AND o.program = w.program) AS is_foreign,
      CASE WHEN block = 'pages' THEN 'page-classification' ELSE '' END AS others FROM w"""
)
def write_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be said of writes of whole blocks: reserved, foreign, or at the cost of a co-contributor's fields."""
    writes = spark.sql(_WRITES + " FROM {events}", events=load(spark, sf_dir, "events"))
    writes = writes.withColumn("block", F.when(F.col("event_id") % 7 == 0, "assembled").otherwise(F.col("block")))
    verdicts = records.write_verdicts(writes, spark.createDataFrame(OWNERS, "block string, program string"), _grants(spark))
    return verdicts.withColumn("others", F.array_join("others", ","))


@query(
    """WITH b AS (SELECT DISTINCT file AS doc_id, page AS record FROM scan_pages WHERE page_index = 0), p AS (SELECT DISTINCT file AS doc_id FROM qa_log)
    SELECT p.doc_id, record, record IS NOT NULL AS had_baseline FROM p LEFT JOIN b USING (doc_id)"""
)
def record_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of logged files on the record of their first scanned page, where there is one."""
    base = load(spark, sf_dir, "scan_pages").where("page_index = 0").select(F.col("file").alias("doc_id"), F.col("page").alias("record")).distinct()
    return records.opened(load(spark, sf_dir, "qa_log").select(F.col("file").alias("doc_id")).distinct(), base)


@query(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, event_type AS block, max(event_id) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL)
    SELECT doc_id, block, CASE WHEN block = 'click' THEN 'new' ELSE CAST(n AS VARCHAR) END AS payload, CASE WHEN block = 'click' THEN 'translator' ELSE 'reader' END AS program,
      CASE WHEN block = 'click' THEN '2026-01-01' ELSE '2025-01-01' END AS updated_at FROM e"""
)
def block_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block of every record replaced whole and stamped."""
    rows = load(spark, sf_dir, "events").where("event_type is not null").groupBy(F.col("user_id").cast("string").alias("doc_id"), F.col("event_type").alias("block"))
    there = rows.agg(F.max("event_id").cast("string").alias("payload")).withColumns({"program": F.lit("reader"), "updated_at": F.lit("2025-01-01")})
    new = there.where("block = 'click'").withColumn("payload", F.lit("new"))
    return records.replaced(there, new, "translator", F.lit("2026-01-01"))


@query("SELECT user_id, event_type, arg_max(props, event_id) AS props FROM events WHERE props IS NOT NULL GROUP BY ALL")
def key_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within one record the last entry of a key counts."""
    return records.last_writer(load(spark, sf_dir, "events").where("props is not null"), ["user_id", "event_type"], "props", "event_id")


@query(
    """WITH e AS (SELECT DISTINCT file, ocr.engine AS engine FROM scan_pages),
    o AS (SELECT file, engine, CASE WHEN engine LIKE 'engine-a%' THEN 'OCR:' || engine WHEN engine IS NULL THEN 'Digital-Born-PDF' ELSE engine END AS origin FROM e)
    SELECT file, engine, origin, CASE WHEN lower(origin) LIKE 'digital-born%' THEN 'digital-convert' WHEN lower(origin) LIKE 'ocr:%' THEN 'alto-postprocess' END AS originator FROM o"""
)
def origin_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    engines = load(spark, sf_dir, "scan_pages").select("file", F.col("ocr.engine").alias("engine")).distinct()
    origin = F.when(F.col("engine").startswith("engine-a"), F.concat(F.lit("OCR:"), "engine")).when(F.col("engine").isNull(), "Digital-Born-PDF").otherwise(F.col("engine"))
    return engines.withColumn("origin", origin).withColumn("originator", records.originator(F.col("origin"), ORIGINS))


@query(
    """SELECT user_id, arg_min(event_type, event_id) AS event_type, count(DISTINCT event_type) > 1 AS has_conflict, count(*) AS n_writers
    FROM events WHERE event_type IS NOT NULL GROUP BY user_id"""
)
def source_first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.first_writer(load(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT user_id, count(DISTINCT event_type) AS n_values FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def source_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("n_values")).where("n_values > 1")


@query(
    """SELECT user_id, event_type, event_id, props FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY coalesce(strftime(ts, '%Y-%m-%d'), '') DESC, event_id) = 1"""
)
def newest_block_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = load(spark, sf_dir, "events").withColumn("stamp", F.date_format("ts", "yyyy-MM-dd"))
    return records.newest_block(blocks, ["user_id", "event_type"], "stamp", "event_id").select("user_id", "event_type", "event_id", "props")


@query("SELECT user_id, json_extract_string(props, '$.k') AS ref, min(event_id) AS first_event FROM events GROUP BY 1, 2")
def derived_from_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = load(spark, sf_dir, "events").withColumn("ref", F.get_json_object("props", "$.k"))
    return refs.groupBy("user_id", "ref").agg(F.min("event_id").alias("first_event"))


@query(
    """WITH f AS (SELECT user_id, event_type, min(event_id) AS seen FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2)
    SELECT user_id, string_agg(event_type, ',' ORDER BY seen) AS contributors FROM f GROUP BY user_id"""
)
def contributors_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.ordered_distinct(load(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", "contributors")


@query(
    """WITH w AS (SELECT DISTINCT file, page FROM scan_pages), h AS (SELECT DISTINCT file, page FROM scan_pages WHERE quality_score IS NOT NULL)
    SELECT w.file, w.page FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.file = w.file AND h.page IS NOT DISTINCT FROM w.page)"""
)
def fields_survived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that were to carry a quality score and came out without one."""
    pages = load(spark, sf_dir, "scan_pages")
    kept = pages.where("quality_score is not null").select(F.col("file").alias("f"), F.col("page").alias("p")).distinct()
    wanted = pages.select("file", "page").distinct()
    return wanted.join(kept, (F.col("file") == F.col("f")) & F.col("page").eqNullSafe(F.col("p")), "left_anti")


@query(
    """SELECT file, page_index, coalesce(page_index >= 0, false) AS index_ok, coalesce(quality_score BETWEEN 0 AND 1, false) AS score_ok,
    coalesce(quality_band IN ('low', 'medium', 'high'), false) AS band_ok, coalesce(canvas.width > 0 AND canvas.height > 0, false) AS canvas_ok,
    coalesce(page_index >= 0, false) AND coalesce(quality_score BETWEEN 0 AND 1, false) AND coalesce(quality_band IN ('low', 'medium', 'high'), false)
      AND coalesce(canvas.width > 0 AND canvas.height > 0, false) AS is_valid FROM scan_pages"""
)
def schema_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "index_ok": F.col("page_index") >= 0,
        "score_ok": F.col("quality_score").between(0, 1),
        "band_ok": F.col("quality_band").isin("low", "medium", "high"),
        "canvas_ok": (F.col("canvas.width") > 0) & (F.col("canvas.height") > 0),
    }
    return records.checked(load(spark, sf_dir, "scan_pages"), rules).select("file", "page_index", *rules, "is_valid")


@query(
    """SELECT run_id, tool_version, CASE WHEN CAST(split_part(coalesce(tool_version, '1.0'), '.', 1) AS INTEGER) < 2 THEN '2.0' ELSE tool_version END AS migrated
    FROM runs"""
)
def migrate_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = records.migrated(F.coalesce("tool_version", F.lit("1.0")), 2)
    return load(spark, sf_dir, "runs").select("run_id", "tool_version", version.alias("migrated"))


@query(
    """SELECT user_id, CAST(user_id AS VARCHAR) || chr(31) || coalesce(event_type, 'null') || chr(31) || CAST(CAST(event_id AS BIGINT) AS VARCHAR) || chr(31)
      || CAST(CAST(event_id AS BIGINT) * 10000000000 AS VARCHAR) || chr(31) || '1.0' || chr(31) || 'true' || chr(31) || '[' || event_id || ',' || (event_id + 1) || ']' AS record_key FROM events"""
)
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of an integer, a text, a decimal, a large double, a text that looks like a number, a boolean and an array."""
    n = F.col("event_id")
    key = records.canonical_key(
        F.col("user_id"), F.col("event_type"), n.cast("decimal(20,1)"), n.cast("double") * 1e10, F.lit("1.0"), F.lit(True), records.as_json(F.array(n, n + 1))
    )
    return load(spark, sf_dir, "events").select("user_id", key.alias("record_key"))


# licences: every source of a file's documents is a component under the licence its kind of source carries
_LICENCE = """CASE split_part(source, '-', 1) WHEN 'museum' THEN ' CC-BY-NC-4.0' WHEN 'scan' THEN 'MIT License' WHEN 'oai' THEN 'cc0'
    WHEN 'csv' THEN 'Apache 2.0' WHEN 'legacy' THEN 'GPL 3.0' WHEN 'upload' THEN 'House rules' WHEN 'mail' THEN 'cc-by-nc-sa-4.0' ELSE 'CC BY 4.0' END"""
_COMPONENTS = f"SELECT file, source AS name, {_LICENCE} AS license, doc_id AS ord FROM documents WHERE file IS NOT NULL"
# spellings and ranks are written out here, not taken from the package, so that these statements stand for themselves
_ALL_ALIASES = """('public domain', 'Public Domain'), ('cc0', 'CC0'), ('mit', 'MIT'), ('mit license', 'MIT'), ('apache-2.0', 'Apache-2.0'), ('apache 2.0', 'Apache-2.0'),
    ('apache license 2.0', 'Apache-2.0'), ('bsd-3-clause', 'BSD-3-Clause'), ('mpl 2.0', 'MPL 2.0'), ('mpl-2.0', 'MPL 2.0'), ('lgpl-3.0', 'LGPL-3.0'),
    ('gpl-3.0', 'GPL-3.0'), ('gpl 3.0', 'GPL-3.0'), ('gpl-3.0 license', 'GPL-3.0'), ('agpl-3.0', 'AGPL-3.0'), ('agpl 3.0', 'AGPL-3.0'),
    ('agpl-3.0 license', 'AGPL-3.0'), ('agplv3', 'AGPL-3.0'), ('gnu affero general public license v3.0', 'AGPL-3.0'), ('cc by 4.0', 'CC BY 4.0'),
    ('cc-by-4.0', 'CC BY 4.0'), ('cc by-sa 4.0', 'CC BY-SA 4.0'), ('cc by-nc 4.0', 'CC BY-NC 4.0'), ('cc-by-nc-4.0', 'CC BY-NC 4.0'),
    ('attribution-noncommercial 4.0 international', 'CC BY-NC 4.0'), ('cc by-nc-sa 4.0', 'CC BY-NC-SA 4.0'), ('cc-by-nc-sa-4.0', 'CC BY-NC-SA 4.0'),
    ('attribution-noncommercial-sharealike 4.0 international', 'CC BY-NC-SA 4.0'), ('glm-4', 'glm-4'), ('glm4', 'glm-4'), ('glm-4 license', 'glm-4')"""
_ALL_RANKS = """('Public Domain', 0), ('CC0', 0), ('MIT', 1), ('Apache-2.0', 1), ('BSD-3-Clause', 1), ('MPL 2.0', 2), ('LGPL-3.0', 3), ('GPL-3.0', 4),
    ('AGPL-3.0', 4), ('CC BY 4.0', 1), ('CC BY-SA 4.0', 3), ('CC BY-NC 4.0', 5), ('CC BY-NC-SA 4.0', 6), ('glm-4', 5)"""
_NORMAL = f"""
    alias(a, c) AS (VALUES {_ALL_ALIASES}), ranks(l, r) AS (VALUES {_ALL_RANKS}),
    comp AS ({_COMPONENTS}),
    named AS (SELECT file, name, coalesce(c, trim(license)) AS license, ord FROM comp LEFT JOIN alias ON lower(trim(license)) = a),
    normal AS (SELECT file, name, license, ord, coalesce(r, -1) AS rank FROM named LEFT JOIN ranks ON license = l)"""
_UNION = f"""{_NORMAL},
    uni AS (SELECT file, name, license, rank, min(ord) AS ord, CASE WHEN rank < 0 THEN 6 ELSE rank END AS weight FROM normal GROUP BY file, name, license, rank),
    top AS (SELECT *, max(weight) OVER (PARTITION BY file) AS worst FROM uni)"""


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return licences.normalised(spark.sql(_COMPONENTS.replace("documents", "{docs}"), docs=docs))


@query(f"WITH {_NORMAL} SELECT DISTINCT name, license, CAST(rank AS INTEGER) AS rank FROM normal")
def normalise_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir).select("name", "license", "rank").distinct()


_SPELLINGS = """' GPL-3.0 License', 'agpl-3.0 license', 'GNU Affero General Public License v3.0', 'Attribution-NonCommercial 4.0 International',
    'Attribution-NonCommercial-ShareAlike 4.0 International', 'GLM-4 License', 'AGPLv3', 'Public Domain', 'Own terms', ''"""


@query(
    f"""WITH alias(a, c) AS (VALUES {_ALL_ALIASES}), ranks(l, r) AS (VALUES {_ALL_RANKS}), d AS (SELECT doc_id, [{_SPELLINGS}][doc_id % 10 + 1] AS spelled FROM documents),
    n AS (SELECT doc_id, spelled, coalesce(c, trim(spelled)) AS license FROM d LEFT JOIN alias ON lower(trim(spelled)) = a)
    SELECT doc_id, spelled, license, CAST(coalesce(r, -1) AS INTEGER) AS rank, CASE license WHEN 'GPL-3.0' THEN 'https://www.gnu.org/licenses/gpl-3.0.html'
      WHEN 'AGPL-3.0' THEN 'https://www.gnu.org/licenses/agpl-3.0.html' WHEN 'CC BY-NC 4.0' THEN 'https://creativecommons.org/licenses/by-nc/4.0/'
      WHEN 'CC BY-NC-SA 4.0' THEN 'https://creativecommons.org/licenses/by-nc-sa/4.0/' WHEN 'glm-4' THEN 'https://huggingface.co/THUDM/glm-4v-9b/blob/main/LICENSE'
      WHEN 'Public Domain' THEN 'https://creativecommons.org/publicdomain/mark/1.0/' ELSE '' END AS license_url FROM n LEFT JOIN ranks ON license = l"""
)
def license_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long and rare spellings of licences, dealt over the documents, with name, rank and address."""
    spelled = F.get(F.expr(f"array({_SPELLINGS})"), F.pmod("doc_id", F.lit(10)).cast("int"))
    rows = load(spark, sf_dir, "documents").select("doc_id", spelled.alias("spelled")).withColumn("license", F.col("spelled"))
    return licences.normalised(rows).select("doc_id", "spelled", "license", "rank", "license_url")


@query(
    f"""WITH {_UNION}, f AS (SELECT DISTINCT file FROM qa_log), e AS (SELECT file, arg_min(license, ord) FILTER (weight = worst) AS l FROM top GROUP BY file)
    SELECT f.file, coalesce(l, 'CC BY-NC 4.0') AS effective_license, coalesce(l, 'CC BY-NC 4.0') IN ('CC BY-NC 4.0', 'CC BY-NC-SA 4.0', 'glm-4') AS is_non_commercial FROM f LEFT JOIN e USING (file)"""
)
def license_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every logged file; a file without known components is not free for commercial use."""
    one = licences.distinct_components(_components(spark, sf_dir), ["file"])
    files = load(spark, sf_dir, "qa_log").select("file")
    return licences.licensed(files, licences.effective(one, ["file"]), ["file"]).select("file", "effective_license", "is_non_commercial")


@query(
    f"""WITH {_NORMAL}, s AS (SELECT *, CASE WHEN ord % 2 = 0 THEN 0 ELSE 1 END AS step FROM normal),
    u AS (SELECT file, name, license, min(struct_pack(step := step, ord := ord)) AS place FROM s GROUP BY ALL)
    SELECT file, name, license, place.step = 0 AS was_there FROM u"""
)
def license_accretion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that a record names (those of even documents) with those that a tool adds."""
    rows = _components(spark, sf_dir)
    both = licences.united(rows.where("ord % 2 = 0"), rows.where("ord % 2 <> 0"), ["file"])
    return both.select("file", "name", "license", (F.col("ord.step") == 0).alias("was_there"))


@query(f"WITH {_UNION} SELECT file, name, license, ord FROM uni")
def license_union_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.distinct_components(_components(spark, sf_dir), ["file"]).select("file", "name", "license", "ord")


@query(
    f"""WITH {_UNION} SELECT file, arg_min(license, ord) FILTER (weight = worst) AS effective_license,
    CAST(count(*) AS INTEGER) AS n_components, coalesce(array_to_string(list_sort(list(DISTINCT license) FILTER (rank < 0)), ','), '') AS unknown_licenses
    FROM top GROUP BY file"""
)
def effective_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = licences.distinct_components(_components(spark, sf_dir), ["file"])
    return licences.effective(one, ["file"]).drop("determined_by")


@query(f"WITH {_UNION} SELECT file, string_agg(name, ',' ORDER BY ord) FILTER (weight = worst) AS determined_by FROM top GROUP BY file")
def license_determined_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = licences.distinct_components(_components(spark, sf_dir), ["file"])
    return licences.effective(one, ["file"]).select("file", "determined_by")


_RUNS = "r AS (SELECT * FROM runs WHERE run_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id) = 1)"
_OUT = f"WITH {_RUNS}, o AS (SELECT run_id, duration_seconds, unnest(map_entries(statistics.output_counts_by_type)) AS e FROM r)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.distinct_runs(load(spark, sf_dir, "runs"))


@query(f"{_OUT} SELECT e.key AS type, CAST(sum(e.value) AS BIGINT) AS n_outputs, count(*) AS n_runs FROM o GROUP BY e.key")
def output_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.output_counts(_runs(spark, sf_dir))


@query(
    f"""{_OUT} SELECT run_id, e.key AS type, e.value AS n, CASE WHEN coalesce(duration_seconds, 0) > 0
    THEN round(e.value / (duration_seconds / 60), 4) ELSE 0.0 END AS per_minute FROM o"""
)
def rate_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.rates(_runs(spark, sf_dir))


@query(
    f"""WITH {_RUNS}, t AS (SELECT run_id, coalesce(statistics.successfully_processed, list_max(map_values(statistics.output_counts_by_type)), 0) AS processed,
    coalesce(statistics.skipped_files, len(skipped), 0) AS skipped, statistics.input_files_total AS total FROM r)
    SELECT run_id, CAST(processed AS INTEGER) AS processed, CAST(skipped AS INTEGER) AS skipped, CAST(coalesce(total, processed + skipped) AS INTEGER) AS inputs FROM t"""
)
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.totals(_runs(spark, sf_dir))


@query(
    f"""WITH {_RUNS} SELECT program, substr(run_id, 1, 6) AS day, count(*) AS n_stages, arg_min_null(statistics.input_files_total, run_id) AS input_files_total,
    arg_max_null(statistics.successfully_processed, run_id) AS successfully_processed, CAST(sum(statistics.skipped_files) AS BIGINT) AS skipped_files,
    round(sum(duration_seconds), 3) AS duration_seconds, min(start_time) AS start_time, max(end_time) AS end_time,
    arg_min(tool_version, run_id) FILTER (tool_version <> '') AS tool_version, any_value(formats) AS formats, CAST(sum(coalesce(len(skipped), 0)) AS BIGINT) AS n_skips
    FROM r LEFT JOIN (SELECT program AS p, d, string_agg(k || '=' || n, ',' ORDER BY k) AS formats FROM (SELECT program, substr(run_id, 1, 6) AS d, e.key AS k, CAST(sum(e.value) AS BIGINT) AS n
      FROM (SELECT program, run_id, unnest(map_entries(statistics.output_counts_by_type)) AS e FROM r) GROUP BY ALL) GROUP BY ALL) f ON p IS NOT DISTINCT FROM program AND d = substr(run_id, 1, 6) GROUP BY program, substr(run_id, 1, 6)"""
)
def merge_run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.merged(_runs(spark, sf_dir).withColumn("day", F.substr("run_id", F.lit(1), F.lit(6))), ["program", "day"], "run_id")
    formats = F.array_join(F.transform(F.map_entries("formats"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.withColumns({"formats": F.nullif(formats, F.lit("")), "n_skips": F.size("skipped").cast("long")}).drop("skipped")


_TERMS = "CASE WHEN coalesce(duration_seconds, 0) >= 100 THEN 'gpl-3.0 license' WHEN coalesce(duration_seconds, 0) >= 50 THEN 'Attribution-NonCommercial 4.0 International' ELSE 'mit' END"


@query(
    f"""WITH {_RUNS}, s AS (SELECT substr(run_id, 1, 6) AS input_file, run_id, duration_seconds, {_TERMS} AS t FROM r)
    SELECT input_file, string_agg(run_id, ',' ORDER BY run_id) AS steps, count(*) AS step_count, round(sum(coalesce(duration_seconds, 0)), 3) AS total_duration_seconds,
    CASE WHEN bool_or(t LIKE 'Attr%') THEN 'CC BY-NC 4.0' WHEN bool_or(t LIKE 'gpl%') THEN 'GPL-3.0' ELSE 'MIT' END AS effective_license FROM s GROUP BY input_file"""
)
def merge_file_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs of one day as those of one input file: steps in order, their durations, and the licence of all together."""
    logs = _runs(spark, sf_dir).withColumns({"input_file": F.substr("run_id", F.lit(1), F.lit(6)), "license": F.expr(_TERMS)})
    merged = runs.merged_steps(logs, ["input_file"], "run_id")
    parts = licences.normalised(logs.select("input_file", F.col("run_id").alias("name"), "license", F.col("run_id").alias("ord")))
    terms = licences.effective(parts, ["input_file"]).select("input_file", "effective_license")
    steps = F.array_join(F.transform("steps", lambda s: s["run_id"]), ",")
    return merged.join(terms, "input_file").select("input_file", steps.alias("steps"), "step_count", "total_duration_seconds", "effective_license")


@query(f"WITH {_RUNS}, s AS (SELECT run_id, unnest(skipped) AS s FROM r) SELECT s.reason AS reason, count(*) AS n_skipped, count(DISTINCT run_id) AS n_runs FROM s GROUP BY s.reason")
def skips_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.skips(_runs(spark, sf_dir))

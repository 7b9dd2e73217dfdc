"""Text-file sources: file sets, lists, vocabularies, references, components, morphology, records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_doc_id, ws_trim


def files(spark: SparkSession, folder: str, formats: list[str]) -> DataFrame:
    """(``path``, ``doc_id``, ``content``) of all files under a folder with one of the suffixes, each once."""
    globs = ",".join(sorted({f.lstrip(".") for f in formats}))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{globs}}}")
    return read.load(folder).select("path", canonical_doc_id(F.col("path")).alias("doc_id"), "content")


def single_file(paths: DataFrame, formats: list[str]) -> DataFrame:
    """Paths with an accepted suffix."""
    ok = F.lit(False)
    for f in formats:
        ok = ok | F.lower("path").endswith("." + f.lower().lstrip("."))
    return paths.where(ok)


def url_lines(lines: DataFrame) -> DataFrame:
    """Stripped lines of a list whose raw form starts with ``http``."""
    return lines.where(F.col("value").startswith("http")).select(ws_trim(F.col("value")).alias("url"))


def xpath_lines(lines: DataFrame) -> DataFrame:
    """Stripped, non-blank lines that are no comments."""
    return lines.where(~F.col("value").startswith("#")).select(ws_trim(F.col("value")).alias("xpath")).where("xpath <> ''")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(``ord``, ``term``, ``target``) as written; short rows have a null target. One task a file keeps the row order."""
    read = spark.read.option("header", "false").option("multiLine", "true").schema("term string, target string").csv(path)
    return read.select(F.monotonically_increasing_id().alias("ord"), "term", "target")


def references(spark: SparkSession, path: str) -> DataFrame:
    """(``file_id``, ``reference``) of a tab-separated list."""
    return spark.read.option("sep", "\t").schema("file_id string, reference string").csv(path).where("reference is not null")


def components(lines: DataFrame) -> DataFrame:
    """(``name``, ``license``, ``loaded``, ``role``) from lines ``name = licence ; loaded ; role``."""
    usable = lines.where(F.contains("value", F.lit("=")) & ~F.trim("value").startswith("#"))
    rest = F.split(F.substring_index("value", "=", -1), ";")
    part = lambda i: F.coalesce(ws_trim(F.get(rest, F.lit(i))), F.lit(""))
    return usable.select(ws_trim(F.substring_index("value", "=", 1)).alias("name"), part(0).alias("license"), part(1).alias("loaded"), part(2).alias("role"))


def conllu(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ``tok_idx``, ``word``, ``lemma``, ``number``) of CoNLL-U text: comments, blank and short lines, multi-word
    ranges and empty nodes are skipped; ``number`` is the value of that feature or ''."""
    cells = F.transform(F.split(text, "\n"), lambda x: F.split(x, "\t"))
    tokens = F.filter(cells, lambda c: ~c[0].startswith("#") & (F.size(c) >= 6) & ~c[0].rlike("[-.]"))  # numbered in the row: no shuffle
    token = F.col("token")
    number = F.regexp_extract(token[5], r"(?:^|\|)Number=([^|]*)", 1)
    return docs.select(key, F.posexplode(tokens).alias("at", "token")).select(
        key, (F.col("at") + 1).alias("tok_idx"), token[1].alias("word"), token[2].alias("lemma"), number.alias("number")
    )


def records(spark: SparkSession, path: str, current_major: int) -> DataFrame:
    """Record files, one JSON object each, as raw text with id and version; newer versions are refused when read."""
    raw = spark.read.text(path, wholetext=True)
    version = F.get_json_object("value", "$.schema_version")
    major = F.split(F.coalesce(version, F.lit("1.0")), r"\.")[0].cast("int")
    checked = F.when(major > current_major, F.raise_error(F.lit("record version is newer than this reader"))).otherwise(F.col("value"))
    return raw.select(F.get_json_object("value", "$.doc_id").alias("doc_id"), version.alias("schema_version"), checked.alias("record"))


def bilingual(source: DataFrame, target: DataFrame) -> DataFrame:
    """Terms of two languages joined on their id as text; the last target of an id counts, blanks are dropped."""
    t = target.groupBy(F.col("id").cast("string").alias("id")).agg(F.max_by("label", "ord").alias("target"))
    s = source.select(F.col("id").cast("string").alias("id"), F.col("label").alias("term"))
    return s.join(t, "id").where("trim(term) <> '' and trim(target) <> ''")


def model_pairs(payload: DataFrame, fallback: tuple[str, ...]) -> DataFrame:
    """(``pair``): the models that catalogue answers (``value``: JSON) name, in an object or a plain list; an answer that is
    no JSON stands for the fixed pairs, one of another form for none."""
    names = F.from_json("value", "struct<_embedded: struct<item: array<struct<model: string>>>>")["_embedded"]["item"]
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>"))
    known = F.array(*[F.lit(p) for p in fallback])
    given = F.coalesce(F.transform(names, lambda x: x["model"]), listed, F.array().cast("array<string>"))
    readable = F.try_parse_json(F.col("value")).isNotNull()
    return payload.select(F.explode(F.when(readable, given).otherwise(known)).alias("pair")).distinct()


def label(by_key, lists, prefs: list[str]):
    """The first non-blank label by language preference: of keys that are or end with a language code, then of entries of
    nested lists; ``by_key`` is a map of texts, ``lists`` an array of (``lang``, ``value``) or null."""

    def entry(p: str):
        own = F.filter(F.map_entries(by_key), lambda e: F.lower(e["key"]).endswith(p) & (F.trim(e["value"]) != ""))
        return F.trim(F.get(own, F.lit(0))["value"])

    out = [entry(p) for p in prefs]
    if lists is not None:
        nested = F.filter(lists, lambda e: F.lower(e["lang"]).isin(*prefs) & (F.trim(e["value"]) != ""))
        out.append(F.trim(F.get(nested, F.lit(0))["value"]))
    return F.coalesce(*out)

"""Record accretion in long form: one row a block, field or key, so every rule is a join or an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_block(blocks: DataFrame, keys: list[str], stamp: str, ord_col: str) -> DataFrame:
    """The newest row of every block; ties and missing stamps go to the one read first. Stamps compare as text."""
    row = F.struct(*[F.col(c) for c in blocks.columns])  # combined before the shuffle: a hot key costs one row a task
    best = blocks.groupBy(*keys).agg(F.max_by(row, F.struct(F.coalesce(stamp, F.lit("")), -F.col(ord_col))).alias("_best"))
    return best.select("_best.*")


def first_writer(rows: DataFrame, keys: list[str], value: str, ord_col: str) -> DataFrame:
    """The first non-null value of every key, and whether a later one disagrees."""
    given = rows.where(F.col(value).isNotNull())
    return given.groupBy(*keys).agg(
        F.min_by(value, ord_col).alias(value), (F.count_distinct(value) > 1).alias("has_conflict"), F.count("*").alias("n_writers")
    )


def canonical_key(*parts: Column) -> Column:
    """Key parts as text: whole numbers alike whether integer, decimal or double of any size, booleans and nulls as in JSON, texts
    as they are. Arrays, maps and structs go in as :func:`as_json`."""

    def one(c: Column) -> Column:
        kind = F.typeof(c)
        as_double = c.try_cast("double")
        whole = kind.isin("double", "float") & (as_double == F.floor(as_double)) & (F.abs(as_double) < 1e18)
        text = F.when(kind.startswith("decimal"), F.regexp_replace(c.cast("string"), r"^(-?\d+)\.0+$", "$1")).otherwise(c.cast("string"))
        return F.coalesce(F.when(whole, as_double.try_cast("decimal(38,0)").cast("string")).otherwise(text), F.lit("null"))

    return F.concat_ws("\u001f", *[one(c) for c in parts])


def as_json(container: Column) -> Column:
    """An array, map or struct as a key part; the entries of a map in the order of their keys."""
    return F.to_json(container, {"sortKeys": "true", "ignoreNullFields": "false"})


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows of both sides by key. ``incoming`` holds ``present``, the fields it sets: a present null overwrites, an
    absent field keeps what was there; only ``fields`` are granted."""
    e = existing.select(*[F.col(k).alias(f"e_{k}") for k in keys], *[F.col(f).alias(f"e_{f}") for f in fields])
    i = incoming.select(*[F.col(k).alias(f"i_{k}") for k in keys], *[F.col(f).alias(f"i_{f}") for f in fields], "present")
    on = [F.col(f"e_{k}").eqNullSafe(F.col(f"i_{k}")) for k in keys]
    merged = e.join(i, on, "full_outer")
    pick = [
        F.when(F.array_contains(F.coalesce("present", F.array().cast("array<string>")), f), F.col(f"i_{f}")).otherwise(F.col(f"e_{f}")).alias(f)
        for f in fields
    ]
    return merged.select(*[F.coalesce(f"e_{k}", f"i_{k}").alias(k) for k in keys], *pick)


def granted_fields(fields: DataFrame, grants: DataFrame) -> DataFrame:
    """Of (program, block, field, ...) the rows whose field the program may write."""
    return fields.join(grants, ["program", "block", "field"], "left_semi")


def dropped_fields(fields: DataFrame, grants: DataFrame) -> DataFrame:
    """The rows whose field is not granted."""
    return fields.join(grants, ["program", "block", "field"], "left_anti")


#: Parts of a record that no program writes as a block.
RESERVED = ("schema_version", "doc_id", "record_type", "source", "derived_from", "regenerable", "provenance", "assembled")


def owner_violations(writes: DataFrame, owners: DataFrame) -> DataFrame:
    """Writes of blocks by programs that do not own them; blocks without an owner are free."""
    owned = owners.select("block").distinct()
    return writes.join(owned, "block", "left_semi").join(owners, ["block", "program"], "left_anti")


def write_verdicts(writes: DataFrame, owners: DataFrame, grants: DataFrame, reserved: tuple[str, ...] = RESERVED) -> DataFrame:
    """``writes`` of whole blocks (``block``, ``program``, ...) with ``is_reserved``, ``is_foreign`` and ``others``: whether the block
    is no one's to write, whether it has owners and the program is none, and the programs that hold fields of it and would
    lose them, in order, without the writer and the owners."""
    owned = owners.groupBy("block").agg(F.collect_set("program").alias("_owners"))  # a handful a block
    held = grants.groupBy("block").agg(F.collect_set("program").alias("_held"))
    none = F.array().cast("array<string>")
    out = writes.join(owned, "block", "left").join(held, "block", "left")
    owners_, held_ = F.coalesce("_owners", none), F.coalesce("_held", none)
    return out.select(
        *writes.columns,
        F.col("block").isin(*reserved).alias("is_reserved"),
        ((F.size(owners_) > 0) & ~F.array_contains(owners_, F.col("program"))).alias("is_foreign"),
        F.array_sort(F.array_except(F.array_except(held_, owners_), F.array("program"))).alias("others"),
    )


def strict(verdicts: DataFrame) -> DataFrame:
    """``verdicts`` that fail the job at the first write that must not be; a reserved block fails it in any case."""
    text = F.concat_ws(" ", F.lit("block"), "block", F.lit("must not be written by"), "program")
    bad = F.col("is_reserved") | F.col("is_foreign") | (F.size("others") > 0)
    return verdicts.withColumn("block", F.when(bad, F.raise_error(text)).otherwise(F.col("block")))


def originator(origin: Column, prefixes: list[tuple[str, str]]) -> Column:
    """The program whose prefix the origin starts with, case folded, the first listed prefix first; null abstains."""
    out = F.lit(None).cast("string")
    for prefix, program in reversed(prefixes):
        out = F.when(F.lower(origin).startswith(prefix.lower()), program).otherwise(out)
    return out


def ordered_distinct(rows: DataFrame, keys: list[str], value: str, ord_col: str, out: str) -> DataFrame:
    """Per key the distinct values in order of first appearance, joined by commas."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(ord_col).alias("_at"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_at", value))), lambda x: x[value])
    return first.groupBy(*keys).agg(F.array_join(listed, ",").alias(out))


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with one boolean a rule and ``is_valid``; a null verdict is a failure. Split on it to quarantine."""
    verdicts = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    out = df
    for name, verdict in verdicts.items():
        out = out.withColumn(name, verdict)
    every = F.lit(True)
    for name in verdicts:
        every = every & F.col(name)
    return out.withColumn("is_valid", every)


def migrated(version: Column, current: int) -> Column:
    """The version after migration; a newer major version is refused."""
    major = F.split(version, r"\.")[0].cast("int")
    return F.when(
        major > current, F.raise_error(F.concat(F.lit("record version is newer than this reader: "), version))
    ).otherwise(F.when(major < current, F.lit(f"{current}.0")).otherwise(version))


def inherited_id(baseline_id: Column, derived_id: Column) -> Column:
    """The id of the record a document already has, else the one its name gives."""
    return F.coalesce(F.nullif(F.trim(baseline_id), F.lit("")), derived_id)


def several_documents(parts: DataFrame, group: str, doc_id: str) -> DataFrame:
    """Groups of parts that claim more than one document id: these must not be merged."""
    named = parts.where(F.coalesce(doc_id, F.lit("")) != "")
    return named.groupBy(group).agg(F.count_distinct(doc_id).alias("n_documents")).where("n_documents > 1")


def originator_audit(
    blocks: DataFrame, origins: DataFrame, prefixes: list[tuple[str, str]], handed_over: DataFrame | None = None, ocr: str = "alto-postprocess"
) -> DataFrame:
    """Blocks written by another program than their document's origin authorises; unknown origins abstain. The documents of
    ``handed_over`` ask for recognition themselves: the program ``ocr`` may write them whatever their origin."""
    allowed = origins.select("doc_id", "origin", originator(F.col("origin"), prefixes).alias("originator")).where("originator is not null")
    out = blocks.join(allowed, "doc_id").where(F.col("program") != F.col("originator"))
    if handed_over is None:
        return out
    asked = handed_over.select("doc_id").distinct().withColumn("_asked", F.lit(True))
    return out.join(asked, "doc_id", "left").where(F.col("_asked").isNull() | (F.col("program") != ocr)).drop("_asked")


def opened(parts: DataFrame, baselines: DataFrame) -> DataFrame:
    """Parts of documents (``doc_id``, ...) with the record each accretes to: ``record`` is null and ``had_baseline`` false where
    there is none, so that the part stands alone."""
    base = baselines.select("doc_id", "record")
    return parts.join(base, "doc_id", "left").withColumn("had_baseline", F.col("record").isNotNull())


def replaced(existing: DataFrame, blocks: DataFrame, program: str, stamp: Column) -> DataFrame:
    """(``doc_id``, ``block``, ``payload``, ``program``, ``updated_at``): whole blocks replaced and stamped, all others as they were."""
    shown = ["doc_id", "block", "payload", "program", "updated_at"]
    new = blocks.select("doc_id", "block", "payload", F.lit(program).alias("program"), stamp.alias("updated_at"))
    return existing.select(*shown).join(new.select("doc_id", "block"), ["doc_id", "block"], "left_anti").unionByName(new)


def last_writer(rows: DataFrame, keys: list[str], value: str, ord_col: str) -> DataFrame:
    """Within one record a later entry of a key overwrites the one before, with null, too."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(value), ord_col).alias("_last")).select(*keys, f"_last.{value}")


def fan_in(parts: DataFrame) -> DataFrame:
    """One row a (document, block) from the parts of many tools: (doc_id, ``block``, ``key``, ``payload``, ``updated_at``, ``ord``).

    Blocks go to the newest stamp, the sub-keys of ``source``, ``derived_from`` and ``regenerable`` to the first writer.
    """
    sub = F.col("block").isin("source", "derived_from", "regenerable")
    first = parts.where(sub & F.col("payload").isNotNull()).groupBy("doc_id", "block", "key").agg(F.min_by("payload", "ord").alias("payload"))
    newest = newest_block(parts.where(~sub), ["doc_id", "block"], "updated_at", "ord").select("doc_id", "block", "key", "payload")
    return newest.unionByName(first)

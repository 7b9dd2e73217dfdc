"""Distributed writers; Spark's commit protocol takes the place of write-then-rename for tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import xml_nodes


def output_name(name, target: str):
    """``<base>_<target>.alto.xml`` for layout files, ``<stem>_<target><suffix>`` for others."""
    base = F.regexp_replace(name, r"(?i)(\.alto\.xml|\.[^./]+)$", "")
    suffix = F.when(F.lower(name).endswith(".alto.xml"), ".alto.xml").otherwise(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    return F.concat(base, F.lit(f"_{target}"), suffix)


def rewritten(files: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(``key``, ``content``): files with new values. ``changes``: (key, ``node_id``, ``kind`` text or content, ``value``);
    a later pass over the same node counts by ``ord``. A file's changes are as many as its nodes."""
    last = changes.groupBy(key, "node_id", "kind").agg(F.max_by("value", "ord").alias("value"))
    grouped = last.groupBy(key).agg(F.collect_list(F.struct("node_id", "kind", "value")).alias("changes"))
    kind = dict(files.dtypes)[key]

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = c if isinstance(c, bytes) else c.encode()
                by = {k: {r["node_id"]: r["value"] or "" for r in rows or () if r["kind"] == k} for k in ("text", "content")}
                out.append(xml_nodes.splice(raw, by["text"], by["content"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "content"])

    return files.select(key, "content").join(grouped, key, "left").mapInArrow(splice, f"{key} {kind}, content binary")


def write_files(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write every row's content to its own file under a shared folder, through a temporary name: (``name``, ``n_bytes``)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names, sizes = [], []
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = c if isinstance(c, bytes) else (c or "").encode()
                path = os.path.join(folder, os.path.basename(n))
                with open(f"{path}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(raw)
                os.replace(f.name, path)  # a task that runs twice leaves one whole file
                names.append(n)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "n_bytes"])

    return files.select(name, content).mapInArrow(write, "name string, n_bytes long")


def qa_csv(rows: DataFrame, folder: str, source: str, target: str) -> None:
    """One folder a file of the QA log, its text columns named by language."""
    named = rows.select(
        "file", F.col("file").alias("_file"), "page_num", "line_num", F.col("text_src").alias(f"text_{source}"), F.col("text_tgt").alias(f"text_{target}")
    )
    named.write.mode("overwrite").partitionBy("_file").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(folder)


RECORD_KEYS = (
    "schema_version", "doc_id", "record_type", "source", "derived_from", "pages", "content", "lines", "tables", "page_categories",
    "entities", "translations", "enrichment", "forms", "regenerable", "provenance", "assembled",
)


def records(blocks: DataFrame, keys: tuple[str, ...] = RECORD_KEYS) -> DataFrame:
    """(``doc_id``, ``record``): one JSON object a document from (doc_id, ``block``, ``payload``): known blocks in fixed
    order, unknown ones after them by name, every payload byte for byte."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("block")), F.lit(0))
    place = F.when(order > 0, order).otherwise(len(keys) + 1)
    items = F.sort_array(F.collect_list(F.struct(place.alias("at"), "block", "payload")))

    def member(x: Column) -> Column:
        name = F.regexp_replace(x["block"], r'(["\\])', r"\\$1")
        return F.concat(F.lit('"'), name, F.lit('":'), F.coalesce(x["payload"], F.lit("null")))

    text = F.array_join(F.transform(items, member), ",")
    return blocks.groupBy("doc_id").agg(F.concat(F.lit("{"), text, F.lit("}")).alias("record"))


def run_logs(runs: DataFrame) -> DataFrame:
    """(``name``, ``log``): one JSON document a run under ``<run_id>_<program>.json``; missing values stay as null."""
    log = F.to_json(F.struct(*runs.columns), {"ignoreNullFields": "false"})
    return runs.select(F.concat_ws("_", "run_id", F.concat("program", F.lit(".json"))).alias("name"), log.alias("log"))


def evaluation_columns(columns: list[str]) -> list[str]:
    """Column order of an evaluation table: by name, the texts last."""
    return sorted(columns, key=lambda c: (c in ("src", "tgt"), c))


def united(parts: list[DataFrame]) -> DataFrame:
    """Evaluation rows of several runs under the union of their columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*evaluation_columns(out.columns))


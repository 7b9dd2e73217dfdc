"""Cutting texts into chunks at lines, sentences, clauses or words (the translation chunker, without overlap)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Boundaries by rank: what to look for and how much of it stays with the left part.
TIERS = ((("\n", 0),), ((". ", 1), ("! ", 1), ("? ", 1)), (("; ", 1), (", ", 1)))


def _cut(text: str, at: int, size: int) -> int:
    """Where the chunk that starts at ``at`` ends."""
    end, least = at + size, size // 4
    for tier in TIERS:
        found = [p + keep for mark, keep in tier if (p := text.rfind(mark, at, end)) - at > least]
        if found:
            return max(found)
    space = text.rfind(" ", at, end)
    return space if space > at else end


def chunks(text: str | None, size: int) -> list[str]:
    """Stripped, non-empty parts of at most ``size`` characters, in order."""
    if size < 1:
        raise ValueError("size must be positive")
    text = (text or "").strip()
    out, at = [], 0
    while len(text) - at > size:
        cut = _cut(text, at, size)
        out.append(text[at:cut].strip())
        at = cut
        while at < len(text) and text[at].isspace():
            at += 1
    out.append(text[at:].strip())
    return [c for c in out if c]


def chunked(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(``key``, ``chunk_idx`` from 0, ``chunk``) of every row; rows without text give none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, c) for k, t in zip(*(c.to_pylist() for c in batch.columns)) for i, c in enumerate(chunks(t, size))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())],
                names=[key, "chunk_idx", "chunk"],
            )

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(cut, f"{key} {kind}, chunk_idx int, chunk string")

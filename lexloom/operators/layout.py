"""Pages, lines and tokens: joining, ordinals, alignment and redistribution, without a shuffle.

A block is one row with its lines as an array; everything positional is done with higher-order functions inside the row.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_even, is_blank, let, ws_split


def with_lines(df: DataFrame, text: str, out: str = "lines") -> DataFrame:
    """``df`` with the lines of ``text``: array of (line_idx from 1, words); rows without words are dropped."""
    lines = F.transform(
        F.split(text, "\n"), lambda x, i: F.struct((i + 1).cast("int").alias("line_idx"), ws_split(x).alias("words"))
    )
    return df.where(~is_blank(F.col(text))).withColumn(out, lines)


def block_text(lines: Column) -> Column:
    """All words of all lines joined by one space."""
    return F.array_join(F.flatten(F.transform(lines, lambda x: x["words"])), " ")


def proportional_buckets(lines: Column, tokens: Column) -> Column:
    """The tokens of a translated block dealt to its lines in proportion to their own words: array of (line_idx, tokens).

    A line takes half-to-even(N * words / all words) of what is left, the last line takes the rest; without any words
    everything goes to the last line. The starts are running sums clamped to N, so no step depends on the one before.
    """
    long = lambda i: F.lit(i).cast("long")

    def counted(v: Column) -> Column:
        counts = F.transform(v["lines"], lambda x: F.size(x["words"]).cast("long"))
        return F.struct(v["lines"].alias("lines"), v["tokens"].alias("tokens"), counts.alias("counts"))

    def totalled(v: Column) -> Column:
        total = F.aggregate(v["counts"], long(0), lambda a, x: a + x)
        return F.struct(v["lines"].alias("lines"), v["tokens"].alias("tokens"), v["counts"].alias("counts"), total.alias("total"), F.size(v["tokens"]).cast("long").alias("n"))

    def taken(v: Column) -> Column:
        take = lambda c: F.when(v["total"] > 0, half_even(v["n"] * c, F.greatest(v["total"], long(1)))).otherwise(long(0))
        takes = F.transform(v["counts"], take)
        return F.struct(v["lines"].alias("lines"), v["tokens"].alias("tokens"), v["n"].alias("n"), takes.alias("takes"))

    def started(v: Column) -> Column:
        begin = F.struct(long(0).alias("sum"), F.array().cast("array<bigint>").alias("at"))
        step = lambda a, t: F.struct((a["sum"] + t).alias("sum"), F.concat(a["at"], F.array(F.least(a["sum"], v["n"]))).alias("at"))
        starts = F.aggregate(v["takes"], begin, step)["at"]
        return F.struct(v["tokens"].alias("tokens"), v["n"].alias("n"), F.size(v["lines"]).alias("last"), F.arrays_zip(v["lines"].alias("line"), starts.alias("start"), v["takes"].alias("take")).alias("zipped"))

    def dealt(v: Column) -> Column:
        def part(z: Column, i: Column) -> Column:
            first = (z["start"] + 1).cast("int")
            size = F.when(i + 1 == v["last"], v["n"]).otherwise(F.least(z["take"], v["n"] - z["start"])).cast("int")
            return F.struct(z["line"]["line_idx"].alias("line_idx"), F.slice(v["tokens"], first, size).alias("tokens"))

        return F.transform(v["zipped"], part)

    out = F.struct(lines.alias("lines"), tokens.alias("tokens"))
    for step in (counted, totalled, taken, started, dealt):
        out = let(out, step)
    return out


def onto_strings(words: Column, tokens: Column) -> Column:
    """The tokens of a line on its strings: string i takes token i, the last one all that is left, none an empty text."""
    n = F.size(words)
    return F.transform(
        words,
        lambda w, i: F.when(
            i + 1 == n, F.array_join(F.slice(tokens, i + 1, F.greatest(F.size(tokens), F.lit(1))), " ")
        ).otherwise(F.coalesce(F.get(tokens, i), F.lit(""))),
    )


def anchored(block: str, anchors: list[str]) -> list[list[str]]:
    """The tokens of ``block`` cut at the places where each part is most like its line's own translation."""
    tokens, parts = block.split(), []
    if not tokens:
        return [[] for _ in anchors]
    at = 0
    for anchor in anchors[:-1]:
        n, left = len(anchor.split()), len(tokens) - at
        if not n or not left:
            parts.append([])
            continue
        matcher = difflib.SequenceMatcher(None, "", anchor)
        best, k = -1.0, 0
        # from the likeliest length outwards; upper bounds spare most comparisons, equal ones go to the shorter part
        for cut in sorted(range(max(0, int(n * 0.5) - 1), min(left, int(n * 1.5) + 2) + 1), key=lambda c: abs(c - n)):
            matcher.set_seq1(" ".join(tokens[at : at + cut]))
            if matcher.real_quick_ratio() < best or matcher.quick_ratio() < best:
                continue
            ratio = matcher.ratio()
            if ratio > best or (ratio == best and cut < k):
                best, k = ratio, cut
        parts.append(tokens[at : at + k])
        at += k
    return [*parts, tokens[at:]]


def anchored_buckets(df: DataFrame, key: str, block: str, anchors: str) -> DataFrame:
    """(``key``, ``line_idx``, ``tokens``) by :func:`anchored`; sequential in a block, parallel over blocks."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (k, i, " ".join(t))
                for k, b, a in zip(*(c.to_pylist() for c in batch.columns))
                for i, t in enumerate(anchored(b or "", [x or "" for x in a or ()]), 1)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())],
                names=[key, "line_idx", "tokens"],
            )

    kind = dict(df.dtypes)[key]
    return df.select(key, block, anchors).mapInArrow(align, f"{key} {kind}, line_idx int, tokens string")

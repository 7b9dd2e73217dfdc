"""Problem 2: cutting oversized texts at natural boundaries, with overlap.

Agglomerative merging: a text is taken apart into atoms (lines, sentences, clauses, words; a stretch without white space
that is too long by itself is broken at its own punctuation, else at the limit). All neighbouring atoms stand in a heap
by the strength of the boundary between them; the weakest is merged first, as long as the merged piece and the overlap
that will precede it fit the limit. What is left are the pieces, cut at the strongest boundaries that fit.

Defined cases: null gives no pieces; a text within the limit is one piece; the bodies of the pieces concatenate to the
text exactly; an overlap as large as the limit is reduced so that every piece advances by at least one character; a limit
below 1 is an error; base letters and their combining marks are kept together where the limit allows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_LIMIT = 4000
DEFAULT_OVERLAP = 0
#: Strength of a boundary by what stands before it; the higher, the better a place to cut.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, MARK, NONE = 6, 5, 4, 3, 2, 1, 0

_atom = re.compile(r"\S*\s+|\S+$")
_inner = re.compile(r".*?(?:[,;|/.:_\-](?=.)|$)", re.S)
_marks = re.compile(r"[\u0300-\u036f\u200d\ufe00-\ufe0f]")

PIECE = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("overlap", T.IntegerType()),
        T.StructField("boundary", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)
RESULT = T.StructType(
    [T.StructField("pieces", T.ArrayType(PIECE)), T.StructField("longest_stretch", T.IntegerType())]
)


def _strength(atom: str) -> int:
    if atom[-1] == " " and atom[-2:-1].isalnum():  # most atoms: a word and a space
        return WORD
    body = atom.rstrip()
    tail = atom[len(body) :]
    if not tail:
        return MARK
    if tail.count("\n") > 1:
        return PARAGRAPH
    if "\n" in tail:
        return LINE
    last = body.rstrip("\"'”’»)]")[-1:]
    return SENTENCE if last in ".!?…" and last else CLAUSE if last in ",;:" and last else WORD


def _hard(part: str, room: int) -> Iterator[str]:
    """A stretch without natural boundary, cut at the limit but not before a combining mark."""
    at = 0
    while len(part) - at > room:
        cut = at + room
        while cut > at + 1 and _marks.match(part[cut]):
            cut -= 1
        yield part[at : (cut if cut > at + 1 or room == 1 else at + room)]
        at = cut if cut > at + 1 or room == 1 else at + room
    yield part[at:]


def _atoms(text: str, room: int) -> tuple[list[int], list[int]]:
    """Sizes of the atoms and the strength of the boundary after each."""
    sizes: list[int] = []
    after: list[int] = []
    for m in _atom.finditer(text):
        atom = m[0]
        if len(atom) <= room:
            sizes.append(len(atom))
            after.append(_strength(atom))
            continue
        for part in filter(None, _inner.findall(atom)):
            if len(part) <= room:
                sizes.append(len(part))
                after.append(MARK)
            else:
                cut = [len(x) for x in _hard(part, room)]
                sizes += cut
                after += [NONE] * (len(cut) - 1) + [MARK]
        after[-1] = _strength(atom)
    return sizes, after


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, boundary strength at end) of the bodies of the pieces, in order."""
    if limit < 1:
        raise ValueError("limit must be positive")
    if len(text) <= limit:
        return [(0, len(text), PARAGRAPH)] if text else []
    overlap = max(0, min(overlap, limit - 1))
    room = limit - overlap
    sizes, after = _atoms(text, room)
    n = len(sizes)
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(after[i], sizes[i] + sizes[i + 1], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        strength, joint, i, j = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and nxt[i] == j) or sizes[i] + sizes[j] != joint:
            continue  # an older state of this pair
        # the first piece has no overlap before it
        if joint > (limit if prv[i] < 0 else room):
            continue  # neither side ever shrinks, so this boundary stays
        sizes[i] = joint
        after[i] = after[j]
        alive[j] = False
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            heapq.heappush(heap, (after[i], sizes[i] + sizes[nxt[i]], i, nxt[i]))
        if prv[i] >= 0:
            p = prv[i]
            heapq.heappush(heap, (after[p], sizes[p] + sizes[i], p, i))
    out, at, i = [], 0, 0
    while i < n:
        out.append((at, at + sizes[i], after[i]))
        at += sizes[i]
        i = nxt[i]
    return out


def cut(text: str | None, limit: int, overlap: int) -> list[dict]:
    """The pieces of one text."""
    if text is None:
        return []
    points = cut_points(text, limit, overlap)
    overlap = max(0, min(overlap, limit - 1))
    return [
        {
            "piece": n, "start": a, "end": b, "overlap": (o := min(overlap, a) if n else 0), "boundary": s,
            "text": text[a - o : b],
        }
        for n, (a, b, s) in enumerate(points)
    ]


@F.pandas_udf(RESULT)
def _cut_udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, limits, overlaps in batches:
        rows = [cut(t, int(a), int(b)) for t, a, b in zip(texts.tolist(), limits.tolist(), overlaps.tolist())]
        longest = [max(map(len, t.split()), default=0) if t else 0 for t in texts.tolist()]
        yield pd.DataFrame({"pieces": rows, "longest_stretch": pd.Series(longest, dtype="int32")})


def cut_pieces(df: DataFrame, text: str, limit: str, overlap: str, out: str = "cut") -> DataFrame:
    """``df`` with a struct column ``out`` of the pieces of ``text`` and its longest stretch without white space."""
    return df.withColumn(
        out, _cut_udf(F.col(text), F.col(limit).cast("int"), F.coalesce(F.col(overlap).cast("int"), F.lit(0)))
    )


def run_limits(runs: DataFrame) -> DataFrame:
    """(``run_id``, ``chunk_limit``, ``chunk_overlap``), one row a run; a limit that is missing, unreadable or below 1 is null."""
    limit = F.expr("try_cast(config['chunk_limit'] as int)")
    return (
        runs.where("run_id is not null")
        .select(
            "run_id",
            F.when(limit >= 1, limit).alias("chunk_limit"),
            F.expr("try_cast(config['chunk_overlap'] as int)").alias("chunk_overlap"),
        )
        .groupBy("run_id")
        .agg(F.max("chunk_limit").alias("chunk_limit"), F.max("chunk_overlap").alias("chunk_overlap"))
    )


def oversized_pieces(log: DataFrame, runs: DataFrame, key: str, text: str) -> DataFrame:
    """Every text longer than its run's limit, with its pieces: (key, ``chunk_limit``, ``chunk_overlap``, ``cut``).

    Texts no longer than the smallest limit of any run are dropped at the scan, so only long ones meet the runs.
    """
    limits = run_limits(runs)
    least = limits.agg(F.min("chunk_limit")).first()[0]
    least = DEFAULT_LIMIT if least is None else min(least, DEFAULT_LIMIT)
    long = log.where(F.length(text) > F.lit(least)).select(F.col(key).alias("k"), "run_id", F.col(text).alias("t"))
    joined = (
        long.join(limits, "run_id", "left")
        .select(
            "k",
            "t",
            F.coalesce("chunk_limit", F.lit(DEFAULT_LIMIT)).alias("chunk_limit"),
            F.coalesce("chunk_overlap", F.lit(DEFAULT_OVERLAP)).alias("chunk_overlap"),
        )
        .where(F.length("t") > F.col("chunk_limit"))
    )
    return cut_pieces(joined, "t", "chunk_limit", "chunk_overlap").select(
        F.col("k").alias(key), "chunk_limit", "chunk_overlap", "cut"
    )

"""Bounded, repeatable samples of labelled rows for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = 1_000_000_007


def per_class(df: DataFrame, label: str, key: str, columns: list[str | Column], rows: int) -> list:
    """About ``rows`` rows of every class of ``label`` (never more than twice that), chosen by a hash of ``key``.

    One pass over the label column gives the class sizes, a second keeps the rows whose hash falls under the class's
    share; nothing is shuffled but the counts. Classes are few (codes of languages, kinds of defect).
    """
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect() if r[0] is not None}
    if not sizes:
        return []
    limit = F.create_map(*[x for c, n in sizes.items() for x in (F.lit(c), F.lit(int(_SPAN * min(1.0, rows / n))))])
    chosen = df.where(F.pmod(F.xxhash64(F.lit(29), key), F.lit(_SPAN)) <= limit[F.col(label)])
    return chosen.select(*columns).limit(2 * rows * len(sizes)).collect()

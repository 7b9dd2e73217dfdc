"""Reference-less quality measures of translation backends."""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank, number_preservation


@F.pandas_udf(T.DoubleType())
def _likeness(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series(
            [None if x is None or y is None else round(difflib.SequenceMatcher(None, x, y).ratio(), 4) for x, y in zip(a, b)], dtype="float64"
        )


def char_similarity(a: Column, b: Column) -> Column:
    """Share of matching characters in matching blocks, to four places; null if either is null."""
    return _likeness(a, b)


def term_hits(segments: DataFrame, terms: DataFrame, matches) -> DataFrame:
    """(``seg``, ``term_hits``, ``term_expected``): glossary terms inside the source, and of these those whose target is
    inside the translation (anywhere, case folded)."""
    found = matches(segments, "seg", "src", terms, False).join(segments.select("seg", "tgt"), "seg")
    return found.groupBy("seg").agg(
        F.sum(F.when(F.contains(F.lower("tgt"), F.lower("target")), 1).otherwise(0)).alias("term_hits"), F.count("*").alias("term_expected")
    )


def pairwise(segments: DataFrame) -> DataFrame:
    """Similarity of the two translations of every segment that has exactly two backends."""
    two = segments.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("backend", "tgt"))).alias("t"))
    two = two.where("size(t) = 2 and t[0].backend <> t[1].backend")
    return two.select("id", F.col("t")[0]["backend"].alias("backend_a"), F.col("t")[1]["backend"].alias("backend_b"), char_similarity(F.col("t")[0]["tgt"], F.col("t")[1]["tgt"]).alias("similarity"))


def summary(segments: DataFrame) -> DataFrame:
    """Per backend: segments, empty ones, hit rate of terms, mean number preservation; null where undefined."""
    kept = number_preservation(F.col("src"), F.coalesce("tgt", F.lit("")))
    return segments.withColumn("kept", kept).groupBy("backend").agg(
        F.count("*").alias("n_segments"),
        F.sum(F.when(is_blank(F.col("tgt")), 1).otherwise(0)).alias("n_empty"),
        F.sum("term_hits").alias("term_hits"),
        F.sum("term_expected").alias("term_expected"),
        F.round(F.try_divide(F.sum("term_hits"), F.nullif(F.sum("term_expected"), F.lit(0))), 6).alias("term_hit_rate"),
        F.round(F.avg("kept"), 6).alias("number_preservation"),
    )


def _grams(items, order: int) -> list[Counter]:
    """Counts of the n-grams of every n up to ``order``."""
    n_items = len(items)
    if isinstance(items, str):
        return [Counter(items[i : i + n] for i in range(n_items - n + 1)) for n in range(1, order + 1)]
    return [Counter(tuple(items[i : i + n]) for i in range(n_items - n + 1)) for n in range(1, order + 1)]


def chrf_of(hypothesis: str, reference: str, order: int = 6, beta: float = 2.0) -> float:
    """Character n-gram F-score in percent: mean precision and recall over the n that both texts have n-grams of, white space
    left out; 0 where there is none."""
    a, b = (_grams("".join(t.split()), order) for t in (hypothesis, reference))
    ratios = [((x & y).total(), x.total(), y.total()) for x, y in zip(a, b) if x and y]
    if not ratios:
        return 0.0
    p, r = (sum(m[0] / m[j] for m in ratios) / len(ratios) for j in (1, 2))
    return round(100 * (1 + beta * beta) * p * r / (beta * beta * p + r), 2) if p + r else 0.0


# The rules of the public mteval-v13a tokenizer.
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
TOKEN_RULES = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
)
_rules = [(re.compile(a), b) for a, b in TOKEN_RULES]


def mt_tokens(text: str) -> list[str]:
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, sign in ENTITIES:
        text = text.replace(entity, sign)
    text = f" {text} "
    for rule, by in _rules:
        text = rule.sub(by, text)
    return text.split()


def bleu_of(hypothesis: str, reference: str, order: int = 4) -> float:
    """Sentence BLEU in percent: tokens of mteval-v13a, n-grams as far as the hypothesis has any, empty matches halved again
    and again, brevity penalty."""
    h, r = mt_tokens(hypothesis), mt_tokens(reference)
    logs, halved, any_match = [], 1, False
    for x, y in zip(_grams(h, order), _grams(r, order)):
        if not x:
            break
        match = (x & y).total()
        any_match = any_match or match > 0
        if not match:
            halved *= 2
        logs.append(math.log(match / x.total() if match else 1 / (halved * x.total())))
    if not any_match:
        return 0.0
    brevity = 0.0 if len(h) >= len(r) else 1 - len(r) / len(h)
    return round(100 * math.exp(brevity + sum(logs) / len(logs)), 2)


def _scored(score, hypothesis: Column, reference: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            yield pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)], dtype="float64")

    return run(hypothesis, reference)


def chrf(hypothesis: Column, reference: Column) -> Column:
    """Column form of :func:`chrf_of`; null if either is null."""
    return _scored(chrf_of, hypothesis, reference)


def bleu(hypothesis: Column, reference: Column) -> Column:
    """Column form of :func:`bleu_of`; null if either is null."""
    return _scored(bleu_of, hypothesis, reference)

"""Language identification by a trained model: naive Bayes over hashed character n-grams.

The model is fitted on a bounded sample of labelled texts (``SAMPLE_TEXTS`` a language) and frozen: one table of log
probabilities of ``2 ** BITS`` slots by language, sent once to every executor. Texts are scored in Arrow batches, whole.

Defined cases: null, blank and letterless texts are ('en', 0.0); without labelled texts so is every text; ties go to the
first code of the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_TEXTS, SAMPLE_CHARS, BITS, ORDERS = 200, 400_000, 16, (1, 2, 3, 4)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def slots(text: str) -> np.ndarray:
    """The slots of all n-grams of the letters of a text, words set apart by one space."""
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    data = np.frombuffer((" " + " ".join(t.split()) + " ").encode("utf-16-le", "surrogatepass"), dtype=np.uint16).astype(np.uint64)
    if len(data) < 3:
        return np.empty(0, dtype=np.int64)
    out = []
    for n in ORDERS:
        if len(data) >= n:
            gram = np.full(len(data) - n + 1, np.uint64(n))
            for i in range(n):
                gram = (gram << np.uint64(16)) ^ data[i : len(data) - n + 1 + i] ^ (gram >> np.uint64(48))
            out.append(((gram * _MIX) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out)


class Identifier:
    """Log probabilities of n-grams by language."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(c for c, t in texts.items() if t)
        counts = np.full((1 << BITS, len(self.languages)), 0.05)
        for j, c in enumerate(self.languages):
            left = SAMPLE_CHARS
            for t in texts[c]:
                if left <= 0:
                    break
                counts[:, j] += np.bincount(slots(t), minlength=1 << BITS)
                left -= len(t)
        self.logs = (np.log(counts) - np.log(counts.sum(axis=0))).astype(np.float32) if self.languages else counts.astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(code, its posterior share)."""
        at = slots(text) if text and self.languages else []
        if not len(at):
            return "en", 0.0
        score = self.logs[at].sum(axis=0, dtype=np.float64) / np.sqrt(len(at))  # neighbouring n-grams are no independent witnesses
        share = np.exp(score - score.max())
        best = int(score.argmax())
        return self.languages[best], round(float(share[best] / share.sum()), 4)


def fitted(labelled: DataFrame, text: str, label: str, key: str) -> Identifier:
    """A model of every language among the labels, from about ``SAMPLE_TEXTS`` texts of each, chosen by a hash of the key."""
    usable = labelled.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(label).alias("_l"), F.col(text).alias("_t"), F.col(key).alias("_k"))
    sizes = {r[0]: r[1] for r in usable.groupBy("_l").count().collect()}  # one row a language
    if not sizes:
        return Identifier({})
    share = F.create_map(*[x for c, n in sizes.items() for x in (F.lit(c), F.lit(min(1.0, SAMPLE_TEXTS / n)))])
    chosen = usable.where(F.pmod(F.xxhash64(F.lit(3), "_k"), F.lit(1_000_000)) < share[F.col("_l")] * 1_000_000)
    texts: dict[str, list[str]] = {}
    for r in sorted(chosen.limit(4 * SAMPLE_TEXTS * len(sizes)).collect(), key=lambda r: str(r[2])):
        texts.setdefault(r[0], []).append(r[1])
    return Identifier(texts)


def identified(df: DataFrame, model: Identifier, key: str, text: str) -> DataFrame:
    """(``key``, ``lang``, ``confidence``) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers a language
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[key, "lang", "confidence"]
            )

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, lang string, confidence double")

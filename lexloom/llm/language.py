"""Problem 4: the language of a text and of each stretch of a mixed one.

Prediction by partial matching over bytes: for every language a context tree of up to ``ORDER`` bytes is counted on a
bounded labelled sample and frozen. A byte costs -log2 of its share in its longest known context; where the context has
not seen the byte, the escape of that context is paid and the next shorter one asked (method C, frozen statistics, order
-1 uniform). The costs of all n-grams of any language are worked out once, so that scoring a text is one table look-up a
byte and language, exact to the bit. Sentences are summed by language; a text takes its cheapest language, and a sentence
that another language describes by a clear margin is a stretch of that one.

Defined cases: null, blank and letterless texts have no language; text that no tree can describe (random letters, digits)
belongs to none; without labelled documents
no text has a language; very long texts are scored whole, in blocks; texts with disguised characters are first brought to their
consistent form.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import samples
from .visual_forms import _suspect, unify, unify_letter

#: Bounds of the sample a model is fitted on.
SAMPLE_DOCS, SAMPLE_BYTES = 300, 300_000
ORDER = 5
#: A sentence leaves its text's language if another one saves this many bits, and this many a byte.
MARGIN_BITS, MARGIN_RATE = 20.0, 0.45
#: Above this many bits a byte no language is recognised; fewer letters than this say nothing.
ALIEN_RATE, LEAST_LETTERS = 4.2, 10
BLOCK_BYTES = 1 << 20

# Three-letter codes of languages beside their two-letter ones (ISO 639).
CODES = {
    "cze": "cs", "ces": "cs", "slk": "sk", "slo": "sk", "pol": "pl", "ger": "de", "deu": "de", "eng": "en", "ukr": "uk",
    "rus": "ru", "fra": "fr", "fre": "fr", "ita": "it", "spa": "es", "hun": "hu", "slv": "sl", "hrv": "hr", "bul": "bg",
    "nld": "nl", "dut": "nl", "lat": "la", "lav": "lv", "lit": "lt", "est": "et", "ron": "ro", "rum": "ro", "hin": "hi",
}

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_fold[48:58] = 48
_fold[[9, 10, 11, 12, 13]] = 32
_TABLE = _fold.tobytes()
_is_letter = np.zeros(256, dtype=bool)
_is_letter[97:123] = True
_is_letter[128:] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Grams:
    """Exact map from packed n-grams to row numbers: open addressing at a load of at most a quarter."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, _EMPTY, dtype=np.uint64)
        self.rows = np.full(1 << self.bits, -1, dtype=np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at] == _EMPTY
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = np.zeros(len(at), dtype=bool)
            won[first] = True
            won &= free
            self.keys[at[won]] = keys[todo[won]]
            self.rows[at[won]] = todo[won]
            todo, at = todo[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.rows[at], np.int32(-1))
        on = np.flatnonzero((seen != keys) & (seen != _EMPTY))
        while len(on):
            at[on] = (at[on] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[on]]
            hit = seen == keys[on]
            out[on[hit]] = self.rows[at[on[hit]]]
            on = on[~hit & (seen != _EMPTY)]
        return out


def packed(data: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each byte from the n-th on, as one number."""
    out = data[n - 1 :].astype(np.uint64)
    for i in range(1, n):
        out |= data[n - 1 - i : len(data) - i].astype(np.uint64) << np.uint64(8 * i)
    return out


class PpmModel:
    """Frozen context trees of several languages, as tables of exact costs."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER, sample_bytes: int = SAMPLE_BYTES):
        self.languages = sorted(texts)
        self.order = order
        pad = b" " * order
        data = {c: b"".join(pad + t.encode().translate(_TABLE) for t in texts[c])[:sample_bytes] for c in self.languages}
        n_lang = len(self.languages)
        self.levels = []  # of each order: Grams, cost of the gram, cost of escaping from it as a context
        below = None
        counts = []
        for k in range(order + 2):  # grams of k+1 bytes; the last level serves for counting contexts only
            per = []
            for c in self.languages:
                arr = np.frombuffer(data[c], dtype=np.uint8)
                per.append(np.unique(packed(arr, k + 1), return_counts=True) if len(arr) > k else (np.empty(0, np.uint64), np.empty(0, np.int64)))
            counts.append(per)
        mask = [np.uint64((1 << (8 * (k + 1))) - 1) for k in range(order + 1)]
        totals0 = [(int(n.sum()), len(n)) for _, n in counts[0]]
        for k in range(order + 1):
            keys = np.unique(np.concatenate([x for x, _ in counts[k]])) if n_lang else np.empty(0, np.uint64)
            grams = Grams(keys)
            cost = np.zeros((len(keys), n_lang), dtype=np.float32)
            escape = np.zeros((len(keys), n_lang), dtype=np.float32)
            for i in range(n_lang):
                own, n = counts[k][i]
                have = np.zeros(len(keys), dtype=np.float64)
                have[np.searchsorted(keys, own)] = n
                # totals of the contexts of these grams
                if k == 0:
                    total = np.full(len(keys), float(totals0[i][0]))
                    kinds = np.full(len(keys), float(totals0[i][1]))
                else:
                    up, inverse = np.unique(own >> np.uint64(8), return_inverse=True)
                    t = np.bincount(inverse, weights=n, minlength=len(up)) if len(up) else np.empty(0)
                    d = np.bincount(inverse, minlength=len(up)).astype(float) if len(up) else np.empty(0)
                    at = np.searchsorted(up, keys >> np.uint64(8))
                    ok = at < len(up)
                    ok[ok] &= up[at[ok]] == (keys >> np.uint64(8))[ok]
                    total, kinds = np.zeros(len(keys)), np.zeros(len(keys))
                    total[ok], kinds[ok] = t[at[ok]], d[at[ok]]
                with np.errstate(divide="ignore", invalid="ignore"):
                    seen = np.log2(total + kinds) - np.log2(have)
                    out = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), 0.0)
                lower = np.full(len(keys), 8.0) if k == 0 else below[keys & mask[k - 1], i]
                cost[:, i] = np.where(have > 0, seen, out + lower)
                nxt, m = counts[k + 1][i]
                up, inverse = np.unique(nxt >> np.uint64(8), return_inverse=True)
                if len(up):
                    t = np.bincount(inverse, weights=m, minlength=len(up))
                    d = np.bincount(inverse, minlength=len(up))
                    escape[np.searchsorted(keys, up), i] = np.log2(t + d) - np.log2(d)
            self.levels.append((grams, cost, escape))
            below = _Lookup(grams, cost)
        self.escape0 = np.array([np.log2(t + d) - np.log2(d) if t else 0.0 for t, d in totals0], dtype=np.float32)

    def costs(self, data: np.ndarray) -> np.ndarray:
        """Bits of every byte of ``data`` from the byte after the first ``order`` ones on, by language."""
        k = self.order
        n = len(data) - k
        if n <= 0:
            return np.empty((0, len(self.languages)), dtype=np.float32)
        keys = packed(data, k + 1)
        grams, cost, _ = self.levels[k]
        rows = grams.find(keys)
        out = cost[rows] if len(cost) else np.zeros((n, len(self.languages)), dtype=np.float32)
        todo = np.flatnonzero(rows < 0)
        if len(todo):
            out[todo] = 0
        while len(todo):
            # the context of k bytes escapes, then the gram is asked one order lower
            context = keys[todo] >> np.uint64(8)
            if k == 0:
                out[todo] += self.escape0 + np.float32(8.0)
                break
            grams, cost, escape = self.levels[k - 1]
            at = grams.find(context)
            known = at >= 0
            out[todo[known]] += escape[at[known]]
            k -= 1
            short = keys[todo] & np.uint64((1 << (8 * (k + 1))) - 1)
            at = grams.find(short)
            known = at >= 0
            out[todo[known]] += cost[at[known]]
            todo, keys_left = todo[~known], short[~known]
            keys[todo] = keys_left
        return out


class _Lookup:
    def __init__(self, grams: Grams, cost: np.ndarray):
        self.grams, self.cost = grams, cost

    def __getitem__(self, at):
        keys, i = at
        return self.cost[self.grams.find(keys), i]


class Sentences:
    """Per sentence of a block of texts: its text, its range in bytes and characters, letters and bits by language."""

    def __init__(self, model: PpmModel, texts: list[str]):
        pad = b" " * model.order
        raw = [t.encode("utf-8", "replace") for t in texts]
        joined = pad.join([b"", *raw])
        data = np.frombuffer(joined, dtype=np.uint8)
        sizes = np.array([len(x) for x in raw], dtype=np.int64)
        first = np.cumsum(sizes + model.order) - sizes  # start of each text in data
        folded = _fold[data]
        bits = model.costs(folded)  # of data[order:]
        space = folded == 32
        stop = np.zeros(256, dtype=bool)
        stop[[33, 46, 63]] = True
        prev, nxt = np.empty_like(data), np.empty_like(data)
        prev[0], prev[1:] = 32, data[:-1]
        nxt[-1], nxt[:-1] = 32, data[1:]
        edge = (space & stop[prev]) | ((data == 10) & (prev == 10)) | ((data == 47) & (prev == 32) & (nxt == 32))
        cut = np.flatnonzero(edge)
        starts = np.unique(np.concatenate([first, cut])) if len(cut) else first
        whole = sizes > 0
        bounds = np.searchsorted(first, starts, side="right") - 1
        keep = (starts < first[bounds] + sizes[bounds]) & whole[bounds] & (bounds >= 0)
        starts, owner = starts[keep], bounds[keep]
        ends = np.minimum(np.append(starts[1:], len(data)), first[owner] + sizes[owner])
        n = len(model.languages)
        if len(starts):
            # sums between starts; padding before the next text is taken off by splitting there, too
            flat = np.empty(2 * len(starts), dtype=np.int64)
            flat[0::2], flat[1::2] = starts, ends
            flat -= model.order
            flat = np.minimum(flat, len(bits) - 1)
            sums = np.add.reduceat(bits.astype(np.float64), flat, axis=0)[0::2]
            over = ends - model.order >= len(bits)
            if over.any():  # the last sentence ends with the data: reduceat's last slice is then one byte short
                for i in np.flatnonzero(over):
                    sums[i] = bits[starts[i] - model.order :].sum(axis=0)
            letters = np.concatenate([[0], np.cumsum(_is_letter[folded])])
            self.letters = letters[ends] - letters[starts]
        else:
            sums, self.letters = np.zeros((0, n)), np.zeros(0, dtype=np.int64)
        self.owner, self.bits = owner, sums
        self.start, self.end = starts - first[owner], ends - first[owner]
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # of UTF-8: bytes that begin one
        self.char_start, self.char_end = chars[starts] - chars[first[owner]], chars[ends] - chars[first[owner]]


def judged(model: PpmModel, texts: list[str]) -> tuple[Sentences, np.ndarray, np.ndarray, np.ndarray]:
    """(sentences, language of each sentence or -1, language of each text or -1, confidence of each text)."""
    s = Sentences(model, texts)
    n_lang = len(model.languages)
    size = np.maximum(1, s.end - s.start)
    best = s.bits.argmin(axis=1) if len(s.bits) else np.zeros(0, dtype=np.int64)
    rate = s.bits[np.arange(len(best)), best] / size
    spoken = (rate <= ALIEN_RATE) & (s.letters * 2 >= size) & (s.letters >= 4)
    total = np.zeros((len(texts), n_lang))
    letters = np.zeros(len(texts))
    np.add.at(total, s.owner[spoken], s.bits[spoken])
    np.add.at(letters, s.owner[spoken], s.letters[spoken])
    main = np.where(letters >= LEAST_LETTERS, total.argmin(axis=1), -1)
    ordered = np.sort(total, axis=1)
    gap = ordered[:, 1] - ordered[:, 0] if n_lang > 1 else np.full(len(texts), 64.0)
    confidence = np.where(main >= 0, 1.0 / (1.0 + np.exp2(-np.minimum(gap, 60.0))), 0.0)
    own = main[s.owner] if len(s.owner) else np.zeros(0, dtype=np.int64)
    save = s.bits[np.arange(len(best)), own] - s.bits[np.arange(len(best)), best] if len(best) else np.zeros(0)
    leaves = spoken & (own >= 0) & (save >= MARGIN_BITS) & (save >= MARGIN_RATE * size) & (s.letters >= LEAST_LETTERS)
    language = np.where(spoken & (own >= 0), np.where(leaves, best, own), -1)
    return s, language, main, confidence


def blocks(texts: list[str], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of neighbouring texts of about ``limit`` characters together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def train(documents: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> PpmModel:
    """A model of every language that labels of ``documents`` name, from a bounded sample of each."""
    usable = documents.where(F.length(text) > 0).select(named_language(F.col(label)).alias("_label"), F.col(text).alias("_text"), F.col(key).alias("_key"))
    rows = samples.per_class(usable.where("_label is not null"), "_label", "_key", ["_label", "_text", "_key"], SAMPLE_DOCS)
    by: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: str(r[2])):
        by.setdefault(r[0], []).append(unify(r[1]))
    return PpmModel(by)


def label_code(label: str | None) -> str | None:
    """The two-letter code that a label names; of other labels the part before the region; ``None`` for what is no code."""
    if label is None:
        return None
    code = label.strip(" ").lower().replace("_", "-").split("-")[0]
    return CODES.get(code, code) if re.fullmatch("[a-z]{2,3}", code) else None


def places(text: str, form: str, bounds: list[int]) -> list[int]:
    """Where places of the consistent form stand in the text it was made of: both are followed by their letters and marks with
    a shape, which the form keeps in number and order."""
    if text == form:
        return bounds
    shaped = lambda c: sum(not x.isspace() and not unicodedata.combining(x) for x in unicodedata.normalize("NFD", c))
    before = list(accumulate((shaped(c) for c in form), initial=0))
    soft = lambda i: text[i] == "\u00ad" and text[i + 1 : i + 3].lstrip("\r")[:1] == "\n"
    after = list(accumulate((1 if soft(i) else shaped(unify_letter(c)) for i, c in enumerate(text)), initial=0))
    return [bisect_left(after, before[b]) if b < len(form) else len(text) for b in bounds]


STRETCHES = "k long, label string, lang string, confidence double, start int, end int, n_languages int"


def stretches(df: DataFrame, model: PpmModel, key: str, text: str, label: str) -> DataFrame:
    """One row for every stretch of one language of every text: (``k``, ``label``, ``lang``, ``confidence``, ``start``,
    ``end`` in characters of the text as stored, ``n_languages`` of the text). Texts of no language give no row."""
    if not model.languages:  # nothing to learn from
        return df.sparkSession.createDataFrame([], STRETCHES)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE_BYTES a language

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m.languages, dtype=object)
        for batch in batches:
            keys, labels = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_pylist()
            stored = [t or "" for t in batch.column(1).to_pylist()]
            texts = [unify(t) if _suspect.search(t) else t for t in stored]
            for a, b in blocks(texts):
                s, language, main, confidence = judged(m, texts[a:b])
                if not len(s.owner):
                    continue
                use = language >= 0
                owner, lang, bits = s.owner[use], language[use], s.bits[use]
                if not len(owner):
                    continue
                new = np.append(True, (owner[1:] != owner[:-1]) | (lang[1:] != lang[:-1]))
                at = np.flatnonzero(new)
                last = np.append(at[1:] - 1, len(owner) - 1)
                sums = np.add.reduceat(bits, at, axis=0)
                two = np.sort(sums, axis=1)
                gap = two[:, 1] - two[:, 0] if two.shape[1] > 1 else np.full(len(two), 60.0)
                sure = 1.0 / (1.0 + np.exp2(-np.minimum(gap, 60.0)))
                pair = np.unique(owner.astype(np.int64) * 64 + lang)
                n_langs = np.bincount(pair // 64, minlength=b - a)
                own = owner[at]
                start, end = s.char_start[use][at], s.char_end[use][last]
                for i in np.flatnonzero([stored[a + o] is not texts[a + o] for o in own.tolist()]).tolist():
                    start[i], end[i] = places(stored[a + own[i]], texts[a + own[i]], [int(start[i]), int(end[i])])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[a:b][own], pa.int64()),
                        pa.array([labels[a + i] for i in own.tolist()], pa.string()),
                        pa.array(names[lang[at]], pa.string()),
                        pa.array(sure, pa.float64()),
                        pa.array(start, pa.int32()),
                        pa.array(end, pa.int32()),
                        pa.array(n_langs[own], pa.int32()),
                    ],
                    names=["k", "label", "lang", "confidence", "start", "end", "n_languages"],
                )

    return df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("label")).mapInArrow(score, STRETCHES)


def named_language(label):
    """Column form of :func:`label_code`."""
    code = F.element_at(F.split(F.regexp_replace(F.lower(F.trim(label)), "_", "-"), "-"), 1)
    return F.when(code.rlike("^[a-z]{2,3}$"), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), code), code))


def wrong_labels(df: DataFrame, model: PpmModel, key: str, text: str, label: str, min_chars: int) -> DataFrame:
    """(``k``, ``lang``) of texts that are mixed or whose label does not name their language; one row a language."""
    found = stretches(df.where(F.length(text) >= min_chars), model, key, text, label)
    named = F.coalesce(named_language(F.col("label")), F.lit("-"))
    return found.where((F.col("n_languages") > 1) | (named != F.col("lang"))).select("k", "lang").distinct()

r"""Problem 7: passages of held-out items inside documents.

Texts and items are brought to plain words (case folded, accents, punctuation and line breaks gone). Every item is laid
out in adjacent blocks of ``BLOCK`` words; all blocks of all items form one Aho-Corasick automaton, which reads each
document once. A stretch of ``WINDOW`` item words with one word changed, dropped or added holds at least
``WINDOW``/2 - 1 unharmed words in a row and so a whole block; an exact check then extends each block found to both sides
over at most one such edit. Offsets are mapped back to the original characters.

Defined cases: null texts, items without id or text and items shorter than the window give no rows; repeated items and
documents count once per id; an item set larger than ``MAX_ITEM_CHARS`` is split over several automata, each reading the
documents once, so the automaton sent to the executors stays bounded; very long documents are read whole.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, BLOCK = 20, 5
MAX_ITEM_CHARS = 8_000_000

_marks = re.compile(r"[\u0300-\u036f\u00ad]+")
_divided = re.compile(r"(?<=\w)[-\u2010\u00ac]\n(?=\w)")
_word = re.compile(r"[^\W_]+")
_spelled = re.compile(r"(?:[^\W_][\u0300-\u036f\u00ad]*(?:[-\u2010\u00ac]\n(?=\w))?)+")
_plain = str.maketrans({"ł": "l", "đ": "d", "ø": "o", "ı": "i"})


def words(text: str) -> list[str]:
    """The plain words of a text."""
    if "\n" in text:
        text = _divided.sub("", text)
    text = text.casefold()
    if not text.isascii():
        text = _marks.sub("", unicodedata.normalize("NFD", text)).translate(_plain)
    return _word.findall(text)


def spans(text: str) -> list[tuple[int, int]]:
    """Where the words of :func:`words` stand in the text."""
    return [m.span() for m in _spelled.finditer(text)]


class Items:
    """One automaton over the blocks of a set of items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, block: int = BLOCK):
        self.window, self.block = window, block
        self.ids, self.words = [], []
        at: dict[str, list[tuple[int, int]]] = {}
        for name, text in items:
            w = words(text)
            if len(w) < window:
                continue
            for i in {*range(0, len(w) - block + 1, block)}:
                at.setdefault(" " + " ".join(w[i : i + block]) + " ", []).append((len(self.ids), i))
            self.ids.append(name)
            self.words.append(w)
        self.automaton = ahocorasick.Automaton()
        for key, places in at.items():
            self.automaton.add_word(key, (len(key), places))
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def search(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item -> (first word, last word + 1 of the document's best stretch, item words it covers)."""
        found: dict[int, tuple[int, int, int]] = {}
        if self.empty:
            return found
        doc = words(text)
        flat = " " + " ".join(doc) + " "
        tried: set[tuple[int, int, int]] = set()
        last, n = 0, 0
        for end, (size, places) in self.automaton.iter(flat):
            start = end - size + 1
            n += flat.count(" ", last, start)  # words before the block
            last = start
            for item, i in places:
                got = self._extended(self.words[item], doc, i, n, item, tried)
                if got and got[2] > found.get(item, (0, 0, 0))[2]:
                    found[item] = got
        return found

    def _extended(self, src, doc, i, d, item, tried):
        """The exact check: the stretch around a block with at most one edit, if it covers the window."""
        a, b, x, y = i, i + self.block, d, d + self.block  # item words [a, b) equal document words [x, y)
        while a and x and src[a - 1] == doc[x - 1]:
            a, x = a - 1, x - 1
        if (item, a, x) in tried:
            return None
        tried.add((item, a, x))
        while b < len(src) and y < len(doc) and src[b] == doc[y]:
            b, y = b + 1, y + 1
        best = (x, y, b - a)
        for skip_src, skip_doc in ((1, 1), (1, 0), (0, 1)):
            p, q = b + skip_src, y + skip_doc  # an edit behind
            if p <= len(src) and q <= len(doc):
                p0 = p
                while p < len(src) and q < len(doc) and src[p] == doc[q]:
                    p, q = p + 1, q + 1
                if p > p0 or skip_src:
                    best = max(best, (x, q, p - a), key=lambda t: t[2])
            p, q = a - skip_src, x - skip_doc  # an edit before
            if p >= 0 and q >= 0:
                p0 = p
                while p and q and src[p - 1] == doc[q - 1]:
                    p, q = p - 1, q - 1
                if p < p0 or skip_src:
                    best = max(best, (q, y, b - p), key=lambda t: t[2])
        return best if best[2] >= self.window else None


_automata: dict[str, Items] = {}


def _automaton(name: str, group) -> Items:
    """The automaton of a group, built once a worker; the last two are kept."""
    if name not in _automata:
        while len(_automata) > 1:
            _automata.pop(next(iter(_automata)))
        _automata[name] = Items(group.value)
    return _automata[name]


def grouped(items: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The items in groups of at most ``MAX_ITEM_CHARS``, one at a time."""
    group, size = [], 0
    for r in items.toLocalIterator():
        if size + len(r[1]) > MAX_ITEM_CHARS and group:
            yield group
            group, size = [], 0
        group.append((str(r[0]), r[1]))
        size += len(r[1])
    yield group


SCHEMA = "k long, item_id string, words int, start int, end int"


def leaks(docs: DataFrame, items: DataFrame, key: str, text: str, item_id: str, item_text: str) -> DataFrame:
    """(``k``, ``item_id``, ``words``, ``start``, ``end``): items found in documents, with the longest stretch of each."""
    held = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(item_id, item_text).distinct()
    out = None
    for group in grouped(held.orderBy(item_id, item_text)):
        shared = docs.sparkSession.sparkContext.broadcast(group)  # at most MAX_ITEM_CHARS, or one item
        name = uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, shared)
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = []
                for k, t in zip(keys, texts):
                    if not t:
                        continue
                    hits = automaton.search(t)
                    if hits:
                        at = spans(t)
                        for item, (x, y, n) in hits.items():
                            ok = y <= len(at)
                            rows.append((k, automaton.ids[item], n, at[x][0] if ok else None, at[y - 1][1] if ok else None))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()))],
                        names=["k", "item_id", "words", "start", "end"],
                    )

        part = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(scan, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out

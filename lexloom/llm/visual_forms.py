"""Problem 1: one consistent form for texts that look the same.

A text is decomposed, stripped of characters without a shape, its blanks are made alike and every letter is replaced by
the prototype of its look-alike class. Then each token's script is resolved: the script sets of its letters are
intersected; one script left means that spelling, several left (a whole-script confusable) mean the spelling of the
text's own script, none left (a mixed-script token) means the script most of its decisive letters belong to. Every
decision depends on the visible form alone, so equal-looking texts always end in the same string.

The classes are those of the public confusables data as the Unicode library of Spark's own JVM holds them
(:func:`public_letters`), reduced to letters of cased scripts that look like one Latin letter of the same case; a small fixed
table (``FIXED``) serves where there is no JVM to ask. Mathematical letters count as the letters they are made of.

Defined cases: null stays null; a text of blanks or invisible characters becomes ``''``; digits, case, accents, marks and
words are never merged (``2`` and ``²``, ``I`` and ``l``, ``-`` and an en dash stay different); very long texts are taken whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that cannot be told from a Latin letter (after the public Unicode confusables data).
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h",
    "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
}
GREEK = {
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z", "ϲ": "c", "ϳ": "j", "ο": "o", "ν": "v",
}
# Characters without a shape, kinds of blank, line ends, hyphens of the same look (as regex classes).
SHAPELESS = (
    r"\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164"
    r"\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufffb\x00-\x08\x0e-\x1f\x7f"
)
BLANKS = r"\t \u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
LINE_ENDS = r"\r\n|[\r\x0b\x0c\x85\u2028\u2029]"
HYPHENS = r"\u2010\u2011\ufe63\uff0d"
# Compositions and widths whose compatibility form looks the same: full width, ligatures, Roman numerals, digraphs, Kelvin.
FOLDED = (
    r"\uff01-\uff0c\uff0e-\uff5e\ufb00-\ufb06\u2160-\u217f\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3\u212a\u212b\uffe0-\uffe6"
    r"\u210a-\u2113\u2115\u2119-\u211d\u2124\u2128\u212c\u212d\u212f-\u2131\u2133\u2134\u2139\u213c-\u213f\u2145-\u2149"
    "\U0001d400-\U0001d6a5\U0001d6a8-\U0001d6c0\U0001d6c2-\U0001d6da\U0001d6dc-\U0001d6fa\U0001d6fc-\U0001d714\U0001d716-\U0001d734"
    "\U0001d736-\U0001d74e\U0001d750-\U0001d76e\U0001d770-\U0001d788\U0001d78a-\U0001d7a8\U0001d7aa-\U0001d7cb"
)

# Texts made only of these, with single inner blanks, already are in their final form.
PLAIN = (
    r"\n\x20-\x7e\u00a1-\u00ac\u00ae-\u0130\u0134-\u013e\u0141-\u0148\u014a-\u017e"
    r"\u2013\u2014\u2018-\u201f\u2022\u2026\u20ac\u2116"
)
SUSPECT = rf"[^{PLAIN}]|  |\n |^[ \n]|[ \n]$| \n"
_all_plain = rf"\A[\x20-\x7e{PLAIN}]*+\z"

_shapeless = re.compile(f"[{SHAPELESS}]+")
_soft_break = re.compile(r"\u00ad(?=\r?\n)")
_lines = re.compile(LINE_ENDS)
_blanks = re.compile(f"[{BLANKS}]+")
_edge = re.compile(" *\n *")
_folded = re.compile(f"[{FOLDED}]+")
_hyphens = re.compile(f"[{HYPHENS}]")
_token = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")
_suspect = re.compile(SUSPECT)

#: Cased scripts other than Latin, as the names of their letters begin, in order of rank where texts leave it open.
SCRIPTS = ("CYRILLIC", "GREEK", "ARMENIAN", "COPTIC", "CHEROKEE", "DESERET", "GEORGIAN", "GLAGOLITIC")
#: Where letters of these scripts and the phonetic Latin ones are looked for.
LETTER_BLOCKS = ((0x250, 0x590), (0x10A0, 0x1100), (0x13A0, 0x1400), (0x1C80, 0x1DC0), (0x1F00, 0x2000), (0x2C00, 0x2E00), (0xA640, 0xA6A0), (0xAB30, 0xABC0), (0x10400, 0x10450))
_has_mark = re.compile("[\u0300-\u036f]")


def script_of(letter: str) -> str:
    """The script of a letter: the first word of its name, or ``L`` for Latin and all that is not in ``SCRIPTS``."""
    name = unicodedata.name(letter, "").partition(" ")[0]
    return name if name in SCRIPTS else "L"


def _letters() -> Iterator[str]:
    for a, b in LETTER_BLOCKS:
        for c in map(chr, range(a, b)):
            if unicodedata.category(c) in ("Lu", "Ll") and unicodedata.normalize("NFD", c) == c and not unicodedata.name(c, "").startswith("LATIN CAPITAL"):
                yield c


def public_letters(spark: SparkSession) -> dict[str, str] | None:
    """Letter -> the Latin letter of the same case it cannot be told from, by the public confusables data of the JVM's Unicode
    library; ``None`` if the JVM has none. ``I``, ``l`` and digits, one class there, stay apart: capitals go with ``I``."""
    try:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        letters = list(_letters())
        shapes = checker.getSkeleton("\n".join(letters)).split("\n")
    except Exception:  # another JVM, or none to speak to
        return None
    out = {}
    for c, shape in zip(letters, shapes):
        if shape == "l" and c.isupper():
            shape = "I"
        if len(shape) == 1 and shape.isascii() and shape.isalpha() and shape != c and shape.isupper() == c.isupper():
            out[c] = shape
    return out


class Lookalikes:
    """Look-alike classes, and the consistent form of texts under them."""

    def __init__(self, letters: dict[str, str]):
        self.letters = letters
        self._build()

    def __getstate__(self):
        return self.letters

    def __setstate__(self, letters):
        self.letters = letters
        self._build()

    def _build(self) -> None:
        self.prototype = {ord(a): b for a, b in self.letters.items()}
        self.spell: dict[str, dict[int, str]] = {"L": {}}
        for a, b in sorted(self.letters.items(), reverse=True):  # the first letter of several in a script counts
            if script_of(a) != "L":
                self.spell.setdefault(script_of(a), {})[ord(b)] = a
        self.scripts = ["L", *[s for s in SCRIPTS if s in self.spell]]
        # the script sets of the prototypes; every other letter has its own script only
        self.sets = {chr(p): frozenset({"L", *[s for s in self.scripts[1:] if p in self.spell[s]]}) for p in {ord(b) for b in self.letters.values()}}
        own = {s: [] for s in self.scripts[1:]}
        for a, b in LETTER_BLOCKS:
            for c in range(a, b):
                s = script_of(chr(c))
                if s in own:
                    own[s].append(chr(c))
        self.decisive = {s: re.compile(f"[{''.join(x)}]") for s, x in own.items() if x}
        shared = "".join(sorted(self.sets))
        self.latin = re.compile(rf"(?![{shared}])[A-Za-z\u00c0-\u024f\u1e00-\u1eff]" if shared else r"[A-Za-z\u00c0-\u024f\u1e00-\u1eff]")
        self.script = lru_cache(1 << 16)(self._script)

    def _script(self, token: str, own: str) -> str:
        """The script to spell a token of prototypes in."""
        left = set(self.scripts)
        votes = dict.fromkeys(self.scripts, 0)
        for ch in token:
            if _has_mark.match(ch):
                continue
            sets = self.sets.get(ch) or {script_of(ch)}
            if len(sets) == 1:
                votes[next(iter(sets))] = votes.get(next(iter(sets)), 0) + 1
            left &= sets
        if len(left) == 1:
            return next(iter(left))
        if left:
            return own if own in left else "L" if "L" in left else min(left)
        return max(self.scripts, key=lambda s: (votes[s], s == own, s == "L"))

    def form(self, text: str | None) -> str | None:
        """The consistent form of one text."""
        if text is None or not _suspect.search(text):
            return text
        t = _soft_break.sub("-", text)
        t = _lines.sub("\n", t)
        t = _shapeless.sub("", t)
        t = _folded.sub(lambda m: unicodedata.normalize("NFKC", m[0]), t)
        t = _hyphens.sub("-", t)
        t = _blanks.sub(" ", t)
        t = _edge.sub("\n", t).strip(" \n")
        t = unicodedata.normalize("NFD", t).translate(self.prototype)
        n = {s: len(p.findall(t)) for s, p in self.decisive.items()} if _other.search(t) else {}
        if any(n.values()):
            n["L"] = len(self.latin.findall(t))
            rank = {s: i for i, s in enumerate(self.scripts)}
            own = max(n, key=lambda s: (n[s], -rank[s]))
            t = _token.sub(lambda m: m[0].translate(self.spell[self.script(m[0], own)]), t)
        return unicodedata.normalize("NFC", t)


_other = re.compile("[" + "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in LETTER_BLOCKS) + "]")
FIXED = Lookalikes(CYRILLIC | GREEK)
unify = FIXED.form


@lru_cache(1 << 14)
def unify_letter(c: str) -> str:
    """What a single character leaves in a consistent form, its spelling aside."""
    return _shapeless.sub("", _folded.sub(lambda m: unicodedata.normalize("NFKC", m[0]), c))


def lookalikes(spark: SparkSession) -> Lookalikes:
    """The public classes with the fixed ones."""
    return Lookalikes({**(public_letters(spark) or {}), "\u04cf": "l", **CYRILLIC, **GREEK})  # the small palochka has no dot


def consistent_form(text: Column, table: Lookalikes | None = None) -> Column:
    """Column form of :meth:`Lookalikes.form`: only texts with a suspect character travel to Python."""
    table = table or FIXED

    @F.pandas_udf(T.StringType())
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([table.form(x) for x in s.tolist()], dtype=object)

    return F.coalesce(form(F.when(suspect(text), text)), text)


def suspect(text: Column) -> Column:
    """Whether ``SUSPECT`` occurs in a text, said without alternatives to try at every character."""
    out = ~text.rlike(_all_plain)
    for pair in ("  ", "\n ", " \n"):
        out = out | F.contains(text, F.lit(pair))
    for blank in (" ", "\n"):
        out = out | text.startswith(blank) | text.endswith(blank)
    return out


def unify_column(df: DataFrame, text: str = "text", out: str = "text_form") -> DataFrame:
    """``df`` with the consistent form of ``text`` in ``out``; all other columns stay as they are."""
    return df.withColumn(out, consistent_form(F.col(text), lookalikes(df.sparkSession)))


#: A form of more rows than this is split, or of more than this share of all rows: so there are at most 1 / HOT_SHARE such forms.
HOT_ROWS, HOT_SHARE = 50_000, 0.00001


def lookalike_classes(df: DataFrame, key: str, text: str, min_chars: int = 40) -> DataFrame:
    """The class of every row: (``k``, ``form_id``, ``text_id``, ``changed``). Rows of one ``form_id`` look the same, those of
    one ``text_id`` are the same; ``changed`` rows are not in their consistent form. Rows without text or shorter than
    ``min_chars`` take no part."""
    return (
        df.where(F.length(text) >= min_chars)
        .select(F.col(key).alias("k"), F.col(text).alias("t"))
        .withColumn("form", consistent_form(F.col("t"), lookalikes(df.sparkSession)))
        .select(
            "k",
            F.unhex(F.md5("form")).alias("form_id"),
            F.unhex(F.md5("t")).alias("text_id"),
            (F.col("form") != F.col("t")).alias("changed"),
        )
    )


def lookalike_pairs(df: DataFrame, key: str, text: str, min_chars: int = 40, materialize=None) -> DataFrame:
    """The rows of :func:`lookalike_classes` as pairs of equal form but different characters: (``a``, ``b``), ``a`` < ``b``,
    each once.

    Only rows whose text is not already in its form can start a pair, so one side of the join holds these few, and
    exact copies are never joined among themselves. Forms of more than ``HOT_ROWS`` rows are split over several tasks.
    """
    base = lookalike_classes(df, key, text, min_chars)
    if materialize is not None:
        base = materialize(base, "forms")
    sizes = base.groupBy("form_id").agg(F.count("*").alias("n"), F.bool_or("changed").alias("any"))
    part_rows = max(HOT_ROWS, int(HOT_SHARE * base.count()))
    hot = sizes.where(F.col("any") & (F.col("n") > part_rows)).select("form_id", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"))
    if materialize is not None:
        hot = materialize(hot, "hot")  # at most 1 / HOT_SHARE rows
    parts = F.coalesce("parts", F.lit(1))
    left = (
        base.where("changed")
        .join(F.broadcast(hot), "form_id", "left")
        .select(F.col("k").alias("k1"), "form_id", F.col("text_id").alias("t1"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    )
    right = base.join(F.broadcast(hot), "form_id", "left").select(
        F.col("k").alias("k2"), "form_id", F.col("text_id").alias("t2"), F.col("changed").alias("c2"), F.pmod(F.xxhash64("k"), parts).cast("int").alias("part")
    )
    return (
        left.join(right, ["form_id", "part"])
        .where("t1 <> t2 and k1 <> k2 and (not c2 or k1 < k2)")
        .select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b"))
        .distinct()
    )

"""Problem 3: readable paragraphs from the text of scanned pages.

One pass over all texts counts the corpus vocabulary. On the pages, lines at the head and foot are compared within their
file after folding away what recognition confuses; a folded line on several pages of a file is running matter, and edge
numbers that keep step with the page order (or equal the page's own label) are page numbers. The lines are taken from each
edge inward, on and on as long as all before them are furniture. A word divided at a line end, over two lines or more, is
joined unless the vocabulary knows it as a compound with that hyphen. A word that is rare against a word it turns into by
undoing known confusions is misread and corrected. Then the furniture is dropped and lines are joined to paragraphs.

All statistics are aggregated before they are compared; a file with a third of all pages costs one row a distinct edge
line. What is known of words (``fixes``: corrections and compounds) stays a distributed table whatever its size: each page
sends the words it holds that may be in it, told by a bitmap of fixed size (``BITMAP_BITS``), to a join by word, and gets
back its own few fixes, so that one pass over the pages repairs them. Words on so many pages that their join would be
skewed number at most ``1 / HOT_SHARE`` and travel by broadcast.

Defined cases: null or blank pages and pages without a key give no rows; a null file is a file of its own; repeated deliveries of a page count once
as pages are counted by number; pages without noise come out with their lines joined; empty tables give empty results; a
correction is applied once (what it gives is not corrected again).
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines looked at in any case on each edge of a page, those further in as long as all before them are furniture; pages a
#: line must stand on to be running matter, a sequence to be numbers.
EDGE_LINES, LEAST_PAGES = 2, 2
#: Pages a line that looks like a part of the text beside it must stand on, besides more than half of the file's pages.
LEAST_FLOW_PAGES = 3
#: Likeness of a running line to one that is repeated exactly.
LEAST_LIKE = 0.8
#: A reading is wrong if the word it is mistaken for is this many times as frequent for each letter changed, and seen at
#: least so often. Letters a word is taken to be misread in at most, besides signs, of which there may be any number, and
#: the letters it must have for each.
TIMES, LEAST_SEEN = 12, 3
LETTER_CHANGES, LETTERS_A_CHANGE = 2, 4
#: Words gathered in a task before they are handed on.
FLUSH_WORDS = 400_000
#: Bits of the bitmaps that tell which words may be known (8 MB sent at most), and the share of all words of pages from
#: which a word's fix is broadcast (so at most 1 / HOT_SHARE of them) instead of joined.
BITMAP_BITS, HOT_SHARE = 1 << 26, 0.0001
#: Single lines of a file that share a word from which they are compared in several tasks, at least, and the share of all such
#: lines from which they are: so there are at most 1 / HOT_LINE_SHARE such words.
HOT_LINES, HOT_LINE_SHARE = 50_000, 0.00001

# What recognition prints for what stood there.
LETTER_CONFUSIONS = (
    ("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("lc", "k"), ("li", "h"), ("vv", "w"), ("c", "e"), ("e", "c"),
    ("f", "t"), ("f", "ř"), ("f", "ť"), ("t", "ł"), ("l", "t"), ("v", "y"), ("c", "o"), ("q", "ą"), ("ä", "á"), ("á", "ä"),
    ("é", "ě"), ("ü", "ů"), ("ů", "ü"), ("ź", "ž"), ("ž", "ź"), ("ż", "ź"), ("ž", "ż"), ("ö", "ő"), ("н", "и"), ("н", "п"),
    ("и", "н"), ("щ", "ш"), ("ш", "щ"), ("с", "е"), ("і", "ї"), ("nn", "m"), ("m", "rn"), ("u", "ii"), ("h", "b"), ("b", "h"),
)
SIGN_CONFUSIONS = {
    "0": "oоóö", "1": "liľłí", "|": "lľłi", "!": "ií", "+": "tťт", "@": "aаáä", "(": "cсč", "5": "sšś", "6": "bбö",
    "2": "zžź", "9": "gż", "8": "вb", "3": "зz", "\\/": "v", "'": "", "$": "s", "€": "e", "<": "c",
}
DIVISION_MARKS = "-\u00ac\u00ad\u2010="

_word = re.compile(r"[^\W\d_]+(?:['\u2019\-\u2010\u2011][^\W\d_]+)*")
_break = re.compile(rf"[{re.escape(DIVISION_MARKS)}][ \t]*\n[ \t]*")
_letters = re.compile(r"[^\W\d_]+")
_space = re.compile(r"(\s+)")
_outer = "„“”\"«»[]…"
_sign = re.compile(r"\\/|[01|!+@(5629838'$€<]")
_number = re.compile(
    r"^[\W_]*(?:(?:str|s|S|p|pp|с|стор)\.|(?:Seite|page|Page|strana|strona|сторінка)\b)?\s*(\d{1,5}|[ivxlcdmIVXLCDM]{1,8})\s*(?:[/z]\s*\d+)?[\W_]*$"
)
_beside = re.compile(r"^\s*(?:([\[(–-]?\s?\d{1,5}\s?[\])–.-]?)\s{2,}(\S.*?)|(\S.*?)\s{2,}([\[(–-]?\s?\d{1,5}\s?[\])–.-]?))\s*$")
_ends_text = re.compile(r"[.,;:!?\u2026]$|[-\u00ac\u00ad\u2010=]$")
_fold_pairs = (("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("lc", "k"), ("li", "h"), ("vv", "w"), ("\\/", "v"))
_fold_signs = str.maketrans(
    {"0": "o", "1": "l", "|": "l", "!": "l", "i": "l", "+": "t", "f": "t", "@": "a", "(": "c", "e": "c", "5": "s", "6": "b",
     "2": "z", "9": "g", "8": "b", "3": "z", "y": "v", "q": "a", "ł": "l", "h": "b", "'": None, "і": "l", "о": "o", "а": "a"}
)


def folded(line: str) -> str:
    """A line without case, accents, marks and the differences recognition makes."""
    t = "".join(c for c in unicodedata.normalize("NFD", line.lower()) if not "\u0300" <= c <= "\u036f")
    for a, b in _fold_pairs:
        t = t.replace(a, b)
    return "".join(c for c in t.translate(_fold_signs) if c.isalnum())


@lru_cache(1 << 17)
def folded_word(word: str) -> str:
    return folded(word) or word.lower()


def roman(text: str) -> int | None:
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    n = [value[c] for c in text.lower()]
    total = sum(-a if a < b else a for a, b in zip(n, n[1:] + [0]))
    return total if 0 < total < 400 and text in (text.lower(), text.upper()) else None


def edges(text: str) -> list[tuple]:
    """(line number, side, depth from the edge, running part folded, number, printed number, folded words, whether it looks
    like a part of the text beside it) of the edge lines: ``EDGE_LINES`` on each side, and those further in as long as all
    before them are numbers or do not look like a part of the text."""
    lines = [(i, x.strip()) for i, x in enumerate(text.split("\n")) if x.strip()]
    n = len(lines)

    def one(at: int, side: str, depth: int) -> tuple | None:
        i, line = lines[at]
        m = _number.match(line)
        if m:
            value = int(m[1]) if m[1].isdigit() else roman(m[1])
            return (i, side, depth, "", value, m[1], [], False) if value is not None else None
        m = _beside.match(line)
        number, body = (m[1] or m[4], m[2] or m[3]) if m else (None, line)
        digits = re.sub(r"\D", "", number) if number else ""
        nxt = lines[at + 1][1] if at + 1 < n else ""
        prev = lines[at - 1][1] if at else ""
        flows = bool(_ends_text.search(body)) and not m
        if side == "head" and nxt[:1].islower():
            flows = True
        if side == "foot" and (body[:1].islower() or (prev and not _ends_text.search(prev) and at > EDGE_LINES and body[-1:] == ".")):
            flows = True
        # halves of a divided word are text, however often they are repeated
        half = (prev.endswith(tuple(DIVISION_MARKS)) and body[:1].islower()) or (body.endswith(tuple(DIVISION_MARKS)) and nxt[:1].islower())
        words = [] if flows else sorted(set(map(folded_word, body.split())))
        return (i, side, depth, "" if flows and half else folded(body), int(digits) if digits else None, digits or None, words, flows)

    feet = range(n - 1, max(n - 1 - EDGE_LINES, -1), -1)
    heads = range(0, min(EDGE_LINES, n - len(feet)))
    found = {("head", at): one(at, "head", at) for at in heads} | {("foot", at): one(at, "foot", n - 1 - at) for at in feet}

    def open_so_far(side: str) -> bool:
        return all(x is not None and not x[7] for (s, _), x in found.items() if s == side)

    top, bottom = len(heads), n - len(feet) - 1
    while top <= bottom and top and open_so_far("head"):
        found["head", top] = one(top, "head", top)
        top += 1
    while top <= bottom and open_so_far("foot"):
        found["foot", bottom] = one(bottom, "foot", n - 1 - bottom)
        bottom -= 1
    return [x for x in found.values() if x is not None]


def _is_letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def _breaks(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, mark, right half) of every mark at a line end between two letters."""
    for m in _break.finditer(text):
        a, b = m.span()
        if a and _is_letter(text[a - 1]) and (right := _letters.match(text, b)):
            yield a, b, text[a], right[0]


def _left(text: str, end: int, start: int = 0) -> str:
    """The letters right before ``end``."""
    i = end
    while i > start and _is_letter(text[i - 1]):
        i -= 1
    return text[i:end]


def divisions(text: str) -> list[str]:
    """The divided words of a text as left TAB mark TAB right, in lower case; of a word over several lines every half with
    the next, and with all before it."""
    out, last, lefts = [], -1, []
    for a, b, mark, right in _breaks(text):
        word = _left(text, a)
        lefts = [*[x + word for x in lefts], word] if a - len(word) == last else [word]
        last = b
        if right[:1].islower():
            out += [f"{x}\t{mark}\t{right}".lower() for x in lefts]
    return out


def rejoined(text: str, decide) -> str:
    """A text with its divided words joined, from left to right; ``decide`` gives for (left, mark, right) what to join them by,
    or ``None`` to leave them; ``left`` holds all halves joined before."""
    out, last, carried = [], 0, ""
    for a, b, mark, right in _breaks(text):
        word = _left(text, a, last)
        whole = carried + word if a - len(word) == last else word
        by = decide(whole, mark, right)
        if by is not None:
            out += [text[last:a], by]
            last, carried = b, "" if by else whole
    return "".join([*out, text[last:]]) if out else text


def undivided(text: str) -> str:
    return rejoined(text, lambda left, mark, right: "" if right[:1].islower() else None)


def core(word: str) -> str:
    """A word without the marks around it."""
    return word.strip(_outer).rstrip(".,;:?)\u201c\u201d\"\u00bb]").lstrip("(\u201e\u00ab")


@lru_cache(1 << 17)
def bare(word: str) -> str:
    return core(word).lower()


def page_words(text: str) -> set[str]:
    """All words that may stand on a page after its divided words are joined or kept, and its divided words."""
    words = set(text.split())
    pairs = divisions(text)
    if _break.search(text):
        words.update(undivided(text).split(), rejoined(text, lambda left, mark, right: "-").split())
    out = set(map(bare, words))
    out.discard("")
    for x in pairs:
        left, _, right = x.split("\t")
        out.add(f"{left}\t{right}")
    return out


def _sign_classes() -> dict[int, str | None]:
    """Every sign and every letter it may stand for, mapped to one of them; a sign that stands for nothing to nothing."""
    head: dict[str, str] = {}

    def top(c: str) -> str:
        while head.setdefault(c, c) != c:
            c = head[c]
        return c

    for sign, options in SIGN_CONFUSIONS.items():
        for c in options if len(sign) == 1 else ():
            head[max(top(sign), top(c))] = min(top(sign), top(c))
    table: dict[int, str | None] = {ord(c): top(c) for c in head}
    return table | {ord(sign): None for sign, options in SIGN_CONFUSIONS.items() if not options}


_classes = _sign_classes()


def signature(word: str) -> str:
    """A word with all signs and letters that are taken for each other alike; what a misread word and the right one share."""
    return word.replace("\\/", "v").translate(_classes)


def signature_column(word: Column) -> Column:
    """Column form of :func:`signature`."""
    kept = {chr(c): to for c, to in _classes.items() if to}
    gone = "".join(chr(c) for c, to in _classes.items() if not to)
    return F.translate(F.replace(word, F.lit("\\/"), F.lit("v")), "".join(kept) + gone, "".join(kept.values()))


def _changed(token: str, changes: int, start: int = 0) -> Iterator[tuple[str, int]]:
    """The token with up to ``changes`` letter confusions undone, each behind the one before, and their number."""
    yield token, 0
    if changes < 1:
        return
    for a, b in LETTER_CONFUSIONS:
        at = token.find(a, start)
        while at >= 0:
            for rest, n in _changed(token[:at] + b + token[at + len(a) :], changes - 1, at + len(b)):
                yield rest, n + 1
            at = token.find(a, at + 1)


def readings(token: str) -> Iterator[tuple[str, str, int]]:
    """(signature, pattern, changes) of what a token may have been before recognition went wrong.

    Signs are left open, any number of them: the pattern tells which words of the signature fit. Letters are changed up to
    ``LETTER_CHANGES`` times, signs counting as one change.
    """
    signs = len(_sign.findall(token))
    letters = sum(c.isalpha() for c in token)
    plain = _sign.sub("", token).replace("-", "")
    if not plain.isalpha() or (signs and letters < max(2, signs)):
        return
    changes = min(LETTER_CHANGES, letters // LETTERS_A_CHANGE) - bool(signs)
    seen = set()
    for t, n in sorted(_changed(token, changes), key=lambda x: x[1]):
        if t not in seen and (signs or n):
            seen.add(t)
            yield signature(t), _sign.sub(lambda m: f"[{''.join(SIGN_CONFUSIONS[m[0]])}]" if SIGN_CONFUSIONS[m[0]] else "", t), n + bool(signs)


def odd_inside(token: str) -> bool:
    """Signs right between small letters, of which there are five or more and five for every two signs: wrong even in an
    unknown word."""
    if not re.fullmatch(r"[^\W\d_]+(?:(?:\\/|[01|!+@(5629])[^\W\d_]+)+", token):
        return False
    letters = sum(c.isalpha() for c in token)
    return letters >= 5 and 2 * letters >= 5 * len(_sign.findall(token))


def bitmap(words: DataFrame, word: Column) -> bytes:
    """A bit for the hash of every word: ``BITMAP_BITS`` at most, however many words there are."""
    place = F.crc32(word.cast("binary")) % F.lit(BITMAP_BITS)
    parts = words.select(place.alias("at")).groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias("bits"))
    out = bytearray(BITMAP_BITS // 8)
    for r in parts.collect():  # BITMAP_BITS at most
        out[r["part"] * 4096 : r["part"] * 4096 + 4096] = r["bits"]
    return bytes(out)


def may_hold(bits: bytes, word: str) -> bool:
    at = zlib.crc32(word.encode("utf-8", "replace")) % (8 * len(bits))
    return bool(bits[at >> 3] >> (at & 7) & 1)


def counted(df: DataFrame, text: str, page: str) -> DataFrame:
    """(``kind``, ``word``, ``n``): words of all texts (w), tokens of pages (p), divided words of pages (h)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tokens, divided = Counter(), Counter(), Counter()

        def out():
            bared = Counter()
            for w, n in tokens.items():
                bared[bare(w)] += n
            bared.pop("", None)
            rows = [(k, w, n) for k, c in (("w", words), ("p", bared), ("h", divided)) for w, n in c.items()]
            for c in (words, tokens, divided):
                c.clear()
            for i in range(0, len(rows), 100_000):
                part = rows[i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*part), (pa.string(), pa.string(), pa.int64()))],
                    names=["kind", "word", "n"],
                )

        for batch in batches:
            for t, on_page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    continue
                words.update(_word.findall(t.lower()))
                if on_page:
                    tokens.update(undivided(t).split())
                    divided.update(divisions(t))
                if len(words) + len(tokens) > FLUSH_WORDS:
                    yield from out()
        yield from out()

    parts = df.select(F.col(text).alias("t"), F.col(page).isNotNull().alias("on_page")).mapInArrow(
        count, "kind string, word string, n long"
    )
    return parts.groupBy("kind", "word").agg(F.sum("n").alias("n"))


def corrections(types: DataFrame) -> DataFrame:
    """(``wrong``, ``right``, ``n``): tokens of pages that are misread and how often they stand there; ``right`` is null where
    no known word fits. Among known words the one with the fewest changes is right, then the most frequent."""
    vocabulary = types.where("kind = 'w'").select("word", "n")
    known = vocabulary.where(F.col("n") >= LEAST_SEEN).select(
        F.col("word").alias("right"), F.col("n").alias("n_right"), signature_column(F.col("word")).alias("sig")
    )
    shared = types.sparkSession.sparkContext.broadcast(bitmap(known, F.col("sig")))  # BITMAP_BITS

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            rows = []
            for w, n in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(w, n, sig, pattern, changes) for sig, pattern, changes in readings(w) if may_hold(bits, sig)]
                if odd_inside(w):
                    rows.append((w, n, None, None, 0))
            if rows:
                types_ = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types_)], names=["wrong", "n", "sig", "pattern", "changes"])

    tokens = types.where("kind = 'p'").select("word", "n").mapInArrow(expand, "wrong string, n long, sig string, pattern string, changes int")
    own = vocabulary.select(F.col("word").alias("wrong"), F.col("n").alias("n_wrong"))
    n_wrong = F.coalesce("n_wrong", F.lit(0))
    sure = (
        tokens.where("sig is not null")
        .join(known, "sig")
        .where("right <> wrong and right rlike concat('^', pattern, '$')")
        .join(own, "wrong", "left")
        .where(F.col("n_right") >= F.when(F.col("changes") < 2, TIMES * n_wrong).otherwise(F.pow(F.lit(TIMES), "changes") * F.greatest(n_wrong, F.lit(1))))
    )
    best = sure.groupBy("wrong").agg(F.max_by("right", F.struct(-F.col("changes"), "n_right", "right")).alias("right"), F.max("n").alias("n"))
    odd = tokens.where("sig is null").select("wrong", F.lit(None).cast("string").alias("right"), "n")
    return best.unionByName(odd).groupBy("wrong").agg(F.max("right").alias("right"), F.max("n").alias("n"))


def compounds(types: DataFrame) -> DataFrame:
    """(``wrong``, ``n``): divided words, as left TAB right, that keep their hyphen, and how often they stand on pages."""
    vocabulary = types.where("kind = 'w'").select("word", "n")
    parts = F.split("word", "\t")
    divided = (
        types.where("kind = 'h'")
        .groupBy(parts[0].alias("a"), parts[2].alias("b"))
        .agg(F.sum("n").alias("n"))
        .select(F.concat_ws("\t", "a", "b").alias("wrong"), F.concat("a", "b").alias("joined"), F.concat_ws("-", "a", "b").alias("hyphened"), "n")
    )
    joined = vocabulary.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    hyphened = vocabulary.select(F.col("word").alias("hyphened"), F.col("n").alias("n_hyphened"))
    return (
        divided.join(hyphened, "hyphened")
        .join(joined, "joined", "left")
        .where(F.col("n_hyphened") > F.coalesce("n_joined", F.lit(0)))
        .select("wrong", "n")
    )


LINE = "line_no int, side string, depth int, running string, number int, printed string, words array<string>, flows boolean"
NOTED = f"k long, file string, page_num int, lines array<struct<{', '.join(x.replace(' ', ':', 1) for x in LINE.split(', '))}>>, suspects array<string>"


def noted(pages: DataFrame, bits: bytes | None = None) -> DataFrame:
    """(``k``, ``file``, ``page_num``, ``lines``, ``suspects``) of every page: its edge lines and, of its words, those that the
    bitmap may hold."""
    names = [x.split()[0] for x in LINE.split(", ")]
    s, i = pa.string(), pa.int32()
    line = pa.struct(list(zip(names, (i, s, i, s, i, s, pa.list_(s), pa.bool_()))))
    shared = pages.sparkSession.sparkContext.broadcast(bits)  # BITMAP_BITS

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        told = lru_cache(1 << 17)(lambda w: may_hold(known, w))
        for batch in batches:
            texts = batch.column(3).to_pylist()
            lines = [[dict(zip(names, (*x[:3], x[3] or None, *x[4:]))) for x in edges(t)] for t in texts]
            words = [list(filter(told, page_words(t))) if known else [] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(lines, pa.list_(line)), pa.array(words, pa.list_(s))],
                names=["k", "file", "page_num", "lines", "suspects"],
            )

    return pages.select("k", "file", "page_num", "t").mapInArrow(note, NOTED)


def edge_lines(pages: DataFrame) -> DataFrame:
    """(``k``, ``file``, ``page_num``, ``LINE``, ``deep``) from ``noted``; ``deep`` lines are those beyond ``EDGE_LINES``."""
    return pages.select("k", "file", "page_num", F.inline("lines")).withColumn("deep", F.col("depth") >= EDGE_LINES)


def furniture(lines: DataFrame, labels: DataFrame | None, materialize=None) -> DataFrame:
    """(``k``, ``side``, ``depth``, ``line_no``, ``is_header``, ``is_number``): edge lines that are running matter or carry page
    numbers.

    A line is running matter if its folded form stands on several pages of its file, or if it shares a folded word with such
    a line and is alike in at least ``LEAST_LIKE`` of its folded characters. Where it looks like a part of the
    text, its folded form must stand on more than half of the file's pages, or on ``LEAST_FLOW_PAGES`` where it does not look
    so: sentences that happen to break alike on a few pages are no running matter. Lines beyond ``EDGE_LINES`` are compared
    among themselves and must not look like text and stand on ``LEAST_FLOW_PAGES`` and more than half of the file's pages.
    """
    # first by page, so that pages are counted without being gathered
    seen = (
        lines.where("length(running) >= 4")
        .groupBy("file", "deep", "running", "page_num")
        .agg(F.bool_and("flows").alias("flows"), F.min(F.when(~F.col("flows"), F.col("words"))).alias("words"))
    )
    forms = seen.groupBy("file", "deep", "running").agg(
        F.count("*").alias("n"), F.count_if(~F.col("flows")).alias("n_steady"), F.min("words").alias("words")
    )
    pages = lines.select(F.col("file").alias("f"), "page_num").distinct().groupBy("f").agg(F.count("*").alias("all"))
    if materialize is not None:
        forms = materialize(forms, "forms")
    repeated = forms.where(~F.col("deep") & (F.col("n_steady") >= LEAST_PAGES)).unionByName(
        forms.where(F.col("deep") & (F.col("n_steady") >= LEAST_FLOW_PAGES)).join(pages, F.expr("file <=> f and 2 * n_steady > all")).drop("f", "all")
    )
    exact = repeated.select("file", "deep", "running")
    word = F.explode("words").alias("word")
    single = forms.where((F.col("n_steady") > 0) & (F.col("deep") | (F.col("n_steady") < LEAST_PAGES))).select("file", "deep", "running", word)
    single = single.withColumn("place", F.xxhash64("file", "deep", "word"))
    right = repeated.select(F.col("file").alias("f"), F.col("deep").alias("d"), F.col("running").alias("r"), word)
    right = right.select("f", "d", "r", F.col("word").alias("w"), F.xxhash64("f", "d", "word").alias("place"))
    if materialize is not None:
        single = materialize(single, "single")
    # places of very many lines are split; a place shared by chance is split alike on both sides
    part_lines = max(HOT_LINES, int(HOT_LINE_SHARE * single.count()))
    hot = single.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > part_lines).select("place", F.ceil(F.col("n") / part_lines).cast("int").alias("parts"))
    if materialize is not None:
        hot = materialize(hot, "hot")
    parts = F.coalesce("parts", F.lit(1))
    single = single.join(F.broadcast(hot), "place", "left").withColumn("part", F.pmod(F.xxhash64("running"), parts).cast("int")).drop("place", "parts")
    right = right.join(F.broadcast(hot), "place", "left").select("f", "d", "r", "w", F.explode(F.sequence(F.lit(0), parts - 1)).alias("p"))
    alike = (
        single.join(right.hint("merge"), F.expr("file <=> f and deep = d and word = w and part = p"))
        .where(F.abs(F.length("running") - F.length("r")) <= (1 - LEAST_LIKE) * F.length("r"))
        .where(F.levenshtein("running", "r") <= (1 - LEAST_LIKE) * F.length("r"))
        .select("file", "deep", "running")
    )
    persistent = (
        forms.where(~F.col("deep") & (F.col("n") >= LEAST_FLOW_PAGES))
        .join(pages, F.expr(f"file <=> f and (2 * n > all or n_steady >= {LEAST_FLOW_PAGES})"))
        .select("file", "deep", "running", F.lit(True).alias("firm"))
    )
    likely = exact.union(alike).withColumn("firm", F.lit(False))
    running = likely.union(persistent).groupBy("file", "deep", "running").agg(F.max("firm").alias("firm")).select(
        F.col("file").alias("f1"), F.col("deep").alias("d1"), F.col("running").alias("r1"), "firm"
    )
    steps = (
        lines.where("number is not null")
        .groupBy("file", "deep", (F.col("number") - F.col("page_num")).alias("step"))
        .agg(F.count_distinct("page_num").alias("n"))
        .where(F.col("n") >= LEAST_PAGES)
        .select(F.col("file").alias("f2"), F.col("deep").alias("d2"), F.col("step").alias("s2"), F.lit(True).alias("in_step"))
    )
    marked = lines.join(running, F.expr("file <=> f1 and deep = d1 and running = r1 and (firm or not flows)"), "left")
    out = marked.withColumn("is_header", F.col("firm").isNotNull()).join(
        steps, F.expr("file <=> f2 and deep = d2 and number - page_num = s2"), "left"
    )
    if labels is not None:
        own = labels.select(F.col("file").alias("f3"), F.col("page_num").alias("p3"), F.col("label").alias("label")).distinct()
        out = out.join(own.hint("merge"), F.expr("file <=> f3 and page_num = p3"), "left")  # one row a page
    else:
        out = out.withColumn("label", F.lit(None).cast("string"))
    number = (F.col("in_step").isNotNull() | F.coalesce(F.lower("printed") == F.lower("label"), F.lit(False))) & F.col("number").isNotNull()
    alone = F.col("running").isNull() | F.col("flows")
    return out.select(
        "k",
        "side",
        "depth",
        "line_no",
        F.coalesce("is_header", F.lit(False)).alias("is_header"),
        (number & (alone | F.coalesce("is_header", F.lit(False)))).alias("is_number"),
    ).where("is_header or is_number")


def marked_pages(found: DataFrame) -> DataFrame:
    """(``k``, ``drop``, ``header``, ``numbered``) from ``furniture``: what to drop of each page; a line beyond ``EDGE_LINES``
    only where all lines before it on its side are furniture, too."""
    lines = F.collect_set(F.struct("side", "depth", "line_no", "is_header", "is_number"))  # of one page
    before = lambda x: F.size(F.array_distinct(F.transform(F.filter("lines", lambda y: (y["side"] == x["side"]) & (y["depth"] < x["depth"])), lambda y: y["depth"])))
    kept = F.filter("lines", lambda x: (x["depth"] < EDGE_LINES) | (before(x) == x["depth"]))
    return (
        found.groupBy("k")
        .agg(lines.alias("lines"))
        .select("k", kept.alias("kept"))
        .select(
            "k",
            F.array_distinct(F.transform("kept", lambda x: x["line_no"])).alias("drop"),
            F.exists("kept", lambda x: x["is_header"]).alias("header"),
            F.exists("kept", lambda x: x["is_number"]).alias("numbered"),
        )
    )


def joined(body: str, keep) -> tuple[str, bool]:
    """(text with its divided words joined, whether one was); ``keep`` tells of left TAB right whether its hyphen stays."""
    found = False

    def by(left: str, mark: str, right: str) -> str | None:
        nonlocal found
        if not right[:1].islower() or keep(f"{left}\t{right}".lower()):
            return "-" if mark in "-\u2010" else None
        found = True
        return ""

    return rejoined(body, by), found


def read_right(text: str, wrong) -> tuple[str, bool]:
    """(text with its misread words corrected where the right one is known, whether one was misread); ``wrong`` gives the
    right form of a word, ``None`` where it is misread but unknown and ``False`` where it is not misread."""
    misread = {w for w in set(text.split()) if bare(w) and wrong(bare(w)) is not False}
    if not misread:
        return text, False

    def read(word: str) -> str:
        right, inner = wrong(bare(word)), core(word)
        if not right:
            return word
        right = right.upper() if inner.isupper() else right[:1].upper() + right[1:] if inner[:1].isupper() else right
        return word.replace(inner, right, 1)

    return "".join(read(w) if w in misread else w for w in _space.split(text)), True


def paragraphs(body: str) -> str:
    return "\n\n".join(p for p in (" ".join(x.split()) for x in re.split(r"\n\s*\n", body)) if p)


REPAIRED = "k long, text string, rest string, divided boolean, misread boolean, header boolean, numbered boolean"


def split_off(text: str, drop: list[int] | None) -> tuple[str, str]:
    """(body, furniture) of a page."""
    out = set(drop or ())
    lines = text.split("\n")
    return "\n".join(x for i, x in enumerate(lines) if i not in out), "\n".join(x for i, x in enumerate(lines) if i in out)


def repair(log: DataFrame, labels: DataFrame | None, key: str, text: str, file: str, page: str, materialize, release=None) -> DataFrame:
    """One row a page: (``k``, ``text``, ``rest``, ``divided``, ``misread``, ``header``, ``numbered``); ``rest`` is the furniture.

    The vocabulary is counted over all texts of ``log``; rows with a ``page`` number are the pages. ``release`` is called with
    tables of ``materialize`` that are not needed any more.
    """
    context = log.sparkSession.sparkContext
    types = materialize(counted(log, text, page), "types")
    pages = log.where(F.col(key).isNotNull() & F.col(page).isNotNull() & (F.length(text) > 0)).select(
        F.col(key).alias("k"), F.col(file).alias("file"), F.col(page).cast("int").alias("page_num"), F.col(text).alias("t")
    )
    kept = compounds(types).select("wrong", F.lit(None).cast("string").alias("right"), "n")
    fixes = materialize(corrections(types).unionByName(kept), "fixes")
    n_tokens = types.where("kind = 'p'").agg(F.sum("n")).first()[0] or 0
    if release is not None:
        release(types)
    is_hot = F.col("n") >= max(1.0, HOT_SHARE * n_tokens)
    hot = context.broadcast({r[0]: r[1] for r in fixes.where(is_hot).select("wrong", "right").collect()})  # 2 / HOT_SHARE words at most
    rare = fixes.where(~is_hot)
    notes = materialize(noted(pages, bitmap(rare, F.col("wrong"))), "notes")
    marks = marked_pages(furniture(edge_lines(notes), labels, materialize))
    own = (
        notes.select("k", F.explode("suspects").alias("wrong"))
        .join(rare.select("wrong", "right"), "wrong")
        .groupBy("k")
        .agg(F.collect_set(F.struct("wrong", "right")).alias("fixes"))  # words of one page
    )
    no = F.lit(False)
    # both grow with the pages: never broadcast
    work = pages.join(marks.hint("merge"), "k", "left").join(own.hint("merge"), "k", "left").select(
        "k", "t", "drop", "fixes", F.coalesce("header", no).alias("header"), F.coalesce("numbered", no).alias("numbered")
    )

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = hot.value
        for batch in batches:
            done = []
            for t, drop, own in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                here = {x["wrong"]: x["right"] for x in own or ()}

                def wrong(word: str, here=here):
                    return here[word] if word in here else everywhere.get(word, False)

                body, rest = split_off(t, drop)
                body, divided = joined(body, lambda pair: wrong(pair) is not False)
                body, m1 = read_right(body, wrong)
                rest, m2 = read_right(rest, wrong)
                done.append((paragraphs(body), rest, divided, m1 or m2))
            s, b = pa.string(), pa.bool_()
            columns = [pa.array([x[j] for x in done], t) for j, t in enumerate((s, s, b, b))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, *batch.columns[4:]], names=["k", "text", "rest", "divided", "misread", "header", "numbered"]
            )

    return work.mapInArrow(mend, REPAIRED)


def noise(pages: DataFrame) -> DataFrame:
    """(``k``, ``noise``): one row for each kind of noise of each page."""
    kinds = F.array(
        F.when(F.col("divided"), F.lit("hyphenation")),
        F.when(F.col("misread"), F.lit("misread")),
        F.when(F.col("header"), F.lit("header")),
        F.when(F.col("numbered"), F.lit("page_number")),
    )
    return pages.select("k", F.explode(kinds).alias("noise")).where("noise is not null")

"""Glossary: loading, matching in texts, ranking, lemma join, protection and restoring."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import ws_trim

# First cells that mark a header row.
HEADERS = ("source_lemma", "source", "src", "term", "lemma", "cs")
#: A glossary larger than this goes into several automata or tables, each reading the texts once.
GROUP_CHARS = 16_000_000

_sentinel = re.compile(r"Xtermzzz\d+z", re.IGNORECASE)
_plain_word = re.compile(r"\w+")


def clean(vocab: DataFrame) -> DataFrame:
    """(``ord``, ``term``, ``target``): terms trimmed and lower-cased, header row and blanks out, the last spelling wins,
    even with an empty target; a missing target is no row."""
    rows = vocab.select("ord", F.lower(ws_trim(F.col("term"))).alias("term"), ws_trim(F.col("target")).alias("target"))
    first = (F.col("ord") == 0) & F.col("term").isin(*HEADERS)
    usable = rows.where(~F.coalesce(first, F.lit(False)) & (F.col("term") != "") & F.col("target").isNotNull())
    last = usable.groupBy("term").agg(F.max_by(F.struct("ord", "target"), "ord").alias("last"))
    return last.select("last.ord", "term", "last.target")


def longest_first(terms: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` longest terms, earlier ones first among equals, with their rank from 1."""
    top = terms.orderBy(F.length("term").desc(), "ord").limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.length("term").desc(), "ord")))


def _groups(terms: DataFrame) -> Iterator[list[tuple[str, str]]]:
    group, size = [], 0
    for r in terms.select("term", "target").toLocalIterator():
        if size + len(r[0]) > GROUP_CHARS and group:
            yield group
            group, size = [], 0
        group.append((r[0], r[1]))
        size += len(r[0])
    if group:
        yield group


def _same_upper() -> dict[int, int]:
    groups = defaultdict(list)
    for c in map(chr, range(0x20000)):  # no letter beyond has another small letter with its capital
        if not "\ud800" <= c <= "\udfff" and c.lower() == c != c.upper():
            groups[c.upper()].append(ord(c))
    return {c: g[0] for g in groups.values() for c in g[1:]}


_SAME_UPPER = _same_upper()


def folded(text: str) -> str:
    """Letter by letter what ``re.IGNORECASE`` takes as the same; every letter keeps its place."""
    low = text.replace("\u0130", "i").lower()
    return low if low.isascii() else low.translate(_SAME_UPPER)


_automata: dict[str, object] = {}


def _automaton(name: str, group, fold: Callable[[str], str]):
    """The automaton of a group of terms, built once a worker; the last two are kept."""
    import ahocorasick

    if name not in _automata:
        automaton, alike = ahocorasick.Automaton(), defaultdict(list)
        for i, (term, _) in enumerate(group.value):
            if fold is str.lower:
                alike[term] = [i]
            else:
                alike[fold(term)].append(i)
        for term, ids in alike.items():
            automaton.add_word(term, (ids, len(term)))
        automaton.make_automaton()
        while len(_automata) > 1:
            _automata.pop(next(iter(_automata)))
        _automata[name] = automaton
    return _automata[name]


def matches(
    df: DataFrame, key: str, text: str, terms: DataFrame, whole_word: bool, fold: Callable[[str], str] = str.lower
) -> DataFrame:
    """(``key``, ``term``, ``target``): terms inside the lower-cased text, each once a text; as whole words or anywhere.

    One automaton over all terms reads each text once, so the cost does not grow with the glossary. With a ``fold`` other than
    lower case, terms are folded too, and those that fold alike are all given.
    """
    kind = dict(df.dtypes)[key]
    out = None
    for group in _groups(terms):
        shared = df.sparkSession.sparkContext.broadcast(group)  # at most GROUP_CHARS
        name = uuid.uuid4().hex

        def find(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, shared, fold)
            for batch in batches:
                rows = []
                for k, t in zip(*(c.to_pylist() for c in batch.columns)):
                    if not t:
                        continue
                    low, seen = fold(t), set()
                    for end, (ids, n) in automaton.iter(low):
                        if ids[0] in seen:
                            continue
                        a, b = end - n, end + 1
                        if whole_word and (
                            (a >= 0 and _in_word(low[a]) and _in_word(low[a + 1])) or (b < len(low) and _in_word(low[b]) and _in_word(low[end]))
                        ):
                            continue
                        seen.update(ids)
                    rows += [(k, *shared.value[i]) for i in seen]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], batch.schema.field(0).type)] + [pa.array([r[j] for r in rows], pa.string()) for j in (1, 2)],
                    names=[key, "term", "target"],
                )

        part = df.select(key, text).mapInArrow(find, f"{key} {kind}, term string, target string")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.select(key).limit(0).selectExpr(key, "'' as term", "'' as target")


def _in_word(c: str) -> bool:
    return c == "_" or c.isalnum()


def protect(text: str, phrases: list[tuple[str, str]]) -> tuple[str, list[str]]:
    """First occurrence of each phrase in any case, in the order given, replaced by the next sentinel: (text, targets)."""
    targets: list[str] = []
    for phrase, target in phrases:
        m = re.search(re.escape(phrase), text, re.IGNORECASE)
        if m:
            text = f"{text[: m.start()]}Xtermzzz{len(targets)}z{text[m.end() :]}"
            targets.append(target)
    return text, targets


def protected(df: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(``key``, ``protected_text``, ``targets``): multi-word terms of every text behind sentinels, the longest first.

    Candidates come from one automaton pass and are folded in the order of length; a text without any stays as it is, a null
    text too, both with no targets.
    """
    multi = terms.where("instr(term, ' ') > 0")
    found = matches(df, key, text, multi, False, folded).join(multi.select("term", "ord"), "term")
    ordered = found.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct((-F.length("term")).alias("n"), "ord", "term", "target"))).alias("hits")
    )
    kind = dict(df.dtypes)[key]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, t, h = (c.to_pylist() for c in batch.columns)
            done = [protect(x, [(y["term"], y["target"]) for y in hits]) if hits else (x, []) for x, hits in zip(t, h)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string()))],
                names=[key, "protected_text", "targets"],
            )

    return df.select(key, text).join(ordered, key, "left").select(key, text, "hits").mapInArrow(
        fold, f"{key} {kind}, protected_text string, targets array<string>"
    )


def plain_words(text: str) -> Iterator[tuple[str, str, str]]:
    """(word, lemma, number) where there is no annotation: the lemma is the word, its number unknown."""
    return ((w, w, "") for w in _plain_word.findall(text))


def annotated_words(conllu: str) -> Iterator[tuple[str, str, str]]:
    """(word, lemma, number) of CoNLL-U text, without ranges and empty nodes; ``number`` is '' where it is not given."""
    for line in map(str.strip, conllu.splitlines()):
        cells = line.split("\t")
        if not line or line.startswith("#") or len(cells) < 3 or "-" in cells[0] or "." in cells[0]:
            continue
        number = (f[7:] for f in (cells[5].split("|") if len(cells) > 5 else ()) if f.startswith("Number="))
        yield cells[1], cells[2], next(number, "")


def protect_words(text: str, targets: list[str], words: list[tuple[str, str]]) -> tuple[str, list[str]]:
    """First whole occurrence of each word, in its own case and in the order given, replaced by the next sentinel."""
    targets = list(targets)
    for word, target in words:
        m = re.search(rf"\b{re.escape(word)}\b", text)
        if m:
            text = f"{text[: m.start()]}Xtermzzz{len(targets)}z{text[m.end() :]}"
            targets.append(target)
    return text, targets


def protected_words(
    df: DataFrame, key: str, terms: DataFrame, annotation: str = "protected_text",
    parse: Callable[[str], Iterator[tuple[str, str, str]]] = plain_words,
) -> DataFrame:
    """(``key``, ``protected_text``, ``targets``) of ``protected`` with the words whose lemma is a term behind sentinels, too.

    ``annotation`` is the column ``parse`` reads words, lemmas and numbers from, in the order of the text: the tagged text
    itself, or what a service made of it (``backends.annotated`` with ``annotated_words``). Plural words and sentinels are
    left, every other word is replaced once. What is found stays in the row; each group of terms reads the texts once.
    """
    kind = dict(df.dtypes)[key]
    words = pa.list_(pa.struct([("i", pa.int32()), ("word", pa.string()), ("target", pa.string())]))
    found = "array<struct<i:int,word:string,target:string>>"
    columns = f"{key} {kind}, protected_text string, targets array<string>"
    rows = df.select(key, "protected_text", "targets", F.col(annotation).alias("annotation"), F.array().cast(found).alias("found"))
    for group in _groups(terms):
        shared = df.sparkSession.sparkContext.broadcast(dict(group))  # at most GROUP_CHARS

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            target = shared.value
            for batch in batches:
                out = batch.column(4).to_pylist()
                for a, hits in zip(batch.column(3).to_pylist(), out):
                    for i, (word, lemma, number) in enumerate(parse(a or "")):
                        if (t := target.get(lemma.lower())) is not None and number != "Plur" and not _sentinel.search(word):
                            hits.append({"i": i, "word": word, "target": t})
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, words)], names=batch.schema.names)

        rows = rows.mapInArrow(find, f"{columns}, annotation string, found {found}")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, targets, hits = (batch.column(i).to_pylist() for i in (1, 2, 3))
            done = [
                protect_words(x, y, [(w["word"], w["target"]) for w in sorted(h, key=lambda w: w["i"])]) if h else (x, y)
                for x, y, h in zip(t, targets, hits)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string()))],
                names=[key, "protected_text", "targets"],
            )

    return rows.drop("annotation").mapInArrow(fold, columns)


def lemma_hits(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(``term``, ``target``, ``n_tokens``): tokens (``word``, ``lemma``, ``number``) whose lemma is a term, without plural words and
    sentinels; counted before they meet the glossary."""
    usable = tokens.where((F.coalesce("number", F.lit("")) != "Plur") & ~F.col("word").rlike(r"(?i)Xtermzzz\d+z"))
    counted = usable.groupBy(F.lower("lemma").alias("term")).agg(F.count("*").alias("n_tokens"))
    return counted.join(terms.select("term", "target"), "term").select("term", "target", "n_tokens")

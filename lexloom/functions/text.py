"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ``str.split`` sees it, as a character class.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


#: The same characters, one by one, for trimming without a pattern.
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ws_trim(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(WS_CHARS))


def ws_split(text: Column) -> Column:
    """The words between white space; no words for null or blank text."""
    trimmed = ws_trim(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{WS}+"))


def is_blank(text: Column) -> Column:
    return ws_trim(F.coalesce(text, F.lit(""))) == ""


def half_even(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as an integer, halves to the even neighbour, in exact integer arithmetic."""
    q = F.floor(numerator / denominator).cast("long")  # exact below 2 ** 53
    r = numerator - q * denominator
    return q + F.when(2 * r > denominator, 1).when((2 * r == denominator) & (q % 2 == 1), 1).otherwise(0)


def url_safe_name(url: Column, prefix: str) -> Column:
    """The part after the last ``=`` without ``prefix``, reduced to letters, digits, ``-`` and ``_``."""
    tail = F.replace(F.substring_index(url, "=", -1), F.lit(prefix), F.lit(""))
    return F.regexp_replace(tail, r"[^\p{L}\p{Nd}_-]", "")


# Suffixes of pipeline files, the most specific first.
PIPELINE_SUFFIXES = (
    ".document.json", ".categories.json", ".teitok.xml", ".alto.xml", ".udpipe.conllu", ".conllu", ".xml", ".json", ".md",
    ".csv", ".txt",
)


def canonical_doc_id(name: Column) -> Column:
    """A file's name without folder and first matching suffix; without a known one, up to the first dot."""
    base = F.substring_index(name, "/", -1)
    out = F.substring_index(base, ".", 1)
    for suffix in reversed(PIPELINE_SUFFIXES):
        cut = F.substr(base, F.lit(1), F.length(base) - F.lit(len(suffix)))
        out = F.when(F.lower(base).endswith(suffix) & (F.length(base) > len(suffix)), cut).otherwise(out)
    return out


def record_doc_id(record: Column) -> Column:
    """The id a JSON record names, ``doc_id`` before ``id``; empty where it names none."""
    return F.coalesce(F.get_json_object(record, "$.doc_id"), F.get_json_object(record, "$.id"), F.lit(""))


# Three-letter language codes (ISO 639-3 and 639-2/B) with their two-letter form.
LANGUAGE_CODES = {
    "ces": "cs", "cze": "cs", "slk": "sk", "slo": "sk", "pol": "pl", "deu": "de", "ger": "de", "eng": "en", "ukr": "uk",
    "rus": "ru", "fra": "fr", "fre": "fr", "ita": "it", "spa": "es", "hun": "hu", "slv": "sl", "hrv": "hr", "bul": "bg",
    "nld": "nl", "lat": "la", "lav": "lv", "lit": "lt", "est": "et", "ron": "ro", "hin": "hi",
}


def two_letter_code(code: Column) -> Column:
    """The two-letter form of a language code; other codes stay as they are."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_CODES.items() for x in kv])
    return F.coalesce(table[code], code)


NUMBER = r"\d+(?:[.,]\d+)*"


def number_preservation(source: Column, target: Column) -> Column:
    """Share of the numbers of ``source`` found as text in ``target``, to four places; null without numbers."""
    numbers = F.regexp_extract_all(source, F.lit(NUMBER), 0)
    kept = F.size(F.filter(numbers, lambda n: F.contains(target, n)))
    return F.round(F.try_divide(kept, F.nullif(F.size(numbers), F.lit(0))), 4)


def length_ratio(source: Column, target: Column) -> Column:
    """Length of the stripped target over that of the stripped source, to four places; null for a blank source."""
    n = F.length(ws_trim(source))
    return F.round(F.try_divide(F.length(ws_trim(target)), F.nullif(n, F.lit(0))), 4)


SENTINEL = "Xtermzzz{}z"


def sentinel(i: Column) -> Column:
    return F.concat(F.lit("Xtermzzz"), i.cast("string"), F.lit("z"))


def scrub(text: Column) -> Column:
    """Remains of sentinels taken out of a text that holds their stem; the text itself if nothing would be left."""
    t = F.regexp_replace(text, r"(?i)Xtermzzz[a-z0-9]*", "")
    t = F.regexp_replace(t, r"(?iU)\bz{2,}\b", "")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    t = F.regexp_replace(t, r"(?U)\s+([)\].,;:!?])", "$1")
    t = F.regexp_replace(t, r"(?U)\(\s+", "(")
    t = F.regexp_replace(t, "^ +| +$", "")
    return F.when(F.contains(F.lower(text), F.lit("xtermzzz")) & ~is_blank(t), t).otherwise(text)


def restore(text: Column, targets: Column) -> Column:
    """Sentinels 0, 1, ... of ``text`` replaced by the entries of ``targets``, in order: as they are, in other case, or
    with spaces between their characters; each step sees the text the step before has left."""

    def spaced(i: Column) -> Column:
        return F.concat(F.lit("(?iU)"), F.array_join(F.split(sentinel(i), ""), r"\s*"))

    def step(state: Column, i: Column) -> Column:
        target = F.element_at(targets, i + 1)
        quoted = F.regexp_replace(target, r"([\\$])", r"\\$1")
        return F.when(F.contains(state, sentinel(i)), F.replace(state, sentinel(i), target)).otherwise(
            F.regexp_replace(state, spaced(i), quoted)
        )

    ordinals = F.when(F.size(targets) > 0, F.sequence(F.lit(0), F.size(targets) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ordinals, text, step)


def first_field(names: Column, hints: list[str]) -> Column:
    """The first name that holds the first hint, else the second, and so on, case folded; null if none does."""
    picks = [F.get(F.filter(names, _holds(h)), F.lit(0)) for h in hints]
    return F.coalesce(*picks) if picks else F.lit(None).cast("string")


def _holds(hint: str):
    return lambda n: F.contains(F.lower(n), F.lit(hint.lower()))

"""Language routing: codes, gates, model pairs, batches and the guards around a backend call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, two_letter_code, ws_split, ws_trim

#: Language used where nothing better is known; confidence above which a detected one counts.
FALLBACK, CONFIDENCE = "cs", 0.2
# Model pairs known without asking the service; lemma and translation models by language.
KNOWN_PAIRS = ("fr-en", "cs-en", "de-en", "uk-en", "ru-en", "pl-en")
LEMMA_MODELS = {
    "cs": "czech-pdt-ud-2.15-241121", "sk": "slovak-snk-ud-2.15-241121", "pl": "polish-pdb-ud-2.15-241121",
    "de": "german-gsd-ud-2.15-241121", "fr": "french-gsd-ud-2.15-241121", "en": "english-ewt-ud-2.15-241121",
    "ru": "russian-syntagrus-ud-2.15-241121", "uk": "ukrainian-iu-ud-2.15-241121",
}
NLLB_CODES = {
    "en": "eng_Latn", "cs": "ces_Latn", "de": "deu_Latn", "fr": "fra_Latn", "pl": "pol_Latn", "sk": "slk_Latn",
    "ru": "rus_Cyrl", "uk": "ukr_Cyrl",
}
#: Frequent short words of each language, for the built-in identifier.
STOP_WORDS = {
    "cs": ("je", "se", "na", "že", "byl", "byla", "byly", "nad", "pod", "jeho", "které", "ve", "při", "bez"),
    "sk": ("je", "sa", "na", "že", "bol", "bola", "boli", "nad", "pod", "jeho", "ktoré", "vo", "pri", "bez"),
    "pl": ("jest", "się", "na", "że", "był", "była", "były", "nad", "pod", "jego", "które", "we", "przy", "bez", "z"),
    "de": ("der", "die", "das", "und", "war", "wurde", "mit", "von", "auf", "aus", "ein", "eine", "im", "in"),
    "en": ("the", "and", "was", "were", "with", "of", "on", "from", "a", "an", "in", "by", "is", "to"),
    "uk": ("та", "і", "на", "що", "був", "була", "були", "над", "під", "його", "які", "у", "при", "без", "до"),
}


def lookup(table: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def lemma_model(lang: Column) -> Column:
    return lookup(LEMMA_MODELS, lang, LEMMA_MODELS["cs"])


def nllb_code(lang: Column) -> Column:
    return lookup(NLLB_CODES, lang, NLLB_CODES["en"])


def identified(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``lang`` and ``confidence`` by stop words: the language with most hits, its share of all hits.

    Blank texts are ('en', 0.0); ties go to the first code of the alphabet. Everything stays in the row.
    """
    words = ws_split(F.lower(F.replace(F.col(text), F.lit("\n"), F.lit(" "))))

    def count(stop: tuple[str, ...]) -> Column:
        return F.size(F.filter("_w", lambda w: w.isin(*stop)))

    hits = F.array(*[F.struct(count(stop).alias("n"), F.lit(lang).alias("lang")) for lang, stop in sorted(STOP_WORDS.items())])
    most = F.array_max(F.transform(F.col("_h"), lambda h: h["n"]))
    total = F.aggregate(F.col("_h"), F.lit(0), lambda a, h: a + h["n"])
    return (
        df.withColumn("_w", words)
        .withColumn("_h", hits)
        .withColumn("lang", F.when(total > 0, F.get(F.filter("_h", lambda h: h["n"] == most), F.lit(0))["lang"]).otherwise("en"))
        .withColumn("confidence", F.when(total > 0, F.round(most / total, 4)).otherwise(0.0))
        .drop("_w", "_h")
    )


def gated(lang: Column, confidence: Column) -> Column:
    """The detected language if its confidence is above the gate, else the fallback."""
    return F.when(confidence > CONFIDENCE, lang).otherwise(FALLBACK)


def pair(source: Column, target: Column, known: tuple[str, ...] = KNOWN_PAIRS) -> Column:
    """The model pair of two language codes; an unknown pair falls back to cs-en, target included."""
    wanted = F.concat_ws("-", two_letter_code(source), two_letter_code(target))
    return F.when(wanted.isin(*known), wanted).otherwise("cs-en")


def batches(df: DataFrame, page: list[str], lang: str, ord_col: str, text: str) -> DataFrame:
    """One row a page and language: the non-blank texts joined by line breaks in order, their places, the group's rank.

    Batches are of one page, so a group is as large as a page; the order of groups on a page is that of first appearance.
    """
    grouped = df.groupBy(*page, lang).agg(
        F.min(ord_col).alias("first_ord"),
        F.sort_array(F.collect_list(F.when(~is_blank(F.col(text)), F.struct(ord_col, text)))).alias("items"),
    )
    return grouped.select(
        *page,
        lang,
        "first_ord",
        F.size("items").alias("n_items"),
        F.transform("items", lambda x: x[ord_col]).alias("places"),
        F.array_join(F.transform("items", lambda x: x[text]), "\n").alias("batch_text"),
    )


def boundary_kept(batch_out: Column, n_items: Column) -> Column:
    """Whether a translated batch still has one line for every text that went in."""
    return F.size(F.split(ws_trim(batch_out), "\n")) == n_items


def needs_backend(source: Column, source_lang: Column, target_lang: Column) -> Column:
    """Identity rows (blank text, same language) are told apart before any backend sees them."""
    return ~is_blank(source) & ~F.coalesce(source_lang == target_lang, F.lit(False))


def ratio_ok(source: Column, target: Column, least_chars: int = 16, low: float = 0.25, high: float = 4.0) -> Column:
    """A translation is suspect if empty, or, for sources of some length, if its length is out of proportion."""
    n, m = F.length(ws_trim(source)), F.length(ws_trim(target))
    return ~is_blank(target) & ((n < least_chars) | m.between(n * low, n * high))

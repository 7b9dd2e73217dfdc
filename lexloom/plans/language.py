"""Queries over glossary, tagging and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import glossary, identify, routing
from ..session import load
from ..sources import readers
from .oracles import LINES, trim, words
from .registry import query

_VOCAB = f"""
    spelled AS (SELECT ord, lower({trim("term")}) AS term, {trim("target")} AS target FROM vocab),
    terms AS (SELECT ord, term, target FROM spelled
              WHERE NOT (ord = 0 AND coalesce(term, '') IN ('source_lemma', 'source', 'src', 'term', 'lemma', 'cs'))
                AND term <> '' AND target IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY term ORDER BY ord DESC) = 1)"""
_BOUND = r"'(^|[^\p{L}\p{N}_])' || regexp_escape(term) || '($|[^\p{L}\p{N}_])'"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.clean(load(spark, sf_dir, "vocab"))


@query(f"WITH {_VOCAB} SELECT ord, term, target FROM terms")
def vocab_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir)


_HITS = f"""{_VOCAB},
    low AS MATERIALIZED (SELECT DISTINCT seg_id, file, lower(text_auto) AS t FROM qa_log WHERE text_auto IS NOT NULL),
    inside AS MATERIALIZED (SELECT seg_id, file, t, term, target FROM low JOIN terms ON contains(t, term)),
    hits AS (SELECT seg_id, file, term, target FROM inside WHERE regexp_matches(t, {_BOUND}))"""


@query(f"WITH {_HITS} SELECT DISTINCT seg_id, term, target FROM hits")
def glossary_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.matches(load(spark, sf_dir, "qa_log"), "seg_id", "text_auto", _terms(spark, sf_dir), True).distinct()


@query(f"WITH {_VOCAB} SELECT DISTINCT doc_id, term, target FROM documents JOIN terms ON contains(lower(text), term)")
def glossary_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.matches(load(spark, sf_dir, "documents"), "doc_id", "text", _terms(spark, sf_dir), False)


@query(
    f"""WITH {_VOCAB} SELECT term, target, CAST(row_number() OVER (ORDER BY length(term) DESC, ord) AS INTEGER) AS rank
    FROM terms QUALIFY rank <= 40"""
)
def glossary_top40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.longest_first(_terms(spark, sf_dir), 40).select("term", "target", "rank")


_TOKEN = r"regexp_replace(lower(w), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')"


@query(
    f"""WITH {_VOCAB}, d AS (SELECT {words("text")} AS w FROM documents), t AS (SELECT w[i] AS w, i FROM (SELECT w, unnest(generate_series(1, len(w))) AS i FROM d))
    SELECT term, target, count(*) AS n_tokens FROM (SELECT {_TOKEN} AS lemma FROM t WHERE i % 2 = 0 AND NOT regexp_matches(w, '(?i)Xtermzzz\\d+z')) JOIN terms ON lemma = term GROUP BY term, target"""
)
def lemma_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens whose lemma (here: the token, case folded, marks off) is a term, every other one being plural; counted before they
    meet the glossary."""
    words_ = load(spark, sf_dir, "documents").select(F.posexplode(fx.ws_split(F.col("text"))).alias("at", "word"))
    lemma = F.regexp_replace(F.lower("word"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    tokens = words_.select("word", lemma.alias("lemma"), F.when(F.col("at") % 2 == 0, "Plur").otherwise("Sing").alias("number"))
    return glossary.lemma_hits(tokens, _terms(spark, sf_dir))


@query(f"WITH {_HITS} SELECT file, count(*) AS n_protected, grouping(file) = 1 AS is_total FROM hits GROUP BY ROLLUP (file)")
def protected_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "qa_log")
    found = glossary.matches(log, "seg_id", "text_auto", _terms(spark, sf_dir), True).distinct()
    files = log.select("seg_id", "file").dropDuplicates(["seg_id"])
    return found.join(files, "seg_id").rollup("file").agg(F.count("*").alias("n_protected"), (F.grouping("file") == 1).alias("is_total"))


@query(
    f"""WITH RECURSIVE {_VOCAB},
    multi AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY length(term) DESC, ord) AS r FROM terms WHERE contains(term, ' ')),
    folded(doc_id, r, t, k) AS (SELECT doc_id, CAST(0 AS BIGINT), text, 0 FROM documents UNION ALL
      SELECT doc_id, r, CASE WHEN p > 0 THEN substr(t, 1, p - 1) || 'Xtermzzz' || k || 'z' || substr(t, p + n) ELSE t END, k + CASE WHEN p > 0 THEN 1 ELSE 0 END
      FROM (SELECT f.doc_id, m.r, f.t, f.k, coalesce(strpos(lower(f.t), m.term), 0) AS p, length(m.term) AS n FROM folded f JOIN multi m ON m.r = f.r + 1))
    SELECT doc_id, t AS protected_text, k AS n_tags FROM folded WHERE r = (SELECT count(*) FROM multi)"""
)
def tag_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = glossary.protected(load(spark, sf_dir, "documents"), "doc_id", "text", _terms(spark, sf_dir))
    return done.select("doc_id", "protected_text", F.size("targets").alias("n_tags"))


@query()
def tag_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, then words whose lemma (here: the word, case folded, without a number) is a term."""
    terms = _terms(spark, sf_dir)
    done = glossary.protected(load(spark, sf_dir, "documents"), "doc_id", "text", terms)
    return glossary.protected_words(done, "doc_id", terms).select("doc_id", "protected_text", F.size("targets").alias("n_tags"))


@query(
    f"""WITH {_VOCAB} SELECT term, 'A ' || target || ' b ' || term || ' c ' || target AS restored FROM terms"""
)
def restore_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat(
        F.lit("A "), fx.sentinel(F.lit(0)), F.lit(" b "), F.upper(fx.sentinel(F.lit(1))), F.lit(" c "),
        F.array_join(F.split(fx.sentinel(F.lit(2)), ""), " "),
    )
    return _terms(spark, sf_dir).select("term", fx.restore(broken, F.array("target", "term", "target")).alias("restored"))


@query(
    r"""WITH t AS (SELECT DISTINCT seg_id, text_en || ' xTERMzzz' || seg_id || 'z , ( zzz ok )' AS x FROM qa_log WHERE text_en IS NOT NULL),
    a AS (SELECT seg_id, regexp_replace(x, '(?i)xtermzzz[a-z0-9]*', '', 'g') AS x FROM t),
    b AS (SELECT seg_id, regexp_replace(x, '(?i)(^|[^\p{L}\p{N}_])z{2,}([^\p{L}\p{N}_]|$)', '\1\2', 'g') AS x FROM a),
    c AS (SELECT seg_id, regexp_replace(x, '[ \t]{2,}', ' ', 'g') AS x FROM b),
    d AS (SELECT seg_id, regexp_replace(x, '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+([)\].,;:!?])', '\1', 'g') AS x FROM c)
    SELECT seg_id, regexp_replace(regexp_replace(x, '\([\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '(', 'g'), '^ +| +$', '', 'g') AS scrubbed FROM d"""
)
def scrub_debris(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "qa_log").where("text_en is not null")
    broken = F.concat("text_en", F.lit(" xTERMzzz"), "seg_id", F.lit("z , ( zzz ok )"))
    return log.select("seg_id", fx.scrub(broken).alias("scrubbed")).distinct()


#: Codes and names are written out here, not taken from the package, so that these statements stand for themselves.
_CODES = """('ces', 'cs'), ('cze', 'cs'), ('slk', 'sk'), ('slo', 'sk'), ('pol', 'pl'), ('deu', 'de'), ('ger', 'de'), ('eng', 'en'), ('ukr', 'uk'),
    ('rus', 'ru'), ('fra', 'fr'), ('fre', 'fr'), ('ita', 'it'), ('spa', 'es'), ('hun', 'hu'), ('slv', 'sl'), ('hrv', 'hr'), ('bul', 'bg'),
    ('nld', 'nl'), ('lat', 'la'), ('lav', 'lv'), ('lit', 'lt'), ('est', 'et'), ('ron', 'ro'), ('hin', 'hi')"""
_CODED = f"""
    codes(long, short) AS (VALUES {_CODES}),
    coded AS (SELECT seg_id, lang, text_auto, text_en, coalesce(short, part) AS code
              FROM (SELECT *, split_part(lower({trim("lang")}), '-', 1) AS part FROM qa_log) LEFT JOIN codes ON part = long)"""


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.substring_index(F.lower(fx.ws_trim(F.col("lang"))), "-", 1)
    return load(spark, sf_dir, "qa_log").withColumn("code", fx.two_letter_code(part))


@query(f"WITH {_CODED} SELECT code, count(*) AS n_rows FROM coded GROUP BY code")
def lang_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n_rows"))


@query(f"WITH {_CODED} SELECT DISTINCT seg_id, lang, code FROM coded")
def iso_code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir).select("seg_id", "lang", "code").distinct()


_LISTS = ", ".join("('" + c + "', [" + ", ".join(f"'{w}'" for w in ws) + "])" for c, ws in sorted(routing.STOP_WORDS.items()))


@query(
    f"""WITH stop(lang, list) AS (VALUES {_LISTS}),
    toks AS (SELECT doc_id, {words("lower(replace(text, chr(10), ' '))")} AS w FROM documents),
    n AS (SELECT doc_id, lang, len(list_filter(w, lambda x: list_contains(list, x))) AS n FROM toks, stop),
    best AS (SELECT doc_id, lang, n, sum(n) OVER (PARTITION BY doc_id) AS total FROM n
             QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) = 1)
    SELECT doc_id, CASE WHEN total > 0 THEN lang ELSE 'en' END AS lang,
           CASE WHEN total > 0 THEN round(CAST(n AS DOUBLE) / total, 4) ELSE 0.0 END AS confidence,
           CASE WHEN total > 0 AND round(CAST(n AS DOUBLE) / total, 4) > 0.2 THEN lang ELSE 'cs' END AS gated FROM best"""
)
def lang_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = routing.identified(load(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", "lang", "confidence", routing.gated(F.col("lang"), F.col("confidence")).alias("gated"))


@query()
def lang_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every logged text by a model fitted on labelled documents, gated by its confidence."""
    model = identify.fitted(load(spark, sf_dir, "documents"), "text", "lang", "doc_id")
    found = identify.identified(load(spark, sf_dir, "qa_log"), model, "seg_id", "text_auto").distinct()
    return found.select("seg_id", "lang", "confidence", routing.gated(F.col("lang"), F.col("confidence")).alias("gated"))


_PAIRS = "'fr-en', 'cs-en', 'de-en', 'uk-en', 'ru-en', 'pl-en'"


@query(
    f"""WITH {_CODED} SELECT CASE WHEN code || '-en' IN ({_PAIRS}) THEN code || '-en' ELSE 'cs-en' END AS pair, count(*) AS n_rows
    FROM coded GROUP BY 1"""
)
def pair_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir).groupBy(routing.pair(F.col("code"), F.lit("en")).alias("pair")).agg(F.count("*").alias("n_rows"))


_LONG_CODES = "'ces', 'eng', 'fra', 'deu', 'rus', 'pol', 'ukr', 'slk', 'bul', 'hrv', 'slv', 'lav', 'lit', 'est', 'hun', 'ron', 'spa', 'ita', 'nld', 'hin', 'xyz'"
_SHORT_CODES = "'cs', 'en', 'fr', 'de', 'ru', 'pl', 'uk', 'sk', 'bg', 'hr', 'sl', 'lv', 'lt', 'et', 'hu', 'ro', 'es', 'it', 'nl', 'hi', 'xyz'"


@query(f"SELECT doc_id, [{_LONG_CODES}][doc_id % 21 + 1] AS code, [{_SHORT_CODES}][doc_id % 21 + 1] AS short FROM documents")
def iso_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code that the language models name, dealt over the documents, in its short form."""
    code = F.get(F.expr(f"array({_LONG_CODES})"), F.pmod("doc_id", F.lit(21)).cast("int"))
    return load(spark, sf_dir, "documents").select("doc_id", code.alias("code")).withColumn("short", fx.two_letter_code(F.col("code")))


@query(
    f"""WITH {_CODED}, c AS (SELECT DISTINCT code AS lang FROM coded)
    SELECT lang, CASE lang WHEN 'sk' THEN 'slovak-snk-ud-2.15-241121' WHEN 'pl' THEN 'polish-pdb-ud-2.15-241121' WHEN 'de' THEN 'german-gsd-ud-2.15-241121'
      WHEN 'fr' THEN 'french-gsd-ud-2.15-241121' WHEN 'en' THEN 'english-ewt-ud-2.15-241121' WHEN 'ru' THEN 'russian-syntagrus-ud-2.15-241121'
      WHEN 'uk' THEN 'ukrainian-iu-ud-2.15-241121' ELSE 'czech-pdt-ud-2.15-241121' END AS lemma_model,
      CASE lang WHEN 'cs' THEN 'ces_Latn' WHEN 'sk' THEN 'slk_Latn' WHEN 'pl' THEN 'pol_Latn' WHEN 'de' THEN 'deu_Latn' WHEN 'fr' THEN 'fra_Latn'
      WHEN 'ru' THEN 'rus_Cyrl' WHEN 'uk' THEN 'ukr_Cyrl' ELSE 'eng_Latn' END AS nllb_code FROM c"""
)
def model_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _coded(spark, sf_dir).select(F.col("code").alias("lang")).distinct()
    return codes.select("lang", routing.lemma_model(F.col("lang")).alias("lemma_model"), routing.nllb_code(F.col("lang")).alias("nllb_code"))


@query(
    f"""WITH {_CODED}, c AS (SELECT DISTINCT code FROM coded WHERE regexp_matches(code, '^[a-z]{{2}}$')),
    p AS (SELECT 'object' AS answer, code || '-en' AS pair FROM c UNION SELECT 'list', 'en-' || code FROM c UNION SELECT 'broken', unnest([{_PAIRS}]))
    SELECT answer, pair, list_sort(string_split(pair, '-')) AS codes FROM p"""
)
def supported_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model pairs of three catalogue answers, an object, a plain list and a broken one, made of the codes of the log."""
    codes = _coded(spark, sf_dir).select("code").distinct().where(F.col("code").rlike("^[a-z]{2}$"))
    all_codes = codes.agg(F.sort_array(F.collect_set("code")).alias("c"))  # of two letters: some hundreds at most
    item = lambda c: F.struct(F.concat(c, F.lit("-en")).alias("model"))
    object_ = F.to_json(F.struct(F.struct(F.transform("c", item).alias("item")).alias("_embedded")))
    plain = F.to_json(F.transform("c", lambda c: F.concat(F.lit("en-"), c)))
    out = None
    for name, answer in (("object", object_), ("list", plain), ("broken", F.lit("<html>busy</html>"))):
        pairs = readers.model_pairs(all_codes.select(answer.alias("value")), routing.KNOWN_PAIRS)
        part = pairs.select(F.lit(name).alias("answer"), "pair", F.sort_array(F.split("pair", "-")).alias("codes"))
        out = part if out is None else out.unionByName(part)
    return out


_LINE_LANG = r"CASE WHEN regexp_matches(line, '[\x{0400}-\x{04FF}]') THEN 'uk' ELSE 'other' END"
_BATCHES = f"""{LINES},
    one AS (SELECT doc_id, line_idx, array_to_string(words, ' ') AS line FROM lines),
    tagged AS (SELECT *, {_LINE_LANG} AS lang FROM one),
    batches AS (SELECT doc_id, lang, min(line_idx) AS first_ord, CAST(count(*) FILTER (line <> '') AS INTEGER) AS n_items,
                       coalesce(string_agg(line, chr(10) ORDER BY line_idx) FILTER (line <> ''), '') AS batch_text
                FROM tagged GROUP BY doc_id, lang)"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import layout

    lines = layout.with_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    one = lines.select("doc_id", F.inline("lines")).select("doc_id", "line_idx", F.array_join("words", " ").alias("line"))
    lang = F.when(F.col("line").rlike(r"[\x{0400}-\x{04FF}]"), "uk").otherwise("other")
    return routing.batches(one.withColumn("lang", lang), ["doc_id"], "lang", "line_idx", "line")


@query(f"WITH {_BATCHES} SELECT doc_id, lang, first_ord, n_items, batch_text FROM batches")
def batch_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).select("doc_id", "lang", "first_ord", "n_items", "batch_text")


@query(
    f"""WITH {_BATCHES}, out AS (SELECT doc_id, lang, n_items, {trim("replace(batch_text, '; ', ';' || chr(10))")} AS o FROM batches)
    SELECT doc_id, lang, len(string_split(o, chr(10))) = n_items AS boundary_kept FROM out"""
)
def batch_boundary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary check on a backend that breaks lines at semicolons: such batches go one by one."""
    out = F.replace(F.col("batch_text"), F.lit("; "), F.lit(";\n"))
    return _batches(spark, sf_dir).select("doc_id", "lang", routing.boundary_kept(out, F.col("n_items")).alias("boundary_kept"))


@query(
    f"""WITH {_CODED} SELECT DISTINCT seg_id, NOT (coalesce({trim("text_auto")}, '') = '') AND NOT coalesce(code = 'en', false) AS to_translate
    FROM coded"""
)
def translate_identity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir).select("seg_id", routing.needs_backend(F.col("text_auto"), F.col("code"), F.lit("en")).alias("to_translate")).distinct()


@query(
    f"""WITH t AS (SELECT DISTINCT seg_id, {trim("text_auto")} AS a, coalesce({trim("text_en")}, '') AS e FROM qa_log WHERE {trim("text_auto")} <> '')
    SELECT seg_id, e <> '' AND (length(a) < 16 OR (length(e) >= length(a) * 0.25 AND length(e) <= length(a) * 4.0)) AS ratio_ok FROM t"""
)
def length_ratio_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "qa_log").where(~fx.is_blank(F.col("text_auto")))
    return log.select("seg_id", routing.ratio_ok(F.col("text_auto"), F.coalesce("text_en", F.lit(""))).alias("ratio_ok")).distinct()

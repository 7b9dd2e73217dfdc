"""Queries over sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import layout
from ..session import load
from ..sinks import writers
from ..sources import readers, xml_nodes
from ..streaming import streams
from .language import _VOCAB
from .oracles import LINES, words
from .registry import query

_URL = "'https://host.example/oai?verb=GetRecord&id=oai:archive:' || coalesce(file, 'none') || '/' || coalesce(source, '') || '?#' || doc_id"


@query(f"SELECT doc_id, regexp_replace(replace(string_split({_URL}, '=')[-1], 'oai:archive:', ''), '[^\\p{{L}}\\p{{Nd}}_-]', '', 'g') AS safe_name FROM documents")
def url_safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.expr(_URL).alias("url"))
    return docs.select("doc_id", fx.url_safe_name(F.col("url"), "oai:archive:").alias("safe_name"))


_URL_LINES = """SELECT CASE doc_id % 4 WHEN 0 THEN 'http://a.example/' || doc_id WHEN 1 THEN '  http://b.example/' || doc_id WHEN 2 THEN 'https://c.example/' || doc_id || ' '
    ELSE '# http' || doc_id END AS value FROM documents"""


@query(f"SELECT trim(value) AS url FROM ({_URL_LINES}) WHERE starts_with(value, 'http')")
def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of addresses, one line a document: indented ones and comments are none."""
    return readers.url_lines(spark.sql(_URL_LINES.replace("documents", "{docs}"), docs=load(spark, sf_dir, "documents")))


_PATH_LINES = "SELECT CASE doc_id % 4 WHEN 0 THEN '//a/b' || doc_id WHEN 1 THEN '# note' WHEN 2 THEN '  amcr:x' || doc_id || ' ' ELSE ' ' END AS value FROM documents"


@query(f"SELECT trim(value) AS xpath FROM ({_PATH_LINES}) WHERE NOT starts_with(value, '#') AND trim(value) <> ''")
def xpath_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.xpath_lines(spark.sql(_PATH_LINES.replace("documents", "{docs}"), docs=load(spark, sf_dir, "documents")))


_COMPONENT_LINES = """SELECT CASE ord % 5 WHEN 0 THEN '# = catalogue' WHEN 1 THEN 'engine ' || ord || ' = MIT ; always ; runtime' WHEN 2 THEN 'model ' || ord || ' = CC BY 4.0'
    WHEN 3 THEN 'tool ' || ord || ' =' ELSE 'no entry' END AS value, ord FROM vocab"""


@query(
    f"""SELECT CASE ord % 5 WHEN 1 THEN 'engine ' WHEN 2 THEN 'model ' ELSE 'tool ' END || ord AS name, CASE ord % 5 WHEN 1 THEN 'MIT' WHEN 2 THEN 'CC BY 4.0' ELSE '' END AS license,
    CASE ord % 5 WHEN 1 THEN 'always' ELSE '' END AS loaded, CASE ord % 5 WHEN 1 THEN 'runtime' ELSE '' END AS role FROM ({_COMPONENT_LINES}) WHERE ord % 5 IN (1, 2, 3)"""
)
def component_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.components(spark.sql(_COMPONENT_LINES.replace("vocab", "{vocab}"), vocab=load(spark, sf_dir, "vocab")))


def _conllu_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as CoNLL-U: every other word is plural, with comments, a range line and an empty node in between."""
    w = F.transform(
        fx.ws_split(F.col("text")),
        lambda x, i: F.concat_ws(
            "\t", (i + 1).cast("string"), x, F.lower(x), F.lit("X"), F.lit("_"), F.when(i % 2 == 0, "Case=Nom|Number=Plur").otherwise("_"), F.lit("0"), F.lit("_"), F.lit("_"), F.lit("_")
        ),
    )
    head = F.array(F.lit("# sent"), F.lit("1-2\tab\t_\t_\t_\t_\t_\t_\t_\t_"), F.lit("1.1\te\te\t_\t_\t_\t_\t_\t_\t_"), F.lit(""))
    docs = load(spark, sf_dir, "documents").where(~fx.is_blank(F.col("text")))
    return docs.select("doc_id", F.array_join(F.concat(head, w), "\n").alias("conllu"))


_TOKENS = f"""toks AS (SELECT doc_id, {words("text")} AS w FROM documents), t AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM toks)"""


@query(f"WITH {_TOKENS} SELECT doc_id, CAST(i AS INTEGER) AS tok_idx, w[i] AS word, lower(w[i]) AS lemma FROM t")
def conllu_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.conllu(_conllu_docs(spark, sf_dir), "doc_id", "conllu").select("doc_id", "tok_idx", "word", "lemma")


@query(f"WITH {_TOKENS} SELECT doc_id, CASE WHEN i % 2 = 1 THEN 'Plur' ELSE '' END AS number, count(*) AS n_tokens FROM t GROUP BY ALL")
def conllu_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.conllu(_conllu_docs(spark, sf_dir), "doc_id", "conllu").groupBy("doc_id", "number").agg(F.count("*").alias("n_tokens"))


def _escaped(c):
    t = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def _alto_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as layout XML: one page and block, a line with an id and a string for each word."""
    lines = layout.with_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    line = F.transform(
        F.filter("lines", lambda x: F.size(x["words"]) > 0),
        lambda x: F.concat(
            F.lit('<TextLine ID="L'), x["line_idx"], F.lit('">'),
            F.array_join(F.transform(x["words"], lambda w: F.concat(F.lit('<String CONTENT="'), _escaped(w), F.lit('"/>'))), "<SP/>"), F.lit("</TextLine>"),
        ),
    )
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<alto xmlns="http://www.loc.gov/standards/alto/ns-v2#"><Layout><Page><PrintSpace><TextBlock>'),
        F.array_join(line, "\n"), F.lit("</TextBlock></PrintSpace></Page></Layout></alto>"),
    )
    return lines.select("doc_id", xml.alias("content"))


@query(
    f"""WITH {LINES}, full_lines AS (SELECT doc_id, line_idx AS id, words, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) AS i FROM lines WHERE len(words) > 0),
    s AS (SELECT *, unnest(generate_series(1, len(words))) AS j FROM full_lines)
    SELECT doc_id, 1 AS page_idx, 1 AS block_idx, CAST(i AS INTEGER) AS line_idx, 'L' || id AS line_id, CAST(j AS INTEGER) AS str_idx, words[j] AS content FROM s"""
)
def alto_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xml_nodes.layout_strings(_alto_files(spark, sf_dir))


#: What the namespaces of the record format and the envelope hold, and the one that stands in for a record's.
PREFIXES = {"amcr": ("amcr", "https://api.example/schema/amcr/2.2/"), "oai": ("OAI-PMH", None)}


def _metadata_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><oai:OAI-PMH xmlns:oai="http://www.openarchives.org/OAI-PMH/2.0/"><oai:record>'),
        F.lit('<amcr:amcr xmlns:amcr="https://api.example/schema/amcr/2.1/"><amcr:dokument><amcr:popis>'), _escaped(F.col("text")),
        F.lit("<amcr:b/>tail</amcr:popis><amcr:typ>"), F.coalesce("kind", F.lit("")), F.lit('</amcr:typ><x:typ xmlns:x="urn:x">foreign</x:typ><amcr:poznamka druh="a">first</amcr:poznamka><amcr:poznamka druh="a">second</amcr:poznamka>'),
        F.lit('<amcr:poznamka druh="b">other</amcr:poznamka></amcr:dokument></amcr:amcr></oai:record></oai:OAI-PMH>'),
    )
    return docs.select("doc_id", xml.alias("content"))


@query(
    r"""WITH d AS (SELECT doc_id, replace(replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t, coalesce(kind, '') AS k FROM documents)
    SELECT doc_id, 0 AS xpath_ord, t AS original FROM d WHERE regexp_matches(t, '\S')
    UNION ALL SELECT doc_id, 1, k FROM d WHERE regexp_matches(k, '\S')
    UNION ALL SELECT doc_id, 4, 'second' FROM d WHERE t IS NOT NULL
    UNION ALL SELECT doc_id, 5, 'other' FROM d WHERE t IS NOT NULL
    UNION ALL SELECT doc_id, 6, 'second' FROM d WHERE t IS NOT NULL"""
)
def xpath_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading text of the described fields; a tail after a child element is not part of it, nor is an element of the
    same name in another namespace."""
    paths = [
        "//amcr:dokument/amcr:popis", "/oai:OAI-PMH/oai:record//amcr:typ", "bad path[", "//nobody:typ", "//amcr:poznamka[2]",
        "//amcr:poznamka[@druh='b']", "//amcr:poznamka[@druh='a'][last()]",
    ]
    return xml_nodes.fields(_metadata_files(spark, sf_dir), paths, PREFIXES).select("doc_id", "xpath_ord", "original")


@query(
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'https://api.example/schema/amcr/2.1/' WHEN 1 THEN 'https://api.example/schema/amcr/2.0/' ELSE 'https://api.example/schema/amcr/2.2/' END AS record_ns,
    CASE WHEN doc_id % 3 = 0 THEN 'http://www.openarchives.org/OAI-PMH/2.0/' END AS oai_ns FROM documents WHERE text IS NOT NULL"""
)
def namespace_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the files declares both namespaces, a third one it does not use, a third none."""
    unused = F.lit('<r xmlns:x="https://api.example/schema/amcr/2.0/" xmlns:y="https://api.example/schema/amcr/1.0/"><a/></r>')
    kind = F.pmod("doc_id", F.lit(3))
    files = _metadata_files(spark, sf_dir).where("content is not null")
    files = files.withColumn("content", F.when(kind == 0, F.col("content")).when(kind == 1, unused).otherwise("<r><a/></r>"))
    return xml_nodes.namespaces(xml_nodes.node_table(files), PREFIXES["amcr"][1])


@query("SELECT doc_id, true AS same_outside, true AS texts_replaced FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\\S')")
def xml_splice_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every described text replaced and put back: the bytes must be those of the source."""
    import pyarrow as pa

    def check(batches):
        for batch in batches:
            rows = []
            for k, c in zip(*(x.to_pylist() for x in batch.columns)):
                raw = c.encode()
                target = next(n for n in xml_nodes.shred(raw) if n.tag == "popis")
                if not (target.text or "").strip():
                    continue
                out = xml_nodes.splice(raw, {target.node_id: "NEW & <text>"}, {})
                new = xml_nodes.shred(out)[target.node_id]
                outside = raw[: target.text_from] == out[: new.text_from] and raw[target.text_to :] == out[new.text_to :]
                rows.append((k, outside, new.text == "NEW & <text>"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.bool_())],
                names=["doc_id", "same_outside", "texts_replaced"],
            )

    return _metadata_files(spark, sf_dir).where("content is not null").mapInArrow(check, "doc_id long, same_outside boolean, texts_replaced boolean")


@query(
    """WITH s AS (SELECT CAST(ord AS VARCHAR) AS id, term FROM vocab), t AS (SELECT CAST(ord AS VARCHAR) AS id, target FROM vocab QUALIFY row_number() OVER (PARTITION BY ord ORDER BY ord DESC) = 1)
    SELECT id, term, target FROM s JOIN t USING (id) WHERE trim(term) <> '' AND trim(target) <> ''"""
)
def bilingual_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = load(spark, sf_dir, "vocab")
    return readers.bilingual(vocab.select(F.col("ord").alias("id"), "ord", F.col("term").alias("label")), vocab.select(F.col("ord").alias("id"), "ord", F.col("target").alias("label")))


@query(f"WITH {_VOCAB}, extra AS (SELECT lower(trim(src)) AS term, min(tgt) AS target FROM eval_rows WHERE length(src) > 0 AND tgt <> '' GROUP BY 1) SELECT term, target FROM terms UNION ALL SELECT term, target FROM extra WHERE term NOT IN (SELECT term FROM terms)")
def vocab_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vocabularies as one; the first source has precedence."""
    from ..operators.glossary import clean

    own = clean(load(spark, sf_dir, "vocab")).select("term", "target")
    rows = load(spark, sf_dir, "eval_rows").where("length(src) > 0 and tgt <> ''")
    extra = rows.groupBy(F.lower(F.trim("src")).alias("term")).agg(F.min("tgt").alias("target"))
    return own.unionByName(extra.join(own, "term", "left_anti"))


@query(
    """SELECT DISTINCT file AS name, CASE WHEN file LIKE 'C-TX%' THEN file || '_en.alto.xml' ELSE split_part(file, '.', 1) || '_en.xml' END AS output FROM qa_log"""
)
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of rewritten files: layout files keep both suffixes, others their own."""
    names = load(spark, sf_dir, "qa_log").select(F.col("file").alias("name")).distinct()
    given = F.concat("name", F.when(F.col("name").startswith("C-TX"), ".alto.xml").otherwise(".xml"))
    return names.select("name", writers.output_name(given, "en").alias("output"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n_events FROM events GROUP BY ALL")
def stream_output_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streams.event_stream(spark, sf_dir, "events", load(spark, sf_dir, "events").schema)
    out = streams.appended(streams.counted(stream.withColumn("ts", F.col("ts").cast("timestamp"))), "counts", "update")
    return streams.latest(out, ["w", "event_type"], "n_events").select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n_events")


@query(
    """SELECT user_id, event_type, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id) = 1"""
)
def stream_block_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = streams.event_stream(spark, sf_dir, "events", load(spark, sf_dir, "events").schema)
    blocks = stream.withColumn("stamp", F.date_format("ts", "yyyy-MM-dd"))
    return streams.upsert_newest(blocks, ["user_id", "event_type"], "stamp", "event_id", "blocks").select("user_id", "event_type", "event_id")

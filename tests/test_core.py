"""Operators on small inputs; whole tables are compared with SQL by the driver."""

from __future__ import annotations

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as fx
from lexloom.operators import backends, chunk, evaluation, glossary, layout, licences, records, routing, runs
from lexloom.sources import harvest, readers, xml_nodes


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_words_see_every_white_space(spark):
    assert one(spark, fx.ws_split(F.col("t")), t="a b　 c\n") == ["a", "b", "c"]
    assert one(spark, fx.ws_split(F.col("t")), t=" \n ") == []
    assert one(spark, fx.ws_split(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize("seed", range(3))
def test_half_even_is_python_round(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(200), rng.randrange(1, 40)) for _ in range(200)] + [(5, 2), (7, 2), (3, 2)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", fx.half_even(F.col("a"), F.col("b")).alias("r")).collect()
    from fractions import Fraction

    assert all(r["r"] == round(Fraction(r["a"], r["b"])) for r in got)


def proportional(tokens, counts):
    """A plain restatement of the rule."""
    if not tokens:
        return [[] for _ in counts]
    total, left, out = sum(counts), list(tokens), []
    for c in counts[:-1]:
        take = min(round(len(tokens) * c / total), len(left)) if c and total else 0
        out.append(left[:take])
        left = left[take:]
    return [*out, left]


def test_proportional_buckets_keep_every_token(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        counts = [rng.choice((0, 1, 3, 7)) for _ in range(rng.randint(1, 6))]
        tokens = [f"t{j}" for j in range(rng.choice((0, 1, 4, 11, 30)))]
        rows.append((i, "\n".join(" ".join("w" * 1 for _ in range(c)) for c in counts), tokens, counts))
    df = spark.createDataFrame([(i, t or " ", k) for i, t, k, _ in rows], "id int, text string, tokens array<string>")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).cast("int").alias("line_idx"), fx.ws_split(x).alias("words")))
    got = {r["id"]: [x["tokens"] for x in r["b"]] for r in df.select("id", layout.proportional_buckets(lines, F.col("tokens")).alias("b")).collect()}
    for i, _, tokens, counts in rows:
        assert got[i] == proportional(tokens, counts), (counts, tokens)


def test_strings_take_tokens_and_the_last_the_tail(spark):
    x = F.array_join(layout.onto_strings(F.split("w", ","), F.split("t", ",")), "|")
    assert one(spark, x, w="a,b", t="1,2,3") == "1|2 3"
    assert one(spark, x, w="a,b,c", t="1") == "1||"


def test_anchored_alignment_matches_a_full_search():
    rng = random.Random(2)

    def full(block, anchors):
        tokens, out = block.split(), []
        for a in anchors[:-1]:
            n = len(a.split())
            if not n or not tokens:
                out.append([])
                continue
            best, k = -1.0, 0
            for c in range(max(0, int(n * 0.5) - 1), min(len(tokens), int(n * 1.5) + 2) + 1):
                r = difflib.SequenceMatcher(None, " ".join(tokens[:c]), a).ratio()
                if r > best:
                    best, k = r, c
            out.append(tokens[:k])
            tokens = tokens[k:]
        return [*out, tokens]

    for _ in range(25):
        words = [rng.choice(("kost", "val", "sonda", "jama", "a", "zlato")) for _ in range(rng.randint(1, 24))]
        anchors = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(2, 4))]
        assert layout.anchored(" ".join(words), anchors) == full(" ".join(words), anchors)
    assert layout.anchored("", ["a", "b"]) == [[], []]


def test_chunks_respect_size_and_lose_no_word():
    text = "First sentence here. Second one, with a clause; and more\n\nNew line " + "x" * 90 + " end."
    for size in (7, 20, 50, 200):
        parts = chunk.chunks(text, size)
        assert all(0 < len(p) <= size for p in parts)
        assert "".join("".join(parts).split()) == "".join(text.split())
    assert chunk.chunks("a" * 10 + ". " + "b" * 10, 15) == ["a" * 10 + ".", "b" * 10]
    assert chunk.chunks(None, 5) == chunk.chunks("  ", 5) == []


def test_vocabulary_cleaning(spark):
    rows = [(0, "term", "target"), (1, " Kost ", "bone"), (2, "kost", "bones"), (3, "", "x"), (4, "val", ""), (5, None, "y"), (6, "short", None)]
    got = glossary.clean(spark.createDataFrame(rows, "ord long, term string, target string")).collect()
    assert sorted((r["term"], r["target"]) for r in got) == [("kost", "bones"), ("val", "")]


def test_glossary_matching_whole_words_or_anywhere(spark):
    terms = spark.createDataFrame([(1, "kost", "bone"), (2, "kostel svatý", "church")], "ord long, term string, target string")
    docs = spark.createDataFrame([(1, "Kostelíček"), (2, "kost, kosti"), (3, None), (4, "KOSTEL SVATÝ")], "k long, t string")
    whole = {(r["k"], r["term"]) for r in glossary.matches(docs, "k", "t", terms, True).collect()}
    any_ = {(r["k"], r["term"]) for r in glossary.matches(docs, "k", "t", terms, False).collect()}
    assert whole == {(2, "kost"), (4, "kostel svatý")}
    assert any_ == whole | {(1, "kost"), (4, "kost")}
    assert glossary.matches(docs, "k", "t", terms.limit(0), True).count() == 0


def test_protect_and_restore_round_trip(spark):
    text, targets = glossary.protect("Nález: Zvířecí kost a kost", [("zvířecí kost", "animal bone"), ("kost", "bone")])
    assert text == "Nález: Xtermzzz0z a Xtermzzz1z" and targets == ["animal bone", "bone"]
    out = one(spark, fx.restore(F.col("t"), F.array(*[F.lit(x) for x in targets])), t=text.replace("Xtermzzz1z", "x t e r m zzz1 z"))
    assert out == "Nález: animal bone a bone"
    assert one(spark, fx.restore(F.col("t"), F.array(F.lit("$5\\x"))), t="p XTERMZZZ0Z") == "p $5\\x"


def test_words_are_protected_after_phrases(spark, monkeypatch):
    terms = spark.createDataFrame(
        [(1, "zvířecí kost", "animal bone"), (2, "kost", "bone"), (3, "jáma", "pit"), (4, "mince", "coin")], "ord long, term string, target string"
    )
    docs = spark.createDataFrame([(1, "Kostel, kost, Jáma; kost a zvířecí kost"), (2, "nic"), (3, None), (4, "V jámě kosti a kost")], "k long, t string")
    want = {
        1: ("Kostel, Xtermzzz1z, Xtermzzz2z; Xtermzzz3z a Xtermzzz0z", ["animal bone", "bone", "pit", "bone"]),
        2: ("nic", []), 3: (None, []), 4: ("V jámě kosti a Xtermzzz0z", ["bone"]),
    }
    done = glossary.protected(docs, "k", "t", terms)
    assert {r[0]: (r[1], r[2]) for r in glossary.protected_words(done, "k", terms).collect()} == want
    monkeypatch.setattr(glossary, "GROUP_CHARS", 5)  # as many groups as terms
    assert {r[0]: (r[1], r[2]) for r in glossary.protected_words(done, "k", terms).collect()} == want


def test_annotated_words_by_lemma_and_number(spark):
    terms = spark.createDataFrame([(1, "kost", "bone"), (2, "jáma", "pit"), (3, "xtermzzz0z", "never")], "ord long, term string, target string")
    conllu = (
        "# text\n1-2\tjámě kosti\tkost\n1\tjámě\tJáma\tNOUN\t_\tCase=Loc|Number=Sing\n2\tkosti\tkost\tNOUN\t_\tNumber=Plur\n"
        "2.1\tkosti\tkost\n\n3\tXtermzzz0z\txtermzzz0z\n4\tkostí\tkost\n5\tKOST\tkost"
    )
    rows = [(1, "V Jámě, jámě kosti Xtermzzz0z nekostí kostí kost", ["x"], conllu), (2, "jámě", [], None)]
    done = spark.createDataFrame(rows, "k long, protected_text string, targets array<string>, conllu string")
    got = {r[0]: (r[1], r[2]) for r in glossary.protected_words(done, "k", terms, "conllu", glossary.annotated_words).collect()}
    assert got == {1: ("V Jámě, Xtermzzz1z kosti Xtermzzz0z nekostí Xtermzzz2z kost", ["x", "pit", "bone"]), 2: ("jámě", [])}


def test_every_text_comes_out_of_protection(spark):
    terms = spark.createDataFrame([(1, "zvířecí kost", "animal bone"), (2, "sklo", "glass"), (3, "kis pince", "cellar")], "ord long, term string, target string")
    docs = spark.createDataFrame([(1, "nic"), (2, None), (3, "İ: Zvířecí KOST"), (4, ""), (5, "K\u0130\u017f p\u0131nce, kis pince")], "k long, t string")
    got = {r[0]: (r[1], r[2]) for r in glossary.protected(docs, "k", "t", terms).collect()}
    assert got == {
        1: ("nic", []), 2: (None, []), 3: ("İ: Xtermzzz0z", ["animal bone"]), 4: ("", []), 5: ("Xtermzzz0z, kis pince", ["cellar"]),
    }


def test_folding_is_what_ignoring_case_means():
    cased = [c for c in map(chr, range(0x20000)) if c.lower() != c or c.upper() != c]
    alike = {}
    for c in cased:
        assert len(glossary.folded(c)) == 1
        alike.setdefault(glossary.folded(c), []).append(c)
    text = "".join(cased)
    for group in alike.values():
        for c in group:
            assert set(re.findall(re.escape(c), text, re.IGNORECASE)) <= set(group)


def test_scrub_only_touches_texts_with_the_stem(spark):
    assert one(spark, fx.scrub(F.col("t")), t="buzz zzz a , b") == "buzz zzz a , b"
    assert one(spark, fx.scrub(F.col("t")), t="see Xtermzzz3z , ( zz end )") == "see, (end)"
    assert one(spark, fx.scrub(F.col("t")), t="Xtermzzz3z") == "Xtermzzz3z"


def test_routing_rules(spark):
    assert one(spark, routing.gated(F.col("l"), F.col("c")), l="de", c=0.2) == "cs"
    assert one(spark, routing.gated(F.col("l"), F.col("c")), l="de", c=0.21) == "de"
    assert one(spark, routing.pair(F.col("a"), F.col("b")), a="deu", b="en") == "de-en"
    assert one(spark, routing.pair(F.col("a"), F.col("b")), a="pl", b="uk") == "cs-en"
    assert one(spark, routing.ratio_ok(F.col("a"), F.col("b")), a="x" * 20, b="y" * 81) is False
    assert one(spark, routing.ratio_ok(F.col("a"), F.col("b")), a="x" * 4, b="y" * 81) is True
    found = routing.identified(spark.createDataFrame([(1, "the pit and the wall of the house"), (2, ""), (3, None)], "k int, t string"), "t")
    assert [(r["lang"], r["confidence"]) for r in found.orderBy("k").collect()][1:] == [("en", 0.0), ("en", 0.0)]
    assert found.orderBy("k").first()["lang"] == "en"


def test_effective_licence_is_the_first_of_the_highest_rank(spark):
    rows = [(1, "a", "MIT", 1), (1, "b", "House", 2), (1, "c", "cc-by-nc-sa-4.0", 3), (2, "a", " gpl 3.0 ", 1), (2, "b", "AGPLv3", 2)]
    comp = licences.normalised(spark.createDataFrame(rows, "g int, name string, license string, ord int"))
    got = {r["g"]: r for r in licences.effective(comp, ["g"]).collect()}
    assert (got[1]["effective_license"], got[1]["determined_by"], got[1]["unknown_licenses"]) == ("House", "b,c", "House")
    assert (got[2]["effective_license"], got[2]["determined_by"]) == ("GPL-3.0", "a,b")


def test_upsert_distinguishes_present_null_from_absent(spark):
    e = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, f string, g string")
    i = spark.createDataFrame([(1, None, None, ["f"]), (3, "n", "z", ["f", "g"])], "k int, f string, g string, present array<string>")
    got = {(r["k"], r["f"], r["g"]) for r in records.upserted(e, i, ["k"], ["f", "g"]).collect()}
    assert got == {(1, None, "x"), (2, "b", "y"), (3, "n", "z")}


def test_newest_block_and_keys(spark):
    rows = [("d", "2020", 2, "b"), ("d", "2020", 1, "a"), ("d", None, 0, "c")]
    best = records.newest_block(spark.createDataFrame(rows, "doc string, at string, ord int, v string"), ["doc"], "at", "ord").first()
    assert best["v"] == "a"
    assert one(spark, records.canonical_key(F.col("a"), F.col("b")), a=1.0, b="x") == "1\u001fx"
    with pytest.raises(Exception, match="newer"):
        one(spark, records.migrated(F.col("v"), 2), v="3.1")


def test_runs_without_duration_have_no_rate(spark):
    row = spark.sql("select 'r' as run_id, 0.0D as duration_seconds, named_struct('output_counts_by_type', map('csv', 3)) as statistics")
    assert runs.rates(row).first()["per_minute"] == 0.0


def test_scores(spark):
    assert one(spark, fx.number_preservation(F.col("a"), F.col("b")), a="12 a 3,5", b="x 12") == 0.5
    assert one(spark, fx.number_preservation(F.col("a"), F.col("b")), a="none", b="x") is None
    assert one(spark, evaluation.char_similarity(F.col("a"), F.col("b")), a="abcd", b="bcde") == 0.75
    assert one(spark, evaluation.chrf(F.col("a"), F.col("b")), a="abc", b="abc") == 100.0


def test_xml_shredding_stops_at_children_and_refuses_entities():
    raw = b'<?xml version="1.0"?><r xmlns="u:1"><a id="x">one<b/>two</a><a><!-- c -->late</a></r>'
    nodes = xml_nodes.shred(raw)
    assert [n.text for n in nodes if n.tag == "a"] == ["one", None]
    assert nodes[0].ns_uri == "u:1" and nodes[1].attrs == {"id": "x"}
    with pytest.raises(ValueError):
        xml_nodes.shred(b'<!DOCTYPE r [<!ENTITY x "y">]><r>&x;</r>')
    with pytest.raises(ValueError):
        xml_nodes.shred(b"<r>")


def test_splice_changes_only_values():
    raw = "<a t='1'>\n <s  CONTENT='p&amp;q' Z=\"é\"/><s Z='>'/>á text<k/></a>".encode()
    out = xml_nodes.splice(raw, {}, {1: 'n"&', 2: "m"})
    assert out.decode() == "<a t='1'>\n <s  CONTENT=\"n&quot;&amp;\" Z=\"é\"/><s Z='>' CONTENT=\"m\"/>á text<k/></a>"
    assert xml_nodes.splice(b"<a>x &lt; y<b/>z</a>", {0: "<new>"}, {}) == b"<a>&lt;new&gt;<b/>z</a>"


def test_paths():
    xml = "<r xmlns:p='u'><x><p:a><p:b>1</p:b></p:a></x><a><b>2</b></a></r>"
    assert hits(xml, "//p:a/p:b", {"p": "u"}) == ["1"] and hits(xml, "/a/b") == []
    with pytest.raises(ValueError):
        xml_nodes.parsed_path("a b")


def test_conllu_skips_ranges_and_empty_nodes(spark):
    text = "# c\n1-2\tdo\t_\t_\t_\t_\n1\tKostí\tkost\tN\t_\tCase=G|Number=Plur\n1.1\te\te\tN\t_\t_\n\nbad\n2\ta\ta\tC\t_\t_"
    got = readers.conllu(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("tok_idx").collect()
    assert [(r["tok_idx"], r["word"], r["lemma"], r["number"]) for r in got] == [(1, "Kostí", "kost", "Plur"), (2, "a", "a", "")]


def test_files_and_vocabulary_from_disk(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "C-1.alto.xml").write_text("<a/>")
    (tmp_path / "v.csv").write_text('term,target\n"a, b",x\nonly\n')
    assert [r["doc_id"] for r in readers.files(spark, str(tmp_path), ["xml"]).collect()] == ["C-1"]
    got = glossary.clean(readers.vocabulary(spark, str(tmp_path / "v.csv"))).collect()
    assert [(r["term"], r["target"]) for r in got] == [("a, b", "x")]


def test_paged_harvest_keeps_what_it_has(spark, tmp_path):
    page = '<l xmlns:xml="http://www.w3.org/XML/1998/namespace"><record><identifier>{0}</identifier><t xml:lang="cs">kost{0}</t></record>{1}</l>'
    (tmp_path / "page1.xml").write_text(page.format(1, "<resumptionToken>2</resumptionToken>"))
    (tmp_path / "page2.xml").write_text(page.format(2, "<resumptionToken>3</resumptionToken>"))
    spark.dataSource.register(harvest.OaiSource)
    got = spark.read.format("oai_terms").option("url", f"file://{tmp_path}").load().collect()
    assert [(r["id"], r["lang"], r["label"]) for r in got] == [("1", "cs", "kost1"), ("2", "cs", "kost2")]


def test_retry_waits_and_gives_up():
    import urllib.error

    waits, calls = [], []

    def busy():
        calls.append(1)
        raise urllib.error.HTTPError("u", 503, "busy", None, None)

    with pytest.raises(urllib.error.HTTPError):
        harvest.with_retry(busy, tries=3, base=1.0, sleep=waits.append)
    assert len(calls) == 3 and len(waits) == 2 and waits[1] >= 2
    with pytest.raises(ValueError):
        harvest.graphql("u", "{x}", lambda u, b: b'{"errors": ["no"]}')


def test_backends(spark):
    assert one(spark, backends.create("prefix").translate(F.col("t"), "cs", "en"), t="a") == "EN:a"
    assert one(spark, backends.create("dictionary", table={"kost": "bone"}).translate(F.col("t"), "cs", "en"), t="Kost x") == "bone x"
    with pytest.raises(ValueError):
        backends.create("none")
    chat = backends.Chat("u", "m", fetch=lambda u, b: b'{"choices": [{"message": {"content": " ok "}}]}')
    assert one(spark, chat.translate(F.col("t"), "cs", "en"), t="a") == "ok"
    with pytest.raises(ValueError):
        backends.answer_text({})


def test_package_without_the_llm_folder_still_offers_the_rest(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "lexloom", tmp_path / "lexloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    ask = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); print(sum(n[:1] == 'p' and n[1:2].isdigit() for n in q))"
    run = lambda: subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True)
    assert run().stdout.strip() == "0"
    # a subpackage that is there but cannot be imported is an error, not a smaller set of queries
    (tmp_path / "lexloom" / "llm").mkdir()
    (tmp_path / "lexloom" / "llm" / "__init__.py").write_text("")
    (tmp_path / "lexloom" / "llm" / "queries.py").write_text("import not_installed_anywhere")
    assert "not_installed_anywhere" in run().stderr


def test_scratch_tables_can_be_released(spark):
    import os

    from lexloom.session import materialize, release

    table = materialize(spark.range(5), "numbers")
    path = table._scratch.removeprefix("file://")
    assert table.count() == 5 and os.path.isdir(path)
    release(table)
    release(table)
    release(spark.range(1))
    assert not os.path.isdir(path)


def test_writers(spark, tmp_path):
    import json

    from lexloom.sinks import writers

    blocks = spark.createDataFrame([("d", "zz", '{"a": 1}'), ("d", "pages", "[ 1 ]"), ("d", "doc_id", '"d"'), ("d", 'q"x', None)], "doc_id string, block string, payload string")
    text = writers.records(blocks).first()["record"]
    assert text.startswith('{"doc_id":"d","pages":[ 1 ],') and json.loads(text)['q"x'] is None
    assert one(spark, writers.output_name(F.col("n"), "en"), n="a.b.ALTO.xml") == "a.b_en.alto.xml"
    assert one(spark, writers.output_name(F.col("n"), "en"), n="rec.xml") == "rec_en.xml"
    files = spark.createDataFrame([("x.xml", bytearray(b"<a>1</a>"))], "name string, content binary")
    assert writers.write_files(files, str(tmp_path / "out")).first()["n_bytes"] == 8
    assert (tmp_path / "out" / "x.xml").read_bytes() == b"<a>1</a>"
    rows = spark.createDataFrame([("f1", 1, "1", 'a "q", b', "c\nd")], "file string, page_num int, line_num string, text_src string, text_tgt string")
    writers.qa_csv(rows, str(tmp_path / "qa"), "cs", "en")
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(tmp_path / "qa" / "_file=f1")).first()
    assert (back["text_cs"], back["text_en"]) == ('a "q", b', "c\nd")
    a, b = spark.createDataFrame([(1, "s")], "z int, src string"), spark.createDataFrame([(2, 0.5)], "z int, chrf double")
    assert writers.united([a, b]).columns == ["chrf", "z", "src"]


def test_rewriting_takes_the_last_pass_over_a_node(spark):
    from lexloom.sinks import writers

    files = spark.createDataFrame([("d", "<a><b>x</b></a>"), ("e", "<a/>")], "doc_id string, content string")
    changes = spark.createDataFrame([("d", 1, "text", "EN:x", 0), ("d", 1, "text", "EN:EN:x", 1)], "doc_id string, node_id int, kind string, value string, ord int")
    got = {r["doc_id"]: bytes(r["content"]) for r in writers.rewritten(files, changes).collect()}
    assert got == {"d": b"<a><b>EN:EN:x</b></a>", "e": b"<a/>"}


# scores


def test_scores_of_known_pairs(spark):
    assert evaluation.chrf_of("abc", "abc") == 100.0 and evaluation.chrf_of("", "abc") == 0.0 and evaluation.chrf_of("ab", "cd") == 0.0
    # one-, two- and three-grams by hand: 3/4 and 3/4, 1/3 and 1/3, 0 and 0, 0 and 0
    assert evaluation.chrf_of("abxc", "abyc") == round(100 * (3 / 4 + 1 / 3) / 4, 2)
    same = "The pit was filled with stones."
    assert evaluation.bleu_of(same, same) == 100.0 and evaluation.bleu_of("", same) == 0.0 and evaluation.bleu_of("x", same) == 0.0
    import math

    # three of four words, two of three pairs, one of two triples, no run of four
    want = math.exp((math.log(4 / 5) + math.log(2 / 4) + math.log(1 / 3) + math.log(1 / 4)) / 4)
    assert evaluation.bleu_of("a b c x d", "a b c d e") == round(100 * want, 2)
    assert evaluation.mt_tokens("It's 3.5-4 m, &quot;wide&quot;.") == ["It's", "3.5", "-", "4", "m", ",", '"', "wide", '"', "."]
    rows = spark.createDataFrame([("a b", "a b"), (None, "a")], "h string, r string")
    assert [r["c"] for r in rows.select(evaluation.chrf(F.col("h"), F.col("r")).alias("c")).collect()] == [100.0, None]


# paths


def hits(xml: str, path: str, prefixes=None) -> list[str]:
    nodes = xml_nodes.shred(xml.encode())
    uris = prefixes or {}
    return [n.text or "" for n in xml_nodes.found(nodes, xml_nodes.parsed_path(path), uris)]


def test_paths_with_predicates_and_namespaces():
    xml = "<r xmlns:p='urn:p'><a t='1'><b>1</b><b>2</b><c>x</c></a><a><b>3</b><p:b>4</p:b></a><d><a t='2'><b>5</b></a></d></r>"
    assert hits(xml, "//a[@t='1']/b[2]") == ["2"] and hits(xml, "//a[@t]/b") == ["1", "2", "5"] and hits(xml, "/r/a/b") == ["1", "2", "3"]
    assert hits(xml, "//b[last()]") == ["2", "3", "5"] and hits(xml, "//p:b", {"p": "urn:p"}) == ["4"] and hits(xml, "//a[c='x']/b[1]") == ["1"]
    assert hits(xml, "//b[text()='3']") == ["3"] and hits(xml, "/r/*/*[1]") == ["1", "3", ""] and hits(xml, "a/b") == ["1", "2", "3"]
    assert hits(xml, "//r") == [""] and hits(xml, "//a[7]") == [] and hits(xml, "//a[0]") == []
    for bad in ("//a[position()<3]", "//a[@t='1' and b]", "//a/..", "count(//a)", "//a|//b", "", "//", "a b"):
        with pytest.raises(ValueError):
            xml_nodes.parsed_path(bad)


def test_fields_are_read_in_one_pass(spark):
    rows = [(1, "<r xmlns:x='http://a/amcr/1'><x:t> v </x:t><t>w</t></r>", "k"), (2, "<r><t>w</t></r>", "k"), (3, "<r", "k"), (4, None, "k")]
    files = spark.createDataFrame(rows, "doc_id long, content string, original string")
    got = xml_nodes.fields(files, ["//q:t", "//t", "//nobody:t", "//["], {"q": ("amcr", None)}).collect()
    assert sorted((r["doc_id"], r["xpath_ord"], r["original"]) for r in got) == [(1, 0, " v "), (1, 1, "w"), (2, 1, "w")]
    ns = xml_nodes.namespaces(xml_nodes.node_table(files.where("doc_id < 3")), "urn:stand-in").collect()
    assert {r["doc_id"]: r["record_ns"] for r in ns} == {1: "http://a/amcr/1", 2: "urn:stand-in"}


def test_harvest_refuses_entities_and_reads_what_a_service_offers():
    bomb = b'<!DOCTYPE r [<!ENTITY a "aaaa"><!ENTITY b "&a;&a;">]><r><record><identifier>1</identifier><l xml:lang="cs">&b;</l></record></r>'
    assert list(harvest.oai_records("u", "p", lambda u, b: bomb)) == []
    import json

    schema = {"types": [{"name": "Query", "fields": [{"name": "search", "args": [{"name": "limit"}, {"name": "language"}], "type": {"ofType": {"name": "Term"}}}, {"name": "exportAll"}]}, {"name": "Term", "fields": [{"name": "id"}, {"name": "termName"}]}]}
    asked = []

    def service(url, body):
        if body is None:
            return b"whole"
        call = json.loads(body)
        asked.append(call)
        if "__schema" in call["query"]:
            return json.dumps({"data": {"__schema": schema}}).encode()
        if "exportAll" in call["query"]:
            return b'{"data": {"exportAll": "http://x/all"}}'
        lang = call["variables"]["lang"]
        return json.dumps({"data": {"search": [{"id": 7, "termName": f" kost {lang} "}]}}).encode()

    assert list(harvest.searched("u", fetch=service)) == [("7", "cs", "kost CS"), ("7", "en", "kost EN")]
    assert asked[-1]["variables"] == {"lang": "EN", "limit": 99_999}
    assert harvest.harvested("u", lambda raw: [("1", "cs", raw.decode())], service) == [("1", "cs", "whole")]
    assert len(harvest.harvested("u", None, service)) == 2
    assert harvest.harvested("u", None, lambda u, b: b"{") == []


def test_catalogue_answers_and_labels(spark):
    answers = ['{"_embedded": {"item": [{"model": "a-b"}]}}', '["c-d", "e-f"]', "<html>", '{"other": 1}', "[]"]
    got = [sorted(r["pair"] for r in readers.model_pairs(spark.createDataFrame([(a,)], "value string"), ("x-y",)).collect()) for a in answers]
    assert got == [["a-b"], ["c-d", "e-f"], ["x-y"], [], []]
    m = F.create_map(F.lit("label_cs"), F.lit(" "), F.lit("Name_EN"), F.lit(" bone "))
    nested = F.array(F.struct(F.lit("CS").alias("lang"), F.lit("kost").alias("value")))
    row = spark.range(1).select(readers.label(m, nested, ["cs"]).alias("a"), readers.label(m, nested, ["en"]).alias("b"), readers.label(m, None, ["de"]).alias("c")).first()
    assert tuple(row) == ("kost", "bone", None)
    paths = spark.createDataFrame([("a.XML",), ("b.txt",)], "path string")
    assert [r["path"] for r in readers.single_file(paths, ["xml"]).collect()] == ["a.XML"]


def test_chat_names_the_terms_of_a_text_and_guards_its_answers():
    import json

    sent = []

    def service(url, body):
        sent.append(json.loads(body)["messages"][0]["content"])
        return b'{"choices": [{"message": {"content": "the bone of the horse"}}]}'

    chat = backends.Chat("u", "m", fetch=service, glossary=(("kost", "bone"), ("zvířecí kost", "animal bone"), ("kostel", "church")))
    throttle = harvest.Throttle(0)
    assert chat.one("Zvířecí kost koně", "cs", "en", throttle) == "the bone of the horse"
    assert "zvířecí kost = animal bone; kost = bone" in sent[0] and "church" not in sent[0]
    with pytest.raises(ValueError):
        chat.one("x" * 500, "cs", "en", throttle)
    urls = []
    form = backends.FormService("u", "models", fetch=lambda u, b: urls.append(u) or b"ok")
    form.one("a", "hu", "en", throttle)
    form.one("a", "uk", "en", throttle)
    assert urls == ["u/models/cs-en", "u/models/uk-en"]


def test_run_logs_are_written_once(monkeypatch):
    written = []
    with pytest.raises(KeyError):
        with runs.RunLog("r", "p", written.append) as log:
            log.log("document", "a")
            raise KeyError("x")
    log.finalise()
    assert len(written) == 1 and [e[2] for e in written[0]] == ["document", "error"]
    monkeypatch.delenv("RUNNER_REPOSITORY", raising=False)
    assert runs.repository({}, "p", {"p": "t"}) == "t" and runs.repository({"repository_fallback": "c"}, "p", {"p": "t"}) == "c"
    monkeypatch.setenv("RUNNER_REPOSITORY", "e")
    assert runs.repository({}, "p", {}) == "e"
    assert licences.backend_components("chat") == ["chat_service"] and "lemma_engine" in licences.backend_components("form", True)


def test_strict_writes_fail(spark):
    owners = spark.createDataFrame([("pages", "a"), ("lines", "b")], "block string, program string")
    grants = spark.createDataFrame([("a", "pages", "x"), ("c", "pages", "y")], "program string, block string, field string")
    writes = spark.createDataFrame([("pages", "a", 1), ("lines", "a", 2), ("assembled", "b", 3), ("free", "z", 4)], "block string, program string, n int")
    got = {r["n"]: (r["is_reserved"], r["is_foreign"], r["others"]) for r in records.write_verdicts(writes, owners, grants).collect()}
    assert got == {1: (False, False, ["c"]), 2: (False, True, []), 3: (True, False, []), 4: (False, False, [])}
    assert records.strict(records.write_verdicts(writes.where("n = 4"), owners, grants)).count() == 1
    with pytest.raises(Exception, match="must not be written"):
        records.strict(records.write_verdicts(writes, owners, grants)).collect()


def test_language_model_on_texts_it_has_not_seen(spark):
    from lexloom.operators import identify

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = identify.fitted(docs, "text", "lang", "doc_id")
    log = spark.read.parquet("/root/testdata/sf0.001/qa_log.parquet").where("length(text_auto) between 60 and 400 and length(lang) = 2 and page_num is null")
    got = identify.identified(log, model, "seg_id", "text_auto").join(log.select("seg_id", F.lower("lang").alias("label")), "seg_id").where("label in ('cs', 'sk', 'pl', 'de', 'en', 'uk')").collect()
    assert sum(r["lang"] == r["label"] for r in got) / len(got) > 0.85  # some labels are wrong
    assert model.predict(None) == model.predict(" 12/3 ") == ("en", 0.0) == identify.Identifier({}).predict("kost")


@pytest.mark.parametrize(
    "head,n", [("<alto xmlns='u'>", 1), ("<alto>", 1), ("<a:alto xmlns:a='u'>", 1), ("<x:alto xmlns:x='u' xmlns:alto='u'>", 0), ("<alto xmlns='u' xmlns:q='v'>", 1)]
)
def test_layout_counts_in_the_namespace_of_the_root(head, n):
    name = head[1:].split()[0].rstrip(">")
    foreign = "<q:String CONTENT='no'/>" if "xmlns:q" in head else ""
    xml = f"{head}<Page><TextBlock><TextLine><String CONTENT='a'/>{foreign}</TextLine></TextBlock></Page></{name}>"
    assert len(list(xml_nodes.layout_of(xml_nodes.shred(xml.encode())))) == n
    named = "<alto:alto xmlns:alto='u'><alto:Page><alto:TextBlock><alto:TextLine><alto:String CONTENT='a'/></alto:TextLine></alto:TextBlock></alto:Page></alto:alto>"
    assert [r[5] for r in xml_nodes.layout_of(xml_nodes.shred(named.encode()))] == ["a"]

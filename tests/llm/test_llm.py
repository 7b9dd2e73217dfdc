"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its defined cases."""

from __future__ import annotations

import itertools
import os
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import cut_off, language, leaks, packing, pairs, pieces, scans, visual_forms
from lexloom.session import materialize

SMALL = "/root/testdata/sf0.001"
RANKS_AT = os.path.exists(os.path.join(packing.TOKENIZER_DIR, packing.RANKS))


# 1 look-alike forms

BASE = ["Pod úrovní podlahy 12 se objevila další situace, studna.", "Розвідкові шурфи від 95 до 47 залишилися без знахідок.", "CO HE HA TAM oko a 7 m² kopa – konec"]


def disguised(rng: random.Random, text: str) -> str:
    """Another spelling of the same look: width, script, composition, blanks, invisible characters."""
    back = {b: a for a, b in (visual_forms.CYRILLIC | visual_forms.GREEK).items()}
    out = []
    for c in unicodedata.normalize(rng.choice(("NFC", "NFD")), text):
        r = rng.random()
        if r < 0.2 and c in back:
            c = back[c]
        elif r < 0.2 and c in visual_forms.CYRILLIC:
            c = visual_forms.CYRILLIC[c]
        elif r < 0.3 and "!" < c <= "~" and c != "-":
            c = chr(ord(c) + 0xFEE0)
        elif r < 0.5 and c == " ":
            c = rng.choice("  　")
        out.append(c + (rng.choice("​⁠­") if r > 0.95 and c.isalpha() else ""))
    return "".join(out)


def test_disguises_of_a_text_share_one_form_and_it_is_stable():
    rng = random.Random(3)
    for base in BASE:
        form = visual_forms.unify(base)
        for _ in range(60):
            assert visual_forms.unify(disguised(rng, base)) == form
        assert visual_forms.unify(form) == form


@pytest.mark.parametrize("a,b", [("m² x", "m2 x"), ("Il", "ll"), ("a-b", "a–b"), ("kost", "Kost"), ("kost", "kosť"), ("rn", "m"), ("0", "O"), ("a.", "a"), ("1/2", "½")])
def test_visible_differences_stay(a, b):
    assert visual_forms.unify(a) != visual_forms.unify(b)


def test_public_classes_of_letters_unify(spark):
    table = visual_forms.lookalikes(spark)
    assert visual_forms.public_letters(spark) and len(table.letters) > 150
    for a, b in [("𝐡ello", "hello"), ("ρaper", "paper"), ("αlpha", "alpha"), ("ɡate", "gate"), ("Ꭺb", "Ab"), ("օrt", "ort"), ("Уes", "Yes"), ("tooӏ", "tool"), ("ℎat", "hat")]:
        assert table.form(a) == table.form(b), (a, b)
    for a, b in [("m²", "m2"), ("I", "l"), ("Kost", "kost"), ("kost", "kosť"), ("0", "O"), ("1", "l"), ("rn", "m"), ("ı", "i")]:
        assert table.form(a) != table.form(b), (a, b)
    rng = random.Random(4)
    for base in BASE:
        form = table.form(base)
        assert table.form(form) == form
        for _ in range(40):
            assert table.form(disguised(rng, base)) == form
    greek = "Η αρχαία πόλη"
    assert table.form(greek) == greek  # a text of one script keeps it


def test_hot_forms_are_split_with_the_same_result(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, disguised(rng, BASE[0]) if i % 3 == 0 else BASE[0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string")
    one = sorted(map(tuple, visual_forms.lookalike_pairs(df, "id", "text", 30, materialize).collect()))
    monkeypatch.setattr(visual_forms, "HOT_ROWS", 7)
    assert sorted(map(tuple, visual_forms.lookalike_pairs(df, "id", "text", 30, materialize).collect())) == one and len(one) > 500
    classes = visual_forms.lookalike_classes(df, "id", "text", 30).groupBy("form_id").count().collect()
    assert [r["count"] for r in classes] == [60]


def test_suspect_texts_are_told_alike_in_both_ways(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choice("ab  \n\u017e\u00a0\u0131č–\u2019\t0") for _ in range(rng.randint(0, 6))),) for _ in range(600)] + [("a\n",), ("\r\n",), ("",), ("x" * 5000,)]
    got = spark.createDataFrame(rows, "t string").select("t", visual_forms.suspect(F.col("t")).alias("s")).collect()
    assert all(r["s"] == bool(re.search(visual_forms.SUSPECT, r["t"])) for r in got) and {r["s"] for r in got} == {True, False}


def test_form_of_nothing():
    assert visual_forms.unify(None) is None and visual_forms.unify("") == "" and visual_forms.unify(" ​ ") == ""


def test_pairs_against_all_pairs(spark):
    rng = random.Random(8)
    rows = [(i, disguised(rng, t) if rng.random() < 0.6 else t, "x", "y") for i, t in enumerate([rng.choice(BASE) + "!" * rng.randint(0, 1) for _ in range(40)])]
    rows += [(100, None, "x", "y"), (101, "", "x", "y"), (102, "kоst", "x", "y"), (103, "kost", "x", "y"), (0, rows[0][1], "x", "y")]
    df = spark.createDataFrame(rows, "id long, text string, form_id string, k string")
    got = {(r["a"], r["b"]) for r in visual_forms.lookalike_pairs(df, "id", "text", 30, materialize).collect()}
    texts = {i: t for i, t, *_ in rows}
    want = {
        (a, b) for a, b in itertools.combinations(sorted(texts), 2)
        if texts[a] and texts[b] and min(len(texts[a]), len(texts[b])) >= 30 and texts[a] != texts[b] and visual_forms.unify(texts[a]) == visual_forms.unify(texts[b])
    }
    assert got == want and want
    assert visual_forms.lookalike_pairs(df.limit(0), "id", "text", 30, materialize).count() == 0


# 2 pieces


def random_text(rng: random.Random, n: int) -> str:
    parts = ["slovo", "a", "věta.", "část,", "\n", "\n\n", " ", "  ", "x" * 70, "1/2,3/4;" * 12, "é" * 30, "Konec!"]
    return "".join(rng.choice(parts) + rng.choice(("", " ")) for _ in range(n))


@pytest.mark.parametrize("limit,overlap", [(40, 0), (40, 9), (64, 20), (7, 3), (1, 0), (30, 30), (50, 99)])
def test_pieces_round_trip(limit, overlap):
    rng = random.Random(limit + overlap)
    for n in (0, 1, 5, 40, 120):
        text = random_text(rng, n)
        got = pieces.cut(text, limit, overlap)
        assert "".join(text[p["start"] : p["end"]] for p in got) == text
        real = max(0, min(overlap, limit - 1))
        for i, p in enumerate(got):
            assert 0 < len(p["text"]) <= limit and p["piece"] == i
            if i:
                assert p["overlap"] == min(real, p["start"]) and p["text"] == text[p["start"] - p["overlap"] : p["end"]]


def test_pieces_take_the_strongest_boundary_and_no_two_neighbours_fit_together():
    text = "Ene mene.\nMene muh. Und raus bist du,\n\nraus bist du noch lange nicht. Sag mir erst."
    cuts = pieces.cut_points(text, 40, 0)
    assert [text[a:b] for a, b, _ in cuts][0].endswith("\n\n") or all(b - a <= 40 for a, b, _ in cuts)
    rng = random.Random(1)
    for _ in range(30):
        t = random_text(rng, 60)
        sizes = [b - a for a, b, _ in pieces.cut_points(t, 60, 10)]
        assert all(x + y > 50 for x, y in zip(sizes[1:], sizes[2:]))


def test_pieces_of_nothing_and_bad_limits():
    assert pieces.cut(None, 10, 0) == [] and pieces.cut("", 10, 0) == []
    assert len(pieces.cut("short", 10, 3)) == 1
    with pytest.raises(ValueError):
        pieces.cut("x", 0, 0)


def test_oversized_rows_meet_their_runs(spark):
    log = spark.createDataFrame(
        [(1, "r1", "a b " * 20, 1), (2, None, "a b " * 20, 1), (3, "r1", "a" * 60, 1), (4, "zz", "c " * 2500, 1), (5, "r2", "d " * 30, 1), (6, "r1", None, 1)],
        "seg_id long, run_id string, text_auto string, chunk_limit int",
    )
    runs = spark.createDataFrame([("r1", {"chunk_limit": "50", "chunk_overlap": "8"}), ("r1", {"chunk_limit": "50", "chunk_overlap": "8"}), ("r2", {}), (None, None), ("r3", {"chunk_limit": "x"}), ("r4", {"chunk_limit": "0"})], "run_id string, config map<string,string>")
    got = {r["seg_id"]: (r["chunk_limit"], r["chunk_overlap"], r["cut"]["longest_stretch"]) for r in pieces.oversized_pieces(log, runs, "seg_id", "text_auto").collect()}
    assert got == {1: (50, 8, 1), 3: (50, 8, 60), 4: (4000, 0, 1)}


# 3 scans


def reads(token: str, word: str) -> int | None:
    """With how many changes a token may be read as a word."""
    return min((n for sig, pattern, n in scans.readings(token) if sig == scans.signature(word) and re.fullmatch(pattern, word)), default=None)


def test_readings_and_edges():
    assert reads("k0st!", "kosti") == 1 and reads("soncly", "sondy") == 1 and not list(scans.readings("12/3"))
    assert reads("a1f0b5r", "alfobšr") == 1 and reads("k0ncepclonalny", "koncepdonalny") == 2 and reads("cxccvaclon", "exeevadon") is None
    assert reads("rnaterlalrn", "materialm") is None and reads("rnaterialclo", "materialdo") == 2
    assert scans.roman("xiv") == 14 and scans.roman("Mix") is None
    sides = {(e[0], e[4], bool(e[3])) for e in scans.edges("12    Zpráva Lhota 1950\nPlocha byla čistá.\nText jde\ndál.\n[3]")}
    assert (0, 12, True) in sides and (4, 3, False) in sides


def test_pages_are_repaired(spark):
    body = "Plocha 12 byla začištěna a sondy zůstaly bez nálezu.\nSeverní osa měřila deset metrů."
    rows = [(100 + i, "m", None, body, None) for i in range(30)]
    for i in range(1, 5):
        text = f"Nálezová zpráva Lhota 1950\nPlocha {i} byla začiš-\ntěna a {'s0ndy' if i == 2 else 'sondy'} zůstaly bez nálezu. Severo-\njižní osa měřila deset metrů.\n– {i + 20} –"
        rows.append((i, "f", i, text if i != 3 else text.replace("Nálezová", "Ná1ezová"), None))
    rows += [(50, "g", 1, None, None), (51, "g", 2, "  \n ", None), (52, None, 1, "Text bez čísla.", None), (1, "f", 1, rows[30][3], None)]
    rows += [(200 + i, "m", None, "severo-jižní osa", None) for i in range(5)]
    log = spark.createDataFrame(rows, "seg_id long, file string, page_num int, text_auto string, drop string")
    done = scans.repair(log, None, "seg_id", "text_auto", "file", "page_num", materialize)
    noise = {(r["k"], r["noise"]) for r in scans.noise(done).collect()}
    assert {k for k, n in noise if n == "header"} == {1, 2, 3, 4} == {k for k, n in noise if n == "page_number"}
    assert {k for k, n in noise if n == "hyphenation"} == {1, 2, 3, 4}
    assert {k for k, n in noise if n == "misread"} == {2, 3}
    text = {r["k"]: r["text"] for r in done.collect()}
    assert text[2] == "Plocha 2 byla začištěna a sondy zůstaly bez nálezu. Severo-jižní osa měřila deset metrů."
    empty = scans.repair(log.limit(0), None, "seg_id", "text_auto", "file", "page_num", materialize)
    assert empty.count() == 0


def test_headers_over_pages_that_continue_a_sentence(spark):
    parts = ["plocha byla čistá a sondy", "stěny jámy zůstaly bez", "severní osa měřila deset", "výplň obsahovala mnoho", "na dně ležely dva", "okraj porušil mladší"]
    ends = ["hrnce", "zlomky", "metrů", "kostí", "kameny", "příkop"]
    rows = []
    for i, (a, b) in enumerate(zip(parts, ends)):
        # the same sentence happens to begin two pages: no header
        first = "v rýze byly pozorovány" if i in (2, 4) else a
        rows.append((i, "f", i + 1, f"Nálezová zpráva Lhota\n{first}\n{a} {b} z vrstvy\nvedle {b} a\nArchiv Praha, s. r. o."))
    # a header most of whose pages begin anew is one on the others, too
    rows += [(10 + i, "g", i + 1, f"Zpráva Kolín\n{a if i == 0 else a.capitalize()}\n{a} {b} z vrstvy\nvedle {b} a\nkonec {b}.") for i, (a, b) in enumerate(zip(parts, ends))]
    log = spark.createDataFrame(rows, "k long, file string, page_num int, t string")
    got = {(r["k"], r["line_no"]) for r in scans.furniture(scans.edge_lines(scans.noted(log)), None).where("is_header").collect()}
    assert got == {(i, n) for i in range(6) for n in (0, 4)} | {(10 + i, 0) for i in range(6)}


def repaired(spark, rows, **bounds):
    log = spark.createDataFrame(rows, "seg_id long, file string, page_num int, text_auto string")
    return {r["k"]: r for r in scans.repair(log, None, "seg_id", "text_auto", "file", "page_num", materialize).collect()}


def test_fixes_joined_or_broadcast_give_the_same_result(spark, monkeypatch):
    rows = [(i, "m", None, "sondy vrstvy nálezu kostry studna severo-jižní půda") for i in range(20)]
    rows += [(50 + i, "f", i, f"Hlavička č1sla 7\ns0ndy vrst\\/y ko5try stu-\ndna a severo-\njižní p@da k0s-\ntry {i}") for i in range(3)]
    one = repaired(spark, rows)
    assert one[50]["text"] == "sondy vrstvy kostry studna a severo-jižní půda kostry 0" or one[50]["misread"]
    for share, bits in ((0.0, 1 << 26), (1.0, 1 << 26), (1.0, 1 << 15)):
        monkeypatch.setattr(scans, "HOT_SHARE", share)
        monkeypatch.setattr(scans, "BITMAP_BITS", bits)
        assert repaired(spark, rows) == one


def test_a_correction_is_applied_once(spark):
    # a1fa reads alfa, and alfa is rare against alta
    rows = [(i, "m", None, "alta " * 40) for i in range(3)] + [(10 + i, "m", None, "alfa") for i in range(4)] + [(20, "f", 1, "Vrstva a1fa byla alfa.")]
    done = repaired(spark, rows)
    assert done[20]["text"] in ("Vrstva alfa byla alta.", "Vrstva alta byla alta.") and done[20]["misread"]
    assert scans.read_right("a1fa b", lambda w: {"a1fa": "alfa", "alfa": "alta"}.get(w, False)) == ("alfa b", True)


def test_words_over_three_lines_and_their_compounds(spark):
    rows = [(i, "m", None, "severo-jižně pohled") for i in range(5)]
    rows += [(20, "f", 1, "Tu leží vy-\nko-\npávka celá."), (21, "f", 2, "Směr severo-\njižně-\npohled tu.")]
    done = repaired(spark, rows)
    assert done[20]["text"] == "Tu leží vykopávka celá." and done[20]["divided"]
    assert done[21]["text"] == "Směr severo-jižněpohled tu."
    assert set(scans.divisions("vy-\nko-\npávka")) == {"vy\t-\tko", "ko\t-\tpávka", "vyko\t-\tpávka"}


def test_headers_of_many_lines_and_headers_misread_at_both_ends(spark, monkeypatch):
    head = ["Ústav archeologie", "Zpráva o výzkumu města Lhota", "Oddíl terénních prací"]
    bodies = ["Plocha byla čistá.", "Stěny byly šikmé.", "Jáma měla oblé dno.", "Sonda byla prázdná.", "Výplň byla šedá."]
    rows = [(i, "f", i + 1, "\n".join([*head, b, f"Dno leželo {i} m hluboko.", "Konec popisu této plochy."])) for i, b in enumerate(bodies)]
    log = spark.createDataFrame(rows, "k long, file string, page_num int, t string")
    found = scans.furniture(scans.edge_lines(scans.noted(log)), None)
    drop = {r["k"]: sorted(r["drop"]) for r in scans.marked_pages(found).collect()}
    assert all(drop[i][:3] == [0, 1, 2] and 3 not in drop[i] for i in range(5))
    wrong = "Zprxva o výzkumu města Lhoxa"
    rows[2] = (2, "f", 3, rows[2][3].replace(head[1], wrong))
    rows += [(10 + k, None, p, t) for k, _, p, t in rows]  # a null file is a file of its own
    log = spark.createDataFrame(rows, "k long, file string, page_num int, t string")
    lines = scans.edge_lines(scans.noted(log))
    for keep, least in ((None, 50_000), (materialize, 50_000), (materialize, 1)):  # split into many tasks or not
        monkeypatch.setattr(scans, "HOT_LINES", least)
        found = scans.furniture(lines, None, keep).where("is_header and line_no = 1")
        assert {r["k"] for r in found.collect()} == {*range(5), *range(10, 15)}


def test_signatures_and_bitmaps_agree_with_their_columns(spark):
    words = ["k0st!", "vrst\\/y", "kóst's", "ĺ|1liíł", "Čс(c", "žz23зз", "\U0001d400x", "m-n"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r[0]: r[1] for r in df.select("w", scans.signature_column(F.col("w"))).collect()}
    assert got == {w: scans.signature(w) for w in words}
    bits = scans.bitmap(df, F.col("w"))
    assert all(scans.may_hold(bits, w) for w in words) and sum(map(int.bit_count, bits)) == len(words)
    assert len(scans.bitmap(df.limit(0), F.col("w"))) * 8 == scans.BITMAP_BITS


def test_pages_without_keys_or_with_clashing_columns(spark):
    rows = [(i, "m", None, "sondy vrstvy nálezu", i, None, "x") for i in range(20)]
    rows += [(None, "f", 1, "s0ndy tu", 1, None, "y"), (50, "f", 2, "s0ndy tam", 1, None, "y"), (50, "f", 2, "s0ndy tam", 2, None, "y"), (51, None, None, None, 1, None, None)]
    log = spark.createDataFrame(rows, "seg_id long, file string, page_num int, text_auto string, k int, fixes string, t string")
    done = scans.repair(log, None, "seg_id", "text_auto", "file", "page_num", materialize).distinct().collect()
    assert [(r["k"], r["text"], r["misread"]) for r in done] == [(50, "sondy tam", True)]
    long = "sondy vrstvy nálezu " * 20_000
    one = scans.repair(spark.createDataFrame([(1, "f", 1, long)], "seg_id long, file string, page_num int, text_auto string"), None, "seg_id", "text_auto", "file", "page_num", materialize).first()
    assert one["text"] == long.strip()


# 4 language


def brute_cost(model_text: bytes, order: int, data: bytes, at: int) -> float:
    """The cost of one byte by walking the contexts, straight from the definition."""
    bits = 0.0
    for k in range(order, -1, -1):
        context = data[at - k : at]
        after = [model_text[i + k] for i in range(len(model_text) - k) if model_text[i : i + k] == context]
        total, kinds, hits = len(after), len(set(after)), after.count(data[at])
        if hits:
            return bits + np.log2((total + kinds) / hits)
        if total:
            bits += np.log2((total + kinds) / kinds)
    return bits + 8.0


def test_costs_are_exact():
    texts = {"aa": ["abracadabra abra cadabra"], "bb": ["bananaband anna bana"]}
    model = language.PpmModel(texts, order=3)
    pad = b" " * 3
    for probe in (b"abra cad", b"banana zz", b"xyz"):
        data = pad + probe
        got = model.costs(np.frombuffer(data, dtype=np.uint8))
        for j, c in enumerate(model.languages):
            own = pad + texts[c][0].encode()
            for i in range(len(probe)):
                assert abs(got[i, j] - brute_cost(own, 3, data, 3 + i)) < 1e-3


@pytest.fixture(scope="module")
def model(spark):
    return language.train(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_language_accuracy_on_other_rows(spark, model):
    rows = spark.read.parquet(f"{SMALL}/qa_log.parquet").where("length(text_auto) between 60 and 400 and page_num is null").select("text_auto", "lang").collect()
    known = [(r[0], language.label_code(r[1])) for r in rows if language.label_code(r[1])]
    _, _, main, _ = language.judged(model, [visual_forms.unify(t) for t, _ in known])
    right = np.mean([model.languages[m] == c for m, (_, c) in zip(main, known)])
    assert right > 0.9  # the labels themselves are wrong in some rows


def test_stretches_are_told_in_places_of_the_stored_text(spark, model):
    cs, de = "Kostry uložené v hrobech byly silně stráveny kyselou půdou.", "Die Suchschnitte blieben ohne archäologischen Befund."
    plain = f"{cs} {de}"
    odd = f"  Kоstry\u200b uložené\u00a0\u00a0v hrobech byly silně stráveny ky\u00adselou půdou. {unicodedata.normalize('NFD', de)} "
    df = spark.createDataFrame([(1, plain, "cs"), (2, odd, "cs"), (3, "\u2167. " + plain, "cs")], "seg_id long, text_auto string, lang string")
    texts = {1: plain, 2: odd, 3: "\u2167. " + plain}
    got = {(r["k"], r["lang"]): texts[r["k"]][r["start"] : r["end"]] for r in language.stretches(df, model, "seg_id", "text_auto", "lang").collect()}
    assert set(got) == {(k, c) for k in (1, 2, 3) for c in ("cs", "de")}
    for k in (1, 2, 3):
        assert visual_forms.unify(got[k, "de"]) == de and visual_forms.unify(got[k, "cs"]).endswith("půdou.")


def test_languages_come_from_the_labels(spark):
    texts = {"hu": "A gödör falai ferdék voltak, az alja egyenes.", "fr": "Les parois de la fosse étaient obliques et le fond plat."}
    docs = spark.createDataFrame([(i, t, {"hu": "HU", "fr": "fre"}[c]) for i, (c, t) in enumerate(texts.items())] + [(9, "x", "?"), (10, None, "cs")], "doc_id long, text string, lang string")
    assert language.train(docs).languages == ["fr", "hu"]
    assert [language.label_code(x) for x in ("cs_CZ", " ENG", "cze", "?", None, "und", "pt-BR")] == ["cs", "en", "cs", None, None, "und", "pt"]


def test_mixed_and_letterless_texts(spark, model):
    cs, de = "Kostry uložené v hrobech byly silně stráveny kyselou půdou.", "Die Suchschnitte blieben ohne archäologischen Befund."
    rows = [(1, f"{cs} {de}", "cs", 0), (2, cs, "cs-CZ", 0), (3, cs, "de", 0), (4, "12/5, 33 - 88 / 4" * 9, None, 0), (5, None, None, 0), (6, "", "cs", 0), (7, cs, None, 0), (8, f"Nápis „{de[:20]}“ stál nad vchodem a četl se dobře zdola.", "cs", 0)]
    df = spark.createDataFrame(rows, "seg_id long, text_auto string, lang string, confidence int")
    got = {(r["k"], r["lang"]) for r in language.wrong_labels(df, model, "seg_id", "text_auto", "lang", 0).collect()}
    assert got == {(1, "cs"), (1, "de"), (3, "cs"), (7, "cs")}
    assert language.stretches(df.limit(0), model, "seg_id", "text_auto", "lang").count() == 0
    nothing = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert language.wrong_labels(df, nothing, "seg_id", "text_auto", "lang", 0).count() == 0
    alone = language.train(spark.createDataFrame([(1, cs, "cs"), (2, None, "cs"), (3, cs, None)], "doc_id long, text string, lang string"))
    assert {r["lang"] for r in language.stretches(df, alone, "seg_id", "text_auto", "lang").collect()} == {"cs"}


# 5 pairs


def test_pairs_held_out_accuracy_and_cases(spark):
    log = spark.read.parquet(f"{SMALL}/qa_log.parquet")
    fitted = pairs.fit(log, "seg_id", "text_auto", "text_en")
    assert all(f > 0.85 for f in fitted.f1.values()), fitted.f1  # a tenth of the usual sample; pairs and phrases not seen
    a = "Kostry uložené v hrobech byly silně stráveny kyselou půdou. Stěny byly šikmé, dno rovné."
    e = "The skeletons placed in graves were badly decayed by the acidic soil. The walls were sloping, the bottom flat."
    rows = [
        (1, a, e), (2, a, None), (3, a, "n/a"), (4, a, a), (5, a, "Translation: " + a.upper()), (6, a, e[:45]), (7, a, "Sorry, I cannot translate this text."),
        (8, a, "Die Skelette in den Gräbern waren durch den sauren Boden stark zersetzt. Die Wände waren schräg, die Sohle eben."),
        (9, "123/4", ""), (10, None, None), (11, "", "x"), (12, "12 x 8", "12 x 8"),
    ]
    df = spark.createDataFrame(rows, "seg_id long, text_auto string, text_en string")
    got = dict(tuple(r) for r in pairs.defective(df, fitted, "seg_id", "text_auto", "text_en").collect())
    assert got == {2: "empty", 3: "empty", 4: "copy", 5: "copy", 6: "truncated", 7: "refusal", 8: "language"}


def test_defects_are_told_without_pairs_to_learn_from(spark):
    cs = "Kostry uložené v hrobech byly silně stráveny kyselou půdou."
    rows = [
        (1, cs, cs), (2, cs, "Translation: " + cs.upper()), (3, cs, "The skeletons in the graves were decayed by the acidic soil."), (4, cs, None), (5, cs, "Sorry, I cannot translate this text."),
        (7, "The walls of the pit were straight.", "The walls of the pit were straight."), (8, "12", "12"), (9, cs, "n/a"),
    ]
    df = spark.createDataFrame(rows, "seg_id long, text_auto string, text_en string")
    want = {1: "copy", 2: "copy", 4: "empty", 5: "refusal", 9: "empty"}
    for sample in (df, df.limit(0)):  # the same operator at every size, down to nothing
        fitted = pairs.fit(sample, "seg_id", "text_auto", "text_en")
        assert dict(tuple(r) for r in pairs.defective(df, fitted, "seg_id", "text_auto", "text_en").collect()) == want


def test_a_few_wrong_pairs_are_not_learned_by_heart():
    rng = random.Random(5)
    words = {"en": "the pit was filled with dark soil and stones from wall near road".split(), "cs": "jáma byla vyplněna tmavou hlínou a kameny ze zdi vedle cesty".split()}
    line = lambda c: " ".join(rng.choice(words[c]) for _ in range(8)).capitalize() + "."
    sample = [(line("cs"), line("en")) for _ in range(400)] + [(line("cs"), "Translation is not possible for this part.")]
    fitted = pairs.Pairs(sample)
    assert fitted.defects([line("cs")] * 2, ["Translation is not possible for this part.", line("en")]) == ["refusal", None]


def test_long_pairs_teach_to_their_end(spark, monkeypatch):
    w = pairs.fit_grams(["a" * 5000 + "qqqqq", "b" * 5000 + "wwwww"], np.array([1.0, 0.0]), 1)
    ends = pairs.gram_means(["qqqqq", "wwwww"], w[:, None])[:, 0]
    assert ends[0] > 0 > ends[1]
    taught = []
    monkeypatch.setattr(pairs, "Pairs", lambda sample: taught.extend(sample))
    rows = [(i, "kost " * (2000 if i % 2 else 2), "bone " * 2000) for i in range(200)] + [(500, "kost", None)]
    df = spark.createDataFrame(rows, "seg_id long, text_auto string, text_en string")
    pairs.fit(df, "seg_id", "text_auto", "text_en")
    assert sorted(taught, key=str) == sorted(((a, e) for _, a, e in rows), key=str)
    taught.clear()
    monkeypatch.setattr(pairs, "SAMPLE_CHARS", 500_000)
    pairs.fit(df, "seg_id", "text_auto", "text_en")
    assert 100_000 < sum(len(a) + len(e or "") for a, e in taught) < 1_000_000


# 6 packing


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_packing_keeps_every_token(capacity):
    rng = random.Random(capacity)
    items = [(i, rng.choice("abc"), rng.choice((1, 3, 9, 30, 200))) for i in range(300)]
    out, _ = packing.pack_shard(items, capacity, {"a": 0.5, "b": 0.3, "c": 0.2}, {"b": 40.0})
    used, by = {}, {}
    for k, piece, start, n, box, _ in out:
        used[box] = used.get(box, 0) + n
        by.setdefault(k, []).append((piece, start, n))
    assert max(used.values()) <= capacity
    for k, _, n in items:
        rows = sorted(by[k])
        assert [r[0] for r in rows] == list(range(len(rows))) and sum(r[2] for r in rows) == n
        assert [r[1] for r in rows] == list(itertools.accumulate([0] + [r[2] for r in rows]))[:-1]
        assert len(rows) == (1 if n <= capacity else -(-n // capacity))


def test_windows_keep_the_mixture():
    rng = random.Random(4)
    items = [(i, "ab"[rng.random() < 0.25], rng.randint(5, 40)) for i in range(6000)]
    total = {s: sum(n for _, x, n in items if x == s) for s in "ab"}
    share = {s: total[s] / sum(total.values()) for s in "ab"}
    out, _ = packing.pack_shard(items, 256, share, {})
    source = {i: s for i, s, _ in items}
    last = max(r[5] for r in out)
    for w in range(last):
        rows = [r for r in out if r[5] == w]
        got = sum(r[3] for r in rows if source[r[0]] == "b") / sum(r[3] for r in rows)
        assert abs(got - share["b"]) < 0.03


def test_windows_keep_the_mixture_of_oversized_texts():
    rng = random.Random(5)
    # source b's texts are nearly all larger than a container, source a's hardly ever
    items = [(i, "a", rng.randint(5, 300)) if rng.random() < 0.9 else (i, "b", rng.randint(200, 6000)) for i in range(6000)]
    source = {i: s for i, s, _ in items}
    total = {s: sum(n for _, x, n in items if x == s) for s in "ab"}
    share = {s: total[s] / sum(total.values()) for s in "ab"}
    out, _ = packing.pack_shard(items, 256, share, {})
    assert sum(r[3] for r in out) == sum(total.values()) and min(r[5] for r in out) == 0
    held = {}
    for r in out:
        held.setdefault(r[4], []).append(r[3])
    assert all(len(x) == 1 for x in held.values() if 256 in x)
    for w in range(max(r[5] for r in out)):
        rows = [r for r in out if r[5] == w]
        got = sum(r[3] for r in rows if source[r[0]] == "b") / sum(r[3] for r in rows)
        assert abs(got - share["b"]) < 0.05


def window_shares(out, items):
    held: dict[int, dict[str, int]] = {}
    for at, _, _, n, _, w in out:
        mine = held.setdefault(w, {})
        mine[items[at][1]] = mine.get(items[at][1], 0) + n
    return held


def test_deficits_are_carried_over_windows_and_shards():
    rng = random.Random(12)
    names = [f"s{i}" for i in range(30)]
    weight = [1 / (i + 1) for i in range(30)]
    items = [(i, rng.choices(names, weight)[0], rng.choice((5, 40, 300, 2500))) for i in range(8000)]
    total = {s: sum(n for _, x, n in items if x == s) for s in names}
    share = {s: total[s] / sum(total.values()) for s in names}
    largest = min(256, 2500)
    credit = {s: rng.uniform(-200, 200) for s in names}
    out, left = packing.pack_shard(items, 256, share, credit)
    assert sum(r[3] for r in out) == sum(total.values())
    served, given = dict.fromkeys(names, 0), 0
    held = window_shares(out, items)
    for w in range(max(held)):  # of the last one sources are exhausted
        given += sum(held[w].values())
        for s in names:
            served[s] += held[w].get(s, 0)
            # over all windows so far a source is behind or before its share by one piece, one round and what it had before
            if served[s] < total[s]:
                assert abs(served[s] - share[s] * given - credit[s]) <= 2 * largest + sum(abs(c) for c in credit.values()) / 30 + share[s] * 3000
    for s in names:  # what is left is what it was credited with, less what it handed over
        assert left[s] > -1e-6


def test_time_and_served_agree():
    mixture = packing.Mixture({"a": 0.5, "b": 0.3}, {"a": 100, "b": 900}, 2000)
    sizes = {"a": (100, 0.5), "b": (900, 0.3), "rest": (1000, 0.2)}
    for t in (0.0, 50.0, 199.0, 201.0, 2500.0, 3500.0, 4999.0):
        want = sum(min(n, s * t) for n, s in sizes.values())
        assert abs(mixture.time(want) - t) < 1e-6
    with pytest.raises(ValueError):
        packing.Mixture({"a": 0.9, "b": 0.3}, {"a": 1, "b": 1}, 9)


def packed_sizes(spark, rows, targets=None):
    """shard -> source -> tokens, and shard -> source -> credit."""
    sizes = spark.createDataFrame(rows, "k long, source string, n long")
    work, mixture, n_shards, step = packing.sharded(sizes, targets)
    got = work.collect()
    assert sorted((r["k"], r["n"]) for r in got) == sorted((k, n) for k, _, n in rows)
    held: dict[int, dict[str, int]] = {}
    for r in got:
        mine = held.setdefault(r["shard"], {})
        mine[r["source"]] = mine.get(r["source"], 0) + r["n"]
    for s in {r["source"] for r in got}:  # places are the running sum of the source
        at = 0
        for r in sorted((r for r in got if r["source"] == s), key=lambda r: (r["place"], r["n"])):
            assert r["place"] == at and r["shard"] >= 0
            at += r["n"]
    return held, n_shards, step


def test_shards_hold_every_source_at_its_share(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 20_000)
    monkeypatch.setattr(packing, "BUCKETS_A_GROUP", 3)
    rng = random.Random(2)
    names = [f"s{i}" for i in range(30)]
    rows = [(i, rng.choices(names, [1 / (j + 1) for j in range(30)])[0], rng.choice((5, 40, 300, 900))) for i in range(3000)]
    rows += [rows[0]] * 3
    total = {s: sum(n for _, x, n in rows if x == s) for s in names}
    all_ = sum(total.values())
    held, n_shards, step = packed_sizes(spark, rows)
    assert len(held) == n_shards > 10
    for mine in held.values():
        for s in names:
            assert abs(mine.get(s, 0) - total[s] / n_shards) <= 900
    # half and half of two sources as long as they last, then the others
    held, n_shards, step = packed_sizes(spark, rows, {"s0": 0.5, "s1": 0.5})
    least = min(total["s0"], total["s1"])
    for h in range(int(2 * least / step)):
        assert set(held[h]) <= {"s0", "s1"} or sum(held[h][s] for s in held[h] if s not in ("s0", "s1")) <= 30 * 900
        assert abs(held[h]["s0"] - step / 2) <= 900 and abs(held[h]["s1"] - step / 2) <= 900
    assert sum(sum(x.values()) for x in held.values()) == all_


@pytest.mark.skipif(not RANKS_AT, reason="no tokenizer files")
def test_token_counts_and_whole_packing(spark):
    counter = packing.TokenCounter()
    for t in (*BASE, "don't  stop\n\n 12345 　x", "a" * 300, "😀 é"):
        assert counter.count(t) == len(counter.encode(t))
    rows = [(i, "slovo " * (i % 9), ("s1", None)[i % 2], "t") for i in range(200)] + [(999, None, "s1", "t"), (998, "x " * 600, "s2", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")
    kinds = spark.createDataFrame([("small", 16, None), ("small", 16, None), ("big", 64, None), ("none", None, None), ("bad", 0, None)], "container_kind string, capacity_tokens int, note string")
    packed = packing.pack(docs, kinds, "doc_id", "text", "source", materialize)
    got = packed.groupBy("capacity_tokens", "doc_id").sum("n_tokens").collect()
    assert all(r[2] == counter.count(dict((i, t) for i, t, *_ in rows)[r[1]]) for r in got)
    assert packing.fills(packed).where("used_tokens > capacity_tokens").count() == 0
    assert packing.pack(docs.limit(0), kinds, "doc_id", "text", "source", materialize).count() == 0


@pytest.mark.skipif(not RANKS_AT, reason="no tokenizer files")
def test_every_kind_of_container_is_filled(spark):
    docs = spark.createDataFrame([(1, "kost", "s")], "doc_id long, text string, source string")
    kinds = spark.createDataFrame([(f"kind {i}", 64) for i in range(1050)], "container_kind string, capacity_tokens int")
    assert packing.pack(docs, kinds, "doc_id", "text", "source", materialize).select("container_kind").distinct().count() == 1050


@pytest.mark.skipif(not RANKS_AT, reason="no tokenizer files")
def test_packing_to_targets_with_nulls_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 3_000)
    rng = random.Random(8)
    rows = [(i, "slovo " * rng.choice((3, 20, 90)), rng.choice(("a", "b", "c", None)), i, 1.0) for i in range(600)] + [(None, "bez klíče", "a", 1, 1.0), (None, "bez klíče", "a", 1, 1.0), (7, "x", "b", 0, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, place int, share double")
    kinds = spark.createDataFrame([("small", 64)], "container_kind string, capacity_tokens int")
    counter = packing.TokenCounter()
    total = sum(counter.count(r[1]) for r in rows)
    for targets in (None, {"a": 0.5, "b": 0.5}, {"a": 0.2, "zz": 0.5}, {"c": 0.0}):
        got = packing.pack(docs, kinds, "doc_id", "text", "source", materialize, targets).collect()
        assert sum(r["n_tokens"] for r in got) == total and sum(r["doc_id"] is None for r in got) == 2
        used = {}
        for r in got:
            used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
        assert max(used.values()) <= 64 and sum(used.values()) / (64 * len(used)) > 0.9
        if targets == {"a": 0.5, "b": 0.5}:
            first = [r for r in got if r["shard"] == 0]
            share = sum(r["n_tokens"] for r in first if r["source"] == "a") / sum(r["n_tokens"] for r in first)
            assert abs(share - 0.5) < 0.06
    mixed = packing.mixtures(packing.pack(docs, kinds, "doc_id", "text", "source", materialize)).groupBy("shard", "pack_window").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-4 for r in mixed)
    with pytest.raises(ValueError):
        packing.pack(docs, kinds, "doc_id", "text", "source", materialize, {"a": 0.9, "b": 0.9})


# 7 leaks


def one_edit(src: list[str], doc: list[str], window: int) -> bool:
    """Whether any window of the item is within one word edit of any stretch of the document."""
    for i in range(len(src) - window + 1):
        w = src[i : i + window]
        for j in range(len(doc)):
            for size in (window - 1, window, window + 1):
                d = doc[j : j + size]
                if len(d) < size:
                    continue
                k = 0
                while k < min(len(w), len(d)) and w[k] == d[k]:
                    k += 1
                if k == len(w) == len(d):
                    return True
                if size == window and w[k + 1 :] == d[k + 1 :] or size < window and w[k + 1 :] == d[k:] or size > window and w[k:] == d[k + 1 :]:
                    return True
    return False


def test_leaks_against_brute_force():
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(30)]
    items = [(f"i{n}", " ".join(rng.choice(vocab) for _ in range(rng.randint(24, 40)))) for n in range(6)]
    automaton = leaks.Items(items)
    hits = 0
    for _ in range(250):
        src = rng.choice(items)[1].split()
        a = rng.randrange(0, len(src) - 15)
        part = src[a : a + rng.randint(14, 28)]
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(part))
            part[at : at + rng.randint(0, 1)] = rng.choice(([], ["zz"], ["zz"]))
        doc = [rng.choice(vocab) for _ in range(rng.randint(0, 6))] + part + [rng.choice(vocab) for _ in range(rng.randint(0, 6))]
        found = {automaton.ids[i] for i in automaton.search(" ".join(doc))}
        want = {name for name, text in items if one_edit(text.split(), doc, 20)}
        assert found == want, (doc, found, want)
        hits += bool(want)
    assert hits > 30


def test_leaks_spans_and_cases(spark):
    src = " ".join(f"Slovo{i}, čest" for i in range(15))
    items = spark.createDataFrame([("a", src, 1), ("a", src, 2), (None, src, 3), ("c", None, 4), ("d", "krátké", 5)], "id string, src string, k int")
    text = "Úvod – " + src.upper().replace("ČEST SLOVO9", "ČEST\nSLOVO9") + " konec"
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "jiný text", "x"), (1, text, "x")], "doc_id long, text string, item_id string")
    got = leaks.leaks(docs, items, "doc_id", "text", "id", "src").distinct().collect()
    assert [(r["k"], r["item_id"], r["words"]) for r in got] == [(1, "a", 30)]
    assert text[got[0]["start"] : got[0]["end"]].startswith("SLOVO0") and text[: got[0]["end"]].endswith("ČEST")
    assert leaks.leaks(docs, items.limit(0), "doc_id", "text", "id", "src").count() == 0


def test_item_groups_find_the_same(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(f"i{n}", " ".join(f"w{rng.randrange(500)}" for _ in range(25))) for n in range(8)]
    items = spark.createDataFrame(rows, "id string, src string")
    docs = spark.createDataFrame([(n, f"x {t} y") for n, (_, t) in enumerate(rows)], "doc_id long, text string")
    one = sorted(tuple(r) for r in leaks.leaks(docs, items, "doc_id", "text", "id", "src").collect())
    monkeypatch.setattr(leaks, "MAX_ITEM_CHARS", 300)
    assert sorted(tuple(r) for r in leaks.leaks(docs, items, "doc_id", "text", "id", "src").collect()) == one and len(one) == 8


# 8 cut-off texts


def test_ends_of_texts(spark):
    rows = {
        "Celá věta.": ("", True), "Věta (viz výše.)": ("", True), "Řekl: „Ano!“": ("", True), "viz obr.": ("", False), "obr.": ("", False), "Plocha byla či\ufffd\ufffd": ("\ufffd\ufffd", False),
        "Plocha […]": (" […]", True), "Plocha <b": ("<b", False), "x &am": ("&am", False), "Plocha...": ("...", True), "a" * 40 + "\ufffd" * 40: ("\ufffd" * 40, False), "bez konce": ("", False), ")": ("", False),
        "s.": ("", False), "dlouhá věta o jámě s.": ("", False), "Byl to hrob.)]”": ("", True),
    }
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", cut_off.cut_mark(F.col("t")).alias("m"), cut_off.ends_sentence(F.col("t")).alias("e")).collect()
    assert {r["t"]: (r["m"], r["e"]) for r in got} == rows


def test_cut_texts(spark):
    rng = random.Random(7)
    words = ["Plocha", "byla", "čistá", "a", "sonda", "ležela", "hluboko", "pod", "terénem", "vedle", "cesty"]

    def body(n):
        out = ""
        while len(out) < n:
            out += " ".join(rng.choice(words) for _ in range(rng.randint(4, 9))).capitalize() + ". "
        return out.strip()

    rows, want = [], set()
    for i in range(400):
        t = body(rng.randint(100, 900))
        if i % 5 == 0:
            t = body(700)[:400].rstrip()
            if len(t) < 400:
                t += "x" * (400 - len(t))
            if not t.endswith("."):
                want.add(i)
        elif i % 5 == 1:
            t += f"\nPříloha č. {i}"
        elif i % 5 == 2:
            t += f"\n\n{rng.choice(('Lhota', 'Brno'))} {i % 28 + 1}. 5. 19{i % 90 + 10}"
        rows.append((i, t, "s1", 0))
    rows += [(1000, body(300)[:-20].rstrip(" .") + " sond [...]", "s2", 0), (1001, body(300) + " Plocha byla či�", None, 0)]
    want |= {1000, 1001}
    rows += [(2000, None, "s1", 0), (2001, "", "s1", 0), (2002, "  ", None, 0), (2003, "Celá věta.", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, form int")
    found = cut_off.find_cut(df, "doc_id", "text", "source", materialize)
    got = {r["k"] for r in found.where("is_cut").collect()}
    assert got == want
    share = {r["source"]: (r["n_values"], r["n_cut"]) for r in cut_off.cut_share(found).collect()}
    assert share["s2"] == (1, 1) and share["s1"][0] == 400
    assert cut_off.find_cut(df.limit(0), "doc_id", "text", "source", materialize).count() == 0


def test_spikes_stand_at_the_maximum_and_reasons_are_told(spark):
    rng = random.Random(3)

    def body(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n - 1)).strip().ljust(n - 1, "x")

    rows = [(i, body(rng.randint(60, 900)) + ".", body(rng.randint(60, 300)) + ".", "s") for i in range(300)]
    rows += [(1000 + i, body(950), body(310), "s") for i in range(40)]  # both columns have a limit of their own
    rows += [(2000 + i, body(120), None, "s") for i in range(20)]  # many of one length, but far below the maximum
    rows += [(3000, "Plocha byla […]", None, "s"), (3001, "Plocha byla čis", None, "t")]
    df = spark.createDataFrame(rows, "id long, a string, b string, source string")
    found = cut_off.find_cut(df, "id", ["a", "b"], "source", materialize)
    got = {(r["k"], r["field"]): r["reason"] for r in found.where("is_cut").collect()}
    assert all(got[1000 + i, c] in ("chars", "bytes") for i in range(40) for c in "ab")
    assert {got.get((2000 + i, "a")) for i in range(20)} <= {"fragment", None}
    assert got[3000, "a"] == "mark" and got[3001, "a"] == "fragment"
    strict = cut_off.find_cut(df, "id", ["a", "b"], "source", materialize, beyond_spikes=False).where("is_cut")
    assert {r["k"] for r in strict.collect()} == {1000 + i for i in range(40)}
    share = {(r["source"], r["field"]): r["n_values"] for r in cut_off.cut_share(found).collect()}
    assert share["s", "b"] == 340 and share["t", "a"] == 1

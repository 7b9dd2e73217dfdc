"""Streams against batch results; run events, fan-in and audits on small inputs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as fx
from lexloom.operators import licences, provenance, records
from lexloom.sources import harvest, xml_nodes
from lexloom.streaming import streams


def test_streamed_upsert_equals_batch_in_any_cut(spark, tmp_path):
    rows = [(i % 3, "ab"[i % 2], f"2024-01-0{1 + i % 4}", i) for i in range(24)]
    schema = "doc int, block string, at string, ord int"
    for n in range(4):  # four files come as one or more batches
        spark.createDataFrame(rows[n::4], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"events.parquet{n}"))
    all_rows = spark.createDataFrame(rows, schema)
    stream = streams.event_stream(spark, str(tmp_path / "in"), "events", all_rows.schema)
    got = {tuple(r) for r in streams.upsert_newest(stream, ["doc", "block"], "at", "ord", "t").collect()}
    assert got == {tuple(r) for r in records.newest_block(all_rows, ["doc", "block"], "at", "ord").collect()}


def test_streamed_counts(spark, tmp_path):
    day = dt.datetime(2024, 1, 1, 12)
    rows = [(day, "x"), (day, "x"), (day + dt.timedelta(days=1), "y"), (None, "x")]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string")
    df.write.parquet(str(tmp_path / "events.parquet"))
    out = streams.appended(streams.counted(streams.event_stream(spark, str(tmp_path), "events", df.schema)), "c", "complete")
    assert sorted((r["event_type"], r["n_events"]) for r in out.collect()) == [("x", 2), ("y", 1)]


def test_run_events(spark):
    rows = [("r", 1, "skip", "a", "bad", None), ("r", 2, "document", "a", None, None), ("r", 3, "skip", "b", "late", None), ("r", 4, "output", "csv", None, 3),
            ("r", 5, "output", "csv", None, None), ("s", 1, "output", "xml", None, 2), ("t", 1, "inputs", None, None, 9)]
    e = spark.createDataFrame(rows, provenance.EVENTS)
    got = {r["run_id"]: tuple(r)[1:] for r in provenance.run_statistics(e).collect()}
    assert got == {"r": (1, 2, 3, 4), "s": (2, 0, 2, 2), "t": (0, 0, 9, 0)}
    assert [(r["name"], r["detail"]) for r in provenance.quarantined(e).collect()] == [("b", "late")]
    comp = spark.createDataFrame([("r", "x"), ("s", "x")], "run_id string, name string")
    assert [r["run_id"] for r in provenance.used_components(e, comp).collect()] == ["r"]


def test_fan_in_and_audits(spark):
    rows = [("d", "source", "sha", "1", None, 0), ("d", "source", "sha", "2", None, 1), ("d", "lines", None, "old", "2020", 2), ("d", "lines", None, "new", "2021", 3), ("d", "lines", None, "tie", "2021", 4)]
    parts = spark.createDataFrame(rows, "doc_id string, block string, key string, payload string, updated_at string, ord int")
    assert {(r["block"], r["payload"]) for r in records.fan_in(parts).collect()} == {("source", "1"), ("lines", "new")}
    blocks = spark.createDataFrame([("d", "w"), ("e", "w")], "doc_id string, program string")
    origins = spark.createDataFrame([("d", "OCR:x"), ("e", "unknown")], "doc_id string, origin string")
    assert [r["doc_id"] for r in records.originator_audit(blocks, origins, [("ocr:", "a")]).collect()] == ["d"]
    grouped = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "a"), ("h", ""), ("h", None)], "g string, doc string")
    assert [r["g"] for r in records.several_documents(grouped, "g", "doc").collect()] == ["g"]
    row = spark.createDataFrame([(None,)], "effective_license string")
    assert tuple(licences.flagged(row).first()) == ("MIT", False, False)


def test_fields_search_and_fetch(spark):
    row = spark.createDataFrame([(["id", "Name_CS"],)], "n array<string>")
    assert row.select(fx.first_field(F.col("n"), ["label", "name"]).alias("x")).first()["x"] == "Name_CS"
    query, variables = harvest.search_query(["language", "limit"], "cs", ["id", "name"], 5)
    assert query == 'query GetSearch($limit: Int!, $lang: Language!) { search(value: "", limit: $limit, language: $lang) { id name } }'
    assert variables == {"lang": "CS", "limit": 5}
    assert harvest.search_query([], "cs", ["id"]) == ('query GetSearch { search(value: "") { id } }', {})
    urls = spark.createDataFrame([("h://x?id=pre-1/2",), ("h://bad?id=pre-3",)], "url string")

    def fake(url, body):
        if "bad" in url:
            raise ValueError("no")
        return b"ok"

    got = {r["name"]: (r["content"], r["error"]) for r in harvest.fetched(urls, "pre-", fake, 1).collect()}
    assert got == {"12": (bytearray(b"ok"), None), "3": (None, "no")}


def test_throttle_waits_between_calls():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    t = harvest.Throttle(2.0, lambda: now[0], sleep)
    t.wait()
    now[0] += 0.5
    t.wait()
    assert slept == [1.5]


@pytest.mark.parametrize("limit,n", [(0, 3), (2, 2)])
def test_evaluation_segments(spark, limit, n):
    alto = "<alto><Page><TextBlock><TextLine><String CONTENT='a'/><String CONTENT=''/><String CONTENT='b'/></TextLine><TextLine><String CONTENT='c'/></TextLine></TextBlock></Page></alto>"
    files = spark.createDataFrame([("z.alto.xml", alto), ("a.xml", "<r><d> one </d><d>two<x/></d><d> </d></r>"), ("bad.xml", "<r>")], "name string, content string")
    got = [(r["file"], r["id"], r["src"]) for r in xml_nodes.evaluation_segments(files, ["//d"], {}, limit).collect()]
    want = [("a.xml", "field0", "one"), ("a.xml", "field1", "two"), ("z.alto.xml", "block0", "a b c")]
    assert sorted(got) == want[:n]


def test_options_precedence():
    from lexloom.operators.options import options

    o = options({"target_lang": "de"}, "target_lang = fr\nchunk_limit = 50\nformats = xml, .ALTO.xml\nfast_align = yes\n", env={"LEXLOOM_CHUNK_LIMIT": "70", "LEXLOOM_CHUNK_OVERLAP": "x"})
    assert (o.target_lang, o.chunk_limit, o.chunk_overlap, o.fast_align, o.layout_mode) == ("de", 70, 0, True, True)
    assert not options({}, "[a]\nformats = xml", env={}).layout_mode


def test_services_and_notes(spark):
    from lexloom.operators import backends

    form = backends.FormService("u", "models", fetch=lambda u, b: (u.rsplit("/", 1)[1] + ":" + b.decode()[11:14] + "\n").encode())
    assert spark.createDataFrame([("abc def",)], "t string").select(form.translate(F.col("t"), "cs", "en").alias("x")).first()["x"] == "cs-en:abc"
    got = backends.annotated(spark.createDataFrame([(1, "a"), (2, None)], "k int, t string"), "k", "t", "u", lambda u, b: b'{"result": "1\\ta"}').collect()
    assert [(r["k"], r["conllu"]) for r in got] == [(1, "1\ta"), (2, "")]
    rows = licences.flagged(spark.createDataFrame([("House", 2, "House,Own")], "effective_license string, n_components int, unknown_licenses string"))
    assert licences.notes(rows).first()["notes"] == "The output licence is House, the most restrictive of 2 component(s). Not recognised and treated as most restrictive: House, Own."


def test_late_events_are_left_out_and_state_is_bounded(spark, tmp_path):
    from lexloom.streaming import streams

    folder = str(tmp_path / "in")

    def batch(name, rows):
        spark.createDataFrame(rows, "ts string, event_type string").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet/{name}")

    batch("1", [("2026-01-01 10:00:00", "a"), ("2026-01-01 11:00:00", "a")])
    schema = spark.read.parquet(f"{folder}/events.parquet/1").schema
    stream = lambda: streams.event_stream(spark, folder, "events", schema)
    state = str(tmp_path / "state")

    def run(out):
        kept = []
        q = streams.counted(stream()).writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda df, i: kept.extend((str(r["w"]["start"])[:10], r["n_events"]) for r in df.collect())).start()
        q.awaitTermination()
        out.append(sorted(kept))
        return q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress and q.lastProgress["stateOperators"] else None

    seen = []
    run(seen)
    batch("2", [("2026-01-05 10:00:00", "a")])
    run(seen)
    batch("3", [("2026-01-01 12:00:00", "a"), ("2026-01-05 11:00:00", "a")])  # the first is four days late
    rows = run(seen)
    assert seen[0] == [("2026-01-01", 2)] and ("2026-01-01", 3) not in seen[2] and ("2026-01-05", 2) in seen[2]
    assert rows in (None, 1)

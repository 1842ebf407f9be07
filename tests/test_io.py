"""Sources, sinks, stages, captions, signals and streams on small files."""

from __future__ import annotations

import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import signals
from tallyframe.operators import captions
from tallyframe.plans.stages import Plan, Stage
from tallyframe.sources import readers, writers
from tallyframe.streaming import events


def test_json_lines_end_at_the_first_malformed_one(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3\n{"a": 4}\n')
    (tmp_path / "b.jsonl").write_text('{"a": 9}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(tmp_path), "a int").collect()) == [1, 2, 9]


def test_nested_documents_and_captions(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"segments": [{"id": 1, "words": [{"w": "Şimdi", "start": 0.0, "end": 0.5}]}]}, ensure_ascii=False, indent=1))
    assert readers.json_documents(spark, str(tmp_path / "t.json")).select(F.explode("segments").alias("s")).select(F.explode("s.words").alias("w")).first().w.w == "Şimdi"
    (tmp_path / "c.vtt").write_text("WEBVTT\nKind: captions\n\n1\n00:00.000 --> 00:01.000\n<c>Selam</c> dünya\n\n2\n00:01.000 --> 00:02.000\nnasıl\n")
    assert readers.captions(spark, str(tmp_path / "c.vtt")).first().text == "Selam dünya nasıl"


def test_upsert_table_and_csv(spark, tmp_path):
    path = f"{tmp_path}/videos"
    rows = lambda *x: spark.createDataFrame(x, "video_id string, title string, at int")
    assert readers.maybe_table(spark, path, "videos").count() == 0
    writers.upsert_table(rows(("a", "x", 1), ("a", "y", 2)), path, "videos", "at")
    writers.upsert_table(rows(("b", "z", 1)), path, "videos", "at")
    assert sorted((r.video_id, r.title) for r in readers.maybe_table(spark, path, "videos").collect()) == [("a", "y"), ("b", "z")]
    assert not writers.write_csv(rows().limit(0), f"{tmp_path}/none") and writers.write_csv(rows(("a", "x", 1)), f"{tmp_path}/some")
    assert "| a | x | 1 |" in writers.markdown(rows(("a", "x", 1)))


def test_reports(spark, tmp_path):
    s = spark.createDataFrame([("s1", 40.0, "energy", 5.0), ("s2", 50.0, "energy", 10.0)], "segment_id string, total double, criterion string, score double")
    assert "s2  50.0" in writers.scorecard(s) and "#" * 20 in writers.scorecard(s)
    assert "<polyline" in writers.report_html("a<b", {"t": s}, [(0.0, 1.0), (1.0, 0.2)])
    writers.write_json(tmp_path / "x.json", {"ş": 1})
    assert json.loads((tmp_path / "x.json").read_text()) == {"ş": 1}


def test_wav_windows_and_signals(spark, tmp_path):
    rate = 8000
    t = np.arange(rate * 2) / rate
    x = 0.5 * np.sin(2 * np.pi * 200 * t) * (t > 1)
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    df = readers.wav_windows(spark, f"{tmp_path}/a.wav", spark.createDataFrame([("a.wav", 0.0, 1.0), ("a.wav", 1.0, 1.5)], "file string, start double, end double"))
    got = {r.start: r for r in df.select("start", F.size("samples").alias("n"), signals.energy_db("samples", F.lit(rate)).alias("e"), signals.pitch_semitones("samples", F.lit(rate)).alias("p")).collect()}
    assert (got[0.0].n, got[1.0].n) == (8000, 4000) and got[1.0].p < 0.5 and got[1.0].e < 1
    assert signals.envelope(x, rate).argmax() >= 5


def test_stages_run_again_only_when_needed(spark, tmp_path):
    stages = [Stage("a", lambda s, _: s.range(3), settings=("n",)), Stage("b", lambda s, i: i["a"].where("id > 0"), ("a",), ("k",)), Stage("c", lambda s, _: s.range(1))]
    first, again, other = (Plan(stages, c, str(tmp_path)) for c in ({"n": 1, "k": 1}, {"n": 1, "k": 1}, {"n": 1, "k": 2}))
    assert first.run(spark)["b"].count() == 2 and first.ran == ["a", "b", "c"]
    again.run(spark)
    other.run(spark)
    assert again.ran == [] and other.ran == ["b"]
    assert Plan(stages, {"n": 2, "k": 1}, "").fingerprints()["b"] != first.fingerprints()["b"]


@pytest.mark.parametrize("width", [1, 5, 12, 80])
@pytest.mark.parametrize("lines", [1, 2, 3])
def test_wrap_drops_no_word(spark, width, lines):
    words = "one two three four five sixteen".split()
    got = spark.range(1).select(captions.wrap(F.array(*map(F.lit, words)), width, lines)).first()[0]
    assert " ".join(got).split() == words and len(got) <= lines


def test_word_events(spark):
    rows = spark.createDataFrame([(1, i, w, i * 1.0, i + 0.5) for i, w in enumerate("abc")], "d int, pos long, w string, start double, end double")
    got = [r.line for r in captions.word_events(rows, "d").orderBy("pos").collect()]
    assert got[1] == "Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,a {\\c&H0000FFFF}b{\\r} c"
    assert spark.range(1).select(captions.colour(F.lit("#ff8000"))).first()[0] == "&H000080FF"


def test_stream_counts_equal_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(2).write.parquet(f"{tmp_path}/in")
    q = events.tumbling(events.read(spark, f"{tmp_path}/in"), "1 day").writeStream.outputMode("complete").format("memory").queryName("days").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("days").agg(F.sum("n")).first()[0] == src.count()
    d = events.once(events.read(spark, f"{tmp_path}/in")).writeStream.outputMode("append").format("memory").queryName("once").start()
    try:
        d.processAllAvailable()
    finally:
        d.stop()
    assert spark.table("once").count() == src.count()


def test_caption_lines_stream_by_partition(spark):
    from tallyframe.operators import caption_documents as docs

    docs.register(spark)
    rows = [("a", i, w, i * 0.5, i * 0.5 + 0.4, "9:16", "vergi iadesi") for i, w in enumerate("bir iki üç dört beş altı yedi".split())] + [("b", 0, None, None, None, None, None)]
    spark.createDataFrame(rows, "clip string, pos int, w string, start double, end double, aspect string, hook string").repartition(3).createOrReplaceTempView("few_words")
    got = {}
    for r in spark.sql("SELECT * FROM caption_lines(TABLE(few_words) PARTITION BY clip ORDER BY pos)").collect():
        got.setdefault(r.clip, {})[r.seq] = r.line
    a = [got["a"][i] for i in sorted(got["a"])]
    n = len(docs.HEAD.split("\n"))
    assert a[0] == "[Script Info]" and "PlayResX: 1080" in a and len(a) == n + 1 + 7
    assert a[n].endswith("{\\fad(180,260)\\pos(540,760)}VERGİ İADESİ")
    assert a[n + 2] == "Dialogue: 0,0:00:00.50,0:00:00.90,Base,,0,0,0,,BİR {\\c&H0000FFFF}İKİ{\\c&H00FFFFFF} ÜÇ DÖRT\\NBEŞ ALTI"
    assert a[-1].endswith("{\\c&H0000FFFF}YEDİ{\\c&H00FFFFFF}")
    assert len(got["b"]) == n + 1 and got["b"][n + 1].startswith("Dialogue: 0,0:00:00.00,0:00:00.04")


@pytest.mark.parametrize("width", [1, 5, 12, 80])
def test_filled_lines_hold_every_word(width):
    from tallyframe.operators import caption_documents as docs

    for lines in (1, 2, 3):
        rows = docs.filled([3, 3, 5, 4, 4, 7], width, lines)
        assert [i for r in rows for i in r] == list(range(6)) and len(rows) <= lines


def test_cover_document(spark):
    from tallyframe.operators import caption_documents as docs

    text = spark.range(1).select(docs.cover_document(F.lit("on dört binin üzerinde kişi bunu hiç bilmiyor ve ödüyor"))).first()[0]
    assert text.count("\\N") == 2 and "ÖDÜYOR" not in text and text.endswith("\n") and "{\\pos(540,1420)}ON DÖRT" in text


def test_settings_are_leaves(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"select": {"k": 3, "gap": [1.5, {"s": "ş"}]}, "none": {}, "off": None}, ensure_ascii=False))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.yaml").write_text("a: 1")
    got = {(r.file, r.key): r.value for r in readers.settings(spark, str(tmp_path)).where("error is null").collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "a.json"} == {"select.k": "3", "select.gap.0": "1.5", "select.gap.1.s": '"ş"', "none": "{}", "off": "null"}
    errors = {r.file: r.error for r in readers.settings(spark, str(tmp_path)).where("error is not null").collect()}
    assert errors["b.json"].startswith("JSONDecodeError") and (got.get(("c.yaml", "a")) == "1" or "YAML" in errors["c.yaml"])

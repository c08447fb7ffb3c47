import io
import json
import wave

import numpy as np
from pyspark.sql import functions as F

from heronry.sources import readers, writers
from heronry.streaming import incremental


def test_manifest_round_trip(spark, tmp_path):
    src = tmp_path / "m.jsonl"
    row = {"audio_path": "a.wav", "text": "hej", "speaker_id": "s", "dataset": "d", "duration_sec": 1.5, "sample_rate": 24000, "quality_score": None, "prosody": {}}
    src.write_text(json.dumps(row) + "\n\n" + json.dumps(row | {"audio_path": "b.wav", "extra": {"k": "v"}}) + "\n")
    df = readers.manifest(spark, str(src))
    assert df.where("audio_path is not null").count() == 2 and df.where("prosody is not null").count() == 0
    writers.write_manifest(df.where("audio_path is not null"), str(tmp_path / "out"))
    lines = sorted(json.loads(x.value)["audio_path"] for x in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ["a.wav", "b.wav"]
    texts = [x.value for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert all('"quality_score":null' in t for t in texts) and sum('"extra"' in t for t in texts) == 1


def test_piped_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("audio|text|speaker_id|duration|dnsmos\nw/1.wav|hej|s|1.5|3.0\nw/2.wav|x|s|bad|3.0\n")
    assert [r["audio"] for r in readers.speakers_csv(spark, str(tmp_path / "s.csv")).collect()] == ["w/1.wav"]
    (tmp_path / "t.txt").write_text("a|raw|norm\nb|raw2|  |x\nshort|x\n")
    assert [(r["rel_path"], r["text"]) for r in readers.piped_lines(spark, str(tmp_path / "t.txt")).collect()] == [("a", "norm"), ("b", "raw2")]
    (tmp_path / "lex.tsv").write_text("# c\n\nVi\tv ˈ i ː\n")
    assert [(r["word"], r["ipa"]) for r in readers.lexicon(spark, str(tmp_path / "lex.tsv"), custom=True).collect()] == [("vi", ["v", "ˈ", "i", "ː"])]
    (tmp_path / "c.yaml").write_text('hours: 11.0\nmix:   # weights\n  a: 0.5\n  b: 0.5\nsel:\n  cls: ["x", "y"]\n')
    assert readers.config(str(tmp_path / "c.yaml")) == {"hours": 11.0, "mix": {"a": 0.5, "b": 0.5}, "sel": {"cls": ["x", "y"]}}
    (tmp_path / "v.json").write_text('{"s1": {"name": "Alva", "gender": "F"}}')
    assert readers.json_lookup(spark, str(tmp_path / "v.json"), "name:string,gender:string,role:string").first().asDict() == {"key": "s1", "name": "Alva", "gender": "F", "role": None}


def test_optional_columns(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert readers.parquet_columns(spark, str(tmp_path / "p"), ["id"], {"dnsmos": 3.5}).agg(F.sum("dnsmos")).first()[0] == 10.5
    plan = readers.payload_of_keys(spark, str(tmp_path / "p"), "id", [1], [])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,1)]" in plan


def test_audio_decode(spark, tmp_path):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[100, 300], [0, 0]], "<i2").tobytes())
    df = spark.createDataFrame([("a", out.getvalue()), ("b", b"nope"), ("c", None)], "k string, content binary")
    got = {r["k"]: r["audio"] for r in readers.decode_audio(df).collect()}
    assert got["b"] is None and got["c"] is None and got["a"]["sr"] == 8000 and abs(got["a"]["samples"][0] - 200 / 32768) < 1e-9
    data = spark.createDataFrame([([0.5, -2.0],)], "x array<double>").select(writers.wav_bytes("x", 8000, 10)).first()[0]
    assert readers.pcm16(bytes(data))[0] == 8000 and len(readers.pcm16(bytes(data))[1]) == 82


def test_incremental_scoring(spark, tmp_path):
    src, report = str(tmp_path / "src"), str(tmp_path / "report")
    rows = spark.createDataFrame([("a",), ("b",)], "audio string")
    rows.write.parquet(src)
    scorer = lambda df: df.withColumn("cer", F.lit(0.1))
    schema = rows.withColumn("cer", F.lit(0.1)).schema
    for _ in range(2):
        incremental.score_stream(spark, src, rows.schema, report, str(tmp_path / "cp"), "audio", scorer, schema).awaitTermination()
    assert spark.read.parquet(report).count() == 2
    spark.createDataFrame([("b",), ("c",)], "audio string").write.mode("append").parquet(src)
    incremental.score_stream(spark, src, rows.schema, report, str(tmp_path / "cp"), "audio", scorer, schema).awaitTermination()
    assert sorted(r["audio"] for r in spark.read.parquet(report).collect()) == ["a", "b", "c"]
    incremental.score_new(spark.read.parquet(src), report, "audio", scorer, schema)
    assert spark.read.parquet(report).count() == 3


def test_merge_stream(spark, tmp_path):
    src, target = str(tmp_path / "src"), str(tmp_path / "t")
    spark.createDataFrame([(1,), (2,)], "k long").write.parquet(src)
    schema = spark.createDataFrame([], "k long").schema
    incremental.merge_stream(spark, src, schema, target, str(tmp_path / "cp"), "k", 900000).awaitTermination()
    spark.createDataFrame([(2,), (3,)], "k long").write.mode("append").parquet(src)
    incremental.merge_stream(spark, src, schema, target, str(tmp_path / "cp"), "k", 900000).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(target).collect()) == [900001, 900002, 900003]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "cer", "0.2", "3.0", 1)], "audio string, flags string, cer string, dnsmos string, idx int")
    writers.write_failures(df, str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).first()[0] == "a  [cer] cer=0.2 mos=3.0"
    writers.write_filelist(df, ["audio", "cer", "idx"], str(tmp_path / "l"), files=1)
    assert spark.read.text(str(tmp_path / "l")).first()[0] == "a|0.2|1"
    writers.write_lookup(df, "audio", "idx", str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": 1}
    writers.write_piped(df.select("audio", "flags"), str(tmp_path / "q"))
    writers.write_piped(df.select("audio", "flags"), str(tmp_path / "q"), mode="append")
    assert spark.read.option("sep", "|").option("header", True).csv(str(tmp_path / "q")).count() == 2
    writers.write_by_key(df, "flags", "audio", str(tmp_path / "k"))
    assert (tmp_path / "k" / "flags=cer").is_dir()
    assert readers.listing(spark, str(tmp_path / "l"), "*.txt").count() == 1
    assert writers.rewrite(df, str(tmp_path / "e")) != str(tmp_path / "e")

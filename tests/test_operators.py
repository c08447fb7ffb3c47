import random

import pytest
from pyspark.sql import functions as F

from heronry import api
from heronry.functions import backends, signal
from heronry.operators import gates, joins, sampling, sets, stats


def test_reasons_and_flags(spark):
    df = spark.createDataFrame([(0.5, 1.0, 0.0), (16.0, 1.0, 0.0), (5.0, 1.0, 0.5), (5.0, 0.01, 0.5), (5.0, 0.5, 0.1), (5.0, 0.5, 0.5)], "d double, p double, s double").coalesce(1)
    assert [r[0] for r in df.select(gates.reject_reason("d", "p", "s")).collect()] == ["too_short", "too_long", "clipping", "silent", "low_speech_ratio", None]
    q = spark.createDataFrame([(0.2, 2.0, 15.0, 0.0), (0.1, 3.0, 5.0, 3.0), (0.15, 2.6, 6.0, 2.0)], "c double, m double, r double, t double").coalesce(1)
    assert [r[0] for r in q.select(gates.flags_text(gates.qc_flags("c", "m", "r", "t"))).collect()] == ["cer+dnsmos", "rate+tail", ""]


def test_prosody_class(spark):
    p = "struct<f0_std:double,energy_std:double,energy_mean:double,speech_rate:double,pause_ratio:double>"
    rows = [(None, "va?"), ((5.0, 0.0, 1.0, 7.0, 0.1), "va? "), ((9.0, 0.9, 1.0, 7.0, 0.1), "x"), ((8.5, 0.0, 1.0, 7.0, 0.1), "x"), ((5.0, 0.0, 1.0, 9.0, 0.1), "x"), ((5.0, 0.0, 1.0, 7.0, 0.7), "x"), ((5.0, 0.0, 1.0, 7.0, 0.1), None)]
    got = [r[0] for r in spark.createDataFrame(rows, f"p {p}, t string").coalesce(1).select(gates.prosody_class("p", "t")).collect()]
    assert got == ["neutral", "frågande", "expressiv", "energisk", "snabb", "långsam", "neutral"]


def test_require(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert gates.require(df, F.col("x") > 5, "bad row").count() == 2
    with pytest.raises(Exception, match="bad row"):
        gates.require(df, F.col("x") > 1, "bad row").collect()
    with pytest.raises(ValueError):
        gates.require_rows(df, 3, "too few")


def loop_budget(rows, target, cap=None):
    kept, total, own = [], 0, {}
    for i, key, d in rows:
        if total >= target:
            break
        if cap is not None and own.get(key, 0) > cap:
            continue
        kept.append(i)
        total += d
        own[key] = own.get(key, 0) + d
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_budgets_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"k{rng.randint(0, 3)}", rng.randint(1, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, key string, d long")
    bucket = sampling.id_bucket("i", 16)
    assert [r[0] for r in sampling.take_budget(df, "d", 400, bucket, ["i"]).orderBy("i").select("i").collect()] == loop_budget(rows, 400)
    got = sampling.take_capped(df, "key", "d", 90, 300, bucket, ["i"]).orderBy("i").select("i").collect()
    assert [r[0] for r in got] == loop_budget(rows, 300, 90)


def test_split_is_disjoint_and_complete(spark):
    df = spark.range(500).withColumnRenamed("id", "clip_id")
    got = {r["split"]: r["count"] for r in sampling.split(df, 60).groupBy("split").count().collect()}
    assert got == {"val": 60, "train": 440}


def test_tickets_prefer(spark):
    df = spark.range(4000).withColumnRenamed("id", "clip_id").withColumn("p", F.col("clip_id") % 2 == 0).withColumn("t", sampling.ticket_key(F.col("p"), "clip_id"))
    first = df.orderBy("t").limit(1000).agg(F.avg(F.col("p").cast("double"))).first()[0]
    assert 0.6 < first < 0.73


def test_dedupe_and_last_wins(spark):
    df = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("c", 3), ("a", 4)], "t string, pos int")
    assert [r["t"] for r in sampling.dedupe_first(df, "t", "pos").orderBy("pos").collect()] == ["b", "a", "c"]
    assert sorted((r["t"], r["pos"]) for r in joins.last_wins(df, "t", "pos").collect()) == [("a", 4), ("b", 2), ("c", 3)]


def test_merge_is_idempotent(spark):
    main, shard = spark.createDataFrame([(1, "m")], "k long, v string"), spark.createDataFrame([(1, "s"), (2, "s")], "k long, v string")
    once = sets.merge_keyed(main, shard, "k")
    assert sorted(r["k"] for r in sets.merge_keyed(once, shard, "k").collect()) == [1, 900001, 900002] and once.count() == 3


def test_argmax_first_seen_wins(spark):
    df = spark.createDataFrame([("b", 3, 0), ("a", 2, 1), ("a", 1, 2)], "k string, v int, pos int")
    assert {r["k"] for r in stats.argmax_rows(df, "k", "v", "pos").collect()} == {"b"}


def test_api_flow(spark):
    rows = [(f"wavs/{i:06d}.wav", f"Hej på dig nummer {i}.", f"s{i % 3}", "nst", 4.0, None if i % 4 else 0.9, None) for i in range(40)]
    schema = "audio_path string, text string, speaker_id string, dataset string, duration_sec double, quality_score double, prosody struct<f0_std:double,energy_std:double,energy_mean:double,speech_rate:double,pause_ratio:double>"
    df = spark.createDataFrame(rows, schema)
    mix = api.build_mix(df, {"target_hours": 60 / 3600, "mix": {"nst": 1.0}, "selection": {"min_quality_score": 0.5}})
    assert mix.count() == 15
    lex = spark.createDataFrame([("hej", ["h", "ɛ", "j"]), ("på", ["p", "oː"]), ("dig", ["d", "ɛ", "j"])], "word string, ipa array<string>")
    lists = api.export_filelists(df, lex, val=10)
    assert lists["train"].count() == 30 and lists["val"].count() == 10 and lists["speakers"].count() == 3 and lists["dropped"].count() == 0
    taken = api.prepare(df.withColumn("i", F.monotonically_increasing_id()), 48.0, ["audio_path"], F.lit(0), used=spark.createDataFrame([("s0",)], "speaker_id string"), least_quality=0.5)
    assert {r[0] for r in taken.select("speaker_id").distinct().collect()} == {"s1", "s2"}
    report = spark.createDataFrame([("a", "0.200", "3.00", "15.0", "0.00"), ("b", "0.100", "3.00", "15.0", "0.00")], "audio string, cer string, dnsmos string, rate string, tail string").coalesce(1)
    scored, summary = api.verify(spark.createDataFrame([("a",), ("b",), ("c",)], "audio string"), report)
    assert {r["audio"]: r["flags"] for r in scored.collect()} == {"a": "cer", "b": ""} and summary.first()["share"] == 0.5


def test_signals(spark):
    df = spark.createDataFrame([([0.5, -0.5] * 50, [0.0] * 100)], "a array<double>, b array<double>")
    r = df.select(signal.blend("a", "b", 0.25)[0].alias("m"), signal.rms(signal.rms_normalise("a")).alias("rms"), F.size(signal.windows("a", 30, 10)).alias("w"), signal.quantise("a")[1].alias("q"), F.size(signal.tile("a", 250)).alias("t")).first()
    assert r["m"] == 0.125 and abs(r["rms"] - 10 ** (-23 / 20)) < 1e-6 and r["w"] == 8 and r["q"] == -16383 and r["t"] == 250


def test_pitch_and_filters(spark):
    import math

    tone = [math.sin(2 * math.pi * 220 * i / 8000) for i in range(6000)]
    df = spark.createDataFrame([(tone, 8000)], "x array<double>, sr int")
    r = df.select(signal.pitch("x", "sr").alias("f0"), signal.resample_to(4000)("x", "sr").alias("half"), signal.notch_at(220.0)("x", "sr").alias("cut")).first()
    assert r["f0"] and all(abs(f - 220) < 6 for f in r["f0"])
    assert len(r["half"]) == 3000 and max(map(abs, r["cut"][2000:4000])) < 0.1


def test_backends():
    with pytest.warns(UserWarning):
        assert backends.resolve_g2p("auto", "no_such_module_here") == "letters"
    with pytest.raises(ImportError):
        backends.resolve_g2p("neural", "no_such_module_here")
    assert backends.route("en-gb") == "b"
    with pytest.raises(KeyError):
        backends.route("xx")


def test_dense_index_of_keys_with_one_beginning(spark):
    """Speakers that all begin alike are numbered in ranges, as many as there are tasks."""
    names = sorted(f"nst_{i * 37 % 1000}" for i in range(1000))
    rows = spark.createDataFrame([(n, k) for k, n in enumerate(names * 2)], "speaker_id string, k int").repartition(4)
    got = joins.dense_index(rows, "speaker_id")
    assert {(r["speaker_id"], r["speaker_index"]) for r in got.collect()} == set(zip(names, range(1000))) and got.count() == 2000
    assert got.columns == ["speaker_id", "k", "speaker_index"]
    assert joins.dense_index(rows.limit(0), "speaker_id").count() == 0

from decimal import Decimal

import numpy as np
import pytest

from heronry.functions import prosody, signal


def whole(x, sr):
    """The eight fields by their definitions, a frame at a time."""
    f0 = []
    padded = np.pad(x, prosody.FRAME // 2)
    for s in range(0, len(x) + 1, prosody.HOP):
        f0.append(prosody.fundamental(padded[None, s : s + prosody.FRAME], sr)[0])
    voiced = np.array([f for f in f0 if 60 < f < 440])
    if len(voiced) < 10:
        return None
    st = 12 * np.log2(voiced / np.median(voiced))
    w = int(0.03 * sr)
    e = np.array([np.sqrt(np.mean(x[i * w : i * w + w] ** 2)) for i in range(len(x) // w)])
    env = e / (e.max() + 1e-9)
    peaks = sum(env[i] > env[i - 1] and env[i] > env[i + 1] and env[i] > 0.25 for i in range(1, len(e) - 1))
    pause, dur = 1 - np.mean(e > 0.1 * e.max()), len(x) / sr
    p = np.percentile(st, [5, 95])
    return [round(float(v), d) for v, d in ((np.median(voiced), 1), (st.std(), 2), (p[1] - p[0], 1), (e.mean(), 4), (e.std(), 4), (peaks / max(dur * (1 - pause), 0.1), 2), (pause, 3), (dur, 2))]


def clip(seed, sr, seconds):
    """A gliding tone with a changing level, pauses and noise."""
    rng = np.random.default_rng(seed)
    t = np.arange(int(sr * seconds)) / sr
    glide = rng.uniform(90, 300) * 2 ** (0.4 * np.sin(2 * np.pi * rng.uniform(0.2, 0.7) * t))
    level = np.abs(np.sin(2 * np.pi * rng.uniform(0.5, 2) * t + seed))
    return level * np.sin(2 * np.pi * np.cumsum(glide) / sr) + 0.001 * rng.normal(size=len(t))


@pytest.mark.parametrize("rows", [False, True])
def test_blocks_give_what_the_whole_gives(spark, rows):
    clips = [(f"c{k}", clip(k, 16000, s), 16000) for k, s in enumerate((3.0, 1.1, 0.2, 0.01))] + [("noise", np.random.default_rng(1).normal(size=20000), 16000), ("silent", np.zeros(20000), 16000)]
    if rows:
        import pandas as pd

        df = spark.createDataFrame(pd.concat([pd.DataFrame({"clip_id": c, "pos": np.arange(len(x)), "value": x}) for c, x, _ in clips]))
        parts = prosody.blocks_of_rows(df, "clip_id", "pos", "value", 16000, 4096)
    else:
        parts = prosody.blocks(spark.createDataFrame([(c, x.tolist(), sr) for c, x, sr in clips], "clip_id string, samples array<double>, sr int"), "clip_id", size=5000)
    got = {r["clip"]: r["prosody"] and list(r["prosody"]) for r in prosody.prosody(parts).collect()}
    want = {c: whole(x, sr) for c, x, sr in clips}
    assert got.keys() == want.keys() and [c for c, v in want.items() if v is None] == ["c2", "c3", "noise", "silent"]
    for c, fields in want.items():
        assert (got[c] is None) == (fields is None)
        assert fields is None or got[c] == pytest.approx(fields, abs=2e-4)


def test_empty_clips(spark):
    df = spark.createDataFrame([("a", [], 8000), ("b", None, 8000)], "clip_id string, samples array<double>, sr int")
    assert prosody.prosody(prosody.blocks(df, "clip_id")).count() == 0


@pytest.mark.parametrize("sr", [8000, 16000, 24000, 44100])
def test_tones(sr):
    for f in np.arange(62, 440, 17.3):
        tone = np.sin(2 * np.pi * f * np.arange(8192) / sr + 0.4) + 0.3 * np.sin(4 * np.pi * f * np.arange(8192) / sr)
        frames = np.lib.stride_tricks.sliding_window_view(tone, 2048)[::512]
        assert np.abs(prosody.fundamental(frames, sr) / f - 1).max() < 1e-3


def test_pitch_of_short_and_silent(spark):
    df = spark.createDataFrame([([0.0] * 4096, 8000), ([0.1] * 100, 8000), ([0.5] * 4096, 8000)], "x array<double>, sr int").coalesce(1)
    assert [r[0] for r in df.select(signal.pitch("x", "sr")).collect()] == [[None] * 5, [], [None] * 5]


def test_frames_at_the_limit_of_speech_are_pauses(spark):
    """Frames of exactly a tenth of the loudest one's level, whatever their samples' rounding."""
    tone = np.sin(2 * np.pi * 700 / 3 * np.arange(240 * 60) / 8000).reshape(60, 240)
    rows = []
    for k in range(1, 40):
        level = np.where(np.arange(60) == 30, k * 0.0247, k * 0.00247)
        rows.append((k, 8000, (tone * level[:, None]).ravel().tolist()))
    df = spark.createDataFrame(rows, "clip_id long, sr int, samples array<double>")
    got = prosody.prosody(prosody.blocks(df, "clip_id", size=4096)).collect()
    assert len(got) == 39 and {r["prosody"]["pause_ratio"] for r in got} == {0.983}


def test_clips_of_users_with_many_events(spark, tmp_path):
    """The frames that follow stand where the SQL has them, also in a clip of more than a thousand events."""
    import duckdb

    from heronry.plans.queries import ORACLE_SQL, QUERIES

    sql = "select e as event_id, timestamp '2024-01-01' + interval (e) second as ts, u as user_id, 'x' as event_type, 20 + (e * 7919 % 4001) / 100.0::DOUBLE as value, '' as props from (select unnest(range(1100)) as e), (select unnest([1, 2]) as u)"
    duckdb.sql(f"copy ({sql}) to '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    for name in ("prosody_of_events", "extracted_prosody"):
        got = sorted(map(tuple, QUERIES[name](spark, f"file://{tmp_path}").select(*con.sql(ORACLE_SQL[name]).columns).collect()))
        assert got == sorted(tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in con.sql(ORACLE_SQL[name]).fetchall())


@pytest.mark.parametrize("order", ["together", "cut", "mixed"])
def test_rows_are_measured_where_they_are(spark, order, monkeypatch):
    """Clips whose rows come together need no blocks by a shuffle; others do, and give the same."""
    import pandas as pd

    clips = [(f"c{k}", clip(k, 16000, s)) for k, s in enumerate((2.0, 0.2, 1.1, 0.01, 1.024))] + [("silent", np.zeros(4096))]
    rows = pd.concat([pd.DataFrame({"clip_id": c, "pos": np.arange(len(x)), "value": x}) for c, x in clips])
    df = spark.createDataFrame(rows.sample(frac=1, random_state=1) if order == "mixed" else rows).coalesce(1)
    if order == "cut":  # the first clip's rows in two pieces
        df = df.where("clip_id <> 'c0' or pos < 20000").unionAll(df.where("clip_id = 'c0' and pos >= 20000"))
    if order == "together":
        monkeypatch.setattr(prosody, "blocks_of_rows", None)
    got = {r["clip"]: r["prosody"] and list(r["prosody"]) for r in prosody.prosody_of_rows(df, "clip_id", "pos", "value", 16000, 4096).collect()}
    assert got.keys() == {c for c, _ in clips}
    for c, x in clips:
        fields = whole(x, 16000)
        assert (got[c] is None) == (fields is None) and (fields is None or got[c] == pytest.approx(fields, abs=2e-4))


def test_samples_in_rows_cost_little_a_block(spark, sf_dir, monkeypatch):
    """Blocks of a run are measured together and leave in few batches, Spark does not weigh rows of numbers one by one, and
    clips of few bytes are dealt to every core."""
    import pyarrow as pa

    from heronry.plans import speech

    x, calls, frames_of = clip(3, 8000, 30.0), [], prosody.frames_of
    batches = [pa.RecordBatch.from_arrays([pa.array([7] * len(v)), pa.array(range(at, at + len(v))), pa.array(v)], ["clip", "p", "v"]) for at in range(0, len(x), 10000) for v in [x[at : at + 10000]]]
    monkeypatch.setattr(prosody, "frames_of", lambda *a: calls.append(a[4]) or frames_of(*a))
    found = list(prosody._run_frames(iter(batches), 8000, 4096))
    assert len(found) == 1 and len(calls) <= 8 and sum(calls[:-1]) % 4096 == 0
    pitch, energy, above = frames_of(x, 8000, len(x), 0, len(x), 0)
    got = [np.array([np.nan if v is None else v for v in found[0].column(c).flatten().to_pylist()]) for c in ("pitch", "energy", "above")]
    assert got[0] == pytest.approx(pitch, rel=1e-9, nan_ok=True) and got[1] == pytest.approx(energy, rel=1e-12) and (got[2] == above).all()
    assert found[0].column("first").to_pylist()[-1] == 0 and found[0].column("n").to_pylist()[-1] == len(x)

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for key, weighed in (("long", False), ("string", True)):
        had = spark.conf.get(name)
        with prosody._unweighed(spark, spark.createDataFrame([], f"clip {key}, p long, v double")):
            assert (spark.conf.get(name) == had) == weighed
        assert spark.conf.get(name) == had
    assert speech._event_clips(spark, sf_dir).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism

import random

import numpy as np
import pytest

from heronry.functions import signal
from heronry.operators import quantiles, stats


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_equals_numpy(spark, most):
    rng = random.Random(3)
    rows = [("hot", rng.gauss(0, 1) ** 5) for _ in range(6000)] + [("ties", float(rng.randrange(3))) for _ in range(2000)] + [("same", 4.0)] * 500
    rows += [(f"k{i % 30}", rng.random()) for i in range(200)] + [(None, rng.random()) for _ in range(300)] + [("hot", None), ("none", None), ("one", 2.5), ("wide", 1e300), ("wide", -1e300), ("wide", 0.0)]
    rows += [("steep", 10.0 ** -k) for k in range(120)]
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    ps = (0.5, 0.05, 0.95, 0.0, 1.0)
    got = {r["k"]: (r["n"], r["q"]) for r in quantiles.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(4), "k", "v", *ps, most=most).collect()}
    assert got.keys() == by.keys()
    for k, vs in by.items():
        assert got[k][0] == len(vs) and got[k][1] == pytest.approx(list(np.quantile(vs, ps)), rel=1e-12, abs=1e-300)


def test_of_whole_numbers_and_nothing(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (7, 5)] * 40, "k long, v int")
    assert sorted(((r["k"], r["median"]) for r in stats.medians(df, "k", "v").collect()), key=str) == [(7, 5.0), (None, 1.5)]
    got = {r["k"]: r["q"] for r in quantiles.quantiles(df, "k", "v", 0.5, most=3).collect()}
    assert got == {None: [1.5], 7: [5.0]}
    assert quantiles.quantiles(df.limit(0), "k", "v", 0.5, most=3).count() == 0


def test_recurrence_equals_the_loop():
    rng = np.random.default_rng(4)
    w = 2 * np.pi * 1500 / 24000
    g = 1 / (1 + np.tan(w / 60))
    b, c = (g, -2 * g * np.cos(w), g), (-2 * g * np.cos(w), 2 * g - 1)
    for n in (1, 2, 3, signal.STEP - 1, signal.STEP, signal.STEP + 1, 3000):
        x = rng.normal(size=(3, n))
        got = signal.recurrence(x.copy(), b, c)
        for row, out in zip(x, got):
            x1 = x2 = y1 = y2 = 0.0
            for v, y in zip(row, out):
                want = b[0] * v + b[1] * x1 + b[2] * x2 - c[0] * y1 - c[1] * y2
                assert abs(want - y) < 1e-9
                x2, x1, y2, y1 = x1, v, y1, want


def test_notch_of_clips_of_any_length(spark):
    """Clips that are worked on together come out as each alone."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=n).tolist(), 8000 if i % 2 else 16000) for i, n in enumerate((900, 700, 1023, 5, 1, 0, 600))] + [(9, None, 8000)]
    df = spark.createDataFrame(rows, "i int, x array<double>, sr int").coalesce(1)
    together = {r["i"]: r["y"] for r in df.select("i", signal.notch_at(1000.0, 50.0)("x", "sr").alias("y")).collect()}
    for i, x, _ in rows:
        alone = df.where(f"i = {i}").select(signal.notch_at(1000.0, 50.0)("x", "sr")).first()[0]
        assert (x is None and together[i] is None is alone) or (len(x) == len(alone) and together[i] == pytest.approx(alone, abs=1e-9))


def test_a_click_stays_where_it_is():
    x = np.zeros(50_000)
    x[-1] = 1
    y = signal.resampled(x, 44100, 24000)
    assert len(y) == 27211 and np.abs(y[:-60]).max() == 0 and np.abs(y[-20:]).max() > 0.3


@pytest.mark.parametrize("rate,to", [(8000, 4000), (44100, 24000), (16000, 24000), (22050, 24000), (48000, 24000)])
def test_resampled_tones_and_blocks(rate, to, monkeypatch):
    x = np.sin(2 * np.pi * 440 * np.arange(30_000) / rate)
    y = signal.resampled(x, rate, to)
    assert np.abs(y - np.sin(2 * np.pi * 440 * np.arange(len(y)) / to))[100:-100].max() < 1e-4
    monkeypatch.setattr(signal, "OUTPUTS", 777)
    assert np.abs(signal.resampled(x, rate, to) - y).max() < 1e-12
    # what the lower rate can't hold goes
    if to < rate:
        high = np.sin(2 * np.pi * (to * 0.56) * np.arange(30_000) / rate)
        assert np.abs(signal.resampled(high, rate, to))[100:-100].max() < 2e-3

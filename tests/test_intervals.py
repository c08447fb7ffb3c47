import random

import numpy as np
import pytest

from heronry.operators import intervals


def plain(rows, longest, shortest):
    out, by = [], {}
    for k, s, e in rows:
        if s is not None and e is not None:
            by.setdefault(k, []).append((s, e))
    for k, xs in by.items():
        cur = None
        for s, e in sorted(xs):
            if cur is None:
                cur = [s, e]
            elif e - cur[0] <= longest:
                cur[1] = e
            else:
                out += [(k, *cur)] if cur[1] - cur[0] >= shortest else []
                cur = [s, e]
        out += [(k, *cur)] if cur[1] - cur[0] >= shortest else []
    return sorted(out, key=str)


def some(rng, n, gap, length):
    at, out = 0.0, []
    for _ in range(n):
        at += rng.random() * gap
        out.append((at, at + rng.random() * length))
    return out


@pytest.mark.parametrize("stretch,fan", [(1 << 16, 64), (16, 4), (7, 2)])
def test_equals_the_loop(spark, stretch, fan):
    """One hot key over many stretches and tasks, small ones, null keys, repeated and overlong intervals."""
    rng = random.Random(stretch)
    rows = [("hot", s, e) for s, e in some(rng, 900, 1.0, 3.0)] + [("dense", s, e) for s, e in some(rng, 300, 0.01, 0.02)]
    rows += [(f"k{i % 40}", s, e) for i, (s, e) in enumerate(some(rng, 200, 1.0, 1.0))] + [(None, s, e) for s, e in some(rng, 50, 2.0, 2.0)]
    rows += [("same", 1.0, 2.0)] * 60 + [("long", float(i // 2), i // 2 + 50.0) for i in range(40)] + [("one", 1.0, 9.0), ("gone", None, 1.0), ("gone", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(5)
    for longest, shortest in ((10.0, 2.0), (0.5, 0.0), (1e9, 0.0)):
        got = intervals.merge(df, "k", "a", "b", longest, shortest, stretch, fan)
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows, longest, shortest)


def test_empty(spark):
    out = intervals.merge(spark.createDataFrame([], "k long, a double, b double"), "k", "a", "b", 1.0, 0.0)
    assert out.columns == ["k", "s", "e"] and out.count() == 0


def test_composition():
    """Steps of neighbours, composed, are the steps of both together."""
    rng = random.Random(2)
    for _ in range(200):
        rows = some(rng, 40, rng.choice([0.1, 1.0]), rng.choice([0.5, 4.0]))
        rows.sort()
        s, e = (np.array(x) for x in zip(*rows))
        longest = rng.choice([0.3, 2.0, 9.0])
        parts = [intervals.step_function(s[i : i + 10], e[i : i + 10], longest) for i in range(0, 40, 10)]
        whole = parts[0]
        for p in parts[1:]:
            whole = intervals.compose(whole, p, longest)
        opened = np.array([-1e9, *(s[0] - rng.random() * 12 for _ in range(30))])
        for o, got in zip(opened, intervals.apply_steps(*whole, opened, longest)):
            cur = o
            for x, y in zip(s, e):
                if y - cur > longest:
                    cur = x
            assert got == cur

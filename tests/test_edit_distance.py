import random

from hypothesis import given, settings
from hypothesis import strategies as st

from heronry.functions.edit_distance import distances, edit_distance


def plain(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def pairs():
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 63, 64, 65, 127, 128, 129, 200):
        for letters in ("ab", "abcdefgh åé日😀"):
            for edits in (0, 1, 3, n // 3):
                a = [rng.choice(letters) for _ in range(n)]
                b = list(a)
                for _ in range(edits):
                    k = rng.randrange(len(b) + 1)
                    b[k : k + rng.randrange(2)] = [rng.choice(letters) for _ in range(rng.randrange(2))]
                yield "".join(a), "".join(b)
                yield "".join(a), "".join(rng.choice(letters) for _ in range(rng.randrange(150)))


def test_equals_the_table():
    left, right = zip(*pairs())
    want = [plain(a, b) for a, b in zip(left, right)]
    assert distances(left, right).tolist() == want
    for most in (0, 4, 20):
        assert all(g == w if w <= most else g > most for g, w in zip(distances(left, right, most).tolist(), want))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abå😀", max_size=90), st.text("abå😀", max_size=90)), max_size=6))
def test_any_pairs(some):
    assert distances([a for a, _ in some], [b for _, b in some]).tolist() == [plain(a, b) for a, b in some]


def test_column(spark):
    rows = [("kitten", "sitting"), (None, "a"), ("a", None), ("", "å😀"), ("same", "same")]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    assert [r[0] for r in df.select(edit_distance("a", "b")).collect()] == [3, None, None, 2, 0]
    assert df.limit(0).select(edit_distance("a", "b")).collect() == []

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from heronry.llm import ranked_search
from heronry.llm.queries import ORACLE_SQL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    """{item: [(rank, doc_id, score)]} by the definition, for every document."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in items:
        own = set(terms(text))
        df = {t: sum(1 for _, c in held if t in c) for t in own}
        scores = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def some(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def tables(seed=1, n=400):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)] + ["Åse", "åse", "x1"]
    docs = [(i, some(rng, rng.choice([3, 20, 200]), words)) for i in range(n)]
    items = [(i, some(rng, rng.choice([1, 5, 40]), words)) for i in range(12)]
    for k in range(60):  # copies of an item's text, more than the top holds: ties
        docs.append((1000 + k % 40, items[3][1]))
    docs += [(None, items[3][1]), (None, None), (5, ""), (6, "-- !!"), (7, "W1 w1 É é w2_w3"), (8, "solo " * 30_000)]
    items += [(12, None), (13, "... "), (13, "solo W1 unheard"), (13, "solo W1 unheard"), (None, "w1 w2"), (14, "nowhere")]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = tables()
    left = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, item_id int, score int, terms string").repartition(5)
    right = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in ranked_search.ranked_search(left, right, 50).collect()), key=str)
    assert got == plain(docs, items, 50)


def test_several_passes_and_merges(spark, monkeypatch):
    docs, items = tables(2, 150)
    monkeypatch.setattr(ranked_search, "TERMS", 60)
    monkeypatch.setattr(ranked_search, "MERGE", 1)
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    right = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in ranked_search.ranked_search(left, right, 7).collect()), key=str)
    assert got == plain(docs, items, 7)


def test_stops_when_bounds_prove_the_top(monkeypatch):
    """Small steps: the work ends early, and what is found holds every document that belongs to the top k."""
    monkeypatch.setattr(ranked_search, "STEP", 32)
    rng = np.random.default_rng(4)
    early = 0
    for trial in range(60):
        n_docs, n_terms, k = 300, 40, 10
        held = rng.random((n_docs, n_terms)) < rng.choice([0.05, 0.3, 0.9])
        impact = rng.integers(1, rng.choice([4, 10_000]), (n_docs, n_terms)) * rng.integers(1, 300, n_terms) ** 2
        if trial % 2:
            held[:k], impact[:k] = True, impact[:k] * 30
        doc, term = np.nonzero(held)
        block = ranked_search.Block(held.sum(1), term, impact[doc, term], n_terms)
        wanted = rng.choice(n_terms, rng.integers(1, 20), replace=False)
        want = np.where(held, impact, 0)[:, wanted].sum(1)
        for floor in (0, int(np.sort(want)[-3])):
            docs, scores, added = block.search(wanted, k, floor)
            assert (want[docs] == scores).all()
            least = max(floor, np.sort(want)[-k], 1)
            assert set(np.flatnonzero(want >= least)) <= set(docs.tolist())
            early += added < held[:, wanted].sum()
    assert early > 20


def test_blocks_of_a_task(monkeypatch):
    """Blocks of a few documents with bounds carried over give what one block gives."""

    class Shared:
        pass

    rng = np.random.default_rng(5)
    import pyarrow as pa

    rows = [(i % 90, int(rng.integers(5, 50)), sorted(rng.choice(30, rng.integers(1, 12), replace=False).tolist())) for i in range(300)]
    times = [[int(x) for x in rng.integers(1, 5, len(t))] for _, _, t in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in rows]), pa.array([n for _, n, _ in rows]), pa.array([t for _, _, t in rows], pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "times"])
    shared = Shared()
    shared.value = ([(q, np.sort(rng.choice(30, 6, replace=False))) for q in range(9)], rng.integers(0, 5000, 30), 300, 6000)
    slices = lambda n: iter([batch.slice(i, n) for i in range(0, 300, n)])
    tell = lambda found: [b.to_pylist() for b in found]
    whole = tell(ranked_search._search(shared, 20)(slices(300)))
    monkeypatch.setattr(ranked_search, "POSTINGS", 100)
    monkeypatch.setattr(ranked_search, "STEP", 16)
    assert tell(ranked_search._search(shared, 20)(slices(7))) == whole


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.ranked_search(docs.limit(0), items).count() == 0
    out = ranked_search.ranked_search(docs, items.limit(0))
    assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_large_totals():
    n = np.array([10**9, 3])
    got = ranked_search.impacts(np.array([7, 7]), np.array([2, 1]), n, 10**12, 10**15)
    want = [7 * (2 * 10**9 // (2000 + 20 * (50 + 50 * x * 10**12 // 10**15))) if t == 2 else 7 * (10**9 // (1000 + 20 * (50 + 50 * x * 10**12 // 10**15))) for x, t in ((10**9, 2), (3, 1))]
    assert got.tolist() == want


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    theirs = con.sql(ORACLE_SQL["op12_ranked_search"])
    ours = ranked_search.op12_ranked_search(spark, sf_dir).select(*theirs.columns)
    assert sorted(map(tuple, ours.collect())) == sorted(theirs.fetchall())

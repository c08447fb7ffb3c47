import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.llm import decontaminate as dc
from heronry.llm import langid, lm_score


def words_of(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


SYLLABLES = {"aa": ["ka", "ko", "ti", "ru"], "bb": ["sch", "ein", "ung", "ver"], "cc": ["çé", "eau", "ment", "ou"]}


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(0)
    n, k = 137, 3
    e, t, s = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    first = np.zeros(n, bool)
    first[[0, 5, 6, 70]] = True
    alpha, beta = np.zeros((n, k)), np.ones((n, k))
    for i in range(n):
        alpha[i] = (np.exp(s) if first[i] else alpha[i - 1] @ np.exp(t)) * np.exp(e[i])
        alpha[i] /= alpha[i].sum()
    for i in range(n - 2, -1, -1):
        beta[i] = 1 if first[i + 1] else np.exp(t) @ (np.exp(e[i + 1]) * beta[i + 1])
        beta[i] /= beta[i].sum()
    want = alpha * beta
    want /= want.sum(1, keepdims=True)
    got, forward = langid.marginals(e, first, t, s, filtered=True)
    assert np.allclose(got, want) and np.allclose(forward, alpha)
    assert langid.marginals(e[:0], first[:0], t, s).shape == (0, 3)


def test_language_of_documents(spark):
    rng = random.Random(1)
    rows = [(i, words_of(rng, SYLLABLES[lang], 60), lang, lang) for i in range(150) for lang in [sorted(SYLLABLES)[i % 3]]]
    rows += [(1000, None, "aa", "x"), (1001, "", "aa", "x"), (1002, "12 34 !!", "aa", "x"), (None, rows[0][1], None, "x"), (1003, words_of(rng, SYLLABLES["bb"], 30000), None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(docs)
    out = {r["doc_id"]: r for r in langid.identify(docs.select("doc_id", "text", "lang"), model).collect()}
    assert all(out[i]["lang_pred"] == lang and 0 <= out[i]["score"] <= 1 for i, _, lang, _ in rows[:150])
    assert [out[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1003]["lang_pred"] == "bb" and out[None]["lang_pred"] == "aa"
    of, p, _, _ = model.words([words_of(rng, SYLLABLES["aa"], 30) + " " + words_of(rng, SYLLABLES["cc"], 30)])
    best = p.argmax(1)
    assert (best[:28] == 0).all() and (best[32:] == 2).all()


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "ord", None)], "doc_id long, text string, lang string")
    assert langid.fit(docs) is None
    assert [tuple(r) for r in langid.identify(docs.select("doc_id", "text"), None).collect()] == [(1, "ord", "und", 0.0)]
    assert langid.identify(docs.select("doc_id", "text").where("false"), None).count() == 0


def plain_scores(texts, order):
    """Stupid backoff where a text's own n-grams don't count, by definition."""
    w = [(t or "").encode().lower().split() for t in texts]
    grams = [Counter(tuple(x[i : i + n]) for n in range(1, order + 1) for i in range(len(x) - n + 1)) for x in w]
    starts = [Counter(tuple(x[i : i + n]) for n in range(1, order) for i in range(len(x) - n)) for x in w]
    all_grams, all_starts = sum(grams, Counter()), sum(starts, Counter())
    total = sum(map(len, w))
    out = []
    for x, g, st in zip(w, grams, starts):
        score = 0.0
        for i in range(len(x)):
            most = min(order, i + 1)
            for n in range(most, 0, -1):
                gram = tuple(x[i - n + 1 : i + 1])
                c = all_grams[gram] - g[gram]
                if n == 1:
                    value = max(c, 1) / max(total - len(x), 1)
                elif c > 0:
                    value = c / max(all_starts[gram[:-1]] - st[gram[:-1]], 1)
                else:
                    continue
                score += math.log(value) + (most - n) * math.log(0.4)
                break
        out.append((len(x), score))
    return out


def score_texts():
    rng = random.Random(2)
    texts = [None, "", " \n", "Ensam", "ensam", "a a a a a"] + [words_of(rng, SYLLABLES["aa"] + ["the "] * 3, rng.randint(1, 80)) for _ in range(120)]
    return texts + [texts[20]] * 5


@pytest.mark.parametrize("hot,known,part", [(1e-3, 2e-6, 3_000_000), (0.02, 0.01, 500), (0.9, 0.9, 200), (0.02, 0.002, 12), (0.5, 0.001, 9)])
def test_scores_equal_brute_force(spark, monkeypatch, hot, known, part):
    monkeypatch.setattr(lm_score, "PART", part)
    texts = score_texts()
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, own int").repartition(3)
    got = {r["doc_id"]: r for r in lm_score.lm_scores(docs, hot_share=hot, known_share=known).collect()}
    for i, (n, s) in enumerate(plain_scores(texts, 2)):
        assert got[i]["n_words"] == n and math.isclose(got[i]["log_score"], s, rel_tol=1e-9, abs_tol=1e-9)
        assert (got[i]["mean_score"] is None) == (n == 0)
    assert lm_score.lm_scores(docs.where("false")).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_of_any_order(spark, order):
    texts = score_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["log_score"] for r in lm_score.scores_by_joins(docs, order).collect()}
    for i, (_, s) in enumerate(plain_scores(texts, order)):
        assert math.isclose(got[i], s, rel_tol=1e-9, abs_tol=1e-9)


def plain_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 25))
        score, start, end = dc.align(a.astype(np.uint64), b.astype(np.uint64))
        assert score == plain_align(a, b)
        assert score == (plain_align(a, b[start:end]) if score else 0)


def test_leaks(spark):
    rng = random.Random(4)
    item = [f"ord{i}" for i in range(40)]
    other = [f"annat{i}" for i in range(12)]
    noise = lambda n: " ".join(f"brus{rng.randrange(10**6)}" for _ in range(n))
    edited = list(item)
    for k in (3, 11, 20, 28, 36):
        edited[k] = "ny"
    del edited[15]
    docs = [
        (1, noise(50) + " " + " ".join(item).upper() + " " + noise(50)), (2, noise(300) + " " + " ".join(edited)), (3, noise(100)), (4, None), (5, ""),
        (6, " ".join(item[:8]) + noise(80)), (7, ", ".join(other)), (8, noise(20000) + " " + " ".join(item)), (2, noise(3) + " " + " ".join(edited)),
    ]
    bench = [(10, " ".join(item)), (11, " ".join(other)), (12, None), (13, ""), (14, "för kort"), (15, " ".join(other))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x"))
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = [(1, 10), (2, 10), (2, 10), (7, 11), (7, 15), (8, 10)]
    for slice_words in (dc.SLICE, 30):
        got = sorted((r["doc_id"], r["item_id"]) for r in dc.leaks(d, b, slice_words=slice_words).collect())
        assert got == want
    place = [r for r in dc.leaks(d, b).collect() if r["doc_id"] == 1][0]
    assert (place["start_word"], place["end_word"], place["score"]) == (50, 90, 1.0)
    kept = dc.decontaminate(d, b)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    mixed = spark.createDataFrame([(None, docs[0][1]), (None, "ren text"), (7, docs[6][1]), (7, "ren också"), (8, None)], "doc_id long, text string")
    assert sorted(r["text"] or "" for r in dc.decontaminate(mixed, b, slice_words=30).collect()) == ["", "ren också", "ren text"]
    assert dc.leaks(d, b.where("false")).count() == 0 and dc.leaks(d.where("false"), b).count() == 0


def test_seeds_are_the_rarest():
    assert dc.choose_seeds(np.array([5, 1, 5, 5, 5, 0, 9])).tolist() == [1, 5] and dc.choose_seeds(np.array([3])).tolist() == [0]


@pytest.mark.parametrize("threshold", [0.5, 0.3, 0.75])
def test_edited_copies_equal_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(dc, "FOUND", 500, raising=False)
    rng = random.Random(6)
    common = [f"c{i}" for i in range(12)]
    items = [[rng.choice(common) if rng.random() < 0.5 else f"ord{k}x{i}" for i in range(n)] for k, n in enumerate((5, 6, 10, 17, 40, 40))]
    noise = lambda n: [rng.choice(common) if rng.random() < 0.5 else f"brus{rng.randrange(300)}" for _ in range(n)]
    docs = []
    for item in items:
        for every in (1, 2, 3, 4, 5, 6, 10):
            for kind in ("replace", "insert", "delete"):
                copy = []
                for i, w in enumerate(item, 1):
                    copy += [w] if i % every else ["ny"] if kind == "replace" else [w, "ny"] if kind == "insert" else []
                docs.append(noise(rng.randrange(60)) + copy + noise(rng.randrange(60)))
    want = {}
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            share = int(plain_align(item, doc)) / (2 * len(item))
            if share >= threshold:
                want[d, i] = share
    got = dc.leaks(
        spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(docs)], "doc_id long, text string").repartition(4),
        spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"), threshold=threshold,
    ).collect()
    assert len(want) > 60 and {(r["doc_id"], r["item_id"]): r["score"] for r in got} == want and len(got) == len(want)
    assert all(int(plain_align(items[r["item_id"]], docs[r["doc_id"]][r["start_word"] : r["end_word"]])) == round(r["score"] * 2 * len(items[r["item_id"]])) for r in got)


def test_language_id_on_held_out_documents(spark):
    """Accuracy on documents that training never saw."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    found = langid.op10_language_id(spark, folder).where("held_out and lang_pred != 'und'").join(docs.where("lang is not null and length(text) > 40"), "doc_id")
    n, right = found.selectExpr("count(*)", "count_if(lang = lang_pred)").first()
    assert n > 100 and right >= 0.97 * n


def test_passages_over_the_whole_text(spark):
    short, long = "kort text " * 20, " ".join(f"ord{k}" for k in range(9000))
    got = [r[0] for r in spark.createDataFrame([(short,), (long,), ("",), ("x" * 4000,)], "text string").coalesce(1).select(langid.passages("text")).collect()]
    assert got[0] == short and got[2] == "" and len(got[3]) <= langid.SAMPLE_CHARS + langid.PASSAGES
    words = got[1].split()
    assert set(words) <= set(long.split()) and words[0] == "ord0" and words[-1] in ("ord8998", "ord8999") and len(got[1]) <= langid.SAMPLE_CHARS + langid.PASSAGES
    numbers = [int(w[3:]) for w in words]
    assert numbers == sorted(numbers) and sum(3000 < n < 6000 for n in numbers) > 20


def test_one_language(spark):
    """With one label there is nothing to learn, but what training met is known."""
    rows = [(k, f"the house number {k} and the old garden by the river", "en") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(docs.select("text").limit(3), langid.fit(docs), known="known").collect()
    assert all(r["lang_pred"] == "en" and r["known"] > 0.9 for r in out)


def test_short_items_as_whole_runs(spark):
    """Items of one to four words are found where all their words follow one another, and nowhere else; filters pass them."""
    rng = random.Random(12)
    words = ["alfa", "beta", "gamma", "delta", "epsilon"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 8, 200]))) for _ in range(60)] + [None, "ALFA, beta!"]
    items = [(1, "delta"), (2, "alfa beta"), (3, "beta beta gamma"), (4, "gamma alfa delta alfa"), (5, "saknas"), (6, "alfa saknas"), (7, "Alfa  beta")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    holds = lambda t, i: any(t[k : k + len(i)] == i for k in range(len(t) - len(i) + 1))
    want = sorted((d, i) for d, t in enumerate(texts) for i, x in items if holds(split(t), split(x)))
    got = dc.leaks(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == want and len(want) > 60 and all(r["score"] == 1.0 for r in got)
    assert dc.decontaminate(docs, bench).count() == len(texts)

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from heronry.llm import suffix_dedup as sd


def brute(texts, length, keep):
    """(bytes, removed, runs, digest) of every text, and the bytes that stay."""
    data = [(t or "").encode() for t in texts]
    count, seen, out = Counter(), set(), []
    for d in data:
        count.update(d[s : s + length] for s in range(len(d) - length + 1))
    for d in data:
        cover = bytearray(len(d))
        for s in range(len(d) - length + 1):
            w = d[s : s + length]
            if (count[w] > 1) if keep == "none" else (w in seen):
                cover[s : s + length] = b"\1" * length
            seen.add(w)
        left = bytes(x for x, c in zip(d, cover) if not c)
        out.append((len(d), sum(cover), sum(1 for i in range(len(d)) if cover[i] and not (i and cover[i - 1])), hashlib.sha256(left).hexdigest()))
    return out


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgåäö") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [line(60) for _ in range(4)]
    texts = [None, "", "kort", "a" * 700, "ab" * 300, "x" * 199, "y" * 200, "y" * 200]
    for _ in range(40):
        texts.append(" ".join(rng.choice([line(rng.randint(5, 60)), rng.choice(shared)]) for _ in range(rng.randint(1, 4))))
    texts += [texts[10], texts[10], texts[11] + " slut", line(4000) + shared[0] + line(10) + shared[0]]
    edited = list(shared[1] + line(50))
    for _ in range(20):
        e = list(edited)
        e[rng.randrange(len(e))] = "#"
        texts.append("".join(e))
    return texts


@pytest.mark.parametrize("keep,many", [("none", 4096), ("first", 4096), ("none", 2), ("first", 2)])
def test_equals_brute_force(spark, monkeypatch, keep, many):
    monkeypatch.setattr(sd, "MANY", many)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, tag int")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.repeated_strings(docs, keep=keep).collect()}
    want = brute(texts, 200, keep)
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []


@pytest.mark.parametrize("keep", ["none", "first"])
def test_long_texts_go_in_pieces(spark, monkeypatch, keep):
    monkeypatch.setattr(sd, "CHUNK", 700)
    texts = corpus()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.repeated_strings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=keep).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200, keep)


def test_many_texts_of_one_or_no_doc_id(spark):
    rng = random.Random(4)
    shared = " ".join(f"ord{rng.randrange(10**6)}" for _ in range(30))
    texts = [f"{rng.randrange(10**12)} " * 16 + (shared if k % 3 == 0 else "") for k in range(9000)]
    for doc_id in (None, 7):
        docs = spark.createDataFrame([(doc_id, t, str(k)) for k, t in enumerate(texts)], "doc_id long, text string, more_tag string")
        got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.repeated_strings(docs).collect())
        assert got == sorted(brute(texts, 200, "none"))
        kept = {r["more_tag"]: r["text"] for r in sd.dedup_substrings(docs).collect()}
        assert len(kept) == 9000 and sum(shared in t for t in kept.values()) == 1 and all(kept[str(k)] == t for k, t in enumerate(texts) if k % 3)


@pytest.mark.parametrize("length", [12, 400])
def test_other_lengths(spark, length):
    texts = corpus()[:40] + ["z" * 900 + "q" * 5]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.repeated_strings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length, "none")


def test_columns_and_repeats(spark):
    t = "åäö " * 80
    docs = spark.createDataFrame([(1, t, "en", 5), (1, t, "en", 5), (2, t + "mer", "sv", 6), (None, None, None, None)], "doc_id long, text string, rows string, n_chars int")
    out = sd.dedup_substrings(docs)
    assert out.schema == docs.schema or out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == 4 and [r["text"] for r in rows if r["doc_id"] is None] == [None]
    assert sorted(r["n_spans"] for r in sd.repeated_strings(docs).where("doc_id = 1").collect()) == [1, 1]
    assert sd.repeated_strings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_that_repeat_often(spark, doc_id):
    """Thousands of rows equal in doc_id and text, beside near copies of theirs, end in linear time."""
    rng = random.Random(6)
    long = " ".join(f"ord{rng.randrange(10**5)}" for _ in range(1800))
    near = long[:8000] + "#" + long[8001:]
    texts = [long] * 3000 + [near, "kort", "kort", long[300:900], "x" * 400]
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.repeated_strings(spark.createDataFrame([(doc_id, t) for t in texts], "doc_id long, text string").repartition(4)).collect())
    few = brute(texts[2998:], 200, "none")  # two copies, or three thousand, remove alike
    assert got == sorted([few[0]] * 2998 + few)


def test_suffix_order():
    texts = [b"banana banana", b"", b"anan"]
    text, start, cls = sd.suffix_classes(texts, 4)
    parts = [texts[t][s : s + 4] for t, s in zip(text, start)]
    assert parts == sorted(parts) and len(parts) == 11
    early, late = sd.earlier_and_later(cls)
    seen = set()
    for t, s in sorted(zip(text.tolist(), start.tolist())):
        k = list(zip(text.tolist(), start.tolist())).index((t, s))
        assert early[k] == (texts[t][s : s + 4] in seen)
        seen.add(texts[t][s : s + 4])
    assert np.array_equal(early | late, [parts.count(p) > 1 for p in parts])

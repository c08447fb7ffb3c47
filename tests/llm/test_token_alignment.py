import hashlib
import random
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heronry.llm import token_alignment as alignment

A, B = f"{alignment.TOKENIZERS}/byte_bpe_50k.json", f"{alignment.TOKENIZERS}/piece_bpe_32k.model"
TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a b", "a  b", "don't we'll 'Tis", "line one\nline two\r\n\tthree  four ", "<|endoftext|> and <|endoftext|>", "<s> </s> <unk> <0x41> <0x0A>",
    "x▁y ▁ z", "under▁score here", "tal 1234567 8 9,5%", "åäö é ñ ÅÄÖ", "日本語 の テキスト です 。", "emoji 😀 👩‍👩‍👧 end", "nbsp inside   x", "\u0085next   line   x", "é combining ​ zero ﻿ bom",
    "tab\x1f unit \x1c sep \x00 nul", "ÿ \x7f \x80 \x9f", "soft­hyphen ¡hola! « x » ×÷", "мир и труд", "مرحبا بالعالم", "a" * 3000, "word " * 400, "- - -- --- — …", "http://x.y/z?q=1&r=2 (see: [this])",
]


@pytest.fixture(scope="module")
def sides():
    return alignment.sides(A, B)


def spans(ids, data):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(data[i]), i))
        at += len(data[i])
    return out


def plain(texts, a, b):
    """By the definitions, over whole texts: every pair of tokens is compared."""
    rows, docs = [], Counter()
    for text in texts:
        x = y = []
        if text:
            (x,), (y,) = a.encode([text]), b.encode([text])
            if not b"".join(a.data[i] for i in x) == (" " + text).encode() == b"".join(b.data[i] for i in y):
                x = y = []
        x, y = spans(x, a.data), spans(y, b.data)
        links = Counter((i, j) for lo, hi, i in x for le, he, j in y if lo < he and le < hi)
        docs.update(set(links))
        cuts = sorted({hi for _, hi, _ in x} & {hi for _, hi, _ in y})
        ids = lambda side, lo, hi: ",".join(str(i) for start, end, i in side if lo <= start and end <= hi)
        told = ";".join(f"{ids(x, lo, hi)}|{ids(y, lo, hi)}" for lo, hi in zip([0, *cuts], cuts))
        rows.append((len(x), len(y), len(cuts), sum(links.values()), links, hashlib.sha256(told.encode()).hexdigest() if x else ""))
    top = Counter()
    for (i, _), n in docs.items():
        top[i] = max(top[i], n)
    return [(*r[:4], sum(n for p, n in r[4].items() if docs[p] == top[p[0]]), sum(n * docs[p] for p, n in r[4].items()), r[5]) for r in rows]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def check(spark, texts, a, b):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, pairs string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_tokenizers(docs, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, a, b)


def test_equals_brute_force(spark, sides):
    rng = random.Random(6)
    words = "the and tion hon nder är också och i att straße l'eau 12 3.5 U.S. foo_bar Thorough unaligned".split()
    texts = TEXTS + TEXTS[9:12] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    check(spark, texts, *sides)


def test_shuffled_counts(spark, sides, monkeypatch):
    monkeypatch.setattr(alignment, "BROADCAST", 0)
    check(spark, TEXTS, *sides)


def test_real_texts(spark, sf_dir, sides):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, sorted(texts, key=lambda t: len(t or ""))[:120], *sides)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab  ''ls1.,<|>\n\t \u0085 \x1c\x00▁éß日😀́\u00ad", "ll ", " the", "ation", "  "]), max_size=40).map("".join))
def test_stretches_give_the_texts_tokens(text):
    """Tokens of a text are those of its stretches, one after the other, for both tokenizers."""
    for side in alignment.sides(A, B):
        assert side.parts
        assert side.encode([text])[0] == [i for part in side.encode(alignment.PARTS.split(text)) for i in part]


def test_rows_and_empty_table(spark, sides):
    schema = "doc_id long, text string"
    rows = [(None, "same text"), (None, "same text"), (7, "same text"), (7, "other"), (7, None)]
    got = sorted(tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in alignment.align_tokenizers(spark.createDataFrame(rows, schema), A, B).fillna(-1).collect())
    assert got == sorted((-1 if i is None else i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows], *sides)))
    assert alignment.align_tokenizers(spark.createDataFrame([], schema), A, B).count() == 0


def test_texts_at_once_or_apart(sides, monkeypatch):
    """Texts aligned at once, apart, in small slices, or with nothing kept give the same rows."""
    texts = [t for t in TEXTS if t] + [None, ""]
    whole = alignment.Aligner(duckdb.connect(config={"threads": 1}), *sides).align(texts)
    for slice_, kept in ((4096, 10**6), (3, 10**6), (7, 0)):
        monkeypatch.setattr(alignment, "SLICE", slice_)
        monkeypatch.setattr(alignment, "KEPT", kept)
        aligner = alignment.Aligner(duckdb.connect(config={"threads": 1}), *sides)
        alone = [aligner.align([t]) for t in texts]
        for c in (*alignment.COUNTS, "groups_sha256"):
            assert list(whole[c]) == [x[c][0] for x in alone]
        assert whole["pairs"].tolist() == [p for x in alone for p in x["pairs"].tolist()]


def test_query(spark, sf_dir):
    from heronry.llm.queries import QUERIES

    out = QUERIES["op13_token_alignment"](spark, sf_dir)
    assert out.columns == ["doc_id", *COLUMNS] and out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()

import random
import re

import pytest

from heronry.llm import repetition
from heronry.llm.queries import ORACLE_SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The counts and the verdict by their definitions."""
    text = text or ""
    words = WORD.findall(text)

    def covered(n):
        where = {}
        for i in range(len(words) - n + 1):
            where.setdefault(tuple(words[i : i + n]), []).append(i)
        return {i + k for at in where.values() if len(at) > 1 for i in at for k in range(n)}

    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    chars = {n: sum(len(words[i]) for i in covered(n)) for n in repetition.LIMITS}
    total, repeats = sum(map(len, words)), len(covered(8))
    failed = len(words) < 20 or 100 * repeats > 30 * len(words)
    kept = not failed and sum(map(len, again)) <= 0.3 * sum(map(len, lines)) and all(chars[n] <= most * total for n, most in repetition.LIMITS.items())
    return [len(words), total, len(re.findall(r"[#*$%&|<>]", text)), len(again), repeats, failed, kept, *chars.values()]


def texts():
    rng = random.Random(3)
    some = lambda n, k: [f"w{rng.randrange(k)}" for _ in range(n)]
    phrase = some(12, 500)
    out = [None, "", " \t\n\r", "one", "a b c d e " * 40, "\n".join(["same line here"] * 30), "\n" * 200 + "x", "# * $ % & | < > #x", "å ä ö é " * 9, "x" * 5000]
    out += [" ".join(some(n, k)) for n in (1, 7, 8, 9, 19, 20, 21, 300) for k in (2, 9, 900)]
    out += [" ".join(some(40, 900) + phrase + some(m, 900) + phrase) for m in (0, 30, 60)]
    out += ["\n".join([" ".join(some(9, 900)) for _ in range(20)] + ["shared line å"] * k) for k in (0, 1, 2, 9, 30)]
    out += [" ".join(some(30, 50)) + "\x0b" + " ".join(some(30, 50)) + "\x0c\x00 \x1c ", "Case case CASE " * 10]
    return out


def test_equals_brute_force(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts())] + [(None, "a b", 2, None), (0, "twice", 3, "y"), (0, "twice", 3, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string").repartition(3)
    got = sorted(([r["doc_id"], *(r[c] for c in [*repetition.COUNTS, "base_failed", "kept"]), *(r[f"chars_{n}"] for n in repetition.LIMITS)] for r in repetition.repetition(docs).collect()), key=str)
    assert got == sorted(([i, *plain(t)] for i, t, *_ in rows), key=str)


def test_long_text_and_batches(monkeypatch):
    some = [t or "" for t in texts()] + ["word%d " % (i % 977) * 3 for i in range(50)] + [" ".join(f"n{i % 40001}" for i in range(120_000))]
    whole = repetition.measure([t.encode() for t in some])
    monkeypatch.setattr("heronry.llm.words.BLOCK", 256)
    blocks = repetition.measure([t.encode() for t in some])
    for name, values in whole.items():
        assert values.tolist() == blocks[name].tolist()
    assert whole["n_repeat_words"][-1] == 120_000 and whole["n_words"][-1] == 120_000


def test_empty_table(spark):
    out = repetition.repetition(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns[:2] == ["doc_id", "n_words"]


def test_clean_documents_stay(spark, sf_dir):
    """What the method drops beyond the base rule holds much repeated text; of documents labelled good it drops none."""
    found = repetition.op11_quality_rules(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    assert found.where("quality = 1 and toxic = 0 and not base_failed and not kept").count() == 0
    assert found.where("kept").count() > 0


@pytest.mark.parametrize("name", ["op11_quality_rules"])
def test_sql(spark, sf_dir, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    theirs = con.sql(ORACLE_SQL[name])
    ours = entry.queries()[name](spark, sf_dir).select(*theirs.columns)
    assert sorted(map(tuple, ours.collect())) == sorted(theirs.fetchall())

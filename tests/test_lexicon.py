import random
import re

import pytest
from pyspark.sql import functions as F

from heronry.functions import phonemes
from heronry.functions.text import IS_WORD, SENTENCE, TOKEN


def plain(text, lexicon):
    out = []
    for sentence in re.findall(SENTENCE, text or ""):
        said, before = "", False
        for t in re.findall(TOKEN, sentence):
            word = bool(re.fullmatch(IS_WORD, t))
            said += (" " if word and before else "") + (lexicon.get(t.lower(), "") if word else t)
            before = word
        out.append(said)
    return " ".join(s for s in out if s)


TEXTS = [None, "", "   ", "12 34", "Hej på dig! Va? Ja...", "hej, hej; HEJ okänd.", "okänd. okänd okänd. hej", "a-b c:d", "!?", "Hej" * 3, "hej 3 dig\nrad två. på"]


@pytest.mark.parametrize("most", [phonemes.LEXICON_BYTES, 0])
def test_phonemise(spark, monkeypatch, most):
    """By a broadcast table, and by a join beyond its bound."""
    monkeypatch.setattr(phonemes, "LEXICON_BYTES", most)
    rng = random.Random(8)
    lexicon = {"hej": "hɛj", "på": "poː", "dig": "dɛj", "va": "vɑ", "ja": "jɑː", "a": "ɑ", "två": "tvoː", "tom": ""}
    words = [*lexicon, "okänd", ",", ".", "!", "7"]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randrange(80))) for _ in range(40)]
    rows = [(i % 45, t) for i, t in enumerate(texts)] + [(None, "hej på"), (None, "dig va")]
    lex = spark.createDataFrame([(w, [i]) for w, i in lexicon.items()], "word string, ipa array<string>")
    got = phonemes.phonemise(spark.createDataFrame(rows, "id int, text string").repartition(3), lex).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, plain(t, lexicon)) for i, t in rows), key=str)


def test_empty_lexicon_and_texts(spark):
    lex = spark.createDataFrame([], "word string, ipa array<string>")
    docs = spark.createDataFrame([(1, "hej, du")], "id int, text string")
    assert [r["phonemes"] for r in phonemes.phonemise(docs, lex).collect()] == [","]
    assert phonemes.phonemise(docs.limit(0), lex).count() == 0


def test_large_lexicon(spark):
    """A lexicon of 300,000 words is looked up by a hash table."""
    name = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    lex = spark.range(300_000).select(F.concat(F.lit("w"), name).alias("word"), F.array(F.reverse(name)).alias("ipa"))
    docs = spark.range(200).select("id", F.concat_ws(" ", *(F.concat(F.lit("W"), F.translate(((F.col("id") + k) * 1499).cast("string"), "0123456789", "abcdefghij")) for k in range(9))).alias("text"))
    got = {r["id"]: r["phonemes"] for r in phonemes.phonemise(docs, lex).collect()}
    letters = str.maketrans("0123456789", "abcdefghij")
    assert got == {i: " ".join("" if (i + k) * 1499 >= 300_000 else str((i + k) * 1499).translate(letters)[::-1] for k in range(9)) for i in range(200)}


def test_a_large_lexicon_moves_whole_texts(spark, monkeypatch):
    """What goes back to a text with its words is the text, not its tokens; repeated words and null keys do no harm."""
    from heronry.functions import phonemes

    monkeypatch.setattr(phonemes, "PLAN_BYTES", 0)
    df = spark.createDataFrame([(1, "ett två. Ett, tre"), (1, "två ett"), (None, "tre tre!"), (2, None)], "id long, text string")
    lex = spark.createDataFrame([("ett", ["e", "t"]), ("två", ["t", "v"]), ("tre", ["r"])], "word string, ipa array<string>")
    got = phonemes.phonemise(df, lex, "id", "text")
    assert sorted((str(r[0]), r[1]) for r in got.collect()) == [("1", "et tv. et,r"), ("1", "tv et"), ("2", ""), ("None", "r r!")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[k" not in plan.replace("ObjectHashAggregate", "Object")

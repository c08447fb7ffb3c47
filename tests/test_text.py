import pytest
from pyspark.sql import functions as F

from heronry.functions import phonemes, swedish, text
from heronry.operators import folds


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).coalesce(1).select(column).collect()]


def test_number_words(spark):
    ns = [0, 21, 42, 100, 123, 1000, 1001, 1250, 21000, 999999, 1000000, 2500000, -5, 10**12]
    assert values(spark, ns, swedish.int_words("x"), "x long") == [
        "noll", "tjugoett", "fyrtiotvå", "etthundra", "etthundratjugotre", "ettusen", "ettusen ett", "ettusen tvåhundrafemtio", "tjugoetttusen",
        "niohundranittioniotusen niohundranittionio", "en miljon", "två miljoner femhundratusen", "minus fem", None,
    ]
    assert values(spark, [1, 21, 30, 31, 32], swedish.ordinal_words("x"), "x int") == ["första", "tjugoförsta", "trettionde", "trettioförsta", "trettiotvå"]
    assert values(spark, [1100, 1999, 2000, 2026, 2100], swedish.year_words("x"), "x long") == ["elvahundra", "nittonhundranittionio", "tjugohundra", "tjugohundratjugosex", "tvåtusen etthundra"]


def test_cer(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", "x"), ("", ""), ("på", "pa")], "r string, h string").coalesce(1)
    assert [r[0] for r in df.select(text.cer("r", "h")).collect()] == [pytest.approx(1 / 3), 1.0, 0.0, 0.5]


def test_phonemes(spark):
    assert values(spark, ["aʏbʉcɵdɧeɭf-g"], phonemes.remap("x")) == ["aybɨcɜdʂelfg"]
    assert values(spark, ["banaːn", "a#b"], phonemes.encode("x", pad=False)) == [[44, 43, 56, 43, 158, 56], [43, 44]]
    assert len(phonemes.VOCABULARY) == 114 and max(phonemes.VOCABULARY.values()) < phonemes.SLOTS
    with pytest.raises(Exception, match="not in the vocabulary"):
        values(spark, ["a#b"], phonemes.encode("x", strict=True))


def test_phonemise_spacing_and_precedence(spark):
    base = spark.createDataFrame([("vi", ["s"], 0), ("usb", ["u"], 1), ("usb", ["ˌɨː", "ˌɛs", "ˈbeː"], 2)], "word string, ipa array<string>, seq long")
    custom = spark.createDataFrame([("Vi", ["v", "ˈiː"], 0), ("godnatt", ["ɡʊn", "ˈat"], 1)], "word string, ipa array<string>, seq long")
    lex = phonemes.lexicon_with_precedence(base, custom)
    df = spark.createDataFrame([(1, "Godnatt, vi"), (2, "vi usb"), (3, "okänt 42"), (4, None)], "id long, text string")
    got = {r["id"]: r["phonemes"] for r in phonemes.phonemise(df, lex).collect()}
    assert got == {1: "ɡʊnˈat,vˈiː", 2: "vˈiː ˌɨːˌɛsˈbeː", 3: "", 4: ""}


def reference_split(t, longest=150, short=25, least=10):
    """The packing rules, step by step."""
    import re

    if len(t) <= longest:
        return [t]
    sentences = [p.strip() for p in re.split(r"(?<=[.!?…])\s+", t) if p.strip()]
    groups = []
    for s in sentences:
        joined = f"{groups[-1]} {s}" if groups else ""
        if groups and min(len(groups[-1]), len(s)) < short and len(joined) <= longest:
            groups[-1] = joined
        else:
            groups.append(s)
    result = []
    for g in groups:
        if len(g) <= longest:
            result += [g] * (len(g) >= least)
            continue
        held = ""
        for clause in re.split(r"(?<=[,;:])\s+", g):
            if len(held) + 1 + len(clause) <= longest:
                held = f"{held} {clause}".strip()
                continue
            result += [held] * (len(held) >= least)
            held = clause
        result += [held] * (least <= len(held) <= longest)
    return result


def test_split_line(spark):
    import random

    rng = random.Random(3)
    rows = ["kort", "x" * 151, "a" * 160 + ", b"]
    for _ in range(150):
        rows.append("".join(rng.choice(["ord ", "längre ord ", "slut. ", "led, ", "hej! ", "x" * 40 + " ", "y" * 160 + "; "]) for _ in range(rng.randint(1, 30))).strip())
    got = values(spark, rows, folds.split_line("x"))
    assert got == [reference_split(r) for r in rows]


def test_split_line_keeps_digits(spark):
    """A piece that begins or ends with its own place's digit."""
    rows = [" ".join(f"{k}{k} Det här är en mening av vanlig längd{k}{k}." for k in range(12)), " ".join(f"{k} och {k}." for k in range(40)), "y" * 140 + ". " + " ".join(f"{k}23" * 9 + "?" for k in range(1, 10))]
    got = values(spark, rows, folds.split_line("x"))
    assert got == [reference_split(r) for r in rows]


def test_merge_intervals(spark):
    cases = [[(0.0, 3.0), (4.0, 9.0), (10.0, 15.0)], [(0.0, 1.0), (20.0, 30.0)], []]
    df = spark.createDataFrame([(c,) for c in cases], "xs array<struct<s:double,e:double>>").coalesce(1)
    got = [[tuple(x) for x in r[0]] for r in df.select(folds.merge_intervals("xs", 10.0, 2.0)).collect()]
    assert got == [[(0.0, 9.0), (10.0, 15.0)], [(20.0, 30.0)], []]


def test_safe_name(spark):
    assert values(spark, ["__a b//c__", "x" * 50], text.safe_name("x")) == ["a_b_c", "x" * 40]
    assert values(spark, ["wavs/000123.wav", "bad"], text.number_of_path("x")) == [123, None]
    assert values(spark, ["a b ?"], F.size(text.sentences("x"))) == [1]

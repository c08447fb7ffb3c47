"""Swedish text normalisation as Column expressions (T3-T12): numbers, dates, times and abbreviations to words.

Rules whose replacement depends on the match (a callback in most regex libraries) are done by cutting the text
into matches and the rest, transforming the matches, and joining; texts without a match skip that.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, strip

# Number words, months and abbreviations.
ONES = "noll ett två tre fyra fem sex sju åtta nio tio elva tolv tretton fjorton femton sexton sjutton arton nitton".split()
TENS = "tjugo trettio fyrtio femtio sextio sjuttio åttio nittio".split()
ORDINALS = {
    1: "första", 2: "andra", 3: "tredje", 4: "fjärde", 5: "femte", 6: "sjätte", 7: "sjunde", 8: "åttonde", 9: "nionde", 10: "tionde",
    11: "elfte", 12: "tolfte", 13: "trettonde", 14: "fjortonde", 15: "femtonde", 16: "sextonde", 17: "sjuttonde", 18: "artonde",
    19: "nittonde", 20: "tjugonde", 30: "trettionde", 31: "trettioförsta",
}
MONTHS = "januari februari mars april maj juni juli augusti september oktober november december".split()
ABBREVIATIONS = {
    "t.ex.": "till exempel", "t ex": "till exempel", "bl.a.": "bland annat", "dvs.": "det vill säga", "d.v.s.": "det vill säga",
    "osv.": "och så vidare", "o.s.v.": "och så vidare", "m.m.": "med mera", "mm.": "med mera", "ca": "cirka", "ca.": "cirka",
    "st.": "stycken", "st": "stycken", "kr": "kronor", "nr": "nummer", "nr.": "nummer", "kl.": "klockan", "kl": "klockan",
    "m.fl.": "med flera", "etc.": "et cetera", "resp.": "respektive", "inkl.": "inklusive", "exkl.": "exklusive",
}
#: Numbers from here on stay digits.
LIMIT = 10**12


def _pick(words: list[str], at: Column) -> Column:
    return F.element_at(F.split(F.lit(" ".join(words)), " "), at.cast("int") + 1)  # folded to a literal list


def _below_100(n: Column) -> Column:
    rest = n % 10
    return F.when(n < 20, _pick(ONES, n % 20)).otherwise(F.concat(_pick(TENS, F.greatest(F.floor(n / 10) - 2, F.lit(0)) % 8), F.when(rest > 0, _pick(ONES, rest)).otherwise("")))


def _below_1000(value: Column) -> Column:
    return let(value, _hundreds)


def _hundreds(n: Column) -> Column:
    h, r = F.floor(n / 100), n % 100
    return F.when(n < 100, _below_100(n)).otherwise(F.concat(_pick(ONES, h), F.lit("hundra"), F.when(r > 0, _below_100(r)).otherwise("")))


def _below_million(value: Column) -> Column:
    return let(value, _thousands)


def _thousands(n: Column) -> Column:
    k, r = F.floor(n / 1000), n % 1000
    head = F.when(k == 1, "ettusen").otherwise(F.concat(_below_1000(k), F.lit("tusen")))
    return F.when(n < 1000, _below_1000(n)).otherwise(F.concat(head, F.when(r > 0, F.concat(F.lit(" "), _below_1000(r))).otherwise("")))


def int_words(c: str | Column) -> Column:
    """T5: cardinal words below 10^12, with "minus" for negatives; null beyond."""
    return let(col(c).cast("long"), _signed)


def _signed(whole: Column) -> Column:
    n = F.abs(whole)
    m, r = F.floor(n / 1_000_000), n % 1_000_000
    head = F.when(m == 1, "en miljon").otherwise(F.concat(_below_million(m), F.lit(" miljoner")))
    words = F.when(n < 1_000_000, _below_million(n)).when(n < LIMIT, F.concat(head, F.when(r > 0, F.concat(F.lit(" "), _below_million(r))).otherwise("")))
    return F.concat(F.when(whole < 0, "minus ").otherwise(""), words)


def ordinal_words(c: str | Column) -> Column:
    """Ordinals from 1 to 31 without 32 and on, which stay cardinals."""
    return let(col(c).cast("int"), _ordinal)


def _ordinal(n: Column) -> Column:
    table = F.transform_keys(F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in ORDINALS.items()))), lambda k, _: k.cast("int"))
    return F.when((n > 20) & (n < 30), F.concat(F.lit("tjugo"), F.try_element_at(table, n - 20))).otherwise(F.coalesce(F.try_element_at(table, n), int_words(n)))


def year_words(c: str | Column) -> Column:
    """Hundreds style from 1100 to 2099, else cardinal."""
    return let(col(c).cast("long"), _year)


def _year(y: Column) -> Column:
    h, r = F.floor(y / 100), y % 100
    tail = F.when(r > 0, _below_100(r)).otherwise("")
    return F.when((y >= 1100) & (y < 2000), F.concat(_below_100(h), F.lit("hundra"), tail)).when((y >= 2000) & (y < 2100), F.concat(F.lit("tjugohundra"), tail)).otherwise(int_words(y))


def replace_matches(text: Column, pattern: str, words: Callable[[Column], Column], word_wise: bool = False) -> Column:
    """Replace matches by a function of the match; ``words`` gives null to leave one as it is.

    Matches must be of two characters at least, or whole words (``word_wise``)."""
    cut = r"(?U)\w+|\W+" if word_wise else f"(?U){pattern}|[\\s\\S]"
    hit = (lambda x: x.rlike(f"^(?U){pattern}$")) if word_wise else (lambda x: F.length(x) > 1)

    def rewrite(t: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(t, F.lit(cut), 0), lambda x: F.when(hit(x), F.coalesce(words(x), x)).otherwise(x))
        return F.when(t.rlike(f"(?U){pattern}"), F.array_join(pieces, "")).otherwise(t)

    return let(text, rewrite)


def _date(x: Column) -> Column:
    p = F.split(x, "-")
    y, m, d = (p.getItem(k).try_cast("int") for k in range(3))
    return F.when(m.between(1, 12) & d.between(1, 31), F.concat_ws(" ", ordinal_words(d), _pick(MONTHS, F.least(F.greatest(m, F.lit(1)), F.lit(12)) - 1), year_words(y)))


def _time(x: Column) -> Column:
    p = F.split(x, "[:.]")
    h, m = p.getItem(0).try_cast("int"), p.getItem(1).try_cast("int")
    return F.when(h.between(0, 23) & m.between(0, 59), F.concat(_below_100(h), F.when(m > 0, F.concat(F.lit(" och "), _below_100(m))).otherwise("")))


def _decimal(x: Column) -> Column:
    p = F.split(x, "[,.]")
    digits = F.transform(F.split(p.getItem(1), ""), lambda c: _pick(ONES, c.try_cast("int")))
    return F.concat(int_words(p.getItem(0).try_cast("long")), F.lit(" komma "), F.array_join(digits, " "))


def _integer(x: Column) -> Column:
    return int_words(F.replace(x, F.lit(" "), F.lit("")).try_cast("long"))


def expand_abbreviations(text: Column) -> Column:
    """T4: longest first, case-sensitive, only between white space, brackets and sentence marks."""
    for short in sorted(ABBREVIATIONS, key=len, reverse=True):
        text = F.regexp_replace(text, rf"(?U)(?<=[\s(]){re.escape(short)}(?=[\s.,!?)])", ABBREVIATIONS[short])
    return text


def normalise(c: str | Column) -> Column:
    """The whole rewrite, in order: abbreviations, dates, times, decimals, numbers, symbols, spacing."""
    t = expand_abbreviations(F.concat(F.lit(" "), strip(c), F.lit(" ")))
    t = replace_matches(t, r"\b\d{4}-\d{2}-\d{2}\b", _date)
    t = replace_matches(t, r"\b\d{1,2}[:.]\d{2}\b", _time)
    t = replace_matches(t, r"\b\d+[,.]\d+\b", _decimal)
    t = replace_matches(t, r"\b\d{1,3}(?: \d{3})+\b", _integer)
    t = replace_matches(t, r"\d+", _integer, word_wise=True)
    for pattern, new in (
        ("%", " procent"), ("&", " och "), ('["“”„«»]', ""), (r"[*_#@^~|<>{}\[\]\\/=+]", " "),
        (r"(?U)\s*—\s*", " — "), (r"(?U)\s+([.,!?:])", "$1"), (r"(?U)\s+", " "),
    ):
        t = F.regexp_replace(t, pattern, new)
    return F.trim(t)

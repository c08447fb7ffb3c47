"""Row gates and verdicts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

# Thresholds of the gates (fixed values; all are arguments below).
MIN_SEC, MAX_SEC, PEAK_MAX, PEAK_MIN, SPEECH_MIN = 1.0, 15.0, 0.999, 0.02, 0.3
CER_MAX, MOS_MIN, RATE, TAIL_MAX = 0.15, 2.6, (6.0, 30.0), 2.0
EVAL_CER, EVAL_MOS, COMB_LOW, SPREAD_MIN = 0.20, 2.5, 1.2, 0.8
MOS_POLYNOMIAL = (-0.06766283, 1.11546468, 0.04602535)


def in_range_or_unknown(duration: str | Column, quality: str | Column, lo: float, hi: float, least: float) -> Column:
    """Duration in range, and a quality that is unknown or high enough."""
    return col(duration).between(lo, hi) & (col(quality).isNull() | (col(quality) >= least))


def speaker_gate(duration: str | Column, mos: str | Column, least: float = 3.5, lo: float = 1.0, hi: float = 12.0) -> Column:
    """Both must be known."""
    return (col(mos) >= least) & col(duration).between(lo, hi)


def long_enough(text: str | Column, least: int = 8) -> Column:
    """P4."""
    return F.length(col(text)) >= least


def by_label(label: str | Column, labels: dict[str, int], wanted: str) -> Column:
    """P5: a categorical filter by its label's number."""
    return col(label) == labels[wanted]


def cast_or_drop(df: DataFrame, *names: str, kind: str = "double") -> DataFrame:
    """Rows whose named columns all parse."""
    out = df.withColumns({n: F.col(n).try_cast(kind) for n in names})
    for n in names:
        out = out.where(F.col(n).isNotNull())
    return out


def reject_reason(duration, peak, speech) -> Column:
    """The first reason that holds, else null."""
    d, p, s = col(duration), col(peak), col(speech)
    return (
        F.when(d < MIN_SEC, "too_short").when(d > MAX_SEC, "too_long").when(p > PEAK_MAX, "clipping").when(p < PEAK_MIN, "silent").when(s < SPEECH_MIN, "low_speech_ratio")
    )


def qc_flags(cer, mos, rate, tail, cer_max=CER_MAX, mos_min=MOS_MIN, rates=RATE, tail_max=TAIL_MAX) -> Column:
    """All flags that hold, in order; thresholds are arguments, so stored metrics can be flagged anew."""
    flags = F.array(
        F.when(col(cer) > cer_max, "cer"), F.when(col(mos) < mos_min, "dnsmos"), F.when(~col(rate).between(*rates), "rate"), F.when(col(tail) > tail_max, "tail")
    )
    return F.filter(flags, lambda x: x.isNotNull())


def flags_text(flags: Column) -> Column:
    return F.array_join(flags, "+")


def prosody_class(p: str | Column, text: str | Column) -> Column:
    """P10: a coarse class of a prosody struct; an unknown one is neutral, whatever the text."""
    p, f = col(p), lambda name: col(p)[name]
    return (
        F.when(p.isNull(), "neutral")
        .when(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+$", "").endswith("?"), "frågande")
        .when((f("f0_std") > 8.6) & (f("energy_std") > f("energy_mean") * 0.8), "expressiv")
        .when(f("f0_std") > 8.1, "energisk")
        .when(f("speech_rate") > 8.2, "snabb")
        .when((f("speech_rate") < 5.5) | (f("pause_ratio") > 0.65), "långsam")
        .otherwise("neutral")
    )


def verdict(cer, mos, comb) -> Column:
    """Intelligibility first, then quality, then artifacts."""
    return F.when(col(cer) > EVAL_CER, "FAIL-intelligibility").when(col(mos) < EVAL_MOS, "FAIL-quality").when(col(comb) < COMB_LOW, "ok (comb low)").otherwise("ok (comb audible)")


def responsive(low, high) -> Column:
    """Whether the spread of two averages passes."""
    return (col(high) - col(low)) > SPREAD_MIN


def composite(mos, cer) -> Column:
    """P13."""
    return F.least(col(mos) / 5.0, F.lit(1.0)) * (1 - F.least(col(cer), F.lit(1.0)))


def passes(mos, cer) -> Column:
    return (col(cer) <= CER_MAX) & (col(mos) >= MOS_MIN)


def mos_of_raw(raw) -> Column:
    """Raw score to opinion score."""
    a, b, c = MOS_POLYNOMIAL
    return a * col(raw) * col(raw) + b * col(raw) + F.lit(c)


def phoneme_length_ok(phonemes, most: int = 400) -> Column:
    """P15."""
    return F.length(col(phonemes)).between(1, most)


def stripe(index, n: int, k: int) -> Column:
    """P16."""
    return F.pmod(col(index), F.lit(n)) == k


def contains_ignoring_case(value, query: str) -> Column:
    """P17."""
    return F.contains(F.lower(col(value)), F.lit(query.lower()))


def require(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """The frame, which fails the query on a row where ``bad`` holds."""
    first = df.columns[0]
    return df.withColumn(first, F.when(bad, F.raise_error(F.lit(message)).cast(df.schema[first].dataType)).otherwise(F.col(first)))


def require_rows(df: DataFrame, least: int, message: str) -> DataFrame:
    """Raises where there are fewer rows than ``least``."""
    if df.limit(least).count() < least:
        raise ValueError(message)
    return df


def rate(chars, seconds) -> Column:
    """P20: characters a second, 0 where there is no duration."""
    return F.coalesce(col(chars) / F.nullif(col(seconds), F.lit(0.0)), F.lit(0.0))


def speaker_label(speaker) -> Column:
    """A readable speaker name from a prefixed id."""
    s = col(speaker)
    return F.when(s.startswith("nst_"), F.concat(F.lit("NST "), F.substring(s, 5, 1_000_000))).when(s.startswith("libri_"), F.replace(F.replace(s, F.lit("libri_"), F.lit("")), F.lit("Unknown - "), F.lit("Libri "))).otherwise(s)

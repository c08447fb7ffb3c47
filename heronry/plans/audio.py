"""Queries over signals and vectors, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signal as sg
from ..operators import intervals, joins, stats
from .tables import SIGNAL_SQL, signal, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FRAMES = f"{SIGNAL_SQL}, frames AS (SELECT clip, pos // 8 AS frame, sqrt(avg(value * value)) AS rms FROM signal GROUP BY clip, pos // 8 HAVING count(*) = 8)"


def _frames(spark, sf_dir):
    return sg.frame_rms(signal(spark, sf_dir), "clip", "pos", "value", 8)


@query(f"WITH {_FRAMES} SELECT clip, frame, round(rms, 6) AS rms FROM frames")
def frame_rms(spark, sf_dir):
    """W6."""
    return _frames(spark, sf_dir).select("clip", "frame", F.round("rms", 6).alias("rms"))


@query(f"WITH {_FRAMES} SELECT clip, avg((rms > 0.1 * top)::INT::DOUBLE) AS speech_ratio, count(*) AS frames FROM (SELECT *, max(rms) OVER (PARTITION BY clip) AS top FROM frames) GROUP BY clip")
def speech_ratio(spark, sf_dir):
    """W9."""
    return sg.speech_ratio(_frames(spark, sf_dir), "clip")


@query(
    f"""WITH {_FRAMES}, e AS (SELECT clip, frame, rms / (max(rms) OVER (PARTITION BY clip) + 1e-9) AS env FROM frames), n AS (SELECT *, lag(env) OVER w AS a, lead(env) OVER w AS b FROM e WINDOW w AS (PARTITION BY clip ORDER BY frame))
    SELECT clip, count(*) FILTER (env > a AND env > b AND env > 0.25) AS peaks FROM n GROUP BY clip"""
)
def local_peaks(spark, sf_dir):
    """W8."""
    return sg.local_peaks(_frames(spark, sf_dir), "clip")


@query(f"WITH {SIGNAL_SQL}, p AS (SELECT clip, max(abs(value)) + 1e-9 AS peak, count(*) AS n FROM signal GROUP BY clip) SELECT clip, coalesce(n - 1 - max(pos) FILTER (abs(value) > peak * 0.5), n) AS tail FROM signal JOIN p USING (clip) GROUP BY clip, n")
def tail_index(spark, sf_dir):
    """W10, at half the peak (the values are all loud)."""
    import math

    return sg.tail_index(signal(spark, sf_dir), "clip", "pos", "value", 20 * math.log10(0.5))


@query(f"WITH {SIGNAL_SQL}, s AS (SELECT clip, 12 * log2(value / median(value) OVER (PARTITION BY clip)) AS st FROM signal WHERE value > 0) SELECT clip, round(stddev_pop(st), 6) AS sd, round(quantile_cont(st, 0.95) - quantile_cont(st, 0.05), 6) AS p90, count(*) AS n FROM s GROUP BY clip")
def semitone_stats(spark, sf_dir):
    """M1, A16."""
    st = sg.semitones(signal(spark, sf_dir).where("value > 0"), "clip", "value")
    return st.groupBy("clip").agg(F.round(F.stddev_pop("st"), 6).alias("sd"), F.round(F.percentile("st", F.lit(0.95)) - F.percentile("st", F.lit(0.05)), 6).alias("p90"), F.count("*").alias("n"))


@query(f"WITH {SIGNAL_SQL} SELECT clip, median(value) AS med, round(avg(value), 6) AS mean, max(value) AS top, round(sqrt(avg(value * value)), 6) AS rms FROM signal GROUP BY clip")
def signal_stats(spark, sf_dir):
    """A16."""
    return stats.signal_stats(signal(spark, sf_dir), "clip", "value").select("clip", "med", F.round("mean", 6).alias("mean"), "top", F.round("rms", 6).alias("rms"))


@query("WITH f AS (SELECT event_type, user_id, stddev_pop(value) AS sd FROM events GROUP BY ALL HAVING count(value) > 20) SELECT event_type, round(avg(sd), 6) AS mean_sd, count(*) AS groups FROM f GROUP BY event_type")
def spread_two_level(spark, sf_dir):
    """A12."""
    e = table(spark, sf_dir, "events").where("value is not null")
    return stats.spread_two_level(e, "event_type", "user_id", "value", 20).withColumn("mean_sd", F.round("mean_sd", 6))


_VOICE = "voice AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i)"


def _voices(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    per = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return per.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("vec"))


@query(f"WITH {_VOICE} SELECT a.label, a.i, round(0.25 * a.x + 0.75 * b.x, 6) AS x FROM voice a JOIN voice b ON b.label = a.label + 1 AND a.i = b.i")
def voice_blend(spark, sf_dir):
    """Each label's mean vector with the next label's."""
    v = _voices(spark, sf_dir)
    pairs = v.join(v.select((F.col("label") - 1).alias("label"), F.col("vec").alias("other")), "label")
    return pairs.select("label", F.posexplode(sg.blend("vec", "other", 0.25)).alias("p", "x")).select("label", (F.col("p") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(f"WITH {_VOICE} SELECT d.doc_id, v.label, round(v.x, 6) AS x FROM documents d JOIN voice v ON v.i = least(d.n_chars, 64) WHERE v.label = 3")
def row_at_length(spark, sf_dir):
    """A text's row of a length-indexed table."""
    v = _voices(spark, sf_dir).where("label = 3").select("label", F.posexplode("vec").alias("p", "x")).select("label", (F.col("p") + 1).alias("n_tokens"), "x")
    d = table(spark, sf_dir, "documents").select("doc_id", F.least("n_chars", F.lit(64)).alias("n_tokens"))
    return d.join(joins.small(v), "n_tokens").select("doc_id", "label", F.round("x", 6).alias("x"))


@query("SELECT vec_id, i, greatest(least(x::DOUBLE, 1.0), -1.0) * 0.5 + 0.0 AS half, trunc(greatest(least(x::DOUBLE, 1.0), -1.0) * 32767)::INT AS q FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)")
def quantise(spark, sf_dir):
    """The mean with silence, and 16-bit integers."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    half = sg.mono(F.transform("x", lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(-1.0))), F.transform("x", lambda v: F.lit(0.0)))
    rows = e.select("vec_id", F.posexplode(F.arrays_zip(half.alias("h"), sg.quantise("x").alias("q"))).alias("i", "z"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.col("z.h").alias("half"), F.col("z.q").alias("q"))


@query(
    """SELECT vec_id, round(sqrt(list_aggregate(list_transform(embedding, lambda v: v::DOUBLE * v), 'sum') / len(embedding)), 6) AS rms, len(embedding) + 16 AS padded, 100 AS tiled,
    (len(embedding) - 16) // 8 + 1 AS windows FROM embeddings"""
)
def levels_and_windows(spark, sf_dir):
    """Levels, padding, tiling and overlapping windows."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(sg.rms("embedding"), 6).alias("rms"), F.size(sg.pad_tail("embedding", 16)).alias("padded"), F.size(sg.tile("embedding", 100)).alias("tiled"), F.size(sg.windows("embedding", 16, 8)).alias("windows"))


@query(None)
def normalised_levels(spark, sf_dir):
    """Level, peak and trimmed tail of each vector as a signal."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    durations = F.array(F.lit(4).cast("long"), F.lit(10).cast("long"), F.lit(2).cast("long"))
    return e.select("vec_id", F.round(sg.rms(sg.rms_normalise("x")), 9).alias("rms"), F.round(sg.peak(sg.peak_normalise("x")), 9).alias("peak"), F.size(sg.trim_tail("x", durations, 800)).alias("kept"))


@query(None)
def spectral_metrics(spark, sf_dir):
    """M6-M8: cepstral and spectral metrics of each user's values as a signal at 24 kHz, short ones repeated."""
    rows = signal(spark, sf_dir).groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s.value).alias("x"))
    rows = rows.withColumn("x", F.when(F.size("x") < 6000, sg.tile("x", 6000)).otherwise(F.col("x"))).withColumn("sr", F.lit(24000))
    return rows.select("clip", sg.comb_score("x", "sr").alias("comb"), sg.echo_ratio("x", "sr").alias("echo"), sg.band_ratio("x", "sr").alias("bands"))


@query(None)
def interval_merge(spark, sf_dir):
    """A user's bursts of events merged greedily, 12 hours at most, 1 hour at least."""
    e = table(spark, sf_dir, "events").where("ts is not null").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return intervals.merge(e.withColumn("e", F.col("s") + 600), "user_id", "s", "e", 12 * 3600.0, 3600.0)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Engine extension: event-time windows."""
    from ..streaming.incremental import event_windows as windows

    return windows(table(spark, sf_dir, "events")).select(F.col("w.start").alias("hour"), "event_type", "n")

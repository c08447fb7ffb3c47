"""Queries over samples: clips whose tones, levels and lengths come from the tables, and the SQL that knows them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import api
from ..functions import prosody as pr
from ..functions import signal as sg
from ..functions.text import let
from .tables import table

#: Samples a second, and in an energy frame, of the clips made from events.
RATE, FRAME = 8000, 240

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# an event is an energy frame (240 samples at 8 kHz) of its user's tone, as loud as its value, and 48 frames that slowly
# grow louder follow; the tones have whole periods in a frame, and loudnesses of neighbours differ. Every seventh user's
# clip is cut to eight frames, too short for ten voiced ones
_LOUD = """loud AS (SELECT user_id, pos, (value + pos * 0.001) / 1000 AS a FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events WHERE value IS NOT NULL) WHERE user_id % 7 > 0 OR pos < 8
    UNION ALL SELECT user_id, 1000 + k, 0.2 + k / 1000 FROM (SELECT DISTINCT user_id FROM events WHERE value IS NOT NULL AND user_id % 7 > 0), (SELECT unnest(range(48)) AS k))"""


def _event_clips(spark, sf_dir):
    """(user_id, f, level of each frame)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").where("value is not null").withColumn("pos", F.row_number().over(w) - 1).where("user_id % 7 > 0 or pos < 8")
    # the frames that follow stand at places 1000 to 1047, as in the SQL, after an event that has the same place
    own = F.collect_list(F.struct("pos", F.lit(0).alias("tail"), ((F.col("value") + F.col("pos") * 0.001) / 1000).alias("a")))
    after = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda k: F.struct((1000 + k).alias("pos"), F.lit(1).alias("tail"), (0.2 + k / 1000).alias("a")))
    frames = e.groupBy("user_id").agg(own.alias("own")).withColumn("frames", F.when(F.col("user_id") % 7 > 0, F.concat("own", after)).otherwise(F.col("own")))
    levels = frames.select("user_id", F.transform(F.array_sort("frames"), lambda s: s["a"]).alias("levels"))
    # levels take few bytes, the samples made of them every core: so many parts are not coalesced
    return levels.repartition(4 * spark.sparkContext.defaultParallelism).withColumn("f", (3 + F.col("user_id") % 8) * 100 / F.lit(3.0))


def _tone(f, i):
    """A sample of a frame's tone, which has whole periods in a frame."""
    return F.sin(2 * np.pi * f * i / RATE)


def _samples():
    """A clip's samples, from the tone's once."""
    tone = F.transform(F.sequence(F.lit(0), F.lit(FRAME - 1)), lambda i: _tone(F.col("f"), i))
    return let(tone, lambda t: F.flatten(F.transform("levels", lambda a: F.transform(t, lambda s: a * s))))


_FIELDS = f"""{_LOUD}, m AS (SELECT user_id, pos, a / sqrt(2) AS rms, max(a) OVER (PARTITION BY user_id) / sqrt(2) AS top, a > lag(a) OVER w AND a > lead(a) OVER w AS above FROM loud WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
    s AS (SELECT user_id, avg(rms) AS mean, stddev_pop(rms) AS sd, 1 - avg((rms > 0.1 * top)::INT) AS pause, count(*) FILTER (above AND rms / (top + 1e-9) > 0.25) AS peaks, count(*) * 0.03 AS dur FROM m GROUP BY user_id),
    p AS (SELECT user_id, dur >= 1 AS known, round((3 + user_id % 8) * 100 / 3.0) AS f0, round_even(mean, 4) AS energy_mean, round_even(sd, 4) AS energy_std, round_even(peaks / greatest(dur * (1 - pause), 0.1), 2) AS speech_rate, round_even(pause, 3) AS pause_ratio, round_even(dur, 2) AS duration FROM s)"""
_SEVEN = ["f0_mean", "f0_std", "energy_mean", "energy_std", "speech_rate", "pause_ratio", "duration"]


@query(
    f"""WITH {_FIELDS} SELECT user_id, CASE WHEN known THEN f0 END AS f0_mean, known AS steady, {", ".join(f"CASE WHEN known THEN {c} END AS {c}" for c in _SEVEN[2:])} FROM p"""
)
def prosody_of_events(spark, sf_dir):
    """Prosody of whole clips; null where fewer than ten frames are voiced."""
    clips = _event_clips(spark, sf_dir).select("user_id", F.lit(RATE).alias("sr"), _samples().alias("samples"))
    found = pr.prosody(pr.blocks(clips, "user_id", size=1 << 12))
    fields = [F.round("prosody.f0_mean").alias("f0_mean"), F.coalesce(F.col("prosody.f0_std") < 0.2, F.lit(False)).alias("steady"), *(F.col(f"prosody.{c}").alias(c) for c in _SEVEN[2:])]
    return found.select(F.col("clip").alias("user_id"), *fields)


@query(f"WITH {_FIELDS} SELECT user_id, known, CASE WHEN known THEN energy_mean END AS energy_mean, CASE WHEN known THEN duration END AS duration FROM p")
def prosody_of_sample_rows(spark, sf_dir):
    """The same from samples in rows, measured where they are read; no task holds more than a block."""
    frames = _event_clips(spark, sf_dir).select("user_id", "f", F.posexplode("levels").alias("k", "a"))
    samples = frames.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(FRAME - 1))))
    rows = samples.select("user_id", (F.col("k") * FRAME + F.col("i")).alias("pos"), (F.col("a") * _tone(F.col("f"), F.col("i"))).alias("value"))
    found = pr.prosody_of_rows(rows, "user_id", "pos", "value", RATE, 1 << 12)
    return found.select(F.col("clip").alias("user_id"), F.col("prosody").isNotNull().alias("known"), "prosody.energy_mean", "prosody.duration")


# the class by the gates of P10, from the fields as SQL has them; these clips are steady
_CLASS = "CASE WHEN NOT known THEN 'neutral' WHEN user_id % 5 = 0 THEN 'frågande' WHEN speech_rate > 8.2 THEN 'snabb' WHEN speech_rate < 5.5 OR pause_ratio > 0.65 THEN 'långsam' ELSE 'neutral' END"


@query(f"WITH {_FIELDS} SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 1.0 WHEN known THEN duration END AS duration, CASE WHEN user_id % 4 = 0 THEN 'långsam' ELSE {_CLASS} END AS prosody_class FROM p")
def extracted_prosody(spark, sf_dir):
    """The verb over a manifest: rows with prosody keep it, the others are measured, all are classed."""
    from ..schemas import PROSODY

    c = _event_clips(spark, sf_dir)
    audio = c.select(F.col("user_id").alias("audio_path"), F.lit(RATE).alias("sr"), _samples().alias("samples"))
    had = F.struct(*(F.lit(1.0).alias(n) for n in PROSODY.fieldNames()))
    rows = c.select(F.col("user_id").alias("audio_path"), F.when((F.col("user_id") % 5 == 0) & (F.col("user_id") % 4 > 0), "va? ").otherwise("ja").alias("text"), F.when(F.col("user_id") % 4 == 0, had).alias("prosody"))
    return api.extract_prosody(rows, audio).select(F.col("audio_path").alias("user_id"), "prosody.duration", "prosody_class")


@query("SELECT p_partkey % 350 AS tone, true AS within, 9 AS frames FROM part GROUP BY p_partkey % 350")
def pitch_accuracy(spark, sf_dir):
    """M2: tones from 62 to 437 Hz, each frame within a thousandth; noise and silence are unvoiced."""
    t = table(spark, sf_dir, "part").select((F.col("p_partkey") % 350).alias("tone")).distinct().withColumn("f", 62 + F.col("tone") * 1.0737)
    i = F.sequence(F.lit(0), F.lit(6143))
    x = F.transform(i, lambda k: F.sin(2 * np.pi * F.col("f") * k / 16000))
    noise = F.transform(i, lambda k: F.pmod(F.xxhash64("tone", k), F.lit(1001)) / 500.0 - 1)
    unheard = lambda y: F.size(F.filter(sg.pitch(y, F.lit(16000)), lambda f: f.isNotNull())) == 0
    found = t.withColumn("p", sg.pitch(x, F.lit(16000))).withColumn("quiet", unheard(noise) & unheard(F.array_repeat(F.lit(0.0), 6144)))
    return found.select("tone", (F.forall("p", lambda p: F.abs(p / F.col("f") - 1) < 1e-3) & F.col("quiet")).alias("within"), F.size("p").alias("frames"))


# the filter from 8 to 4 kHz: every output is a weighted sum of 103 inputs
_TAPS = """taps AS (SELECT j, w / sum(w) OVER () AS w FROM (SELECT j, CASE WHEN j = 0 THEN 1 ELSE sin(pi() * 0.475 * j) / (pi() * 0.475 * j) END * (0.5 + 0.5 * cos(pi() * j / 51)) AS w FROM (SELECT unnest(range(-51, 52)) AS j)))"""


@query(
    f"""WITH {_TAPS}, x AS (SELECT n_nationkey, i, sin(2 * pi() * (100 + 70 * n_nationkey) * i / 8000.0) + (i = 799)::INT AS x FROM nation, (SELECT unnest(range(800)) AS i)),
    y AS (SELECT n_nationkey, n, sum(w * x) AS y FROM (SELECT unnest(range(400)) AS n), taps JOIN x ON i = 2 * n + j GROUP BY n_nationkey, n) SELECT n_nationkey, n AS i, round(y, 6) + 0.0 AS x FROM y"""
)
def resampled_clips(spark, sf_dir):
    """Tones with a click at their end, from 8 to 4 kHz, against the weighted sums."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", (100 + 70 * F.col("n_nationkey")).cast("double").alias("f"))
    x = F.transform(F.sequence(F.lit(0), F.lit(799)), lambda i: F.sin(2 * np.pi * F.col("f") * i / 8000) + F.when(i == 799, 1.0).otherwise(0.0))
    out = n.select("n_nationkey", F.posexplode(sg.resample(4000)(x, F.lit(8000))).alias("i", "x"))
    return out.select("n_nationkey", F.col("i").cast("long").alias("i"), (F.round("x", 6) + F.lit(0.0)).alias("x"))


# a notch at 1500 Hz as its recurrence, forward and then back
_NOTCH = "SELECT 1 / (1 + tan(2 * pi() * 1500 / 8000 / 30 / 2)) AS g, cos(2 * pi() * 1500 / 8000) AS c"


@query(
    f"""WITH RECURSIVE k AS ({_NOTCH}), x AS (SELECT n_nationkey AS key, i, sin(2 * pi() * (100 + 100 * n_nationkey) * i / 8000.0) AS x FROM nation, (SELECT unnest(range(300)) AS i)),
    f(key, i, x1, x2, y1, y2) AS (SELECT DISTINCT key, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM x UNION ALL SELECT f.key, f.i + 1, x.x, f.x1, g * x.x - 2 * g * c * f.x1 + g * f.x2 + 2 * g * c * f.y1 - (2 * g - 1) * f.y2, f.y1 FROM f JOIN x ON x.key = f.key AND x.i = f.i, k),
    b(key, i, x1, x2, y1, y2) AS (SELECT DISTINCT key, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM x UNION ALL SELECT b.key, b.i + 1, f.y1, b.x1, g * f.y1 - 2 * g * c * b.x1 + g * b.x2 + 2 * g * c * b.y1 - (2 * g - 1) * b.y2, b.y1 FROM b JOIN f ON f.key = b.key AND f.i = 300 - b.i, k WHERE b.i < 300)
    SELECT key AS n_nationkey, 300 - i AS i, round(y1, 6) + 0.0 AS x FROM b WHERE i > 0"""
)
def notch_values(spark, sf_dir):
    """M9: every value of a zero-phase notch, against the recurrence a sample at a time."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", (100 + 100 * F.col("n_nationkey")).cast("double").alias("f"))
    x = F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.sin(2 * np.pi * F.col("f") * i / 8000))
    out = n.select("n_nationkey", F.posexplode(sg.notch_at(1500.0)(x, F.lit(8000))).alias("i", "x"))
    return out.select("n_nationkey", F.col("i").alias("i"), (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query("SELECT l_returnflag AS flag, count(l_extendedprice) AS n, median(l_extendedprice::DOUBLE) AS mid, round(quantile_cont(l_extendedprice::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice::DOUBLE, 0.05), 6) AS p05, median(l_quantity::DOUBLE) AS quantity FROM lineitem GROUP BY l_returnflag")
def refined_quantiles(spark, sf_dir):
    """Exact quantiles of a few large keys, values that differ and values that repeat, narrowed by sketches."""
    from ..operators.quantiles import quantiles

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice", "l_quantity")
    price = quantiles(rows, "flag", "l_extendedprice", 0.5, 0.95, 0.05, most=1000)
    quantity = quantiles(rows, "flag", "l_quantity", 0.5, most=1000).select(F.col("flag").alias("k"), F.col("q")[0].alias("quantity"))
    return price.join(quantity, F.col("flag").eqNullSafe(F.col("k"))).select("flag", "n", F.col("q")[0].alias("mid"), F.round(F.col("q")[1], 6).alias("p95"), F.round(F.col("q")[2], 6).alias("p05"), "quantity")

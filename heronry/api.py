"""The pipeline's verbs: prepare, extract_prosody, build_mix, export_filelists, verify, evaluate, normalize."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import phonemes as ph
from .functions import swedish
from .operators import gates, joins, sampling, stats
from .sources.scratch import scratch


def prepare(rows: DataFrame, target_sec: float, order: list[str], bucket: Column, used: DataFrame | None = None, least_chars: int = 8, least_quality: float = 3.6, speaker_cap: bool = True) -> DataFrame:
    """Gate, normalise and take a budget: speakers in ``used`` out, quality, length; a speaker gives a sixth at most."""
    rows = rows if used is None else joins.exclude(rows, used, "speaker_id")
    rows = rows.where(F.col("quality_score").isNull() | (F.col("quality_score") >= least_quality)).withColumn("text", swedish.normalise("text")).where(gates.long_enough("text", least_chars))
    # running totals read the rows several times; the rewrite is done once
    path = scratch(rows.sparkSession, "prepared")
    rows.write.parquet(path)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    if speaker_cap:
        return sampling.take_capped(rows, "speaker_id", "duration_sec", target_sec / 6, target_sec, bucket, order)
    return sampling.take_budget(rows, "duration_sec", target_sec, bucket, order)


def extract_prosody(rows: DataFrame, audio: DataFrame | Callable[[DataFrame], DataFrame], key: str = "audio_path") -> DataFrame:
    """Enrich the rows that have no prosody yet, then class all of them.

    ``audio`` holds the samples of clips (key, sr, samples); only those of rows without prosody are measured. A function
    that fills the column of such rows may stand in for it."""
    from .functions import prosody
    from .streaming.incremental import enrich_missing

    def measured(missing: DataFrame) -> DataFrame:
        found = prosody.prosody(prosody.blocks(audio.join(missing.select(key), key, "left_semi"), key)).withColumnRenamed("clip", key)
        return missing.drop("prosody").join(found, key, "left").select(*missing.columns)

    extractor = audio if callable(audio) else measured
    return enrich_missing(rows, "prosody", extractor).withColumn("prosody_class", gates.prosody_class("prosody", "text"))


def build_mix(rows: DataFrame, config: dict, key: str = "audio_path") -> DataFrame:
    """Weighted mix by a config: target_hours, mix and selection."""
    sel = config.get("selection", {})
    pool = rows.where(gates.in_range_or_unknown("duration_sec", "quality_score", sel.get("min_clip_sec", 0), sel.get("max_clip_sec", 1e9), sel.get("min_quality_score", 0)))
    preferred = gates.prosody_class("prosody", "text").isin(*sel.get("prefer_prosody_classes", ["-"]))
    out = sampling.weighted_mix(pool, config["mix"], config["target_hours"] * 3600, preferred, key=key)
    return out.withColumn("order_key", sampling.shuffle_key(key)).orderBy("order_key", key)


def export_filelists(rows: DataFrame, lexicon: DataFrame, val: int = 150, key: str = "audio_path") -> dict[str, DataFrame]:
    """Phonemes, vocabulary gate, speaker index and split: frames "train", "val", "dropped" and "speakers"."""
    phon = ph.phonemise(rows, lexicon, key, "text").withColumn("phonemes", ph.remap("phonemes"))
    marked = rows.join(phon, key).withColumn("unknown", ph.unknown_symbols("phonemes"))
    fine = marked.where(gates.phoneme_length_ok("phonemes") & (F.size("unknown") == 0))
    placed = sampling.split(joins.dense_index(fine, "speaker_id").withColumnRenamed(key, "clip_id"), val).withColumnRenamed("clip_id", key)
    return {
        "train": placed.where("split = 'train'"), "val": placed.where("split = 'val'"),
        "dropped": stats.symbol_documents(marked.where(F.size("unknown") > 0), key, F.col("unknown")), "speakers": placed.select("speaker_id", "speaker_index").distinct(),
    }


def verify(rows: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored rows with flags from the stored (rounded) metrics, and the summary."""
    flags = gates.qc_flags(*(F.col(c).cast("double") for c in ("cer", "dnsmos", "rate", "tail")))
    scored = rows.select("audio").join(joins.last_wins(results.withColumn("seq", F.monotonically_increasing_id()), "audio", "seq"), "audio").withColumn("flag_list", flags).withColumn("flags", gates.flags_text(F.col("flag_list")))
    return scored, stats.failure_rate(scored, F.col("flag_list"))


def evaluate(metrics: DataFrame, system: str = "system") -> DataFrame:
    """Mean metrics of each system and the verdict, gates in order."""
    return stats.means(metrics, system, "cer", "dnsmos", "comb").withColumn("verdict", gates.verdict("mean_cer", "mean_dnsmos", "mean_comb"))


def normalize(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.withColumn("normalised", swedish.normalise(text))

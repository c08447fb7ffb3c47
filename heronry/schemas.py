"""Explicit schemas of the relations that the engine reads and writes."""

from pyspark.sql import types as T

PROSODY = T.StructType([T.StructField(n, T.DoubleType()) for n in ("f0_mean", "f0_std", "f0_range", "energy_mean", "energy_std", "speech_rate", "pause_ratio", "duration")])
MANIFEST = T.StructType(
    [
        T.StructField("audio_path", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("speaker_id", T.StringType(), False),
        T.StructField("dataset", T.StringType(), False),
        T.StructField("duration_sec", T.DoubleType(), False),
        T.StructField("sample_rate", T.IntegerType(), False),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("prosody", PROSODY),
        T.StructField("prosody_class", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)
SPEAKERS_CSV = "audio string, text string, speaker_id string, duration string, dnsmos string"
QC_REPORT = "audio string, cer string, dnsmos string, rate string, tail string, flags string, asr_text string"
LEXICON = "word string, ipa array<string>, seq long"
VOICES = "speaker_id string, name string, gender string, role string"
CSS_LINE = "rel_path string, raw_text string, text string"

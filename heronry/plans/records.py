"""Queries that write a relation, read it back and work on what comes: sources, sinks, incremental batches and the
pipeline's verbs, and the SQL that checks them against the tables they were written from."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .. import api
from ..functions import backends, signal as sg, swedish, text
from ..operators import folds, gates, joins, sampling, stats
from ..schemas import MANIFEST, PROSODY
from ..sources import early_stop as early_stop_scan
from ..sources import readers, versions, writers
from ..sources.scratch import put_text, scratch
from ..streaming import incremental
from .language import _HUND, _LISTS, quoted
from .tables import CLIPS_SQL, clips, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _manifest(spark, sf_dir):
    """clips with the columns of a manifest; every third one has an extra."""
    c = clips(spark, sf_dir)
    have = {"audio_path": F.concat(F.lit("wavs/"), "clip_id", F.lit(".wav")), "duration_sec": F.col("chars").cast("double"), "sample_rate": F.lit(24000)}
    have["prosody"] = F.when(F.col("clip_id") % 5 > 0, F.struct(*((F.col("chars") % 10 if n == "f0_std" else F.lit(6)).cast("double").alias(n) for n in PROSODY.fieldNames())))
    have["extra"] = F.when(F.col("clip_id") % 3 == 0, F.create_map(F.lit("k"), F.col("clip_id").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    have["prosody_class"] = F.lit(None).cast("string")
    return c.select(*(have.get(f.name, F.col(f.name) if f.name in c.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in MANIFEST))


@query(f"WITH {CLIPS_SQL} SELECT 'wavs/' || clip_id || '.wav' AS audio_path, md5(text) AS text, chars::DOUBLE AS duration_sec, quality_score, CASE WHEN clip_id % 5 > 0 THEN (chars % 10)::DOUBLE END AS f0_std, CASE WHEN clip_id % 3 = 0 THEN clip_id::VARCHAR END AS extra FROM clips")
def jsonl_manifest(spark, sf_dir):
    """Written as JSONL, blank lines among it, and read again."""
    path = scratch(spark, "manifest")
    writers.write_manifest(_manifest(spark, sf_dir), path)
    put_text(spark, f"{path}/blank.txt", "\n\n")
    back = readers.manifest(spark, path).where("audio_path is not null")
    return back.select("audio_path", F.md5("text").alias("text"), "duration_sec", "quality_score", F.col("prosody.f0_std").alias("f0_std"), F.col("extra")["k"].alias("extra"))


@query("SELECT count(*) AS lines, count(*) FILTER (doc_id % 3 = 0) AS with_extra, count(*) FILTER (quality IS NULL) AS null_quality FROM documents LEFT JOIN labels USING (doc_id)")
def manifest_lines(spark, sf_dir):
    """K1: nulls are written, empty extras are not."""
    path = scratch(spark, "manifest")
    writers.write_manifest(_manifest(spark, sf_dir), path)
    v = F.col("value")
    return spark.read.text(path).agg(F.count("*").alias("lines"), F.count_if(v.rlike(r'"extra":\{')).alias("with_extra"), F.count_if(v.contains('"quality_score":null')).alias("null_quality"))


def _parquet_shards(spark, sf_dir):
    path = scratch(spark, "shards")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    d.where("doc_id % 2 = 0").repartition(3, "doc_id").write.parquet(f"{path}/a")
    d.where("doc_id % 2 = 1").repartition(2, "doc_id").write.parquet(f"{path}/b")
    return path


@query("SELECT doc_id, n_chars, 3.5::DOUBLE AS dnsmos FROM documents")
def parquet_shards(spark, sf_dir):
    """Pruned columns over several shards; a column that the files lack gets a constant."""
    path = _parquet_shards(spark, sf_dir)
    return readers.parquet_columns(spark, [f"{path}/a", f"{path}/b"], ["doc_id", "n_chars"], {"dnsmos": 3.5})


@query("SELECT source, doc_id, n_chars FROM documents WHERE source IN ('src1', 'src7', 'absent')")
def payload_of_keys(spark, sf_dir):
    """S3: payload of wanted keys; the filter reaches the scan."""
    return readers.payload_of_keys(spark, f"{sf_dir}/documents.parquet", "source", ["src1", "src7", "absent"], ["doc_id", "n_chars"])


@query("SELECT 'wavs/' || doc_id || '.wav' AS audio, source || ' \"q\"' AS text, source AS speaker_id, n_chars / 4.0 AS duration, 3.25::DOUBLE AS dnsmos FROM documents WHERE doc_id % 7 > 0")
def piped_speakers(spark, sf_dir):
    """A pipe CSV written in two appends; rows whose numbers don't parse are dropped."""
    path = scratch(spark, "speakers")
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.concat(F.lit("wavs/"), "doc_id", F.lit(".wav")).alias("audio"), F.concat("source", F.lit(' "q"')).alias("text"), F.col("source").alias("speaker_id"), (F.col("n_chars") / 4.0).cast("string").alias("duration"), F.when(F.col("doc_id") % 7 == 0, "bad").otherwise("3.25").alias("dnsmos"))
    for k in (0, 1):
        writers.write_piped(rows.where(F.col("doc_id") % 2 == k).drop("doc_id"), path, "append")
    return readers.speakers_csv(spark, path)


@query("SELECT 'w/' || doc_id AS rel_path, source AS raw_text, CASE WHEN doc_id % 4 = 0 THEN source ELSE lang END AS text FROM documents WHERE doc_id % 5 > 0")
def filelists(spark, sf_dir):
    """Headerless lists; lines of two fields are skipped, a blank third one falls back to the second."""
    path = scratch(spark, "lists")
    d = table(spark, sf_dir, "documents").withColumn("rel", F.concat(F.lit("w/"), "doc_id")).withColumn("third", F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.col("lang")))
    writers.write_filelist(d.where("doc_id % 5 > 0"), ["rel", "source", "third"], f"{path}/whole", 1)
    writers.write_filelist(d.where("doc_id % 5 = 0"), ["rel", "source"], f"{path}/short")
    return readers.piped_lines(spark, f"{path}/*")


_LINES = r"SELECT regexp_replace(l, '^\s+|\s+$', '', 'g') AS line FROM (SELECT unnest(string_split_regex(text, '\r\n|\r|\n')) AS l FROM documents)"


@query(f"SELECT line, count(*) AS n FROM ({_LINES}) WHERE line <> '' GROUP BY line")
def line_corpus(spark, sf_dir):
    """Texts written as lines and read as a line corpus, blanks dropped."""
    path = scratch(spark, "lines")
    table(spark, sf_dir, "documents").where("text is not null").select("text").write.text(path)
    return readers.lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT lower(n_name) AS word, len(string_split(n_name, '')) AS tokens, n_nationkey > 4 AS custom FROM nation")
def lexicon_files(spark, sf_dir):
    """A base lexicon and a custom one with comments, blank lines and upper case; the custom one wins."""
    path = scratch(spark, "lexicon")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.array_join(F.split("n_name", ""), " ").alias("ipa"))
    n.select(F.concat(F.lower("n_name"), F.lit("\tx"))).write.text(f"{path}/base")
    n.where("n_nationkey <= 4").select(F.concat(F.lower("n_name"), F.lit("\t"), "ipa")).write.text(f"{path}/base2")
    n.where("n_nationkey > 4").select(F.concat(F.lit("# a comment\n\n"), "n_name", F.lit("\t"), "ipa")).write.text(f"{path}/custom")
    from ..functions.phonemes import lexicon_with_precedence

    base, base2, custom = readers.lexicon(spark, f"{path}/base"), readers.lexicon(spark, f"{path}/base2"), readers.lexicon(spark, f"{path}/custom", custom=True)
    best = lexicon_with_precedence(base, base2, custom)
    marked = best.join(custom.select("word", F.lit(True).alias("c")), "word", "left")
    return marked.select("word", F.size("ipa").cast("long").alias("tokens"), F.coalesce("c", F.lit(False)).alias("custom"))


CONFIG = """# hours and shares of the mix
target_hours: 100.0
mix:
  en: 0.4   # the largest
  fr: 0.2
  de: 0.3
  es: 0.1
selection:
  prefer_prosody_classes: ["expressiv"]
  min_quality_score: 0.5
  min_clip_sec: 22
  max_clip_sec: 18000
"""
_KEY = "md5(concat_ws('|', '1337', path{0}))"


@query(
    f"""WITH {CLIPS_SQL}, p AS (SELECT 'wavs/' || clip_id || '.wav' AS path, * FROM clips WHERE chars BETWEEN 22 AND 18000 AND (quality_score IS NULL OR quality_score >= 0.5)),
    t AS (SELECT *, CASE WHEN clip_id % 5 > 0 AND chars % 10 = 9 AND right(rtrim(text, E' \\n\\t\\r'), 1) <> '?' THEN least({_KEY.format(", '0'")}, {_KEY.format(", '1'")}) ELSE {_KEY.format(", '0'")} END AS ticket FROM p),
    w AS (SELECT * FROM (VALUES ('en', 0.4::DOUBLE), ('fr', 0.2::DOUBLE), ('de', 0.3::DOUBLE), ('es', 0.1::DOUBLE)) AS v(ds, share)),
    r AS (SELECT t.*, share, coalesce(sum(chars) OVER (PARTITION BY dataset ORDER BY ticket, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t JOIN w ON ds = dataset)
    SELECT path AS audio_path, dataset, row_number() OVER (ORDER BY {_KEY.format('')}, path) AS place FROM r WHERE before < share * 360000"""
)
def config_mix(spark, sf_dir):
    """A mix built as a YAML config says, in shuffled order."""
    path = scratch(spark, "config") + ".yaml"
    put_text(spark, path, CONFIG)
    out = api.build_mix(_manifest(spark, sf_dir), readers.config(path, spark))
    return sampling.sequence_ids(out, sampling.hash_bucket("order_key"), ["order_key", "audio_path"]).select("audio_path", "dataset", (F.col("seq") + 1).alias("place"))


@query("SELECT source, count(*) AS n, sum(length(lang))::BIGINT AS chars, row_number() OVER (ORDER BY source) AS place FROM documents GROUP BY source")
def folder_per_key(spark, sf_dir):
    """One folder a key, listed in path order, and read again."""
    path = scratch(spark, "keys")
    writers.write_by_key(table(spark, sf_dir, "documents"), "source", "lang", path)
    files = readers.listing(spark, f"{path}/source=*", "*.txt").select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).distinct()
    placed = joins.dense_index(files, "source", "place").withColumn("place", (F.col("place") + 1).cast("long"))
    rows = spark.read.text(path).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))
    return placed.join(rows, "source").select("source", "n", "chars", "place")


@query("SELECT source AS speaker_id, 'Röst ' || source AS name, count(*) AS clips FROM documents GROUP BY source")
def lookup_document(spark, sf_dir):
    """A lookup as one JSON document."""
    path = scratch(spark, "lookup") + ".json"
    per = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("clips"))
    writers.write_lookup(per.select("source", F.struct(F.concat(F.lit("Röst "), "source").alias("name"), "clips").alias("v")), "source", "v", path)
    return readers.json_lookup(spark, path, "name string, clips long", "speaker_id")


@query("SELECT lang, n, ok, count(*) AS docs FROM documents JOIN (VALUES ('en', 1::BIGINT, true), ('fr', 2, false), ('å', 3, true)) AS v(lang, n, ok) USING (lang) GROUP BY ALL")
def literal_rows(spark, sf_dir):
    """A relation written in code, joined to a table."""
    codes = readers.literal(spark, [("en", 1, True), ("fr", 2, False), ("å", 3, True)], "lang string, n long, ok boolean")
    return table(spark, sf_dir, "documents").select("lang").join(joins.small(codes), "lang").groupBy("lang", "n", "ok").agg(F.count("*").alias("docs"))


@query("SELECT d.doc_id, coalesce(l.quality, d.n_chars % 2)::BIGINT AS quality, l.quality IS NULL AS enriched FROM documents d LEFT JOIN labels l USING (doc_id)")
def enriched_rows(spark, sf_dir):
    """Rows without a value are enriched and the table is written beside the old one."""
    path = scratch(spark, "enrich")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality")), "doc_id", "left")
    d.withColumn("enriched", F.lit(False)).write.parquet(path)
    out = incremental.enrich_missing(spark.read.parquet(path), "quality", lambda x: x.withColumn("quality", F.col("n_chars") % 2).withColumn("enriched", F.lit(True)))
    return spark.read.parquet(writers.rewrite(out, path)).select("doc_id", "quality", "enriched")


@query("SELECT vec_id, i, CASE WHEN i < 64 THEN trunc(greatest(least(embedding[i + 1]::DOUBLE, 1.0), -1.0) * 32767)::INT ELSE 0 END AS q FROM embeddings, (SELECT unnest(range(84)) AS i) WHERE vec_id % 10 > 0")
def wav_round_trip(spark, sf_dir):
    """Vectors as WAV content with a silent tail, decoded again; broken content is set aside."""
    e = table(spark, sf_dir, "embeddings")
    wav = writers.wav_bytes("embedding", 100, 200)
    files = e.select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.substring(wav, 1, 20)).otherwise(wav).alias("content"))
    fine, _ = readers.set_aside(readers.decode_audio(files), F.col("audio").isNull())
    return fine.select("vec_id", F.posexplode("audio.samples").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("x") * 32768).cast("int").alias("q"))


@query("SELECT vec_id, 'rejected' AS what FROM embeddings WHERE vec_id % 10 = 0")
def rejected_audio(spark, sf_dir):
    """Rows whose content can't be decoded are kept aside and fail nothing."""
    e = table(spark, sf_dir, "embeddings")
    wav = writers.wav_bytes("embedding", 100, 0)
    files = e.select("vec_id", F.when(F.col("vec_id") % 20 == 0, F.lit(b"RIFF")).when(F.col("vec_id") % 10 > 0, wav).alias("content"))
    _, rejects = readers.set_aside(readers.decode_audio(files), F.col("audio").isNull())
    return rejects.select("vec_id", F.lit("rejected").alias("what"))


@query("SELECT vec_id, i, trunc(greatest(least(embedding[i + 1]::DOUBLE, 1.0), -1.0) * 8388607)::INT AS q, count(*) OVER (PARTITION BY vec_id) AS n FROM embeddings, (SELECT unnest(range(64)) AS i) WHERE vec_id % 10 > 0")
def flac_round_trip(spark, sf_dir):
    """Vectors as lossless clips of 24 bits, decoded again; clips with a changed byte are set aside."""
    e = table(spark, sf_dir, "embeddings")
    clip = writers.flac_bytes("embedding", 100, 24)
    n = F.octet_length("clip")
    # a byte that is 0x55 already becomes another one, so that every such clip is changed
    other = F.when(F.substring("clip", n - 8, F.lit(1)) == F.lit(b"\x55"), F.lit(b"\xaa")).otherwise(F.lit(b"\x55"))
    broken = F.concat(F.substring("clip", 1, n - 9), other, F.substring("clip", n - 7, F.lit(8)))
    files = e.select("vec_id", clip.alias("clip")).select("vec_id", F.when(F.col("vec_id") % 10 > 0, F.col("clip")).otherwise(broken).alias("content"))
    fine, rejects = readers.set_aside(readers.decode_audio(files), F.col("audio").isNull())
    rows = fine.select("vec_id", F.posexplode("audio.samples").alias("i", "x"), F.size("audio.samples").alias("n"))
    whole = rows.select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("x") * 8388608).cast("int").alias("q"), F.col("n").cast("long").alias("n"))
    return whole.join(rejects.select("vec_id"), "vec_id", "left_anti")


_QC = "qc AS (SELECT 'd' || doc_id AS audio, (n_chars % 100) / 250.0 AS cer, 1 + (n_chars % 30) / 8.0 AS dnsmos, (n_chars % 40)::DOUBLE AS rate, (n_chars % 5) * 0.75 AS tail FROM documents), fl AS (SELECT *, list_filter([CASE WHEN round(cer, 3) > 0.15 THEN 'cer' END, CASE WHEN round(dnsmos, 2) < 2.6 THEN 'dnsmos' END, CASE WHEN rate NOT BETWEEN 6 AND 30 THEN 'rate' END, CASE WHEN tail > 2 THEN 'tail' END], lambda x: x IS NOT NULL) AS f FROM qc)"


def _qc(spark, sf_dir):
    n = F.col("n_chars")
    m = {"cer": (n % 100) / 250.0, "dnsmos": 1 + (n % 30) / 8.0, "rate": (n % 40).cast("double"), "tail": (n % 5) * 0.75}
    digits = {"cer": 3, "dnsmos": 2, "rate": 1, "tail": 2}
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("audio"), *(text.fixed(c.alias(k), digits[k]).alias(k) for k, c in m.items()))


@query(f"WITH {_QC} SELECT audio, array_to_string(f, '+') AS flags FROM fl")
def verify_flow(spark, sf_dir):
    """Stored metrics flagged anew; the report's later line of a clip wins."""
    rows = _qc(spark, sf_dir)
    old = rows.withColumn("cer", F.lit("9.000"))
    scored, _ = api.verify(rows, old.drop("doc_id").coalesce(1).unionByName(rows.drop("doc_id").coalesce(1)))
    return scored.select("audio", "flags")


@query(f"WITH {_QC} SELECT count(*) AS scored, count(*) FILTER (len(f) > 0) AS failing, round(count(*) FILTER (len(f) > 0) / greatest(count(*), 1), 9) AS share FROM fl")
def verify_summary(spark, sf_dir):
    """F6, A10."""
    rows = _qc(spark, sf_dir)
    return api.verify(rows, rows.drop("doc_id"))[1].withColumn("share", F.round("share", 9))


@query(f"WITH {_QC} SELECT audio || '  [' || array_to_string(f, '+') || '] cer=' || printf('%.3f', cer::DOUBLE) || ' mos=' || printf('%.2f', dnsmos + 1e-9) AS line FROM fl WHERE len(f) > 0")
def failure_list(spark, sf_dir):
    """K10."""
    path, rows = scratch(spark, "failures"), _qc(spark, sf_dir)
    scored, _ = api.verify(rows, rows.drop("doc_id"))
    writers.write_failures(scored.where("flags <> ''"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    f"""WITH {CLIPS_SQL}, p AS (SELECT clip_id, speaker_id, chars, dataset || ' ' || speaker_id AS text FROM clips WHERE speaker_id NOT IN ('src3', 'src5') AND (quality_score IS NULL OR quality_score >= 0.5) AND length(dataset || ' ' || speaker_id) >= 8),
    s AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY speaker_id ORDER BY clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own FROM p),
    g AS (SELECT *, coalesce(sum(chars) OVER (ORDER BY clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s WHERE own <= 20000) SELECT clip_id, text FROM g WHERE before < 120000"""
)
def prepare_flow(spark, sf_dir):
    """Used speakers out, gates, normalised texts, budget with a cap for each speaker."""
    c = clips(spark, sf_dir).withColumn("text", F.concat_ws(" ", "dataset", "speaker_id")).withColumn("duration_sec", F.col("chars"))
    used = spark.createDataFrame([("src3",), ("src5",), ("src5",)], "speaker_id string")
    return api.prepare(c, 120_000, ["clip_id"], sampling.id_bucket("clip_id"), used, 8, 0.5).select("clip_id", "text")


_NATION_KEY = "md5(concat_ws('|', '1337', n_name))"
_SPELLED = "translate(lower(n_name), '_0123456789', ' abcdefghij')"


def _spelled(spark, sf_dir):
    """Clips named by nations, their digits as letters, and a lexicon that spells their words out."""
    t = F.translate(F.lower("n_name"), "_0123456789", " abcdefghij")
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("audio_path"), t.alias("text"), F.concat(F.lit("region"), "n_regionkey").alias("speaker_id"))
    return n, n.select(F.explode(F.split("text", " ")).alias("word")).distinct().withColumn("ipa", F.split("word", ""))


@query(f"WITH n AS (SELECT *, {_SPELLED} AS t FROM nation), f AS (SELECT n_name, t AS phonemes, 'region' || n_regionkey AS speaker FROM n WHERE NOT contains(t, 'g')) SELECT n_name AS audio_path, phonemes, dense_rank() OVER (ORDER BY speaker) - 1 AS speaker_index, CASE WHEN row_number() OVER (ORDER BY {_NATION_KEY}, n_name) <= 6 THEN 'val' ELSE 'train' END AS split FROM f")
def filelist_export(spark, sf_dir):
    """Phonemes, vocabulary gate, speaker numbers and split."""
    n, words = _spelled(spark, sf_dir)
    out = api.export_filelists(n, words, 6)
    return out["train"].union(out["val"]).select("audio_path", "phonemes", F.col("speaker_index").cast("long").alias("speaker_index"), "split")


@query(f"SELECT 'g' AS symbol, count(*) AS n_docs FROM nation WHERE contains({_SPELLED}, 'g')")
def filelist_drops(spark, sf_dir):
    """Symbols that dropped clips, and how many."""
    n, words = _spelled(spark, sf_dir)
    return api.export_filelists(n, words, 6)["dropped"]


def _length_scorer(df):
    return df.select("doc_id", (F.col("n_chars") * 2).alias("score"))


@query("SELECT doc_id, n_chars * 2 AS score FROM documents")
def incremental_scores(spark, sf_dir):
    """Three batches that overlap; every key is scored once, and a batch that comes again adds nothing."""
    from pyspark.sql.types import StructType

    report, d = scratch(spark, "report"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    schema = StructType.fromDDL("doc_id long, score long")
    for batch in (d.where("doc_id % 3 = 0"), d.where("doc_id % 2 = 0"), d, d):
        incremental.score_new(batch, report, "doc_id", _length_scorer, schema)
    return spark.read.schema(schema).parquet(report)


@query("SELECT doc_id, n_chars * 2 AS score FROM documents")
def scored_stream(spark, sf_dir):
    """R2: files that arrive under a folder, scored by a stream that is started twice."""
    from pyspark.sql.types import StructType

    base, d = scratch(spark, "stream"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    schema = StructType.fromDDL("doc_id long, score long")
    for batch in (d.where("doc_id % 2 = 0"), d):
        batch.write.mode("append").parquet(f"{base}/in")
        incremental.score_stream(spark, f"{base}/in", d.schema, f"{base}/report", f"{base}/state", "doc_id", _length_scorer, schema).awaitTermination()
    return incremental.read_report(spark, f"{base}/report", schema)


@query("SELECT doc_id + 1000000 AS doc_id, source FROM documents")
def merged_shards(spark, sf_dir):
    """Shards merged under moved keys by a stream; a shard that comes again adds nothing."""
    base, d = scratch(spark, "merge"), table(spark, sf_dir, "documents").select("doc_id", "source")
    for shard in (d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0")):
        shard.write.mode("append").parquet(f"{base}/in")
        incremental.merge_stream(spark, f"{base}/in", d.schema, f"{base}/out", f"{base}/state", "doc_id", 1_000_000).awaitTermination()
    return incremental.read_report(spark, f"{base}/out", d.schema)


@query("WITH t AS (SELECT sum(n_chars) * 2 // 5 AS target FROM documents WHERE n_chars % 3 > 0), r AS (SELECT doc_id, n_chars, source, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS before FROM documents WHERE n_chars % 3 > 0) SELECT doc_id, n_chars, source FROM r, t WHERE before < target")
def early_stop(spark, sf_dir):
    """Files in order are read with their payload until a budget is met."""
    path, d = scratch(spark, "shards"), table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "text")
    d.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    wanted = F.col("n_chars") % 3 > 0
    target = (d.where(wanted).agg(F.sum("n_chars")).first()[0] or 0) * 2 // 5
    return early_stop_scan.scan_until(spark, path, "n_chars", target, wanted, ["doc_id", "n_chars", "source"])


@query("SELECT doc_id, n_chars * 2 AS score FROM documents")
def published_batches(spark, sf_dir):
    """Batches published one by one; a run that stops between writing and publishing is gone on with."""
    path, d = scratch(spark, "versions"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    schema = _length_scorer(d).schema

    def stop():
        raise InterruptedError

    for k in range(2):
        versions.add(_length_scorer(d.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == k)), path, str(k))
    try:
        versions.add(_length_scorer(d), path, "2", before_publish=stop)
    except InterruptedError:
        pass
    versions.run(d, path, "doc_id", 5, _length_scorer, compact=3)
    return versions.current(spark, path, schema)


@query("SELECT * FROM (VALUES ('known symbols', false), ('unknown symbol', true), ('enough rows', false), ('too few rows', true), ('strict encode', true)) AS v(what, failed)")
def fail_fast(spark, sf_dir):
    """Checks that fail the query where they should, and only there."""
    from pyspark.errors import PySparkException

    from ..functions import phonemes as ph

    n = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("t"))

    def failed(run) -> bool:
        try:
            run()
        except (PySparkException, ValueError):
            return True
        return False

    out = [
        ("known symbols", failed(lambda: gates.require(n, F.length("t") == 0, "empty").collect())),
        ("unknown symbol", failed(lambda: gates.require(n, F.size(ph.unknown_symbols("t")) > 0, "symbol").collect())),
        ("enough rows", failed(lambda: gates.require_rows(n, 25, "rows"))),
        ("too few rows", failed(lambda: gates.require_rows(n, 26, "rows"))),
        ("strict encode", failed(lambda: n.select(ph.encode("t", strict=True)).collect())),
    ]
    return spark.createDataFrame(out, "what string, failed boolean")


@query("SELECT source, row_number() OVER (ORDER BY avg(doc_id % 3), avg(n_chars % 2), source) AS place FROM documents GROUP BY source ORDER BY avg(doc_id % 3), avg(n_chars % 2), source LIMIT 12")
def gallery_order(spark, sf_dir):
    """O3: by the mean, then by a second mean, then by name; the first twelve."""
    d = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 3).alias("a"), (F.col("n_chars") % 2).alias("b"))
    first = stats.ranked_by_mean(d, "source", "a", "b", k=12)
    places = first.agg(F.array_sort(F.collect_list(F.struct("mean_a", "mean_b", "source"))).alias("x"))  # twelve rows
    return places.select(F.posexplode("x").alias("p", "r")).select("r.source", (F.col("p") + 1).cast("long").alias("place"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 17")
def head_of_order(spark, sf_dir):
    """O6."""
    return stats.head(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 17, F.desc("n_chars"), "doc_id")


@query("SELECT doc_id, printf('%.3f', n_chars / 7.0) AS three, printf('%.2f', n_chars / 7.0) AS two, printf('%.1f', n_chars / 7.0) AS one FROM documents")
def fixed_numbers(spark, sf_dir):
    """T20."""
    x = F.col("n_chars") / 7.0
    return table(spark, sf_dir, "documents").select("doc_id", text.fixed(x, 3).alias("three"), text.fixed(x, 2).alias("two"), text.fixed(x, 1).alias("one"))


@query("SELECT r_regionkey, input, output || ' vid ' || translate(lower(r_name), '_0123456789', ' abcdefghij') AS output FROM region, (VALUES ('Tid kl. 12 osv. slut', 'Tid klockan tolv och så vidare slut'), ('ca. 3 st. och ca 3 st', 'cirka tre stycken och cirka tre stycken')) AS v(input, output)")
def rules_longest_first(spark, sf_dir):
    """Longer abbreviations go before those that they begin with, before every region's name."""
    names = table(spark, sf_dir, "region").select("r_regionkey", F.translate(F.lower("r_name"), "_0123456789", " abcdefghij").alias("name"))
    rows = names.withColumn("input", F.explode(F.array(F.lit("Tid kl. 12 osv. slut"), F.lit("ca. 3 st. och ca 3 st"))))
    return rows.select("r_regionkey", "input", swedish.normalise(F.concat("input", F.lit(" vid "), "name")).alias("output"))


_MILLIONS = "CASE WHEN {0} < 1000 THEN " + _HUND.format("({0})") + " ELSE CASE WHEN {0} // 1000 = 1 THEN 'ettusen' ELSE " + _HUND.format("({0} // 1000)") + " || 'tusen' END || CASE WHEN {0} % 1000 > 0 THEN ' ' || " + _HUND.format("({0} % 1000)") + " ELSE '' END END"


@query(
    f"""WITH n AS (SELECT DISTINCT (o_orderkey * 7919 + 1000000) % 999999999 AS n FROM orders), l AS (SELECT {_LISTS}), p AS (SELECT *, n // 1000000 AS m, n % 1000000 AS r FROM n, l)
    SELECT n, CASE WHEN m = 0 THEN {_MILLIONS.format('n')} ELSE CASE WHEN m = 1 THEN 'en miljon' ELSE {_MILLIONS.format('m')} || ' miljoner' END || CASE WHEN r > 0 THEN ' ' || {_MILLIONS.format('r')} ELSE '' END END AS words FROM p WHERE n > 0"""
)
def large_numbers(spark, sf_dir):
    """T5, up to 999,999,999."""
    n = table(spark, sf_dir, "orders").select(((F.col("o_orderkey") * 7919 + 1_000_000) % 999_999_999).alias("n")).distinct().where("n > 0")
    return n.select("n", swedish.int_words("n").alias("words"))


def _tones(spark, sf_dir, rate: int, seconds: float, step: int = 10):
    n = table(spark, sf_dir, "nation").select("n_nationkey", (100 + step * F.col("n_nationkey")).cast("double").alias("f"))
    t = F.transform(F.sequence(F.lit(0), F.lit(int(rate * seconds) - 1)), lambda i: F.sin(2 * np.pi * F.col("f") * i / rate))
    return n.select("n_nationkey", "f", t.alias("x"), F.lit(rate).alias("sr"))


@query("SELECT n_nationkey, (100 + 10 * n_nationkey)::DOUBLE AS f0 FROM nation")
def pitch_of_tones(spark, sf_dir):
    """M2: the pitch of pure tones, to the nearest ten hertz."""
    return _tones(spark, sf_dir, 16000, 0.4).select("n_nationkey", (F.round(F.array_sort(sg.pitch("x", "sr"))[3] / 10) * 10).alias("f0"))


@query("SELECT n_nationkey, i, round(sin(2 * pi() * (100 + 10 * n_nationkey) * i / 4000.0), 6) + 0.0 AS x FROM nation, (SELECT unnest(range(0, 400, 40)) AS i)")
def resampled_tones(spark, sf_dir):
    """Tones of whole periods at 8 kHz, resampled to 4 kHz, are the same tones."""
    out = _tones(spark, sf_dir, 8000, 0.1).select("n_nationkey", F.posexplode(sg.resample_to(4000)("x", "sr")).alias("i", "x")).where("i % 40 = 0")
    return out.select("n_nationkey", F.col("i").cast("long").alias("i"), (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query("SELECT n_nationkey, abs(100 + 100 * n_nationkey - 1500) > 100 AS passes, n_nationkey = 14 AS stopped FROM nation WHERE n_nationkey < 25 AND (abs(100 + 100 * n_nationkey - 1500) > 100 OR n_nationkey = 14)")
def notched_tones(spark, sf_dir):
    """M9: a notch at 1500 Hz stops that tone and lets others pass."""
    t = _tones(spark, sf_dir, 8000, 0.4, 100)
    out = t.withColumn("y", sg.notch_at(1500.0)("x", "sr")).select("n_nationkey", (sg.rms(F.slice("y", 800, 1600)) / sg.rms(F.slice("x", 800, 1600))).alias("g"))
    return out.select("n_nationkey", (F.col("g") > 0.95).alias("passes"), (F.col("g") < 0.1).alias("stopped")).where("passes or stopped")


@query("SELECT doc_id, length(text) % 7 = 0 AS good FROM documents WHERE text IS NOT NULL")
def scored_clips(spark, sf_dir):
    """a scorer over whole batches, its model loaded once a task."""

    def loader():
        return lambda b: pd.DataFrame({"doc_id": b.doc_id, "good": b.n_chars % 7 == 0})

    return backends.score_clips(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "n_chars"), loader, "doc_id long, good boolean")


@query("SELECT lang, CASE lang WHEN 'en' THEN 'a' WHEN 'fr' THEN 'f' WHEN 'es' THEN 'e' ELSE 'unknown' END AS voice FROM (SELECT DISTINCT lang FROM documents)")
def routed_languages(spark, sf_dir):
    """each language's voice pipeline; the router refuses what it doesn't know."""

    def voice(lang):
        try:
            return backends.route(lang)
        except KeyError:
            return "unknown"

    known = [(x, voice(x)) for x in ("en", "fr", "es", "de")]
    return table(spark, sf_dir, "documents").select("lang").distinct().join(joins.small(readers.literal(spark, known, "lang string, voice string")), "lang")


@query("SELECT word, 'letters' AS backend, array_to_string(string_split(word, ''), ' ') AS ipa FROM (SELECT DISTINCT lower(n_name) AS word FROM nation)")
def g2p_backends(spark, sf_dir):
    """without a neural module "auto" falls back to the built-in with a warning."""
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        name = backends.resolve_g2p("auto")
    words = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("word")).distinct()
    return backends.g2p_fallback(name)(words).select("word", F.lit(name).alias("backend"), F.array_join("ipa", " ").alias("ipa"))


_PIECES = r"string_split(regexp_replace({0}, '([.!?…])[\s]+', '\1' || chr(1), 'g'), chr(1))"
_CLAUSES = r"string_split(regexp_replace({0}, '([,;:])[\s]+', '\1' || chr(1), 'g'), chr(1))"
_DOC_LINES = r"lines AS (SELECT doc_id, line - 1 AS line, trim(t) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE length(trim(t)) > 0)"


@query(f"WITH {_DOC_LINES}, p AS (SELECT unnest({_PIECES.format('t')}) AS s FROM lines) SELECT s AS piece, count(*) AS n, sum(len({_CLAUSES.format('s')}))::BIGINT AS clauses FROM p GROUP BY s")
def sentence_pieces(spark, sf_dir):
    """Pieces after sentence ends, and their clauses."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("t")).select(F.trim("t").alias("t")).where("length(t) > 0")
    s = lines.select(F.explode(text.split_sentences("t")).alias("piece"))
    return s.groupBy("piece").agg(F.count("*").alias("n"), F.sum(F.size(text.split_clauses("piece"))).alias("clauses"))


# neighbours joined where either is short and both fit; then overlong pieces gathered clause by clause: out chr(2) buffer
_JOINED = f"list_reduce(list_filter(list_transform({_PIECES.format('t')}, lambda x: trim(x)), lambda x: length(x) > 0), lambda a, p: CASE WHEN (length(list_last(string_split(a, chr(1)))) < 25 OR length(p) < 25) AND length(list_last(string_split(a, chr(1)))) + 1 + length(p) <= 150 THEN a || ' ' || p ELSE a || chr(1) || p END)"
_BUF, _OUT = "split_part(a, chr(2), 2)", "split_part(a, chr(2), 1)"
_FLUSH = f"CASE WHEN length({_BUF}) >= 10 THEN {_OUT} || chr(3) || {_BUF} ELSE {_OUT} END"
_PACKED = f"list_reduce(list_prepend(chr(2), {_CLAUSES.format('m')}), lambda a, s: CASE WHEN length({_BUF}) + length(s) + 1 <= 150 THEN {_OUT} || chr(2) || trim({_BUF} || ' ' || s) ELSE ({_FLUSH}) || chr(2) || s END)"


@query(
    f"""WITH {_DOC_LINES}, long AS (SELECT doc_id, line, unnest(string_split({_JOINED}, chr(1))) AS m, generate_subscripts(string_split({_JOINED}, chr(1)), 1) AS k FROM lines WHERE length(t) > 150),
    c AS (SELECT doc_id, line, k, {_PACKED} AS a FROM long WHERE length(m) > 150),
    f AS (SELECT doc_id, line, k, list_filter(string_split({_OUT} || CASE WHEN length({_BUF}) BETWEEN 10 AND 150 THEN chr(3) || {_BUF} ELSE '' END, chr(3)), lambda x: x <> '') AS xs FROM c)
    SELECT doc_id, line, t AS text FROM lines WHERE length(t) <= 150 UNION ALL SELECT doc_id, line, m FROM long WHERE length(m) BETWEEN 10 AND 150 UNION ALL SELECT doc_id, line, unnest(xs) FROM f"""
)
def packed_lines(spark, sf_dir):
    """Lines packed into pieces of 150 characters at most."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).select("doc_id", F.col("line").cast("long").alias("line"), F.trim("t").alias("t")).where("length(t) > 0")
    return lines.select("doc_id", "line", F.explode(folds.split_line("t")).alias("text"))


#: The same pieces, numbered within their line; the query is ``language.split_lines``.
SQL["split_lines"] = f"""WITH {_DOC_LINES}, long AS (SELECT doc_id, line, unnest(string_split({_JOINED}, chr(1))) AS m, generate_subscripts(string_split({_JOINED}, chr(1)), 1) AS k FROM lines WHERE length(t) > 150),
    c AS (SELECT doc_id, line, k, {_PACKED} AS a FROM long WHERE length(m) > 150),
    f AS (SELECT doc_id, line, k, list_filter(string_split({_OUT} || CASE WHEN length({_BUF}) BETWEEN 10 AND 150 THEN chr(3) || {_BUF} ELSE '' END, chr(3)), lambda x: x <> '') AS xs FROM c),
    p AS (SELECT doc_id, line, 0 AS k, 0 AS j, t AS text FROM lines WHERE length(t) <= 150 UNION ALL SELECT doc_id, line, k, 0, m FROM long WHERE length(m) BETWEEN 10 AND 150 UNION ALL SELECT doc_id, line, k, unnest(range(len(xs))), unnest(xs) FROM f)
    SELECT doc_id, line::INT AS line, (row_number() OVER (PARTITION BY doc_id, line ORDER BY k, j) - 1)::INT AS piece, text FROM p"""


@query(
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events WHERE ts IS NOT NULL),
    w(user_id, k, s, e, os, oe) AS (SELECT user_id, k, s, s + 600, NULL::DOUBLE, NULL::DOUBLE FROM e WHERE k = 1
        UNION ALL SELECT w.user_id, n.k, CASE WHEN n.s + 600 - w.s <= 43200 THEN w.s ELSE n.s END, n.s + 600, CASE WHEN n.s + 600 - w.s <= 43200 THEN NULL ELSE w.s END, CASE WHEN n.s + 600 - w.s <= 43200 THEN NULL ELSE w.e END FROM w JOIN e n ON n.user_id = w.user_id AND n.k = w.k + 1),
    c AS (SELECT user_id, os AS s, oe AS e FROM w WHERE os IS NOT NULL UNION ALL SELECT user_id, s, e FROM (SELECT *, max(k) OVER (PARTITION BY user_id) AS top FROM w) WHERE k = top)
    SELECT user_id, s, e FROM c WHERE e - s >= 3600"""
)
def merged_bursts(spark, sf_dir):
    """A user's bursts of events merged greedily, 12 hours at most, 1 hour at least."""
    from .audio import QUERIES as audio

    return audio["interval_merge"](spark, sf_dir)


#: The same rows under their earlier name.
SQL["interval_merge"] = SQL["merged_bursts"]

_X = "list_transform(embedding, lambda v: v::DOUBLE)"
_RMS = "sqrt(list_aggregate(list_transform({0}, lambda v: v * v), 'sum') / len({0}))"
_PEAK = "list_aggregate(list_transform({0}, lambda v: abs(v)), 'max')"


@query(
    f"""WITH x AS (SELECT vec_id, {_X} AS x FROM embeddings), l AS (SELECT *, {_RMS.format('x')} AS r, {_PEAK.format('x')} AS p FROM x),
    k AS (SELECT *, x[1:56] AS c FROM l), w AS (SELECT *, [{_RMS.format('c[1:16]')}, {_RMS.format('c[17:32]')}, {_RMS.format('c[33:48]')}] AS env FROM k),
    q AS (SELECT *, list_aggregate(env, 'max') * pow(10, -1.5) AS lim FROM w)
    SELECT vec_id, round(r * least(pow(10, (-23 - 20 * log10(r + 1e-9)) / 20), 0.99 / greatest(p, 1e-9)), 9) AS rms, round(p * 0.9 / greatest(p, 1e-9), 9) AS peak,
    least(56, (CASE WHEN env[3] > lim THEN 3 WHEN env[2] > lim THEN 2 ELSE 1 END) * 16 + 32)::INT AS kept FROM q"""
)
def vector_levels(spark, sf_dir):
    """Level, peak and trimmed tail of each vector as a signal."""
    from .audio import QUERIES as audio

    return audio["normalised_levels"](spark, sf_dir).select("vec_id", F.round("rms", 9).alias("rms"), F.round("peak", 9).alias("peak"), "kept")


SQL["normalised_levels"] = SQL["vector_levels"]


@query(
    """SELECT vec_id, round(list_aggregate(list_transform(embedding, lambda v: v::DOUBLE), 'sum') + list_aggregate(list_transform(embedding[1:36], lambda v: v::DOUBLE), 'sum'), 6) AS tiled,
    round(list_aggregate(list_transform(embedding, lambda v: v::DOUBLE), 'sum'), 6) AS padded, i, round(list_aggregate(list_transform(embedding[i * 8 + 1:i * 8 + 16], lambda v: v::DOUBLE), 'sum'), 6) AS win FROM embeddings, (SELECT unnest(range(7)) AS i)"""
)
def window_values(spark, sf_dir):
    """What padding, tiling and overlapping windows hold."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    rows = e.select("vec_id", F.round(total(sg.tile("x", 100)), 6).alias("tiled"), F.round(total(sg.pad_tail("x", 16)), 6).alias("padded"), F.posexplode(sg.windows("x", 16, 8)).alias("i", "w"))
    return rows.select("vec_id", "tiled", "padded", F.col("i").cast("long").alias("i"), F.round(total(F.col("w")), 6).alias("win"))


# a signal of 256 (or 2049) values a region and its transforms, written out as sums
_REGION = "sig AS (SELECT r_regionkey AS k, i, sin(0.05 * (r_regionkey + 1) * i) + 0.4 * cos(0.9 * i + r_regionkey) + ((i * (7 + r_regionkey)) % 11) / 20.0 AS x FROM region, (SELECT unnest(range({0})) AS i))"


def _region_signals(spark, sf_dir, n: int, rate: int):
    k = F.col("r_regionkey")
    x = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sin(0.05 * (k + 1) * i) + 0.4 * F.cos(0.9 * i + k) + ((i * (7 + k)) % 11) / 20.0)
    return table(spark, sf_dir, "region").select(k.alias("k"), x.alias("x"), F.lit(rate).alias("sr"))


@query(
    f"""WITH {_REGION.format(512)}, h AS (SELECT k, i, x * (0.5 - 0.5 * cos(2 * pi() * i / 511)) AS x FROM sig),
    s AS (SELECT k, f, sqrt(sum(x * cos(2 * pi() * f * i / 512)) ** 2 + sum(x * sin(2 * pi() * f * i / 512)) ** 2) AS a FROM h, (SELECT unnest(range(257)) AS f) GROUP BY k, f)
    SELECT k, round(sum(a) FILTER (f * 24000 / 512.0 > 4000 AND f * 24000 / 512.0 < 10000) / (sum(a) FILTER (f * 24000 / 512.0 > 100 AND f * 24000 / 512.0 < 4000) + 1e-9), 6) AS bands FROM s GROUP BY k"""
)
def band_energies(spark, sf_dir):
    """M8: against a Fourier transform written out as sums."""
    return _region_signals(spark, sf_dir, 512, 24000).select("k", F.round(sg.band_ratio("x", "sr"), 6).alias("bands"))


@query(
    f"""WITH {_REGION.format(300)}, en AS (SELECT a.k, a.i AS peak, sum(b.x * b.x) AS e FROM sig a JOIN sig b ON a.k = b.k AND b.i >= a.i AND b.i < a.i + 250 WHERE a.i <= 50 GROUP BY ALL),
    best AS (SELECT k, arg_max(peak, e) AS peak FROM en GROUP BY k), h AS (SELECT sig.k, i - peak AS i, x * (0.5 - 0.5 * cos(2 * pi() * (i - peak) / 250)) AS x FROM sig JOIN best ON sig.k = best.k AND i >= peak AND i < peak + 250),
    s AS (SELECT k, f, ln(sqrt(sum(x * cos(2 * pi() * f * i / 256)) ** 2 + sum(x * sin(2 * pi() * f * i / 256)) ** 2) + 1e-9) AS a FROM h, (SELECT unnest(range(129)) AS f) GROUP BY k, f),
    c AS (SELECT k, q, sum(a * cos(2 * pi() * f * q / 256) * CASE WHEN f IN (0, 128) THEN 1 ELSE 2 END) / 256 AS v FROM s, (SELECT unnest(range(256)) AS q) GROUP BY k, q)
    SELECT k, round(max(v) FILTER (q > 18 AND q < 120) / max(v) FILTER (q > 2 AND q < 12.5), 6) AS echo FROM c GROUP BY k"""
)
def echo_ratios(spark, sf_dir):
    """M7: against a cepstrum written out as sums, at 1 kHz."""
    return _region_signals(spark, sf_dir, 300, 1000).select("k", F.round(sg.echo_ratio("x", "sr"), 6).alias("echo"))


@query(
    f"""WITH {_REGION.format(2049)}, h AS (SELECT k, i, x * (0.5 - 0.5 * cos(2 * pi() * i / 2047)) AS x FROM sig WHERE i < 2048),
    s AS (SELECT k, f, ln(sqrt(sum(x * cos(2 * pi() * ((f * i) % 2048) / 2048)) ** 2 + sum(x * sin(2 * pi() * ((f * i) % 2048) / 2048)) ** 2) + 1e-9) AS a FROM h, (SELECT unnest(range(1025)) AS f) GROUP BY k, f),
    c AS (SELECT k, q, abs(sum(a * cos(2 * pi() * ((f * q) % 2048) / 2048) * CASE WHEN f IN (0, 1024) THEN 1 ELSE 2 END) / 2048) AS v FROM s, (SELECT unnest(range(40)) AS q) GROUP BY k, q)
    SELECT k, round(greatest(max(v) FILTER (q BETWEEN 11.7 AND 13.3), max(v) FILTER (q BETWEEN 24.2 AND 25.8)) / (max(v) FILTER (q BETWEEN 2.5 AND 12) + 1e-9), 6) AS comb FROM c GROUP BY k"""
)
def comb_scores(spark, sf_dir):
    """M6: against a cepstrum written out as sums, at 1 kHz."""
    return _region_signals(spark, sf_dir, 2049, 1000).select("k", F.round(sg.comb_score("x", "sr"), 6).alias("comb"))

"""Queries over manifests: statistics, gates, joins, budgets, splits, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, joins, sampling, sets, stats
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


HASH = "md5(concat_ws('|', '1337', {0}::VARCHAR))"
TICKET = "least(md5(concat_ws('|', '1337', {0}::VARCHAR, '0')), md5(concat_ws('|', '1337', {0}::VARCHAR, '1')))"
ONE_TICKET = "md5(concat_ws('|', '1337', {0}::VARCHAR, '0'))"
WEIGHTS = {"en": 0.4, "fr": 0.2, "de": 0.3, "es": 0.1}
TOTAL = 300_000


@query(
    f"""WITH {CLIPS_SQL}, t AS (SELECT *, CASE WHEN n > 0 THEN {TICKET.format('clip_id')} ELSE {ONE_TICKET.format('clip_id')} END AS ticket
    FROM (SELECT *, CASE WHEN chars % 3 = 0 THEN 1 ELSE 0 END AS n FROM clips WHERE chars BETWEEN 22 AND 18000 AND (quality_score IS NULL OR quality_score >= 0.5))),
    w AS (SELECT * FROM (VALUES ('en', 0.4::DOUBLE), ('fr', 0.2::DOUBLE), ('de', 0.3::DOUBLE), ('es', 0.1::DOUBLE)) AS v(ds, share)),
    r AS (SELECT t.*, share, coalesce(sum(chars) OVER (PARTITION BY dataset ORDER BY ticket, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t JOIN w ON ds = dataset)
    SELECT dataset, count(*) AS clips, sum(chars)::BIGINT AS chars, count(DISTINCT speaker_id) AS speakers FROM r WHERE before < share * {TOTAL} GROUP BY dataset"""
)
def manifest_mix(spark, sf_dir):
    """The weighted mix, by dataset."""
    pool = clips(spark, sf_dir).where(F.col("chars").between(22, 18000) & (F.col("quality_score").isNull() | (F.col("quality_score") >= 0.5)))
    out = sampling.weighted_mix(pool, WEIGHTS, TOTAL, F.col("chars") % 3 == 0, "chars")
    return out.groupBy("dataset").agg(F.count("*").alias("clips"), F.sum("chars").alias("chars"), F.countDistinct("speaker_id").alias("speakers"))


@query(f"WITH {CLIPS_SQL} SELECT count(*) AS clips, sum(chars)::BIGINT AS chars, count(DISTINCT speaker_id) AS speakers, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets, round(sum(chars) / 3600, 2) AS hours FROM clips")
def manifest_stats(spark, sf_dir):
    """A1; a character counts as a second."""
    return stats.manifest_stats(clips(spark, sf_dir), seconds="chars", extra=[F.sum("chars").alias("chars")])


@query(f"WITH {CLIPS_SQL} SELECT dataset, count(*) AS clips, count(DISTINCT speaker_id) AS speakers, sum(chars)::BIGINT AS chars, max(chars) AS longest FROM clips GROUP BY dataset")
def manifest_stats_by_dataset(spark, sf_dir):
    """A1, A2."""
    return clips(spark, sf_dir).groupBy("dataset").agg(F.count("*").alias("clips"), F.countDistinct("speaker_id").alias("speakers"), F.sum("chars").alias("chars"), F.max("chars").alias("longest"))


@query(f"WITH {CLIPS_SQL} SELECT clip_id, speaker_id, quality_score FROM clips WHERE chars BETWEEN 23 AND 180 * 15 AND (quality_score IS NULL OR quality_score >= 0.5)")
def null_passes_quality(spark, sf_dir):
    """P1, P3."""
    return clips(spark, sf_dir).where(gates.in_range_or_unknown("chars", "quality_score", 23, 180 * 15, 0.5)).select("clip_id", "speaker_id", "quality_score")


@query(f"WITH {CLIPS_SQL} SELECT clip_id, chars FROM clips WHERE quality_score >= 1 AND chars BETWEEN 15 AND 1800")
def speaker_gate(spark, sf_dir):
    """P2."""
    return clips(spark, sf_dir).where(gates.speaker_gate("chars", "quality_score", 1.0, 15, 1800)).select("clip_id", "chars")


@query("SELECT conv_id, turn, length(text) AS n FROM conversations WHERE length(text) >= 80 AND role = 'assistant'")
def long_turns_of_role(spark, sf_dir):
    """P4, P5."""
    labels = {"user": 0, "assistant": 1, "system": 2}
    number = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    c = table(spark, sf_dir, "conversations").withColumn("label", F.try_element_at(number, F.col("role")))
    return c.where(gates.long_enough("text", 80) & gates.by_label("label", labels, "assistant")).select("conv_id", "turn", F.length("text").alias("n"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.' || json_keys(props)[1]) AS DOUBLE) AS number FROM events WHERE try_cast(json_extract_string(props, '$.' || json_keys(props)[1]) AS DOUBLE) IS NOT NULL")
def cast_or_drop(spark, sf_dir):
    """The first property of an event, where it is a number."""
    e = table(spark, sf_dir, "events").withColumn("keys", F.json_object_keys("props"))
    first = e.select("event_id", F.expr("try_element_at(from_json(props, 'map<string,string>'), try_element_at(keys, 1))").alias("number"))
    return gates.cast_or_drop(first, "number")


@query(
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n_chars < 600 THEN 'too_short' WHEN n_chars > 9000 THEN 'too_long' WHEN (doc_id % 101) / 100.0::DOUBLE > 0.999 THEN 'clipping'
    WHEN (doc_id % 101) / 100.0::DOUBLE < 0.02 THEN 'silent' WHEN (doc_id % 11) / 10.0::DOUBLE < 0.3 THEN 'low_speech_ratio' ELSE '?' END AS reason FROM documents) GROUP BY reason"""
)
def reject_reason(spark, sf_dir):
    """P7, A5."""
    d = table(spark, sf_dir, "documents")
    reason = gates.reject_reason(F.col("n_chars") / 600, (F.col("doc_id") % 101) / 100.0, (F.col("doc_id") % 11) / 10.0)
    return stats.class_counts(d, reason, "reason")


_QC = """qc AS (SELECT conv_id, turn, (length(text) % 40) / 100.0::DOUBLE AS cer, 2.0 + (length(text) % 20) / 10.0::DOUBLE AS mos, (length(text) % 35)::DOUBLE AS rate, (turn % 5)::DOUBLE AS tail FROM conversations),
    fl AS (SELECT *, list_filter([CASE WHEN cer > 0.15 THEN 'cer' END, CASE WHEN mos < 2.6 THEN 'dnsmos' END, CASE WHEN NOT (rate BETWEEN 6 AND 30) THEN 'rate' END, CASE WHEN tail > 2 THEN 'tail' END], lambda x: x IS NOT NULL) AS flags FROM qc)"""


def _qc(spark, sf_dir):
    n = F.length("text")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", ((n % 40) / 100.0).alias("cer"), (2.0 + (n % 20) / 10.0).alias("mos"), (n % 35).cast("double").alias("rate"), (F.col("turn") % 5).cast("double").alias("tail"))
    return c.withColumn("flags", gates.qc_flags("cer", "mos", "rate", "tail"))


@query(f"WITH {_QC} SELECT conv_id, turn, array_to_string(flags, '+') AS flags FROM fl")
def qc_flags(spark, sf_dir):
    """P8, P9."""
    return _qc(spark, sf_dir).select("conv_id", "turn", gates.flags_text(F.col("flags")).alias("flags"))


@query(f"WITH {_QC} SELECT f AS reason, count(*) AS n FROM (SELECT unnest(flags) AS f FROM fl) GROUP BY f")
def qc_reason_histogram(spark, sf_dir):
    """A9."""
    return stats.symbol_counts(_qc(spark, sf_dir), F.col("flags"), "reason")


@query(f"WITH {_QC} SELECT count(*) AS scored, count(*) FILTER (len(flags) > 0) AS failing, count(*) FILTER (len(flags) > 0)::DOUBLE / greatest(count(*), 1) AS share FROM fl")
def qc_failure_rate(spark, sf_dir):
    """A10."""
    return stats.failure_rate(_qc(spark, sf_dir), F.col("flags"))


@query(f"WITH {_QC} SELECT conv_id, turn, least(mos / 5.0, 1.0) * (1 - least(cer, 1.0)) AS quality, cer <= 0.15 AND mos >= 2.6 AS pass, -0.06766283 * mos * mos + 1.11546468 * mos + 0.04602535 AS mapped FROM fl")
def composite_quality(spark, sf_dir):
    """P13, P14."""
    return _qc(spark, sf_dir).select("conv_id", "turn", gates.composite("mos", "cer").alias("quality"), gates.passes("mos", "cer").alias("pass"), gates.mos_of_raw("mos").alias("mapped"))


@query(
    """SELECT class, count(*) AS n FROM (SELECT CASE WHEN user_id % 7 = 0 THEN 'neutral' WHEN rtrim(event_type) LIKE '%?' THEN 'frågande' WHEN value / 20 > 8.6 AND value / 100 > 1.0 * 0.8 THEN 'expressiv'
    WHEN value / 20 > 8.1 THEN 'energisk' WHEN user_id % 10 > 8.2 THEN 'snabb' WHEN user_id % 10 < 5.5 OR (event_id % 100) / 100.0::DOUBLE > 0.65 THEN 'långsam' ELSE 'neutral' END AS class FROM events) GROUP BY class"""
)
def prosody_classes(spark, sf_dir):
    """P10, A5."""
    e = table(spark, sf_dir, "events")
    p = F.struct((F.col("value") / 20).alias("f0_std"), (F.col("value") / 100).alias("energy_std"), F.lit(1.0).alias("energy_mean"), (F.col("user_id") % 10).cast("double").alias("speech_rate"), ((F.col("event_id") % 100) / 100.0).alias("pause_ratio"))
    e = e.withColumn("p", F.when(F.col("user_id") % 7 != 0, p))
    return stats.class_counts(e.withColumn("class", gates.prosody_class("p", "event_type")), "class")


@query(
    """SELECT source, mean_cer, mean_mos, mean_comb, n, CASE WHEN mean_cer > 0.2 THEN 'FAIL-intelligibility' WHEN mean_mos < 2.5 THEN 'FAIL-quality' WHEN mean_comb < 1.2 THEN 'ok (comb low)' ELSE 'ok (comb audible)' END AS verdict
    FROM (SELECT source, avg((n_chars % 8) / 16.0::DOUBLE) AS mean_cer, avg((n_chars % 16) / 4.0::DOUBLE) AS mean_mos, avg((n_chars % 4)::DOUBLE) AS mean_comb, count(*) AS n FROM documents GROUP BY source)"""
)
def eval_rollup(spark, sf_dir):
    """Metrics are sixteenths, so means are exact."""
    n = F.col("n_chars")
    d = table(spark, sf_dir, "documents").select("source", ((n % 8) / 16.0).alias("cer"), ((n % 16) / 4.0).alias("mos"), (n % 4).cast("double").alias("comb"))
    return stats.means(d, "source", "cer", "mos", "comb").withColumn("verdict", gates.verdict("mean_cer", "mean_mos", "mean_comb"))


@query("SELECT doc_id, cer FROM (SELECT doc_id, n_chars % 97 AS cer FROM documents) ORDER BY cer, doc_id LIMIT 1")
def best_checkpoint(spark, sf_dir):
    """A13."""
    return stats.argmin(table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 97).alias("cer")), "cer", "doc_id")


@query("SELECT user_id, a, b, b - a AS delta, (b - a) > 0.8 AS responsive FROM (SELECT user_id, max(value) FILTER (event_type = (SELECT min(event_type) FROM events)) AS a, max(value) FILTER (event_type = (SELECT max(event_type) FROM events)) AS b FROM events GROUP BY user_id) WHERE a IS NOT NULL AND b IS NOT NULL")
def paired_systems(spark, sf_dir):
    """Two event types as two systems on the same user."""
    e = table(spark, sf_dir, "events")
    lo, hi = e.agg(F.min("event_type"), F.max("event_type")).first()
    return joins.paired(e, "event_type", lo, hi, "user_id", "value").withColumn("responsive", gates.responsive("a", "b"))


@query(f"WITH {CLIPS_SQL}, t AS (SELECT speaker_id, sum(chars)::BIGINT AS total, count(*) AS n, min(clip_id) AS first_pos FROM clips GROUP BY speaker_id HAVING sum(chars) >= 90 * 15) SELECT * FROM t ORDER BY total DESC, first_pos LIMIT 10")
def speaker_having_top(spark, sf_dir):
    """A2, A3, O2."""
    return stats.top_keys(clips(spark, sf_dir), "speaker_id", "chars", "clip_id", 90 * 15, 10)


@query(f"WITH {CLIPS_SQL}, b AS (SELECT speaker_id FROM clips GROUP BY speaker_id ORDER BY sum(chars) DESC, min(clip_id) LIMIT 1) SELECT clip_id, speaker_id, chars FROM clips WHERE speaker_id IN (SELECT speaker_id FROM b)")
def best_speaker_rows(spark, sf_dir):
    """A4."""
    return stats.argmax_rows(clips(spark, sf_dir), "speaker_id", "chars", "clip_id").select("clip_id", "speaker_id", "chars")


@query("SELECT max(doc_id) AS max_index, max(length(text)) AS max_length, avg(length(text)) AS avg_length FROM documents")
def length_stats(spark, sf_dir):
    """A14."""
    return stats.length_stats(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT DISTINCT source AS speaker_id, lang AS dataset FROM documents")
def distinct_speakers(spark, sf_dir):
    """A15, U5."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("speaker_id"), F.col("lang").alias("dataset")).distinct()


@query("SELECT c_nationkey, avg(c_acctbal) AS mean_balance, median(c_acctbal) AS median_balance FROM customer GROUP BY c_nationkey")
def mean_and_median(spark, sf_dir):
    """A11."""
    c = table(spark, sf_dir, "customer")
    middle = stats.medians(c, "c_nationkey", "c_acctbal").select(F.col("c_nationkey").alias("k"), F.col("median").alias("median_balance"))
    means = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean_balance"))
    return means.join(middle, F.col("c_nationkey").eqNullSafe(F.col("k")), "left").drop("k")


_ORDERED = "row_number() OVER (ORDER BY " + HASH.format("clip_id") + ", clip_id)"


@query(f"WITH {CLIPS_SQL}, r AS (SELECT clip_id, chars, coalesce(sum(chars) OVER (ORDER BY {HASH.format('clip_id')}, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM clips) SELECT clip_id, chars FROM r WHERE before < 500000")
def running_budget(spark, sf_dir):
    """W1, O1."""
    c = clips(spark, sf_dir).withColumn("key", sampling.shuffle_key("clip_id"))
    return sampling.take_budget(c, "chars", 500_000, sampling.hash_bucket("key"), ["key", "clip_id"]).select("clip_id", "chars")


@query(
    f"""WITH {CLIPS_SQL}, s AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY speaker_id ORDER BY clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own FROM clips),
    g AS (SELECT *, coalesce(sum(chars) OVER (ORDER BY clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s WHERE own <= 100000) SELECT clip_id, speaker_id, chars FROM g WHERE before < 600000"""
)
def capped_budget(spark, sf_dir):
    """W1, W2."""
    return sampling.take_capped(clips(spark, sf_dir), "speaker_id", "chars", 100_000, 600_000, sampling.id_bucket("clip_id"), ["clip_id"]).select("clip_id", "speaker_id", "chars")


@query(f"WITH {CLIPS_SQL}, r AS (SELECT clip_id, {_ORDERED} - 1 AS pos FROM clips) SELECT clip_id, CASE WHEN pos < 200 THEN 'val' ELSE 'train' END AS split FROM r")
def train_val_split(spark, sf_dir):
    """U4, O1."""
    return sampling.split(clips(spark, sf_dir), 200).select("clip_id", "split")


@query(f"WITH {CLIPS_SQL} SELECT clip_id, row_number() OVER (ORDER BY clip_id) - 1 AS seq FROM clips WHERE chars >= 1000")
def sequence_ids(spark, sf_dir):
    """Numbers of the rows that were kept."""
    return sampling.sequence_ids(clips(spark, sf_dir).where("chars >= 1000"), sampling.id_bucket("clip_id"), ["clip_id"]).select("clip_id", "seq")


@query(f"WITH {CLIPS_SQL} SELECT clip_id, dense_rank() OVER (ORDER BY speaker_id) - 1 AS speaker_index FROM clips")
def speaker_index(spark, sf_dir):
    """J13."""
    return joins.dense_index(clips(spark, sf_dir), "speaker_id").select("clip_id", "speaker_index")


@query(f"WITH {CLIPS_SQL} SELECT speaker_id, clip_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY clip_id) AS rn FROM clips) WHERE rn <= 5")
def first_n_per_speaker(spark, sf_dir):
    """W3."""
    return sampling.first_n(clips(spark, sf_dir), "speaker_id", ["clip_id"], 5).select("speaker_id", "clip_id", "rn")


@query(f"WITH {CLIPS_SQL}, k AS (SELECT speaker_id FROM clips GROUP BY speaker_id ORDER BY min(clip_id) LIMIT 10) SELECT speaker_id, clip_id FROM (SELECT c.*, row_number() OVER (PARTITION BY speaker_id ORDER BY clip_id) AS rn FROM clips c WHERE speaker_id IN (SELECT speaker_id FROM k)) WHERE rn <= 5")
def smoke_subset(spark, sf_dir):
    """The first five rows of the ten first-seen speakers."""
    return sampling.first_keys(clips(spark, sf_dir), "speaker_id", "clip_id", 10, 5).select("speaker_id", "clip_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def anti_incremental(spark, sf_dir):
    """J2, J3, U3."""
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.exclude(table(spark, sf_dir, "orders"), done, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def existing_files(spark, sf_dir):
    """Rows whose key is in a listing."""
    listed = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.existing(table(spark, sf_dir, "orders"), listed, "o_orderkey").select("o_orderkey", "o_totalprice")


@query(
    """WITH main AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), shard AS (SELECT o_orderkey + 900000 AS o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0)
    SELECT * FROM main UNION ALL SELECT * FROM shard WHERE o_orderkey NOT IN (SELECT o_orderkey FROM main)"""
)
def merge_idempotent(spark, sf_dir):
    """Merged twice; the second time adds nothing."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    main, shard = o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 = 0")
    return sets.merge_keyed(sets.merge_keyed(main, shard, "o_orderkey"), shard, "o_orderkey")


@query("SELECT text, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedupe_first(spark, sf_dir):
    """W13."""
    return sampling.dedupe_first(table(spark, sf_dir, "documents").select("text", "doc_id"), "text", "doc_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1")
def last_wins(spark, sf_dir):
    """J11."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return joins.last_wins(li, "l_orderkey", F.struct("l_linenumber", "l_quantity"))


@query("SELECT d.doc_id, d.source, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def rows_with_results(spark, sf_dir):
    """J4."""
    return joins.with_results(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "doc_id")


NAMES = [("src0", "Alva", "F", "narrator"), ("src1", "Bo", "M", None), ("src2", "Cilla", "F", None), ("src9", "Disa", "F", "news"), ("nobody", "Egil", "M", None)]
_NAMES_SQL = "names AS (SELECT * FROM (VALUES ('src0', 'Alva', 'F', 'narrator'), ('src1', 'Bo', 'M', NULL), ('src2', 'Cilla', 'F', NULL), ('src9', 'Disa', 'F', 'news'), ('nobody', 'Egil', 'M', NULL)) AS v(speaker_id, name, gender, role))"


@query(f"WITH {_NAMES_SQL} SELECT d.doc_id, coalesce(n.name, d.source) AS name, coalesce(n.role, '-') AS role FROM documents d LEFT JOIN names n ON n.speaker_id = d.source")
def voice_lookup_default(spark, sf_dir):
    """J5, D15."""
    names = spark.createDataFrame(NAMES, "speaker_id string, name string, gender string, role string")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("speaker_id"))
    return joins.lookup(d, names, "speaker_id").select("doc_id", F.coalesce("name", "speaker_id").alias("name"), F.coalesce("role", F.lit("-")).alias("role"))


@query(f"WITH {_NAMES_SQL} SELECT n.name, count(d.doc_id) AS clips, count(d.doc_id) = 0 AS missing FROM names n LEFT JOIN documents d ON n.speaker_id = d.source GROUP BY n.name")
def requested_names(spark, sf_dir):
    """Requested names with their clips, misses reported."""
    names = spark.createDataFrame(NAMES, "speaker_id string, name string, gender string, role string")
    per = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("speaker_id")).agg(F.count("*").alias("n"))
    return names.join(per, "speaker_id", "left").select("name", F.coalesce("n", F.lit(0)).alias("clips"), F.col("n").isNull().alias("missing"))


@query("SELECT n_name, mood FROM nation CROSS JOIN (VALUES ('glad'), ('lugn'), ('arg'), ('neutral')) AS m(mood)")
def voice_mood_cross(spark, sf_dir):
    """J8, D17."""
    return joins.every_pair(table(spark, sf_dir, "nation").select("n_name"), ["glad", "lugn", "arg", "neutral"], "mood")


@query("SELECT s_suppkey, 'clip_' || lpad(s_suppkey::VARCHAR, 6, '0') AS name, left(regexp_replace(regexp_replace(s_name, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) AS safe, s_suppkey % 4 = 1 AS mine, contains(lower(s_name), lower('000001')) AS found FROM supplier")
def derived_names(spark, sf_dir):
    """P16, P17, P19, T19."""
    from ..functions.text import padded_id, safe_name

    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", padded_id("s_suppkey", "clip_").alias("name"), safe_name("s_name").alias("safe"), gates.stripe("s_suppkey", 4, 1).alias("mine"), gates.contains_ignoring_case("s_name", "000001").alias("found"))


@query("SELECT user_id, a.pos, a.v AS left_value, b.v AS right_value FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_id AS v FROM events WHERE value > 100) a JOIN (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_id AS v FROM events WHERE value <= 10) b USING (user_id) WHERE a.pos = b.pos")
def positional_pairs(spark, sf_dir):
    """The i-th loud event of a user with the i-th quiet one."""
    e = table(spark, sf_dir, "events")
    a = e.where("value > 100").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("x"))
    b = e.where("value <= 10").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("y"))
    return joins.positional(a, b, "user_id", "x", "y").select("user_id", F.col("pos").cast("long").alias("pos"), "left_value", "right_value")


@query("SELECT source, CASE WHEN old THEN 'nst_' ELSE 'libri_Unknown - ' END || source AS id, CASE WHEN old THEN 'NST ' ELSE 'Libri ' END || source AS label FROM (SELECT DISTINCT source, regexp_matches(source, '[02468]$') AS old FROM documents)")
def speaker_labels(spark, sf_dir):
    """P21."""
    old = F.col("source").rlike("[02468]$")
    s = table(spark, sf_dir, "documents").select("source").distinct().withColumn("id", F.concat(F.when(old, "nst_").otherwise("libri_Unknown - "), "source"))
    return s.withColumn("label", gates.speaker_label("id"))


@query("SELECT doc_id, coalesce(n_chars / nullif((doc_id % 4)::DOUBLE, 0), 0) AS rate, n_chars BETWEEN 1 AND 400 AS fits FROM documents")
def derived_rates(spark, sf_dir):
    """P15, P20."""
    return table(spark, sf_dir, "documents").select("doc_id", gates.rate("n_chars", (F.col("doc_id") % 4).cast("double")).alias("rate"), gates.phoneme_length_ok("text").alias("fits"))

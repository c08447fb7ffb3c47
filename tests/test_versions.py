import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heronry.operators import sampling
from heronry.sources import early_stop, versions
from heronry.streaming import incremental


def read_bytes(spark):
    """Bytes that this JVM has read from local files."""
    stats = spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics()
    return sum(s.getBytesRead() for s in stats if s.getScheme() == "file")


@pytest.fixture
def shards(spark, tmp_path):
    path = f"{tmp_path}/shards"
    rows = spark.range(8000).select(F.col("id").alias("i"), (F.col("id") % 7 + 1).alias("v"), F.sha2(F.col("id").cast("string"), 512).alias("payload"))
    rows.repartitionByRange(16, "i").sortWithinPartitions("i").write.parquet(path)
    return path, spark.read.parquet(path)


@pytest.mark.parametrize("target", [0, 1, 2, 1999, 4000, 4001, 31_999, 10**9])
def test_same_rows_as_the_budget(spark, shards, target):
    path, rows = shards
    for where in (None, F.col("i") % 3 == 1):
        want = sampling.take_budget(rows if where is None else rows.where(where), "v", target, sampling.id_bucket("i"), ["i"])
        got = early_stop.scan_until(spark, path, "v", target, where, ["i", "payload"])
        assert got.columns == ["i", "payload"]
        assert sorted(r["i"] for r in got.collect()) == sorted(r["i"] for r in want.collect())


def test_reads_payload_up_to_the_crossing(spark, shards):
    """A budget met in the third of 16 files: what is read is a small share of the payload."""
    path, rows = shards
    rows.select("v").agg(F.sum("v")).collect()
    at = read_bytes(spark)
    rows.write.format("noop").mode("overwrite").save()
    whole = read_bytes(spark) - at
    got = early_stop.scan_until(spark, path, "v", 5000)
    at = read_bytes(spark)
    got.write.format("noop").mode("overwrite").save()
    assert read_bytes(spark) - at < 0.3 * whole
    assert got.count() < 1500


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "v long, p string").write.parquet(f"{tmp_path}/none")
    assert early_stop.scan_until(spark, f"{tmp_path}/none", "v", 5).count() == 0
    spark.createDataFrame([(None, "a"), (3, "b")], "v long, p string").coalesce(1).write.parquet(f"{tmp_path}/nulls")
    assert [r["p"] for r in early_stop.scan_until(spark, f"{tmp_path}/nulls", "v", 2).collect()] == ["a", "b"]


def test_killed_between_write_and_publish(spark, tmp_path):
    path, rows = f"file://{tmp_path}/out", spark.range(1000).withColumnRenamed("id", "k")
    schema = StructType.fromDDL("k long, twice long")
    work = lambda df: df.withColumn("twice", F.col("k") * 2)
    calls = []

    def killed():
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        versions.run(rows, path, "k", 6, work, before_publish=killed)
    part = versions.current(spark, path, schema)
    assert versions.state(spark, path)["batches"] == ["0", "1"]
    assert 0 < part.count() < 1000 and part.distinct().count() == part.count()  # whole batches, none twice
    assert versions.run(rows, path, "k", 6, work, compact=3) == 4
    assert versions.run(rows, path, "k", 6, work) == 0
    assert sorted(map(tuple, versions.current(spark, path, schema).collect())) == [(i, 2 * i) for i in range(1000)]
    # a reader of an old version goes on; what no pointer names can be deleted
    assert part.count() > 0
    assert versions.sweep(spark, path) >= 1 and versions.current(spark, path, schema).count() == 1000


def test_nothing_published(spark, tmp_path):
    assert versions.current(spark, f"file://{tmp_path}/none", StructType.fromDDL("k long")).count() == 0


def test_stream_keeps_its_keys(spark, tmp_path):
    """Keys are state of the stream: a shard that comes again adds nothing, even with the report out of reach."""
    source, report, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "report", "state"))
    schema = StructType.fromDDL("k long, v long")
    scored = []

    def scorer(df):
        scored.append(df.count())
        return df

    def go():
        incremental.score_stream(spark, source, schema, report, checkpoint, "k", scorer, schema).awaitTermination()

    shard = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    shard.write.mode("append").parquet(source)
    go()
    (tmp_path / "report").rename(tmp_path / "away")
    shard.union(spark.createDataFrame([(500, 1), (500, 1)], schema)).write.mode("append").parquet(source)
    go()
    go()
    assert sum(scored) == 101
    assert sorted(map(tuple, incremental.read_report(spark, report, schema).collect())) == [(500, 1)]


def test_another_stream_replaces_nothing(spark, tmp_path):
    source, report = f"{tmp_path}/in", f"{tmp_path}/report"
    schema = StructType.fromDDL("k long")
    for k in range(2):
        spark.range(10 * k, 10 * k + 10).withColumnRenamed("id", "k").write.parquet(f"{source}{k}")
        incremental.merge_stream(spark, f"{source}{k}", schema, report, f"{tmp_path}/state{k}", "k", 100).awaitTermination()
    assert sorted(r["k"] for r in incremental.read_report(spark, report, schema).collect()) == list(range(100, 120))


def test_state_lets_old_keys_go(spark, tmp_path):
    source, report = f"{tmp_path}/in", f"{tmp_path}/report"
    schema = StructType.fromDDL("k long, t timestamp")
    for k, day in ((1, 1), (1, 1), (2, 9), (1, 9)):  # time moves on with the second key
        spark.sql(f"SELECT {k}L AS k, timestamp'2024-01-{day:02d} 00:00:00' AS t").write.mode("append").parquet(source)
        incremental.score_stream(spark, source, schema, report, f"{tmp_path}/state", "k", lambda df: df, schema, ("t", "1 day")).awaitTermination()
    assert incremental.read_report(spark, report, schema).count() == 3

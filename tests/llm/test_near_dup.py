import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronry.llm import common, embed_dedup, simhash


def components(n, edges):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(300, 300)]
    got = dict(common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = components(301, edges)
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = [None, "", " \t\n", "Ett", "ett", "två ord", "a b c", "A  b\tc", "a b c d", "å Ä ö é", "nbsp inside one", "x y " * 3000]


def test_simhash_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(200)] for _ in range(25)]
    texts = TEXTS + [" ".join(b) for b in base]
    for b in base:
        for _ in range(6):
            c = list(b)
            c[rng.randrange(200)] = "new"
            texts.append(" ".join(c))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, None, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    fp = [plain_fingerprint(t) for t in texts]
    near = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3]
    want = components(len(fp), near)
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(rows)
    assert all(r["fp"] & (2**64 - 1) == fp[r["doc_id"]] and r["component_id"] == want[r["doc_id"]] for r in got)


def test_simhash_dense_cells(spark, monkeypatch):
    """Cells over the limit give the same components as light ones."""
    rng = random.Random(6)
    start = rng.getrandbits(64)
    fps = {start}
    while len(fps) < 120:
        x = rng.choice(sorted(fps)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(80)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    for limit, block in ((1 << 14, 1024), (400, 1024), (30, 16), (0, 7)):
        monkeypatch.setattr(simhash, "CELL_PAIRS", limit)
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = dict(common.connected_components(simhash.links(frame)).collect())
        assert [got.get(i, i) for i in range(len(fps))] == want


def brute_vectors(vs, threshold=0.9):
    units = [None if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not np.any(v) else np.array(v) / np.linalg.norm(v) for v in vs]
    edges = [(i, j) for i in range(len(vs)) for j in range(i) if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold]
    links = [0] * len(vs)
    for i, j in edges:
        links[i] += 1
        links[j] += 1
    return links, components(len(vs), edges)


@pytest.mark.parametrize("window,block,cell", [(512, 1024, 4096), (8, 16, 4096), (8, 16, 16)])
def test_vectors_equal_brute_force(spark, monkeypatch, window, block, cell):
    """One window over all vectors, several passes of small ones, and components counted in many blocks."""
    monkeypatch.setattr(embed_dedup, "WINDOW", window)
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "CELL", cell)
    rng = np.random.default_rng(7)
    vs = [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0] * 4, [2.0] * 4]
    centre = rng.standard_normal(8)
    vs += [list(map(float, centre + 0.18 * rng.standard_normal(8))) for _ in range(60)]
    vs += [list(map(float, rng.standard_normal(8))) for _ in range(120)]
    vs += [list(vs[30]), list(vs[30]), [3 * x for x in vs[31]]]
    links, comp = brute_vectors(vs)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(vs)], "vec_id long, embedding array<double>, label int, w string")
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(df).collect()}
    assert len(got) == len(vs)
    wrong = [i for i in range(len(vs)) if (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) != (links[i], comp[i], comp[i] == i)]
    assert not wrong


def test_vectors_empty_and_recall(spark):
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    for n in (10_000, 50_000, 10**9):
        meet = (1 - np.arccos(0.9) / np.pi) ** np.ceil(np.log2(n / embed_dedup.WINDOW))
        passes = embed_dedup.plan_passes(n, 0.9, 0.97)
        assert (1 - meet) ** passes <= 0.03 < (1 - meet) ** (passes - 1)
    assert embed_dedup.plan_passes(embed_dedup.WINDOW, 0.9, 0.99) == embed_dedup.plan_passes(0, 0.9, 0.99) == 1


def test_simhash_null_ids_bridge(spark):
    word = lambda fp: fp - 2**64 if fp >= 2**63 else fp
    docs = spark.createDataFrame([(1, "samma text här"), (None, "samma text här"), (2, "samma text här"), (None, "helt egen text finns")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.simhash_components(docs).collect()) == [(0, 0), (0, 1), (1, 1), (2, 1)]
    assert common.connected_components(simhash.links(spark.createDataFrame([(word(x), word(x)) for x in (0, 7, 63)], "fp long, rep long"))).count() == 3


def test_simhash_empty(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_row_of_a_group(spark):
    rows = [(1, "a", 1.0, 1), (1, "a", 2.0, 1), (1, "b", 3.0, 1), (2, "c", 4.0, 1), (None, "d", 5.0, 1), (None, "e", 6.0, 2), (None, "e", 6.0, 2), (5, "f", 7.0, 3), (5, "g", 8.0, 4)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, key double")
    group = F.when(F.col("text").isin("a", "b", "c", "d"), 1).when(F.col("text") == "e", 2).when(F.col("text") == "f", 3).otherwise(4)
    found = docs.select("doc_id", common.row_key().alias("key"), group.alias("group"))
    got = common.keep_one(docs, found)
    assert got.columns == docs.columns
    out = sorted((str(r["doc_id"]), r["text"]) for r in got.collect())
    assert len(out) == 4 and out[1:] == [("5", "f"), ("5", "g"), ("None", "e")] and out[0] in (("1", "a"), ("1", "b"))


@pytest.mark.parametrize("hub,held", [(1 << 16, 1 << 18), (1 << 16, 4), (3, 4), (3, 25)])
def test_components_with_hubs(spark, monkeypatch, hub, held):
    """Rounds of stars, the last task and both in turn give the same components."""
    monkeypatch.setattr(common, "HUB", hub)
    monkeypatch.setattr(common, "EDGES", held)
    rng = random.Random(2)
    edges = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(50, 120)] + [(rng.randrange(130, 200), rng.randrange(130, 200)) for _ in range(45)] + [(300, 300)]
    want = components(301, edges)
    got = dict(common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got.get(i, i) == want[i] for i in range(301))


def test_shared_folder(spark):
    df = common.materialize(spark.range(3), "t")
    assert df.count() == 3 and common.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir")) and spark.sparkContext.applicationId in common.shared_dir(spark)
    common.clear_shared(spark)
    common.clear_shared(spark)
    assert common.materialize(spark.range(2), "t").count() == 2
    mark = common.written(spark)
    first, last = common.materialize(spark.range(2), "t"), common.materialize(spark.range(5), "t")
    common.release(spark, mark, but=1)
    assert last.count() == 5 and common.written(spark) == mark + 1
    with pytest.raises(Exception):
        spark.read.parquet(first.inputFiles()[0]).count()


def test_rows_marked_before_a_join(spark):
    """No wanted row is left out, few others pass; texts that a join drops are not shuffled, however it is planned."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("s"), F.col("id").alias("bits"), F.lit("x").alias("a.b"))
    hashed = F.xxhash64("bits")
    for n in (0, 1, 900, 20_000):
        wanted = rows.where(F.col("bits") < n).select(hashed.alias("h"))
        got = common.marked(rows, hashed, wanted)
        passed = got.where("maybe").select("row.*")
        assert passed.columns == rows.columns and passed.where(F.col("bits") < n).count() == n and got.count() == 20_000
        assert passed.count() <= n + (20_000 - n) // 8


def test_crowded_filter(spark, monkeypatch):
    """Where a filter is too small for the names all may pass, and the same rows stay."""
    monkeypatch.setattr(common, "FILTER", common.BITMAP)
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    found = docs.select("doc_id", common.row_key().alias("key"), F.floor(F.col("doc_id") / 2).alias("group"))
    row = common.keep_one(docs, found).agg(F.count("*"), F.sum("doc_id"), F.max(F.col("doc_id") % 2)).first()
    assert tuple(row) == (30_000, sum(range(0, 60_000, 2)), 0)


def test_near_dedup_leaves_other_texts_in_place(spark):
    """Without broadcasts, as on large inputs, only texts of near copies are shuffled."""
    from heronry.llm import near_dup

    rng = random.Random(8)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(60)) + " " + f"{rng.getrandbits(80_000):x}" for _ in range(400)]
    texts += [t.replace(" ", "\t", 3) for t in texts[:20]]
    docs = common.materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    near = [t.rsplit(" ", 1)[0] + f" last {k}" for k, t in enumerate(texts[:20])]
    docs = common.materialize(docs.union(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(near)], "doc_id long, text string")))

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    set_ = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in set_}
    for k, v in set_.items():
        spark.conf.set(k, v)
    try:
        start = shuffled()
        kept = sorted(r["doc_id"] for r in common.materialize(near_dup.dedup_simhash(docs)).select("doc_id").collect())
        moved = shuffled() - start
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert kept == list(range(400))
    assert moved < 0.6 * sum(map(len, texts))

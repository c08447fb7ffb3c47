import random

import corpus_pipeline
import __spark_entry__ as entry


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, columns = docs.count(), docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "substring_dedup", "decontamination", "mixing"]
    counts = [n]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[1] <= n and counts[2] < counts[1] and counts[3] == counts[2] and counts[4] < counts[3]
    assert docs.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names and [sum(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)] == [1] * 10


def test_near_dedup_equals_brute_force(spark):
    rng = random.Random(7)
    texts = [None, "", "ett", "ett två", "Ett  två", "ett två tre fyra fem"]
    for n in (8, 30, 120, 400):
        for _ in range(5):
            base = [f"ord{rng.randrange(400)}" for _ in range(n)]
            texts.append(" ".join(base))
            for edits in (1, 1, 2, 3, 5, 8):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(n)] = f"ny{rng.randrange(9)}"
                texts.append(" ".join(copy[: rng.randrange(n * 9 // 10, n + 1)]))
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and group[i] != group[j]:
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    want = sorted(set(group))
    assert 50 < len(want) < 110 and sorted(r["doc_id"] for r in kept.collect()) == want
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), "").count() == 0


def test_near_copies_in_blocks(spark, monkeypatch):
    """A crowd of copies that are near one another but not near any one of them: blocks of a few sets give the same."""
    from heronry.llm import near_dup

    monkeypatch.setattr(near_dup, "BLOCK", 5)
    rng = random.Random(9)
    base = [f"ord{k}" for k in range(120)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for k in rng.sample(range(40, 120), rng.choice([1, 2, 3, 4])):
            copy[k] = f"ny{rng.randrange(50)}"
        texts.append(" ".join(copy))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and group[i] != group[j]:
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in near_dup.dedup_simhash(docs).collect()) == sorted(set(group))


def test_links_of_blocks(spark):
    """Sets that share shingles, similar or not, in components of some: blocks of any size join what brute force joins."""
    from heronry.llm import common, near_dup

    rng = random.Random(3)
    base = [f"ord{k}" for k in range(100)]
    texts = []
    for k in range(50):
        copy = list(base)
        for i in rng.sample(range(100), rng.choice([1, 2, 3, 5])):
            copy[i] = f"ny{rng.randrange(90)}"
        texts.append(" ".join(copy[: rng.choice([100, 96, 60])]))
    sets = near_dup.shingles([t.encode() for t in texts])
    nodes = [near_dup._digest(s) for s in sets]
    rows = [(n, len(s), bytearray(near_dup.sketch(s))) for n, s in zip(nodes, sets)]
    comp = {n: min(nodes[k % 7 :: 7]) if k < 20 else n for k, n in enumerate(nodes)}
    places = [(h, n, k % 4 > 0, comp[n]) for h in range(4) for k, n in enumerate(nodes) if k % (h + 1) == 0]
    part = spark.createDataFrame(places, "h long, node long, short boolean, c long")
    frame = spark.createDataFrame(rows, "node long, n long, sk binary").distinct()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at = {n: set(s.tolist()) for n, s in zip(nodes, sets)}
    joined = [(c, n) for n, c in comp.items() if n != c]
    for h, x, short, _ in places:
        for h2, y, _, _ in places:
            if h == h2 and x != y and short and len(at[x]) <= len(at[y]) and len(at[x] & at[y]) >= 0.8 * len(at[x] | at[y]):
                joined.append((x, y))
    edges = spark.createDataFrame([(a, b) for a, b in joined if a != b], "a long, b long")
    want = dict(common.connected_components(edges).collect())
    start = spark.createDataFrame([(c, n) for n, c in comp.items() if n != c], "a long, b long")
    for block in (2048, 6):
        near_dup.BLOCK, whole = block, near_dup.BLOCK
        try:
            found = near_dup._apart(part, frame, docs, 5, 0.8)
            assert 10 < found.count() < 50 * 50 / 4
            assert dict(common.connected_components(start.union(found)).collect()) == want
        finally:
            near_dup.BLOCK = whole


def test_stages_take_nulls_clashing_names_and_empty_tables(spark, sf_dir):
    """Each stage alone: nulls in any column, empty and repeated texts, columns named like those that stages add."""
    word = "the house and the garden of a small town near the river with old trees in it"
    texts = [None, "", " \n", word, word, word + " again", "x", "12 34 !", word.upper(), (word + " ") * 300]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, __lang string, key long, x_text string, `group` int"
    rows = [(None if k == 3 else k, t, "en" if k % 2 else None, None if k % 3 else "a", None if k == 4 else len(t or ""), "r", None, k, "x", 1) for k, t in enumerate(texts)]
    train = [(100 + k, f"{word} number {k} of many", "en", "b", 60, None, "l", None, None, None) for k in range(30)]
    docs = spark.createDataFrame(rows + rows[3:5] + train, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        kept = corpus_pipeline.materialize(out, name)
        assert 0 < kept.count() <= 2 * docs.count(), name
        empty = stage(spark, docs.where("false"), sf_dir)
        assert empty.columns == docs.columns and corpus_pipeline.materialize(empty, name).count() == 0, name


def test_language_id_sends_a_text_once(spark, monkeypatch):
    """Python gets each text once, whatever the columns are called; rows and columns stay as they are."""
    sent, identify = [], corpus_pipeline.identify

    def seen(docs, *rest, **more):
        sent.append(docs.schema.simpleString().count("text:string"))
        return identify(docs, *rest, **more)

    monkeypatch.setattr(corpus_pipeline, "identify", seen)
    rows = [(i, ("det är en rad om ord" if i % 2 else "this is a line of words") + f" {i}", "sv" if i % 2 else "en", float(i), f"k{i}", i) for i in range(40)]
    rows += [(40, None, None, 0.5, None, 40), (41, "1 2 3", None, 0.5, "k", 41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __score double, __LANG string, `_a.b` long")
    got = corpus_pipeline.language_id(spark, docs, "")
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == rows[:40]
    assert sent == [1]


def test_mixing_starts_no_further_workers(spark, monkeypatch):
    """The table of sources is a local relation: rows of Python objects need workers of another kind in the executors."""
    from heronry.llm import mixing

    plans, materialize = [], mixing.materialize

    def seen(df, name="t"):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return materialize(df, name)

    monkeypatch.setattr(mixing, "materialize", seen)
    docs = spark.createDataFrame([(i, "ord " * (i + 1), [None, "a", "b"][i % 3]) for i in range(30)], "doc_id long, text string, source string")
    assert mixing.mix(materialize(docs)).count() > 0
    assert [("LocalRelation" in p, "LogicalRDD" in p) for name, p in plans if name == "pi"] == [(True, False)]
    assert mixing.mix(materialize(docs.where("false"))).count() == 0

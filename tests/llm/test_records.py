import base64
import hashlib
import random

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from heronry.llm import chat, mixing, warc, wrapper


def test_turns_round_trip():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["\\", "<turn:", "</turn>", "\n", "a", "<", ">", "turn"]) for _ in range(rng.randint(0, 8)))
        role = rng.choice(["user", "assistant", "a>b", "", "x\ny"])
        segment, lo, hi = chat.format_turn(role, text)
        assert chat.read_turns(segment * 2) == [(role, text)] * 2
        assert (lo, hi) == (0, 0) if role != "assistant" else chat._ESCAPED.sub(r"\1", segment[lo:hi]) == text
    with pytest.raises(ValueError):
        chat.read_turns("<turn:user>\nno end")


def test_layouts(spark):
    ask, say = ("user", "a", True), ("assistant", "b", True)
    pair = '[{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]'
    cases = [
        (f'{{"messages": {pair}}}', [ask, say]), ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', [ask, say]),
        ('{"instruction": "i", "input": "x", "output": "b"}', [("user", "i\n\nx", True), say]), ('{"instruction": "a", "output": "b"}', [ask, say]), ('{"prompt": "a", "response": null}', [ask, ("assistant", "", True)]),
        (f'{{"system": "s", "messages": {pair}}}', [("system", "s", True), ask, say]), ('{"messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "bot", "content": "b"}], "id": 3}', [ask, say]),
        ('{"system": "s", "instruction": "a", "output": "b", "source": "x"}', [("system", "s", True), ask, say]), ('{"prompt": "a", "chosen": "b", "rejected": "c"}', [ask, say]), (f'{{"chosen": {pair}, "rejected": {pair}}}', [ask, say]),
        ('{"turns": [{"role": "user", "text": "a"}]}', [ask]), ('{"question": "a", "answer": "b", "context": ""}', [ask, say]), ('{"messages": []}', []), ('{"system": "s", "conversations": []}', [("system", "s", True)]),
        ('{"messages[].role": "user", "messages[].content": "a"}', None), ('{"a.b": 1}', None), ('{"a": {"b": 1}}', None), ('{"odd": 1}', None), ("{}", None), ("[1]", None), ("not json", None), (None, None),
    ]
    got = {}
    for r in chat.canonical_records(spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "conv_id long, record string").repartition(3)).collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"], r["error"] is None))
    for k, (_, want) in enumerate(cases):
        assert [x[1:] for x in sorted(got.get(k, []), key=lambda x: x[0] or 0)] == ([(None, None, False)] if want is None else want), cases[k]
    assert chat.fingerprint(chat.paths_of_value({"a.b": 1})) != chat.fingerprint(chat.paths_of_value({"a": {"b": 1}}))


def test_chats_equal_plain_digests(spark):
    rows = [(1, 1, "assistant", "två\\"), (1, 0, "user", None), (1, 1, "assistant", "ett </turn>"), (2, 0, None, "x" * 200_000), (None, 0, "assistant", ""), (1, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(chat.canonical_table(df))).collect()}
    for conv in (1, 2, None):
        turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[conv][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want
    assert chat.read_chats(chat.format_chats(chat.canonical_table(df.where("false")))).count() == 0


@pytest.mark.parametrize("range_bytes", [97, 1000, 8 << 20])
def test_warc_round_trip(spark, range_bytes):
    pages = [(5, "http://a/å", "<p>å</p>"), (3, "http://b/\r\nX: y", "<p>å</p>"), (4, None, None), (9, "u", ""), (7, "u", "z" * 50_000), (8, "u", "unik"), (8, "u", "unik"), (None, "u", "<p>å</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("first", F.lit("x"))
    folder = warc.new_folder(spark)
    files = warc.write_archives(df, folder)
    got = sorted(((r["page_id"] is None, r["page_id"] or 0), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(files, folder, range_bytes).collect())
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        first = min(p for p, _, x in pages if (x or "") == (h or "") and p is not None)
        want.append(((i is None, i or 0), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=lambda x: x[0])
    assert warc.read_archives(warc.write_archives(df.where("false"), folder), folder).count() == 0


def test_warc_tasks_grow_with_ranges(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat_ws(" ", *(F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 512) for k in range(20))).alias("html")).repartition(2)
    folder = warc.new_folder(spark)
    files = warc.write_archives(pages, folder)
    size = files.agg(F.sum("size")).first()[0]
    for ranges in (2, 8, 32):
        got = warc.read_archives(files, folder, -(-size // ranges)).withColumn("task", F.spark_partition_id())
        assert got.count() == 400 and got.select("task").distinct().count() >= ranges // 2 and got.rdd.getNumPartitions() >= ranges


def test_warc_reader_skips_damage_and_owns_by_start(tmp_path):
    members = [warc.member(warc.record("response", warc.page_urn(i), None, b"x" * 100 + str(i).encode(), "S", None, "d")) for i in range(9)]
    decoy = b"\x1f\x8b\x08garbage\x1f\x8b\x08" + warc.member(b"not a record")
    data = members[0] + decoy + b"".join(members[1:6]) + members[6][:-9] + b"".join(members[7:])
    read = lambda at, n: data[at : at + n]
    whole = [warc.urn_page(warc.parse(d)["headers"]["warc-record-id"]) for _, d in warc.members(read, len(data), 0, len(data))]
    assert whole == [0, 1, 2, 3, 4, 5, 7, 8]
    for step in (1, 50, 333):
        parts = [warc.urn_page(warc.parse(d)["headers"]["warc-record-id"]) for lo in range(0, len(data), step) for _, d in warc.members(read, len(data), lo, min(len(data), lo + step))]
        assert parts == whole


def test_archives_are_plain_gzip(spark):
    import gzip

    folder = warc.new_folder(spark)
    files = warc.write_archives(spark.createDataFrame([(1, "u", "hej")], "page_id long, url string, html string").coalesce(1), folder).collect()
    fs, _ = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(files[0]["path"]) as f:
        text = gzip.decompress(f.readall())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response") and text.endswith(b"hej\r\n\r\n")


def test_html_blocks():
    e = wrapper.extract
    assert e("") == "" and e("bara text &amp; mer") == "bara text & mer"
    assert e("<p>a<br>b <i>c</i>d<p>e&nbsp; f</p><ul><li>x<li>y</ul>") == "a b cd\ne f\nx\ny"
    page = "<html><head><title>t</title><style>p{}</style></head><body><header>H</header><nav><a>m</a></nav><div class='cookie-notice'>ok?</div><main><article><h1>R&eacute;</h1><p>ett<script>if(a<b){}</script></p><aside>s</aside><form><input>f</form><div class='ad'>köp</div><p>två</p></article></main><section id='comments'><p>k</p></section><div class='sidebar'>s</div><footer>f</footer></body></html>"
    assert e(page) == "Ré\nett\ntvå"
    assert e("<article><p>hel</p><p>avhuggen <b>t") == "hel\navhuggen t" and e("<article><p>a</p><div") == "a"
    assert e("<div>" * 5000 + "djup") == "djup" and e("<p>a <!-- x > y --> b") == "a b"
    assert e("<article><p>uppdaterad</p><p class='loading'>header</p></article>") == "uppdaterad\nheader"


def test_html_headers_and_names():
    e = wrapper.extract
    assert e("<body><header>H</header><div><p>x</p></div><div class='site-header'>t</div><div class='commentlist'>c</div><p class='cookie-bar'>k</p></body>") == "x"
    assert e("<article><header><h1>R</h1></header><p>x</p><footer>f</footer></article>") == "R\nx"
    assert e("<div role='navigation'>n</div><p hidden>h</p><p style='display: none'>d</p><p>a<button>b</button>c</p>") == "ac"


SITE = "<body><div class=top>Min sajt</div><div id=body><h2>{0}</h2><div><p>{1}</p><p>Mer om {0}, och mer.</p></div></div><div class=end>Alla rättigheter</div></body>"


def test_templates(spark):
    pages = [(i, f"http://a.example/{i}", SITE.format(f"Ämne {i}", f"En lång text om ämne {i} som är olika.")) for i in range(6)]
    pages += [(10, "http://solo.example/x", SITE.format("Ensam", "En sida.")), (11, None, None), (12, "konstig", "<p>x"), (13, "http://solo2.example/", SITE.format("Lika", "Kopia")), (14, "http://solo2.example/", SITE.format("Lika", "Kopia"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r["page_id"]: r for r in wrapper.main_text(df).collect()}
    assert len(got) == len(pages)
    assert all(got[i]["text"] == f"Ämne {i}\nEn lång text om ämne {i} som är olika.\nMer om Ämne {i}, och mer." for i in range(6))
    assert "Ensam\nEn sida.\nMer om Ensam, och mer." in got[10]["text"] and got[11]["text"] == "" and got[12]["text"] == "x" and got[13]["text"] == got[14]["text"] != ""
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert wrapper.main_text(df.where("false")).count() == 0


def test_targets():
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    assert mixing.targets([10, 100, 1000]) == [20.0, 200.0, 1.5 * 1110 - 220]
    t = mixing.targets([100, 100, 100, 100])
    assert sum(t) == pytest.approx(600) and max(t) <= 200


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 80))), rng.choice(["b", "a", None, "a", "a"])) for i in range(3000)]
    rows += [(5000, None, "a"), (5001, "", "tom"), (5002, "x", "ensam"), (None, "a b c", "a"), (5003, "dubbel rad", "b"), (5003, "dubbel rad", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("lang", F.lit("sv"))
    base, plan = mixing.mix_plan(docs)
    per = {r["source"]: r for r in plan.groupBy("source").agg(F.first("source_size").alias("n"), F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()}
    names = sorted((s for s in per if s is not None)) + [None]
    size = lambda s: sum(len((t or "").split()) for _, t, x in rows if x == s)
    want = mixing.targets([size(s) for s in names])
    for s, t in zip(names, want):
        assert per[s]["n"] == size(s) and per[s]["t"] == pytest.approx(t) and per[s]["most"] <= 2 and per[s]["least"] >= 0
        assert abs(per[s]["taken"] - t) <= max(3, 0.002 * t) or per[s]["n"] < 3
    again = mixing.mix_plan(docs.repartition(7))[1]
    key = lambda p: sorted((r["doc_key"], r["source"] or "", r["copies"]) for r in p.collect())
    assert key(plan) == key(again)
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == plan.join(base.groupBy("doc_key").count(), "doc_key").agg(F.sum(F.col("copies") * F.col("count"))).first()[0]
    assert mixing.mix_plan(docs.where("false"))[1].count() == 0 and mixing.mix(docs.where("false")).count() == 0

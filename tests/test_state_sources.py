import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import chat, evaluation, meta, store
from tessera.sources import files, office
from tessera.streaming import events as stream

CHUNK = "id string, file_id string, chunk_index long, content string"


def test_upsert_replaces_files(spark):
    old = spark.createDataFrame([("a0", "a", 0, "x"), ("a1", "a", 1, "y"), ("b0", "b", 0, "z"), ("c0", "c", 0, "w")], CHUNK)
    new = spark.createDataFrame([("a0", "a", 0, "new"), ("a0", "a", 0, "old")], CHUNK)
    gone = spark.createDataFrame([("b",), ("",), (None,)], "file_id string")
    out = store.upsert(old, new, gone)
    assert sorted((r["id"], r["content"]) for r in out.collect()) == [("a0", "old"), ("c0", "w")]
    again = store.upsert(spark.createDataFrame(out.collect(), CHUNK), new, gone)
    assert sorted(again.collect()) == sorted(out.collect())
    assert sorted(r["id"] for r in store.upsert(old, new.limit(0), gone).collect()) == ["a0", "a1", "c0"]
    assert store.delete_by_file(old, spark.createDataFrame([("",)], "file_id string")).count() == 4
    assert store.get_by_ids(old, spark.createDataFrame([], "id string")).count() == 0


def test_store_versions_and_rejects(spark, tmp_path):
    rows = [("k", [1.0, 0.0], {1: 0.5, 2: -1.0}, "t", "f", 0, "{}"), ("m", [1.0], {1: 0.5}, "t", "f", 1, "{}"), ("n", [1.0, 1.0], {1: 0.0}, "t", "f", 2, "{}")]
    good, bad = store.valid_rows(spark.createDataFrame(rows, store.CHUNK_SCHEMA), 2)
    assert good.first()["sparse"] == {1: 0.5} and {r["reason"] for r in bad.collect()} == {"wrong dimension", "empty sparse vector"}
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.read().count() == 0 and s.upsert(good)["rows"] == 1 and s.upsert(good)["rows"] == 1
    s.drop()
    assert s.read().count() == 0


def test_answers_are_a_stack(spark):
    rows = [("k", 1, "question", "q1"), ("k", 2, "question", "q2"), ("k", 3, "answer", "a2"), ("k", 4, "answer", "a1"), ("k", 5, "answer", "lone"), ("j", 1, "question", "open")]
    out = chat.attach_answers(spark.createDataFrame(rows, "key string, seq long, kind string, text string")).collect()
    assert sorted((r["key"], r["question"], r["answer"]) for r in out) == [("j", "open", ""), ("k", "", "lone"), ("k", "q1", "a1"), ("k", "q2", "a2")]


def kept(times, ttl):
    out, until = [], None
    for t in sorted(times):
        if until is None or until <= t:
            out.append(t)
            until = t + ttl
    return out


def test_first_seen_batch_and_stream_agree(spark, tmp_path):
    r = random.Random(4)
    rows = sorted(((f"k{r.randrange(4)}", r.randrange(0, 30_000) * 1_000_000, i) for i in range(300)), key=lambda x: x[1])
    schema = "key string, ts_us long, event_id long"
    df = spark.createDataFrame(rows, schema)
    batch = {(x["key"], x["ts_us"]) for x in chat.first_seen(df).collect()}
    for k in {x[0] for x in rows}:
        assert sorted(t for key, t in batch if key == k) == sorted(set(kept([x[1] for x in rows if x[0] == k], 3600 * 1_000_000)))
    for i in range(3):  # three files, one a batch, in the order of time
        spark.createDataFrame(rows[i * 100 : (i + 1) * 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream.to_table(stream.dedupe_with_ttl(stream.source(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {(x["key"], x["ts_us"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()} == batch


def test_streamed_answers(spark, tmp_path):
    schema = "key string, seq long, kind string, text string"
    spark.createDataFrame([("k", 1, "question", "q1"), ("k", 2, "question", "q2")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("k", 3, "answer", "a2"), ("k", 4, "answer", "a1"), ("k", 5, "answer", "x")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream.to_table(stream.attach_answers(stream.source(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r["question"], r["answer"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("", "x"), ("q1", "a1"), ("q2", "a2")]


def test_encryption_round_trip(spark):
    row = spark.createDataFrame([("héllo",), ("plain",)], "t string").select("t", chat.encrypted(F.col("t"), "k").alias("c")).select("t", "c", chat.decrypted(F.col("c"), "k").alias("d"), chat.decrypted(F.col("t"), "k").alias("p")).collect()
    assert all(r["t"] == r["d"] == r["p"] and r["c"].startswith(chat.PREFIX) for r in row)


def test_published_token(spark):
    """The token format's published vector, one with a changed signature, and another key."""
    key, token = "cw_0x689RpI-jtRR7oE8h_eQsKImvJapLeSbXpwF4e4=", "gAAAAAAdwJ6wAAECAwQFBgcICQoLDA0ODy021cpGVWKZ_eEwCGM4BLLF_5CV9dOPmrhuVUPgJobwOz7JcbmrR64jVmpU4IwqDA=="
    rows = spark.createDataFrame([("fernet:v1:" + token,), ("fernet:v1:" + token[:-6] + "AAAA==",)], "t string")
    assert [r["d"] for r in rows.select(chat.decrypted(F.col("t"), key).alias("d")).collect()] == ["hello", None]
    assert rows.select(chat.decrypted(F.col("t"), "other").alias("d")).where("d is not null").count() == 0
    with pytest.raises(ValueError):
        chat.encrypted(F.lit("x"), " ")


def test_choices_window_and_ids(spark):
    df = spark.createDataFrame([(1, 3, "issue"), (1, 1, "helpful"), (2, 5, "issue")], "k long, ts long, c string")
    assert {(r["k"], r["selected"]) for r in chat.first_choices(df, ["k"], ["ts"], "c").collect()} == {(1, "helpful"), (2, "issue")}
    ids = chat.normalized_ids(spark.createDataFrame([(" ", "s", None), ("u", None, "c")], "user_id string, session_id string, conversation_id string")).collect()
    assert [tuple(r) for r in ids] == [("anonymous", "s", "s"), ("u", "default", "c")]


def test_judgment_summary_and_halves(spark):
    rows = spark.createDataFrame([("5", "4", "x", None, 1.0, 10.0, None), ("3", "4", "4", None, 0.0, 30.0, "e"), ("9", "9", "9", "false", 1.0, 20.0, None)], "readability string, correctness string, completeness string, pass string, recall double, latency_ms double, error string")
    out = evaluation.judged(rows)
    assert [r["pass"] for r in out.collect()] == [False, True, False]
    s = evaluation.summary(out).first()
    assert (s["n"], s["pass_rate"], s["average_recall"], s["mean_readability"], s["failed_query_count"]) == (3, 0.3333, 0.6667, 4.33, 1)
    assert evaluation.summary(out.limit(0)).first()["pass_rate"] == 0.0
    lat = evaluation.latency_summary(spark.createDataFrame([("a", float(v), i) for i, v in enumerate([1, 2, 4, 8])], "g string, v double, i long"), "g", "v", "i").first()
    assert (lat["p90"], lat["median"], lat["tail_minus_head"]) == (6.8, 3.0, 4.5)


def test_recall_and_containment(spark):
    items = spark.createDataFrame([(1, "Doc A", "alpha beta gamma", None), (2, "zzz", "one two three", "four five"), (3, "none", None, None)], "item_id long, name string, evidence string, reference string")
    chunks = spark.createDataFrame([(1, 1, "nothing"), (1, 2, "about doca"), (2, 1, "five four x"), (3, 1, "abc")], "item_id long, rank long, content string")
    assert {r["item_id"]: (r["hit"], r["matched_rank"], r["matched_by"]) for r in evaluation.recall(items, chunks).collect()} == {1: (1, 2, "name"), 2: (1, 1, "reference"), 3: (0, None, None)}
    p = spark.createDataFrame([(1, "b c d"), (2, "x" * 30), (3, ""), (4, None)], "item_id long, passage string")
    d = spark.createDataFrame([(1, "A B CD e"), (2, "y" + "x " * 40), (3, None)], "doc_id long, text string")
    for most in (0, 10**6):
        assert {tuple(r) for r in evaluation.contained(p, d, most_chars=most).collect()} == {(1, 1), (2, 2)}


def test_maps_and_vocabulary(spark):
    rows = spark.createDataFrame([("a", "u1", 1), ("a", "u2", 2), ("b", "u3", 3), ("", "u4", 4)], "k string, v string, seq long")
    assert {tuple(r) for r in meta.first_wins(rows, "k", "v", ["seq"]).collect()} == {("a", "u1"), ("b", "u3")}
    assert [tuple(r) for r in meta.conflicts(rows, "k", "v", ["seq"]).collect()] == [("a", "u1", "u2")]
    old, new = rows.where("seq = 1").select("k", "v"), rows.where("seq in (2, 3)").select("k", "v")
    assert {tuple(r) for r in meta.merged_map(old, new, "k", "v").collect()} == {("a", "u1", True), ("b", "u3", False)}
    words = lambda rows: spark.createDataFrame(rows, "word string, pos string, seq long")
    assert {tuple(r) for r in meta.vocabulary(words([("Ab", "n", 1)]), words([("ab", "v", 1), ("cd", "v", 3), ("cd", "a", 2), ("12", "m", 1), ("x", "n", 1)])).collect()} == {("ab", "n"), ("cd", "a")}
    urls = spark.createDataFrame([("A.docx", "http://h/a")], "file_name string, url string")
    asked = spark.createDataFrame([("x/a.docx",), ("b c.docx",), ("https://z",)], "p string")
    assert [r["url"] for r in meta.hosted(asked, urls, "p").orderBy("p").collect()] == ["/download?path=b+c.docx", "https://z", "http://h/a"]


def test_intervals_equal_all_pairs(spark):
    r = random.Random(6)
    at = lambda: f"2024-01-01 0{r.randrange(3)}:{r.randrange(60):02}:{r.randrange(60):02}"
    p = spark.createDataFrame([(r.randrange(3), i, at()) for i in range(80)], "k long, point_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    s = spark.createDataFrame([(r.randrange(3), i, at()) for i in range(60)], "k long, span_id long, start string").withColumn("start", F.to_timestamp("start")).withColumn("end", F.col("start"))
    want = {(a["k"], a["point_id"], b["span_id"]) for a in p.collect() for b in s.collect() if a["k"] == b["k"] and -3 <= (a["ts"] - b["start"]).total_seconds() <= 600}
    assert {tuple(x) for x in meta.interval_matches(p, s, "k", 3, 600).collect()} == want and want


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="w" xmlns:r="r" xmlns:a="a"'
P = lambda t, s="": f"<w:p><w:pPr>{f'<w:pStyle w:val={chr(34)}{s}{chr(34)}/>' if s else ''}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
CELL = lambda t, more="": f"<w:tc><w:tcPr>{more}</w:tcPr>{P(t)}</w:tc>"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    table = "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in (CELL("A") + CELL("B") + CELL("C"), CELL("x", '<w:vMerge w:val="restart"/>') + CELL("1") + CELL("2"), CELL("", "<w:vMerge/>") + CELL("3") + CELL(""))) + "</w:tbl>"
    link = '<w:p><w:hyperlink r:id="R1"><w:r><w:t>site</w:t></w:r></w:hyperlink></w:p>'
    rels = '<Relationships xmlns="p"><Relationship Id="R1" Target="http://h"/></Relationships>'
    (d / "a.docx").write_bytes(package({"word/document.xml": f"<w:document {W}><w:body>{P('Title', 'Heading1')}{P('Body  text')}{link}{table}</w:body></w:document>", "word/_rels/document.xml.rels": rels, "word/styles.xml": f'<w:styles {W}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>'}))
    cells = '<c r="A1" t="inlineStr"><is><t>Name</t></is></c><c r="B1" t="s"><v>0</v></c>', '<c r="A2" t="inlineStr"><is><t>n</t></is></c><c r="B2" t="s"><v>1</v></c>'
    (d / "b.xlsx").write_bytes(package({
        "xl/workbook.xml": f'<workbook {W}><sheets><sheet name="S" r:id="R1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships xmlns="p"><Relationship Id="R1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>Url</t></si><si><t>link</t></si></sst>", "xl/worksheets/_rels/sheet1.xml.rels": rels,
        "xl/worksheets/sheet1.xml": f'<worksheet {W}><sheetData><row r="1">{cells[0]}</row><row r="2">{cells[1]}</row></sheetData><hyperlinks><hyperlink ref="B2" r:id="R1"/></hyperlinks></worksheet>'}))
    shape = lambda t, y, x: f'<p:sp><a:off x="{x}" y="{y}"/><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sp>'
    slide = lambda body: f'<p:sld xmlns:p="p" xmlns:a="a">{body}</p:sld>'
    (d / "c.pptx").write_bytes(package({"ppt/slides/slide1.xml": slide(shape("right", 100, 900) + shape("left", 200, 5) + shape("low", 900000, 1)), "ppt/slides/slide2.xml": slide(shape("end", 0, 0))}))
    (d / "bad.docx").write_bytes(b"no zip")
    (d / "~$a.docx").write_bytes(b"lock")
    (d / "a.pdf").write_bytes(b"%PDF")
    return str(d)


def test_office(spark, folder):
    found = files.discover(spark, folder)
    assert [r["path"].rpartition("/")[2] for r in found.select("path").collect()] == ["a.docx", "a.pdf", "b.xlsx", "bad.docx", "c.pptx"]
    assert "a.docx" not in {r["path"].rpartition("/")[2] for r in files.without_pdf_twins(found).collect()}
    of = {}
    for r in office.documents(found).orderBy("doc_id", "item_index").collect():
        of.setdefault(r["doc_id"].rpartition("/")[2], []).append((r["type"], r["style"], r["text"], r["url"], r["links"]))
    assert of["a.docx"] == [("paragraph", "heading 1", "Title", None, {}), ("paragraph", "正文", "Body text", None, {}), ("paragraph", "正文", "site", None, {}), ("link", "正文", "site", "http://h", {}), ("table", "table", '[{"A":"x","B":"1","C":"2"},{"A":"x","B":"3"}]', None, {})]
    assert of["b.xlsx"] == [("paragraph", "标题", "b", None, {}), ("paragraph", "标题 2", "S", None, {}), ("table", "row:2", '[{"Name":"n","Url":"link"}]', None, {"link": "http://h"})]
    assert [x[2] for x in of["c.pptx"]] == ["第1页", "left", "right", "low"]
    assert of["bad.docx"][0][0] == "error" and of["a.pdf"][0][2] == "unsupported format"


def test_file_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"content": "x", "chunk_index": 1, "metadata": {"file_id": "f"}}]))
    assert files.read_chunks(spark, str(tmp_path / "c.json")).first()["metadata"]["file_id"] == "f"
    (tmp_path / "e.json").write_text(json.dumps([{"content": "x", "chunk_index": 0, "metadata": {"file_id": "f"}, "embedding": [1.0, 0.0], "bm25_embedding": {"3": 0.5, "4": 0.0}}]))
    r = files.read_embeddings(spark, str(tmp_path / "e.json")).first()
    assert (r["file_id"], r["sparse"], r["vector"]) == ("f", {3: 0.5}, [1.0, 0.0])
    (tmp_path / "v.csv").write_text("﻿词,词性\n检索,v\n ,n\n召回,\n", encoding="utf-8")
    rows = files.read_vocabulary(spark, str(tmp_path / "v.csv"))
    assert [(x["word"], x["pos"]) for x in rows.orderBy("seq").collect()] == [("检索", "v"), ("召回", "nz")]
    files.write_vocabulary(rows, str(tmp_path / "out"))
    assert files.read_vocabulary(spark, str(tmp_path / "out")).count() == 2
    have = spark.createDataFrame([("/d/data/raw/a/x.docx",), ("/d/data/raw/b/Y.docx",)], "path string")
    asked = spark.createDataFrame([("a%2Fx.docx",), ("data\\raw\\b\\y.docx",), ("../x.docx",), ("q.docx",)], "request string")
    assert {tuple(r) for r in files.resolved(asked, have).collect()} == {("a%2Fx.docx", "/d/data/raw/a/x.docx"), ("data\\raw\\b\\y.docx", "/d/data/raw/b/Y.docx")}


def test_tree(spark):
    edges = spark.createDataFrame([("a", "b", "B"), ("b", "c", "C")], "parent string, child string, name string")
    out = meta.tree(spark, edges, spark.createDataFrame([("a", "A")], "node string, name string"))
    assert {tuple(r) for r in out.collect()} == {("a", 0, "A"), ("b", 1, "A/B"), ("c", 2, "A/B/C")}


def test_passages_are_found_by_fingerprints(spark):
    """Passages of all lengths at any place of documents, at their ends too, with near misses, one passage in very many documents and characters beyond the basic plane."""
    from tessera.operators import fingerprints

    r = random.Random(8)
    letters = "abcdé😀"
    docs = [(i, "".join(r.choice(letters) for _ in range(r.choice([1, 5, 40, 400])))) for i in range(150)] + [(1000 + i, "thesamepassageineverydocument" + str(i)) for i in range(300)]
    passages = [(0, "thesamepassageineverydocument"), (1, "a"), (2, "thesamepassageineverydocumen!")]
    for n in (1, 2, 7, 15, 16, 17, 23, 24, 25, 60, 400):
        for _ in range(6):
            text = r.choice([t for _, t in docs if len(t) >= n])
            at = r.choice([0, len(text) - n, r.randint(0, len(text) - n)])
            found = text[at : at + n]
            passages += [(len(passages), found), (len(passages) + 1, found[:-1] + "x")]
    p, d = spark.createDataFrame(passages, "item_id long, p string"), spark.createDataFrame(docs, "doc_id long, d string")
    got = {tuple(x) for x in fingerprints.contained(p, d).collect()}
    assert got == {(i, j) for i, x in passages for j, t in docs if x in t}
    assert fingerprints.contained(p.limit(0), d).collect() == [] and fingerprints.contained(p, d.limit(0)).collect() == []
    assert len(set(fingerprints.windows("".join(r.choice(letters) for _ in range(5000))).tolist())) < 1500

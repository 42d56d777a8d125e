import json
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import cleaning, loose, markdown, references, split
from tessera.functions import text as T
from tessera.operators import items, layout, meta


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_clean_text(spark):
    dirty = "​Hello 　 world \U0001f600 , itâ€™s ( fine )﻿ "
    clean = one(spark, T.clean_text, dirty)
    assert clean == "Hello world, it's (fine)"
    assert one(spark, T.clean_text, clean) == clean
    assert T.clean_text(F.lit(None)) is not None and one(spark, T.clean_text, None) is None


def test_sanitize_question(spark):
    assert one(spark, T.sanitize_question, 'café\\n ​is \\"open\\"\x07? now') == 'café is "open"? now'


def test_tokens_and_overlap(spark):
    df = spark.createDataFrame([("Foo bar 知识库 x", "foo 知识 baz")], "a string, b string")
    r = df.select(T.overlap_tokens(F.col("a")).alias("a"), T.overlap_ratio(T.overlap_tokens(F.col("a")), T.overlap_tokens(F.col("b"))).alias("r"), T.overlap_tokens(F.lit("foo bar"), True).alias("c")).first()
    assert sorted(r["a"]) == ["bar", "foo", "知识", "识库"] and r["r"] == 0.5 and r["c"] == ["foobar"]


def test_small_expressions(spark):
    row = spark.range(1).select(
        T.file_id(F.lit("/a/b/Name.docx"), F.lit("doc")).alias("f"), T.chunk_id(F.lit("x"), F.lit(7)).alias("c"), T.trim_document(F.lit("abcdefghij"), 6).alias("t"), T.shorten(F.lit("a  b c d e f"), 6).alias("s"),
        T.hamming(F.lit("ffffffffffffffff"), F.lit("0000000000000001")).alias("h"), T.epoch_seconds(F.lit("1970-01-01T00:00:01.5Z")).alias("e"), T.url_domain(F.lit("https://A.b/c")).alias("d"),
        T.elapsed_text(F.lit(61.2)).alias("el"), T.heading_level(F.lit("Heading 2")).alias("hl"),
    ).first()
    import hashlib

    assert row["f"] == "doc_" + hashlib.sha1(b"Name").hexdigest()[:12] and row["c"] == "x_chunk_000007"
    assert (row["t"], row["s"], row["h"], row["e"], row["d"], row["el"], row["hl"]) == (f"abcd{T.OMITTED}ij", "a b c ...", 63, 1.5, "a.b", "1m01s", 2)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 。.\n1、", max_size=1500))
def test_plain_pieces_are_bounded_and_keep_all(text):
    pieces = split.plain(text, 100, 0)
    assert all(0 < len(p) <= 100 for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(text.split())


def test_split_kinds():
    table = json.dumps([{"k": "v" * 90, "i": i} for i in range(20)], separators=(",", ":"))
    pieces = split.split(table)
    assert [x for p in pieces for x in json.loads(p)] == json.loads(table) and all(len(p) <= 500 for p in pieces)
    image = '<img index="3">' + "word " * 200 + "</img>"
    assert all(p.startswith('<img index="3">') and p.endswith("</img>") for p in split.split(image))
    long = '<a index="1">' + "x" * 600 + "</a>"
    assert split.split("before " + long + " after") == ["before", long, "after"]
    nested = json.dumps({"a": [{"k": "v" * 90}] * 9, "b": {"c": "d" * 300, "e": "f" * 300}, "g": 1}, separators=(",", ":"))
    pieces = [json.loads(p) for p in split.split(nested)]
    assert [list(p) for p in pieces] == [["a"], ["a"], ["a"], ["b"], ["b"], ["g"]] and sum(len(p["a"]) for p in pieces[:3]) == 9
    assert split.plain("word " * 30 + "2. second part of it " + "word " * 30, 200, 20)[0].endswith("word") and split.plain("word " * 30 + "2. second part of it " + "word " * 30, 200, 20)[1].startswith("2. second")
    assert split.plain("x" * 250, 100, 20) == ["x" * 100, "x" * 100, "x" * 90]
    assert split.split(None) == split.split("  ") == []


def walk(rows):
    """Heading paths one item after another."""
    state, out = {}, []
    for level, text in rows:
        if level is not None:
            state = {k: v for k, v in state.items() if k < level} | {level: text}
        out.append("\\".join(state[k] for k in sorted(state)))
    return out


def test_heading_paths_equal_a_walk(spark):
    r = random.Random(1)
    rows = [(d, i, r.choice([None, None, 1, 2, 3, 4]), f"t{i}") for d in range(20) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, item_index long, lv int, text string").withColumn("style", F.when(F.col("lv").isNotNull(), F.concat(F.lit("heading "), F.col("lv").cast("string"))))
    out = {(x["doc_id"], x["item_index"]): x["path"] for x in items.heading_paths(df).collect()}
    for d in range(20):
        own = [x for x in rows if x[0] == d]
        assert [out[d, i] for i in range(30)] == walk([(x[2], x[3]) for x in own])


SCHEMA = "doc_id long, item_index long, type string, style string, text string"


def test_cleaning_drops_sync_notes_with_their_link(spark):
    rows = [("paragraph", "同步自文档：{{x}}"), ("link", "同步自文档"), ("link", "l2"), ("paragraph", "图片：data\\processing\\a.png"), ("paragraph", "（ 空 ）"), ("image", ""), ("paragraph", "text"), ("table", '[{"a ✅":"1 ,2"}]')]
    df = spark.createDataFrame([(1, i, k, "正文", t) for i, (k, t) in enumerate(rows)], SCHEMA)
    out = items.clean_items(df).orderBy("item_index").collect()
    assert [r["item_index"] for r in out] == [2, 5, 6, 7] and out[-1]["text"] == '[{"a":"1,2"}]'


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab ,.'-()（空）\u200b\u3000✅★â€™¦Â\n\t\x07", max_size=60))
def test_cleaning_is_stable(text):
    once = cleaning.cleaned(text)
    assert not set(once) & set("\u200b✅★\x07") and once == once.strip()
    again = cleaning.cleaned(once)
    assert len(again) <= len(once)


def test_cleaning_agrees_with_python(spark):
    r = random.Random(5)
    pieces = ["word", " ", "  ", ",", " . ", "-- ", "\u3000", "\u200b", "✅", "â€™", "â€¦", "Ã\x80", "（ ", " ）", "[ x ]", "图片：data/processing/a.png", "同步自文档：https://a.b/c ", "\x07", "\n", "\t", "\ufffd", "é", "漢字"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 25))) for _ in range(400)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.clean_text(F.col("t")).alias("c")).collect()
    assert all(x["c"] == cleaning.cleaned(x["t"]) for x in got)


def test_item_lines_round_trip(spark):
    df = spark.createDataFrame([(1, "[paragraph] [heading 1] A\n\nplain\n[table] [row] x")], "doc_id long, text string")
    got = items.items_from_text(df)
    assert [(r["type"], r["style"], r["text"]) for r in got.orderBy("item_index").collect()] == [("paragraph", "heading 1", "A"), ("paragraph", "正文", "plain"), ("table", "row", "x")]
    assert items.items_to_text(got).first()["text"] == "[paragraph] [heading 1] A\n[paragraph] [正文] plain\n[table] [row] x"


def test_chunks(spark):
    long = "Sentence with words. " * 40
    rows = [("heading 1", "H"), ("heading 2", "S1"), ("正文", "short body one"), ("heading 2", "S2"), ("正文", "short body two"), ("heading 1", "L"), ("正文", long)]
    df = spark.createDataFrame([(1, i, "paragraph", s, t) for i, (s, t) in enumerate(rows)], SCHEMA)
    out = items.chunk(df).orderBy("chunk_index").collect()
    assert out[0]["path"] == "H" and out[0]["content"] == "S1\nshort body one\nS2\nshort body two"
    assert [r["chunk_index"] for r in out] == list(range(len(out)))
    assert all(len(r["content"]) <= 500 for r in out) and {r["path"] for r in out[1:]} == {"L"}


def test_table_takes_the_title_right_before_it(spark):
    rows = [("paragraph", "heading 1", "H"), ("table", "表标题", "T"), ("table", "row", '[{"a":"bbbbbbbbbbbb"}]'), ("table", "表标题", "U"), ("paragraph", "正文", "some words between"), ("table", "row", '[{"c":"dddddddddddd"}]')]
    df = spark.createDataFrame([(1, i, k, s, t) for i, (k, s, t) in enumerate(rows)], SCHEMA)
    assert {r["path"] for r in items.segments(df).where("chunk_type = 'table'").collect()} == {"H\\T", "H"}


def test_batches_equal_a_loop(spark):
    r = random.Random(2)
    rows = [(d, i, "x" * r.randint(1, 60)) for d in range(5) for i in range(40)]
    out = {(x["doc_id"], x["item_index"]): x["batch"] for x in items.batched(spark.createDataFrame(rows, "doc_id long, item_index long, line string"), 100).collect()}
    for d in range(5):
        batch, size = -1, 0
        for _, i, t in (x for x in rows if x[0] == d):
            if batch >= 0 and size + len(t) <= 100:
                size += len(t)
            else:
                batch, size = batch + 1, len(t)
            assert out[d, i] == batch


def test_sections(spark):
    rows = [("heading 1", "A"), ("heading 2", "empty"), ("heading 2", "B"), ("正文", "x"), ("heading 1", "参考文献"), ("heading 2", "sub"), ("正文", "ref"), ("heading 1", "C"), ("正文", "y"), ("heading 1", "last")]
    df = spark.createDataFrame([(1, i, "paragraph", s, t) for i, (s, t) in enumerate(rows)], SCHEMA)
    left = lambda f: [r["text"] for r in f(df).orderBy("item_index").collect()]
    assert left(layout.without_reference_sections) == ["A", "empty", "B", "x", "C", "y", "last"]
    assert left(layout.without_empty_sections) == ["A", "B", "x", "参考文献", "sub", "ref", "C", "y"]


LINE = "doc_id long, page_number int, line_order int, text string, page_width double, page_height double, x0 double, y0 double, x1 double, y1 double, font_size double, bold boolean"


def line(p, i, t, x0, x1, size=10.0, bold=False, top=None):
    y = 20.0 * i if top is None else top
    return (1, p, i, t, 600.0, 800.0, x0, y, x1, y + size, size, bold)


def test_pdf_headings(spark):
    rows = [line(1, 0, "Big Title", 250.0, 350.0, 24.0, True), line(1, 1, "一、 Part", 50.0, 120.0, 16.0), line(1, 2, "1. Point", 50.0, 120.0)] + [line(1, i, f"body text number {i} goes on here", 50.0, 400.0) for i in range(3, 12)] + [line(1, 12, "3", 290.0, 310.0, 9.0)]
    rows += [line(p, 30, "Confidential", 50.0, 100.0, 9.0) for p in (1, 2, 3)] + [line(3, 5, "plain centre", 250.0, 350.0)] + [line(2, i, f"{i}. a long point of a list that ends.", 50.0, 400.0) for i in range(2, 6)] + [line(2, 7, "2024年5月", 250.0, 350.0, 24.0, True), line(2, 8, "right", 540.0, 590.0, 20.0, True)]
    df = spark.createDataFrame(rows, LINE)
    clean = layout.without_furniture(df)
    assert not {"3", "Confidential"} & {r["text"] for r in clean.collect()}
    got = layout.headings(clean)
    style = {r["text"]: r["style"] for r in got.collect()}
    assert (style["Big Title"], style["一、 Part"], style["1. Point"]) == ("标题", "标题 2", "标题 4")
    assert {t for t, k in style.items() if k != "正文"} == {"Big Title", "一、 Part", "1. Point"}
    found = layout.items_of_lines(got.withColumn("urls", F.when(F.col("line_order") == 0, F.array(F.lit("http://x")))))
    assert [r["text"] for r in found.where("type = 'link_ref'").collect()] == ["http://x"]


def test_rows_of_lines(spark):
    rows = [line(1, 2, "b", 80.0, 100.0, top=11.0), line(1, 1, "a", 50.0, 75.0, top=10.0), line(1, 3, "far", 300.0, 330.0, top=12.5), line(1, 4, "next", 50.0, 70.0, top=40.0)]
    out = layout.same_row_merged(spark.createDataFrame(rows, LINE)).orderBy("line_order").collect()
    assert [(r["text"], r["x0"], r["x1"], r["line_order"]) for r in out] == [("a b", 50.0, 100.0, 1), ("far", 300.0, 330.0, 3), ("next", 50.0, 70.0, 4)]


def test_repeated_images(spark):
    rows = [(1, i, f"{h:016x}", x, 0.1, 0.2, 0.2) for i, (h, x) in enumerate([(0, 0.10), (7, 0.11), (0, 0.5), ((1 << 40) - 1, 0.10)])]
    got = layout.repeated_images(spark.createDataFrame(rows, "doc_id long, image_id long, hash string, x double, y double, w double, h double")).collect()
    assert {r["image_id"] for r in got} == {0, 1}
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(6)]
    flip = lambda h, n: sum((1 << b for b in r.sample(range(64), n)), 0) ^ h
    rows = [(d, 100 * d + i, f"{flip(r.choice(base), r.randint(0, 6)):016x}", r.choice([0.1, 0.13, 0.5]), 0.1, r.choice([0.2, 0.25, 0.3]), 0.2) for d in range(3) for i in range(60)]
    rows += [(d, i + 50, *rest) for d, i, *rest in rows[:9]]  # the same again
    near = lambda a, b: a[0] == b[0] and bin(int(a[2], 16) ^ int(b[2], 16)).count("1") <= 8 and abs(a[3] - b[3]) <= 0.04 and abs(a[5] - b[5]) <= 0.06
    want = {a[:2] for i, a in enumerate(rows) if any(near(a, b) for j, b in enumerate(rows) if i != j)}
    got = layout.repeated_images(spark.createDataFrame(rows, "doc_id long, image_id long, hash string, x double, y double, w double, h double")).collect()
    assert {(x["doc_id"], x["image_id"]) for x in got} == want and 0 < len(want) < len(rows)


def test_loose():
    assert loose.loads('<think>x</think>```json\n{"a": [1, 2]}\n```') == {"a": [1, 2]}
    assert loose.loads('well: {"a": "}"} and more') == {"a": "}"} and loose.loads("[") is None
    assert loose.vocabulary_reply('[{"word":"知识库","pos":"n"},{"word":"123","pos":"n"},{"word":"向量","pos":"??"},{"word":"知识库","pos":"v"}]') == [("向量", "nz"), ("知识库", "n")]
    assert loose.vocabulary_reply("检索 v\n- 召回, n\nx") == [("召回", "n"), ("检索", "v")] and loose.vocabulary_reply("[") == []
    assert loose.vocabulary_reply('{"word":"年假","pos":"zz"},\na.docx, n') == [("年假", "nz")]


def test_references_are_numbered(spark):
    want = {
        "See [片段1：A](d/a.docx) and [x](y) <reference>d\\a.docx</reference> <reference>b</reference>\n```\n[片段2：q](z)\n```\n\n---\n\n## 参考来源：\n- a": ("See [[1]](d\\a.docx) and [x](y) [[1]](d\\a.docx)[[2]](b)\n```\n[片段2：q](z)\n```", ["d/a.docx", "b"]),
        "a\n\nreferences\n- b": ("a\n\nreferences\n- b", []),
        None: ("", []),
        "**知识来源**：\n- x": ("", []),
        'x [片段1:T](<u v> "片段9, y")\n![片段1:T](no)<reference>\t</reference>': ("x [[1]](<u v>)\n![片段1:T](no)", ["<u v>"]),
        "<reference>c</reference> <reference>c</reference>\n<reference>e</reference>": ("[[1]](c)[[2]](e)", ["c", "e"]),
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(want)], "line int, answer string")
    got = {r["answer"]: (r["text"], r["refs"]) for r in references.with_references(rows, "answer").collect()}
    assert got == want


def test_card_text(spark):
    want = {
        "| a | |\n|---|---|\n| 1 | 2 |\n|  |  |\ntext": "1. a: 1；列2: 2\ntext",
        "| a |\n| --- |": "a",
        "## H\ntext\n#### I": "**H**\ntext\n**I**",
        "* *来源：x*\n>q\n>\n- - -\n": "· 来源：x\n▌ q\n▌\n────────",
        None: " ",
        "": " ",
        "x\r\n| p |\r| h | i |\n|:---:|---|\n|1|2|3|\n|4|\n```\n| h |\n|---|\n# no\n```\n| h |\n|---|\n| 9 |": "x\n| p |\n1. h: 1；i: 2\n2. h: 4\n```\n| h |\n|---|\n# no\n```\n1. h: 9",
        "```\n- a\n* b": "```\n- a\n* b",
        "# T  \n--\n----\n  + i": "**T**\n---\n--\n────────\n  · i",
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(want)], "card int, text string")
    got = {r["text"]: r["c"] for r in markdown.with_cards(rows, "text", "c").collect()}
    assert got == want


def test_reading_order(spark):
    rows = [(1, i, t, l) for i, (t, l) in enumerate([(0.0, 5.0), (2.0, 1.0), (3.5, 0.0), (10.0, 9.0), (11.0, 2.0)])]
    out = meta.row_leaders(spark.createDataFrame(rows, "page long, id long, top double, left double"), "page", 3.0).orderBy("place").collect()
    assert [r["id"] for r in out] == [1, 0, 2, 4, 3]


def test_boxes_meet_in_cells(spark):
    """Sizes from points to the whole page, inverted and boundless boxes; in a grid of small ones only neighbours are compared."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        x, y, w, h = rng.uniform(-40, 40), rng.choice([0.0, 8.0, 16.0, rng.uniform(0, 50)]), rng.choice([0.0, 1.0, 8.0, 64.0, rng.random()]), rng.choice([0.0, 8.0, rng.uniform(-2, 9)])
        rows.append((i, i % 2, x, y, x + w, y + h))
    rows += [(300, 0, float("-inf"), 0.0, float("inf"), 1.0), (301, 1, 1e15, 0.0, 1e15, 50.0), (302, 1, None, 0.0, 1.0, 1.0), (303, 0, -1e15, -5.0, 1e15, 60.0)]
    boxes = spark.createDataFrame(rows, "id long, page int, x0 double, y0 double, x1 double, y1 double")
    got = [tuple(r) for r in meta.box_pairs(boxes, boxes, "page").select("l.id", "r.id").collect()]
    some = [r for r in rows if None not in r]
    want = [(a[0], b[0]) for a in some for b in some if a[1] == b[1] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]]
    assert sorted(got) == sorted(want)

    # 90,000 boxes of one page, none of which meets another: as pairs of the page they would be 8,100,000,000.
    apart = spark.range(90000).select("id", F.lit(0).alias("page"), (F.col("id") % 300 * 3.0).alias("x0"), (F.floor(F.col("id") / 300) * 3.0).alias("y0"))
    apart = apart.withColumns({"x1": F.col("x0") + 1, "y1": F.col("y0") + 1})
    pairs = meta.box_pairs(apart, apart, "page")
    assert "_x" in pairs._jdf.queryExecution().optimizedPlan().toString() and pairs.count() == 90000


def test_images_of_a_large_document_meet_in_cells(spark, monkeypatch):
    """Hashes of few bits, all of whose bands are often equal: no pairs are written, and results equal all pairs."""
    rng = random.Random(8)
    rows = [(i % 3 if i < 260 else 9, 1000 - i, f"{sum(1 << b for b in rng.sample(range(64), 6)):016x}", rng.choice([0.0, 0.025, 0.05]), 0.0, rng.choice([0.0, 0.1]), 0.0) for i in range(280)]
    rows.append((0, 5, None, 0.0, 0.0, 0.0, 0.0))
    images = spark.createDataFrame(rows, "doc_id long, image_id long, hash string, x double, y double, w double, h double")
    near = lambda a, b: a[0] == b[0] and a[1] != b[1] and bin(int(a[2], 16) ^ int(b[2], 16)).count("1") <= 8 and abs(a[3] - b[3]) <= 0.04 and abs(a[5] - b[5]) <= 0.06
    some = rows[:-1]
    want = sorted((a[0], a[1], min(a[1], *o)) for a in some if (o := [b[1] for b in some if near(a, b)]))
    for block in (4096, 30):
        monkeypatch.setattr(layout, "BLOCK", block)
        monkeypatch.setattr(layout, "ROWS", 7)
        got = layout.repeated_images(images)
        assert sorted(map(tuple, got.select("doc_id", "image_id", "first").collect())) == want and want
    assert "FlatMapGroupsInPandas" in got._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_of_many_documents_need_no_frame_each(spark):
    rows = [(d, i, "paragraph", "heading 1" if i == 0 else "正文", f"part {i} of a document with number {d}") for d in range(40) for i in range(4)]
    got = items.chunk(spark.createDataFrame(rows, "doc_id long, item_index int, type string, style string, text string").repartition(5))
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = [(d, 0, f"part 0 of a document with number {d}", "text", "\n".join(f"part {i} of a document with number {d}" for i in (1, 2, 3))) for d in range(40)]
    assert sorted(map(tuple, got.collect())) == want


def test_quick_steps_equal_patterns(spark):
    """What the JVM puts before a step's pattern, or in its place, changes no result; ends are trimmed as by their pattern."""
    import random

    from tessera.functions import cleaning as C

    rnd = random.Random(5)
    parts = [*C.SPACES, *" \n\t  \u3000,.!?;:，。()（）[]【】\"'-ab1ZéÃÂâå€\u0080\u00bf\u200b\ufeff\x07\ufffd\ufe0f✅★空", "同步自文档：https://a.b/c ", "图片: data/processing/a b.PNG", "\U0001f600", "\U000e0101", "\u2028", "Â "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(4000)] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    steps = {p: n for p, n in (*C.FIRST, *C.LAST)}
    assert set(C.BEFORE) | set(C.INSTEAD) <= set(steps)
    wrong = [F.count_if(~C._replaced(F.col("x"), p, n).eqNullSafe(F.regexp_replace("x", p, n))) for p, n in steps.items()]
    assert set(rows.agg(*wrong, F.count_if(~C.stripped(F.col("x")).eqNullSafe(F.regexp_replace("x", C.ENDS, "")))).first()) == {0}


def test_vocabulary_is_hashed_first(spark):
    """Words are kept by hash tables of numbers before they are normalised; spellings of a word meet after that, a null seq comes first."""
    of = lambda rows: spark.createDataFrame(rows, "word string, pos string, seq long")
    old = of([("Alpha", "n", 5), (" alpha", "v", 3), ("b", "n", 1), ("12", "n", 1), (None, "n", 1)])
    new = of([("alpha ", "x", 1), ("BETA", "y", 9), ("beta", "z", 8), (" beta", None, 7), ("gamma", "u", 1), ("Gamma", "w", None)])
    out = meta.vocabulary(old, new)
    assert {r["word"]: r["pos"] for r in out.collect()} == {"alpha": "v", "beta": None, "gamma": "w"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[word" in plan and "rlike" not in plan.lower()[plan.lower().rindex("exchange") :]

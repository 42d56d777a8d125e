import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import loose, names
from tessera.operators import enrich, models, webhook, workflow
from tessera.sources import files, paged

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_further_queries_match_their_sql(spark):
    import duckdb

    from tessera.plans import catalog, more  # noqa: F401

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    mine = [n for n, q in catalog.QUERIES.items() if q.__module__ == "tessera.plans.more" and n in catalog.SQL]
    assert len(mine) > 50
    for name in mine:
        got = catalog.QUERIES[name](spark, SF)
        rel = con.execute(catalog.SQL[name])
        cols = [d[0] for d in rel.description]
        assert sorted(got.columns) == sorted(cols), name
        plain = lambda r: tuple(str(list(v) if isinstance(v, (list, tuple)) else round(v, 6) if isinstance(v, float) else v) for v in r)
        assert sorted(map(plain, got.select(*[f"`{c}`" for c in cols]).collect())) == sorted(map(plain, rel.fetchall())), name


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_message_fields(spark):
    m = lambda **x: F.lit(json.dumps(x))
    assert one(spark, webhook.message_text(m(message_type="text", content='{"text":" a "}'))) == "a"
    assert one(spark, webhook.message_text(m(message_type="text", content="plain "))) == "plain"
    assert one(spark, webhook.message_text(m(message_type="image", content='{"text":"a"}'))) == ""
    assert one(spark, webhook.sender_id(m(sender_id={"open_id": "o", "user_id": "u"}))) == "o" and one(spark, webhook.sender_id(m(x=1))) is None
    assert one(spark, webhook.sender_name(m(name=" ", sender_id={"nickname": "n"}))) == "n"
    assert one(spark, webhook.dedupe_key(F.lit(""), F.lit("e"))) == "event:e" and one(spark, webhook.dedupe_key(F.lit(None).cast("string"), F.lit(None).cast("string"))) is None
    assert one(spark, webhook.action_kind(F.lit('{"action":"stop_feishu_answer"}'))) == "missing"
    assert one(spark, webhook.status_card(F.lit(" a "), F.lit(" "))) == "a" and not one(spark, webhook.is_transient(F.lit("...")))


def test_late_answers_are_suppressed(spark):
    answers = spark.createDataFrame([("a", 0.0, 10.0), ("b", 0.0, 10.0), ("c", 0.0, 9000.0)], "cancel_id string, started double, answered double")
    stops = spark.createDataFrame([("a", 5.0), ("a", 6.0), ("b", 11.0), ("c", 8000.0)], "cancel_id string, at double")
    assert {r["cancel_id"]: r["suppressed"] for r in webhook.delivered(answers, stops).collect()} == {"a": True, "b": False, "c": False}


def test_latest_stage(spark):
    detail = {"data": {"workflowData": {"nodes": [{"id": "1", "name": "x"}, {"id": "2", "name": "y"}]}, "resultData": {"runData": {"y": [{"startTime": "2024-01-01T00:00:02Z"}], "x": [], "z": [{}]}}}}
    rows = spark.createDataFrame([("e", json.dumps(detail)), ("f", "{}")], "id string, detail string")
    stages = spark.createDataFrame([("1", "generating"), ("2", "retrieving")], "node_id string, stage string")
    assert {r["id"]: r["stage"] for r in workflow.reached(rows, stages).collect()} == {"e": "generating", "f": None}
    assert [r["name"] for r in workflow.executed(rows).orderBy("at").collect()] == ["x", "z", "y"]


def test_links_are_named():
    assert enrich.marked("官网：http://a.b/c", "") == ("官网：{{官网网站链接}}", [("官网网站链接", "http://a.b/c")])
    assert enrich.marked("http://a.b and http://a.b", "链接：")[0] == "{{a.b 链接}} and {{a.b 链接 2}}"
    assert enrich.marked("http://a.b", "", {"http://a.b": "d"})[1] == [("d", "http://a.b")]


def test_settings(monkeypatch):
    monkeypatch.setenv("TESSERA_X", "yes")
    assert names.as_bool(names.setting("TESSERA_NONE", None, "TESSERA_X"), False) and names.as_float(" ", 1.0) is None and names.as_float(None, 1.0) == 1.0
    assert names.endpoint("https://h:9/") == ("h:9", True)


def test_models_answer_and_fail_alone(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(6)] + [(None, "text 1")], "id long, text string").withColumn("m", models.prompt("s", F.col("text")))

    def client():
        def ask(messages):
            if messages[1]["content"].endswith("3"):
                raise OSError("down")
            return messages[1]["content"].upper()

        return ask

    out = {r["id"]: (r["reply"], r["error"]) for r in models.chat(rows, "id", "m", client, pause_s=0.0).collect()}
    assert out[2] == ("TEXT 2", None) and out[3] == (None, "OSError: down") and out[None][0] == "TEXT 1" and len(out) == 7
    assert models.chat(rows, "id", "m", None).where("reply is not null").count() == 0
    waits = []
    assert models.retried(lambda m: 1 / 0, [], 3, 2.0, waits.append)[0] is None and waits == [2.0, 4.0]


def test_models_of_texts(spark):
    words = models.vocabulary(spark.createDataFrame([(1, "t")], "text_id long, text string"), lambda: lambda m: '[{"word":"年假","pos":"n"}]').collect()
    assert [tuple(r) for r in words] == [("年假", "n", 1)]
    asked = models.questions(spark.createDataFrame([("p", "t")], "path string, text string"), lambda: lambda m: '```json\n[{"question":"q","reference_answer":"a"},{"question":" "}]\n```').collect()
    assert len(asked) == 1 and asked[0]["id"].startswith("qa_")
    rows = spark.createDataFrame([(1, "q", "alpha beta", "alpha beta"), (2, "q", "alpha", " ")], "item_id long, question string, reference string, answer string")
    assert {r["item_id"]: r["pass"] for r in models.judgments(rows).collect()} == {1: True, 2: False}
    vec = models.unit_vectors(spark.createDataFrame([(1, "abc"), (2, " ")], "id long, text string"), lambda: lambda texts: [[3.0, 4.0] for _ in texts]).collect()
    assert [(r["id"], r["vec"]) for r in vec] == [(1, [0.6, 0.8])]
    pairs = spark.createDataFrame([(1, i, "q", "x" * i) for i in range(20)], "query_id long, id long, query string, content string")
    assert {r["id"]: r["rerank_score"] for r in models.rerank_scores(pairs, lambda: lambda q, c: [len(x) for x in c]).collect()} == {i: float(i) for i in range(1, 20)}


def test_images_without_a_model(spark):
    rows = [(1, 0, "paragraph", "正文", "above"), (1, 1, "image", "正文", "a.png"), (1, 2, "image", "正文", "b.png")]
    df = spark.createDataFrame(rows, "doc_id long, item_index long, type string, style string, text string")
    assert {(r["item_index"], r["description"]) for r in models.image_descriptions(df).collect()} == {(1, "above"), (2, "above")}
    said = models.image_descriptions(df, lambda: lambda m: '{"image_type":"flowchart","description":"above。"}').collect()
    assert {(r["image_type"], r["description"]) for r in said} == {("flowchart", "already satisfied")}


def test_paged_source(spark):
    def fetch(root, cursor):
        n = int(cursor or 0)
        return {"items": [{"root": root, "n": n}], "has_more": n < 2, "page_token": str(n + 1)}

    got = paged.read(spark, ["a", "b"], fetch)
    assert sorted((r["root"], r["page"], json.loads(r["item"])["n"]) for r in got.collect()) == [(r, n, n) for r in "ab" for n in range(3)]
    with pytest.raises(ValueError):
        list(paged.pages(lambda r, c: {"has_more": True, "page_token": "x"}, "a"))


def test_question_sources(spark, tmp_path):
    for name in ("a.docx", "a.pdf", "b.TXT", "c.exe", "~$d.docx", "cache/e.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1] for r in files.question_sources(spark, str(tmp_path), "cache").collect()}
    assert got == {"a.pdf", "b.TXT"}


def test_nested_replies():
    assert loose.first_chunks([{"a": 1}, {"documents": [{"b": 2}, 3]}]) == [{"b": 2}] and loose.first_chunks("x") == []


def test_answers_in_replies(spark):
    """The first text by path, whatever the depth; repeated rows and names that clash with helpers."""
    from tessera.functions import replies

    want = {
        '{"answer":{"x":1},"output":" o "}': "o", '[null,3,{"data":[]},{"result":[{"text":" "},{"answer":" deep "}],"data":"late"}]': "deep", " plain ": "plain", None: None, '"str "': "str",
        '{"a":"b"}': "", "[]": "", "": "", '{"answer":" ","output":[{"text":"yes"}]}': "yes", "[" * 12 + '"x"' + "]" * 12: "x", "{broken": "{broken",
    }
    rows = spark.createDataFrame([(t, "k") for t in want] + [('"str "', "again")], "reply string, key string")
    got = replies.with_answers(rows, "reply").collect()
    assert sorted((r["reply"] or "", r["key"], r["answer"] or "") for r in got) == sorted([(t or "", "k", a or "") for t, a in want.items()] + [('"str "', "again", "str")])


def test_a_number_before_a_text_is_no_reply_in_json(spark):
    """What follows a first JSON value makes a reply plain; so it is with a message's content."""
    from tessera.functions import replies

    plain = ["4703 words follow", '{"answer":"a"} and more', '"quoted" word', "true story", "1, 2", '1,0] [1', '1,0],1] x', "[1] [2]", "null and void"]
    whole = {'\n {"answer":"a"} \n': "a", ' ["x", 1] ': "x", "17": "", '"s"': "s", '[[0],1]': ""}
    rows = spark.createDataFrame([(t,) for t in [*plain, *whole]], "reply string")
    assert {r["reply"]: r["answer"] for r in replies.with_answers(rows, "reply").collect()} == {t: t for t in plain} | whole
    m = lambda content: F.lit(json.dumps({"message_type": "text", "content": content}))
    assert one(spark, webhook.message_text(m("42 is it"))) == "42 is it" and one(spark, webhook.message_text(m('{"text":"a"}'))) == "a"


def test_routed_takes_each_part_of_a_payload_out_once(spark):
    """Odd payloads, and a plan in which a part's path stands once. F18."""
    message = lambda content, **more: {"header": {"event_type": webhook.MESSAGE, "event_id": "e"}, "event": {"message": {"message_type": "text", "content": content}, **more}}
    value = {"action": "answer_feedback"}
    cases = [
        (message('{"text":" a "}', sender={"name": " ", "sender_id": {"union_id": "", "user_id": "u", "nickname": " n "}}), ("message", "a", "u", "n", "event:e")),
        (message("3 of 4", sender={"user_name": " x ", "name": "y"}), ("message", "3 of 4", None, "x", "event:e")),
        (message('["text"]'), ("empty", "", None, None, "event:e")),
        (message(None, action={"value": value}), ("card", "", None, None, "event:e")),
        ({"event": {"action_info": value}}, ("card", "", None, None, None)),
        ({"type": "x", "challenge": "c"}, ("challenge", "", None, None, None)),
        ({"encrypt": "s"}, ("encrypted", "", None, None, None)),
    ]
    texts = [json.dumps(p) for p, _ in cases] + [r'{"action":{"value":{"action":"answer_feedback"}}}', "no JSON", None]
    want = [w for _, w in cases] + [("card", "", None, None, None), *[("ignored", "", None, None, None)] * 2]
    out = webhook.routed(spark.createDataFrame(list(enumerate(texts)), "i int, payload string"))
    got = [tuple(r) for r in out.orderBy("i").select("route", "question", "sender", "sender_name", "key").collect()]
    assert got == want and not [c for c in out.columns if c.startswith("_")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f", $.{p})") for p in ("event.sender", "event.message", "header.event_id", "type")] == [1] * 4 and plan.count("parseJson(") <= 3

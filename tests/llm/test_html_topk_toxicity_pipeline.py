import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import html_extract, topk, toxicity
from tests.llm.conftest import prose

PAGE = """<!doctype html><html><head><title>T</title><style>p{x}</style></head><body><header><h1>Site</h1><a href=1>Home</a></header>
<div id="main-menu"><ul><li><a href=2>One</a></li><li><a href=3>Two</a></li></ul></div>%s
<aside><p>Side, bar, with, many, commas, and, words, to, win</p></aside><div class="cookie-notice">We use cookies, yes.</div>
<div id="comments"><p>First, of, all, I, agree, with, this, entirely.</p></div><form><label>Mail</label><input></form><footer>&copy; us</footer><script>var a="<p>no</p>";</script></body></html>"""
BODY = "<h2>Head &eacute; &amp; tail</h2><p>A long, winding sentence, with commas, that goes on and on for the score.</p><p>Short</p><ul><li>item   one<li>item\n two</ul><div class=\"advert\">Buy!</div><p>More, a < b, text&nbsp;here, so that it wins<br>over all the others.</p>"
WANT = "Head é & tail A long, winding sentence, with commas, that goes on and on for the score. Short item one item two More, a < b, text here, so that it wins over all the others."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<div class=content>%s</div>", "<main><div><section>%s</section></div></main>", "<article><header>%s</header></article>"])
def test_article_is_found(wrap):
    assert html_extract.extract(PAGE % (wrap % BODY)) == WANT


def test_odd_pages():
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<script>x</script>") == ""
    assert html_extract.extract("plain &lt;text&gt;") == "plain <text>"
    assert html_extract.extract("<p>a<p>b</i></div>c <!-- d --> <b>e") == "a b c e"
    assert html_extract.extract("<table><tr><td>x<td>y<tr><td>z</table>") == "x y z"
    for page in ('<a "' * 20000, "<div>" * 20000 + "x", "<" * 20000, "<p>" * 20000, "&" * 20000, "<button>" * 5000):
        html_extract.extract(page)


def test_sections_of_an_article_stay_together():
    parts = "".join(f"<section><h3>H{i}</h3><p>{prose(i, 5 + 30 * (i == 1))}, {i}</p></section>" for i in range(4))
    got = html_extract.extract(PAGE % f"<article><h2>All</h2>{parts}</article>")
    assert got == " ".join(["All", *(f"H{i} {prose(i, 5 + 30 * (i == 1))}, {i}" for i in range(4))])


@pytest.mark.parametrize("tag", ["div class='content has-sidebar'", "div id='content' class='no-sidebar'", "div class='post social-enabled'", "article class='post comments-open'", "div class='content fixed-header'", "div class='content right-sidebar'", "div class='widget'"])
def test_names_do_not_cut_the_article(tag):
    assert html_extract.extract(PAGE % f"<{tag}>{BODY}</{tag.split()[0]}>") == WANT


@pytest.mark.parametrize("name", ["sidebar-left", "left-sidebar", "sidebar2", "widget", "comment-list", "siteFooter", "cookie-notice", "related-posts related"])
def test_names_still_cut(name):
    said = f"<div class='{name}'><p>Some, other, words, with, commas.</p></div>"
    assert html_extract.extract(PAGE % f"<div class=content>{BODY}{said}</div>") == WANT


@pytest.mark.parametrize("wrap", ["<div class=content>%s</div>", "<main>%s</main>", "<main><div>%s</div></main>", "%s"])
@pytest.mark.parametrize("part", ["<section>%s</section>", "<div>%s</div>", "<div><div>%s</div></div>"])
def test_short_sections_stay_without_an_article(wrap, part):
    texts = [("Short", "Ahead."), ("Long", prose(1, 90) + ", a, b, c, d, e, f, g, h"), ("End", "Brief paragraph."), ("Last", "More.")]
    parts = "".join(part % f"<h2>{h}</h2><p>{p}</p>" for h, p in texts)
    links = "<div><a href=1>One</a> <a href=2>Two</a></div><h3>Links</h3><ul><li><a href=1>Three</a></li><li><a href=2>Four</a></li></ul>"
    assert html_extract.extract(PAGE % (wrap % (parts + links))) == " ".join(f"{h} {p}" for h, p in texts)


def test_a_form_around_the_page_stays():
    page = PAGE % f"<div class=content>{BODY}</div>"
    inside = page.replace("<body>", "<body><form id='aspnet' method=post><input type=hidden>").replace("</body>", "</form></body>").replace("<form><label>Mail</label><input></form>", "")
    assert html_extract.extract(inside) == WANT
    assert html_extract.extract(f"<body><form id=f><h1>T</h1><p>{prose(1, 40)}</p><p>{prose(2, 40)}</p></form></body>") == f"T {prose(1, 40)} {prose(2, 40)}"
    assert html_extract.extract(PAGE % f"<div class=content>{BODY}<form><p>Sign, up, for, our, letter, now.</p></form><p>E = <math><mi>m</mi><mi>c</mi></math></p></div>") == WANT + " E = mc"


def test_long_comments_and_adverts_are_cut():
    assert html_extract.extract(f"<body><div class='ad'><p>{prose(2, 90)}</p></div><article><h1>T</h1><p>Short.</p></article></body>") == "T Short."
    said = f"<div id='comments'><article class='comment-body'><p>{prose(1, 400)}</p></article></div>"
    assert html_extract.extract(PAGE % f"<div class=content><h1>T</h1>{BODY}{said}</div>") == "T " + WANT


def test_pages_table(spark):
    rows = [(1, None, PAGE % f"<article>{BODY}</article>", "x"), (None, "u", None, "y"), (1, None, "", "x"), (1, None, "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_extract.extracted(df).collect()
    assert sorted((r["n_chars"], r["text"]) for r in out) == [(0, ""), (0, ""), (0, ""), (len(WANT), WANT)]
    assert html_extract.extracted(df.limit(0)).count() == 0


def brute(rows, k):
    """The best of all candidates: every row but the query's own, told apart by place."""
    use = [(n, i, [int(np.floor(256 * float(x))) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for n, i, q in use:
        if i is not None and i % 50 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for m, j, v in use if len(v) == len(q) and m != n))
            out.update((i, at + 1, None if absent else j, -s) for at, (s, absent, j) in enumerate(scores[:k]))
    return out


MENU = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(6))
#: What is no part of an article, wherever on the page it may lie; and what is, with its text.
AROUND = [
    f"<nav><ul>{MENU}</ul></nav>", f"<ul>{MENU}</ul>", "<a href='#main'>Skip to content</a>", "<div id='onetrust-consent-sdk'><p>We use cookies, as all do, for your comfort, and ours.</p></div>",
    "<div class='adbox'><p>Buy now, and save, today.</p></div>", "<div id='google_ads_iframe_1'><p>Cheap, cheaper, cheapest.</p></div>", "<aside><p>Other news, in short, here.</p></aside>", "<footer><p>Contact us, at any time.</p></footer>",
    "<div id='disqus_thread'><p>I think, as a reader, that this is good.</p></div>", "<section class='reader-feedback'><p>Thanks, really, for this one.</p></section>", "<div class='discussion'><p>First, second, third reader here.</p></div>",
    "<form><p>Your name, please</p><input name=q></form>", "<script>var a = '<p>no, no, no</p>';</script>", "<style>p { color: red }</style>", "<div hidden><p>Hidden, by all means, from all.</p></div>", "<!-- <p>a comment, too</p> -->",
]
PROSE = ["Rain fell, slowly, on the roof &amp; the old garden wall, and nobody, not even the cat, cared to look outside.", "Later, when the sun came back, the whole street was out again, talking, laughing and, at last, drying their things.", "It was, all said and done, a day like most others in that town, of which there are many, and few that one would keep."]
BELOW = [("<h2>References</h2><ol><li><a href='a'>A first source</a></li><li><a href='b'>A second one</a></li></ol>", ["References", "A first source", "A second one"]), ("<h3>Related articles</h3><ul><li><a href='a'>Another page</a></li><li><a href='b'>And one more</a></li></ul>", []), ("", [])]


@pytest.mark.parametrize("seed", range(8))
def test_generated_pages_give_their_articles(seed):
    """Pages of known articles with parts around them in any order: nothing is lost and nothing added."""
    r = random.Random(seed)
    for n in range(25):
        frame = r.choice(["article", "main", "div class='post'", "div id='story-body'"])
        texts = [r.choice(PROSE) for _ in range(r.randint(4, 9))]
        below, more = r.choice(BELOW)
        head = r.choice(["inside", "header", "none"])
        body = "".join(f"<p>{t.replace(' ', chr(10) + ' ', 1)}</p>" for t in texts)
        inner = f"<{frame}>{'<h1>The day it rained</h1>' if head == 'inside' else ''}{body}{below}</{frame.split()[0]}>"
        top = "<header><a href='/'>Site</a><h1>The day it rained</h1></header>" if head == "header" else r.choice(["", "<header><p>Our site, since long ago</p></header>"])
        before, after = (r.sample(AROUND, r.randint(0, 5)) for _ in range(2))
        page = f"<html><head><title>The day it rained | Site</title></head><body>{top}{''.join(before)}{inner}{''.join(after)}</body></html>"
        want = " ".join((["The day it rained"] if head != "none" else []) + [" ".join(t.replace("&amp;", "&").split()) for t in texts] + more)
        assert html_extract.extract(page) == want, page


def test_a_very_long_page(spark):
    body = "".join(f"<p>Paragraph {i}, of very many, in one <b>long</b> page.</p>" for i in range(60_000))
    page = f"<body><nav><a href=x>Menu</a></nav><div>{'<div>' * 300}{body}{'</div>' * 300}</div><div class='comments'><p>No, no.</p></div></body>"
    out = html_extract.extracted(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert out["text"] == " ".join(f"Paragraph {i}, of very many, in one long page." for i in range(60_000)) and out["n_chars"] == len(out["text"])


@pytest.mark.parametrize("dim", [1, 5, 64])
def test_search_equals_brute_force(spark, monkeypatch, dim):
    monkeypatch.setattr(topk, "ROW_BLOCK", 70 * dim)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2 * dim)
    monkeypatch.setattr(topk, "SUB_BLOCK", 16)
    r = np.random.default_rng(dim)
    rows = [(int(i), (r.normal(0, 1, dim) * (1 + 5 * (i % 7 == 0))).astype(float).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(20)] + [(2000, None), (2050, [float("nan")] * dim), (2100, [None] * dim), (2150, [float("inf")] * dim), (None, rows[1][1]), (None, [9.0] * dim), (None, [9.0] * dim), (50, rows[50][1]), (50, rows[7][1]), (1003, rows[3][1]), (2200, [0.1] * (dim + 1))]
    df = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = Counter((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.nearest(df, F.col("id") % 50 == 0).collect())
    assert got == brute(rows, 5)
    assert topk.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_search_equals_sql(spark, tmp_path):
    import duckdb

    rows = [(50, [0.5, 0.1]), (50, [0.5, 0.1]), (50, [-0.5, 0.2]), (100, [0.3, 0.3]), (7, [0.4, 0.4]), (8, None), (None, [0.1, 0.1]), (9, [0.4])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = Counter(con.execute(topk.SQL).fetchall())
    assert Counter(map(tuple, topk.op10_topk(spark, str(tmp_path)).collect())) == want and want[50, 1, 50, 128 * 128 + 25 * 25] == 2


def test_large_components_are_exact():
    q = np.array([[2**30, -(2**30)]], dtype=np.int64)
    x = np.array([[2**30, 1], [2**30, 0], [2**30, -1]], dtype=np.int64)
    scores, ids, has = topk.best(q, np.array([9]), x, np.array([1, 2, 3]), np.zeros(3, bool), np.array([1, 2, 3]), 2)
    assert scores.tolist() == [[2**60 + 2**30, 2**60]] and ids.tolist() == [[2, 1]] and has.all()


def test_terms_are_chosen_as_by_brute_force(spark):
    """Chi-square of contingency tables, alone and among the texts that hold a term kept for itself, set by set."""
    r = random.Random(4)
    words = [prose(100 + i, 1) + str(i) for i in range(60)]
    rows = []
    for i in range(260):
        own = set(r.sample(words[4:], r.randint(3, 12))) | ({words[0]} if r.random() < 0.3 else set()) | ({words[1]} if r.random() < 0.3 else set())
        toxic = words[0] in own and words[1] in own or r.random() < 0.03
        rows.append((i, " ".join(sorted(own) + ([words[2]] if toxic and r.random() < 0.8 else [])), int(toxic)))
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")

    def chi(df, both, n, m):
        if df < toxicity.LEAST_DOCS or not 0 < df < n or not 0 < m < n:
            return 0.0
        seen = [[both, df - both], [m - both, n - m - df + both]]
        return sum((seen[a][b] - x * y / n) ** 2 / (x * y / n) for a, x in enumerate((df, n - df)) for b, y in enumerate((m, n - m)))

    sets = [(toxicity.terms(t), y) for _, t, y in rows]
    count = lambda some: (Counter(t for s, _ in some for t in s), Counter(t for s, y in some if y for t in s), len(some), sum(y for _, y in some))
    df, both, n, m = count(sets)
    first = {t for t in df if chi(df[t], both[t], n, m) >= toxicity.LEAST_CHI_SQUARE}
    best, tests = Counter(), 0
    for f in first:
        own = [(s, y) for s, y in sets if f in s]
        df2, both2, n2, m2 = count(own)
        if 0 < m2 < n2:
            some = [t for t in df2 if df[t] >= toxicity.LEAST_DOCS and df2[t] >= toxicity.LEAST_DOCS and df2[t] * min(m2, n2 - m2) >= n2]
            tests += len(some)
            for t in some:
                best[t] = max(best[t], chi(df2[t], both2[t], n2, m2))
    want = first | {t for t, x in best.items() if x >= max(toxicity.LEAST_CHI_SQUARE, 2 * np.log(max(tests, 1)))}
    model = toxicity.learn(docs, labels)
    assert set(model.ids.tolist()) == want and first and len(want) < len(df)


def test_pairs_are_learned():
    """Neither term alone tells the label, only both together."""
    r = np.random.default_rng(0)
    sets, marked = [], []
    for _ in range(2000):
        a, b = r.random(2) < 0.5
        sets.append(np.array(sorted({5} | ({7} if a else set()) | ({9} if b else set()))))
        marked.append(float(a and b))
    model = toxicity.fit(sets, np.array(marked), np.array([5, 7, 9]), epochs=30)
    assert model.logit({5, 7, 9}) > 0 > max(model.logit({5, 7}), model.logit({5, 9}), model.logit({5}))
    v = model.factor
    assert abs(model.logit({7, 9}) - (model.bias + model.weight[1] + model.weight[2] + v[1] @ v[2])) < 1e-9


def test_pairs_are_learned_from_texts(spark):
    """A group is as often clean as toxic alone; an insult is toxic only beside it."""
    kinds = (("oaf zed", 1), ("zed", 0), ("scum", 1), ("oaf", 0)) * 2 + (("oaf zed", 1), ("zed", 0), ("scum", 1), ("", 0))
    texts = [(i, f"{prose(i, 8)} {kinds[i % 12][0]}") for i in range(1600)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.learn(rows, spark.createDataFrame([(i, kinds[i % 12][1]) for i in range(1200)], "doc_id long, toxic int"))
    assert model.place[toxicity.term("wzed")] >= 0
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(rows, model).collect()}
    right = [(got[i] >= 0.5) == bool(kinds[i % 12][1]) for i in range(1200, 1600)]
    assert sum(right) >= 380


def test_scores(spark, docs, no_docs):
    texts = [(i, (f"{prose(i, 20)} awful scum" if i % 5 == 0 else prose(i, 22)), "x") for i in range(400)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (5, 0), (7, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.learn(rows, labels)
    again = toxicity.learn(rows.unionByName(rows), labels)  # repeated rows count once
    assert again.ids.tolist() == model.ids.tolist() and np.allclose(again.weight, model.weight)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(rows, model).collect()}
    late = [(got[i] >= 0.5) == (i % 5 == 0) for i in range(300, 400)]
    assert sum(late) == 100
    assert Counter(r["doc_id"] for r in toxicity.scored(docs, model).collect()) == Counter(r["doc_id"] for r in docs.collect()) and toxicity.scored(no_docs, model).count() == 0
    assert model.score(None) == model.score("") < 0.5
    empty = toxicity.learn(rows, labels.limit(0))
    assert 0.49 < empty.score("scum") < 0.5
    odd = ["awful scum " * 3, texts[0][1], "awfully scummy", "größe Größen größenwahn grö ñandúes ñan 漢字漢字漢字 \ud800abcdef", "a ab abc abcd abcde abcdef abcdefgh abcdefghi abcdefghijk " * 2, "", None]
    some = sorted({x for t in odd for x in toxicity.terms(t)})
    all_known = toxicity.Model(np.array(some[::2]), np.zeros(len(some[::2])), np.zeros((len(some[::2]), 2)), 0.0)
    for m in (model, all_known):
        reader = toxicity.Reader(m)
        for _ in range(2):
            for t, at in zip(odd, reader.found(odd)):
                assert m.ids[at].tolist() == sorted(x for x in toxicity.terms(t) if m.place[x] >= 0), t
            reader.clear()


def test_held_out_accuracy(spark, sf_dir):
    path = sf_dir.replace("sf0.001", "sf0.01")
    out = toxicity.op7_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out").collect()
    wrong = Counter((r["predicted"], r["toxic"]) for r in out if r["predicted"] != r["toxic"])
    assert sum(wrong.values()) <= 0.08 * len(out) and wrong[1, 0] <= 1


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline
    from tests.llm.test_ngram_packing import brute as all_links

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        got = Counter(r["doc_id"] for r in after.collect())
        if name != "packing":
            assert after.columns == docs.columns
        if name == "ngram_join":
            want = all_links(before)
            assert got == Counter({k for k, (root, _) in want.items() if k == root})
        if name == "pii":
            assert got == Counter(before.keys()) and not any(re.search(r"@mail\d\.example\.com", r["text"]) for r in after.collect())
        if name in ("quality_rules", "mixing", "packing"):
            assert set(got) <= set(before)
        docs = after
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_stages_on_odd_and_empty_tables(spark, docs, no_docs, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and clashing names; and no rows at all."""
    import corpus_pipeline

    for at, rows in enumerate((docs, no_docs)):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, now, "").write.parquet(f"{tmp_path}/{at}-{name}")
            now = spark.read.parquet(f"{tmp_path}/{at}-{name}")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert now.columns == docs.columns, name
            if name == "quality_rules":
                assert all(len((r["text"] or "").split()) >= 20 for r in now.collect())
            if name == "ngram_join":
                texts = [r["text"] for r in now.collect()]
                assert len(texts) == len(set(texts))
        assert (now.count() == 0) == (at == 1)

"""Operators that learn, and those whose output is read back."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from factloom.llm import chat, classifier, html_extract
from factloom.llm.html_pages import MARK, _page
from factloom.llm.html_tree import parse


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = classifier.scores(docs, labels)
    assert rows.count() == docs.count()
    held = rows.where("held_out").join(labels, "doc_id")
    assert held.select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, classifier.scores(docs.repartition(5), labels).collect()))


def test_classifier_without_labels_and_texts(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (1, "la " * 50_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, None), (7, 0)], "doc_id long, quality int")
    rows = classifier.scores(docs, labels.limit(0)).collect()
    assert {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {0} and len(rows) == 4
    assert classifier.scores(docs.limit(0), labels).count() == 0


def test_chat_round_trip():
    machine = chat.Machine(chat.Template())
    rng = random.Random(3)
    parts = ["<", "/", "s", ">", "[", "INST", "]", " ", "\\", "SYS", "<<", "ANS", "[/INST]", "</s>", "[:]", "[ROLE ", "a", "é", "\n"]
    for _ in range(5000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "x[:] y"]), "".join(rng.choice(parts) for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(1, 5))]
        text = "".join(s for role, t in turns for s, _ in machine.segments(role, t))
        assert [(r, t) for r, t, _ in machine.read(text)] == turns
        assert not any(c in machine.escape(t) for _, t in turns for c in machine.template.controls())


def test_chat_orders_turns_and_flags_losses(spark):
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, "user", "a", "x"), (2, 0, "assistant", None, "x"), (2, 1, None, "q", "x"), (None, 0, "user", "n", "x"), (1, 2, "user", "c" * 200_000, "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.digests(table, run_turns=1).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].n_invalid) == (3, 1, 0)
    assert (got[2].n_turns, got[2].n_invalid, got[2].loss_chars) == (2, 2, 0) and got[None].n_turns == 1
    out = chat.segments(table).where("conv_id = 1").collect()
    assert [r.segment for r in out if r.loss] == ["b"]
    assert sum(len(r.segment) for r in out) == got[1].formatted_chars
    assert chat.digests(table.limit(0)).count() == 0


@pytest.fixture(scope="module")
def forest():
    return html_extract.train()


def test_extraction_of_held_out_pages(forest):
    rng = random.Random(99)
    hit = wrong = missed = 0
    for _ in range(150):
        nodes = parse(_page(rng))
        kept = html_extract.decode(nodes, forest.logits(html_extract.features(nodes)))
        for node, keep in zip(nodes, kept):
            if node.tag == "#":
                main = any(w.startswith(MARK) for w in node.text.split())
                hit += len(node.text) * (main and keep)
                wrong += len(node.text) * (keep and not main)
                missed += len(node.text) * (main and not keep)
            assert not keep or kept[node.parent] or node.parent < 0
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


def test_extraction_of_stored_pages(spark, forest):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(rows, forest).collect()}
    import html

    for r in rows.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_pages(spark, forest):
    sources = [None, "", "<", "<p", "<p>a", "a <b>c", "<div>" * 2000 + "x", "<!-- <p>no</p> -->", "<script>var a='<p>no</p>'</script>", "<table><tr><td>a<td>b<tr><td>c", "&lt;p&gt; &amp;amp; &#x41;", "<article>" + "<p>some words here.</p>" * 3]
    rows = spark.createDataFrame([(k, "u", s, "t") for k, s in enumerate(sources)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_extract.extract(rows, forest).collect()}
    assert len(got) == len(sources) and got[0] == got[1] == got[7] == got[8] == ""
    assert got[11] == "\n".join(["some words here."] * 3)
    assert [n.text for n in parse("<p>&lt;b&gt; x<br>y &amp;amp; <i>z</i></p>w") if n.tag == "#"] == ["<b> x y &amp; z", "w"]
    assert [n.text for n in parse("<table><tr><td>a<td>b<tr><td>c") if n.tag == "#"] == ["a", "b", "c"]


def texts(source, **how):
    return [n.text for n in parse(source, **how) if n.tag == "#"]


def test_attributes_as_browsers_read_them():
    assert texts("<p data-x=it's>one two</p><p>three</p><p>don't</p><p>four</p>") == ["one two", "three", "don't", "four"]
    assert texts("<p title='a > b'>x</p><p title=\"it's > \">y</p><p a'b=c>z</p><p x = 'q>'>w</p><p x=>v</p><p/>u") == ["x", "y", "z", "w", "v", "u"]
    assert texts("<a href=a/b'c>link</a> text <p class=it's id='m'>more") == ["link text", "more"]
    node = parse("<div data-k=it's class=\"entry-content\">x")[1]
    assert node.tokens == ("entry", "content")


def test_formulas_raw_text_and_marked_sections():
    assert texts("<p>Let <math><mi>x</mi></math> be one.") == ["Let x be one."]
    assert texts("<p><math><semantics><mi>x</mi><annotation encoding='t'>\\x<b></annotation></semantics></math>, z") == ["x, z"]
    assert texts("<p>a<xmp>shown <b> &amp; text</xmp>c<xmp>open") == ["a", "shown <b> &amp; text", "c", "open"]
    assert texts("<head><xmp>q</xmp></head>z<svg><text>q</text></svg>") == ["z"]
    assert texts("<p>x<math><mtext><![CDATA[a>b & c]]></mtext></math>y<![CDATA[p>q]]>") == ["xa>b & cyq]]>"]
    assert texts("<math><![CDATA[abcdef") == ["abcdef"] and texts("<p>x<![CDATA[abcdef") == ["x"] and texts("<math/><![CDATA[z]]>w") == ["w"]
    start = time.monotonic()
    assert texts("<math>" + "<![CDATA[x" * 200_000) == ["x<![CDATA[" * 199_999 + "x"] and texts("<p>" + "<![CDATA[x>" * 200_000 + "y") == ["y"]
    assert time.monotonic() - start < 20


def test_noscript_counts_only_where_nothing_else_does(spark, forest):
    body = "".join(f"<p>Sentence number {k} of the story, which is long enough to be read.</p>" for k in range(6))
    pages = [f"<body><script>x()</script><noscript><article>{body}</article></noscript></body>", f"<body><noscript>Please switch scripts on.</noscript><article>{body}</article></body>"]
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "'u' url", "html")
    got = {r.page_id: r.text for r in html_extract.extract(rows, forest).collect()}
    assert got[0] == got[1] and got[0].count("\n") == 5


def test_deep_nesting_takes_linear_time(forest):
    start = time.monotonic()
    for page in ("<div>" * 200_000 + "x" + "</div>" * 200_000, "<ul><li>" * 50_000 + "x", "<p><div>" * 50_000 + "<li>y"):
        assert len(html_extract.main_texts([page], forest)) == 1
    assert time.monotonic() - start < 60


def test_training_sample_is_bounded_by_rows_and_bytes(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k % 80} " * (1 + k % 3)) for k in range(400)] + [(41, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(42)] + [(7, None), (9, 3)], "doc_id long, quality int")
    rows = classifier.sample(docs, labels, 10)
    assert 0 < len(rows) <= 20 and {label for _, _, label in rows} == {0, 1}
    again = classifier.sample(docs.repartition(5).unionByName(docs), labels, 10)
    assert [(a.tolist(), b.tolist(), c) for a, b, c in rows] == [(a.tolist(), b.tolist(), c) for a, b, c in again]
    few = classifier.sample(docs, labels, 10, 500)
    assert len(few) < len(rows) and sum(a.nbytes + b.nbytes for a, b, _ in few) <= 500

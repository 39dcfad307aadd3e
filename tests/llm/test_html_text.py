import os
import re
import sys
import time

import pytest
from pyspark.sql import functions as F

from stationflow.llm import queries as Q
from stationflow.llm.html_text import ChainCRF, extract_text, features, labelled_pages, leaf_blocks, main_text, train, viterbi

sys.path.insert(0, os.path.dirname(__file__))
from page_forms import FORMS  # noqa: E402

MODEL = train(500)


def test_held_out_pages():
    wrong = n = 0
    for page, labels in labelled_pages(150, seed=77):
        blocks = leaf_blocks(page)
        gain = [sum(MODEL[0].get(f, 0.0) for f in fs) for fs in features(blocks)]
        wrong += sum(a != b for a, b in zip(viterbi(gain, MODEL[1]), labels, strict=True))
        n += len(labels)
    assert wrong < 0.01 * n


def test_given_pages(spark):
    import html

    for r in Q.op3_html_extraction(spark, "/root/testdata/sf0.001").collect():
        page = spark_pages(spark)[r.page_id]
        inner = (re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S) or [None, ""])[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", p)).split()) for p in re.split(r"</?p>|</?h1>", inner))
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


_PAGES = {}


def spark_pages(spark):
    if not _PAGES:
        _PAGES.update({r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()})
    return _PAGES


def test_other_layouts():
    page = """<html><head><title>t</title><style>x</style></head><body><header class=site><a href=/>Home</a></header><div class="cookie-banner">We use cookies to do things for you.</div>
    <main><article><h1>A &amp; B</h1><p>First   <em>line</em>&nbsp;one.</p><script>no()</script><div class="ad-slot">Buy this now, a lot of words in here.</div><p>Second
    line.<p>Third &#233;.</article></main><aside class="sidebar"><p>Other story about something else.</p></aside><section id="comments"><div class="comment"><p>I liked reading this page very much indeed.</p></div></section>
    <form action="/s"><label>Search</label><input></form><footer>&copy; 2024</footer></body></html>"""
    assert main_text(page, MODEL) == "A & B\n\nFirst line one.\n\nSecond line.\n\nThird é."


def test_viterbi_is_the_best_path():
    import itertools

    gain, moves = [0.5, -2.0, 1.0, 0.2], [[0.3, -0.7], [-0.2, 0.6]]
    score = lambda p: sum(g for g, x in zip(gain, p, strict=True) if x) + sum(moves[a][b] for a, b in itertools.pairwise(p))
    assert score(viterbi(gain, moves)) == max(score(p) for p in itertools.product((0, 1), repeat=4))
    assert viterbi([], moves) == [] and ChainCRF().fit([]).compact()[0] == {}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "<p>x"), (4, "<article><p>a</p></article>"), (4, "<article><p>a</p></article>"), (5, "<" * 3000), (6, "<article><h1>t</h1>" + "<p>long text here.</p>" * 5000), (7, "<article><p>cut &am"), (8, '<article><p class="x" title="a>b">in</p><a href="un')]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit(None).cast("string")).withColumn("text", F.lit(5))
    got = [(r.page_id, r.text) for r in extract_text(df).collect()]
    assert len(got) == len(rows) and dict(got)[1] == dict(got)[2] == dict(got)[3] == ""
    assert dict(got)[6].count("long text here.") == 5000 and "in" in dict(got)[8]
    assert extract_text(df.limit(0)).count() == 0


def test_attributes_of_any_length():
    for quote in "\"'":
        value = "<p>inside > " * 1000
        blocks = leaf_blocks(f"<p>before</p><div data-x={quote}{value}{quote} class={quote}sidebar{quote}>after</div>")
        assert [b.text for b in blocks] == ["before", "after"] and "side" in blocks[1].hints
        assert [b.text for b in leaf_blocks(f"<p>before</p><div data-x={quote}{value}<p>lost</p>")] == ["before"]
    assert [b.text for b in leaf_blocks("<p don't>one</p><p \"x>two</p>")] == ["one", "two"]


def test_raw_text_ends_in_any_case():
    page = "<p>İ one</p><SCRIPT>var a = '<p>no</p>';</Script ><p>two</p><style>x</STYLE><title>t</TITLE\n><p>three</p>"
    assert [b.text for b in leaf_blocks(page)] == ["İ one", "two", "three"]
    assert [b.text for b in leaf_blocks("<p>a</p><script>b")] == ["a"]


def test_block_ends_an_open_paragraph_at_any_depth():
    blocks = leaf_blocks('<div><p class="ad">one<b><i><u><s><em><q>deep<div>two</div><p>three<table><tr><td>four</table>five')
    assert [(b.text, "ad" in b.hints) for b in blocks] == [("onedeep", True), ("two", False), ("three", False), ("four", False), ("five", False)]


@pytest.mark.parametrize("name", FORMS)
def test_page_forms(name):
    body, want = FORMS[name]
    for page in (body, f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>"):
        assert main_text(page, MODEL).split("\n\n") == want


@pytest.mark.parametrize("tags", ["<div>", "<b>", "<li><div>", "<p><b>", "<table><tr><td>", "</div><p>", "<ul><li>", "<div></b>"])
def test_time_grows_with_the_page(tags):
    def took(n):
        began = time.process_time()
        leaf_blocks(tags * n + "end")
        return time.process_time() - began

    assert took(100_000) < 8 * took(25_000) + 0.5

"""What the extraction must leave in articles, deep and long pages, and tables at their edges."""

import time

import pytest
from pyspark.sql import functions as F

from papergraph.llm.html_text import extract_text, read_page


def texts(spark, pages):
    rows = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in extract_text(rows).orderBy("page_id").collect()]


@pytest.mark.parametrize("n", [1, 4, 6, 30])
def test_a_paragraph_that_all_pages_have_stays(spark, n):
    shared = "This is one of our weekly columns on physics."
    pages = [(f"http://h/{i}", f"<article><h1>T{i}</h1><p>{shared}</p><div><p>also shared</p></div><ul><li>item</ul><p>body {i}</p></article>") for i in range(n)]
    assert texts(spark, pages) == [f"T{i} {shared} also shared item body {i}" for i in range(n)]


def test_a_paragraph_ends_behind_any_number_of_inline_elements():
    assert read_page("<p class=notice><b><i><u><em>n<p>kept", set()) == "kept"
    assert read_page("<p class=notice><b><i><u><em><s><q>n<div>kept</div>", set()) == "kept"
    assert read_page("<p>a<b>b<div>c", set()) == "ab c"


def test_words_of_noise_that_do_not_name_an_element():
    for name in ("related-work", "form-of-life", "search-space", "share-price", "reply-rate"):
        assert read_page(f"<article><p>a</p><div class='{name}'>b</div></article>", set()) == "a b"
    for name in ("related-posts", "share-buttons", "ad", "ad-slot", "comment-list", "top_ad", "navMenu nav-menu", "site-nav", "newsletter-signup", "post-comments"):
        assert read_page(f"<article><p>a</p><div class='{name}'>b</div></article>", set()) == "a"


def test_deep_and_long_pages():
    deep = "<div>" * 16_000 + "x" + "</div>" * 16_000
    began = time.process_time()
    assert read_page(deep, {1}) == "x"
    assert time.process_time() - began < 3
    long = "<article>" + "".join(f"<p>word{i}</p>" for i in range(50_000)) + "</article>"
    assert read_page(long, {1}).split()[-1] == "word49999"


def test_edges_of_the_table(spark):
    schema = "page_id long, url string, html string, text string, host string, low long"
    rows = spark.createDataFrame([(1, "http://h/", "<p>a", "x", "y", 1), (1, "http://h/", "<p>a", "x", "y", 1), (None, None, "<p>b", None, None, None), (3, "no url", None, None, None, None), (4, "", "", None, None, None)], schema)
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract_text(rows).collect())
    assert got == [(0, "b", 1), (1, "a", 1), (1, "a", 1), (3, "", 0), (4, "", 0)]
    assert extract_text(rows.where(F.lit(False))).collect() == []

"""The element tree and its selectors against plain ancestor walks, and the listings' order of strategies."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.plans import listings
from tidewell.sources import html_sources
from tidewell.sources.elements import VOID, Page, parsed


def brute(page, selector):
    """Elements whose chain of ancestors fulfils the steps, by trying every ancestor."""

    def holds(k, steps):
        child, compound = steps[-1]
        if not compound.matches(page.elements[k]):
            return False
        if len(steps) == 1:
            return True
        p = page.elements[k].parent
        while p >= 0:
            if holds(p, steps[:-1]):
                return True
            if child:
                return False
            p = page.elements[p].parent
        return False

    return [k for k in range(len(page.elements)) if any(holds(k, steps) for steps in parsed(selector))]


@pytest.mark.parametrize("seed", range(15))
def test_selectors_equal_ancestor_walks(seed):
    r = random.Random(seed)
    html = ""
    for _ in range(150):
        tag = r.choice(["div", "ul", "li", "a", "p", "br", "span"])
        if r.random() < 0.4:
            html += f"</{tag}>"
        else:
            html += f'<{tag} class="{" ".join(r.sample(["list_a", "rank", "x", "Top"], r.randrange(3)))}" id="{r.choice("ab")}" href="/{r.choice(["news", "article"])}/{r.randrange(3)}">'
        html += r.choice(["", "t ", "1 < 2 & 3", "<!-- no -->"])
    page = Page(html)
    for s in ("ul li", "ul > li", "div ul > li a", ".rank", "div.list_a, li#b > a", "[class*='list']", "a[href^='/news/']", "a[href$='2'] span", "[class*='top' i] a", "div div > p", "p p p", "*", "a[href='/news/1']"):
        assert page.select(s) == brute(page, s), s
    for k, e in enumerate(page.elements):
        inside = [j for j in range(len(page.elements)) if j > k and _has_ancestor(page, j, k)]
        assert inside == list(range(k + 1, e.last + 1))
        assert e.tag not in VOID or not inside


def _has_ancestor(page, j, k):
    while j >= 0 and j != k:
        j = page.elements[j].parent
    return j == k


def test_texts():
    page = Page("<div> a &lt; b <b>c</b><script>d</script> 1 < 2 <!-- e -->f<br>g</div></p>tail<style>x</style>")
    assert page.text(0) == "a < bc1 < 2fg" and page.text(0, " ") == "a < b c 1 < 2 f g"
    assert Page("").elements == [] and Page("no tags").texts == ["no tags"] and Page("<div").elements == []


def test_strategies_limits_and_odd_pages(spark):
    def page(body):
        return listings._NAV + body

    entry = "".join(f'<li><a href="/v/{k % 70}">Entry number {k % 70}</a></li>' for k in range(140))
    pages = [
        (1, page(f'<ul class="mb16">{entry}</ul>')), (2, page('<ul class="mb16"><li>nothing</li></ul><p><a href="/article/1">fallback entry</a></p>')), (3, None), (4, ""), (5, page("")),
        (None, page('<ul class="mb16"><li><a href="http://e.example/x">Some entry</a></li></ul>')), (7, page(f'<div id="ranking"><ul>{entry}</ul></div>')),
    ]
    got = html_sources.listed(spark.createDataFrame(pages, "page_id long, html string"), "goo_news").collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.rank_position, r.title, r.url))
    assert sorted(by[1]) == [(k + 1, f"Entry number {k}", f"https://news.goo.ne.jp/v/{k}") for k in range(50)] == sorted(by[7])
    assert by[2] == [(1, "fallback entry", "https://news.goo.ne.jp/article/1")] and by[None] == [(1, "Some entry", "http://e.example/x")]
    assert set(by) == {1, 2, 7, None}


def test_a_container_without_items_keeps_the_fallback_out(spark):
    html = '<div class="category-wrap_1"><p>no link</p></div><ul><li><a href="/x">A title</a></li></ul>'
    assert html_sources.listed(spark.createDataFrame([(1, html)], "page_id long, html string"), "baidu_hot").count() == 0


def test_counts_with_k(spark):
    shown = ["1,234", "12.5k", "1,234 stars today", "", None, "many", "k", "2.5"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in shown], "s string").select(html_sources.count_with_k(F.col("s"))).collect()]
    assert got == [1234, 12500, 1234, 0, 0, 0, 0, 0]

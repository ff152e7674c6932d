"""Scalar functions on literal cases."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import collections as C
from tidewell.functions import numbers as N
from tidewell.functions import text as X
from tidewell.functions import times as T
from tidewell.functions import urls as U


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def run(column):
        return one.select(column.alias("v")).first()["v"]

    return run


L = F.lit


def null(kind="string"):
    return F.lit(None).cast(kind)


def test_text(value):
    assert value(X.canonical_hash(L(" Title　"), L("URL "))) == value(F.sha2(L("title|url"), 256))
    assert value(X.canonical_hash(null(), null())) == value(F.sha2(L("|"), 256))
    assert value(X.strip(L("　a b\t"))) == "a b"
    assert value(X.squeeze(L("  a \n\n b　c "))) == "a b c"
    assert value(X.snippet(L("abcdef"), 3)) == "abc..." and value(X.snippet(L("abc"), 3)) == "abc"
    assert value(X.without_tags(L("<p>A&amp;B</p><script>x()</script> <b>c</b>"))) == "A&B c"
    assert value(X.comment_text(L("<p>a &gt; b&#x27;s</p>  c"))) == "a > b's c"
    assert value(X.template("{a}-{b}", {"a": L(1), "b": null()})) == "1-"
    assert value(X.salvaged_array(L('```json\n["a", [1]]\n``` end'))) == '["a", [1]]' and value(X.salvaged_array(L("none"))) is None
    assert value(X.numbered_parts(L("[1] first\nline\n[2]  second\n[3]  "))) == {1: "first\nline", 2: "second"}
    assert value(X.embedding_text(L("t"), L("d"), F.array(*[L(str(i)) for i in range(7)]))) == "t d [comments: 0 | 1 | 2 | 3 | 4]"
    assert value(X.embedding_text(L("t"), null(), null("array<string>"))) == "t"
    assert [value(X.short_number(L(n))) for n in (999, 1234, 4_500_000)] == ["999", "1.2K", "4.5M"]
    assert value(X.engagement_line(L(1500), L(0), L(7), null("int"), L(3))) == "🎬 1.5K views · 3 🔁"
    assert value(X.engagement_line(null("int"), null("int"), L(7), null("int"), L(3))) == "🔥 7 pts · 3 🔁"
    assert value(X.numbered_list(F.array(L("a"), L("b")))) == "1. a\n2. b"
    assert [value(X.masked_secret(L(s))) for s in ("", "short", "sk-1234567890abcd")] == ["(not set)", "***", "sk-1234...abcd"]
    assert [value(X.ago_label(L(s))) for s in (59.9, 3599, 7200, 200000)] == ["59s ago", "59m ago", "2h ago", "2d ago"]
    assert [value(X.duration_label(L(s))) for s in (999, 1500, 90000)] == ["999ms", "1.5s", "1.5m"] and value(X.duration_label(null("int"))) == "-"
    assert value(X.max_age(L("public, max-age=600"))) == 600 and value(X.max_age(L("no-store"))) is None


def test_urls(value):
    assert value(U.domain(L("https://news.ycombinator.com/news"))) == "news.ycombinator.com"
    assert value(U.domain(L("http://example.com:8080/path"))) == "example.com"
    n = lambda u: value(U.normalized(L(u)))
    assert n("https://e.com/p?b=2&a=1") == n("https://e.com/p?a=1&b=2") == "https://e.com/p?a=1&b=2"
    assert n("https://e.com/p?id=123&utm_source=twitter&FBCLID=xyz#frag") == "https://e.com/p?id=123"
    assert n("HTTP://EXAMPLE.COM/PAGE") == "http://example.com/PAGE"
    assert n("http://e.com:80/a") == "http://e.com/a" and n("https://e.com:80/a") == "https://e.com:80/a" and n("https://e.com:443") == "https://e.com"
    assert n("https://e.com/?z=&a=2&a=1&q") == "https://e.com/?a=2&a=1&q=&z="
    assert len(value(U.url_hash(L("https://example.com/page?b=2&a=1")))) == 64
    assert value(U.favicon(L("https://e.com/a/b"))) == "https://e.com/favicon.ico"


def test_times(value):
    ts = lambda s: F.lit(s).cast("timestamp")
    assert value(T.hours_between(ts("2024-01-01 00:00:00"), ts("2024-01-01 01:30:00"))) == 1.5
    assert value(T.hours_between(ts("2024-01-02 00:00:00"), ts("2024-01-01 00:00:00"))) == 0.0
    assert value(T.hour_key(ts("2026-02-18 15:42:00"))) == "2026-02-18-15"
    assert value(T.parsed_hour_key(L("2026-02-18-15"))) == datetime(2026, 2, 18, 15)
    assert [value(T.url_date(L(u))) for u in ("/2024-01-31/x", "https://a/2024/02/03/y.html", "/n/20240105/", "/2024-13-45/")] == [date(2024, 1, 31), date(2024, 2, 3), date(2024, 1, 5), None]
    today = F.lit("2024-01-31").cast("date")
    assert value(T.age_days(L("2024-01-01"), today)) == 30 and value(T.age_days(L("bad"), today)) == 0
    assert value(T.elapsed(null("timestamp"), ts("2024-01-01 00:00:00"), L(60)))
    assert not value(T.elapsed(ts("2024-01-01 00:00:00"), ts("2024-01-01 00:00:59"), L(60)))


def test_hotness(value):
    w = lambda u, s, r: value(N.engagement_weight(N.first_signal([u, s]), L(0), L(0), L(0), r))
    assert w(L(0), L(50), null("int")) == 50 and w(null("int"), L(0), L(0)) == 0
    assert [w(L(0), L(0), L(r)) for r in (1, 100, 101)] == [990, 0, 0] and w(L(-5), L(1), null("int")) == 0
    assert value(N.hotness(L(0.0), L(3.0))) == 0
    assert value(N.hotness(L(99.0), L(-2.0))) == pytest.approx(200.0)
    assert value(N.hotness(L(99.0), L(10.0))) == pytest.approx(200 * math.exp(-0.5))
    assert [value(N.band(L(float(x)))) for x in (500, 499, 200, 100, 50, 0)] == ["Top 1%", "Top 5%", "Top 10%", "Top 25%", "Top 50%", "Bottom 50%"]
    due = lambda h, c, o: value(N.needs_recompute(h, L(c), L(o)))
    assert due(null("double"), 0.0, 0.0) and due(L(1.0), 6.0, 100.0) and due(L(1.0), 3.0, 47.0) and not due(L(1.0), 3.0, 48.0) and not due(L(1.0), 2.9, 1.0)
    signals = F.create_map(L("score"), L(0.0), L("points"), L(4.0))
    assert value(N.map_signal(signals, "upvotes")) == 4 and value(N.map_signal(signals, "views")) == 0


def test_number_parsing(value):
    assert [value(N.cjk_number(L(s))) for s in ("3856万", "1.2亿", "56789热度", "56,789", "", "garbage", "1.2.3万")] == [38_560_000, 120_000_000, 56789, 56789, 0, 0, 0]
    assert [value(N.abbreviated_number(L(s))) for s in ("1,234", "12.5k", "1,234 stars today", "", "x")] == [1234, 12500, 1234, 0, 0]
    assert [value(N.reddit_upvotes(L(s), L(r))) for s, r in ((100, 0.75), (10, 0.5), (10, 0.0), (10, 0.25))] == [200, 10, 0, -20]
    assert [value(N.truncated_percent(L(27), p)) for p in (10, 50)] == [2, 13]
    assert [value(N.quota_target(L(n), 10)) for n in (1, 10, 19, 20, 300)] == [1, 2, 2, 2, 30]
    assert value(N.percent(L(1), L(0))) == 0 and value(N.percent(L(1), L(3))) == 33.33
    assert [value(N.backoff_delay(L(n))) for n in (0, 3, 9)] == [1, 8, 60]
    assert value(N.budget_cap(L(100), 1)) == 30 and value(N.budget_cap(L(3), 5)) == 5


def test_collections(value):
    arr = lambda *x: F.array(*[L(v) for v in x])
    assert value(C.first_other_than(arr("us", "cn"), "us")) == "cn" and value(C.first_other_than(arr("us"), "us")) == "us"
    assert value(C.sorted_set(F.array(L("b"), null(), L("a"), L("b")))) == ["a", "b"]
    assert value(C.allowed(arr("a", "x", "b"), ["b", "a"])) == ["a", "b"]
    assert value(C.highest_priority(arr("sports", "ai"), ["ai", "sports"])) == "ai" and value(C.highest_priority(arr("x"), ["ai"])) is None
    assert value(C.zipped(arr("a", "b"), arr(1))) is None and len(value(C.zipped(arr("a"), arr(1)))) == 1
    assert value(C.positive_entries(F.create_map(L("a"), L(1), L("b"), L(0)))) == {"a": 1}
    assert [value(C.batch_number(L(n), 20)) for n in (1, 20, 21)] == [0, 0, 1]


def test_one_decimal_equals_c(spark):
    """Halves that a double holds go to the even digit; others by the double's exact value."""
    rows = [(n, d) for d in (1000.0, 60000.0, 1_000_000.0) for n in [*range(0, 12_000, 10), *range(999_000, 1_003_000, 50), *range(0, 30_000_000, 50_000), 2**53 + 1, 10**17 + 50_000]]
    got = spark.createDataFrame(rows, "n long, d double").select("n", "d", X.one_decimal(F.col("n") / F.col("d")).alias("s")).collect()
    assert len(got) == len(rows) and [(r.n, r.d, r.s) for r in got if r.s != f"{r.n / r.d:.1f}"] == []
    halves = spark.createDataFrame([(n,) for n in (1250, 1150, 1350, 999_950, 1_250_000)], "n long")
    assert [r.s for r in halves.select(X.short_number(F.col("n")).alias("s")).collect()] == ["1.2K", "1.1K", "1.4K", "1000.0K", "1.2M"]

"""Style trees: what they remove by themselves, entropies against brute force, odd and long pages."""

import math
import time
from collections import Counter, defaultdict

import pytest
from pagewright.llm import html
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows, **more):
    return {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, SCHEMA), **more).collect()}


def soup(k):
    return (
        f"<body><div class=x1><a href=/>Home</a> <a href=/about>About us</a> <a href=/item/{k}>Item {k}</a> <a href=/help>Help</a></div>"
        f"<div class=x2><p>First words {k} of a text that goes on {k * 7} times.</p><p>Then {k * k} more of it and {k + 5} again, all {k * 3} new.</p></div><div class=x3>All rights kept since {1990 + k % 2}</div>"
    )


def test_the_tree_alone_removes_menus_whose_links_vary(spark):
    rows = [(k, "https://h.example/", soup(k)) for k in range(40)] + [(99, "https://alone.example/", soup(1))]
    want = {k: f"First words {k} of a text that goes on {k * 7} times.\n\nThen {k * k} more of it and {k + 5} again, all {k * 3} new." for k in range(40)}
    got = texts(spark, rows)
    assert {k: got[k] for k in range(40)} == want
    assert got[99].startswith("Home") and "All rights" in got[99]  # a single page has no entropies
    assert texts(spark, rows, most=0) == got  # the way for many places of little importance


@pytest.mark.parametrize(
    "page", ["<article id='search-algorithms'>Text</article>", "<main class='search-results'>Text</main>", "<article><p class='notice-of-award'>Text</article>", "<article><div class='related-work'>Text</div></article>"]
)
def test_words_of_a_name_do_not_decide(page):
    assert html.extract(page) == "Text"


def test_tagged_parts_go_without_a_tree():
    page = "<body><header>H</header><div class='site-nav'>N</div><div role=navigation>R</div><p>A<aside>S</aside><div class='cookie-notice'>C</div><div hidden>D</div><section class='user comments'>U</section><footer>F</footer>"
    assert html.extract(page) == "A"


def test_importance_by_brute_force(spark):
    pages = [soup(k % 9) for k in range(30)] + ["<body><div class=x1>Home<b>x</b></div>", "", None]
    rows = [(k, "https://h.example/", p) for k, p in enumerate(pages)]
    table = spark.createDataFrame(rows, SCHEMA).select(F.lit(5).cast("long").alias("host"), F.xxhash64(F.lit("h"), "html").alias("key"), "html").repartition(3)
    seen, shapes, found = Counter(), defaultdict(Counter), defaultdict(Counter)
    for p in set(pages):
        for place, (shape, f) in html.features(html.parse(p or "")).items():
            seen[place] += 1
            shapes[place][shape] += 1
            found[place].update(f)
    got = {r.place: r for r in html.style_tree(table).collect()}
    assert set(got) == set(seen) and len(got) >= 2
    for place, r in got.items():
        m, g = seen[place], 0.9 ** len(shapes[place])
        content = 1 - sum(n * math.log(n) for n in found[place].values()) / (found[place].total() * math.log(m)) if m > 1 else 1
        shape = -sum(n / m * math.log(n / m) for n in shapes[place].values()) / math.log(m) if m > 1 else 1
        assert r.seen == m and math.isclose(r.importance, (1 - g) * shape + g * content, abs_tol=1e-9)


@pytest.mark.parametrize(
    "page", ["<a <a " * 170_000, "<i>" * 60_000 + "<div>" + "</b>" * 60_000, "<b><div>" + "<i>" * 60_000 + "</b>" * 60_000, "<div>" * 60_000 + "</p>" * 60_000, "<a '>' " * 100_000, "<p>word </p>" * 80_000, "<ul>" * 60_000 + "<li>" * 60_000, "<!--" * 90_000]
)
def test_long_pages_take_time_in_proportion(page):
    start = time.process_time()
    html.extract(page, frozenset([1]))
    html.features(html.parse(page))
    assert time.process_time() - start < 20


def test_references_quotes_and_raw_text():
    assert html.extract("<p title='a>b'>x &lt;b&gt; &amp;amp;<script>if (a<b) '</p>'</script> y</p>1 < 2 <![CDATA[&amp;]]><!-- no -->!") == "x <b> &amp; y\n\n1 < 2 &amp;!"
    assert html.extract("<div>a<div>b<p>c</div>d") == "a\n\nb\n\nc\n\nd"

"""Pages whose text must come out whole."""

import random

import pytest

from lumenmill.llm import html_extract
from lumenmill.llm.common import prepare


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.extract(df).collect()}


def words(rng, n=12):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_pages_without_the_hosts_article_keep_their_text(spark):
    rng, rows, want = random.Random(1), [], {}
    for i in range(20):
        body = words(rng)
        rows.append((i, f"http://h.example/{i}", f"<body><p>Welcome</p><div class=content><p>{body}</p></div></body>"))
        want[i] = body
    rows.append((50, "http://h.example/a", "<body><article><p>an article</p></article></body>"))
    rows += [(60, None, "<article>one</article>"), (61, None, "<p>two</p>"), (62, "odd", "<main>three</main>")]
    assert texts(spark, rows) == want | {50: "an article", 60: "one", 61: "two", 62: "three"}


def test_the_wrapper_is_asked_where_an_article_is(spark):
    """Template text inside the article goes; text beside a small article stays; repeats on one page are no template."""
    rng, rows, want = random.Random(2), [], {}
    for i in range(8):
        body, more = words(rng), words(rng, 40)
        beside = f"<div class=story><p>{more}</p></div>" if i < 3 else ""
        rows.append((i, f"http://h.example/{i}", f"<body><article><h2><a href=/{i}>Head {i}</a></h2><p>{body}</p><div class=by>Written by us</div></article>{beside}</body>"))
        want[i] = f"Head {i}\n{body}" + (f"\n{more}" if beside else "")
    for i in range(20, 23):
        echo = "<blockquote>echo</blockquote>" * 3 if i == 20 else ""
        rows.append((i, f"http://e.example/{i}", f"<article><p>t{i}</p>{echo}</article>"))
        want[i] = f"t{i}" + "\necho" * (3 if i == 20 else 0)
    assert texts(spark, rows) == want


def test_texts_that_only_start_alike_are_no_template(spark):
    rng, rows, want = random.Random(3), [], {}
    lead = "LONDON (Agency) " + words(rng, 60)
    for i in range(8):
        body = f"{lead} {words(rng, 5)}"
        rows.append((i, f"http://h.example/{i}", f"<body><div><p>{lead}</p></div><div class=content><h2>{words(rng, 3)}</h2><p>{body}</p></div></body>"))
        want[i] = body
    got = texts(spark, rows)
    assert {i: t.split("\n")[-1] for i, t in got.items()} == want and all(len(t.split("\n")) == 2 for t in got.values())


def test_names_that_only_contain_a_drop_word_lose_nothing(spark):
    pages = {
        "<body class='no-sidebar'><p>a</p></body>": "a",
        "<body class='single comments-open'><p>b</p></body>": "b",
        "<body class='login'><div class='page-with-sidebar'><p>c</p></div></body>": "c",
        "<article class='post share-enabled'><div class='article-header'><h1>T</h1></div><p>d</p></article>": "T\nd",
        "<article class='post promo'><p>the whole of it</p><div class='share-box'>Share</div><div id='ad-7'>Buy</div></article>": "the whole of it",
        "<div class='sidebar'><article><p>f</p></article><p>menu</p></div><p>x</p>": "f\nx",
        "<form id='aspnet'><div class='wrap'><p>all of the text is here</p></div></form><p>y</p>": "all of the text is here\ny",
        "<div class='widget'><p>most of the text is here</p></div><div class='ad'>Buy</div><p>z</p>": "most of the text is here\nz",
        "<p>g <svg width='1'/> h</p><p>i</p><svg><text>no</text></svg><iframe src=a /><p>j</p>": "g h\ni\nj",
        "<p>k</p><svg><path d='M0'/></svg><p>l</p><div id=comments><article class='comment-body'>nice</article></div><p>and so on</p>": "k\nl\nand so on",
    }
    got = texts(spark, [(i, f"http://h{i}.example/", page) for i, page in enumerate(pages)])
    assert [got[i] for i in range(len(pages))] == list(pages.values())


def test_odd_pages_take_linear_time():
    """Open quotes, open tags, raw elements and deep nesting, and long unlike lists."""
    import json
    import time

    began = time.time()
    for page in ('<a "' * 16_000, "<p x='" * 50_000, "<" * 100_000, "<script>" * 20_000, "<!--" * 50_000, "<div>" * 5_000 + "<p>some text</p>" + "</div>" * 5_000):
        node = html_extract.wrap(html_extract.parse(page))
        assert json.loads(json.dumps(node)) == node and html_extract.shape(node)
    deep = "<div>" * 1_200 + "<p>some text</p><p>more</p>" + "</div>" * 1_200 + "<p>last</p>"
    assert html_extract.Roles(html_extract.wrap(html_extract.parse(deep)), 1).text(html_extract.parse(deep)) == "some text\nmore\nlast"
    a = [[f"p{i % 7}", "1", []] for i in range(3_000)]
    b = [[f"p{i % 5}", "1", []] for i in range(3_000)]
    both = html_extract.align(a, b)
    assert {x[0] for x in both} == {f"p{i}" for i in range(7)}
    shifted = html_extract.align([[f"p{i}", "1", []] for i in range(2_000)], [[f"p{i}", "1", []] for i in range(1_000, 3_000)])
    assert [x[0] for x in shifted] == [f"p{i}" for i in range(3_000)] and [x[1] for x in shifted] == ["?"] * 1_000 + ["1"] * 1_000 + ["?"] * 1_000
    assert time.time() - began < 60

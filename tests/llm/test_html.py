import html
import random
import re
import tracemalloc

import pytest
from pyspark.sql import functions as F

from barlight.llm import html_extract as H
from barlight.llm import queries


def text(page, wrapper=H.Wrapper()):
    return H.main_text(H.parsed(page), wrapper)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>er
 word<br>next<p>Two &#233;&nbsp;&lt;x&gt;<!-- hidden --><ul><li>a<li>b</ul><form><p>Mail <input name=q></p></form><aside>See also</aside>
<div class="advert big"><p>Buy</p></div><table><tr><td>c1<td>c2<tr><td>c3</table><div class="shadow">kept</div></article>
<section id="comments"><p>First!</p></section></main><div class="sidebar"><p>More</p></div><footer>&copy; me</footer></body></html>"""


def test_roles_blocks_and_entities():
    assert text(PAGE) == "Head & line One bolder word next Two é <x> a b c1 c2 c3 kept"


def test_broken_and_empty_pages():
    assert text("") == "" and text("plain <b>text") == "plain text"
    assert text("<article><p>a<p>b</article") == "a b"
    assert text("<p>a &am <p>b &amp") == "a &am b &"
    assert text("<article><p>x</p><script>never closed <p>y") == "x"
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert text("a < b and <3 <p>c") .startswith("a < b")


def test_simple_tree_matching_is_the_largest():
    a, b = (H.parsed(x) for x in ("<div><h1>x</h1><p>1</p><ul><li>a</li></ul><p>2</p></div>", "<div><p>0</p><h1>x</h1><ul><li>b</li><li>c</li></ul><p>2</p><h2>z</h2></div>"))
    # root, div, h1, ul, li, p
    assert H.matching(a, b, {}) == 6


def wrapped(i):
    return f"<html><body><div class='x'><p>Terms of use apply.</p><div><h1>Title {i}</h1><p>{'Body ' * (i + 9)}{i}.</p><p>All rights kept.</p></div></div></body></html>"


def extracted(spark, pages):
    rows = [(i, f"https://host.example/{i}", page) for i, page in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    return [r.text for r in sorted(H.extract(df).collect())]


def brute_size(a, b):
    if a.tag != b.tag:
        return 0
    left, right = H.elements(a), H.elements(b)
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_size(x, y))
    return 1 + best[-1][-1]


@pytest.mark.parametrize("cells", [1_000_000, 3])
def test_matching_of_random_trees(monkeypatch, cells):
    monkeypatch.setattr(H, "MOST_CELLS", cells)
    rng = random.Random(5)

    def tree(depth):
        return H.Node(rng.choice("ab"), "", [tree(depth - 1) for _ in range(rng.randrange(5) if depth else 0)])

    for _ in range(300):
        a, b, pairs = tree(3), tree(3), {}
        size = H.matching(a, b, pairs)
        assert size == brute_size(a, b) == len(pairs) or (a.tag != b.tag and not pairs and size == 0)
        above = {id(c): n for t in (a, b) for _, n in H.in_order(t) for c in H.elements(n)}
        for _, n in H.in_order(a):
            if id(n) in pairs and n is not a:
                assert pairs[id(n)].tag == n.tag and pairs[id(above[id(n)])] is above[id(pairs[id(n)])]
        assert H.skeleton(H.from_skeleton(H.skeleton(a))) == H.skeleton(a)


def test_wide_pages_need_little_memory():
    rng = random.Random(6)
    kinds = ["<p>a</p>", "<div><b>c</b></div>", "<ul><li>x</ul>", "<div><i>x</i><b>y</b></div>"]
    a, b = (H.parsed("<div>" + "".join(rng.choice(kinds) for _ in range(10_000)) + "</div>") for _ in "ab")
    tracemalloc.start()
    pairs = {}
    assert H.matching(a, b, pairs) == len(pairs) > 10_000
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()


def test_constant_blocks_are_the_template(spark):
    assert extracted(spark, [wrapped(i) for i in range(5)])[2] == "Title 2 " + "Body " * 11 + "2."
    # Copies of a page teach nothing.
    assert extracted(spark, [wrapped(0)] * 5)[0].startswith("Terms of use apply. Title 0")


@pytest.mark.parametrize("words", [3, 10, 400])
def test_content_without_telling_names(spark, words):
    """No article, no class: the alignment alone finds the content, however short it is against the template."""
    rules = "<p>" + "Terms of use that everybody has to keep. " * 20 + "</p>"

    def page(i):
        seen = f"<div><p>{i} seen</p></div>" if i % 3 else ""
        return f"<html><body><div>{rules}</div>{seen}<div><h1>Title of page {i}</h1><p>{f'w{i} ' * words}</p><p>End {i}.</p></div><div>All rights kept.</div></body></html>"

    got = extracted(spark, [page(i) for i in range(30)])
    for i, text in enumerate(got):
        article = f"Title of page {i} {f'w{i} ' * words}End {i}."
        assert "Terms" not in text and "rights" not in text and article in text
        assert text == article or words < 10  # three words don't outweigh the counter


def test_article_that_varies_beside_other_text(spark):
    """The name of an element is a vote: half of the varying text is enough. Where it names the wrong one, the alignment decides."""
    rng = random.Random(7)
    some = lambda i, n: " ".join(f"{rng.choice('abcdef')}{i}x{k}" for k in range(n))
    rows = [(some(i, 60), some(i, 40)) for i in range(20)]
    got = extracted(spark, [f"<html><body><div><p>{b}</p></div><article><p>{a}</p></article></body></html>" for a, b in rows])
    assert got == [a for a, _ in rows]
    rows = [(some(i, 300), some(i, 5)) for i in range(20)]
    got = extracted(spark, [f"<html><body><div><p>{a}</p></div><div><article><p>{b}</p></article></div></body></html>" for a, b in rows])
    assert got == [a for a, _ in rows]


def test_extract(spark):
    rows = [(i, f"https://Host.example/{i}", wrapped(i), "x", 1) for i in range(60)] + [(100, None, wrapped(1), "x", 1), (101, "http://one.example/", None, "x", 1), (101, "http://one.example/", None, "x", 1), (None, "no url", PAGE, "x", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, grp int").repartition(4)
    got = {(r.page_id, r.url): r.text for r in H.extract(df).collect()}
    assert H.extract(df).count() == len(rows)
    assert all(got[i, f"https://Host.example/{i}"] == f"Title {i} {'Body ' * (i + 9)}{i}." for i in range(60))
    assert got[100, None].startswith("Terms of use") and got[101, "http://one.example/"] == ""
    assert got[None, "no url"].startswith("Head & line")
    assert H.extract(df.limit(0)).count() == 0


def test_template_is_that_of_the_whole_host(spark):
    def page(i):
        notice = "<p>Our office is closed on Sunday.</p>" if i % 5 else ""
        passage = "<p>A passage that some quote.</p>" if i % 5 < 2 else ""
        return f"<html><body><div><div><h1>Title {i}</h1><p>{'Body ' * (i % 17 + 9)}{i}.</p>{passage}</div><div><p>All rights kept.</p>{notice}</div></div></body></html>"

    rows = [(i, f"https://host.example/{i}", page(i)) for i in range(200)]
    got = {r.page_id: r for r in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)).collect()}
    for i, _, _ in rows:
        passage = " A passage that some quote." if i % 5 < 2 else ""
        assert got[i].text == f"Title {i} {'Body ' * (i % 17 + 9)}{i}.{passage}" and got[i].aligned == 200


def test_query_on_the_table(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op6_wrapper_induction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.DOTALL)
        assert r.text == re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", article[1]))).strip() and r.n_chars == len(r.text)


def test_table_without_article_tags(spark, sf):
    """The same text from pages whose article is a div among others; hosts with three pages at least."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    bare = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "(</?)article>", "$1div>"), ' class="[^"]*"', ""))
    want = {r.page_id: r.text for r in H.extract(pages).collect()}
    got = [r for r in H.extract(bare).collect() if r.aligned >= 3]
    assert len(got) > 5 and all(r.text == want[r.page_id] for r in got)

import html
import re

from seasonlark.llm import wrapper_induction as W

SCHEMA = "page_id bigint, url string, html string, host string, constant int, text string"


def text_of(page):
    return "\n".join(t for part in W._main(W.parse(page)) for _, t in W.blocks(part))


def test_blocks_and_furniture():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li>Home</ul></nav><div class="cookie-notice">We use cookies</div><div id="sideBar">x</div>
    <main><article><header><h1>A &amp; B</h1></header><p><b>First <i>bold</i><br>line<p>Second\n  para&nbsp;x &#233; 3 < 4 <!-- no --> end
    <ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><div>pre<p>mid</p>post</div><form><input>send</form><div class="comments"><p>nice!</p></div>
    <aside>note</aside><p hidden>h</p><textarea>t</textarea></article></main><footer>&copy; me</footer></body></html>"""
    assert text_of(page) == "A & B\nFirst bold line\nSecond para x é 3 < 4 end\none\ntwo\nc1\nc2\npre\nmid\npost"
    assert text_of(None) == text_of("") == text_of("<nav>x</nav>") == ""
    assert text_of("plain <b>text") == "plain text" and text_of("<div>a<div>b") == "a\nb"
    assert text_of("<p class='x>y'>q</p><!-- open") == "q"


def plain_matching(a, b):
    if a.label != b.label:
        return 0
    xs, ys = a.children(), b.children()
    rows = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            rows[i + 1][j + 1] = max(rows[i][j + 1], rows[i + 1][j], rows[i][j] + plain_matching(x, y))
    return rows[-1][-1] + 1


def test_tree_matching_is_maximal():
    import random

    rnd = random.Random(3)

    def tree(depth):
        tag = rnd.choice(["div", "p", "ul"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rnd.randint(0, 3) if depth and tag != "p" else 0)) + f"</{tag}>"

    for _ in range(150):
        a, b = W.parse(tree(4)), W.parse(tree(4))
        m = W.match_trees(a, b)
        assert len(m) == plain_matching(a, b) and len({id(v) for v in m.values()}) == len(m)


def test_constant_slots_are_template(spark):
    page = "<body><div>Welcome to the site</div><div>Updated daily</div><div><p>Story {0} one</p><p>Story {0} two</p></div><div>Imprint {1}</div></body>"
    rows = [(i, "https://a.example/x", page.format(i, "of this site"), "h", 1, "t") for i in range(12)]
    rows += [(100 + i, f"https://b{i}.example/", page.format(i, "x"), "h", 1, "t") for i in range(3)]
    rows += [(None, None, None, None, None, None), (200, "nonsense", "<p>alone", "h", 1, "t"), (200, "nonsense", "<p>alone", "h", 1, "t")]
    out = W.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows)
    assert got[5] == "Story 5 one\nStory 5 two"
    assert got[101].startswith("Welcome to the site\nUpdated daily\nStory 1 one")
    assert got[200] == "alone" and got[None] == "" and all(r.n_chars == len(r.text) for r in out)
    assert W.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_plain_extraction(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = W.op7_wrapper_induction(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(p for p in parts if p) and r.url == pages[r.page_id].url


def test_deep_and_wide_pages_take_linear_time():
    import time

    began = time.perf_counter()
    deep = "<div>" * 5000 + "<p>core</p>" + "</div>" * 5000
    rows = lambda n, k: "<table>" + "".join(f"<tr class='r{i % k}'><td>{i}</td></tr>" for i in range(n)) + "</table>"
    for a, b in ((deep, deep.replace("core", "rind")), (deep, "<div>" * 4000 + "<p>x</p>"), (rows(20000, 1), rows(15000, 1)), (rows(3000, 7), rows(2500, 5))):
        x, y = W.parse(a), W.parse(b)
        match = W.match_trees(x, y)
        assert len(match) > 2000
    quotes = "<p>kept</p>" + "<a title='" * 8001 + "<p>x"
    assert [t for _, t in W.blocks(W.parse(quotes))][0] == "kept"
    assert W.parse("<a b=\"" * 20000) is not None
    assert time.perf_counter() - began < 60


def test_alignment_has_the_greatest_size():
    import numpy as np

    rng = np.random.default_rng(4)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if depth else ''}</{t}>" for t in rng.choice(["div", "section", "ul"], int(rng.integers(0, 4))))

    def best(x, y):
        if x.label != y.label:
            return 0
        xs, ys = x.children(), y.children()
        rows = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, a in enumerate(xs):
            for j, b in enumerate(ys):
                rows[i + 1][j + 1] = max(rows[i][j + 1], rows[i + 1][j], rows[i][j] + best(a, b))
        return 1 + rows[-1][-1]

    for _ in range(150):
        a, b = W.parse(tree(3)), W.parse(tree(3))
        assert len(W.match_trees(a, b)) == best(a, b)


def test_names_cut_furniture_only():
    text = lambda page: [t for part in W._main(W.parse(page)) for _, t in W.blocks(part)]
    assert text("<body class='has-sidebar'><article class='reader-content'><p>a</p><div class='related-work'>b</div><div class='cookie-banner'>c</div></article>") == ["a", "b"]
    assert text("<main class='search-page'><p>a</p></main>") == ["a"]
    assert text("<div id='widget'><h1>t</h1><p>a</p></div><div class='sidebar'>s</div>") == ["t", "a"]
    assert text('<p class="x>hello</p><p>b</p>') == ["hello", "b"]
    assert text("<p title='a > b'>c</p><script>if (a < b) { x = '</p>' }</script><p>d &amp; e</p>") == ["c", "d & e"]


def test_copies_of_one_page_are_no_template(spark):
    """Nine copies of an article under several addresses, an empty page and one other article of the host."""
    page = lambda t: f"<body><div><p>{t}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page("same article")) for i in range(9)] + [(20, "http://h.example/20", None), (21, "http://h.example/21", page("other"))]
    out = {r.page_id: r.text for r in W.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out == {**dict.fromkeys(range(9), "same article"), 20: "", 21: "other"}


def test_pages_of_one_content_are_no_template(spark):
    """Nine pages hold one article and differ in an HTML comment; on another host so do two articles' pages, beside a menu that is template."""
    page = lambda t, n, menu="": f"<body><!-- {n} --><ul>{menu}</ul><div><p>{t}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page("same article", i)) for i in range(9)]
    rows += [(20 + i, f"http://g.example/{i}", page("first" if i < 5 else "second", i, "<li>Start</li>")) for i in range(10)]
    out = {r.page_id: r.text for r in W.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert out == dict.fromkeys(range(9), "same article") | {20 + i: "first" if i < 5 else "second" for i in range(10)}


def test_reader_comments_by_name():
    text = lambda page: [t for part in W._main(W.parse(page)) for _, t in W.blocks(part)]
    assert text("<article><p>a</p><div class='user-comments'><p>b</p></div><div id='disqus_thread'>c</div></article>") == ["a"]

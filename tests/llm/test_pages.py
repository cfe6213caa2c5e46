import html as entities
import re

from meterlake.llm import pages
from meterlake.llm.queries import op7_pages

PAGES = "page_id long, url string, html string"


def text_of(body):
    return pages.main_text(body, set())


def test_blocks_of_an_article():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>x";</script></head><body>
    <header>Site</header><nav><ul><li>a<li>b</ul></nav><!-- note --><div class="cookie-notice">Cookies!</div>
    <article><h1>Head &amp; shoulders</h1><p>One <b>bo</b>ld&nbsp;word<br>next<p>Two  &#233;&eacute;&lt;x&gt;
    <div class="ad">Buy</div>loose text<ul><li>first<li>second</ul><aside>side</aside>
    <section id="comments"><p>first!</p></section><form><p>Name</p><input></form></article>
    <div class="related">More</div><footer>&copy; x</footer></body></html>"""
    assert text_of(page) == "Head & shoulders One bold word next Two éé<x> loose text first second"


def test_broken_markup():
    assert text_of("<article><p>a<b>b<p>c</i></article></div>") == "ab c"
    assert text_of("<article><p>cut off here &am") == "cut off here &am"
    assert text_of("<article><p>cut off here</p><p class=") == "cut off here"
    assert text_of("<article><p>a &amp b</p></arti") == "a & b"
    assert text_of("<article><p>1 < 2 and 3 > 2</p></article>") == "1 < 2 and 3 > 2"
    assert text_of("<p>no article</p><nav>menu</nav>") == "no article"
    assert text_of("") == text_of(None) == text_of("<html><body></body></html>") == ""
    deep = "<div>" * 3000 + "<article><p>deep</p></article>"
    assert text_of(deep) == "deep"


def test_reader_comments_are_no_article():
    page = "<article><p>main</p><article><p>reply</p></article><div class='comment-list'><p>other</p></div></article>"
    assert text_of(page) == "main"


def test_site_style_tree_drops_what_recurs(spark):
    """The pages mark nothing: a box that recurs on the pages of one host goes there and stays elsewhere."""
    page = lambda k, box: f"<body><div class=x1><p>{box}</p></div><div class=x2><p>Unique text {k} {k * k}</p></div></body>"
    rows = [(k, f"http://a.com/{k}", page(k, "Same on all pages")) for k in range(12)]
    rows += [(100 + k, f"http://b.com/{k}", page(k, f"Box {k}")) for k in range(12)]
    rows += [(200, "http://c.com/", page(0, "Same on all pages")), (201, None, page(1, "Same on all pages")), (202, "http://a.com/n", None)]
    frame = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as low", "'x' as path")
    got = {r.page_id: r.text for r in pages.extract(frame).collect()}
    assert got[3] == "Unique text 3 9" and got[103] == "Box 3 Unique text 3 9"
    assert got[200] == "Same on all pages Unique text 0 0" and got[201] == "Same on all pages Unique text 1 1" and got[202] == ""
    tree = {(r.host, r.path): r for r in pages.style_tree(spark.createDataFrame([(r[1][7:12], r[2]) for r in rows[:24]], "host string, html string")).collect()}
    assert abs(tree["a.com", ">body>div.x1>p"].importance) < 1e-9 and tree["a.com", ">body>div.x2>p"].importance == 1


def test_copies_of_an_article_stay(spark):
    body = "<body><nav>menu</nav><article><h1>Title</h1><p>Copied paragraph.</p></article></body>"
    rows = [(k, f"http://a.com/{k}", body) for k in range(20)] + [(3, "http://a.com/3", body)]
    assert {r.text for r in pages.extract(spark.createDataFrame(rows, PAGES)).collect()} == {"Title Copied paragraph."}
    assert pages.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_query_against_the_generated_markup(spark, folder):
    """In the test pages the article is one element of headings and paragraphs."""
    source = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = op7_pages(spark, folder).collect()
    assert len(rows) == len(source)
    for r in rows:
        raw = re.sub(r"<[A-Za-z/!][^<>]*\Z", "", source[r.page_id].html or "")
        article = re.search(r"<article>(.*?)(</article>|\Z)", raw, re.S)
        inner = re.sub(r"</?(?:p|h1|br)>", " ", article[1]) if article else ""
        plain = entities.unescape(re.sub(r"</?b>", "", inner))
        assert r.text == " ".join(plain.split()) and r.n_chars == len(r.text) and r.url == source[r.page_id].url


def extracted(spark, rows):
    return {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_importance_decides_inside_articles(spark):
    """A notice in a plain paragraph goes, and so does a box of a few takes turns; near copies of an article stay."""
    offers = ["Buy one of these.", "Get two of those.", "Take all three."]
    page = lambda k: f"<article><h1>Title {k}</h1><p>Text {k} is longer than a notice is.</p><p>Sign up here</p><div class=q9><p>{offers[k % 3]}</p></div></article>"
    near = lambda k: f"<article><h1>Day {k}</h1><p>The same long paragraph on each of these pages of the host.</p></article>"
    rows = [(k, f"http://a.com/{k}", page(k)) for k in range(12)] + [(100 + k, f"http://b.com/{k}", near(k)) for k in range(12)]
    got = extracted(spark, rows)
    assert got[4] == "Title 4 Text 4 is longer than a notice is."
    assert got[104] == "Day 4 The same long paragraph on each of these pages of the host."


def test_whole_branches_go(spark):
    """What two pages alone have in a branch of low importance goes with it; elsewhere it is too rare to be judged."""
    rare = "<div class=r2><p>Now on sale</p></div>"
    page = lambda k: f"<body><div class=x1><p>Same</p>{rare if k < 2 else ''}</div><div class=x2><p>Text {k}</p>{rare if k in (2, 3) else ''}</div></body>"
    got = extracted(spark, [(k, f"http://a.com/{k}", page(k)) for k in range(12)])
    assert got[0] == "Text 0" and got[2] == "Text 2 Now on sale" and got[5] == "Text 5"
    assert pages.judged([], 0.7, 4) == []


def test_presentations_have_an_importance():
    node = lambda path, parent, styles, shape, own=None: {"path": path, "parent": parent, "pages": 10, "styles": styles, "own": own, "shape": shape}
    tree = [node("", None, 1, 0.0), node(">div", "", 10, 1.0), node(">div>p", ">div", 1, 0.0, 0.2)]
    got = {p: i for p, _, i, _ in pages.judged(tree, 0.7, 4)}
    many = (1 - 0.9**10) * 0.2 + 0.9**10
    assert got[">div>p"] == 0.2 and abs(got[">div"] - many) < 1e-12 and abs(got[""] - 0.1 * many) < 1e-12


def test_unmarked_copies_count_once(spark):
    """Copies of a page without an article keep their text, also if they differ in what the tags rule out."""
    page = lambda k, nav="": f"<body><nav>{nav}</nav><div><p>Text {k}</p><p>More of {k}</p></div></body>"
    rows = [(k, "http://a.com/", page(0)) for k in range(4)] + [(10 + k, f"http://b.com/{k}", page(k // 2, k)) for k in range(4)]
    got = extracted(spark, rows)
    assert {got[k] for k in range(4)} == {"Text 0 More of 0"}
    assert [got[10 + k] for k in range(4)] == ["Text 0 More of 0"] * 2 + ["Text 1 More of 1"] * 2


def test_the_pages_of_a_node_count_and_not_those_of_its_host(spark):
    side = lambda k: "<div class=s1><p>Same</p></div>" if k < 4 else ""
    rare = lambda k: "<div class=s2><p>Rare</p></div>" if k < 3 else ""
    rows = [(k, f"http://a.com/{k}", f"<body>{side(k)}{rare(k)}<div class=t><p>Text {k}</p></div></body>") for k in range(5000)]
    got = extracted(spark, rows)
    assert got[0] == "Rare Text 0" and got[3] == "Text 3" and got[4] == "Text 4"
    assert len(got) == 5000 and all(got[k] == f"Text {k}" for k in range(3, 5000))


def test_names_that_hold_a_noise_word_are_no_noise():
    body = "<article><h1>T</h1>{}</article>"
    for kept in ('<div class="share-price">5</div>', '<section class="copyright-law"><p>5</p></section>', '<p id="search-results">5</p>', '<p class="form">5</p>'):
        assert text_of(body.format(kept)) == "T 5"
    for gone in ('<div class="share-buttons">5</div>', '<section id="comments"><p>5</p></section>', '<p class="ad">5</p>', '<div class="x newsletter-signup">5</div>'):
        assert text_of(body.format(gone)) == "T"


def test_a_line_on_all_pages_goes_from_short_articles_too(spark):
    line = "<p>Subscribe to our weekly letter for more of this.</p>"
    page = lambda k: f"<article><p>{f'Long text of page {k}, ' * 30 if k else 'Short.'}</p>{line}</article>"
    got = extracted(spark, [(k, f"http://a.com/{k}", page(k)) for k in range(12)])
    assert got[0] == "Short." and "Subscribe" not in got[5] and got[5].startswith("Long text of page 5")


def test_long_and_malformed_pages_take_one_scan():
    assert text_of("<article><p>kept</p>" + "a <a <a <" * 120_000) == "kept a"
    assert text_of("<article>" + "<div>" * 20_000 + "</p>" * 20_000 + "<p>deep</p>") == "deep"
    assert text_of("<article><p>x</p>" + "<li></li><ul>" * 20_000) == "x"
    assert text_of("<article><p>" + "word " * 300_000) == " ".join(["word"] * 300_000)
    assert text_of("<article><p>a<!-- cut off <p>b") == "a"
    assert text_of("<article><p>a<!-->b<!-- x --!>c</ d>e<?php f ?>g") == "abceg"
    assert text_of("<article><script>if (a </scripty) '</article>'</SCRIPT ><p title='>'>t</p>") == "t"


def test_attributes():
    assert pages.attributes(""" CLASS=a id = 'b c' class="z" hidden data-x="&lt;" /""") == {"class": "a", "id": "b c", "hidden": "", "data-x": "<"}

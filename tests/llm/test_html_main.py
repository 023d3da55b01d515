import html
import math
import random
import re

from larkspur.llm import html_main
from larkspur.llm.queries import op8_html

rng = random.Random(6)

PARAGRAPH = "The river turns north here, and the old mill stands beside it, half hidden by the trees. " * 3
PAGE = f"""<!doctype html><html><head><title>T</title><style>p {{}}</style><script>var a = "<p>no</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul></nav>
<div class="cookie-banner"><p>We use cookies on this page, and we would like you to accept them all.</p></div>
<header><h1>Site name</h1></header>
<div id=content><h1>A &amp; B&nbsp;C</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH} <b>bold</b>
 text<p>Short.</p><ul><li>one</li><li>two</li></ul>
<div class="ad"><p>Buy now and save a lot of money with this wonderful offer today.</p></div></div>
<div class="comments"><p>{PARAGRAPH} says a reader</p></div><aside>More</aside><footer><p>Imprint, contact, and all rights reserved</p></footer></body></html>"""


def test_article_without_the_rest():
    p = " ".join(PARAGRAPH.split())
    assert html_main.main_text(PAGE) == "\n".join(["A & B C", p, p + " bold text", "Short.", "one", "two"])


def test_odd_pages():
    assert [html_main.main_text(x) for x in (None, "", "<html></html>", "<p>", "<script>x")] == [""] * 5
    assert html_main.main_text("plain  text &lt;3") == "plain text <3"
    assert html_main.main_text("<p>a<p>b</div></p>c") == "a\nb\nc"


def test_deep_and_long_pages_are_whole():
    assert html_main.main_text("<div>" * 20_000 + "deep") == "deep"
    body = [f"Sentence number {i} of a very long page, with some words." for i in range(20_000)]
    assert html_main.main_text("<article>" + "".join(f"<p>{x}</p>" for x in body) + "</article>") == "\n".join(body)


def test_no_part_of_an_article_is_left_behind():
    p = " ".join(PARAGRAPH.split())
    lead = "A lead of one sentence, which says what follows in a few words more."
    body = "".join(f"<p>{PARAGRAPH}</p>" for _ in range(5))
    page = f"<body><div id=post><div class=post-title><h1>Title</h1></div><div class=lead><p>{lead}</p></div><div class=body>{body}</div></div></body>"
    assert html_main.main_text(page) == "\n".join(["Title", lead] + [p] * 5)
    page = f"<body><article><h2>A</h2>{body}</article><p>between</p><article><h2>B</h2><p>{PARAGRAPH}</p></article><main><p>{PARAGRAPH}</p></main></body>"
    assert html_main.main_text(page) == "\n".join(["A"] + [p] * 5 + ["B", p, p])


def test_missing_end_tags_close_nothing_late():
    s = "The old mill stands beside the river, half hidden by the trees."
    after = "<div><p>Outside of the article, a teaser that is long enough to count</p></div>"
    for n in (1, 198, 199, 5000):
        assert html_main.main_text("<article>" + f"<p>{s}" * n + "</article>" + after) == "\n".join([s] * n)
        assert html_main.main_text("<article><ul>" + f"<li>{s}" * n + "</ul></article>" + after) == "\n".join([s] * n)
        assert html_main.main_text("<article><dl>" + f"<dt>{s}<dd>{s}" * n + "</dl></article>" + after) == "\n".join([s] * 2 * n)
        assert html_main.main_text("<article><table>" + f"<tr><td>{s}<td>{s}" * n + "</table></article>" + after) == "\n".join([s] * 2 * n)
        assert html_main.main_text("<article>" + f"<div>{s}" * n + "</article>" + after) == "\n".join([s] * n)
    nested = html_main.BlockReader()
    nested.feed("<ul><li>a<ul><li>b<li>c</ul><li>d<table><tr><td>e<table><tr><td>f</table><td>g")
    assert [t for t, _ in nested.open] == ["ul", "li", "table", "tr", "td"]


#: No telling names: boilerplate above and below, and an article of long and short lines in one of several equal boxes.
BARE = f"""<body><div class=x1><ul><li><a href=/>Home page of ours</a></li><li><a href=/b>All other pages</a></li></ul></div>
<div class=x2><p><a href=/c>Weather</a> <a href=/d>Sports</a> and <b>more</b></p></div>
<div class=x3><p>{PARAGRAPH}</p><p>Short.</p><p>{PARAGRAPH}</p></div><div class=x4><p><i>Seen</i> <b>by</b> <i>many</i></p></div></body>"""


def test_the_ratio_decides(monkeypatch):
    """With equal ratios everything counts as content; with the real ones, the article alone."""
    p = " ".join(PARAGRAPH.split())
    assert html_main.main_text(BARE) == "\n".join([p, "Short.", p])
    monkeypatch.setattr(html_main, "smoothed", lambda ratios, sigma=1.0: ratios * 0)
    assert "Weather" in html_main.main_text(BARE) and "Seen by many" in html_main.main_text(BARE)


def test_links_alone_are_left_out_where_a_heading_is_outside():
    p = " ".join(PARAGRAPH.split())
    page = f"<body><h1>Title</h1><div><a href=/>Home</a> <a href=/b>Pages</a></div><div><p>{PARAGRAPH}</p><p><a href=/c>One link</a> in a line</p></div><div>Told by A.</div></body>"
    assert html_main.main_text(page) == "\n".join(["Title", p, "One link in a line", "Told by A."])


def test_the_clusters_decide_on_the_tables_pages(spark, monkeypatch):
    """The real clusters confirm every article; random ones refuse many, and results change."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    real = [html_main.main_text(p) for p in pages]
    monkeypatch.setattr(html_main, "clustered", lambda lengths, tags: [rng.random() < 0.5 for _ in lengths])
    assert sum(html_main.main_text(p) != t for p, t in zip(pages, real, strict=True)) > len(pages) / 4


def test_a_marked_part_that_the_clusters_refuse():
    """An article of many short linked lines, and the story in a box that isn't marked."""
    p = " ".join(PARAGRAPH.split())
    list_of_links = "".join(f"<p><a href=/{i}>Story <b>{i}</b></a></p>" for i in range(40))
    page = f"<body><article><p>{'Words ' * 20}</p>{list_of_links}</article><div><p>{PARAGRAPH}</p><p>Short.</p><p>{PARAGRAPH}</p></div></body>"
    assert html_main.main_text(page).endswith("\n".join([p, "Short.", p])) and "Story 7" not in html_main.main_text(page)


def test_named_parts_count_as_lines_but_are_not_returned():
    reader = html_main.BlockReader()
    reader.feed("<p>a</p><nav><script>x</script><ul><li><a href=/>b</a> c</li></ul><nav>d</nav>e</nav><div class=ad>f<style>g</style></div><p>h<svg><text>i</text></svg>j</p><footer>k")
    reader.close()
    assert [("".join(x.parts), x.noise) for x in reader.lines] == [("a", False), ("b c", True), ("d", True), ("e", True), ("f", True), ("hj", False), ("k", True)]


def test_clusters_against_plain_sums():
    for n in (1, 2, 3, 40):
        lengths, tags = [rng.randint(1, 400) for _ in range(n)], [rng.randint(1, 5) for _ in range(n)]
        ratio = [a / b for a, b in zip(lengths, tags, strict=True)]
        level = []
        for i in range(n):
            weights = {j: math.exp(-0.5 * (i - j) ** 2) for j in range(n) if abs(i - j) <= 3}
            level.append(sum(w * ratio[j] for j, w in weights.items()) / sum(weights.values()))
        mean = sum(level) / n
        least = min(mean, math.sqrt(sum((x - mean) ** 2 for x in level) / n))
        high = [x >= least for x in level]
        want = []
        for i in range(n):
            ends = []
            for step in (-1, 1):
                j = i
                while 0 <= j < n and high[j] and ratio[j] < least:
                    j += step
                ends.append(0 <= j < n and high[j])
            want.append(high[i] and all(ends))
        assert html_main.clustered(lengths, tags) == (want if any(want) else high)


def test_query_against_plain_cuts(spark, sf_dir):
    """The tables' pages are plain: what stands between the article's tags, cut at its blocks."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()
    want = {}
    for r in rows:
        inner = re.search(r"<article[^>]*>(.*)</article>", r["html"] or "", re.S)
        blocks = re.split(r"</?(?:h1|h2|h3|p|ul|li|div)[^>]*>", re.sub(r"<br>", " ", re.sub(r"<!--.*?-->|<div class=.?ad.*?</div>", "", inner[1], flags=re.S))) if inner else []
        texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        want[r["page_id"]] = "\n".join(t for t in texts if t)
    assert {r["page_id"]: r["text"] for r in op8_html(spark, sf_dir).collect()} == want


def test_smoothing_keeps_level_lines():
    import numpy as np

    assert np.allclose(html_main.smoothed(np.full(7, 3.0)), 3.0)


def test_operator_on_odd_tables(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "x")]
    out = html_main.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    got = sorted(((r["page_id"] or 0, r["text"]) for r in out.collect()))
    assert out.columns == ["page_id", "url", "text"]
    assert got == sorted([(0, ""), (1, html_main.main_text(PAGE)), (1, html_main.main_text(PAGE)), (2, "")])
    assert html_main.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query(spark, sf_dir):
    rows = op8_html(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) and "<script" not in r["text"] for r in rows)

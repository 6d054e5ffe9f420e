import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from panelwright.llm import html_text

LONG = "This is a text that has many of the words that all texts have, and it is long enough to be taken for what it is: the main part of the page that was asked for by the reader, with one thing after another."
CASES = [
    ("", ""),
    ("plain", ""),
    (f"<p>{LONG}", LONG),
    (f"<nav><a href=x>Home</a></nav><article><h1>T&eacute;</h1><p>One\n  two &amp; three<br>four</p><p><b>x</p></article><footer>f</footer>", "Té\nOne two & three four\nx"),
    ("<article><p>a</p><aside>no</aside><form>no<input></form><div class='reader-comments'>no</div><script>'</p>'</script><style>p{}</style><p>b <!-- no --> c</article>", "a\nb c"),
    ("<main><p>5 < 6 & 7 &gt; 3</p><p title='a>b'>z</p></main>", "5 < 6 & 7 > 3\nz"),
    ("<article><p>cut off &am", "cut off &am"),
    ("<article><p>cut off</artic", "cut off"),
    ("<article><p>one<p>two<div>three<div>four</div></div>five</article><div class=ad>six</div>", "one\ntwo\nthree\nfour\nfive"),
    ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
    ("<article><script>never closed <p>x", ""),
    (f"<h2>Short heading</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p><ul><li><a href=a>link one</a><li><a href=b>link two</a></ul><p>© 2020</p>", f"Short heading\n{LONG}\nShort.\n{LONG}"),
    (f"<div class='cookie-notice'><p>{LONG}</p></div><div id=content><p>{LONG}</p></div>", LONG),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert "\n".join(html_text.main_blocks(page)) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><p class=ad>buy<p>Real text</p></article>", "Real text"),
        ("<article><p class=ad>buy <span class=share>now<div>Real text</div><p>More</article>", "Real text\nMore"),
        ("<article><ul><li class=ad>buy<li>Real text</ul></article>", "Real text"),
        ("<article><ul><li class=ad>buy<ul><li>inner</ul>buy<li>Real text</ul></article>", "Real text"),
        ("<article><dl><dt class=ad>buy<dd>Real text</dl><h2 class=ad>buy<h3>Title</h3><p>More</article>", "Real text\nTitle\nMore"),
        ("<article><div class=ad><p>buy<p>this</div><p>Real text</article>", "Real text"),
    ],
)
def test_dropped_elements_without_an_end_tag_end_where_html_ends_them(page, text):
    assert "\n".join(html_text.main_blocks(page)) == text


def test_rows(spark):
    rows = [(i, "u", page) for i, (page, _) in enumerate(CASES)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as row")
    got = {r.row.page_id: r.text for r in html_text.main_text(df).collect()}
    assert got == {**{i: t for i, (_, t) in enumerate(CASES)}, None: ""}
    assert html_text.main_text(df.limit(0)).count() == 0


def test_a_long_page_takes_linear_time():
    page = "<article>" + "<p>word &lt; word " * 50_000 + "<" * 1000
    assert len(html_text.main_blocks(page)) >= 50_000


def test_unmatched_end_tags_take_linear_time():
    page = "<article>" + "<div>" * 100_000 + "</section>" * 100_000 + "<p>text"
    start = time.perf_counter()
    assert html_text.main_blocks(page) == ["text"]
    assert time.perf_counter() - start < 5


@pytest.mark.parametrize("edge", ["good", "bad"])
def test_second_pass_equals_a_search_from_each_block(edge):
    rng = np.random.default_rng(0)
    for _ in range(300):
        made = [html_text.Block("t", 0, bool(rng.integers(0, 2)), str(rng.choice(["good", "bad", "near", "short"]))) for _ in range(int(rng.integers(1, 12)))]
        for b, kept in zip(made, html_text._second_pass(made, edge), strict=True):
            at = next(i for i, x in enumerate(made) if x is b)
            decided = [(abs(i - at), i < at, x.label) for i, x in enumerate(made) if i != at and x.label in ("good", "bad")]
            before = min((d for d in decided if d[1]), default=(len(made), True, edge))
            after = min((d for d in decided if not d[1]), default=(len(made), False, edge))
            if b.label == "near":
                want = "good" in (before[2], after[2])
            elif b.label == "short":
                want = (after if b.heading or before[0] > after[0] else before)[2] == "good"
            else:
                want = b.label == "good"
            assert kept == want


def without_names(page):
    """The page with every element a plain one that says nothing of its purpose."""
    page = re.sub(r"<(/?)(article|main|nav|header|footer|aside|form|section|button)\b", r"<\1div", page, flags=re.I)
    return re.sub(r"\s(class|id|role|hidden|aria-hidden|style)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page, flags=re.I)


def test_densities_and_neighbours_find_most_blocks_of_pages_without_purpose_names():
    """Of the given pages, short paragraphs of few stop words at an article's edges are what densities alone miss."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    full = hit = extra = 0
    for page in pages:
        named, bare = set(html_text.main_blocks(page)), set(html_text.main_blocks(without_names(page)))
        full, hit, extra = full + len(named), hit + len(named & bare), extra + len(bare - named)
    assert hit > 0.85 * full and extra < 0.05 * full


def test_an_article_without_a_decided_block_is_kept_and_one_with_such_is_judged_inside():
    junk = "Zxq vrt plm " * 12
    assert html_text.main_blocks(f"<div><a href=x>Menu entry</a></div><article><p>{junk}</p><p>x</p></article><p>© 2020</p>") == [junk.strip(), "x"]
    assert html_text.main_blocks(f"<article><p>{LONG}</p><p>{junk}</p><div class=ad>{LONG}</div><p>x</p></article>") == [LONG, junk.strip(), "x"]

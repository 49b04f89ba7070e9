"""Templates of web pages whose names or number of names are unusual."""

import json
import random
from html import escape

import pytest
from conftest import prose

from scribelake.llm import html_wrappers

TEXT = "The main text of this page"


@pytest.mark.parametrize(
    "html",
    [
        f'<body class="no-sidebar"><div><p>{TEXT}</p></div></body>',
        f'<body class="sidebar"><p>{TEXT}</p></body>',
        f'<html class="menu"><main class="content has-sidebar"><p>{TEXT}</p></main></html>',
        f'<article class="post search-result"><p>{TEXT}</p></article>',
        f'<article class="related"><p>{TEXT}</p></article>',
        f'<div id="post-widget-area"><p>{TEXT}</p></div>',
        # All is outside by name: the widest of them.
        f'<body><div class="menu">Home</div><div class="modal"><p>{TEXT}</p></div><nav>All of the many links of this site</nav></body>',
    ],
)
def test_names_of_a_page_do_not_hide_it(html):
    assert html_wrappers.extract(html, html_wrappers.main_path(html_wrappers.page_wrapper(html))) == TEXT


@pytest.mark.parametrize("name", ["ad", "ads ad-2", "cookie-notice", "x sidebar", "ad-slot", "share_buttons", "comments-area", "related-links"])
def test_parts_outside_the_article_stay_out(name):
    html = f'<body><div><p>{TEXT}</p><div class="{name}">not this</div></div></body>'
    assert html_wrappers.extract(html, html_wrappers.main_path(html_wrappers.page_wrapper(html))) == TEXT


def test_a_wrapper_does_not_grow_with_the_pages_of_a_host(spark):
    def page(i):
        # Names of letters only: folding digits does not join them.
        own = "post-" + "".join(chr(97 + int(c)) for c in f"{i:04d}")
        return (
            f'<body><div class="top"><a>Home</a></div><div class="wrap"><div id="{own}"><p>Text of {own}</p></div><p id="x{own}">More {i}</p></div>'
            f'<div class="ad">Buy {i}</div></body>'
        )

    size = {}
    for n in (60, 600):
        pages = spark.createDataFrame([(i, "http://h/", page(i)) for i in range(n)], "page_id int, url string, html string").repartition(4)
        (row,) = html_wrappers.wrappers(pages).collect()
        size[n] = len(json.loads(row["wrapper"]))
        assert "div.wrap" in row["wrapper"] and "post-" not in row["wrapper"]
    assert size[600] == size[60] < 30
    for r in html_wrappers.extracted(pages).collect():
        assert r["text"].split("\n\n")[-1] == f"More {r['id']}" and "Home" not in r["text"] and "Buy" not in r["text"]


@pytest.mark.parametrize(
    "inner",
    [
        '<span class="ad">Buy now</span>', "<a class=share href='/s'>Share</a>", '<span class="ad"><span>Buy</span> now</span>', '<em hidden>secret</em>',
        '<span style="color:red; display : none">secret</span>', '<i aria-hidden="true">icon</i>', '<b class="ad">Buy <b>now</b></b>',
    ],
)
def test_hidden_and_named_inline_parts_stay_out_without_cutting_the_block(inner):
    html = f"<body><article><p>Before {inner} after <b>this</b></p><p>Next</p></article></body>"
    assert html_wrappers.extract(html, []) == "Before after this\n\nNext"
    # Never closed: it ends with its block.
    cut = inner.rsplit("</", 1)[0]
    assert html_wrappers.extract(f"<article><p>Before {cut}</p><p>Next</p></article>", []) == "Before\n\nNext"


@pytest.mark.parametrize("attributes", ["hidden", 'hidden=""', 'aria-hidden="true"', 'style="display:none"', "style='visibility: hidden'", 'HIDDEN class="x"'])
def test_hidden_blocks_stay_out(attributes):
    html = f"<body><article><p {attributes}>not this</p><p>{TEXT}</p></article></body>"
    assert html_wrappers.extract(html, []) == TEXT


@pytest.mark.parametrize("attributes", ['title="a hidden door"', 'data-class="ad"', 'aria-hidden="false"', 'alt="class=ad"', 'style="display:block"'])
def test_other_attributes_hide_nothing(attributes):
    assert html_wrappers.extract(f"<article><p {attributes}>{TEXT}</p></article>", []) == TEXT
    assert html_wrappers.extract(f'<html style="visibility:hidden"><body style="display:none"><p>{TEXT}</p></body></html>', []) == TEXT


def test_depth_does_not_matter(spark):
    deep = [(1, "http://d/", "<div>" * 100_000 + TEXT), (2, "http://d/", "<div>" * 100_000 + "Other" + "</div>" * 100_000), (3, "http://d/", "<section><p>" * 30_000)]
    deep.append((4, "http://d/", "".join(f"<div><ul><li>{i}" for i in range(20_000))))
    deep.append((5, "http://w/", "<p><i>x</i>" * 100_000))
    pages = spark.createDataFrame(deep, "page_id int, url string, html string").coalesce(1)
    got = {r["id"]: r["text"] for r in html_wrappers.extracted(pages).collect()}
    assert got[1] == TEXT and got[2] == "Other" and got[3] == "" and got[4].split("\n\n") == [str(i) for i in range(20_000)]
    assert len(got[5].split("\n\n")) == 100_000
    for _, _, html in deep[:4]:
        one = html_wrappers.page_wrapper(html)
        assert html_wrappers.to_json(html_wrappers.from_json(html_wrappers.to_json(one))) == html_wrappers.to_json(one)


def test_alignment_looks_ahead_in_long_sequences(monkeypatch):
    r = random.Random(2)
    a, b = ([r.choice("pqh") for _ in range(60)] for _ in range(2))
    longest = html_wrappers._common(a, b)
    monkeypatch.setattr(html_wrappers, "CELLS", 10)
    ahead = html_wrappers._common(a, b)
    for found in (longest, ahead):
        assert all(a[i] == b[j] for i, j in found) and found == sorted(found) and len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
    assert len(longest) >= len(ahead) > 20


def test_texts_of_the_template_go(spark):
    """A line on all pages of a host is no article text, also inside the article; on hosts with few pages nothing is known of that."""

    def page(i, extra):
        return f"<body><article><h1>Title {i}</h1><p>{prose(i, 30)}</p><p>Follow us <b>everywhere</b></p>{extra}</article></body>"

    rows = [(i, "http://big/", page(i, "<p>Only here</p>" if i == 3 else "")) for i in range(40)]
    rows += [(100 + i, "http://few/", page(i, "")) for i in range(5)]
    # All pages are copies of one page: that is no template.
    rows += [(200 + i, "http://same/", page(0, "")) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(4)
    got = {r["id"]: r["text"] for r in html_wrappers.extracted(pages).collect()}
    for i in range(40):
        assert got[i] == f"Title {i}\n\n{prose(i, 30)}" + ("\n\nOnly here" if i == 3 else "")
    assert all(got[100 + i].endswith("Follow us everywhere") for i in range(5))
    assert {got[200 + i] for i in range(30)} == {f"Title 0\n\n{prose(0, 30)}\n\nFollow us everywhere"}


def test_an_article_element_without_the_text_does_not_win(spark):
    def page(i):
        teasers = "".join(f"<article><p>Teaser {k}</p></article>" for k in range(3))
        return f'<body><div class="story"><h2>Story {i}</h2><p>{prose(i, 80)}</p></div><div class="more">{teasers}</div></body>'

    pages = spark.createDataFrame([(i, "http://t/", page(i)) for i in range(6)], "page_id int, url string, html string")
    for r in html_wrappers.extracted(pages).collect():
        assert r["text"] == f"Story {r['id']}\n\n{prose(r['id'], 80)}"


# --- a truth set: templates of many kinds around known articles ----------------------------------------------------------------------


def _site(r, site):
    """A template: a function from a number and blocks to a page."""
    outer = r.choice(["article", "main", "div.story", "div.post-body", "section#content"])
    tag, _, name = outer.replace("#", ".").partition(".")
    box = f'<{tag}{f" class={chr(34)}{name}{chr(34)}" if name else ""}>'
    menu = "<nav><ul>" + "".join(f"<li><a href=/{k}>{prose(site * 10 + k, 1)}</a></li>" for k in range(5)) + "</ul></nav>"
    side = r.choice(["<aside><p>{x}</p></aside>", '<div class="sidebar"><h3>More</h3><p>{x}</p></div>', '<div id="related-links"><p>{x}</p></div>'])
    ad = r.choice(['<div class="ad">{x}</div>', '<p class="ad-slot">{x}</p>', '<div hidden><p>{x}</p></div>', ""])
    inline = r.choice(['<span class="ad">Buy</span>', "", "<a class=share>Share</a>"])
    notice = r.choice(['<div class="cookie-notice"><p>We use cookies</p></div>', '<div role="alert">{x}</div>', ""])
    comments = r.choice(['<section id="comments"><h3>Comments</h3><article class="comment"><p>{x}</p></article></section>', '<ol class="comment-list"><li>{x}</li></ol>', ""])
    fixed = r.choice(["<p>Follow us on social media</p>", ""])
    form = r.choice(["<form><label>Mail</label><input></form>", ""])
    wraps = r.randrange(4)

    def page(i, blocks):
        x = prose(90_000 + i, 12)
        body = "".join(f"<h1>{escape(b)}</h1>" if k == 0 else f"<p>{escape(b)}{inline if k == 1 else ''}" + r.choice(["</p>", ""]) for k, b in enumerate(blocks))
        inner = "<div>" * wraps + box + body + fixed + form + f"</{tag}>" + "</div>" * wraps
        parts = [f"<!DOCTYPE html><html><head><title>t{i}</title><script>if(a<b){{}}</script></head><body>", notice, f"<header>Site {site}</header>", menu, ad, inner, side]
        return "".join(parts + [comments, f"<footer>&copy; {site}</footer></body></html>"]).replace("{x}", x)

    return page


def test_precision_and_recall_of_planted_articles(spark):
    r = random.Random(17)
    rows, truth = [], {}
    for site in range(40):
        page = _site(r, site)
        for i in range(30):
            at = site * 100 + i
            blocks = [f"Head {at} & co"] + [prose(at * 31 + k, r.randrange(5, 40)) + r.choice(["", " <x>", " é"]) for k in range(r.randrange(1, 9))]
            rows.append((at, f"https://site{site}.example/{i}", page(at, blocks)))
            truth[at] = blocks
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(4)
    kept = wrong = lost = 0
    for row in html_wrappers.extracted(pages).collect():
        got = row["text"].split("\n\n")
        kept += len(set(got) & set(truth[row["id"]]))
        wrong += len(set(got) - set(truth[row["id"]]))
        lost += len(set(truth[row["id"]]) - set(got))
    print("precision", kept / (kept + wrong), "recall", kept / (kept + lost))
    assert kept / (kept + wrong) > 0.99 and kept / (kept + lost) > 0.99

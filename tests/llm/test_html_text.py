import random
import re
import time

import pytest

from pickwell.llm import html_text as H
from pickwell.llm.queries import QUERIES

LONG = "This is the long text of an article that has more than enough words for the rules to be sure of it."
OTHER = "And another one, of which it is said that it was written by the same author for all of you, too."


@pytest.mark.parametrize("html,text", [
    ("", ""),
    ("no markup", ""),
    (f"<p>{LONG}", LONG),
    (f"<p>{LONG}<p>Short.<p>{OTHER}", f"{LONG}\nShort.\n{OTHER}"),
    (f"<article><h1>Title</h1><p>{LONG}</p><p>End.</article><footer>&copy; Us</footer>", f"Title\n{LONG}\nEnd."),
    (f"<nav><ul><li><a href=/>Home</a></ul></nav><main><p>{LONG}</main><aside>{OTHER}</aside>", LONG),
    (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{LONG}</article>", f"Title\n{LONG}"),
    (f"<div class='ad box'>{OTHER}</div><p>{LONG}</p><div id=comments><p>{OTHER}</div>", LONG),
    (f"<article><p>{LONG}<div class=sidebar><div>{OTHER}</div>{OTHER}</div><p>{OTHER}</article>", f"{LONG}\n{OTHER}"),
    (f"<p>{LONG}</p><form><p>{OTHER}</p><input name=a></form><script>var p = '<p>{OTHER}</p>';</script>", LONG),
    (f"<p>{LONG}<style>p > a {{}}</style><!-- <p>{OTHER}</p> --> <textarea>{OTHER}</textarea>", LONG),
    (f"<article><p>a &amp; b&nbsp;&lt;i&gt; &#233;\n\t&#x1F600; c<br>d <b>e</b>f</p><p>{LONG}</article>", f"a & b <i> é 😀 c d ef\n{LONG}"),
    (f"<article><p>{LONG}</p><ul><li><a href=x>One link</a><li><a href=y>{OTHER}</a></ul></article>", LONG),
    (f"<p><a href=x>{LONG}</a></p><p>{OTHER}", OTHER),
    (f"<article><p title='a > b' data-x=\"</p>\">{LONG}</p></article>", LONG),
    (f"<article><p>1 < 2 and {LONG}</article>", f"1 < 2 and {LONG}"),
    (f"<article><p hidden>{OTHER}</p><p style='display: none'>{OTHER}</p><p>{LONG}</article>", LONG),
    (f"<p>{LONG} <span class=ad>Buy this</span> {OTHER}</p>", f"{LONG}\n{OTHER}"),
    (f"<p>{LONG}</p><!-- open comment <p>{OTHER}", LONG),
    (f"<article><p>{LONG}</p><div>{'word ' * 50_000}</div></article>", f"{LONG}\n{('word ' * 50_000).strip()}"),
    ("<article>" + "<div>" * 3_000 + LONG + "</article>", LONG),
])
def test_pages(html, text):
    assert H.main_text(html) == text


POLISH = "Wczoraj wieczorem nad rzeką zebrało się kilkaset osób, które chciały zobaczyć pierwszy pokaz nowej wystawy."
JAPANESE = "昨日の夕方、新しい展覧会の最初の公開を見るために、数百人が川のほとりに集まりました。"


@pytest.mark.parametrize("html,text", [
    *((f"<div class='{c}'><p>{LONG}</p><div class=sidebar>{OTHER}</div></div>", LONG) for c in ("has-sidebar", "box no-sidebar", "with-comments")),
    *((f"<{t} class='{c}'><p>{LONG}</p></{t}>", LONG) for t in ("main", "article") for c in ("has-sidebar", "widget", "sidebar-left")),
    (f"<div class=sidebar-left><ul class=menu><li>{OTHER}</ul><div id=header><article><p>{LONG}</article></div></div>", LONG),
    (f"<form id=aspnet><main><p>{LONG}</main></form><form><p>{OTHER}</form>", LONG),
    (f"<article><div class=entry-header><h1>Title</h1></div><header class=article-header>By me</header><p>{LONG}</article>", f"Title\nBy me\n{LONG}"),
    (f"<article><p>{LONG}</p><div id=comments><article><p>{OTHER}</article></div></article>", LONG),
    (f"<article title='hidden gems' data-hidden=no data-id=menu><p>{LONG}</article>", LONG),
    (f"<div class='cookie-notice'>{OTHER}</div><p>{LONG}", LONG),
    (f"<div class=sidebar><aside><article>{OTHER}</article></aside>{OTHER}</div><p>{LONG}", LONG),
    (f"<html><head><title>T</title><meta charset=utf-8><body><p>{LONG}", LONG),
    (f"<head><title>T</title><link rel=x><p>{LONG}", LONG),
    (f"<head><title>T</title>\n{LONG}", LONG),
    (f"<head><noscript><div>{OTHER}</div></noscript><template><p>{OTHER}</p></template></head><p>{LONG}", LONG),
    (f"<div><p>{POLISH}</p><p>{POLISH}</p></div>", f"{POLISH}\n{POLISH}"),
    (f"<div>We use cookies on all of our pages so that they work for you as you would have them. </div><p>{JAPANESE}", f"We use cookies on all of our pages so that they work for you as you would have them.\n{JAPANESE}"),
    (f"<p>{JAPANESE}</p><p><a href=x>{JAPANESE}</a></p>", JAPANESE),
    (f"<p>{LONG}</p><p>{'-' * 90}</p><p>{OTHER}</p><p>{'Brand Model Colour ' * 5}</p>", f"{LONG}\n{OTHER}"),
])
def test_no_article_is_lost(html, text):
    assert H.main_text(html) == text


@pytest.mark.parametrize("html,text", [
    (f"<article><p>{LONG}</p><section id=related-work><h2>Related work</h2><p>{OTHER}</section></article>", f"{LONG}\nRelated work\n{OTHER}"),
    (f"<article><h1 class=header-title>Title</h1><p>{LONG}</article>", f"Title\n{LONG}"),
    (f"<article><div class=header><h1>Title</h1></div><p>{LONG}</article>", f"Title\n{LONG}"),
    (f"<article><p>{LONG}</p><p class=notice-of-award>{OTHER}</article>", f"{LONG}\n{OTHER}"),
    (f"<article><p>{LONG}</p><h2 class=notice>Second part</h2><p>{OTHER}</article>", f"{LONG}\nSecond part\n{OTHER}"),
    (f"<div class=social-science><p>{LONG}</p></div>", LONG),
    (f"<div id=search-engine-history><h1>Search</h1><p>{LONG}</p><p>{OTHER}</div>", f"Search\n{LONG}\n{OTHER}"),
    *((f"<div class='{c}'><p>{OTHER}</div><p>{LONG}", LONG) for c in ("ad", "ad-box", "sidebar_left", "left-sidebar", "site-header", "cookie-notice", "related-posts", "x social-links")),
    *((f"<article><p>{LONG}</p></article><section><h3>{h}</h3><article><p>{OTHER}</article><article><p>{OTHER}</article></section>", LONG)
      for h in ("12 Comments", "Comments (3)", "2 reader comments", "3 Kommentare")),
    (f"<article><p>{LONG}</p><section><h3>Comments on the text</h3><p>{OTHER}</section></article>", f"{LONG}\nComments on the text\n{OTHER}"),
    (f"<article><p>{LONG}</p><div><h2>1 comment</h2><ul><li><p>{OTHER}</ul></div><p>{OTHER}</article>", f"{LONG}\n{OTHER}"),
])
def test_names_count_as_a_whole_and_threads_by_their_heading(html, text):
    assert H.main_text(html) == text


@pytest.mark.parametrize("html", [
    "<div>" * 100_000 + "</b>" * 100_000, "<b>" * 100_000 + "<div></div>" * 100_000, "<div>" * 100_000 + "<body>" * 100_000,
    "<div class=ad>" * 100_000 + "<article>" * 100_000, "<p>" * 200_000, "<li><b>" * 100_000, "<a '" * 100_000, "<i>" * 100_000 + "</i>" * 100_000,
])
def test_time_is_linear_in_the_page(html):
    start = time.process_time()
    H.main_text(html + LONG)
    assert time.process_time() - start < 12


def plain_label(blocks):
    """The two passes again, each rule by itself and the nearest decided block looked for one step at a time."""
    visible = [len(b.text.replace(" ", "")) for b in blocks]
    wide = [len(b.text) + 2 * sum("\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7a3" for c in b.text) for b in blocks]
    words = [re.findall(r"[^\W\d_]+", b.text.lower()) for b in blocks]
    stops = [sum(w in H.STOP_WORDS for w in ws) for ws in words]
    foreign = [2 * sum(c.isalpha() and c > "\u024f" and not "\u1e00" <= c <= "\u1eff" for c in b.text) > sum(map(len, ws)) for b, ws in zip(blocks, words)]
    out = []
    bad = [b.boilerplate or b.linked > H.LINK_DENSITY * v for b, v in zip(blocks, visible)]
    long = [not x and w >= H.SHORT for x, w in zip(bad, wide)]
    latin = [i for i in range(len(blocks)) if long[i] and not foreign[i]]
    listed = sum(stops[i] for i in latin) >= H.LISTED * sum(len(words[i]) for i in latin)
    for i, b in enumerate(blocks):
        if bad[i]:
            out.append("bad")
        elif not long[i]:
            out.append("bad" if b.linked and not b.content else "")
        elif b.content:
            out.append("good")
        else:
            dense = stops[i] >= H.STOP_DENSITY * len(words[i])
            out.append("good" if words[i] and (dense or foreign[i] or not listed) else "bad")
    final = list(out)
    for i, b in enumerate(blocks):
        if out[i]:
            continue
        region = [j for j, c in enumerate(blocks) if c.content == b.content and not (c.content and c.boilerplate)]
        here = region.index(i)
        for step in range(1, len(region) + 1):
            near = [out[region[j]] for j in (here - step, here + step) if 0 <= j < len(region) and out[region[j]]]
            if near:
                break
        favoured = "good" if b.content else "bad"
        final[i] = favoured if not near or favoured in near else near[0]
    return final


@pytest.mark.parametrize("seed", range(300))
def test_labels_against_a_plain_implementation(seed):
    r = random.Random(seed)
    texts = ["a", "menu", LONG, OTHER, JAPANESE, "日本" * 9, "日本" * 14, POLISH, "Brand Model Colour " * 5, "-" * 90, "the of and " * 9, "x" * 69, "x" * 70, "x" * 71]
    blocks = []
    for _ in range(r.randrange(1, 25)):
        text = r.choice(texts).strip()
        linked = r.choice([0, 0, 0, 1, len(text) // 2, len(text)])
        blocks.append(H.Block(r.random() < 0.5, r.random() < 0.2, text=text, linked=linked))
    want = plain_label(blocks)
    H.label(blocks)
    assert [b.label for b in blocks] == want


def test_open_blocks_take_the_nearest_label():
    blocks = [H.Block(False, False, text=t) for t in ("x" * 80, "a", "b", "c", "the " * 30, "d", "e")]
    H.label(blocks)
    assert [b.label for b in blocks] == ["bad", "bad", "bad", "good", "good", "good", "good"]
    blocks = [H.Block(True, False, text=t) for t in ("a", "b")]
    H.label(blocks)
    assert [b.label for b in blocks] == ["good", "good"]


def test_any_input_is_taken():
    r = random.Random(2)
    parts = ["<p>", "</p>", "<div class=ad>", "</div>", "<", ">", "&", "&amp", "<!--", "-->", "<script", "</a>", "<a href='", '"', "text ", "<article>", "</article>", "<br/>", "<li>", "<![CDATA["]
    for _ in range(500):
        assert isinstance(H.main_text("".join(r.choices(parts, k=r.randrange(40)))), str)


def test_rows(spark):
    rows = [(1, "u", f"<p>{LONG}", "x"), (None, None, None, "x"), (1, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(str, map(tuple, H.extract(pages).collect())))
    assert got == sorted(map(str, [(1, "u", LONG, len(LONG)), (None, None, "", 0), (1, "u", "", 0)]))
    assert H.extract(pages.limit(0)).count() == 0


def test_query_finds_the_articles(spark):
    import re
    from html import unescape

    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = QUERIES["op4_html_text"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search("<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        parts = re.split("</?(?:p|h1)>", article)
        texts = (" ".join(unescape(re.sub("<[^>]+>", " ", re.sub("</?b>", "", p))).split()) for p in parts)
        assert r.text == "\n".join(t for t in texts if t) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url

"""Main text of web pages by block rules in two passes.

A page is cut into blocks at its block elements. The first pass decides blocks by the elements around
them, link density, length and stop-word density; short ones stay undecided. In the second
pass these take the label of their nearest decided neighbours.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwell.llm.common import over_texts

#: HTML elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CONTENT = frozenset(["article", "main"])
BOILERPLATE = frozenset(
    "nav footer aside menu dialog noscript template svg canvas object audio video map select button head math".split()
)
#: Elements that leave a head open; any other, or text, ends it.
IN_HEAD = frozenset("base bgsound head html link meta noframes noscript script style template title".split())
#: Words that tell a part which is not the main text, as a whole class, id or role, or with words of place and form.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies disclaimer disqus footer gdpr header login menu modal nav navbar navigation newsletter notice "
    "notification pagination popup promo promotion promoted recommended related respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Words that say where a part is, and what form it has; with them a mark stays one.
PLACES = frozenset("bottom global left lower right secondary site sticky top upper".split())
FORMS = frozenset(
    "area bar block bottom box button buttons cell column container content form group holder icons inner item items left "
    "links list main outer panel posts region right row section sticky strip top wrap wrapper zone".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a heading of a comment thread can stand for.
THREADS = frozenset("aside details div ol section ul".split())
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its "
    "more no not of on one or other our out she so than that the their them there they this to up was we were what when "
    "which who will with would you "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus "
    "pour qu que qui sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einen einer er es für hat "
    "ich ihr im ist mit nach nicht noch nur oder sich sie sind so über um und uns unter vom von vor war was wenn wie wir "
    "wird zu zum zur "
    "al como con cuando del el ella ellos entre era esta este fue ha hay las lo los me mi muy nos o para pero porque se "
    "sin sobre son su sus también tan te tiene todo una uno y ya".split()
)

SHORT = 70
"""Code points under which a block without links is undecided; letters of :data:`_WIDE` count three times."""
LINK_DENSITY = 0.5
STOP_DENSITY = 0.12
LISTED = 0.25
"""Stop-word density of a page's longer blocks under which its language is taken to have no list."""

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|iframe|xmp|noembed|noframes)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[^\W\d_]+")
_FOREIGN = re.compile(r"[^\W\d_\u0000-\u024f\u1e00-\u1eff]")
"""Letters that are not Latin; no stop list has them."""
_THREAD = re.compile(
    r"\W*(?:\d+\W*(?:reader\W+)?(?:comments?|replies|responses|commentaires?|kommentare?|comentarios?)"
    r"|(?:reader\W+)?(?:comments?|replies|responses|commentaires?|kommentare?|comentarios?)\W*\d+)\W*\Z", re.I,
)
"""A heading that counts comments."""
_WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3\uf900-\ufaff\U00020000-\U0003ffff]")


@dataclass
class Mark:
    """An element that its class, id or role, or being a form, tells to be no main text; lifted where it holds an article or main,
    unless it is a comment thread, whose comments may be articles."""

    around: Mark | None
    lifted: bool = False
    thread: bool = False


@dataclass
class Block:
    content: bool
    boilerplate: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: str = ""
    mark: Mark | None = None


@dataclass
class _Open:
    tag: str
    boilerplate: bool
    content: bool
    link: bool
    mark: Mark | None = None
    article: bool = False
    block: int = 0
    """Where the nearest block element is on the stack, itself included."""


def _names(word: str, content: bool) -> bool:
    """Whether a class, id or role names a part that is no main text; a header inside the content is one of its own."""
    if content and word == "header":
        return False
    parts = re.split("[_-]+", word)
    while len(parts) > 1 and parts[0] in PLACES:
        del parts[0]
    return parts[0] in MARKS and all(p in MARKS or p in FORMS or p.isdigit() for p in parts)


def _marks(attributes: str, content: bool) -> tuple[bool, bool]:
    """Whether attributes hide an element, and whether a class, id or role marks it."""
    marked = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, marked
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return True, marked
        elif name in ("class", "id", "role"):
            marked = marked or any(_names(word, content) for word in value.split())
    return False, marked


def blocks_of(html: str) -> list[Block]:
    """Blocks with text, in page order. Unclosed paragraphs and items end at the next block, a head at
    what cannot be in one; other elements end with their tag or that of an element around them.

    A mark holds for all in its element, unless that is or has a main or an article; headings bear none of their own. Articles
    inside an article (its comments, as HTML has it) lift no mark, nor do those after a heading that counts comments, which marks the
    rest of the element it is in. The time is linear in the page: what is open is counted by name.
    """
    stack = [_Open("", False, False, False)]
    blocks = [Block(False, False)]
    opened: Counter[str] = Counter()

    def close(depth: int) -> None:
        opened.subtract(o.tag for o in stack[depth:])
        del stack[depth:]

    def close_last(tag: str) -> bool:
        """Close the innermost element of this name and all in it."""
        if not opened[tag]:
            return False
        depth = len(stack) - 1
        while stack[depth].tag != tag:
            depth -= 1
        close(depth)
        return True

    def text(raw: str) -> None:
        if stack[-1].tag == "head" and not raw.isspace():
            close(len(stack) - 1)
            new_block()
        block = blocks[-1]
        decoded = unescape(raw)
        block.parts.append(decoded)
        if stack[-1].link:
            block.linked += len("".join(decoded.split()))

    def new_block() -> None:
        if blocks[-1].parts:
            blocks.append(Block(False, False))
        blocks[-1].content, blocks[-1].boilerplate, blocks[-1].mark = stack[-1].content, stack[-1].boilerplate, stack[-1].mark

    at = 0
    for token in _TOKEN.finditer(html):
        if token.start() > at:
            text(html[at : token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if tag in VOID:
            if tag == "hr":
                new_block()
            elif tag == "br":
                blocks[-1].parts.append(" ")
            continue
        is_block = tag in BLOCKS
        if token["end"]:
            heading = blocks[-1] if tag in HEADINGS else None
            closed = close_last(tag)
            if heading is not None and closed and stack[-1].tag in THREADS and _THREAD.match("".join(heading.parts)):
                heading.mark = stack[-1].mark = Mark(stack[-1].mark, thread=True)
            if is_block or closed:
                _settle(is_block, new_block, blocks, stack)
            continue
        if (tag == "body" or tag not in IN_HEAD and stack[-1].tag == "head") and close_last("head"):
            new_block()
        if is_block:
            around = stack[-1].block
            if stack[around].tag == "p" or stack[around].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                close(around)
        top = stack[-1]
        header = tag == "header" and not top.content
        bad, mark = top.boilerplate or tag in BOILERPLATE or header, top.mark
        marked = tag == "form"
        if tag not in ("html", "body") and tag not in HEADINGS and ("=" in token["attributes"] or "hidden" in token["attributes"].lower()):
            hidden, named = _marks(token["attributes"], top.content)
            bad, marked = bad or hidden, marked or named
        elif tag in HEADINGS and token["attributes"]:
            bad = bad or _marks(token["attributes"], True)[0]
        if tag == "main" or tag == "article" and not top.article:
            while not bad and mark and not mark.lifted and not mark.thread:
                mark.lifted, mark = True, mark.around
            mark = top.mark
        elif marked:
            mark = Mark(top.mark)
        if not token["attributes"].endswith("/") or is_block:
            stack.append(_Open(
                tag, bad, top.content or tag in CONTENT, top.link or tag == "a", mark, top.article or tag == "article",
                len(stack) if is_block else top.block,
            ))
            opened[tag] += 1
            _settle(is_block or bad != top.boilerplate, new_block, blocks, stack)
    if at < len(html):
        text(html[at:])
    kept = []
    for block in blocks:
        block.text = " ".join("".join(block.parts).split())
        if block.text:
            block.boilerplate = block.boilerplate or block.mark is not None and not block.mark.lifted
            kept.append(block)
    return kept


def _settle(is_block: bool, new_block, blocks: list[Block], stack: list[_Open]) -> None:
    """Start a block at a block element, or where boilerplate starts or ends inside one."""
    if is_block or blocks[-1].boilerplate != stack[-1].boilerplate or blocks[-1].mark is not stack[-1].mark:
        new_block()


def label(blocks: list[Block]) -> None:
    """Both passes; ``label`` is ``good`` or ``bad``.

    First: boilerplate and blocks of links are bad. Blocks under :data:`SHORT` stay open. A longer
    one is good in an article or if stop words are dense enough. Where the stop lists do not know its language
    (most letters are not Latin, or the page's Latin blocks have too few stop words) its length is enough; else it is bad. Second: an open
    block looks both ways for the nearest decided block of its own region (in an article or not) and takes the nearer label; at equal
    distances a good one wins in an article, a bad one outside. Without any, it is good in an article only.
    """
    longer, stops, total = [], 0, 0
    for block in blocks:
        visible = len(block.text) - block.text.count(" ")
        if block.boilerplate or block.linked > LINK_DENSITY * visible:
            block.label = "bad"
        elif len(block.text) < SHORT and _size(block.text) < SHORT:
            block.label = "bad" if block.linked and not block.content else ""
        else:
            words = _WORD.findall(block.text.lower())
            found = sum(w in STOP_WORDS for w in words)
            foreign = not block.text.isascii() and 2 * len(_FOREIGN.findall(block.text)) > sum(map(len, words))
            longer.append((block, bool(words), foreign, found >= STOP_DENSITY * len(words)))
            if not foreign:
                stops, total = stops + found, total + len(words)
    listed = stops >= LISTED * total
    for block, lettered, foreign, dense in longer:
        block.label = "good" if block.content or lettered and (dense or foreign or not listed) else "bad"
    for content in (True, False):
        region = [b for b in blocks if b.content == content and not (content and b.boilerplate)]
        favoured = "good" if content else "bad"
        before, distance = _nearest(region)
        after, back = _nearest(region[::-1])
        for b, left, dl, right, dr in zip(region, before, distance, after[::-1], back[::-1]):
            if not b.label:
                near = [x for x, d in ((left, dl), (right, dr)) if x and d == min(dl, dr)]
                b.label = favoured if not near or favoured in near else near[0]


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text) + 2 * len(_WIDE.findall(text))


def _nearest(region: list[Block]) -> tuple[list[str], list[float]]:
    """Label of the last decided block before each, and how far it is."""
    labels, distances, last, away = [], [], "", float("inf")
    for block in region:
        away += 1
        labels.append(last)
        distances.append(away)
        if block.label:
            last, away = block.label, 0.0
    return labels, distances


def main_text(html: str) -> str:
    blocks = blocks_of(html)
    label(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from the whole html; null html counts as empty.

    A page without text gives an empty string. Null and repeated ids and urls are passed through.
    """
    rows = pages.select(
        F.struct(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).alias("doc_id"),
        F.coalesce(F.col(html_col), F.lit("")).alias("text"),
    )

    def extracted(pages_html: list[str]) -> dict[str, list]:
        texts = [main_text(h) for h in pages_html]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    found = over_texts(rows, extracted, {"text": pa.string(), "n_chars": pa.int64()})
    return found.select("doc_id.page_id", "doc_id.url", "text", "n_chars")

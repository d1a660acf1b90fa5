"""Main text of web pages by two passes over their blocks.

One narrow pass over the table. A page's markup is read once, from left to
right, into blocks: runs of text between block-level tags, with the share of
their characters that lies in links, and the region they lie in: *content*
(inside article or main), *margin* (navigation, headers, footers, asides, forms
and whatever class, id or role names say) or *plain*.

First pass: margin blocks, blocks with many links, and plain blocks with a
copyright sign are bad; short blocks are ambiguous; longer ones are good, close
to good, or bad by the share of stop words, and at least close to good in
content. Second pass: an ambiguous block takes the label of its nearest decided
neighbours on both sides; where they differ it goes with a block close to good.
The edges of content count as good neighbours, those of the page as bad ones. A
heading before a good block is good. Where a page has content, plain blocks of
it are bad.

Defined cases: null and empty html give an empty text; unclosed and crossing
tags, comments, quotes and scripts end where the markup around them or the page
does; text without tags is one plain block; rows that repeat an id are pages
each, null ids and urls stay null; very long pages take time in proportion to
their length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least characters of a block that stop words decide; of one that is good rather than close to good.
SHORT, LONG = 70, 200
#: Least share of stop words of good blocks, and of blocks close to good; most share of link characters of either, by region.
DENSE, SPARSE, LINKS = 0.32, 0.30, {"content": 0.5, "plain": 0.33, "margin": 0.0}
#: Most characters between a heading and the good block that makes it good.
HEADING_REACH = 200

# Function words by language.
STOP_WORDS = {
    "en": "a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its "
          "may more most no not of on one only or other our out over said she so some such than that the their them then there these they this "
          "those to under up was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die diese dieser doch du durch ein eine einem einen einer er es für hat "
          "hatte ich ihr im in ist ja kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war was wenn werden "
          "wie wird wir zu zum zur",
    "fr": "à au aux avec c ce ces cette comme d dans de des du elle en est et être fait il ils j je l la le les leur lui mais me même n ne nous on "
          "ont ou où par pas plus pour qu que qui s sa sans se ses si son sont sur un une vous y",
    "es": "a al como con cuando de del desde donde el ella en entre era es esta este esto fue ha hay la las le lo los más me mi muy no nos o para "
          "pero por que se ser si sin sobre son su sus también te todo un una y ya",
}

# Element names.
SILENT = {"script", "style", "template", "noscript", "noframes", "noembed", "iframe", "object", "svg", "math", "canvas", "audio", "video", "select", "textarea", "button", "title", "head"}
RAW = {"script", "style", "textarea", "title", "noscript", "noframes", "noembed", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTENT_TAGS, MARGIN_TAGS = {"article", "main"}, {"nav", "aside", "footer", "form", "dialog", "menu", "search", "fieldset"}
MARGIN_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar", "tablist", "status"}
#: Words of class names and ids that mark what is not the article.
MARGIN_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "alert", "banner", "breadcrumb", "breadcrumbs", "captcha", "comment", "comments", "consent", "cookie",
    "cookies", "copyright", "disclaimer", "discussion", "disqus", "feedback", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "notification", "outbrain", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond",
    "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "taboola", "toolbar", "topbar",
}
#: Words that mark the head of an article where they stand beside "header"; alone, that word marks the head of the page.
ARTICLE_NAMES = {"article", "entry", "post", "story", "content", "section"}
#: Words that take the meaning out of a name ("has-sidebar", "no-comments").
NEUTRAL_NAMES = {"has", "with", "no", "without", "is"}

CONTENT, PLAIN, MARGIN = "content", "plain", "margin"
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTED = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")


def stop_share(text: str, lists=None) -> float:
    """Share of stop words among the words of a text, for the language with most of them."""
    words = _WORD.findall(text.lower())
    if not words:
        return 0.0
    return max(sum(w in known for w in words) for known in (lists or _LISTS)) / len(words)


_LISTS = [frozenset(words.split()) for words in STOP_WORDS.values()]


def _named_margin(names: str, outer: str) -> bool:
    for name in names.split():
        parts = {p.lower() for p in _PARTS.findall(name)}
        if parts & NEUTRAL_NAMES:
            continue
        if parts & MARGIN_NAMES or (outer == PLAIN and "header" in parts and not parts & ARTICLE_NAMES):
            return True
    return False


def _region(tag: str, attributes: str, outer: str) -> str:
    """Region of an element inside a region."""
    if outer == MARGIN or tag in MARGIN_TAGS:
        return MARGIN
    if tag == "header" and outer != CONTENT:
        return MARGIN
    held = {}
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            held.setdefault(name.lower(), next((v for v in values if v), ""))
    role = held.get("role", "").lower()
    if role in MARGIN_ROLES or "hidden" in held or held.get("aria-hidden", "").lower() == "true":
        return MARGIN
    if tag not in ("html", "body", "main") and _named_margin(f"{held.get('class', '')} {held.get('id', '')}", outer):
        return MARGIN
    if tag in CONTENT_TAGS or role in CONTENT_TAGS or held.get("itemprop", "") == "articleBody":
        return CONTENT
    return outer


def _closings(page: str):
    """Finds the end of raw text: a function (tag, from) -> place of its closing tag or -1; a tag found missing is not looked for again."""
    lower, missing = page.lower() if page.isascii() else None, set()

    def find(tag: str, start: int) -> int:
        if tag in missing:
            return -1
        if lower is not None:
            at = lower.find(f"</{tag}", start)
        else:
            hit = re.compile(f"</{tag}", re.IGNORECASE).search(page, start)
            at = hit.start() if hit else -1
        if at < 0:
            missing.add(tag)
        return at

    return find


def blocks_of(page: str) -> list[tuple[str, int, str, bool]]:
    """(text, characters in links, region, heading) of each block with text, in page order."""
    out, text, linked = [], [], 0
    stack: list[tuple[str, str]] = []
    opened: dict[str, int] = {}
    silent, breaks, heading, quotes = 0, 0, False, True
    find_closing = _closings(page)

    def region() -> str:
        return stack[-1][1] if stack else PLAIN

    def flush() -> None:
        nonlocal text, linked, heading, breaks
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append((whole, linked, region(), heading))
        text, linked, heading, breaks = [], 0, False, 0

    def close(tag: str) -> None:
        nonlocal silent
        while stack:
            if stack[-1][1] != (stack[-2][1] if len(stack) > 1 else PLAIN):
                flush()
            name, _ = stack.pop()
            opened[name] -= 1
            silent -= name in SILENT
            if name == tag:
                return

    def add(piece: str) -> None:
        nonlocal linked, breaks
        if silent or not piece:
            return
        piece = references.unescape(piece) if "&" in piece else piece
        text.append(piece)
        if not piece.isspace():
            breaks = 0
            if opened.get("a"):
                linked += len("".join(piece.split()))

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            if stop < 0:
                break
            at = stop + 3
            continue
        closing = page.startswith("/", lt + 1)
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            if page[lt + 1 : lt + 2] in ("!", "?", "/") and page[lt + 1 : lt + 2]:
                stop = page.find(">", lt)
                if stop < 0:
                    break
                at = stop + 1
            else:
                add("<")
                at = lt + 1
            continue
        tag = name.group().lower()
        whole = _QUOTED.match(page, name.end()) if quotes else None
        if whole:
            stop = whole.end()
        else:
            # A quote that nothing closes: from here on tags end at the next ">".
            quotes, stop = False, page.find(">", name.end()) + 1
            if not stop:
                break
        attributes = page[name.end() : stop - 1]
        at = stop
        if tag == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                add(" ")
            continue
        if tag in BLOCKS:
            flush()
        if closing:
            if opened.get(tag):
                close(tag)
            continue
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCKS):
            continue
        if tag == "a" and opened.get("a") or tag in BLOCKS and opened.get("p") and not silent:
            close("a" if tag == "a" else "p")
        if tag == "body":
            while opened.get("head"):
                close("head")
        heading = heading or tag in HEADINGS
        inner = _region(tag, attributes, region())
        if inner != region():
            flush()
            heading = tag in HEADINGS
        stack.append((tag, inner))
        opened[tag] = opened.get(tag, 0) + 1
        silent += tag in SILENT
        if tag in RAW:
            stop = find_closing(tag, at)
            if stop < 0:
                break
            at = stop
    flush()
    return out


def _first_labels(blocks) -> list[str]:
    held = any(region == CONTENT for _, _, region, _ in blocks)
    labels = []
    for text, linked, region, _ in blocks:
        n = len(text)
        if region == MARGIN or (held and region == PLAIN) or linked > LINKS[region] * n:
            labels.append("bad")
        elif region == PLAIN and ("\xa9" in text or (n < SHORT and linked)):
            labels.append("bad")
        elif n < SHORT:
            labels.append("short")
        else:
            share = stop_share(text)
            if share >= DENSE and n > LONG:
                labels.append("good")
            else:
                labels.append("near" if share >= SPARSE or region == CONTENT else "bad")
    return labels


def _nearest(blocks, labels, order, wide: bool) -> list[str]:
    """For each block, the nearest decided label before it in ``order``; blocks close to good count as decided if ``wide``."""
    out, last, before = [""] * len(blocks), "bad", None
    for i in order:
        region = blocks[i][2]
        if region == CONTENT and before != CONTENT:
            last = "good"
        elif before == CONTENT and region != CONTENT:
            last = "bad"
        out[i], before = last, region
        if labels[i] in ("good", "bad") or (wide and labels[i] == "near"):
            last = labels[i]
    return out


def label_blocks(blocks) -> list[bool]:
    """Which blocks belong to the main text."""
    labels, n = _first_labels(blocks), len(blocks)
    # A heading waits for the good block after it.
    reach, nearest = [0] * n, "bad"
    gap = 0
    raised = list(labels)
    for i in range(n - 1, -1, -1):
        if blocks[i][3] and labels[i] == "short" and nearest == "good" and gap <= HEADING_REACH:
            raised[i] = "near"
        if labels[i] == "good":
            nearest, gap = "good", 0
            continue
        if labels[i] == "bad" and not blocks[i][3]:
            nearest = "bad"
        gap += len(blocks[i][0])
    labels = raised
    forth, back = range(n), range(n - 1, -1, -1)
    left, right = _nearest(blocks, labels, forth, False), _nearest(blocks, labels, back, False)
    near_left, near_right = _nearest(blocks, labels, forth, True), _nearest(blocks, labels, back, True)
    second = list(labels)
    for i, label in enumerate(labels):
        if label != "short":
            continue
        if left[i] == right[i]:
            second[i] = left[i]
        else:
            near = near_left[i] if left[i] == "bad" else near_right[i]
            second[i] = "good" if near == "near" else "bad"
    left, right = _nearest(blocks, second, forth, False), _nearest(blocks, second, back, False)
    return [label == "good" or (label == "near" and "good" in (left[i], right[i])) for i, label in enumerate(second)]


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(block[0] for block, kept in zip(blocks, label_blocks(blocks)) if kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def extraction_sql() -> str:
    """The article's text in DuckDB SQL, for pages that mark it up as h1 and p inside article and hold no character references but these."""
    entities = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]
    plain = "regexp_replace(b, '<[^>]*>', ' ', 'g')"
    for name, sign in entities:
        plain = f"replace({plain}, '{name}', '{sign}')"
    return rf"""
WITH blocks AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:h1|p)>'),
         lambda b: trim(regexp_replace({plain}, '[\s\x0B]+', ' ', 'g'))) AS found
  FROM pages),
texts AS (SELECT page_id, url, array_to_string(list_filter(found, lambda b: b <> ''), chr(10) || chr(10)) AS text FROM blocks)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""

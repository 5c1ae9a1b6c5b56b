"""Main-text extraction by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; a linear scan (Kadane) finds the best
contiguous region, and the region's blocks are the text. The weights are log-odds, counted on labelled pages
(`labelled_pages`: layouts written for this purpose, whose content blocks are marked): a word's by where it stands
(in an article or main element, in a link, elsewhere), a tag's by its name. Elements that are never content (menus,
page headers and footers, sidebars, notices, adverts, forms, scripts, styles, reader comments), by name, role, class or
id, give their tags' negative scores but no words, so the region may cross but never show them.

A class or id says so only of an element that does not hold most of the page's characters, unless an article or main element
lies outside it, and not behind has-, with-, without- or no-. Text outside article and main elements is left out only if they hold most of
the page's characters; otherwise the scan decides.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_CUE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notices?|newsletter|subscribe|subscription|signup|"
    r"sidebar|side-?bar|widgets?|related|recommended|share|sharing|social|breadcrumbs?|menu|nav|navbar|navigation|comments?|comment-?list|disqus|replies|respond|popup|modal|overlay|"
    r"pagination|pager|footer|masthead|site-?header|page-?header|toolbar|skip-?link)(?:$|[\s_-])",
    re.I,
)
#: A class that tells what else a page has or lacks.
_MODIFIER = re.compile(r"(?:^|(?<=[\s_-]))(?:has|have|with|without|no)[_-]\S*", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "form", "menu", "menubar", "toolbar"}
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "select", "svg", "math", "object", "video", "audio", "canvas", "title", "head"}
_NEVER = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "input", "label", "fieldset", "datalist"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def _never(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is never content for sure, and whether a class or id says so."""
    if name in _NEVER or (name == "header" and not inside):
        return True, False
    cue = False
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True, False
        if key == "role" and value in _ROLES:
            return True, False
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and _CUE.search(value) and _CUE.search(_MODIFIER.sub("", value)):
            cue = True
    return False, cue


def _closed_raw(page: str, pos: int, name: str, attributes: str) -> bool:
    """Whether a raw element is closed in itself (<svg/>); of an HTML one its own end tag must not come next."""
    if not attributes.rstrip().endswith("/"):
        return False
    after = None if name in ("svg", "math") else re.compile(rf"<(/?){re.escape(name)}\b", re.I).search(page, pos)
    return after is None or not after[1]


def tokens(page: str):
    """(kind, value, context) in page order: ("tag", name, never), ("text", string, context), ("block", None, None).

    context: "never", "link", "main" (in an article or main element) or "plain". An element left open ends with the
    element around it.
    """
    seq = list(_tokens(page))
    held, mains, total = Counter(), Counter(), 0
    for kind, value, context, cues in seq:
        if kind == "text" and context != "never":
            size = len(value.strip())
            total += size
            for c in cues:
                held[c] += size
        elif kind == "tag" and value in ("article", "main"):
            mains[None] += 1
            for c in cues:
                mains[c] += 1
    spared = {c for c, size in held.items() if 2 * size > total and mains[c] == mains[None]}
    for kind, value, context, cues in seq:
        if kind != "block" and not spared.issuperset(cues):
            context = True if kind == "tag" else "never"
        yield kind, value, context


def _tokens(page: str):
    """As tokens, with the elements around that a class or id calls never content, which do not count in context."""
    stack: list[tuple[str, bool, int]] = []  # name, never content, place if by class or id or else -1
    cues: tuple[int, ...] = ()
    blocked = main = links = at = 0
    pos, n = 0, len(page)
    while pos < n:
        m = _TOKEN.search(page, pos)
        if m is None:
            at = n
        else:
            at = m.start()
        if at > pos:
            yield "text", page[pos:at], "never" if blocked else "link" if links else "main" if main else "plain", cues
        if m is None:
            return
        pos = m.end()
        if m[2] is None:
            if page.startswith("<![CDATA[", at):
                yield "text", page[at + 9 : pos - 3], "never" if blocked else "plain", cues
            continue
        name, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if name in _RAW and not closing:
            if _closed_raw(page, pos, name, attributes):
                yield "tag", name, True, cues
                yield "block", None, None, cues
                continue
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, pos)
            if name == "head" and end is None:
                body = re.compile(r"<body\b", re.I).search(page, pos)
                pos = body.start() if body else pos
            else:
                pos = end.end() if end else n
            yield "tag", name, True, cues
            yield "block", None, None, cues
            continue
        if name not in _INLINE:
            yield "block", None, None, cues
        if closing:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is None or (name in _INLINE and any(x not in _INLINE for x, *_ in stack[depth + 1 :])):
                continue
            gone = stack[depth:]
            del stack[depth:]
            never, around = bool(blocked), cues
            blocked -= sum(x for _, x, _ in gone)
            main -= sum(x in ("article", "main") for x, *_ in gone)
            links -= sum(x == "a" for x, *_ in gone)
            cues = cues[: len(cues) - sum(x >= 0 for *_, x in gone)]
            yield "tag", "/" + name, never, around
            continue
        if name in _CLOSES_P:
            while stack and (stack[-1][0] == "p" or (stack[-1][0] in _INLINE and any(x == "p" for x, *_ in stack))):
                x, never, cue = stack.pop()
                blocked -= never
                cues = cues[: len(cues) - (cue >= 0)]
                links -= x == "a"
        never, cue = _never(name, attributes, main > 0)
        if name not in _VOID and not attributes.rstrip().endswith("/"):
            stack.append((name, never, at if cue else -1))
            blocked += never
            cues = (*cues, at) if cue else cues
            main += name in ("article", "main")
            links += name == "a"
        yield "tag", name, bool(blocked), cues
        if name == "br":
            yield "text", "\n", "never" if blocked else "main" if main else "plain", cues


def labelled_pages() -> list[tuple[str, set[str]]]:
    """Pages in common layouts with their content blocks: made by rule, so that weights can be counted without a corpus."""
    out = []
    words = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt".split()
    say = lambda k, n: " ".join(words[(k * 7 + i * 3) % len(words)] for i in range(n)) + f" {k}."
    menu = lambda k: "<ul>" + "".join(f'<li><a href="/{i}">{words[(k + i) % len(words)]}</a></li>' for i in range(6)) + "</ul>"
    wraps = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("<div>", "</div>"), ('<div id="post"><section>', "</section></div>")]
    for k in range(20):
        blocks = [say(100 * k + i, 6 + (k * 5 + i * 11) % 40) for i in range(3 + k % 5)]
        a, b = wraps[k % len(wraps)]
        body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{x}</p>" if i % 3 else f"<p>{x}<br></p>" for i, x in enumerate(blocks[1:]))
        before = f"<nav>{menu(k)}</nav>" if k % 2 else f"<div>{menu(k)}</div>"
        after = f'<div class="sidebar">{menu(k + 1)}</div><footer>{say(k, 8)}</footer>' if k % 3 else f"<div><span>{say(k + 1, 3)}</span>{menu(k)}</div>"
        out.append((f"<html><head><title>{say(k, 4)}</title></head><body>{before}{a}{body}{b}{after}</body></html>", set(blocks)))
    return out


def fit(pages: list[tuple[str, set[str]]]) -> tuple[dict[str, float], dict[str, float]]:
    """Word scores by context (positive) and tag scores by name (negative)."""
    inside, outside = Counter(), Counter()
    for page, blocks in pages:
        seq = list(tokens(page))
        marks = [i for i, (kind, value, _) in enumerate(seq) if kind == "text" and " ".join(html.unescape(value).split()) in blocks]
        for i, (kind, value, context) in enumerate(seq):
            where = inside if marks[0] <= i <= marks[-1] else outside
            if kind == "text" and context != "never":
                where["word", context] += len(value.split())
            elif kind == "tag":
                where["tag", value.lstrip("/")] += 1
    odds = lambda key: math.log((inside[key] + 1) / (outside[key] + 1))
    word = {c: max(0.05, odds(("word", c))) for c in ("main", "plain", "link")}
    tag = {v: min(-0.05, odds(("tag", v))) for kind, v in {*inside, *outside} if kind == "tag"}
    return word, tag


_WEIGHTS: list = []


def weights() -> tuple[dict[str, float], dict[str, float]]:
    if not _WEIGHTS:
        _WEIGHTS.append(fit(labelled_pages()))
    return _WEIGHTS[0]


def extract(page: str | None) -> str:
    """The main text: blocks joined by two \\n, white space inside a block as one space; empty if there is none."""
    if not page:
        return ""
    word, tag = weights()
    scores, items = [], []
    seq = list(tokens(page))
    held = Counter()
    for kind, value, context in seq:
        if kind == "text":
            held[context] += len(value.strip())
    whole = held["main"] > held["plain"]
    for kind, value, context in seq:
        if kind == "block":
            items.append(None)
            scores.append(0.0)
        elif kind == "tag":
            scores.append(tag.get(value.lstrip("/"), -0.5) if not context else -0.5)
            items.append("")
        else:
            # beside article or main elements that hold most of the page nothing else is content; a link in them is
            if context == "never" or (whole and context == "plain"):
                continue
            value = html.unescape(value)
            n = len(value.split())
            items.append(value)
            scores.append(n * word[context])
    best = low = total = 0.0
    start = first = last = 0
    for i, s in enumerate(scores):
        total += s
        if total - low > best:
            best, first, last = total - low, start, i + 1
        if total < low:
            low, start = total, i + 1
    blocks, now = [], []
    for value in [*items[first:last], None]:
        if value is None:
            text = " ".join("".join(now).split())
            if text:
                blocks.append(text)
            now = []
        else:
            now.append(value)
    return "\n\n".join(blocks)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html).

    A null or empty html gives an empty text; null ids and urls are passed on; repeated rows are extracted alike; other
    columns are ignored. n_chars counts code points.
    """

    def run(batches):
        for b in slices(batches, "html"):
            texts = [extract(h) for h in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("page_id").cast(pa.int64()), b.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))

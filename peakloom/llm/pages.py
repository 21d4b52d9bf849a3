"""Main text of web pages by tag-path ratios.

A scanner turns the page into text nodes, each with its tag path from the root (tag names with the first class). Text
and punctuation are summed by path: a path's text ratio is characters a node, its punctuation ratio marks a node.
Along the page both are smoothed over neighbouring nodes (Gaussian window) and fused with the path's share of all text.
What a path's tags and classes say (menus, notices, adverts, forms, comments) is a factor of its fused mean, MARKED.
Paths that then reach a share of the deviation of the page's fused values are content: marks lower a path's chance, but
where ratios don't differ no mark decides.

The smallest element that holds nearly all content, an article or main element before others, is the article; within
it unmarked text stays whatever its ratio, so that headings and short paragraphs aren't lost. Outside it, nodes on
content paths and other article and main elements with content stay; all else goes. Where the smallest element is the
whole page, headings and siblings of content stay too.

Cases: null counts as the empty page: empty text. Broken markup is read as far as it goes: unclosed tags end with
their parents, an unclosed comment, script or tag at the end is dropped. A page without tags is its own text. Null ids
and urls stay null, repeated rows give repeated results, other columns are not read. Elements know their parent and
paths are numbers, so time and memory are in proportion to a page's length at any depth; nothing is cut off.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import in_slices, map_arrow, text_of

_NAME = re.compile(r"(/?)([A-Za-z][A-Za-z0-9:-]*)")
#: A tag from its name on, up to what ends it: a quote opens after = only and closes at the same quote.
_INSIDE = re.compile(r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)[^>=]*+)*+""")
_ATTR = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?。，、；：！？…]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A start of one of these ends an open paragraph.
BLOCK = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start of the key ends open elements of the value, up to the nearest list or table.
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table select menu".split())
#: Elements whose content isn't text of the page.
DROPPED = frozenset("button select script style noscript template svg iframe textarea title head object canvas audio video map datalist".split())
#: Elements that are parts around the article; what they hold is marked.
AROUND = frozenset("nav aside footer dialog menu".split())
#: Blocks that hold one piece of text: never the article.
LEAF = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
#: Words of classes and ids for parts that are about others than the article, and for other parts around it.
PARTS = frozenset("ad ads advert adverts advertisement advertising promo promos promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices popup newsletter related recommended recommendations comment comments disqus reply replies respond outbrain taboola".split())
PLACES = frozenset("nav navbar navigation menu menus header masthead topbar footer sidebar sidebars aside banner modal overlay subscribe signup login share sharing social breadcrumb breadcrumbs pagination pager widget widgets search toolbar skip".split())
#: Words that may stand beside those in a compound; one with any other word (entry-header, notice-of-intent) marks nothing.
NEUTRAL = frozenset("area bar block blocks body bottom box button buttons col column container content dropdown form global group holder icons inner inline item items left level link links list main mobile nested outer page panel policy post posts primary rail region right row secondary section sections side site slot text thread title top unit wrap wrapper zone".split())
_COMPOUND = re.compile(r"[-_]+")
#: Smoothing window in nodes, and the share of the deviation that a path's fused mean must reach.
WINDOW = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
WINDOW /= WINDOW.sum()
SHARE = 0.25
HELD = 0.9
#: What a mark leaves of a path's fused ratio.
MARKED = 0.01


@dataclass
class Page:
    """Text nodes (text, element, block number) and elements; element 0 is the page. parent, tag, path, gone (no text of
    the page) and mark ("", "class", "part" or "kind") are by element, path_parent and path_tag by path. Parents have
    smaller numbers than what is in them, for elements and paths alike."""

    texts: list[str]
    at: list[int]
    blocks: list[int]
    parent: list[int]
    tag: list[str]
    path: list[int]
    gone: list[bool]
    mark: list[str]
    path_parent: list[int]
    path_tag: list[str]

    def summed(self, value: list[float]) -> list[float]:
        """Of a value by element, the sums with all that is in each."""
        out = list(value)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def inherited(self, own: list[bool]) -> list[bool]:
        """Of a flag by element, whether an element or one around it has it."""
        out = list(own)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out

    def lengths(self, chosen: list[bool]) -> list[float]:
        """Characters of the chosen nodes by element, with all that is in each."""
        own = [0.0] * len(self.parent)
        for text, e, ok in zip(self.texts, self.at, chosen, strict=True):
            if ok:
                own[e] += len(text)
        return self.summed(own)


def _tag_end(page: str, start: int) -> int:
    """Index of the > that ends the tag; quoted ones don't. A quote that never closes counts up to the next >."""
    return page.find(">", _INSIDE.match(page, start).end())


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", text), ("start", tag, attributes) and ("end", tag, "") of a page, in order. Raw text elements come
    as their start and end only."""
    at, n = 0, len(page)
    low = None
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, lt + 1)
        if not m:
            yield "text", "", "<"
            at = lt + 1
            continue
        end = _tag_end(page, m.end())
        if end < 0:
            return
        tag, at = m[2].lower(), end + 1
        if m[1]:
            yield "end", tag, ""
            continue
        inside = page[m.end() : end]
        yield "start", tag, inside
        if tag in RAW and not inside.endswith("/"):
            low = page.lower() if low is None else low
            if len(low) != n:  # a letter whose lower case is longer: search as it is
                low = page
            close = low.find("</" + tag, at)
            stop = page.find(">", close) if close >= 0 else -1
            at = n if close < 0 or stop < 0 else stop + 1
            yield "end", tag, ""


def _marked(tag: str, attributes: list[tuple[str, str]], in_article: bool) -> str:
    """How an element is marked: "" not, "gone" as holding no text of the page, "kind" by its kind or role, "part" by words
    for parts about others, "class" by other words or as a form, which can also be a wrapper of the whole page."""
    if tag in DROPPED:
        return "gone"
    if tag in AROUND or tag == "header" and not in_article:
        return "kind"
    found = "class" if tag == "form" else ""
    if not attributes or tag in ("html", "body", "article", "main"):
        return found
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "gone"
        if name == "role" and value.lower() in ROLES:
            if value.lower() not in ("form", "search"):
                return "kind"
            found = found or "class"
        if name in ("class", "id"):
            for words in (set(_COMPOUND.split(x)) - {""} for x in value.lower().split()):
                if words <= NEUTRAL | PLACES | PARTS and not words <= NEUTRAL:
                    found = "part" if found == "part" or words & PARTS else "class"
    return found


def parsed(page: str) -> Page:
    """The page's text nodes, white space only ones included (they separate words), and its elements."""
    out = Page([], [], [], [-1], [""], [0], [False], [""], [-1], [""])
    numbers: dict[tuple[int, str], int] = {}
    stack = [0]
    open_at: dict[str, list[int]] = defaultdict(list)  # depths of the open elements of each tag
    block = 0
    last = lambda tags: max((open_at[t][-1] for t in tags if open_at[t]), default=-1)

    def close(depth: int) -> None:
        nonlocal block
        inline = True
        while len(stack) > depth:
            tag = out.tag[stack.pop()]
            open_at[tag].pop()
            inline = inline and tag in INLINE
        block += not inline

    for kind, tag, value in scan(page):
        if kind == "text" or kind == "start" and tag == "br":
            out.texts.append(html.unescape(value) if kind == "text" else " ")
            out.at.append(stack[-1])
            out.blocks.append(block)
        elif kind == "start":
            if tag in BLOCK and open_at["p"] and open_at["p"][-1] > last(("td", "th", "li", "button", "table")):
                close(open_at["p"][-1])
            for other in SAME.get(tag, ()):
                if open_at[other] and open_at[other][-1] > last(SCOPE):
                    close(open_at[other][-1])
            block += tag not in INLINE
            if tag in VOID:
                continue
            around = stack[-1]
            attributes = [(n.lower(), a or b or c) for n, a, b, c in _ATTR.findall(value)] if value else []
            cls = next((v for n, v in attributes if n == "class"), "").split()
            mark = _marked(tag, attributes, bool(open_at["article"] or open_at["main"]))
            open_at[tag].append(len(stack))
            stack.append(len(out.parent))
            # equal paths have equal marks: what marks an element is part of its name
            name = f"{tag}.{cls[0] if cls else ''} {mark}"
            number = numbers.setdefault((out.path[around], name), len(out.path_parent))
            if number == len(out.path_parent):
                out.path_parent.append(out.path[around])
                out.path_tag.append(tag)
            out.parent.append(around)
            out.tag.append(tag)
            out.path.append(number)
            out.gone.append(out.gone[around] or mark == "gone")
            out.mark.append("" if mark == "gone" else mark)
        elif open_at[tag]:
            close(open_at[tag][-1])
        else:
            block += tag not in INLINE
    return out


def _weigh_marks(page: Page, seen: list[bool]) -> list[bool]:
    """Whether each element counts as marked. Marks by class also stand on wrappers of a layout: the largest article or
    main element under such marks loses those of its wrappers, if it has more text than all that is unmarked, and
    no article or main element is unmarked. Else, if unmarked text is under 1 - HELD of what isn't a part that other
    parts are about (comments, notices, adverts), the wrappers with most of that text lose theirs; and if nothing is
    left, all do. seen: the nodes with text."""
    fixed, n = page.inherited([m == "kind" for m in page.mark]), len(page.parent)
    soft = [m in ("class", "part") for m in page.mark]
    by = page.inherited(soft)
    seen = [ok and not fixed[e] for ok, e in zip(seen, page.at, strict=True)]
    if not any(ok and by[e] for ok, e in zip(seen, page.at, strict=True)):
        return [a or b for a, b in zip(fixed, by, strict=True)]
    mass = page.lengths(seen)
    named = [t in ("article", "main") for t in page.tag]
    in_named = page.inherited(named)
    free = sum(len(t) for t, e, ok in zip(page.texts, page.at, seen, strict=True) if ok and not by[e])
    top = max((e for e in range(1, n) if named[e] and by[page.parent[e]] and mass[e]), key=lambda e: (mass[e], -e), default=0)
    if top and mass[top] > free and not any(ok and not by[e] and in_named[e] for e, ok in zip(page.at, seen, strict=True)):
        by = list(soft)
        for e in range(1, n):
            by[e] = e != top and (by[e] or by[page.parent[e]])
    else:
        part = page.inherited([m == "part" for m in page.mark])
        rest = [ok and not part[e] for e, ok in zip(page.at, seen, strict=True)]
        own = page.lengths(rest)
        if free < (1 - HELD) * own[0]:
            by = page.inherited([x and not (m == "class" and 2 * own[e] > own[0]) for e, (x, m) in enumerate(zip(soft, page.mark, strict=True))])
        if all(by[e] for e, ok in zip(page.at, seen, strict=True) if ok):
            by = [False] * n
    return [a or b for a, b in zip(fixed, by, strict=True)]


def path_ratios(page: Page, own: list[int]) -> np.ndarray:
    """The fused value of each of the nodes own: the root of the product of its smoothed text ratio, its smoothed punctuation
    ratio and the share of the page's text that its path has."""
    paths = np.array([page.path[page.at[i]] for i in own])
    count = np.bincount(paths)
    chars = np.bincount(paths, [len(page.texts[i].strip()) for i in own])
    marks = np.bincount(paths, [len(_MARKS.findall(page.texts[i])) for i in own])
    smooth = lambda v: np.convolve(np.pad(v[paths] / count[paths], 2, mode="edge"), WINDOW, mode="valid")
    return np.sqrt(smooth(chars) * (1 + smooth(marks)) * chars[paths] / chars.sum())


def content_paths(page: Page, own: list[int], marked: list[bool]) -> set[int]:
    """The paths whose mean fused value, times MARKED if they are marked, reaches a share of the deviation of all fused
    values; the best one if none does. Where values differ, a marked path must also be the higher one by its mark's
    factor; where all are equal there is nothing to select by."""
    paths, value = np.array([page.path[page.at[i]] for i in own]), path_ratios(page, own)
    factor = np.where([marked[page.at[i]] for i in own], MARKED, 1.0)
    mean = np.bincount(paths, value * factor) / np.maximum(np.bincount(paths), 1)
    spread = value.std()
    limit = min(max(SHARE * spread, 2 * MARKED * value.max()) if spread else 0.0, mean.max())
    return {int(p) for p in np.unique(paths) if mean[p] >= limit}


def main_text(text: str | None) -> str:
    """The page's main text: white space in a block as one space, blocks in order joined by one space."""
    if not text:
        return ""
    if "<" not in text:
        return _SPACE.sub(" ", html.unescape(text)).strip()
    page = parsed(text)
    seen = [not page.gone[e] and bool(t.strip()) for t, e in zip(page.texts, page.at, strict=True)]
    own = [i for i, ok in enumerate(seen) if ok]
    marked = _weigh_marks(page, seen)
    if all(marked[page.at[i]] for i in own):
        return ""
    paths = content_paths(page, own, marked)
    content = [ok and page.path[e] in paths for ok, e in zip(seen, page.at, strict=True)]
    mass, n = page.lengths(content), len(page.parent)
    depth = [0] * n
    nearest = [0] * n  # the article or main element around each element
    for e in range(1, n):
        depth[e] = depth[page.parent[e]] + 1
        nearest[e] = e if page.tag[e] in ("article", "main") else nearest[page.parent[e]]
    deepest = lambda share, fit: max((e for e in range(1, n) if mass[e] and mass[e] >= share * mass[0] and fit(e)), key=lambda e: depth[e], default=0)
    held = lambda e: page.tag[e] not in INLINE and page.tag[e] not in LEAF
    # the smallest element with all content, else with nearly all, but no smaller than an article or main element that has it
    best = deepest(HELD, lambda e: nearest[e] == e)
    if not best:
        best = deepest(1, held)
        if page.tag[best] in ("", "html", "body"):
            best = deepest(HELD, held)
    whole = page.tag[best] in ("", "html", "body")
    chosen = [False] * n
    chosen[best] = not whole
    # content outside it: an article or main element is taken whole, other content by its path
    inside = page.inherited(chosen)
    for e, ok in zip(page.at, content, strict=True):
        if ok and not inside[e] and nearest[e]:
            chosen[nearest[e]] = True
    inside = page.inherited(chosen)
    near = {page.path_parent[p] for p in paths}
    on_path = [p in paths for p in range(len(page.path_tag))]  # a link or bold words in a paragraph are on its path
    for p in range(1, len(on_path)):
        on_path[p] = on_path[p] or page.path_tag[p] in INLINE and on_path[page.path_parent[p]]

    def stays(e: int) -> bool:
        p = page.path[e]
        if page.gone[e]:
            return False
        if on_path[p] or inside[e] and not marked[e]:
            return True
        return whole and not marked[e] and (page.path_parent[p] in near and page.tag[e] not in ("a", "li") or page.tag[e] in HEADINGS)

    parts: list[str] = []
    last = None
    for x, e, block in zip(page.texts, page.at, page.blocks, strict=True):
        if stays(e):
            if block != last:
                parts.append(" ")
            parts.append(x)
            last = block
    return _SPACE.sub(" ", "".join(parts)).strip()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), text_of(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString(), rows.schema["url"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(rows, run, f"page_id {kind[0]}, url {kind[1]}, text string, n_chars long")

"""Main text of web pages by tag-path ratios.

A page is read once into blocks: runs of text between block-level tags, each
with its root-to-leaf path of tags and classes.  Per path the mean text length
and the mean punctuation of its blocks are aggregated, smoothed along the page,
fused with the share of text outside links, and thresholded: blocks on paths
above the threshold are content and stay; short blocks in the smallest element
that holds nearly all of the content come along.  Parts that their tag, role or
class names as menu, header, footer, sidebar, notice, advert, form or comment
are left out, unless they hold the content of the page.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import text_rows

# What HTML itself says about its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the first kind ends open elements of the second kind, up to one of the third.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
P_ENDS_AT = frozenset({"td", "th", "button", "caption", "object", "html"})

#: Elements, roles and words in classes and ids that are not part of an article.
OUTSIDE_TAGS = frozenset(
    "head nav footer aside button select noscript template svg canvas object menu dialog audio video".split()
)
#: Elements that may also lie around an article.
MARKED_TAGS = frozenset({"form", "header"})
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist disqus replies reply respond discussion widget pagination pager".split()
)
HEADER_WORDS = frozenset({"header"})
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond discussion".split())
#: Words of inline elements that are no part of a sentence.
INLINE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted cookie cookies "
    "consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social disqus".split()
)
PUNCTUATION = re.compile(r"[.,;:!?…،。，；：！？、]")

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HIDDEN_STYLE = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")

#: Width of the smoothing along the page, in blocks.
SPREAD = 1.0
#: Share of the content that the article's element has to hold.
HELD = 0.8
#: A marked element is outside where the unmarked content is at least this share of its own; comments need less.
BESIDE, BESIDE_COMMENTS = 0.2, 0.02


class Element:
    __slots__ = ("tag", "label", "outside", "marks", "link", "parent", "number")

    def __init__(self, tag: str, attributes: str, parent: Element | None, number: int) -> None:
        self.tag, self.parent, self.number = tag, parent, number
        role, hidden, classes, tokens = "", False, "", []
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id"):
                    tokens += value.split()
                    classes = classes or ".".join(value.split())
                elif name == "role":
                    role = value.strip().lower()
                elif name == "hidden" or _HIDDEN_STYLE.search(value):
                    hidden = True
        self.label = f"{tag}.{classes}" if classes else tag
        page = tag in ("html", "body")
        self.outside = (parent is not None and parent.outside) or tag in OUTSIDE_TAGS or (hidden and not page)
        # What names this element as outside: (word, shortest class or id with it).
        marks: dict[str, str] = {}
        if tag in MARKED_TAGS:
            marks[tag] = tag
        if role in OUTSIDE_ROLES and not page:
            marks[f"role {role}"] = role
        if not page and tag not in ("article", "main"):
            for token in sorted(tokens, key=len):
                for word in _WORD.findall(token):
                    if word.lower() in OUTSIDE_WORDS or word.lower() in HEADER_WORDS:
                        marks.setdefault(word.lower(), token)
        self.marks = frozenset(marks.items())
        self.link = (parent is not None and parent.link) or tag == "a"

    def chain(self) -> list[Element]:
        """The elements from the root to this one."""
        found, at = [], self
        while at is not None:
            found.append(at)
            at = at.parent
        return found[::-1]


def block_level(element: Element) -> Element:
    while element.parent is not None and element.tag not in BLOCKS:
        element = element.parent
    return element


class Block:
    __slots__ = ("element", "pieces", "linked", "path", "text")

    def __init__(self, element: Element) -> None:
        self.element, self.pieces, self.linked = block_level(element), [], 0
        self.path = "/".join(e.label for e in self.element.chain() if e.tag in BLOCKS)
        self.text = ""

    def close(self) -> None:
        """Make the text, without the pieces in inline elements that are outside.

        Where nothing else is in the block, its outermost such element speaks for the block.
        """
        kept = []
        for text, element in self.pieces:
            cut, at = None, element
            while at is not self.element and at is not None:
                if at.outside or any(word in INLINE_WORDS for word, _ in at.marks):
                    cut = at
                at = at.parent
            kept.append((text, element, cut))
        if not any(cut is None and text.strip() for text, _, cut in kept):
            first = next((cut for text, _, cut in kept if cut is not None and text.strip()), None)
            self.element = first or self.element
            kept = [(text, element, None) for text, element, _ in kept]
        elif all(_marked_inline(e, self.element) for text, e, cut in kept if cut is None and text.strip()):
            self.element = next(e for text, e, cut in kept if cut is None and text.strip())
        self.text = " ".join("".join(" " if cut else text for text, _, cut in kept).split())
        self.linked = sum(len(text.strip()) for text, element, cut in kept if cut is None and element.link)


def _marked_inline(element: Element, block: Element) -> bool:
    while element is not block and element is not None:
        if element.marks:
            return True
        element = element.parent
    return False


def read_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, empty ones left out; unclosed tags end as HTML says."""
    root = Element("html", "", None, 0)
    stack, blocks, current, at, number = [root], [], None, 0, 0

    def add(text: str) -> None:
        nonlocal current
        if current is None:
            if not text.strip():
                return
            current = Block(stack[-1])
            blocks.append(current)
        current.pieces.append((text, stack[-1]))

    def close_to(depth: int) -> None:
        del stack[depth:]

    while True:
        m = _TOKEN.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text:
            add(html_lib.unescape(text) if "&" in text else text)
        if m is None:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in BLOCKS:
            current = None
        elif tag == "br":
            add(" ")
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close_to(depth)
                    break
                if stack[depth].tag in BLOCKS and tag not in BLOCKS:
                    break  # an inline end tag does not end a block
            continue
        if tag == "html":
            continue
        if tag in BLOCKS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close_to(depth)
                    break
                if stack[depth].tag in P_ENDS_AT:
                    break
        ended, limits = IMPLIED_ENDS.get(tag, ((), ()))
        if ended:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in limits:
                    break
                if stack[depth].tag in ended:
                    close_to(depth)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"(?i)</{tag}\b[^>]*>").search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "body":
            close_to(1)  # an unclosed head ends here
        number += 1
        stack.append(Element(tag, m[3], stack[-1], number))
    for block in blocks:
        block.close()
    return [b for b in blocks if b.text]


def path_scores(blocks: list[Block]) -> list[float]:
    """Fused and smoothed tag-path ratio of every block."""
    nodes, length, marks, linked = Counter(), Counter(), Counter(), Counter()
    for b in blocks:
        nodes[b.path] += 1
        length[b.path] += len(b.text)
        marks[b.path] += len(PUNCTUATION.findall(b.text))
        linked[b.path] += min(b.linked, len(b.text))
    ratio = [length[b.path] / nodes[b.path] for b in blocks]
    stops = [(1 + marks[b.path]) / nodes[b.path] for b in blocks]
    reach = math.ceil(2 * SPREAD)
    kernel = [math.exp(-(d * d) / (2 * SPREAD * SPREAD)) for d in range(reach + 1)]

    def smooth(values: list[float]) -> list[float]:
        out = []
        for i in range(len(values)):
            total = weight = 0.0
            for j in range(max(0, i - reach), min(len(values), i + reach + 1)):
                k = kernel[abs(i - j)]
                total, weight = total + k * values[j], weight + k
            out.append(total / weight)
        return out

    free = [1 - linked[b.path] / length[b.path] for b in blocks]
    return [r * math.log1p(s) * f for r, s, f in zip(smooth(ratio), smooth(stops), free)]


def content_of(blocks: list[Block]) -> list[bool]:
    """Is the tag-path score of a block above the threshold of the page?"""
    scores = path_scores(blocks)
    mean = sum(scores) / len(scores)
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    threshold = max(mean - spread, 0.0)
    return [s >= threshold and s > 0 for s in scores]


def unmarked(blocks: list[Block]) -> list[Block]:
    """The blocks that no marked element holds, after the marks around the content are lifted.

    A mark is lifted where the content below it outweighs what is unmarked: such
    an element lies around the article, or is a part of it.  Marks are lifted
    for all elements that bear them, the heaviest first.
    """
    marked = []
    for b in blocks:
        chain = [e for e in b.element.chain() if e.marks]
        if b.element.tag in HEADINGS:
            chain = [e for e in chain if any(word not in HEADER_WORDS for word, _ in e.marks)]
        marked.append(chain)
    # Nothing is marked, or marks are weighed by the text of content blocks outside links.
    weight = [max(len(b.text) - b.linked, 0) if c else 0 for b, c in zip(blocks, content_of(blocks))]
    lifted: set[tuple[str, str]] = set()
    first = [0] * len(blocks)
    while True:
        rest, own, titled = 0, Counter(), set()
        for i, (b, chain) in enumerate(zip(blocks, marked)):
            while first[i] < len(chain) and chain[first[i]].marks <= lifted:
                first[i] += 1
            if first[i] == len(chain):
                rest += weight[i]
                continue
            marks = chain[first[i]].marks - lifted
            own[marks] += weight[i]
            # An article, main part or title that no further mark sets apart.
            at, only = b.element, all(e.marks - lifted <= marks for e in chain[first[i]:])
            while only and at is not chain[first[i]]:
                if at.tag in ("article", "main", "h1"):
                    titled.add(marks)
                at = at.parent
        for marks, held in sorted(own.items(), key=lambda kv: (-kv[1], sorted(kv[0]))):
            words = {word for word, _ in marks}
            share = 1.0 if marks in titled else BESIDE_COMMENTS if words & COMMENT_WORDS else BESIDE
            if held > 0 and rest < share * held:
                lifted |= marks
                break
        else:
            return [b for b, chain, at in zip(blocks, marked, first) if at == len(chain)]


def article_blocks(blocks: list[Block]) -> list[Block]:
    inside = [b for b in blocks if not b.element.outside]
    inside = unmarked(inside) if inside else inside
    if not inside:
        return []
    chosen = content_of(inside)
    content = [b for b, c in zip(inside, chosen) if c] or inside
    # Text of the content under each element, from the deepest element up.
    weight: Counter = Counter()
    elements: dict[int, Element] = {}
    depth: dict[int, int] = {}
    for b in content:
        for level, e in enumerate(b.element.chain()):
            weight[e.number] += len(b.text)
            elements[e.number], depth[e.number] = e, level
    total = sum(len(b.text) for b in content)
    named = [n for n in weight if elements[n].tag in ("article", "main") and weight[n] * 2 >= total]
    held = named or [n for n in weight if weight[n] >= HELD * total]
    article = max(held, key=lambda n: (depth[n], weight[n], -n))
    if elements[article].tag in HEADINGS or elements[article].tag not in BLOCKS or elements[article].tag == "p":
        # One paragraph holds nearly everything: its neighbours belong to it.
        at = elements[article]
        while at.parent is not None and (at.tag not in BLOCKS or at.tag == "p" or at.tag in HEADINGS):
            at = at.parent
        article = at.number

    def added(b: Block) -> bool:
        """Short blocks beside the content, in its element, come along; lists of links do not."""
        if not named and b.element.tag != "h1" and 2 * min(b.linked, len(b.text)) > len(b.text):
            return False
        return any(e.number == article for e in b.element.chain())

    return [b for b, c in zip(inside, chosen) if c or added(b)]


def main_text(page: str) -> str:
    """The article of a page: blocks with single blanks, joined by an empty line; empty if there is none."""
    return "\n\n".join(b.text for b in article_blocks(read_blocks(page)))


def extract_batches(batches: Iterator[pd.DataFrame]):
    for batch in batches:
        yield pd.DataFrame({
            "page_id": batch["page_id"], "url": batch["url"], "text": [main_text(h or "") for h in batch["html"]],
        })


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points of the text).

    Null or empty pages, and pages without an article, have the empty text.
    Whole pages are read, of any length.  Repeated rows give a row each; an
    empty table gives no rows; other columns are not read.
    """
    kind = dict(pages.dtypes)[id_col]
    return text_rows(pages).select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    ).mapInPandas(extract_batches, f"page_id {kind}, url string, text string").select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )

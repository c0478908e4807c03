"""HTML extraction by tag-path ratios.

A page is cut into blocks of text in page order.  Blocks with the same root-to-leaf tag path are
one group: its text length outside links and its punctuation, each for one block, are smoothed over the
paths' page order, fused into one ratio and thresholded.  The element that holds the blocks of the
chosen paths is the content; its short blocks belong to it as well, whatever their path's ratio.
Subtrees that mark themselves as boilerplate (by tag, role, class or id) don't count, however long they are, as long as
there is prose beside them: prose in the sense of the ratios, text outside links with punctuation.  A mark is taken
back where the element holds an article or main element, or where nothing else on the page is prose; a weak mark
(a form, a header, a name of which only a part is a known one) also where it holds most of the page's prose.
Hidden subtrees never count.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# HTML element classes.
RAW = "script style textarea title noscript iframe template svg object xmp noframes select".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split()
)
BOILERPLATE = frozenset("head nav header footer aside form button fieldset menu dialog".split())
#: Elements of the article itself may be called header; inside one of these a header is its own heading.
CONTENT = frozenset("article main".split())
#: An open element that the start of the other closes.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
NAMES = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer "
    "header masthead menu menubar nav navbar navigation newsletter notice notices notification popup promo promotion related reply replies respond share "
    "sharing sidebar sidebars signup social sponsor sponsored subscribe subscription toolbar widget widgets alert modal paywall login search".split()
)
#: Beside one of these in a class or id, the name of a boilerplate tells what the element has or lacks, not what it is.
PLAIN = frozenset("article articles body container content entry has main no page post posts story text with without wrapper wrap layout title".split())
#: Parts of a name that tell a boilerplate's shape or place.
SHAPES = frozenset("area bar block bottom box column feed group holder inner item items left link links list module outer panel right row section slot strip top unit zone".split())
#: Tags that often hold a whole page, or the article's own heading.
WEAK = frozenset("form fieldset header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")(?=[\s/>])[^>]*+>.*?(?:</\1\s*+>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?|([^<]++|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?、。，！？؟،।]")


def _attributes(text: str) -> dict[str, str]:
    """Names and values in lower case; of a repeated name the first."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return found


def _name_weight(token: str) -> int:
    """2 for a class or id of boilerplate names, with or without shapes; 1 if only a part is such a name; else 0."""
    parts = {x for x in re.split(r"[-_]+", token) if x}
    if token in NAMES or parts & NAMES and parts <= NAMES | SHAPES:
        return 2
    return int(bool(parts & NAMES) and not parts & PLAIN)


def _is_hidden(tag: str, found: dict[str, str]) -> bool:
    return tag == "head" or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")


def _mark(tag: str, found: dict[str, str], in_content: bool) -> int:
    """How strongly an element marks itself as boilerplate: 2, 1 (weakly) or 0."""
    own = 0 if tag not in BOILERPLATE or tag == "header" and in_content else 1 if tag in WEAK else 2
    if own == 2 or found.get("role") in ROLES:
        return 2
    if tag in ("html", "body", "article", "main"):
        return own
    names = {x for c in ("class", "id") for x in found.get(c, "").split()}
    weight = max([0, *[_name_weight(x) for x in names if not (in_content and x == "header")]])
    # Inside an article a name in part is more likely the article's own.
    return max(own, 0 if in_content and weight == 1 else weight)


@dataclass
class Block:
    """A run of text: its element, the element's tag path as a number, its text, and its characters inside links."""

    node: int
    path: int
    text: str
    linked: int


@dataclass
class Page:
    """Blocks in page order, and of each block element its parent, tag, depth and whether it stands in an article or main."""

    blocks: list[Block]
    parent: list[int]
    tag: list[str]
    depth: list[int]
    in_content: list[bool]


def blocks(page: str) -> Page:
    """The blocks of a page; elements are known by number and parent, so the work grows with the page alone."""
    out, text, linked = [], [], 0
    # Elements by number, 0 above all: parent, parent among block elements, tag, depth among those, in an article or main, marked.
    parent, above, tags, depth, in_content, marked = [0], [0], [""], [0], [False], [0]
    paths: dict[tuple[int, str], int] = {}  # tag paths, as a path and a tag below it
    path_of = [0]
    around: list[int] = []  # of each block the element it ended in, inline ones too
    holding = [False]
    stack: list[tuple[int, str, bool, bool]] = []  # element, tag, hidden, in a link
    opened: dict[str, int] = defaultdict(int)

    def flush():
        nonlocal linked
        words = html.unescape("".join(text)).split()
        if words and not (stack and stack[-1][2]):
            here = stack[-1][0] if stack else 0
            node = here if here == 0 or tags[here] not in INLINE else above[here]
            out.append(Block(node, path_of[node], " ".join(words), linked))
            around.append(here)
        text.clear()
        linked = 0

    def shut(at):
        for x in stack[at:]:
            opened[x[1]] -= 1
        del stack[at:]

    for m in _TOKEN.finditer(page):
        if m[8] is not None:
            if not (stack and stack[-1][2]):
                text.append(m[8])
                if stack and stack[-1][3]:
                    linked += len(m[8])
            continue
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if tag == "br" or tag == "img":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if m[2] or m[5]:
            if opened[tag]:
                at = len(stack) - 1
                # An inline element's end doesn't reach beyond the block it stands in.
                while stack[at][1] != tag and not (tag in INLINE and stack[at][1] not in INLINE):
                    at -= 1
                if stack[at][1] == tag:
                    shut(at)
            continue
        if tag not in INLINE:
            # A block ends what can't hold it: an open paragraph or heading, or an item of its own kind.
            while stack and (stack[-1][1] in INLINE or stack[-1][1] == "p" or tag in CLOSED_BY.get(stack[-1][1], ())):
                shut(len(stack) - 1)
        found = _attributes(m[4] or m[7] or "")
        top = stack[-1] if stack else (0, "", False, False)
        hidden = top[2] or _is_hidden(tag, found)
        holder = top[0] if tags[top[0]] not in INLINE else above[top[0]]
        number = len(parent)
        parent.append(top[0])
        above.append(holder)
        tags.append(tag)
        block = tag not in INLINE
        depth.append(depth[holder] + block)
        path_of.append(paths.setdefault((path_of[holder], tag), len(paths) + 1) if block else path_of[holder])
        marked.append(_mark(tag, found, in_content[top[0]]))
        in_content.append(in_content[top[0]] or tag in CONTENT)
        holding.append(tag in CONTENT and not hidden)
        if not (m[4] or "").endswith("/") or tag in INLINE:
            stack.append((number, tag, hidden, top[3] or tag == "a"))
            opened[tag] += 1
    flush()
    for x in range(len(parent) - 1, 0, -1):  # children come after their parents
        if holding[x]:
            holding[parent[x]] = True
            marked[x] *= tags[x] in CONTENT
    gone = _boilerplate(parent, marked, [_prose(b) for b in out], around)
    return Page([b for b, x in zip(out, around, strict=True) if not gone[x]], above, tags, depth, in_content)


def _prose(b: Block) -> int:
    """Characters of a block that read like prose: outside links, with punctuation or of some length."""
    own = len(b.text) - b.linked
    return own if 2 * b.linked < len(b.text) and (own >= 20 and _PUNCTUATION.search(b.text) or own >= 60) else 0


def _boilerplate(parent: list[int], marked: list[int], prose: list[int], around: list[int]) -> list[bool]:
    """Which elements stand in a marked one, after marks were taken back where they hold the page's prose."""
    marked = list(marked)
    while True:
        # The innermost mark around each element, and how much prose stands right below each mark (0: below none).
        mark = [0] * len(parent)
        for x in range(1, len(parent)):
            mark[x] = x if marked[x] else mark[parent[x]]
        below = [0] * len(parent)
        for n, x in zip(prose, around, strict=True):
            below[mark[x]] += n
        best = max((x for x in range(1, len(parent)) if marked[x]), key=lambda x: below[x], default=0)
        weak = max((x for x in range(1, len(parent)) if marked[x] == 1), key=lambda x: below[x], default=0)
        if best and below[best] and not below[0]:
            x = best
        elif weak and below[weak] > 2 * below[0]:
            x = weak
        else:
            return [bool(m) for m in mark]
        while x:
            marked[x] = 0
            x = parent[x]


def _smooth(x: np.ndarray, radius: int = 1) -> np.ndarray:
    """Gaussian smoothing over neighbouring paths."""
    weights = np.exp(-0.5 * np.arange(-radius, radius + 1) ** 2.0)
    total = np.convolve(np.ones(len(x)), weights, "same") if len(x) > 2 * radius else None
    return x if total is None else np.convolve(x, weights, "same") / total


def chosen_blocks(found: list[Block], spread: float = 0.5) -> list[int]:
    """Blocks of the paths whose fused ratio reaches ``spread`` standard deviations, or the largest one."""
    groups = defaultdict(list)  # in order of first appearance
    for i, b in enumerate(found):
        groups[b.path].append(i)
    length = np.array([sum(max(0, len(found[i].text) - found[i].linked) for i in g) / len(g) for g in groups.values()])
    marks = np.array([sum(len(_PUNCTUATION.findall(found[i].text)) * (found[i].linked < len(found[i].text) / 2) for i in g) / len(g) for g in groups.values()])
    fused = _smooth(length) * (1 + _smooth(marks))
    fused[length == 0] = 0
    chosen = fused >= min(spread * fused.std() + 1e-9, fused.max()) if len(fused) > 1 else fused >= 0
    return [i for g, on in zip(groups.values(), chosen, strict=True) if on for i in g]


def extract(page: str | None, spread: float = 0.5) -> str:
    """Main text of one page: blocks joined by an empty line; null, empty or textless pages give ``""``."""
    tree = blocks(page or "")
    found = tree.blocks
    if not found:
        return ""
    content = chosen_blocks(found, spread)
    # Where some of the chosen blocks stand in an article or main element, that element is the content.
    marked = [i for i in content if tree.in_content[found[i].node]]
    content = marked or content
    # The innermost element around all of them.
    first = holder = found[content[0]].node
    below = {first}  # elements known to stand in it
    for i in content:
        other = found[i].node
        while other not in below:
            below.add(other)
            if tree.depth[other] <= tree.depth[holder]:
                holder = tree.parent[holder]
                below.add(holder)
            if tree.depth[other] > tree.depth[holder]:
                other = tree.parent[other]
    if marked:
        while holder and not (tree.tag[holder] in CONTENT or tree.in_content[holder]):
            holder = tree.parent[holder]
        inner = first
        while inner and tree.tag[inner] not in CONTENT:
            inner = tree.parent[inner]
        holder = min(holder, inner) if holder else holder
    elif holder == first:
        holder = tree.parent[holder]
    picked = set(content)
    if holder and tree.tag[holder] not in ("html", "body"):
        inside = [False] * len(tree.parent)
        for x in range(1, len(inside)):
            inside[x] = x == holder or inside[tree.parent[x]]
        picked.update(i for i, b in enumerate(found) if inside[b.node])
    else:
        # Nothing narrower than the body holds the content: it lasts from its first to its last chosen block, links apart, with
        # the headings right before.
        picked.update(i for i in range(min(content), max(content)) if 2 * found[i].linked < len(found[i].text))
        for i in range(len(found) - 2, -1, -1):
            if i + 1 in picked and re.fullmatch("h[1-6]", tree.tag[found[i].node]):
                picked.add(i)
    return "\n\n".join(found[i].text for i in sorted(picked))


def extract_pages(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` with ``text`` in place of the html column and n_chars (its code points, long) added.

    Every row gives one row, repeated rows too; null, empty and textless html give empty text.  Columns
    named text or n_chars are replaced.
    """
    kept = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    plain = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html_column}`").alias("text"))

    def run(batches):
        for batch in batches:
            texts = [extract(s.as_py()) for s in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*kept, "text", "n_chars"])

    schema = T.StructType([*plain.schema.fields, T.StructField("n_chars", T.LongType())])
    return plain.mapInArrow(run, schema)

"""Main text of web pages by composite text density.

Every node of the page's tree gets its characters per tag, lowered where many of them are links. A node's density sum
adds the densities of its children, and the node with the largest sum is where the text is. The least density on the way
from there up to the body is the threshold: under every node that reaches it the subtree with the largest sum is main
text.

What an element or a name says about a block only changes its weight. Text of menus, footers, sidebars, forms and page
headers counts as text of links, so its density is 0; a block with a telling name has LOWERED of its density. Only what
is no text at all (scripts, styles, controls, pictures) is cut from the tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, empty_text

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
#: A start tag of the key ends an open element of the value, up to an element that bounds it.
ENDS = {x: frozenset(["p"]) for x in BLOCK - {"body", "html", "tbody", "tfoot", "thead", "tr"}} | {
    "li": frozenset(["p", "li"]),
    "dt": frozenset(["p", "dt", "dd"]),
    "dd": frozenset(["p", "dt", "dd"]),
    "option": frozenset(["option"]),
    "tr": frozenset(["p", "tr", "td", "th"]),
    "td": frozenset(["p", "td", "th"]),
    "th": frozenset(["p", "td", "th"]),
    "tbody": frozenset(["p", "tr", "td", "th", "tbody", "thead", "tfoot"]),
    "tfoot": frozenset(["p", "tr", "td", "th", "tbody", "thead", "tfoot"]),
    "body": frozenset(["p", "head"]),
}
BOUNDS = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])} | {x: frozenset(["table"]) for x in ("tr", "td", "th", "tbody", "tfoot")}
SCOPE = frozenset("html body table td th button article section div".split())
#: Elements that hold no text of the page.
NEVER = frozenset("script style noscript template head title button select textarea iframe noembed noframes object svg math canvas audio video".split())
#: Elements whose text counts as that of links; a header only outside articles.
ASIDE = frozenset("nav footer aside form dialog menu search header".split())
MAIN = frozenset(["article", "main"])
#: Names in a class, id or role that tell what is not main text, alone or with PLAIN words beside them.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie "
    "cookies discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo "
    "promoted promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
PLAIN = frozenset(
    "area article bar block body bottom box buttons center column container content entry form group holder inner item items left links list "
    "main outer page panel post posts right row section site slot text top unit wrap wrapper".split()
)
HEADERS = frozenset("header site-header page-header main-header top-header".split())
NAMED = BLOCK - MAIN - frozenset("html body h1 h2 h3 h4 h5 h6".split())
LOWERED = 0.002

TAG = re.compile(r"""<(/?)([a-zA-Z][^\t\n\f\r />]*+)((?:[^>=]++|=[\t\n\f\r ]*+(?:"[^"]*+"|'[^']*+'|))*+)>""")
#: A tag whose quotes do not end.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\t\n\f\r />]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
COMMENT_END = re.compile(r"--!?>")
#: A tag that the page ends in.
UNENDED = re.compile(r"<[a-zA-Z/!][^<>]*\Z")
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {x: re.compile(rf"</{x}(?=[\t\n\f\r />])", re.IGNORECASE) for x in RAW}


def telling(attributes: str) -> bool:
    """Whether a class, id or role names what is not main text: every word of one of its names is in NAMES or PLAIN."""
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for own in "".join(values).split():
                words = {w.lower() for w in PIECE.findall(own)}
                if own.lower() in HEADERS or not NAMES.isdisjoint(words) and words <= NAMES | PLAIN:
                    return True
    return False


class Tree:
    """A page's nodes in page order: tag and parent of each, whether its names are telling, and its texts (node, text,
    last node begun). Reading takes time in proportion to the page: open elements are found by their name."""

    def __init__(self, html: str):
        self.tags, self.parents, self.marked, self.texts = ["#"], [-1], [False], []
        self.open = [0]
        self.places: dict[str, list[int]] = {}  # of each name and of all blocks ("") where they are in self.open
        self.read(UNENDED.sub("", html))

    def read(self, html: str) -> None:
        at, tag_of = 0, TAG
        last_end = html.rfind(">")
        held: list[str] = []  # text since the last tag

        def flush() -> None:
            if held:
                self.texts.append((self.open[-1], "".join(held), len(self.tags) - 1))
                held.clear()

        while (lt := html.find("<", at)) >= 0 and lt < last_end:
            if at < lt:
                held.append(unescape(html[at:lt]))
            if html.startswith("<!--", lt):
                found = COMMENT_END.search(html, lt + 2)
                at = found.end() if found else len(html)
            elif html.startswith(("<!", "<?", "</"), lt) and not html[lt + 2 : lt + 3].isalpha() or html.startswith("<!", lt):
                at = html.index(">", lt) + 1
            elif not (html[lt + 1 : lt + 2].isascii() and html[lt + 1 : lt + 2].isalpha()) and not html.startswith("</", lt):
                held.append("<")
                at = lt + 1
            else:
                found = tag_of.match(html, lt)
                if not found:  # quotes that end nowhere: from here on they mean nothing
                    tag_of = PLAIN_TAG
                    found = tag_of.match(html, lt)
                if not found:  # no name after all
                    at = html.index(">", lt) + 1
                    continue
                at, tag = found.end(), found[2].lower()
                flush()
                if found[1]:
                    self.end(tag)
                    continue
                self.start(tag, found[3])
                if tag in RAW:
                    ending = RAW_END[tag].search(html, at)
                    at = ending.start() if ending else len(html)
        held.append(unescape(html[at:]))
        flush()

    def pop_to(self, place: int) -> None:
        """Ends the open elements from a place on."""
        for i in self.open[place:]:
            self.places[self.tags[i]].pop()
            if self.tags[i] in BLOCK:
                self.places[""].pop()
        del self.open[place:]

    def top(self, names: frozenset[str] | set[str]) -> int:
        return max((x[-1] for n in names if (x := self.places.get(n))), default=0)

    def start(self, tag: str, attributes: str) -> None:
        if tag in ENDS:
            ends, bound = ENDS[tag], self.top(BOUNDS.get(tag, SCOPE) - ENDS[tag])
            if len(ends) == 1:
                place = self.top(ends)
                if place > bound:
                    self.pop_to(place)
            else:
                while (place := self.top(ends)) > bound:
                    self.pop_to(place)
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.marked.append(bool(attributes) and tag in NAMED and telling(attributes))
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            if tag in BLOCK:
                self.places.setdefault("", []).append(len(self.open))
            self.open.append(len(self.tags) - 1)

    def end(self, tag: str) -> None:
        place = self.top({tag})
        if place and (tag in BLOCK or place > self.top({""})):  # an inline element does not end beyond its block
            self.pop_to(place)


class Weights:
    """For each node whether it is cut, whether its text counts as that of links, and the factor of its density."""

    def __init__(self, tree: Tree, names: bool = True):
        tags, parents, n = tree.tags, tree.parents, len(tree.tags)
        holds = [t in MAIN for t in tags]
        for i in range(n - 1, 0, -1):
            holds[parents[i]] |= holds[i]
        inside = [False] * n
        for i in range(1, n):
            inside[i] = inside[parents[i]] or tags[i] in MAIN
        self.cut, self.linked, self.named, self.factor = [False] * n, [False] * n, [False] * n, [1.0] * n
        for spared in (False, True):  # what holds the only articles of the page says nothing about them
            for i in range(1, n):
                up, tag = parents[i], tags[i]
                whole = spared and holds[i]
                self.cut[i] = self.cut[up] or tag in NEVER and not holds[i]
                aside = tag in ASIDE and not (tag == "header" and inside[i]) and (names or tag != "form")
                self.linked[i] = self.linked[up] or aside and not whole
                self.named[i] = self.named[up] or names and tree.marked[i] and not whole
                self.factor[i] = LOWERED if self.named[i] else 1.0
            if any(t in MAIN and not (self.linked[i] or self.named[i] or self.cut[i]) for i, t in enumerate(tags)):
                break
        self.anything = any(not (self.cut[i] or self.linked[i]) and t.strip() for i, t, _ in tree.texts)


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag times how far the text is from being links, on a logarithm whose base grows with links.

    share: of the page's characters those in links.
    """
    if not chars:
        return 0.0
    t, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = log(chars * lc / max(1, chars - link_chars) + share * chars + e)
    return chars / t * log(max(1.0, chars / lc * t / lt)) / log(base)


def main_nodes(tree: Tree, weights: Weights, block: list[int]) -> list[bool]:
    """For each node whether it belongs to the main text.

    Blocks are the nodes that count. Inline elements are tags of their block, and a block's text outside its inner blocks
    counts as one more child, so that a paragraph weighs the same with and without emphasis in it. Inside the main text a
    block of links stays, unless its element or its name put it aside and its weight is below that of the main subtree.
    """
    n, parents, cut, aside = len(tree.tags), tree.parents, weights.cut, weights.linked
    own = [[0, 0, 0, 0] for _ in range(n)]  # characters, tags, characters in links, links of a block's own text
    linked = [False] * n
    for i in range(1, n):
        linked[i] = tree.tags[i] == "a" or linked[parents[i]] or aside[i]
        if block[i] != i and not cut[i]:
            own[block[i]][1] += 1
            own[block[i]][3] += tree.tags[i] == "a" or aside[i]
    for i, text, _ in tree.texts:
        if not cut[i]:
            size = len(" ".join(text.split()))
            own[block[i]][0] += size
            own[block[i]][2] += size * linked[i]
    outer = [0] + [block[parents[i]] for i in range(1, n)]
    total = [list(x) for x in own]
    blocks = [i for i in range(1, n) if block[i] == i and not cut[i]]
    for i in reversed(blocks):
        up, mine = total[outer[i]], total[i]
        for k in range(4):
            up[k] += mine[k]
        up[1] += 1
        up[3] += aside[i]
    top = next((i for i in blocks if tree.tags[i] == "body"), 0)
    share = total[top][2] / max(1, total[top][0])
    plain = {i: density(*total[i], share) for i in (0, *blocks)}
    dense = {i: d * weights.factor[i] for i, d in plain.items()}
    sums = {i: density(*own[i], share) * weights.factor[i] for i in (0, *blocks)}
    for i in blocks:
        sums[outer[i]] += dense[i]
    best = {i: i for i in (0, *blocks)}
    for i in reversed(blocks):
        if (sums[best[i]], -best[i]) > (sums[best[outer[i]]], -best[outer[i]]):
            best[outer[i]] = best[i]
    i = most = best[top]
    around = {most}
    least = dense[i]
    while i != top and i:
        i = outer[i]
        around.add(i)
        least = min(least, dense[i])
    chosen, dropped = [False] * n, [False] * n
    reached = {top}
    for i in (0, *blocks):
        if (aside[i] or weights.named[i]) and i not in around and not (weights.named[most] or aside[most]):
            dropped[i] = aside[i] or LOWERED * plain[i] < plain[most] or not plain[i]
        if i == top or outer[i] in reached and i:
            reached.add(i)
            if total[i][0] and dense[i] >= least:
                chosen[best[i]] = True
    for i in range(1, n):
        dropped[i] |= dropped[parents[i]]
        chosen[i] = not cut[i] and not dropped[i] and (chosen[i] or chosen[parents[i]])
    return chosen


def extract(html: str | None) -> str:
    """The main text: blocks with single spaces, in page order, joined by two line ends."""
    if not html:
        return ""
    tree = Tree(html)
    weights = Weights(tree)
    if not weights.anything:  # all of the page is in a form
        weights = Weights(tree, names=False)
        if not weights.anything:
            return ""
    block = [0] * len(tree.tags)  # the nearest block element at or above each node
    for i in range(1, len(tree.tags)):
        block[i] = i if tree.tags[i] in BLOCK else block[tree.parents[i]]
    chosen = main_nodes(tree, weights, block)
    blocks: list[str] = []
    parts: list[str] = []
    begun, last = 0, 0

    def flush() -> None:
        if text := " ".join("".join(parts).split()):
            blocks.append(text)
        parts.clear()

    for node, text, seen in tree.texts:
        for i in range(begun + 1, seen + 1):  # what began since the text before
            if tree.tags[i] in BLOCK:
                flush()
            elif tree.tags[i] in ("br", "td", "th"):
                parts.append(" ")
        if block[node] != last:
            flush()
        begun, last = seen, block[node]
        if chosen[node]:
            parts.append(text)
    flush()
    return "\n\n".join(blocks)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if there is none) and n_chars of every row, from the whole html.

    A null html counts as empty. Repeated rows stay repeated; columns other than page_id, url and html are not looked at;
    an empty table gives an empty result.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = [extract(h) for h in empty_text(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(kernel, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")

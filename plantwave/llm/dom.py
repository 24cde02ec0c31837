"""Web pages as trees of blocks with their text runs, and block features over whole batches.

A page is read leniently, as browsers do: unclosed and stray tags, unfinished tags at the end, unquoted
attributes.  Formatting tags (`b`, `a`, `span`, …) make no block of their own; the names they carry count for the
block of their text.  A run is the text between two block borders: character references decoded, white space made one
space, trimmed.
"""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass, field

import numpy as np

# --- fixed values of HTML ---
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span "
                 "strike strong sub sup time tt u var".split())
MATH = set("math maction annotation annotation-xml menclose merror mfenced mfrac mglyph mi mlabeledtr mmultiscripts mn mo mover "
           "mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder "
           "munderover none semantics".split())
FORMATTING |= MATH
ENDS_PARAGRAPH = set("address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 "
                     "h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th", "tbody"},
          "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
SCOPE = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "body", "html", "menu", "nav"}
TEXT_BLOCKS = set("p li h1 h2 h3 h4 h5 h6 td th dt dd blockquote pre figcaption caption summary title button option label".split())
CONTROLS = {"input", "button", "select", "textarea"}

_RUN = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)"
    rf"|<svg(?=[\s/>]){_RUN}(?<=/)>"
    r"|<(script|style|template|svg|iframe|noscript|textarea|select|object|canvas|audio|video)(?=[\s/>]|\Z)"
    rf"{_RUN}(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_RUN})(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])([^\s=\"'>/]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))")
_NAMING = {"class", "id", "role", "itemprop", "aria-label"}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Nodes:
    """Blocks of many pages, in document order; a page starts with a root block."""
    tag: list[str] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    sibling: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    link_chars: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)
    page: list[int] = field(default_factory=list)
    roots: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)


def _tokens(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = []
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() not in _NAMING:
            continue
        value = m[2] or m[3] or m[4] or ""
        found += [w.lower() for w in _WORD.findall(value)]
    return tuple(dict.fromkeys(found))


def add_page(nodes: Nodes, html: str | None) -> None:
    """Append the blocks and runs of one page."""
    html, page = html or "", len(nodes.roots)
    children: list[int] = []

    def block(tag, tokens, parent):
        at = len(nodes.tag)
        nodes.tag.append(tag), nodes.tokens.append(tokens), nodes.parent.append(parent), nodes.page.append(page)
        nodes.depth.append(nodes.depth[parent] + 1 if parent >= 0 else 0)
        nodes.sibling.append(children[parent - root] if parent >= 0 else 0)
        if parent >= 0:
            children[parent - root] += 1
        children.append(0)
        for column in (nodes.end, nodes.chars, nodes.link_chars, nodes.words, nodes.stops, nodes.controls):
            column.append(0)
        return at

    root = len(nodes.tag)
    nodes.roots.append(root)
    stack = [block("#root", (), -1)]
    parts: list[str] = []
    inline: list[tuple[str, tuple[str, ...]]] = []
    named: dict[str, None] = {}
    links = linked = told = 0

    def flush():
        nonlocal linked, told
        if not parts:
            return
        words = "".join(parts).split()
        names = dict(named)
        parts.clear(), named.clear()
        linked, told, in_links = 0, 0, linked
        if not words:
            return
        text = " ".join(words)
        at = stack[-1]
        if nodes.tag[at] not in TEXT_BLOCKS:
            at = block("#run", (), at)
            nodes.end[at] = at + 1
        if names:
            nodes.tokens[at] = tuple(dict.fromkeys([*nodes.tokens[at], *names]))
        nodes.runs.append((at, text))
        nodes.chars[at] += len(text)
        nodes.link_chars[at] += min(in_links, len(text))
        nodes.words[at] += len(words)
        nodes.stops[at] += text.count(".") + text.count(",") + text.count("!") + text.count("?")

    def close(down_to: int):
        nonlocal links, told
        flush()
        links = told = 0
        inline.clear()
        while len(stack) > down_to:
            nodes.end[stack.pop()] = len(nodes.tag)

    def say(raw: str):
        nonlocal linked, told
        if "&" in raw:
            raw = references.unescape(raw)
        parts.append(raw)
        if len(inline) > told and not raw.isspace():
            named.update(dict.fromkeys(t for _, tokens in inline[told:] for t in tokens))
            told = len(inline)
        if links:
            linked += len(raw)

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            say(html[at:m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] and m[1].lower() in ("textarea", "select"):
                nodes.controls[stack[-1]] += 1
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in FORMATTING:
                for k in range(len(inline) - 1, -1, -1):
                    if inline[k][0] == tag:
                        del inline[k]
                        told -= k < told
                        break
                continue
            if tag in ("br", "p") and tag not in [nodes.tag[i] for i in stack[-3:]]:
                parts.append(" ")
            for k in range(len(stack) - 1, 0, -1):
                if nodes.tag[stack[k]] == tag:
                    close(k)
                    break
            continue
        tokens = _tokens(m[4])
        if tag in VOID:
            if tag == "input":
                nodes.controls[stack[-1]] += 1
            if tag in ("br", "hr"):
                parts.append(" ")
            continue
        if tag in FORMATTING:
            links += tag == "a"
            if tokens:
                inline.append((tag, tokens))
            continue
        if tag in ENDS_PARAGRAPH:
            for k in range(len(stack) - 1, 0, -1):
                if nodes.tag[stack[k]] == "p":
                    close(k)
                break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if nodes.tag[stack[k]] in CLOSES[tag]:
                    close(k)
                    break
                if nodes.tag[stack[k]] in SCOPE:
                    break
        if tag in ("html", "body") and any(nodes.tag[i] == tag for i in stack):
            continue
        flush()
        new = block(tag, tokens, stack[-1])
        stack.append(new)
        nodes.controls[new] += tag in CONTROLS
    if at < len(html):
        say(html[at:])
    close(0)


def read_pages(pages: list[str | None]) -> Nodes:
    nodes = Nodes()
    for html in pages:
        add_page(nodes, html)
    return nodes


NAMES = ["tag", "worst_token", "best_token", "tokens", "worst_tag_above", "worst_token_above", "best_above", "depth",
         "sibling", "siblings", "children", "chars", "link_share", "density", "words_a_run", "stops_a_word", "controls",
         "share_of_parent", "share_of_page", "start", "own_chars", "items", "paragraphs", "before", "after"]


def features(nodes: Nodes, tags: dict[str, float], tokens: dict[str, float]) -> np.ndarray:
    """One row per block: NAMES.  `tags` and `tokens` are learned log odds."""
    n = len(nodes.tag)
    if not n:
        return np.zeros((0, len(NAMES)))
    parent, end = np.array(nodes.parent), np.array(nodes.end)
    depth, sibling, page = np.array(nodes.depth), np.array(nodes.sibling), np.array(nodes.page)
    own = np.arange(n)
    up = np.where(parent < 0, own, parent)

    def under(values):
        total = np.concatenate([[0], np.cumsum(values)])
        return total[end] - total[own]

    chars, words = np.array(nodes.chars), np.array(nodes.words)
    tag = np.array([tags.get(t, 0.0) for t in nodes.tag])
    known = [[tokens[w] for w in ws if w in tokens] for ws in nodes.tokens]
    worst = np.array([min(k, default=0.0) for k in known])
    best = np.array([max(k, default=0.0) for k in known])
    above = np.stack([np.minimum(tag, 0), np.minimum(worst, 0), np.maximum(best, 0)])
    order = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    for d in range(1, len(edges) - 1):
        at = order[edges[d]:edges[d + 1]]
        above[:2, at] = np.minimum(above[:2, at], above[:2, up[at]])
        above[2, at] = np.maximum(above[2, at], above[2, up[at]])
    children = np.bincount(up[parent >= 0], minlength=n)
    sub_chars = under(chars)
    runs = under((chars > 0).astype(np.int64))
    roots = np.array(nodes.roots)
    page_chars = sub_chars[roots][page]
    passed = np.concatenate([[0], np.cumsum(chars)])[own] - np.concatenate([[0], np.cumsum(chars)])[roots][page]
    kinds = np.array([t == "li" for t in nodes.tag]), np.array([t == "p" for t in nodes.tag])
    # text of the neighbours among siblings
    by = np.lexsort((sibling, up))
    same = (up[by][1:] == up[by][:-1]) & (parent[by][1:] >= 0)
    before, after = np.zeros(n), np.zeros(n)
    before[by[1:]] = np.where(same, sub_chars[by[:-1]], 0)
    after[by[:-1]] = np.where(same, sub_chars[by[1:]], 0)
    over = lambda a, b: a / np.maximum(b, 1)
    sizes = end - own
    return np.stack([
        tag, worst, best, np.array([len(w) for w in nodes.tokens]), above[0], above[1], above[2],
        np.minimum(depth, 30), np.minimum(sibling, 50), np.minimum(children[up], 50), np.minimum(children, 50),
        np.log1p(sub_chars), over(under(np.array(nodes.link_chars)), sub_chars), np.log1p(over(sub_chars, sizes)),
        over(under(words), runs), over(under(np.array(nodes.stops)), under(words)), over(under(np.array(nodes.controls)), sizes),
        over(sub_chars, sub_chars[up]), over(sub_chars, page_chars), over(passed, page_chars), np.log1p(chars),
        over(under(kinds[0]), sizes), over(under(kinds[1]), sizes), np.log1p(before), np.log1p(after)], axis=1)


def decode(nodes: Nodes, margin: np.ndarray) -> np.ndarray:
    """The consistent choice of largest total margin: a block is kept only if its parent is.

    A subtree's worth is its margin plus the worths of those children that are worth keeping; summed from the leaves
    up, level by level, then chosen from the roots down.
    """
    n = len(nodes.tag)
    if not n:
        return np.zeros(0, dtype=bool)
    parent, depth = np.array(nodes.parent), np.array(nodes.depth)
    worth = margin.astype(np.float64).copy()
    order = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    levels = [order[a:b] for a, b in zip(edges, edges[1:])]
    for at in levels[:0:-1]:
        np.add.at(worth, parent[at], np.maximum(worth[at], 0))
    keep = worth > 0
    for at in levels[1:]:
        keep[at] &= keep[parent[at]]
    return keep


def texts(nodes: Nodes, keep: np.ndarray) -> list[str]:
    """The kept runs of each page, joined by spaces."""
    out: list[list[str]] = [[] for _ in nodes.roots]
    for at, text in nodes.runs:
        if keep[at]:
            out[nodes.page[at]].append(text)
    return [" ".join(o) for o in out]

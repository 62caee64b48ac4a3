"""Main text of web pages by boosted trees over DOM nodes.

A page becomes a tree of elements (comments, scripts, styles and templates carry no text;
void and unclosed elements end as browsers end them). Text and inline elements that lie loose in
the body, or beside blocks in any other element, become blocks without a tag, run by run. Each block gets features: depth,
share of the page's text, link density, tags per character, sentence marks, position,
attribute tokens grouped by meaning, and how its siblings compare. Boosted trees give the
log-odds that the element belongs to the article; a page's labels are then chosen together
from the root down, the best total under the rule that nothing inside a rejected element is
accepted. Accepted text is returned block by block.

The trees are trained on the driver from pages that a seeded writer lays out with known
parts (several layouts, semantic and plain tags, many names for menus, adverts, notices and
reader comments); `pages` and `seed` fix the sample. No row of the input is used.

Null html counts as empty and gives empty text, as does a page without an accepted block; an empty
table gives no rows. A page that is one run of bare text is judged like any other block. Truncated pages are
read to their end, very long and very deep ones whole and without recursion. Rows are independent; repeated rows repeat, and nothing
depends on their order. Of the input only `keep` columns come back, so other names cannot clash; `text` and `n_chars` may not be among them.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import boosting

PAGES, SEED = 600, 7
# Fixed values of HTML: element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
SILENT = frozenset("script style template noscript head title svg math object iframe select option textarea button datalist canvas audio video noembed noframes xmp".split())
BLOCK = frozenset((
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption").split())
RUN = "#run"  # a block made of loose text and inline elements
BLOCKS = BLOCK | {RUN}
ENDS_PARAGRAPH = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"},
         "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")
GROUPS = {
    "good": "article|content|entry|post(?!s)|story|body|text|main|hentry|blog|articlebody|prose|markdown|paragraph|headline",
    "menu": "nav|menu|breadcrumb|crumbs|toc|pagination|pager|tabs|topbar|navbar|links|skip|sitemap|tags?\\b|categor",
    "frame": "header|footer|masthead|banner|branding|contentinfo|copyright|legal|foot\\b|credits",
    "side": "sidebar|aside|widget|related|recommend|promo|popular|trending|more-|teaser|rail|secondary|complementary|author-box|share|social|follow",
    "advert": "\\bads?\\b|\\bad[-_]|[-_]ads?\\b|advert|sponsor|dfp|banner|affiliate|outbrain|taboola",
    "notice": "cookie|consent|gdpr|popup|modal|overlay|notice|alert|newsletter|subscribe|signup|paywall|toast|dialog|disclaimer",
    "comment": "comment|disqus|respond|reply|replies|discussion|feedback|review|thread",
    "unseen": "hidden|display:\\s*none|visibility:\\s*hidden|sr-only|screen-reader|visually-hidden|print-only",
}
GROUP_TESTS = [(name, re.compile(pattern, re.I).search) for name, pattern in GROUPS.items()]
KINDS = {tag: i for i, names in enumerate(("div section span td", "p blockquote pre figure figcaption", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd",
                                           "table tbody tr", "article main", "nav", "header footer", "aside", "form fieldset dialog address", RUN), 1) for tag in names.split()}
FEATURES = ["kind", "depth", "log_chars", "page_share", "parent_share", "link_density", "tags_per_100", "marks_per_100", "words_per_block", "children",
            "place", "before_share", "sibling_same_tag", "sibling_share", "above_good", "above_bad", *GROUPS]


@dataclass
class Node:
    tag: str
    words: str
    parent: int
    depth: int
    own: list = field(default_factory=list)  # text pieces and child numbers, in order
    children: int = 0
    chars: int = 0
    linked: int = 0
    tags: int = 0
    marks: int = 0
    blocks: int = 0
    end: int = 0


def parse(html: str) -> list[Node]:
    """Elements in page order, each with its text pieces and children."""
    nodes = [Node("#root", "", -1, 0)]
    stack = [0]

    def text(piece: str) -> None:
        if piece:
            nodes[stack[-1]].own.append(unescape(piece) if "&" in piece else piece)

    def close(names, stops) -> None:
        for at in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[at]].tag
            if tag in names:
                del stack[at:]
                return
            if tag in stops:
                return

    at, size = 0, len(html)
    while at < size:
        match = TOKEN.search(html, at)
        if not match:
            text(html[at:])
            break
        text(html[at:match.start()])
        at = match.end()
        slash, tag, rest = match.group(1), match.group(2), match.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            if tag == "p" and not any(nodes[n].tag == "p" for n in stack):
                continue
            close({tag}, {"table"} if tag not in ("table", "body", "html") and tag in BLOCK else ())
            continue
        if tag in ENDS_PARAGRAPH:
            close({"p"}, BLOCK - {"p"})
        if tag in CLOSES:
            for _ in range(3):
                close(CLOSES[tag], STOPS[tag])
        if tag in ("body", "html") and any(nodes[n].tag == tag for n in stack):
            continue
        words = " ".join((a[0] if a[0].lower() in ("hidden", "aria-hidden") else "") + " " + (a[1] or a[2] or a[3] or "") for a in ATTRIBUTE.findall(rest)) if rest.strip() else ""
        number = len(nodes)
        nodes.append(Node(tag, words, stack[-1], nodes[stack[-1]].depth + 1))
        nodes[stack[-1]].own.append(number)
        nodes[stack[-1]].children += 1
        if tag in VOID or rest.endswith("/") and tag not in BLOCK and tag not in RAW and tag not in ("a", "b", "i", "span", "em", "strong"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            if tag not in SILENT:
                nodes[number].own.append(html[at:stop.start() if stop else size])
            at = stop.end() if stop else size
            continue
        stack.append(number)
    return nodes


def with_runs(nodes: list[Node]) -> tuple[list[Node], list[int]]:
    """The tree with loose runs as blocks of their own, and for each of its nodes the number it had (-1 for runs).

    Loose is what lies directly in the root, html or body, or in an element that also holds blocks: text, and
    inline elements without blocks in them. Runs without anything to read stay as they are.
    """
    holds = [False] * len(nodes)  # a block below
    reads = [False] * len(nodes)  # text to read, here or below
    for number in range(len(nodes) - 1, 0, -1):
        node = nodes[number]
        if node.tag not in SILENT:
            reads[number] = reads[number] or any(isinstance(p, str) and not p.isspace() and p for p in node.own)
            holds[node.parent] = holds[node.parent] or holds[number] or node.tag in BLOCK
            reads[node.parent] = reads[node.parent] or reads[number]
    made, was = [Node("#root", nodes[0].words, -1, 0)], [0]
    todo = [(0, 0, 0)]  # node as it was, node as it is, next piece
    while todo:
        old, new, at = todo.pop()
        node = nodes[old]
        mixed = node.tag in ("#root", "html", "body") or holds[old] and node.tag not in SILENT
        pieces = node.own
        while at < len(pieces):
            stop = at
            while mixed and stop < len(pieces) and (isinstance(pieces[stop], str) or nodes[pieces[stop]].tag not in BLOCK | SILENT and not holds[pieces[stop]]):
                stop += 1
            if stop > at and any(reads[q] if isinstance(q, int) else q and not q.isspace() for q in pieces[at:stop]):
                number = len(made)
                made.append(Node(RUN, "", new, made[new].depth + 1))
                was.append(-1)
                made[new].own.append(number)
                made[new].children += 1
                _lay_out(nodes, made, was, [(number, q) for q in pieces[at:stop]])
                at = stop
                continue
            piece = pieces[at]
            at += 1
            if isinstance(piece, str):
                made[new].own.append(piece)
                continue
            number = len(made)
            made.append(Node(nodes[piece].tag, nodes[piece].words, new, made[new].depth + 1))
            was.append(piece)
            made[new].own.append(number)
            made[new].children += 1
            todo.append((old, new, at))
            todo.append((piece, number, 0))
            break
    return made, was


def _lay_out(nodes: list[Node], made: list[Node], was: list[int], pieces: list[tuple[int, object]]) -> None:
    """Copy pieces with all below them under their new parents, in page order."""
    todo = pieces[::-1]
    while todo:
        parent, piece = todo.pop()
        if isinstance(piece, str):
            made[parent].own.append(piece)
            continue
        number = len(made)
        made.append(Node(nodes[piece].tag, nodes[piece].words, parent, made[parent].depth + 1))
        was.append(piece)
        made[parent].own.append(number)
        made[parent].children += 1
        todo += [(number, q) for q in reversed(nodes[piece].own)]


def measure(nodes: list[Node]) -> None:
    """Totals of every subtree, children before parents."""
    for number in range(len(nodes) - 1, -1, -1):
        node = nodes[number]
        node.end = max([number + 1, *(nodes[c].end for c in node.own if isinstance(c, int))]) if node.children else number + 1
        if node.tag in SILENT:
            continue
        node.tags, node.blocks = 1, int(node.tag in BLOCKS)
        for piece in node.own:
            if isinstance(piece, int):
                child = nodes[piece]
                node.chars += child.chars
                node.linked += child.chars if child.tag == "a" else child.linked
                node.tags += child.tags
                node.marks += child.marks
                node.blocks += child.blocks
            else:
                bare = len(piece) - piece.count(" ") if piece.isascii() else len(piece.strip())
                node.chars += bare
                node.marks += piece.count(". ") + piece.count(", ") + piece.rstrip().endswith((".", "!", "?"))


def features(nodes: list[Node]) -> tuple[list[int], np.ndarray]:
    """Numbers and feature rows of the block elements that hold text."""
    whole = max(nodes[0].chars, 1)
    chosen, rows = [], []
    before = 0
    groups: dict[int, list[int]] = {}
    running: dict[int, int] = {}
    largest: dict[int, int] = {}
    tags: dict[tuple[int, str], int] = {}
    for number, node in enumerate(nodes):
        if number:
            tags[node.parent, node.tag] = tags.get((node.parent, node.tag), 0) + 1
            largest[node.parent] = max(largest.get(node.parent, 0), node.chars)
    for number, node in enumerate(nodes):
        own = [int(test(node.words) is not None) for _, test in GROUP_TESTS] if node.words.strip() else [0] * len(GROUPS)
        up = groups.get(node.parent, (0, 0))
        good = up[0] or int(node.tag in ("article", "main")) or own[0]
        bad = up[1] or int(any(own[1:]) or node.tag in ("nav", "footer", "aside", "form", "dialog"))
        groups[number] = (good, bad)
        if number and node.tag in BLOCKS and node.chars and node.tag not in ("html", "body"):
            parent = nodes[node.parent]
            done = running.get(node.parent, 0)
            chosen.append(number)
            rows.append([
                KINDS.get(node.tag, 0), node.depth, np.log1p(node.chars), node.chars / whole, node.chars / max(parent.chars, 1), node.linked / node.chars,
                100 * node.tags / node.chars, 100 * node.marks / node.chars, node.chars / max(node.blocks, 1), node.children,
                done / max(parent.children, 1), before / whole, tags[node.parent, node.tag], node.chars / max(largest[node.parent], 1), up[0], up[1], *own])
        if number:
            running[node.parent] = running.get(node.parent, 0) + 1
        before += sum(len(p) for p in node.own if isinstance(p, str)) if node.tag not in SILENT else 0
    return chosen, np.array(rows, float).reshape(len(rows), len(FEATURES))


def decode(nodes: list[Node], chosen: list[int], score: np.ndarray) -> set[int]:
    """Accepted elements: the labels of highest total score in which a rejected element has no accepted descendant.

    An element votes with its log-odds, weighted by the text that is its own; accepting an
    element earns its own vote and the best of each child, rejecting it earns nothing.
    """
    own = dict(zip(chosen, score.tolist(), strict=True))
    gain = [0.0] * len(nodes)
    for number in range(len(nodes) - 1, -1, -1):
        node = nodes[number]
        total = sum(max(gain[c], 0.0) for c in node.own if isinstance(c, int))
        if node.tag in SILENT:
            gain[number] = -1.0
        elif number in own:
            gain[number] = own[number] + total
        else:
            gain[number] = total
    accepted = {0}
    for number in range(1, len(nodes)):
        node = nodes[number]
        if node.parent in accepted and node.tag not in SILENT and (gain[number] > 0 or number not in own):
            accepted.add(number)
    return accepted


def blocks(nodes: list[Node], accepted: set[int], wanted: set[int]) -> list[str]:
    """Text of the accepted elements by block; only text under a `wanted` block counts."""
    found: list[str] = []
    current: list[str] = []

    def flush() -> None:
        piece = SPACE.sub(" ", "".join(current)).strip()
        current.clear()
        if piece:
            found.append(piece)

    todo: list[tuple[int, int, bool]] = [(0, 0, False)]
    while todo:
        number, at, inside = todo.pop()
        node = nodes[number]
        if at == 0:
            inside = inside or number in wanted
            if node.tag in BLOCKS:
                flush()
        pieces = node.own
        while at < len(pieces) and not isinstance(pieces[at], int):
            if inside:
                current.append(pieces[at])
            at += 1
        if at < len(pieces):
            todo.append((number, at + 1, inside))
            child = pieces[at]
            if child in accepted:
                if nodes[child].tag == "br":
                    current.append("\n")
                else:
                    todo.append((child, 0, inside))
            elif nodes[child].tag in BLOCKS:
                flush()
        elif node.tag in BLOCKS or number == 0:
            flush()
    return found


def extract_many(pages: list[str | None], model: boosting.Model, together: int = 64) -> list[str]:
    """Article text of each page; elements of some pages at a time are scored in one go."""
    texts = []
    for at in range(0, len(pages), together):
        trees = [with_runs(parse(html or ""))[0] for html in pages[at:at + together]]
        for nodes in trees:
            measure(nodes)
        held = [features(nodes) for nodes in trees]
        scores = model.score(np.vstack([rows for _, rows in held]))
        done = 0
        for nodes, (chosen, rows) in zip(trees, held, strict=True):
            texts.append(_chosen_text(nodes, chosen, scores[done:done + len(rows)]))
            done += len(rows)
    return texts


def _chosen_text(nodes: list[Node], chosen: list[int], score: np.ndarray) -> str:
    accepted = decode(nodes, chosen, score)
    wanted = {n for n, s in zip(chosen, score, strict=True) if n in accepted and s > 0}
    return "\n\n".join(blocks(nodes, accepted, wanted))


# --- training pages -------------------------------------------------------------------

def _sentences(draw: random.Random, low: int, high: int) -> str:
    letters = "etaoinshrdlucmfwypvbgkéüñöß" if draw.random() < 0.4 else "etaoinshrdlucmfwypvbgk"
    out = []
    for _ in range(draw.randint(low, high)):
        words = ["".join(draw.choices(letters, k=draw.randint(1, 10))) + draw.choice(["", "", "", "", "", ",", "***", "!!", " |"] if draw.random() < 0.1 else ["", "", "", "", "", ","]) for _ in range(draw.choice([1, 1, 3, 8, 14]))]
        out.append(" ".join(words).capitalize() + draw.choice([".", ".", ".", "", "!"]))
    return " ".join(out)


def _label(draw: random.Random, names: str) -> str:
    if draw.random() < 0.12:
        return ""
    name = draw.choice(names.split())
    return draw.choice([f' class="{name}"', f' class="{name} box"', f' id="{name}"', f' class="c-{name} row"', f' role="{name}" class="{name}"'])


LOOSE = "\ue000"  # marks article text that has no element of its own, on training pages


def written_page(draw: random.Random) -> str:
    """A page whose article elements carry the mark data-y="1", and loose article text the mark LOOSE."""
    s = lambda low=1, high=3: _sentences(draw, low, high)
    link = lambda: f'<a href="/{draw.randint(1, 999)}">{_sentences(draw, 1, 1)[:draw.choice([6, 14, 40])]}</a>'
    listing = lambda n: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"

    def menu() -> str:
        tag = draw.choice(["nav", "nav", "div", "header", "ul"])
        inner = listing(draw.randint(2, 9)) if draw.random() < 0.8 else " | ".join(link() for _ in range(5))
        return f"<{tag}{_label(draw, 'nav menu navbar topbar breadcrumb main-menu navigation') if tag != 'nav' else ''}>{inner}</{tag}>"

    def advert() -> str:
        return f'<div{_label(draw, "ad ads advert ad-slot sponsored banner-ad promo ad-box advertisement") or " class=ad"}>{s(1, 3)}</div>'

    def side() -> str:
        tag = draw.choice(["aside", "div", "section"])
        names = "" if tag == "aside" and draw.random() < 0.5 else _label(draw, "sidebar related widget recommended more-stories popular share social") or ' class="sidebar"'
        return f"<{tag}{names}><h3>{s(1, 1)}</h3>{listing(draw.randint(1, 6)) if draw.random() < 0.7 else '<p>' + s() + '</p>'}</{tag}>"

    def notice() -> str:
        return f'<div{_label(draw, "cookie-banner cookie consent popup newsletter notice modal subscribe gdpr") or " class=notice"}><p>{s()}</p>{"<button>ok</button>" if draw.random() < 0.6 else ""}</div>'

    def form() -> str:
        return f'<form{_label(draw, "search signup login")}><label>{s(1, 1)}</label><input><p>{s(1, 1)}</p></form>'

    def comments() -> str:
        tag = draw.choice(["section", "div", "ol"])
        item = draw.choice(["li", "div", "article"])
        return f'<{tag}{_label(draw, "comments comment-list discussion replies disqus") or " class=comments"}>' + (f"<h3>{s(1, 1)}</h3>" if tag != "ol" else "") + "".join(
            f'<{item}{_label(draw, "comment reply comment-body")}><p>{s(1, 4)}</p></{item}>' for _ in range(draw.randint(1, 6))) + f"</{tag}>"

    def footer() -> str:
        tag = draw.choice(["footer", "footer", "div"])
        return f"<{tag}{'' if tag == 'footer' else _label(draw, 'footer copyright legal site-footer') or ' id=footer'}>" + draw.choice([f"&copy; {s(1, 1)}", f"<p>{s()}</p>", listing(4), f"{link()} &middot; {link()}"]) + f"</{tag}>"

    def mark(tag: str, inner: str, extra: str = "") -> str:
        return f'<{tag} data-y="1"{extra}>{inner}</{tag}>'

    def loose() -> str:
        gaps = draw.choice(["<br><br>", "<br>", " ", "<br><br>\n"])
        said = gaps.join(s(1, draw.choice([1, 3, 8])) for _ in range(draw.choice([1, 2, 4])))
        inline = draw.choice(["", "", f"<b>{s(1, 1)}</b> ", f"<i>{s(1, 1)}</i> ", f"<font size=2>{s(1, 2)}</font> ", f"{link()} ", f"<span>{s(1, 1)}</span>"])
        return LOOSE + (inline + said if draw.random() < 0.5 else said + " " + inline)

    def loose_frame() -> str:
        return draw.choice([" | ".join(link() for _ in range(draw.randint(2, 6))), f"&copy; {draw.randint(1990, 2030)} {s(1, 1)}", f"{link()} &middot; {link()}", f"<small>&copy; {s(1, 1)}</small>"])

    def bare_article() -> str:
        """Heading and text straight in the body, between other blocks."""
        parts = [mark(draw.choice(["h1", "h1", "h2"]), s(1, 1))] if draw.random() < 0.85 else []
        for _ in range(draw.choice([1, 1, 2, 4])):
            parts.append(loose())
            parts += [mark("p", s(1, 4))] if draw.random() < 0.4 else [draw.choice([advert, side, notice])()] if draw.random() < 0.3 else [mark("h2", s(1, 1))] if draw.random() < 0.2 else []
        return "".join(parts)

    def article() -> str:
        parts = [mark(draw.choice(["h1", "h1", "h2"]), s(1, 1))] if draw.random() < 0.9 else []
        if draw.random() < 0.15:
            parts += [draw.choice([loose, lambda: mark("p", s(1, 3))])() for _ in range(draw.randint(1, 5))]
        for _ in range(draw.choice([0, 1, 2, 4, 8, 14])):
            kind = draw.random()
            if kind < 0.72:
                parts.append(mark("p", draw.choice(["", "<b>"]) + s(1, draw.choice([1, 3, 8])) + (f" {link()} {s(1, 2)}" if draw.random() < 0.2 else "")))
            elif kind < 0.80:
                parts.append(mark(draw.choice(["h2", "h3", "h4"]), s(1, 1)))
            elif kind < 0.86:
                parts.append(mark("ul", "".join(mark("li", s(1, 1)) for _ in range(draw.randint(2, 6)))))
            elif kind < 0.90:
                parts.append(mark("blockquote", mark("p", s())))
            elif kind < 0.93:
                parts.append(mark("pre", s()))
            elif kind < 0.96:
                parts.append(mark("table", mark("tr", mark("td", s(1, 1)) + mark("td", s(1, 1)))))
            else:
                parts.append(draw.choice([advert, side, notice, form, comments])())
        if not parts:
            parts.append(mark("p", s(1, 2)))
        tag = draw.choice(["article", "article", "main", "div", "section"])
        names = _label(draw, "content article post-content entry-content story article-body main-content text post") if tag in ("div", "section") or draw.random() < 0.3 else ""
        inner = "".join(parts)
        if draw.random() < 0.25:
            inner = mark("div", inner, _label(draw, "body text inner wrap content"))
        return mark(tag, inner, names)

    top = [menu()] if draw.random() < 0.85 else []
    for part in (advert, notice, side, form):
        if draw.random() < 0.3:
            top.append(part())
    if draw.random() < 0.3:
        top.insert(0, f"<header{_label(draw, 'header masthead site-header')}><h2>{s(1, 1)}</h2>{menu() if draw.random() < 0.5 else '<p>' + s(1, 1) + '</p>'}</header>")
    tail = [part() for part in (side, comments, advert, form, notice) if draw.random() < 0.3] + ([footer()] if draw.random() < 0.85 else [])
    if draw.random() < 0.25:
        top, tail = top + ([loose_frame()] if draw.random() < 0.4 else []), ([loose_frame()] if draw.random() < 0.4 else []) + tail
        if tail and not tail[0].startswith("<") and top and draw.random() < 0.5:
            tail.insert(0, "<hr>" + draw.choice([advert, side, comments])())
        inner = bare_article()
        # Frame text needs a block between it and the article, or it would be one run with it.
        between = lambda part: part if part.startswith("<") and not part.startswith(("<a", "<small")) else f"{part}<div></div>"
        body = "".join(map(between, top)) + inner + "<div></div>" + "".join(map(between, tail))
        if draw.random() < 0.2:
            body = loose()
        return f"<!DOCTYPE html><html><head><title>{s(1, 1)}</title></head><body>{body}</body></html>"
    body = "".join(top) + article() + "".join(tail)
    if draw.random() < 0.3:
        body = f'<div data-y="1"{_label(draw, "wrapper page container site layout")}>{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{s(1, 1)}</title><style>p{{}}</style></head><body>{body}</body></html>"


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, seed: int = SEED) -> boosting.Model:
    draw = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        html = written_page(draw)
        nodes = parse(html)
        marked = [m.group(3) is not None and 'data-y="1"' in m.group(3) for m in TOKEN.finditer(html) if m.group(2) and not m.group(1)]
        # Elements and opening tags come in the same order; raw text holds no tags here.
        nodes, was = with_runs(nodes)
        loose = [node.tag == RUN and any(isinstance(q, str) and LOOSE in q for q in node.own) for node in nodes]
        for node in nodes:
            node.own = [q.replace(LOOSE, "") if isinstance(q, str) else q for q in node.own]
        measure(nodes)
        chosen, rows = features(nodes)
        xs.append(rows)
        ys.append(np.array([float(loose[n] if was[n] < 0 else marked[was[n] - 1]) for n in chosen]))
    x, y = np.vstack(xs), np.concatenate(ys)
    return boosting.fit(x, y, trees=60, depth=4, rate=0.25)


def extract_pages(pages: DataFrame, keep: list[str], html: str = "html", sample: int = PAGES, seed: int = SEED) -> DataFrame:
    """`keep` columns with `text` and `n_chars`."""
    model = trained(sample, seed)

    def run(batches):
        for batch in batches:
            texts = extract_many(batch.column(batch.num_columns - 1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*batch.schema.names[:-1], "text", "n_chars"])

    rows = pages.select(*keep, F.col(html).alias("_html"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, text string, n_chars long")

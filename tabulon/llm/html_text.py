"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read once as a flat list of blocks, the text between block-level tags. A block is described by its number
of words and link density, those of its neighbours, and where it stands (inside an article, inside navigation and the
like, under a container whose class, id or role names a menu, advert, notice, comment section ...). A small decision
tree, grown here from the labelled blocks of ``labelled_pages``, says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from tabulon.llm.labelled_pages import PAGES

FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after",
    "in_article", "in_boilerplate", "named_boilerplate", "heading", "paragraph", "item",
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea|select|title|math|canvas|audio|video)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.I | re.S,
)
_ATTR = re.compile(r"""(?:^|[\s"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?(?=[\s/"']|$)""", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTENT = frozenset(("article", "main"))
_BOILERPLATE = frozenset("nav header footer aside form menu dialog button label fieldset legend address".split())
# Parts of class, id and role names that mark what is not main text, and those that mark it.
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted menu menubar nav navbar "
    "navigation breadcrumb breadcrumbs sidebar sidenav aside footer header masthead topbar toolbar cookie cookies consent gdpr notice "
    "notices notification alert disclaimer popup modal overlay newsletter subscribe subscription signup login signin search share "
    "sharing social related recommended recommendations trending widget pagination pager copyright legal complementary contentinfo "
    "author byline meta tags outbrain taboola".split()
)
_COMMENTS = frozenset("comment comments commentlist respond responses reply replies disqus".split())
_TEXTUAL = frozenset("article content post entry story body main text".split())


@dataclass
class Block:
    text: str
    words: int
    linked: int
    place: tuple[int, int, int, int, int, int]  # the last six features


def _names(attrs: str) -> tuple[set[str], bool]:
    """Parts of the class, id and role names, and whether the element is hidden."""
    parts: set[str] = set()
    hidden = False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            parts.update(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value)))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or "display:none" in value.replace(" ", ""):
            hidden = True
    return parts, hidden


def _inside(state: tuple[int, int, int, int], tag: str, attrs: str) -> tuple[int, int, int, int]:
    """(in article, in boilerplate element, under a boilerplate name, under comments) inside a new element."""
    article, plate, named, comments = state
    parts, hidden = _names(attrs) if attrs and not attrs.isspace() else (set(), False)
    if tag in ("html", "body"):
        return state
    comments |= bool(parts & _COMMENTS)
    if tag in _CONTENT:  # starts afresh, whatever a wrapper is called
        article, plate, named = 1, 0, int(hidden)
    elif tag in _BOILERPLATE and not (tag == "header" and article and not plate):  # an article's own header holds its title
        plate = 1
    if parts & _MARKS and tag not in _CONTENT:
        named = 1
    elif parts & _TEXTUAL and tag in ("div", "section", "td") and not (plate or named):
        article = 1
    return article, plate, int(named or hidden), int(comments)


def blocks(source: str) -> list[Block]:
    """The text blocks of a page in order; white space inside each is one space, none is empty."""
    found: list[Block] = []
    state, link = (0, 0, 0, 0), 0
    stack: list[tuple[str, tuple[int, int, int, int]]] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            tag = next((t for t, _ in reversed(stack) if t in _BLOCKS), "")
            article, plate, named, comments = state
            kinds = (tag[:1] == "h" and tag[1:].isdigit(), tag == "p", tag in ("li", "td", "dd", "dt", "th"))
            n = text.count(" ") + 1
            found.append(Block(text, n, min(linked, n), (article, plate, int(named or comments), *map(int, kinds))))
        parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if link:
                linked += len(text.split())

    at = 0
    for m in _TOKEN.finditer(source):
        say(source[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append("\n")
        elif tag == "a":
            link = 0 if m["close"] or m["close2"] else 1
        if tag in _BLOCKS:
            flush()
        if tag in _VOID:
            continue
        if m["close"] or m["close2"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    state = stack[i][1]
                    del stack[i:]
                    break
        else:
            if tag in ("p", "li", "dd", "dt", "td", "th", "tr") and stack and stack[-1][0] == tag:
                state = stack.pop()[1]  # an end tag that may be left out
            attrs = m["attrs"] or m["attrs2"] or ""
            if not attrs.rstrip().endswith("/"):
                stack.append((tag, state))
                state = _inside(state, tag, attrs)
    say(source[at:])
    flush()
    return found


def describe(found: list[Block]) -> np.ndarray:
    """One row of FEATURES per block."""
    own = np.array([(b.words, b.linked / b.words) for b in found], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    around = np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])])
    return np.hstack([around, np.array([b.place for b in found], float).reshape(-1, 6)])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """Decision tree by Gini impurity: ``(share,)`` for a leaf, ``(feature, limit, at or below, above)`` else."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, good = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cut):
            continue
        n, left = len(y), good[cut - 1]
        right = good[-1] - left
        worth = left * (1 - left / cut) + right * (1 - right / (n - cut))
        i = int(np.argmin(worth))
        if best is None or worth[i] < best[0] - 1e-9:
            best = (worth[i], f, float(v[cut[i] - 1] + v[cut[i]]) / 2)
    if best is None:
        return (share,)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def is_main(tree: tuple, row: list[float]) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled table: ``{n}`` stands for n words of main text, ``[n]`` for n others."""
    xs, ys = [], []
    for page in PAGES:
        source = re.sub(r"([\[{])(\d+)[\]}]", lambda m: " ".join(["keep" if m[1] == "{" else "drop"] * int(m[2])), page)
        found = blocks(source)
        xs.append(describe(found))
        ys.append([float(b.text.startswith("keep")) for b in found])
    return np.vstack(xs), np.concatenate(ys)


def main_text(source: str | None, tree: tuple) -> str:
    found = blocks(source) if source else []
    if not found:
        return ""
    return "\n".join(b.text for b, row in zip(found, describe(found).tolist()) if is_main(tree, row))


def extract(page: Column, tree: tuple | None = None) -> Column:
    """Main text of an HTML column: kept blocks in page order, one per line. Null, empty and markup-only pages give ''."""
    tree = tree or grow(*labelled_blocks())

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(p, tree) for p in pages.to_pylist()], pa.string())

    return run(page)

"""A small, forgiving HTML tree."""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import xxhash

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title"))
HIDDEN = frozenset(("script", "style", "noscript", "template", "head", "title"))
BLOCK = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
#: A tag that ends an open one of these when it starts.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS |= {t: ("p",) for t in BLOCK - {"br", "html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot"}}
#: Where looking for an open tag to end stops.
WALL = frozenset(("table", "ul", "ol", "dl", "div", "article", "section", "body", "html", "nav", "header", "footer", "main", "aside", "blockquote"))
#: Elements nested deeper are put beside each other at this depth.
DEEPEST = 48
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*(?:>|$)|<\?[^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    """An element, or a text if ``text`` isn't None. ``label`` is what its presentation looks like: tag, class, id and role without digits."""

    __slots__ = ("tag", "label", "children", "text", "key", "style")

    def __init__(self, tag: str, label: str, text: str | None = None):
        self.tag, self.label, self.text = tag, label, text
        self.children: list[Node] = []
        self.key = self.style = 0


@lru_cache(maxsize=1 << 14)
def _label(tag: str, attributes: str) -> str:
    attrs = sorted(f"{a.lower()}={b or c or d}" for a, b, c, d in _ATTR.findall(attributes)) if attributes else ()
    return re.sub(r"[0-9]+", "0", " ".join((tag, *attrs)))


def parse(page: str) -> Node:
    root = Node("#root", "#root")
    stack, at, n = [root], 0, len(page)

    def words(raw: str) -> None:
        text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
        if text:
            stack[-1].children.append(Node("#text", "#text", text))

    while at < n:
        found = _TOKEN.search(page, at)
        if not found:
            words(page[at:])
            break
        if found.start() > at:
            words(page[at : found.start()])
        at = max(found.end(), at + 1)
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        for old in ENDS.get(tag, ()):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == old:
                    del stack[k:]
                    break
                if stack[k].tag in WALL:
                    break
        node = Node(tag, _label(tag, found[3]))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not found[3].endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
    return root


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text, seed & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def identify(root: Node) -> list[tuple[Node, int, int]]:
    """Sets each node's key, and the style of those with children; returns (node, depth, key of the style it stands in).

    A style is an element and the labels of its children in order; a child is known by
    its style and place. So nodes of two pages are one if all above them looks the same.
    """
    out, queue = [], [(root, 0, 0)]
    root.key = _hash("#root")
    for node, depth, above in queue:
        out.append((node, depth, above))
        if node.children:
            style = node.style = _hash("\x00".join([c.label for c in node.children]), node.key)
            spread = style * 0x9E3779B97F4A7C15
            for k, child in enumerate(node.children, 1):
                mixed = (spread + k * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF
                child.key = ((mixed ^ (mixed >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
                queue.append((child, depth + 1, style))
    return out


def visible_text(root: Node, gone: set[int] = frozenset()) -> tuple[str, int]:
    """Text of a tree without the branches whose every node is in ``gone``, in lines by block; and how many branches that are."""

    def noise(node: Node) -> bool:
        return node.key in gone and all(noise(c) for c in node.children)

    lines, line, removed = [], [], 0

    def end() -> None:
        if line:
            lines.append(" ".join(line))
            line.clear()

    def walk(node: Node) -> None:
        nonlocal removed
        if node.tag in HIDDEN:
            return
        if gone and noise(node):
            removed += 1
            return
        if node.text is not None:
            line.append(node.text)
            return
        block = node.tag in BLOCK
        if block:
            end()
        for c in node.children:
            walk(c)
        if block:
            end()

    walk(root)
    end()
    return "\n".join(lines), removed

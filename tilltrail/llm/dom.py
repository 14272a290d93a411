"""A tolerant reading of HTML into a flat tree of nodes with text, for classification.

Nodes are in document order, each behind its parent. Formatting elements do not make nodes: their text belongs to the
element around them. Text of an element that also has child nodes makes a node of its own, so that it can be told from them.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element names by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset(
    "head script style noscript template iframe object svg math canvas audio video select option optgroup datalist "
    "textarea button title noembed noframes map progress meter dialog".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br img picture input".split()
)
CLOSED_BY_SAME = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th", "tbody"), "tfoot": ("tbody", "tr", "td", "th"),
}
LIST_BOUNDS = frozenset("ul ol dl table body html div section article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NO_PARAGRAPH_END = frozenset(INLINE | RAW | frozenset("li td th tr dt dd button select option noscript object svg math canvas".split()))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
READ_ATTRIBUTES = ("class", "id", "role", "itemprop", "aria-label", "aria-hidden", "hidden", "style", "data-main")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    words: tuple[str, ...] = ()
    hidden: bool = False
    main: str | None = None
    start: int = 0
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    """Nodes, and pieces of text as ``(node, block, text, within a link)`` in page order."""

    nodes: list[Node]
    pieces: list[tuple[int, int, str, bool]]
    links: list[int]
    controls: list[int]


CASE_CHANGE = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORD = re.compile(r"[a-z]+")


def attribute_words(attributes: dict[str, str]) -> tuple[str, ...]:
    """Lower-case words of class, id, role, item property and label, cut at digits, signs and changes of case."""
    named = " ".join(attributes.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label"))
    return tuple(WORD.findall(CASE_CHANGE.sub(" ", named).lower()))


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        if (name := name.lower()) in READ_ATTRIBUTES and name not in found:
            found[name] = html.unescape(double or single or bare)
    return found


def read_page(text: str, marked=lambda words: False) -> Page:
    """The tree of a page. ``marked`` tells whether the attribute words of a formatting element make it a node."""
    nodes = [Node("#page", -1, 0)]
    pieces: list[tuple[int, int, str, bool]] = []
    links, controls = [0], [0]
    # Open elements as (tag, node they belong to, unseen, inside a link).
    stack: list[tuple[str, int, bool, bool]] = [("#page", 0, False, False)]
    block, place, end = 0, 0, len(text)

    while place < end:
        match = TOKEN.match(text, place)
        place = match.end()
        tag = match.group(2)
        if tag is None:
            piece = match.group()
            if piece[0] == "<" and len(piece) > 1:
                continue
            _, node, unseen, linked = stack[-1]
            if not unseen:
                pieces.append((node, block, piece, linked))
            continue
        tag = tag.lower()
        if match.group(1):
            at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if tag in INLINE and any(open_[0] not in INLINE for open_ in stack[at + 1 :]):
                at = 0
            if at:
                del stack[at:]
            if tag not in INLINE:
                block += 1
            continue
        if tag not in INLINE:
            block += 1
            if tag not in NO_PARAGRAPH_END:
                at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p"), 0)
                if at and all(open_[0] in INLINE for open_ in stack[at + 1 :]):
                    del stack[at:]
            if tag in CLOSED_BY_SAME:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in CLOSED_BY_SAME[tag]:
                        del stack[i:]
                        if tag in ("li", "dt", "dd", "option", "td", "th"):
                            break
                    elif stack[i][0] in LIST_BOUNDS:
                        break
        _, owner, unseen, linked = stack[-1]
        attributes = _attributes(match.group(3)) if "=" in match.group(3) or "hidden" in match.group(3) else {}
        if tag == "br" and not unseen:
            pieces.append((owner, block, " ", linked))
        if tag in ("input", "select", "textarea", "button"):
            controls[owner] += 1
        if tag in VOID:
            continue
        if tag == "a":
            links[owner] += 1
        unseen = unseen or tag in UNSEEN
        words = attribute_words(attributes)
        if not unseen and (tag not in INLINE or (words and marked(words))):
            hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true"
            hidden = hidden or "display:none" in attributes.get("style", "").replace(" ", "").lower()
            parent = owner
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, words, hidden, attributes.get("data-main"), len(pieces)))
            links.append(0)
            controls.append(0)
            owner = len(nodes) - 1
            nodes[parent].children.append(owner)
        if tag in RAW:
            closing = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, place)
            inner_end = closing.start() if closing else end
            if not unseen:
                pieces.append((owner, block, text[place:inner_end], linked))
            place = inner_end
            if closing:
                place = text.find(">", inner_end) + 1 or end
            continue
        stack.append((tag, owner, unseen, linked or tag == "a"))
    return _with_text_nodes(Page(nodes, pieces, links, controls))


def _with_text_nodes(page: Page) -> Page:
    """Text beside child nodes moves to a node of its own, one for each block; blank pieces stay."""
    own: dict[tuple[int, int], int] = {}
    pieces = []
    for i, (node, block, text, linked) in enumerate(page.pieces):
        if page.nodes[node].children and (key := (node, block)) in own:
            node = own[key]
        elif page.nodes[node].children and page.nodes[node].tag != "#text" and text.strip():
            parent = page.nodes[node]
            page.nodes.append(Node("#text", node, parent.depth + 1, start=i, main=parent.main))
            page.links.append(0)
            page.controls.append(0)
            node = own[key] = len(page.nodes) - 1
        pieces.append((node, block, text, linked))
    for i, node in enumerate(page.nodes):
        if node.tag == "#text":
            page.nodes[node.parent].children.append(i)
    for node in page.nodes:
        node.children.sort(key=lambda c: page.nodes[c].start)
    page.pieces = pieces
    return page


def text_of(page: Page, kept: list[bool]) -> str:
    """The text of kept nodes: references decoded, white space to single spaces, blocks joined by line ends."""
    blocks: list[list[str]] = []
    last = None
    for node, block, text, _ in page.pieces:
        if not kept[node]:
            continue
        if block != last:
            blocks.append([])
            last = block
        blocks[-1].append(text)
    lines = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks)
    return "\n".join(line for line in lines if line)

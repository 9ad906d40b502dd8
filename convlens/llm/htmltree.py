"""Pages as trees: a forgiving reader of HTML that keeps what extraction needs.

One pass of a regular expression over the page; nodes live in parallel lists (tag, parent, words of
class and id, text pieces), parents before children.
"""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z]+")

# Fixed values of the HTML standard: elements without content, elements whose content is no markup,
# elements that flow inside a line, and open elements that a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript template iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span"
    " strike strong sub sup time tt u var wbr img br button input select".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}
HEAD_ONLY = frozenset("head title base link meta style script".split())


class Page:
    """tag[i], parent[i], names[i] (words of class, id and role), hidden[i], main[i] and other[i]
    (labels of a training page); pieces: (node, text) in page order, the text None where a block opens."""

    def __init__(self) -> None:
        self.tag, self.parent, self.names, self.hidden, self.main = ["#root"], [-1], [()], [False], [False]
        self.other = [False]
        self.pieces: list[tuple[int, str | None]] = []

    def add(self, tag: str, parent: int, attributes: str) -> int:
        names: list[str] = []
        hidden = False
        if attributes and not attributes.isspace():
            for key, a, b, c in _NAMES.findall(attributes):
                key, value = key.lower(), (a or b or c).lower()
                if key in ("class", "id", "role"):
                    names += [w for w in _SPLIT.split(value) if w]
                elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                    hidden = True
                elif key == "style":
                    hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(tuple(names))
        self.hidden.append(hidden)
        self.main.append("data-main" in attributes)
        self.other.append("data-other" in attributes)
        return len(self.tag) - 1


def parse(text: str) -> Page:
    page = Page()
    open_nodes = [0]
    tag = page.tag
    position, end = 0, len(text)
    while position < end:
        m = _TOKEN.match(text, position)
        position = m.end()
        name = m[2]
        if name is None:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                page.pieces.append((open_nodes[-1], html.unescape(raw) if "&" in raw else raw))
            continue
        name = name.lower()
        if m[1]:  # an end tag closes what it names, if that is open, and all inside it
            if name == "p" and not any(tag[n] == "p" for n in open_nodes):
                continue
            for i in range(len(open_nodes) - 1, 0, -1):
                own = tag[open_nodes[i]]
                if own == name:
                    del open_nodes[i:]
                    break
                if name in INLINE and own not in INLINE:
                    break  # </b> does not close the block it stands in
            continue
        if name == "body" or name == "html":
            if name in tag:
                continue
            while len(open_nodes) > 1 and tag[open_nodes[-1]] in HEAD_ONLY:
                open_nodes.pop()
        elif name not in HEAD_ONLY and tag[open_nodes[-1]] == "head":
            open_nodes.pop()
        if name in ENDS_P:
            for i in range(len(open_nodes) - 1, 0, -1):
                own = tag[open_nodes[i]]
                if own == "p":
                    del open_nodes[i:]
                    break
                if own not in INLINE:
                    break
        if name in SIBLINGS:
            closes, stop = SIBLINGS[name], SCOPE[name]
            lowest = None
            for i in range(len(open_nodes) - 1, 0, -1):
                own = tag[open_nodes[i]]
                if own in stop:
                    break
                if own in closes:
                    lowest = i
            if lowest is not None:
                del open_nodes[lowest:]
        node = page.add(name, open_nodes[-1], m[3])
        if name not in INLINE:
            page.pieces.append((node, None))
        if name in VOID:
            if name == "br":
                page.pieces.append((open_nodes[-1], " "))
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(text, position)
            position = close.end() if close else end
            continue
        if not (m[3].endswith("/") and name in ("path", "circle", "rect", "use", "line", "polygon")):
            open_nodes.append(node)
    return page

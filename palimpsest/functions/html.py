"""A tolerant HTML tree on the standard tokenizer, and GitHub-flavoured Markdown of it.

Covers what real pages need: void and raw-text elements, implied html, head, body and tbody,
implied end tags, and reopening of formatting elements that a block end cut off.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from palimpsest.functions.text import clean_text

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
IN_HEAD = set("base link meta title style script noscript template".split())
#: Elements whose start ends an open paragraph.
BLOCK = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Start tag -> open elements that it ends, and where the search for them stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"})}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs=()):
        self.tag, self.children = tag, []
        self.attrs = {}
        for k, v in attrs:
            self.attrs.setdefault(k, v or "")

    def walk(self):
        """Elements below, in document order."""
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, Node):
                yield n
                stack.extend(reversed(n.children))

    def find(self, *tags: str):
        return (n for n in self.walk() if n.tag in tags)

    def text(self, skip=None) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif not (skip and skip(n)):
                stack.extend(reversed(n.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.html, self.head, self.body = Node("html"), Node("head"), Node("body")
        self.html.children = [self.head, self.body]
        self.open: list[Node] = []
        self.cut: list[Node] = []  # formatting elements still in force
        self.in_body = False

    def updatepos(self, i: int, j: int) -> int:
        """Lines are not counted: nothing asks for them."""
        return j

    @property
    def top(self) -> Node:
        return self.open[-1] if self.open else (self.body if self.in_body else self.head)

    def _end(self, names: set, stop: set) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in names:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def _reopen(self) -> None:
        for i, f in enumerate(self.cut):
            if not any(n is f for n in self.open):
                again = self.cut[i] = Node(f.tag, f.attrs.items())
                self.top.children.append(again)
                self.open.append(again)

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "body"):
            node = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for k, v in attrs:
                node.attrs.setdefault(k, v or "")
            self.in_body |= tag == "body"
            if tag == "body":
                self.open.clear()
            return
        if not self.in_body and not self.open and tag not in IN_HEAD:
            self.in_body = True
        if tag in BLOCK:
            self._end({"p"}, {"button", "table", "td", "th"})
            if re.fullmatch("h[1-6]", tag) and self.open and re.fullmatch("h[1-6]", self.open[-1].tag):
                self.open.pop()
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag == "tr" and self.open and self.open[-1].tag == "table":
            self._push(Node("tbody"))
        if tag in ("td", "th") and self.open and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            if self.open[-1].tag == "table":
                self._push(Node("tbody"))
            self._push(Node("tr"))
        if tag not in BLOCK and tag not in ENDS and tag not in IN_HEAD:
            if tag == "a" and (old := next((f for f in self.cut if f.tag == "a"), None)):
                self.handle_endtag("a")
                self.cut = [f for f in self.cut if f is not old]
            self._reopen()
        node = Node(tag, attrs)
        if tag in VOID:
            self.top.children.append(node)
            return
        self._push(node)
        if tag in FORMATTING:
            alike = [f for f in self.cut if f.tag == tag and f.attrs == node.attrs]
            if len(alike) >= 3:
                self.cut = [f for f in self.cut if f is not alike[0]]
            self.cut.append(node)

    def _push(self, node: Node) -> None:
        self.top.children.append(node)
        self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # outside SVG the slash means nothing
        if tag not in VOID and any(n.tag in ("svg", "math") for n in self.open) and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "head":
            self.in_body = True
            return
        if tag in FORMATTING:
            for i in range(len(self.cut) - 1, -1, -1):
                if self.cut[i].tag == tag:
                    del self.cut[i]
                    break
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.in_body = True
            self.top.children.append(Node("p"))
            return
        stop = {"table", "td", "th"} - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else set()
        self._end({tag}, stop)

    def handle_data(self, data):
        if self.open and self.open[-1].tag in ("script", "style", "title", "textarea"):
            self.open[-1].children.append(data)
            return
        if not self.in_body and not self.open:
            if not data.strip():
                return
            self.in_body = True
        if data.strip():
            self._reopen()
        self.top.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.html


def hidden_block(n: Node) -> bool:
    """Never shown: code, templates, and what is marked hidden."""
    return n.tag in ("style", "script", "template", "noscript") or "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true"


def hidden(n: Node) -> bool:
    """``hidden_block``, or hidden by an inline style."""
    return hidden_block(n) or bool(re.search("display: ?none|visibility: ?hidden", n.attrs.get("style", "")))


def _inline(n, skip) -> str:
    if isinstance(n, str):
        return re.sub(r"([\\`*_\[\]])", r"\\\1", re.sub(r"\s+", " ", n))
    if skip(n):
        return ""
    inner = "".join(_inline(c, skip) for c in n.children)
    core = inner.strip()
    if n.tag == "br":
        return "  \n"
    if n.tag == "img":
        title = f' "{n.attrs["title"]}"' if n.attrs.get("title") else ""
        return f"![{n.attrs.get('alt', '')}]({n.attrs['src']}{title})" if n.attrs.get("src") else ""
    if not core:
        return inner
    lead, trail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
    wrap = {"b": "**", "strong": "**", "i": "_", "em": "_", "del": "~", "s": "~", "strike": "~"}.get(n.tag)
    if wrap:
        return f"{lead}{wrap}{core}{wrap}{trail}"
    if n.tag == "code":
        return f"{lead}`{re.sub(chr(92) * 2 + '([`*_])', chr(92) + '1', core)}`{trail}"
    if n.tag == "a" and n.attrs.get("href"):
        title = f' "{n.attrs["title"]}"' if n.attrs.get("title") else ""
        return f"{lead}[{core}]({n.attrs['href']}{title}){trail}"
    return inner


_INLINE = FORMATTING | set("abbr bdi bdo br cite data del dfn img ins kbd label mark q ruby samp span sub sup time var wbr".split())


def markdown(n, skip=hidden) -> str:
    """Markdown of a node: ATX headings, hyphen bullets, pipe tables, fenced code."""
    if isinstance(n, str) or n.tag in _INLINE:
        return _inline(n, skip).strip()
    if skip(n):
        return ""
    if re.fullmatch("h[1-6]", n.tag):
        core = "".join(_inline(c, skip) for c in n.children).strip()
        return f"{'#' * int(n.tag[1])} {core}" if core else ""
    if n.tag == "hr":
        return "* * *"
    if n.tag == "pre":
        return f"```\n{n.text().rstrip(chr(10))}\n```"
    if n.tag == "blockquote":
        return "\n".join(f"> {line}".rstrip() for line in _flow(n.children, skip).split("\n"))
    if n.tag in ("ul", "ol"):
        return _list(n, skip)
    if n.tag == "table":
        return _table(n, skip)
    return _flow(n.children, skip)


def _flow(children: list, skip) -> str:
    """Blocks apart by blank lines; runs of inline nodes as paragraphs."""
    out, run = [], []

    def flush():
        text = "".join(_inline(c, skip) for c in run).strip()
        if text:
            out.append(text)
        run.clear()

    for c in children:
        if isinstance(c, str) or c.tag in _INLINE:
            run.append(c)
        else:
            flush()
            if part := markdown(c, skip):
                out.append(part)
    flush()
    return "\n\n".join(out)


def _list(n: Node, skip) -> str:
    lines, number = [], int(n.attrs["start"]) if re.fullmatch(r"-?\d+", n.attrs.get("start", "")) else 1
    for item in n.children:
        if isinstance(item, str) or item.tag != "li" or skip(item):
            continue
        if n.tag == "ol" and re.fullmatch(r"-?\d+", item.attrs.get("value", "")):
            number = int(item.attrs["value"])
        mark = f"{number}.  " if n.tag == "ol" else "-   "
        tight = not any(isinstance(c, Node) and c.tag == "p" for c in item.children)
        body = re.sub(r"\n\n(?=[-\d])", "\n", _flow(item.children, skip)) if tight else _flow(item.children, skip)
        lines.append(mark + body.replace("\n", "\n    "))
        number += 1
    return "\n".join(lines)


def _table(n: Node, skip) -> str:
    rows = [[re.sub(r"\s*\n\s*", " ", "".join(_inline(x, skip) for x in c.children).strip()).replace("|", "\\|") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in n.find("tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


def page_text(n: Node, skip=None) -> str:
    return clean_text(n.text(skip))

"""Tolerant XML and HTML trees, and the labelled texts in them.

`article_fields` and `page_fields` only find texts; the record is made of them by Column expressions
(`sources.articles`).  An article is parsed as strict XML first.  Where that fails, one scan recovers what is there, by
a rule for each kind of fault (RULES), and tells where it met which.  Names keep their case.  Web pages go to an event
parser that closes what is open when an outer element ends.  Documents without any element give the defaults.
Nothing external is ever read.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree


@dataclass
class Node:
    """An element: its local name, attributes, and children in order (nodes and text)."""
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list["Node | str"] = field(default_factory=list)

    def walk(self) -> Iterator["Node"]:
        """The element and all below it, in document order, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def pieces(self) -> Iterator[str]:
        """All pieces of text below, in order."""
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            else:
                stack += reversed(x.children)

    def text(self) -> str:
        """All text below, pieces parted by a blank, white space collapsed."""
        return re.sub(r"\s+", " ", " ".join(self.pieces())).strip()

    def elements(self) -> list["Node"]:
        return [c for c in self.children if isinstance(c, Node)]


class _Builder:
    """Builds Nodes.  Elements, comments and instructions part the text; a run between them is one piece, whatever pieces it comes in."""

    def __init__(self):
        self.top = Node("")
        self.open, self.parted = [self.top], True

    def begin(self, name: str, attributes: dict[str, str], stays: bool = True) -> None:
        node = Node(name, attributes)
        self.open[-1].children.append(node)
        if stays:
            self.open.append(node)
        self.parted = True

    def part(self) -> None:
        self.parted = True

    def add(self, text: str) -> None:
        own = self.open[-1].children
        if self.parted or not own or not isinstance(own[-1], list):
            own.append([])
        own[-1].append(text)
        self.parted = False

    def root(self) -> Node | None:
        """The first element, its runs of text joined."""
        for node in self.top.walk():
            node.children = ["".join(c) if isinstance(c, list) else c for c in node.children]
        return next(iter(self.top.elements()), None)


class _Strict(_Builder):
    """An ElementTree target."""

    def start(self, tag: str, attributes: dict) -> None:
        self.begin(tag.rpartition("}")[2], {k.rpartition("}")[2]: v for k, v in attributes.items()})

    def end(self, tag: str) -> None:
        self.open.pop()
        self.part()

    def data(self, text: str) -> None:
        self.add(text)

    def comment(self, text: str) -> None:
        self.part()

    def pi(self, target: str, text: str | None = None) -> None:
        self.part()

    def close(self) -> Node | None:
        return self.root()


#: HTML elements without an end tag.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree = _Builder()

    def handle_starttag(self, tag, attrs):
        self.tree.begin(tag.rpartition(":")[2], {k.rpartition(":")[2]: v or "" for k, v in attrs}, stays=tag.rpartition(":")[2] not in _VOID)

    def handle_startendtag(self, tag, attrs):
        self.tree.begin(tag.rpartition(":")[2], {k.rpartition(":")[2]: v or "" for k, v in attrs}, stays=False)

    def handle_endtag(self, tag):
        name, open_nodes = tag.rpartition(":")[2], self.tree.open
        at = next((i for i in range(len(open_nodes) - 1, 0, -1) if open_nodes[i].name == name), 0)
        if at:
            del open_nodes[at:]
            self.tree.part()

    def handle_data(self, data):
        self.tree.add(data)

    def handle_comment(self, data):
        self.tree.part()

    def handle_pi(self, data):
        self.tree.part()

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.tree.add(data[6:])


#: What is done about each kind of fault.
RULES = {
    "undeclared entity": "a name that HTML knows gives its character, another one nothing",
    "bare ampersand": "is text",
    "bare bracket": "is text",
    "truncated tag": "is left out, with all that follows",
    "bad attribute": "what can't be read as one is left out",
    "undeclared prefix": "is left out, as declared ones are",
    "stray end": "is left out",
    "wrong nesting": "elements inside end with the outer one",
    "left open": "ends with the document",
    "after the end": "elements and text beyond the first element are left out",
    "bad byte": "counts as U+FFFD",
    "control character": "is left out",
}
_NAME = r"[A-Za-z_:\u0080-\U0010ffff][-.\w:\u00b7]*"
_TOKEN = re.compile(rf"""<!--(?P<comment>.*?)-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?(?P<pi>.*?)\?>|<!(?P<declaration>[A-Za-z][^<>\[]*(?:\[.*?\]\s*)?)>
|</(?P<end>{_NAME})\s*>|<(?P<start>{_NAME})(?P<attributes>(?:[^<>"']|"[^"<]*"|'[^'<]*')*?)(?P<empty>/?)>|(?P<text>[^<]+)|(?P<bare><)""".replace("\n", ""), re.S)
#: What isn't text where it has no end.
_BEGINS = re.compile(r"<(?:/?[A-Za-z_:]|[!?]|\Z)")
_ATTRIBUTE = re.compile(rf"""\s*(?P<name>{_NAME})\s*=\s*(?:"(?P<a>[^"]*)"|'(?P<b>[^']*)')""")
_REFERENCE = re.compile(rf"&(?:#(?P<number>[0-9]+);|#x(?P<hex>[0-9A-Fa-f]+);|(?P<name>{_NAME});)?")
_CONTROL, _BYTE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]"), re.compile("[\udc80-\udcff]")
_OWN = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


class _Recovering:
    """One scan of an article that isn't well formed."""

    def __init__(self, text: str):
        self.tree, self.text, self.found = _Builder(), text, []
        self.prefixes = {"xml", "xmlns", *re.findall(r"\sxmlns:([-.\w]+)\s*=", text)}
        self.ended = False
        last = {mark: text.rfind(end) for mark, end in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"), ("<", ">"))}
        at = 0
        while at < len(text):
            # What begins and never ends: a tag, comment or section that is cut off; each end is looked for once.
            if text[at] == "<" and any(at > last[mark] and text.startswith(mark, at) for mark in last) and _BEGINS.match(text, at):
                self._fault(at, "truncated tag")
                break
            m = _TOKEN.match(text, at)
            self._take(m)
            at = m.end()
        if len(self.tree.open) > 1:
            self._fault(len(text), "left open")

    def _fault(self, at: int, rule: str) -> None:
        self.found.append((at, rule))

    def _take(self, m: re.Match) -> None:
        kind, at = m.lastgroup, m.start()
        if m["text"] is not None or m["cdata"] is not None:
            if len(self.tree.open) > 1:
                self.tree.add(self._characters(m["cdata"], m.start("cdata")) if m["text"] is None else self._text(m["text"], at))
            elif m[0].strip("\ufeff \t\r\n"):
                if self.ended:
                    self._fault(at, "after the end")
        elif kind in ("comment", "pi", "declaration"):
            self.tree.part()
        elif m["end"] is not None:
            self._end(m["end"].rpartition(":")[2], at)
        elif m["start"] is not None:
            if self.ended and len(self.tree.open) == 1:
                self._fault(at, "after the end")
            stays = not m["empty"]
            self.tree.begin(self._local(m["start"], at), self._attributes(m["attributes"], m.start("attributes")), stays)
            self.ended = self.ended or (not stays and len(self.tree.open) == 1)
        else:
            self._bare(at)

    def _bare(self, at: int) -> None:
        self._fault(at, "bare bracket")
        if len(self.tree.open) > 1:
            self.tree.add("<")

    def _local(self, name: str, at: int) -> str:
        prefix, _, local = name.rpartition(":")
        if prefix and prefix not in self.prefixes:
            self._fault(at, "undeclared prefix")
        return local

    def _end(self, name: str, at: int) -> None:
        opened = self.tree.open
        k = next((i for i in range(len(opened) - 1, 0, -1) if opened[i].name == name), 0)
        if not k:
            self._fault(at, "stray end")
            return
        if k < len(opened) - 1:
            self._fault(at, "wrong nesting")
        del opened[k:]
        self.ended = self.ended or k == 1
        self.tree.part()

    def _attributes(self, text: str, at: int) -> dict[str, str]:
        out, end = {}, 0
        for m in _ATTRIBUTE.finditer(text):
            value = m["a"] if m["a"] is not None else m["b"]
            name = m["name"]
            self._rest(text[end:m.start()], at + end)
            if name in out:
                self._fault(at + m.start("name"), "bad attribute")
            if not name.startswith("xmlns"):
                out.setdefault(self._local(name, at + m.start("name")), self._text(value, at + m.end() - len(value) - 1))
            end = m.end()
        self._rest(text[end:], at + end)
        return out

    def _rest(self, text: str, at: int) -> None:
        """What is no attribute."""
        if text.strip():
            self._fault(at + len(text) - len(text.lstrip()), "bad attribute")

    def _text(self, text: str, at: int) -> str:
        """Characters of a text with references."""
        out, end = [], 0
        for m in _REFERENCE.finditer(text):
            out.append(self._characters(text[end:m.start()], at + end))
            end = m.end()
            name = m["name"]
            if m["number"] or m["hex"]:
                code = int(m["number"] or m["hex"], 10 if m["number"] else 16)
                good = code <= 0x10FFFF and not 0xD800 <= code < 0xE000 and not _CONTROL.match(chr(code))
                if not good:
                    self._fault(at + m.start(), "control character")
                out.append(chr(code) if good else "")
            elif name in _OWN:
                out.append(_OWN[name])
            elif name:
                self._fault(at + m.start(), "undeclared entity")
                out.append(html5.get(name + ";", ""))
            else:
                self._fault(at + m.start(), "bare ampersand")
                out.append("&")
        return "".join([*out, self._characters(text[end:], at + end)])

    def _characters(self, text: str, at: int) -> str:
        if text.isprintable():
            return text
        for m in _CONTROL.finditer(text):
            self._fault(at + m.start(), "control character")
        for m in _BYTE.finditer(text):
            self._fault(at + m.start(), "bad byte")
        return _BYTE.sub("\ufffd", _CONTROL.sub("", text))

    def faults(self) -> list[tuple[int, str]]:
        """(byte, rule) in order."""
        out, at, byte = [], 0, 0
        for place, rule in sorted(self.found):
            byte += len(self.text[at:place].encode("utf-8", "surrogateescape"))
            at = place
            out.append((byte, rule))
        return out


def recovered(data: bytes | str) -> tuple[Node | None, list[tuple[int, str]]]:
    """The root element of an article, or null where there is none, and the faults in it as (byte, rule)."""
    try:
        parser = ElementTree.XMLParser(target=_Strict())
        parser.feed(data)
        return parser.close(), []
    except (ElementTree.ParseError, ValueError, LookupError):
        raw = data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data
        found = _Recovering(raw.decode("utf-8", "surrogateescape"))
        return found.tree.root(), found.faults()


def parse(data: bytes | str, html: bool = False) -> Node | None:
    """The root element of a document, or null where there is none."""
    if not html:
        return recovered(data)[0]
    text = data.decode("utf-8", "replace") if isinstance(data, bytes) else data
    page = _Page()
    page.feed(re.sub(r"<[^<>]*\Z", "", text))  # a tag that is cut off is no text
    page.close()
    return page.tree.root()


#: The labelled texts of an article: element names and the attribute that tells their kind.
SLOTS = {"article-title": "", "article-id": "pub-id-type", "abstract": "abstract-type", "kwd": "", "body": ""}
Field = tuple[str, str, str]


def _heading(node: Node) -> str:
    return next((c.text() for c in node.elements() if c.name == "title"), "")


def article_fields(data: bytes | str | None) -> list[Field]:
    """(slot, kind, text) of an article's labelled elements in document order, found in one walk.

    An id's text is that before its first element.  The first body gives a `section` for each of its own sections,
    or one for all of it; a section's kind is its heading.
    """
    root = parse(data) if data else None
    out: list[Field] = []
    bodies = 0
    for node in root.walk() if root is not None else ():
        if node.name not in SLOTS:
            continue
        kind = node.attributes.get(SLOTS[node.name], "")
        if node.name == "article-id":
            out.append((node.name, kind, "".join(c for c in node.children[:1] if isinstance(c, str)).strip()))
        elif node.name == "body":
            bodies += 1
            if bodies == 1:
                out += [("section", _heading(s) if s is not node else "", s.text()) for s in [c for c in node.elements() if c.name == "sec"] or [node]]
        else:
            out.append((node.name, kind, node.text()))
    return out


_UNSEEN = {"script", "style", "title", "head"}


def page_fields(data: str | None) -> list[Field]:
    """The same of a web page: its title, and a `part` for each heading with the text up to the next one."""
    root = parse(data, html=True) if data else None
    if root is None:
        return []
    out: list[Field] = [("article-title", "", n.text()) for n in root.walk() if n.name == "title"][:1]
    body = next((n for n in root.walk() if n.name == "body"), root)
    parts: list[tuple[str, list[str]]] = [("", [])]
    stack: list[Node | str] = [body]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts[-1][1].append(x)
        elif re.fullmatch("h[1-6]", x.name):
            parts.append((x.text(), []))
        elif x.name not in _UNSEEN:
            stack += reversed(x.children)
    return out + [("part", head, re.sub(r"\s+", " ", " ".join(pieces)).strip()) for head, pieces in parts]

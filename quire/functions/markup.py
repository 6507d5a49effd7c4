"""State machines over markup, in Python: tokens, the sanitiser, plain text, XML trees."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.schema import ALLOWED_TAGS, DROPPED_TAGS, GLOBAL_ATTRIBUTES, TAG_ATTRIBUTES, VOID_TAGS

ALLOWED, DROPPED, VOID = frozenset(ALLOWED_TAGS), frozenset(DROPPED_TAGS), frozenset(VOID_TAGS)
BLOCKS = frozenset("p div li h1 h2 h3 h4 h5 h6 blockquote tr figcaption dd dt".split())
JS_SPACE = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>[^>]*)>|(?P<text><[^>]*>|<[^>]*\Z|[^<]+)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
_ENTITY = re.compile(r"&(?:#[xX]([0-9A-Fa-f]+)|#([0-9]+)|(amp|lt|gt|quot|apos|nbsp));", re.I)


def decode_entities(text: str) -> str:
    """The six named entities and numeric ones, once; others, and numbers beyond Unicode, stay as they are."""

    def one(m: re.Match) -> str:
        if m[3]:
            return _NAMED[m[3].lower()]
        n = int(m[1], 16) if m[1] else int(m[2])
        return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]

    return _ENTITY.sub(one, text)


def escape_text(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attribute(text: str) -> str:
    return escape_text(text).replace('"', "&quot;")


def tokens(html: str) -> Iterator[tuple]:
    """("text", value), ("open", tag, attributes, self-closing) and ("close", tag). A tag ends at the first >;
    comments and declarations are left out; < without a name is text."""
    for m in _TOKEN.finditer(html):
        if m["tag"]:
            if m["close"]:
                yield "close", m["tag"].lower()
            else:
                rest = m["rest"]
                yield "open", m["tag"].lower(), attributes(rest), rest.rstrip().endswith("/")
        elif m["text"]:
            yield "text", m["text"]


def attributes(rest: str) -> list[tuple[str, str]]:
    return [(m[1].lower(), decode_entities(next((g for g in m.groups()[1:] if g is not None), ""))) for m in _ATTRIBUTE.finditer(rest)]


def kept(found: Iterator[tuple]) -> Iterator[tuple]:
    """Tokens outside elements that are dropped with their content; depth counts the same tag only."""
    tag, depth = None, 0
    for t in found:
        if tag is None:
            if t[0] == "open" and t[1] in DROPPED:
                if not t[3]:
                    tag, depth = t[1], 1
            elif t[0] != "close" or t[1] not in DROPPED:
                yield t
        elif t[0] != "text" and t[1] == tag:
            depth += (1 if not t[3] else 0) if t[0] == "open" else -1
            if not depth:
                tag = None


def allowed(tag: str, name: str) -> bool:
    return name in GLOBAL_ATTRIBUTES or name in TAG_ATTRIBUTES.get(tag, ())


def tag_text(tag: str, attrs: list[tuple[str, str]], void: bool = False) -> str:
    return f"<{tag}{''.join(f' {k}="{escape_attribute(v)}"' for k, v in attrs)}{' /' if void else ''}>"


def sanitize(html: str) -> str:
    """The restricted HTML: other tags are unwrapped, other attributes left out; nothing is balanced."""
    out = []
    for t in kept(tokens(html)):
        if t[0] == "text":
            out.append(escape_text(decode_entities(t[1])))
        elif t[1] in ALLOWED:
            if t[0] == "open":
                out.append(tag_text(t[1], [(k, v) for k, v in t[2] if allowed(t[1], k)], t[1] in VOID))
            elif t[1] not in VOID:
                out.append(f"</{t[1]}>")
    return "".join(out)


def plain_text(html: str) -> str:
    out = []
    for t in kept(tokens(html)):
        if t[0] == "text":
            out.append(decode_entities(t[1]))
        elif t[1] == "br" or (t[0] == "close" and t[1] in BLOCKS):
            out.append("\n")
    return re.sub(r"\n{3,}", "\n\n", re.sub("[ \t\u00a0]+", " ", "".join(out))).strip(JS_SPACE)


def character_count(html: str) -> int:
    return sum(2 if c > "\uffff" else 1 for c in plain_text(html) if c not in JS_SPACE)


def is_external(href: str) -> bool:
    return bool(re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//", href))


def rewritten(html: str, change) -> str:
    """html with every opening tag passed through change(tag, attributes), which gives attributes, or None to unwrap
    the element, or "" to remove a void one."""
    out, closed = [], []
    for t in tokens(html):
        if t[0] == "text":
            out.append(t[1])
        elif t[0] == "open":
            attrs = change(t[1], t[2])
            if t[1] not in VOID and not t[3]:
                closed.append((t[1], attrs is not None))
            if attrs is not None and attrs != "":
                out.append(tag_text(t[1], attrs, t[1] in VOID or t[3]))
        else:
            k = next((i for i in range(len(closed) - 1, -1, -1) if closed[i][0] == t[1]), None)
            if k is None or closed.pop(k)[1]:
                out.append(f"</{t[1]}>")
    return "".join(out)


# XML, leniently


class Node:
    """name without prefix, attributes by full and local name, children (nodes and strings)."""

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def all(self, *names: str) -> Iterator[Node]:
        """The outermost elements of these names."""
        for c in self.children:
            if isinstance(c, Node):
                if c.name in names:
                    yield c
                else:
                    yield from c.all(*names)

    def first(self, *names: str) -> Node | None:
        return next(self.all(*names), None)

    @property
    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text for c in self.children)

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)


_XML = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[A-Za-z_][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)", re.S)


def xml(text: str) -> Node:
    """A tree of whatever the text holds; elements left open end with what holds them."""
    root = Node("", {})
    stack = [root]
    for m in _XML.finditer(text):
        if m["tag"]:
            name = m["tag"].rpartition(":")[2]
            if m["close"]:
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
                if k:
                    del stack[k:]
                continue
            attrs = {}
            for a in re.finditer(r"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", m["rest"]):
                value = _html.unescape(a[2] if a[2] is not None else a[3])
                attrs[a[1]] = value
                attrs.setdefault(a[1].rpartition(":")[2], value)
            node = Node(name, attrs)
            stack[-1].children.append(node)
            if not m["rest"].endswith("/"):
                stack.append(node)
        elif m["data"] is not None:
            stack[-1].children.append(m["data"])
        elif m["text"]:
            stack[-1].children.append(_html.unescape(m["text"]))
    return root


# Columns


def _column(f, kind: str):
    def batches(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda x: None if x is None else f(x))

    batches.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(batches, kind)


def sanitize_column(html: Column) -> Column:
    return _column(sanitize, "string")(html)


def plain_text_column(html: Column) -> Column:
    """Exact on any input, also where dropped elements are nested or left open."""
    return _column(plain_text, "string")(html)

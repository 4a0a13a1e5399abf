"""Front matter: a subset of YAML, read by indentation, and lists in it rewritten with all else left as it is.

Block and flow maps and lists, plain and quoted scalars, literal and folded blocks, and comments are read; scalars stay strings, but for
null. Anchors, aliases, tags, several documents and keys that aren't scalars are not read: such a text, and any that isn't
well formed, is None as a whole.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD = re.compile(r"\A---[ \t]*\r?\n(?:([\s\S]*?)\r?\n)??---[ \t]*(?:\r?\n|\Z)")
KEY = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s#&*!|>%@`"'{}\[\],?:-][^#:\n]*?|[^\s#&*!|>%@`"'{}\[\],][^:#\n]*?)[ \t]*:(?=[ \t]|$)""")
NULLS = ("", "~", "null", "Null", "NULL")


class Malformed(ValueError):
    pass


def split(text: str) -> tuple[str, str] | None:
    """Front matter and the rest of a document; None without front matter."""
    m = HEAD.match(text)
    return (m[1] or "", text[m.end() :]) if m else None


def uncommented(s: str) -> str:
    """A line without a comment, which is a # at its start or after a space, outside of quotes."""
    quote = None
    for i, c in enumerate(s):
        if quote:
            quote = None if c == quote and (quote == "'" or s[i - 1] != "\\") else quote
        elif c in "\"'" and (i == 0 or s[i - 1] in " \t[{,:-"):
            quote = c
        elif c == "#" and (i == 0 or s[i - 1] in " \t"):
            return s[:i].rstrip()
    return s.rstrip()


def scalar(s: str) -> str | None:
    s = s.strip()
    if s[:1] == '"':
        if not re.fullmatch(r'"(?:\\.|[^"\\])*"', s):
            raise Malformed(s)
        named = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "e": "\x1b", "b": "\b"}
        return re.sub(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else named.get(m[3], m[3]), s[1:-1])
    if s[:1] == "'":
        if not re.fullmatch(r"'(?:''|[^'])*'", s):
            raise Malformed(s)
        return s[1:-1].replace("''", "'")
    if s[:1] in tuple("&*!%@`|>") or ": " in s or s.endswith(":"):
        raise Malformed(s)
    return None if s in NULLS else s


def flow(s: str, i: int) -> tuple[object, int]:
    """The flow value at i and what comes after it."""
    while s[i : i + 1].isspace():
        i += 1
    if s[i : i + 1] in ("[", "{"):
        close, out, pairs = {"[": "]", "{": "}"}[s[i]], [], {}
        many = s[i] == "["
        i += 1
        while True:
            while s[i : i + 1].isspace():
                i += 1
            if i >= len(s):
                raise Malformed(s)
            if s[i] == close:
                return (out if many else pairs), i + 1
            if many:
                value, i = flow(s, i)
                out.append(value)
            else:
                m = re.compile(r"""\s*("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^,{}\[\]:]+?)\s*(?::(?=[\s"'\[{])|(?=[,}]))""").match(s, i)
                if not m:
                    raise Malformed(s)
                i = m.end()
                value = None
                if s[i - 1] == ":":
                    value, i = flow(s, i)
                pairs[scalar(m[1]) or ""] = value
            while s[i : i + 1].isspace():
                i += 1
            if s[i : i + 1] == ",":
                i += 1
            elif s[i : i + 1] != close:
                raise Malformed(s)
    m = re.compile(r"""\s*("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^,\[\]{}]*)""").match(s, i)
    return scalar(m[1]), m.end()


class Front:
    """Reads lines; top holds for each key of the outermost map its first line and the one after its last."""

    def __init__(self, text: str):
        self.raw = text.split("\n")
        self.lines = [s.rstrip("\r") for s in self.raw]
        self.i = 0
        self.top: dict[str, tuple[int, int]] = {}

    def peek(self) -> tuple[int, str] | None:
        """Indentation and content of the next line that has any."""
        while self.i < len(self.lines):
            s = uncommented(self.lines[self.i])
            if s.strip():
                body = s.lstrip(" ")
                if body[0] == "\t":
                    raise Malformed(s)
                return len(s) - len(body), body
            self.i += 1
        return None

    def document(self) -> dict:
        now = self.peek()
        if now is None:
            return {}
        value = self.block(now[0], True)
        if self.peek() is not None or not isinstance(value, dict):
            raise Malformed(self.lines[min(self.i, len(self.lines) - 1)])
        return value

    def block(self, indent: int, top: bool = False) -> object:
        now = self.peek()
        return self.items(indent) if re.match(r"-(?:\s|$)", now[1]) else self.pairs(indent, top)

    def items(self, indent: int) -> list:
        out: list = []
        while (now := self.peek()) and now[0] == indent and re.match(r"-(?:\s|$)", now[1]):
            rest = now[1][1:].lstrip(" ")
            if not rest:
                self.i += 1
                after = self.peek()
                out.append(self.block(after[0]) if after and after[0] > indent else None)
            else:
                # what stands after the dash is a block of its own, indented to where it begins
                inner = indent + len(now[1]) - len(rest)
                if re.match(r"-\s", rest) or KEY.match(rest):
                    self.lines[self.i] = " " * inner + rest
                    out.append(self.block(inner))
                else:
                    out.append(self.value(rest, indent))
        if now and now[0] > indent:
            raise Malformed(now[1])
        return out

    def pairs(self, indent: int, top: bool = False) -> dict:
        out: dict = {}
        while (now := self.peek()) and now[0] == indent:
            m = KEY.match(now[1])
            if not m or re.match(r"-\s", now[1]):
                raise Malformed(now[1])
            key, first = scalar(m[1]), self.i
            if key is None or key in out:
                raise Malformed(now[1])
            rest = now[1][m.end() :].strip()
            if rest:
                out[key] = self.value(rest, indent)
            else:
                self.i += 1
                after = self.peek()
                inside = after and (after[0] > indent or after[0] == indent and re.match(r"-(?:\s|$)", after[1]))
                out[key] = self.block(after[0]) if inside else None
            if top:
                self.top[key] = (first, self.i)
        if now and now[0] > indent:
            raise Malformed(now[1])
        return out

    def value(self, rest: str, indent: int) -> object:
        """A value that begins on this line."""
        if m := re.fullmatch(r"([|>])([+-]?)", rest):
            return self.text(m[1], m[2], indent)
        self.i += 1
        if rest[0] in "[{":
            # a flow value may go on over lines
            while True:
                try:
                    value, end = flow(rest, 0)
                    break
                except Malformed:
                    if self.i >= len(self.lines):
                        raise
                    rest += " " + uncommented(self.lines[self.i]).strip()
                    self.i += 1
            if rest[end:].strip():
                raise Malformed(rest)
            return value
        while rest[0] not in "\"'" and (after := self.peek()) and after[0] > indent:
            # a plain scalar that goes on
            if KEY.match(after[1]) or re.match(r"-\s", after[1]):
                raise Malformed(after[1])
            rest += " " + after[1].strip()
            self.i += 1
        return scalar(rest)

    def text(self, style: str, end: str, indent: int) -> str:
        self.i += 1
        held: list[str] = []
        while self.i < len(self.lines) and (not self.lines[self.i].strip() or len(self.lines[self.i]) - len(self.lines[self.i].lstrip(" ")) > indent):
            held.append(self.lines[self.i])
            self.i += 1
        margin = min((len(s) - len(s.lstrip(" ")) for s in held if s.strip()), default=0)
        body = "\n".join(s[margin:] for s in held).rstrip("\n")
        body = body if style == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", body).replace("\n\n", "\n")
        return body if end == "-" or not body else body + "\n"


def parse(text: str | None) -> dict | None:
    """The map that front matter holds; None where it isn't well formed, or is no map."""
    if text is None:
        return None
    try:
        return Front(text).document()
    except (Malformed, RecursionError, IndexError):
        return None


def read(document: str | None) -> dict | None:
    """The front matter of a whole document; None without any, or where it isn't well formed."""
    found = split(document) if document is not None else None
    return parse(found[0]) if found else None


def entries(value: object, fields: tuple[str, ...], must: tuple[str, ...]) -> list[tuple] | None:
    """The fields of a list of maps; None as a whole if the value is no list, or any entry is no map with scalars for all of must."""
    if not isinstance(value, list):
        return None
    out = []
    for x in value:
        if not isinstance(x, dict) or any(not isinstance(x.get(f), str) or not x[f] for f in must):
            return None
        out.append(tuple(x.get(f) if isinstance(x.get(f), str) else None for f in fields))
    return out


def quoted(s: str) -> str:
    return s if re.fullmatch(r"[A-Za-z0-9_./:@-]*[A-Za-z0-9_./@-]", s) and s not in NULLS and s[0] not in "-@:" else '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def with_list(document: str, key: str, rows: list[dict[str, str]]) -> str:
    """The document with key's list in its front matter replaced, or put at its end; every other byte stays. Without front matter that is well formed it stays whole."""
    found = split(document)
    if found is None or parse(found[0]) is None:
        return document
    f = Front(found[0])
    f.document()
    end = "\r\n" if "\r\n" in document[: document.find("\n") + 1] else "\n"
    made = [f"{key}:", *[("  - " if k == 0 else "    ") + f"{name}: {quoted(value)}" for row in rows for k, (name, value) in enumerate(row.items())]] if rows else [f"{key}: []"]
    tail = end[:-1]
    # the last line's own carriage return stands before the closing dashes
    lines = (found[0] + tail).split("\n") if found[0] else []
    a, z = f.top.get(key, (len(lines), len(lines)))
    # blank lines and comments after a list are not its own
    while z > a and not uncommented(lines[z - 1].rstrip("\r")).strip():
        z -= 1
    lines[a:z] = [s + tail for s in made]
    start, body = document.index("\n") + 1, "\n".join(lines)
    return document[:start] + (body + "\n" + document[start:] if not found[0] else body.removesuffix(tail) + document[start + len(found[0]) :])

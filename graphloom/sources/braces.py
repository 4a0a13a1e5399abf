"""TypeScript, JavaScript and Rust: a lexer with states, and declarations, calls and imports read from its tokens.

One pass over the characters gives tokens and comments; brackets are matched once; declarations are then read by recursive descent.
All of it takes time in proportion to the file.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from typing import NamedTuple

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Token(NamedTuple):
    kind: str  # word, str, num, re, op, jsx (a run of an element's own characters)
    text: str
    start: int
    end: int


WORD = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")
NUMBER = re.compile(r"\d[\w.]*")
OPERATOR = re.compile(r"=>|->|::|\.\.\.|\?\.|===|!==|==|!=|&&|\|\||\?\?|[^\s]")
SPACE = re.compile(r"\s+")
REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
RAW = re.compile(r'b?r(#*)"')
CHARACTER = re.compile(r"b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^\\'\n])'", re.S)
#: Words after which an expression begins, so that a slash opens a regular expression and a less-than sign an element.
BEFORE = frozenset("return typeof case in of new delete void throw else do await yield default instanceof extends".split())


class Lexer:
    """tokens and comments (start, end) of a text; unterminated strings and the like end with the line or the text."""

    def __init__(self, text: str, rust: bool = False, elements: bool = False):
        self.text, self.rust, self.elements = text, rust, elements
        self.tokens: list[Token] = []
        self.comments: list[tuple[int, int]] = []
        # what is open: code in braces, a template, an element's tag or its children
        self.open: list[str] = []
        self.heads: list[str] = []  # the word before each open parenthesis
        self.closed = ""  # that of the last one closed
        at = 0
        while at < len(text):
            mode = self.open[-1] if self.open else "code"
            at = {"code": self.code, "template": self.template, "tag": self.tag, "children": self.children}[mode](at)

    def put(self, kind: str, start: int, end: int) -> int:
        self.tokens.append(Token(kind, self.text[start:end], start, end))
        return end

    def expects(self) -> bool:
        """Whether an expression may begin here."""
        if not self.tokens:
            return True
        t = self.tokens[-1]
        if t.kind == "word":
            return t.text in BEFORE
        if t.text == ")":
            return self.closed in ("if", "while", "for", "with")
        return t.kind == "op" and t.text not in ("]", "}", "++", "--")

    def quoted(self, at: int, quote: str, lines: bool) -> int:
        k = at + 1
        while k < len(self.text) and self.text[k] != quote and (lines or self.text[k] != "\n"):
            k += 2 if self.text[k] == "\\" else 1
        return self.put("str", at, min(k + 1, len(self.text)))

    def comment(self, at: int) -> int | None:
        t = self.text
        if t.startswith("//", at):
            end = t.find("\n", at)
            end = len(t) if end < 0 else end
        elif t.startswith("/*", at):
            end, depth = at + 2, 1
            while depth:
                close, inner = t.find("*/", end), t.find("/*", end) if self.rust else -1
                if close < 0:
                    end, depth = len(t), 0
                elif 0 <= inner < close:
                    end, depth = inner + 2, depth + 1
                else:
                    end, depth = close + 2, depth - 1
        else:
            return None
        self.comments.append((at, end))
        return end

    def code(self, at: int) -> int:
        t, c = self.text, self.text[at]
        if m := SPACE.match(t, at):
            return m.end()
        if c == "/" and (end := self.comment(at)) is not None:
            return end
        if self.rust:
            if m := RAW.match(t, at):
                end = t.find('"' + m[1], m.end())
                return self.put("str", at, len(t) if end < 0 else end + 1 + len(m[1]))
            if c in "'b" and (m := CHARACTER.match(t, at)):
                return self.put("str", at, m.end())
            if c == "'" and (m := WORD.match(t, at + 1)):  # a lifetime
                return self.put("op", at, m.end())
        if c in "\"'":
            return self.quoted(at, c, self.rust)
        if not self.rust:
            if c == "`":
                self.open.append("template")
                return self.put("str", at, at + 1)
            if c == "/" and self.expects() and (m := REGEX.match(t, at)):
                return self.put("re", at, m.end())
            if c == "<" and self.elements and self.expects() and re.match(r"<(>|[A-Za-z][\w.\-:]*(?![\w.\-:])(?!\s*,|\s+extends\b))", t[at : at + 200]):
                self.open.append("tag")
                return self.put("jsx", at, at + 1)
        if m := WORD.match(t, at):
            return self.put("word", at, m.end())
        if m := NUMBER.match(t, at):
            # a range, as in 0..n, is no part of a number
            return self.put("num", at, m.start() + len(re.split(r"\.\.", m[0])[0]))
        end = OPERATOR.match(t, at).end()
        if c == "{":
            self.open.append("code")
        elif c == "}" and self.open:
            self.open.pop()
        elif c == "(":
            self.heads.append(self.tokens[-1].text if self.tokens else "")
        elif c == ")" and self.heads:
            self.closed = self.heads.pop()
        return self.put("op", at, end)

    def template(self, at: int) -> int:
        t, k = self.text, at
        while k < len(t) and t[k] != "`" and not t.startswith("${", k):
            k += 2 if t[k] == "\\" else 1
        k = min(k, len(t))
        if k > at:
            self.put("str", at, k)
        if k < len(t) and t[k] == "`":
            self.open.pop()
            return self.put("str", k, k + 1)
        if k < len(t):
            self.open.append("code")
            self.put("op", k, k + 1)
            return self.put("op", k + 1, k + 2)
        return k

    def tag(self, at: int) -> int:
        t, c = self.text, self.text[at]
        if m := SPACE.match(t, at):
            return m.end()
        if c == "{":
            self.open.append("code")
            return self.put("op", at, at + 1)
        if c in "\"'":
            return self.quoted(at, c, True)
        if t.startswith("/>", at):
            self.open.pop()
            return self.put("jsx", at, at + 2)
        if c == ">":
            closing = self.open.pop() == "closing"
            if not closing:
                self.open.append("children")
            return self.put("jsx", at, at + 1)
        m = re.compile(r"[^\s{}\"'>/]+|.").match(t, at)
        return self.put("jsx", at, m.end())

    def children(self, at: int) -> int:
        t = self.text
        if t.startswith("</", at):
            end = t.find(">", at)
            self.open.pop()
            return self.put("jsx", at, len(t) if end < 0 else end + 1)
        if t[at] == "<":
            self.open.append("tag")
            return self.put("jsx", at, at + 1)
        if t[at] == "{":
            self.open.append("code")
            return self.put("op", at, at + 1)
        m = re.compile(r"[^<{]+").match(t, at)
        return m.end()


CLOSING = {"(": ")", "[": "]", "{": "}"}
#: What a route is called on, and the methods that make one.
ROUTERS, METHODS = ("app", "router"), ("get", "post", "put", "patch", "delete", "options", "head", "all")
#: Words before a bracket that are no calls.
NO_CALLS = frozenset("if for while switch catch return function typeof match fn super constructor await import require else loop".split())
MODIFIERS = frozenset("export default declare abstract async static public private protected override readonly accessor get set".split())
STARTS = frozenset("import export class interface enum type function const let var return if for while switch try throw namespace module abstract declare async do break continue".split())
PRIMITIVE = frozenset("Self self str bool char u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64".split())


class Reader:
    """What a file declares and refers to: node(kind, name, scope, start, end, doc, signature, flags) and ref(kind, name, scope, at)."""

    def __init__(self, text: str, lexer: Lexer):
        self.text, self.tok, self.comments = text, lexer.tokens, lexer.comments
        self.nodes: list[dict] = []
        self.refs: list[tuple[str, str, list[str], int]] = []
        self.ends = [e for _, e in self.comments]
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.tok):
            if t.kind == "op" and t.text in CLOSING:
                stack.append(i)
            elif t.kind == "op" and t.text in (")", "]", "}"):
                # an unmatched bracket inside is left out
                k = next((k for k in range(len(stack) - 1, max(-1, len(stack) - 8), -1) if CLOSING[self.tok[stack[k]].text] == t.text), None)
                if k is not None:
                    self.match[stack[k]] = i
                    del stack[k:]

    def line(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tok) and self.tok[i].kind in ("op", "word") and self.tok[i].text in texts

    def word(self, i: int) -> str | None:
        return self.tok[i].text if i < len(self.tok) and self.tok[i].kind == "word" else None

    def past(self, i: int) -> int:
        """After the bracket at i and what it holds."""
        return self.match.get(i, i) + 1

    def angles(self, i: int) -> int:
        """After the type arguments that begin at i, or i if these are none."""
        if not self.is_(i, "<"):
            return i
        depth, k = 0, i
        while k < min(len(self.tok), i + 400):
            if self.is_(k, "<"):
                depth += 1
            elif self.is_(k, ">"):
                depth -= 1
                if not depth:
                    return k + 1
            elif self.is_(k, "(", "[", "{"):
                k = self.match.get(k, k)
            elif self.is_(k, ";", ")", "}", "&&", "||"):
                return i
            k += 1
        return i

    def doc(self, start: int) -> str | None:
        """The comments right before a place, without their marks."""
        found, k = [], bisect_right(self.ends, start) - 1
        while k >= 0 and not self.text[self.comments[k][1] : start].strip():
            start = self.comments[k][0]
            found.append(self.text[start : self.comments[k][1]])
            k -= 1
        if not found:
            return None
        plain = []
        for c in reversed(found):
            body = re.sub(r"^/\*+!?|\*+/$", "", c) if c.startswith("/*") else re.sub(r"^//[/!]?", "", c)
            plain += [re.sub(r"^\s*\*?\s?", "", x) if c.startswith("/*") else x.strip() for x in body.split("\n")]
        return "\n".join(plain).strip() or None

    def add(self, kind: str, name: str, scope: list[str], first: int, last: int, stop: int | None = None, **flags) -> None:
        """A node from token first to token last; its signature ends before token stop."""
        a, z = self.tok[first].start, self.tok[min(last, len(self.tok) - 1)].end
        end = self.tok[min(stop, len(self.tok) - 1)].start if stop is not None else z
        self.nodes.append({"kind": kind, "name": name, "scope": list(scope), "start_line": self.line(a), "end_line": self.line(max(a, z - 1)), "docstring": self.doc(a), "signature": " ".join(self.text[a:end].split()), **flags})

    def refer(self, kind: str, name: str, scope: list[str], i: int) -> None:
        self.refs.append((kind, name, list(scope), self.line(self.tok[i].start)))

    def path(self, i: int, joints: tuple[str, ...]) -> tuple[str, int]:
        """The dotted name that begins at i, and what comes after it."""
        name, k = self.tok[i].text, i + 1
        while self.is_(k, *joints) and self.word(k + 1):
            name += ("." if self.tok[k].text == "?." else self.tok[k].text) + self.tok[k + 1].text
            k += 2
        return name, k

    def type_end(self, i: int, end: int) -> int:
        """After the type that begins at i: where a bracket or a mark can't belong to it any more."""
        whole = False
        while i < end:
            t = self.tok[i]
            if self.is_(i, "(", "[") or self.is_(i, "{") and not whole:
                i, whole = self.past(i), True
            elif self.is_(i, "<"):
                k = self.angles(i)
                if k == i:
                    return i
                i, whole = k, True
            elif self.is_(i, "|", "&", "=>", ".", "::", "?.", "+", "*", "?", ":") or t.kind == "word" and t.text in ("is", "keyof", "typeof", "readonly", "extends", "infer", "asserts", "unique", "dyn", "impl", "mut", "new", "for"):
                i, whole = i + 1, False
            elif t.kind in ("word", "str", "num") and (not whole or not self.fresh(i) and t.kind != "word"):
                i, whole = i + 1, True
            elif t.kind == "op" and (t.text == "-" or t.text[0] == "'" or t.text == "!" and not whole):
                i += 1
            else:
                return i
        return i

    def fresh(self, i: int) -> bool:
        """Whether token i is the first of its line."""
        return 0 < i < len(self.tok) and "\n" in self.text[self.tok[i - 1].end : self.tok[i].start]

    # TypeScript and JavaScript

    def statement_end(self, i: int, end: int, comma: bool = False) -> int:
        """After the expression that begins at i: at a semicolon, or a line that begins a statement."""
        begun = i
        while i < end:
            if self.is_(i, ";") or comma and self.is_(i, ","):
                return i
            if i > begun and self.fresh(i):
                p, t = self.tok[i - 1], self.tok[i]
                over = p.kind in ("word", "str", "num", "re", "jsx") and p.text not in BEFORE or p.text in (")", "]", "}")
                if over and (t.kind in ("word", "num") and t.text not in ("in", "of", "instanceof", "as", "satisfies") or t.text in ("@", "#", "{", "[") and comma):
                    return i
            i = self.past(i) if self.is_(i, "(", "[", "{") else i + 1
        return end

    def function_head(self, i: int, end: int) -> tuple[int, str | None] | None:
        """For parameters at i: where the body or the arrow stands, and the return type."""
        i = self.angles(i)
        if not self.is_(i, "(") or i not in self.match:
            return None
        i, kind = self.past(i), None
        if self.is_(i, ":"):
            k = self.type_end(i + 1, end)
            kind = " ".join(self.text[self.tok[i + 1].start : self.tok[k - 1].end].split()) if k > i + 1 else None
            i = k
        return i, kind

    def value(self, i: int, end: int) -> tuple[int, bool, str | None] | None:
        """If a function is written at i: where its body begins, whether it is async, its return type."""
        is_async = self.is_(i, "async") and not self.fresh(i + 1)
        i += is_async
        if self.is_(i, "function"):
            i += 1 + self.is_(i + 1, "*")
            i += bool(self.word(i))
            head = self.function_head(i, end)
            return (head[0], is_async, head[1]) if head and self.is_(head[0], "{") else None
        if self.word(i) and self.is_(i + 1, "=>"):
            return i + 2, is_async, None
        k = self.angles(i)
        if self.is_(k, "(") and k in self.match:
            after = self.match[k] + 1
            if self.is_(after, "=>"):
                return after + 1, is_async, None
            if self.is_(after, ":") and (head := self.function_head(k, min(end, after + 200))) and self.is_(head[0], "=>"):
                return head[0] + 1, is_async, head[1]
            # the type of an arrow function may have been taken for its end
            if self.is_(after, ":"):
                stop = next((x for x in range(after, min(end, after + 60)) if self.is_(x, "=>", ";", ",")), end)
                if self.is_(stop, "=>"):
                    return stop + 1, is_async, " ".join(self.text[self.tok[after + 1].start : self.tok[stop - 1].end].split())
        return None

    def body(self, i: int, end: int, scope: list[str]) -> int:
        """Walk a function's body, a block or an expression; what comes after it."""
        stop = self.past(i) if self.is_(i, "{") else self.statement_end(i, end, comma=True)
        self.script(i + self.is_(i, "{"), stop - self.is_(i, "{"), scope, False)
        return stop

    def script(self, i: int, end: int, scope: list[str], top: bool) -> None:
        """Statements from i to end; top: at the level of the module, where variables count."""
        first, flags = None, set()
        while i < end:
            t = self.tok[i]
            if t.kind == "op" and t.text == "@" and self.word(i + 1):
                first = i if first is None else first
                name, k = self.path(i + 1, (".",))
                self.refer("decorates", name, scope, i)
                self.script(k, self.past(k), scope, False) if self.is_(k, "(") else None
                i = self.past(k) if self.is_(k, "(") else k
                continue
            if t.kind != "word" or self.is_(i - 1, ".", "?."):
                if t.kind == "word":
                    i = self.called(i, end, scope)
                else:
                    i, first, flags = i + 1, None, set()
                continue
            if t.text in MODIFIERS and i + 1 < end and (self.word(i + 1) or self.is_(i + 1, "{", "*", "@") and t.text == "export"):
                if t.text == "export" and self.is_(i + 1, "{", "*") or t.text == "export" and self.is_(i + 1, "type") and self.is_(i + 2, "{", "*"):
                    i = self.imported(i, end)
                    continue
                first = i if first is None else first
                flags.add(t.text)
                i += 1
                continue
            start, k = i if first is None else first, None
            exported = "export" in flags
            if t.text == "import" and not self.is_(i + 1, "."):
                i = self.imported(i, end)
            elif t.text == "class":
                i = self.class_(i, end, scope, start, exported, "abstract" in flags)
            elif t.text == "interface" and self.word(i + 1):
                k = self.heritage(i + 2, end, [*scope, self.tok[i + 1].text])
                self.add("interface", self.tok[i + 1].text, scope, start, self.match.get(k, k), k, is_exported=exported)
                i = self.past(k)
            elif t.text == "enum" and self.word(i + 1) and self.is_(i + 2, "{"):
                self.enum(i, scope, start, exported)
                i = self.past(i + 2)
            elif t.text == "type" and self.word(i + 1) and self.is_(self.angles(i + 2), "="):
                k = self.type_end(self.angles(i + 2) + 1, end)
                self.add("type_alias", self.tok[i + 1].text, scope, start, k - 1, is_exported=exported)
                i = max(k, i + 3)
            elif t.text in ("namespace", "module") and self.word(i + 1) and self.is_(i + 2, "{"):
                self.script(i + 3, self.match.get(i + 2, end), [*scope, self.tok[i + 1].text], top)
                i = self.past(i + 2)
            elif t.text == "function":
                k = i + 1 + self.is_(i + 1, "*")
                name = self.word(k)
                head = self.function_head(k + bool(name), end)
                if head and name:
                    stop = self.match.get(head[0], head[0]) if self.is_(head[0], "{") else head[0] - 1
                    self.add("function", name, scope, start, stop, head[0], is_exported=exported, is_async="async" in flags, return_type=head[1])
                    self.script(self.angles(k + 1), head[0], scope, False)
                if head and self.is_(head[0], "{"):
                    i = self.body(head[0], end, [*scope, name] if name else scope)
                else:
                    i = head[0] if head else k
            elif t.text in ("const", "let", "var") and not self.is_(i + 1, "enum"):
                i = self.variables(i, end, scope, start, exported, top)
            elif t.text == "const":
                i += 1
                continue
            else:
                i = self.called(i, end, scope)
            first, flags = None, set()

    def called(self, i: int, end: int, scope: list[str]) -> int:
        """A name: a call, a construction, or neither; what comes after it."""
        made = self.is_(i, "new") and self.word(i + 1) is not None
        name, k = self.path(i + made, (".", "?."))
        last, after = name.split(".")[-1], self.angles(k)
        on = name.split(".")[-2:]
        if on[0] in ROUTERS and on[-1] in METHODS and self.is_(k, "(") and k + 1 < end and self.tok[k + 1].kind == "str":
            self.route(i, k + 1, on[-1])
        if made and last != "target":
            self.refer("instantiates", name, scope, i)
        elif self.is_(after if after < end else k, "(") and last not in NO_CALLS and last not in MODIFIERS - {"get", "set"}:
            self.refer("calls", name.removeprefix("this."), scope, i)
        elif last in ("import", "require") and self.is_(k, "(") and k + 1 < end and self.tok[k + 1].kind == "str":
            self.refer("imports", self.tok[k + 1].text.strip("\"'"), [], i)
        return k

    def route(self, i: int, k: int, method: str) -> None:
        """A route, if after its path, at k, a handler is named."""
        template = self.tok[k].text == "`" and k + 2 < len(self.tok) and self.tok[k + 2].text == "`"
        path, k = (self.tok[k + 1].text, k + 3) if template else (self.tok[k].text.strip("\"'"), k + 1)
        if path and self.is_(k, ",") and self.word(k + 1):
            name = f"{method.upper()} {path}"
            self.add("route", name, [], i, k + 1)
            self.refer("function_ref", self.tok[k + 1].text, [name], i)

    def imported(self, i: int, end: int) -> int:
        """An import, or an export from another module."""
        k = i + 1
        if self.is_(k, "("):
            return self.called(i, end, [])
        while k < end and not self.is_(k, ";", "="):
            if self.tok[k].kind == "str":
                self.refer("imports", self.tok[k].text.strip("\"'"), [], i)
                return k + 1
            if self.fresh(k) and self.tok[k].text in STARTS and k > i + 1:
                return k
            if self.is_(k, "}") and not self.is_(k + 1, "from"):
                return k + 1
            k = max(self.past(k) - 1, k + 1) if self.is_(k, "{") else k + 1
        return k

    def heritage(self, i: int, end: int, scope: list[str]) -> int:
        """References to what is extended and implemented; where the body's brace stands."""
        kind = None
        i = self.angles(i)
        while i < end and not self.is_(i, "{", ";"):
            if self.is_(i, "extends", "implements"):
                kind, i = self.tok[i].text, i + 1
            elif self.word(i) and kind:
                name, k = self.path(i, (".",))
                self.refer(kind, name, scope, i)
                i = self.angles(self.past(k) if self.is_(k, "(") else k)
            else:
                i += 1
        return i

    def class_(self, i: int, end: int, scope: list[str], start: int, exported: bool, abstract: bool) -> int:
        name = self.word(i + 1) if not self.is_(i + 1, "extends", "implements") else None
        k = self.heritage(i + 1 + bool(name), end, [*scope, name] if name else scope)
        if not self.is_(k, "{"):
            return k
        if name:
            self.add("class", name, scope, start, self.match.get(k, k), k, is_exported=exported, is_abstract=abstract)
        self.members(k + 1, self.match.get(k, end), [*scope, name] if name else scope)
        return self.past(k)

    def members(self, i: int, end: int, scope: list[str]) -> None:
        first, flags = None, set()
        while i < end:
            if self.is_(i, ";", ",", "*"):
                i += 1
                continue
            first = i if first is None else first
            if self.is_(i, "@") and self.word(i + 1):
                name, k = self.path(i + 1, (".",))
                self.refer("decorates", name, scope, i)
                i = self.past(k) if self.is_(k, "(") else k
                continue
            if self.word(i) in MODIFIERS and not self.is_(i + 1, "(", "=", ":", ";", "?", "!", "<", "}"):
                if self.is_(i, "static") and self.is_(i + 1, "{"):
                    i, first = self.body(i + 1, end, scope), None
                    continue
                flags.add(self.tok[i].text)
                i += 1
                continue
            i += self.is_(i, "#") and not self.fresh(i + 1)
            name = None
            if self.is_(i, "["):
                k = self.past(i)
            elif self.tok[i].kind in ("word", "str", "num"):
                name = ("#" if self.is_(i - 1, "#") else "") + self.tok[i].text.strip("\"'")
                k = i + 1
            else:
                i, first, flags = i + 1, None, set()
                continue
            seen = next((x for x in ("private", "protected", "public") if x in flags), "private" if name and name[0] == "#" else None)
            own = {"visibility": seen, "is_static": "static" in flags, "is_abstract": "abstract" in flags}
            k += self.is_(k, "?", "!")
            head = self.function_head(k, end) if self.is_(k, "(", "<") else None
            inner = [*scope, name] if name else scope
            if head:
                has = self.is_(head[0], "{")
                stop = self.match.get(head[0], head[0]) if has else head[0] - 1
                if name and (has or "abstract" in flags):
                    self.add("method", name, scope, first, stop, head[0], is_async="async" in flags, return_type=head[1], **own)
                i = self.body(head[0], end, inner) if has else max(head[0], i + 1)
            else:
                if self.is_(k, ":"):
                    k = self.type_end(k + 1, end)
                made = self.value(k + 1, end) if self.is_(k, "=") else None
                if made:
                    stop = self.body(made[0], end, inner)
                    if name:
                        self.add("method", name, scope, first, stop - 1, made[0], is_async=made[1], return_type=made[2], **own)
                else:
                    stop = self.statement_end(k, end, comma=True) if self.is_(k, "=") else k
                    self.script(k, stop, scope, False)
                    if name:
                        self.add("property", name, scope, first, max(first, stop - 1), **own)
                i = max(stop, i + 1)
            first, flags = None, set()

    def enum(self, i: int, scope: list[str], start: int, exported: bool) -> None:
        name, opened = self.tok[i + 1].text, i + 2
        self.add("enum", name, scope, start, self.match.get(opened, opened), opened, is_exported=exported)
        k, end = opened + 1, self.match.get(opened, opened)
        while k < end:
            if self.tok[k].kind in ("word", "str") and self.is_(k - 1, "{", ",", "]"):
                self.add("enum_member", self.tok[k].text.strip("\"'"), [*scope, name], k, k)
            k = self.past(k) if self.is_(k, "(", "[", "{") else k + 1

    def variables(self, i: int, end: int, scope: list[str], start: int, exported: bool, top: bool) -> int:
        constant, k, first = self.is_(i, "const"), i + 1, start
        while k < end:
            name = self.word(k)
            k = self.past(k) if self.is_(k, "{", "[") else k + 1
            k += self.is_(k, "!")
            if self.is_(k, ":"):
                k = self.type_end(k + 1, end)
            made = self.value(k + 1, end) if self.is_(k, "=") else None
            if made:
                stop = self.body(made[0], end, [*scope, name] if name and top else scope)
                if name and top:
                    self.add("function", name, scope, first, stop - 1, made[0], is_exported=exported, is_async=made[1], return_type=made[2])
            else:
                stop = self.statement_end(k + 1, end, comma=True) if self.is_(k, "=") else k
                self.script(k, stop, scope, False)
                if name and top:
                    self.add("constant" if constant else "variable", name, scope, first, max(first, stop - 1), is_exported=exported)
            k, first = stop, stop + 1
            if not self.is_(k, ","):
                return max(k, i + 1)
            k += 1
        return k

    # Rust

    def rust(self, i: int, end: int, scope: list[str], where: str) -> None:
        """Items from i to end; where: file, impl, trait or body."""
        first, public = None, False
        while i < end:
            t = self.tok[i]
            if self.is_(i, "#") and (self.is_(i + 1, "[") or self.is_(i + 1, "!") and self.is_(i + 2, "[")):
                first = i if first is None else first
                i = self.past(i + 1 + self.is_(i + 1, "!"))
                continue
            if t.kind != "word":
                i, first, public = i + 1, None, False
                continue
            if t.text in ("pub", "async", "unsafe", "extern", "default") and i + 1 < end and not self.is_(i + 1, "!") and (t.text == "pub" or self.word(i + 1) or self.tok[i + 1].kind == "str"):
                first = i if first is None else first
                public |= t.text == "pub"
                i = self.past(i + 1) if self.is_(i + 1, "(") and t.text == "pub" else i + 1
                i += i < end and self.tok[i].kind == "str"
                continue
            start = i if first is None else first
            name = self.word(i + 1)
            if t.text == "fn" and name:
                i = self.fn(i, end, scope, start, public, where)
            elif t.text == "const" and name == "fn":
                first, i = start, i + 1
                continue
            elif t.text in ("struct", "union") and name and where != "impl" and not self.is_(i + 1, "{"):
                i = self.struct(i, end, scope, start, public)
            elif t.text == "enum" and name:
                i = self.variants(i, end, scope, start, public)
            elif t.text == "trait" and name:
                k = next((x for x in range(i, end) if self.is_(x, "{", ";")), end)
                self.add("interface", name, scope, start, self.match.get(k, k), k, is_exported=public)
                self.rust(k + 1, self.match.get(k, k), [*scope, name], "trait")
                i = self.past(k)
            elif t.text == "impl" and where in ("file", "body"):
                i = self.impl(i, end, scope, start)
            elif t.text == "mod" and name:
                if self.is_(i + 2, "{"):
                    self.add("namespace", name, scope, start, self.match.get(i + 2, i + 2), i + 2, is_exported=public)
                    self.rust(i + 3, self.match.get(i + 2, end), [*scope, name], "file")
                i = self.past(i + 2) if self.is_(i + 2, "{") else i + 2
            elif t.text in ("const", "static") and where in ("file", "impl", "trait") and name:
                k = i + 1 + self.is_(i + 1, "mut")
                stop = next((x for x in range(k, end) if self.is_(x, ";")), end)
                if self.word(k) and self.is_(k + 1, ":"):
                    self.add("constant" if t.text == "const" else "variable", self.word(k), scope, start, stop, is_exported=public)
                self.rust(k + 1, stop, scope, "body")
                i = stop + 1
            elif t.text == "use":
                stop = next((x for x in range(i, end) if self.is_(x, ";")), end)
                self.refer("imports", "".join(x.text if x.text != "as" else " as " for x in self.tok[i + 1 : stop]), [], i)
                i = stop + 1
            else:
                i = self.rust_name(i, end, scope, where)
            first, public = None, False

    def rust_name(self, i: int, end: int, scope: list[str], where: str) -> int:
        name, k = self.path(i, ("::",))
        # type arguments within a path
        while self.is_(k, "::") and self.is_(k + 1, "<") and (after := self.angles(k + 1)) > k + 1:
            k = after
            while self.is_(k, "::") and self.word(k + 1):
                name, k = f"{name}::{self.tok[k + 1].text}", k + 2
        last = name.split("::")[-1]
        after = self.angles(k) if last[:1].isupper() else k
        if self.is_(k, "!"):
            return k + 1
        if self.is_(k, "(") and last not in NO_CALLS and not self.is_(i - 1, "fn"):
            self.refer("calls", name, scope, i)
        elif where == "body" and last[:1].isupper() and self.is_(after, "{") and not self.is_(i - 1, "match", "if", "while", "in", "for", "->", "impl", "dyn", "+"):
            self.refer("instantiates", last if last != "Self" or not scope else scope[-2] if len(scope) > 1 else scope[-1], scope, i)
        return k

    def named_type(self, i: int, end: int) -> str | None:
        """The name of the type at i, without references and arguments; None for what has none of its own."""
        while i < end and (self.is_(i, "&", "mut", "dyn", "impl", "*", "const") or self.tok[i].text[0] == "'"):
            i += 1
        if i < end and self.word(i):
            name = self.path(i, ("::",))[0].split("::")[-1]
            return None if name in PRIMITIVE else name
        return None

    def fn(self, i: int, end: int, scope: list[str], start: int, public: bool, where: str) -> int:
        name = self.tok[i + 1].text
        k = self.angles(i + 2)
        k = self.past(k) if self.is_(k, "(") else k
        kind = None
        inner = [*scope, name]
        if self.is_(k, "->"):
            stop = next((x for x in range(k + 1, end) if self.is_(x, "{", ";", "where")), end)
            kind = " ".join(self.text[self.tok[k + 1].start : self.tok[stop - 1].end].split()) if stop > k + 1 else None
            if named := self.named_type(k + 1, stop):
                self.refer("returns", named, inner, k)
            k = stop
        k = next((x for x in range(k, end) if self.is_(x, "{", ";")), end)
        has = self.is_(k, "{")
        is_async = any(self.is_(x, "async") for x in range(start, i))
        self.add("method" if where in ("impl", "trait") else "function", name, scope, start, self.match.get(k, k) if has else min(k, end - 1), k, is_exported=public, is_async=is_async, return_type=kind)
        if has:
            self.rust(k + 1, self.match.get(k, end), inner, "body")
        return self.past(k) if has else k + 1

    def struct(self, i: int, end: int, scope: list[str], start: int, public: bool) -> int:
        name = self.tok[i + 1].text
        k = self.angles(i + 2)
        k = next((x for x in range(k, end) if self.is_(x, "{", ";", "(")), end)
        last = self.match.get(k, k)
        self.add("class", name, scope, start, min(last, end - 1), k, is_exported=public)
        if self.is_(k, "{"):
            x, first = k + 1, None
            while x < last:
                first = x if first is None else first
                if self.is_(x, "#") and self.is_(x + 1, "["):
                    x = self.past(x + 1)
                elif self.is_(x, "pub"):
                    x = self.past(x + 1) if self.is_(x + 1, "(") else x + 1
                elif self.word(x) and self.is_(x + 1, ":"):
                    stop = x + 2
                    while stop < last and not self.is_(stop, ","):
                        stop = self.past(stop) if self.is_(stop, "(", "[", "{") else max(self.angles(stop), stop + 1)
                    self.add("property", self.tok[x].text, [*scope, name], first, max(x, stop - 1), is_exported=self.is_(first, "pub"))
                    if named := self.named_type(x + 2, stop):
                        self.refer("type_of", named, [*scope, name, self.tok[x].text], x)
                    x, first = stop + 1, None
                else:
                    x += 1
        return last + 1

    def variants(self, i: int, end: int, scope: list[str], start: int, public: bool) -> int:
        name = self.tok[i + 1].text
        k = next((x for x in range(i, end) if self.is_(x, "{", ";")), end)
        last = self.match.get(k, k)
        self.add("enum", name, scope, start, min(last, end - 1), k, is_exported=public)
        x = k + 1
        while x < last:
            if self.is_(x, "#") and self.is_(x + 1, "["):
                x = self.past(x + 1)
                continue
            if self.word(x):
                self.add("enum_member", self.tok[x].text, [*scope, name], x, x)
                while x < last and not self.is_(x, ","):
                    x = self.past(x) if self.is_(x, "(", "[", "{") else x + 1
            x += 1
        return last + 1

    def impl(self, i: int, end: int, scope: list[str], start: int) -> int:
        k = self.angles(i + 1)
        stop = next((x for x in range(k, end) if self.is_(x, "{", ";")), end)
        told = next((x for x in range(k, stop) if self.is_(x, "where")), stop)
        split = next((x for x in range(k, told) if self.is_(x, "for") and not self.is_(x + 1, "<")), None)
        trait = self.named_type(k, split) if split is not None else None
        name = self.named_type(split + 1 if split is not None else k, told)
        if name:
            self.impls.append((name, scope, start, self.match.get(stop, stop), stop))
        inner = [*scope, name] if name else scope
        if trait and name:
            self.refer("implements", trait, inner, i)
        self.rust(stop + 1, self.match.get(stop, stop), inner, "impl")
        return self.past(stop)


def read(text: str, language: str) -> tuple[list[dict], list[tuple[str, str, list[str], int]]]:
    """Nodes, and references (kind, name, scope of the node that refers, line) of a file, each once."""
    rust = language == "rust"
    r = Reader(text, Lexer(text, rust, language in ("tsx", "jsx", "javascript")))
    r.impls = []
    if rust:
        r.rust(0, len(r.tok), [], "file")
        known = {n["name"] for n in r.nodes if n["kind"] in ("class", "enum", "interface")}
        # the methods of a type that is declared elsewhere stand in a namespace of its name
        for name, scope, start, last, stop in r.impls:
            if name not in known:
                r.add("namespace", name, scope, start, last, stop)
                known.add(name)
    else:
        r.script(0, len(r.tok), [], True)
    return r.nodes, list(dict.fromkeys((k, n, tuple(s), at) for k, n, s, at in r.refs))


def leaves(text: str, language: str, keywords: frozenset[str]) -> list[tuple[int, int, str]]:
    """line, last line, type of all tokens and comments: names and literals by their kind, all else as it stands."""
    lexer = Lexer(text, language == "rust", language in ("tsx", "jsx", "javascript"))
    kinds = {"str": "string", "num": "number", "re": "regex", "jsx": "element"}
    found = [(t.start, t.end, kinds.get(t.kind) or (t.text if t.kind == "op" or t.text in keywords else "identifier")) for t in lexer.tokens]
    found = sorted(found + [(a, z, "comment") for a, z in lexer.comments])
    breaks = [m.start() for m in re.finditer("\n", text)]
    return [(bisect_right(breaks, a - 1) + 1, bisect_right(breaks, max(a, z - 1) - 1) + 1, kind) for a, z, kind in found]

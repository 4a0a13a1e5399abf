"""Extractors: one source file in, nodes, references and containment out.

Files are parsed on executors by mapInPandas, one batch of files at a time; what
follows (resolution, fingerprints, search) is DataFrame operations. Python files
are parsed with the standard library's ast, TypeScript, JavaScript and Rust by braces.py.
"""

from __future__ import annotations

import ast
import hashlib
import io
import keyword
import re
import sys
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import node_id
from . import braces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROW = "path string, what string, kind string, name string, scope array<string>, start_line int, end_line int, docstring string, signature string, is_exported boolean, is_async boolean, target string, visibility string, return_type string, is_static boolean, is_abstract boolean, body_hash string"
BRACES = ("typescript", "tsx", "javascript", "jsx", "rust")
#: Kinds whose bodies are hashed.
BODIES = ("function", "method", "class", "interface", "enum", "constant", "variable", "type_alias")
FIELDS = [c.split()[0] for c in ROW.split(", ")]


def node(path, kind, name, scope, start, end, doc=None, sig=None, exported=False, is_async=False, visibility=None, return_type=None, is_static=False, is_abstract=False):
    return (path, "node", kind, name, list(scope), start, end, doc, sig, exported, is_async, None, visibility, return_type, is_static, is_abstract, None)


def ref(path, kind, name, scope, line):
    """scope names the node that refers."""
    return (path, "ref", kind, None, list(scope), line, line, None, None, None, None, name, None, None, None, None, None)


def dotted(e: ast.expr) -> str | None:
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, ast.Attribute):
        base = dotted(e.value)
        return f"{base}.{e.attr}" if base else e.attr
    return None


class PythonFile(ast.NodeVisitor):
    """Rows of one Python module; a leading underscore means not exported, upper case a constant."""

    def __init__(self, path: str):
        self.path, self.scope, self.kinds, self.rows = path, [], [], []

    def define(self, n, kind: str, sig: str | None = None, is_async: bool = False, returns: str | None = None):
        doc = ast.get_docstring(n) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else None
        self.rows.append(node(self.path, kind, n.name, self.scope, n.lineno, n.end_lineno, doc, sig, not n.name.startswith("_"), is_async, return_type=returns))
        self.scope.append(n.name)
        self.kinds.append(kind)
        for child in n.body:
            self.visit(child)
        self.scope.pop()
        self.kinds.pop()

    def visit_FunctionDef(self, n, is_async: bool = False):
        kind = "method" if self.kinds and self.kinds[-1] == "class" else "function"
        self.define(n, kind, f"({ast.unparse(n.args)})", is_async, ast.unparse(n.returns) if n.returns else None)

    def visit_AsyncFunctionDef(self, n):
        self.visit_FunctionDef(n, True)

    def visit_ClassDef(self, n):
        for b in n.bases:
            if name := dotted(b):
                self.rows.append(ref(self.path, "extends", name, [*self.scope, n.name], n.lineno))
        self.define(n, "class")

    def visit_Assign(self, n):
        self.assigned(n, n.targets)

    def visit_AnnAssign(self, n):
        self.assigned(n, [n.target])

    def assigned(self, n, targets):
        if not self.kinds or self.kinds[-1] == "class":
            for t in targets:
                if isinstance(t, ast.Name):
                    kind = "property" if self.kinds else "constant" if t.id.isupper() else "variable"
                    self.rows.append(node(self.path, kind, t.id, self.scope, n.lineno, n.end_lineno, exported=not t.id.startswith("_")))
        self.generic_visit(n)

    def visit_Import(self, n):
        self.rows += [ref(self.path, "imports", a.name, [], n.lineno) for a in n.names]

    def visit_ImportFrom(self, n):
        base = "." * n.level + (n.module or "")
        self.rows.append(ref(self.path, "imports", base, [], n.lineno))
        if not n.module:
            self.rows += [ref(self.path, "imports", base + a.name, [], n.lineno) for a in n.names]

    def visit_Call(self, n):
        if name := dotted(n.func):
            last = name.split(".")[-1]
            self.rows.append(ref(self.path, "instantiates" if last[:1].isupper() else "calls", name, self.scope, n.lineno))
        self.generic_visit(n)


def python_rows(path: str, text: str) -> list[tuple]:
    """A file with broken syntax still gives the definitions that its lines show."""
    v = PythonFile(path)
    try:
        v.visit(ast.parse(text))
        return v.rows
    except (SyntaxError, ValueError, RecursionError):
        found = re.finditer(r"(?m)^([ \t]*)(async\s+)?(def|class)\s+(\w+)", text)
        at = lambda m: text.count("\n", 0, m.start(4)) + 1
        return [node(path, "class" if m[3] == "class" else "method" if m[1] else "function", m[4], [], at(m), at(m), exported=m[4][0] != "_", is_async=bool(m[2])) for m in found]


def body_digest(lines: list[str], start: int, end: int) -> str:
    """As functions.text.body_hash, of lines start to end."""
    body = re.sub(r"[ \t\n\x0b\f\r]+", " ", "\n".join(lines[start - 1 : end])).strip(" ")
    return hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()


def brace_rows(path: str, text: str, language: str) -> list[tuple]:
    """Rows of a file in a language with braces."""
    nodes, refs = braces.read(text, language)
    flags = lambda n: {k.removeprefix("is_") if k == "is_exported" else k: n[k] for k in ("is_exported", "is_async", "visibility", "return_type", "is_static", "is_abstract") if n.get(k) is not None}
    rows = [node(path, n["kind"], n["name"], n["scope"], n["start_line"], n["end_line"], n["docstring"], n["signature"], **flags(n)) for n in nodes]
    return rows + [ref(path, kind, name, scope, at) for kind, name, scope, at in refs]


def file_rows(path: str, text: str, language: str) -> list[tuple]:
    end = text.count("\n") + 1
    own = node(path, "file", path, [], 1, end, exported=True)
    if language == "python":
        return [own, *python_rows(path, text)]
    return [own, *brace_rows(path, text, language)] if language in BRACES else [own]


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for p, t, g in zip(pdf["path"], pdf["text"], pdf["language"], strict=True):
            lines = (t or "").split("\n")
            rows = [(*r[:-1], body_digest(lines, r[5], r[6])) if r[1] == "node" and r[2] in BODIES else r for r in file_rows(p, t or "", g)]
            yield pd.DataFrame(rows, columns=FIELDS)


def extract(files: DataFrame) -> DataFrame:
    """Raw rows of all files (X01-X03, X05-X07); a file without declarations has its own node."""
    return files.select("path", "text", "language").mapInPandas(_extract, ROW)


def nodes(raw: DataFrame) -> DataFrame:
    """The nodes: id, kind, name, qualified_name, file_path, lines, docstring, signature, flags, body_hash, ord."""
    return raw.filter("what = 'node'").select(
        node_id(F.col("kind"), F.col("path"), F.col("name")).alias("id"), "kind", "name",
        F.array_join(F.concat("scope", F.array("name")), "::").alias("qualified_name"), F.col("path").alias("file_path"), "start_line", "end_line",
        "docstring", "signature", "is_exported", "is_async", "body_hash", F.xxhash64("path", "start_line", "name").alias("ord"),
        "visibility", "return_type", "is_static", "is_abstract",
    )


def references(raw: DataFrame, named: DataFrame) -> DataFrame:
    """The references: ref_id, from_node_id, reference_name, reference_kind, file_path, line."""
    r = raw.filter("what = 'ref'").withColumn("qualified_name", F.array_join("scope", "::"))
    owner = named.groupBy(F.col("file_path").alias("path"), "qualified_name").agg(F.min_by("id", "ord").alias("owner"))
    j = r.join(owner, ["path", "qualified_name"], "left")
    return j.select(
        F.xxhash64("path", "kind", "target", "start_line", "qualified_name").alias("ref_id"),
        F.coalesce("owner", F.concat(F.lit("file:"), "path")).alias("from_node_id"), F.col("target").alias("reference_name"),
        F.col("kind").alias("reference_kind"), F.col("path").alias("file_path"), F.col("start_line").alias("line"),
    )


def routes(files: DataFrame) -> DataFrame:
    """path, line, method, route, handler of web routes (X04): one pattern over the text."""
    #: Fixed value: a call app.get("/path", handler) and its like.
    pattern = r"""\b(?:app|router)\.(?:get|post|put|patch|delete|options|head|all)\s*\(\s*["'`][^"'`]+["'`]\s*,\s*[A-Za-z_$][\w$]*"""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "s"))
    m = lines.select("path", (F.col("pos") + 1).alias("line"), F.explode(F.regexp_extract_all("s", F.lit(pattern), F.lit(0))).alias("m"))
    part = lambda i: F.regexp_extract("m", r"""\.(\w+)\s*\(\s*["'`]([^"'`]+)["'`]\s*,\s*([\w$]+)$""", i)
    return m.select("path", "line", part(1).alias("method"), part(2).alias("route"), part(3).alias("handler"))


def build(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges, references of a tree (C01): extraction, containment, imports, resolution."""
    from ..functions.store import checkpoint
    from ..operators import graph

    # files are parsed once; nodes and references are used several times
    raw = checkpoint(extract(files))
    if files.filter((F.col("path") == "package.json") & F.col("text").rlike(r'"express"\s*:')).isEmpty():
        raw = raw.filter("not kind <=> 'route' and not kind <=> 'function_ref'")
    n = checkpoint(graph.upsert_latest(nodes(raw)))
    refs = checkpoint(references(raw, n))
    return n, edges_of(bound(refs, n, imported(refs, files)), n), refs


def imported(refs: DataFrame, files: DataFrame) -> DataFrame:
    """ref_id, file_path, imported_path of the imports among references that lead to a file (J06); files: path."""
    from ..operators import graph, lookup

    said = refs.filter("reference_kind = 'imports'").select("ref_id", "file_path", F.col("reference_name").alias("specifier"))
    python = F.col("file_path").endswith(".py")
    return graph.import_targets(said.filter(~python), files).unionByName(lookup.python_import_targets(said.filter(python), files))


def bound(refs: DataFrame, n: DataFrame, imports: DataFrame) -> DataFrame:
    """ref_id, source, target, kind of the references that bind."""
    from ..operators import graph

    met = graph.resolve(refs.filter("reference_kind != 'imports'"), n, imports.select("file_path", "imported_path"))
    met = graph.framework_first(met, graph.route_targets(refs.filter("reference_kind = 'function_ref'"), n))
    e = refs.join(met, "ref_id").select("ref_id", F.col("from_node_id").alias("source"), "target", F.col("reference_kind").alias("kind"))
    i = imports.join(refs.select("ref_id"), "ref_id", "left_semi")
    i = i.select("ref_id", F.concat(F.lit("file:"), "file_path").alias("source"), F.concat(F.lit("file:"), "imported_path").alias("target"), F.lit("imports").alias("kind"))
    return e.unionByName(i)


def edges_of(e: DataFrame, n: DataFrame) -> DataFrame:
    """Edges of bound references and of what files contain, each once, both ends there."""
    from ..operators import graph

    e = e.select("source", "target", "kind", F.col("ref_id").alias("ord"))
    c = n.filter("kind != 'file'").select(F.concat(F.lit("file:"), "file_path").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"), "ord")
    return graph.valid_edges(graph.first_edges(e.unionByName(c)), n)


#: Words of TypeScript, JavaScript and Rust that stand for themselves among a body's tokens.
KEYWORDS = frozenset(
    """as async await break case catch class const continue crate debugger default delete do dyn else enum export extends extern false
    finally fn for from function get if impl implements import in instanceof interface let loop match mod move mut namespace new null of
    private protected pub public readonly ref return self set static struct super switch this throw trait true try type typeof undefined
    unsafe use var void where while with yield""".split()
)
PYTHON_LEAVES = {tokenize.NUMBER: "number", tokenize.STRING: "string", tokenize.COMMENT: "comment"} | {
    getattr(tokenize, t): "string" for t in ("FSTRING_START", "FSTRING_MIDDLE", "FSTRING_END") if hasattr(tokenize, t)
}


def python_leaves(text: str) -> Iterator[tuple[int, int, str]]:
    """line, last line, type of a Python file's tokens, up to where it can't be read."""
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.NAME:
                yield t.start[0], t.end[0], t.string if keyword.iskeyword(t.string) else "identifier"
            elif t.type == tokenize.OP:
                yield t.start[0], t.end[0], t.string
            elif t.type in PYTHON_LEAVES:
                yield t.start[0], t.end[0], PYTHON_LEAVES[t.type]
    except (tokenize.TokenError, SyntaxError):
        return


def _leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for p, t, g in zip(pdf["path"], pdf["text"], pdf["language"], strict=True):
            found = python_leaves(t or "") if g == "python" else braces.leaves(t or "", g, KEYWORDS) if g in BRACES else ()
            yield pd.DataFrame([(p, i, *leaf) for i, leaf in enumerate(found)], columns=["path", "pos", "line", "end_line", "type"])


def leaves(files: DataFrame) -> DataFrame:
    """path, pos, line, end_line, type of all tokens of all files (X08): names and literals by their kind, all else as it stands."""
    return files.select("path", "text", "language").mapInPandas(_leaves, "path string, pos int, line int, end_line int, type string")

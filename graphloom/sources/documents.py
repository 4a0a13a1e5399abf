"""Markdown documents: front matter, claims, links, anchors, groundings."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import front

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What makes a span of code a path, a command, or neither, and headings that list dependencies.
EXTENSION = re.compile(r"\.(ts|js|tsx|jsx|py|go|rs|rb|java|json|yaml|yml|toml|md|css|scss|html|vue|svelte|sh)$")
COMMAND = re.compile(r"^(npm|yarn|pnpm|bun|make|cargo|python|pip|go|node|npx|tsx)\s")
PLACEHOLDER = re.compile(r"[<>\[\]{}]")
PIECE_OF_CODE = re.compile(r"[=();,\"']")
METHOD = re.compile(r"^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+/")
DEPENDENCIES = re.compile(r"key\s*libraries|core\s*technologies|dependencies|stack|tech", re.I)
VERSION = re.compile(r"^(.+?)\s+[v^~>=<]*(\d[\d.]*\S*)$")
NEGATED = ("not exist", "not use", "deliberately not", "excluded", "removed", "deprecated")

CLAIM = "source string, kind string, value string, line int, section string, negated boolean"


def is_path(value: str) -> bool:
    """Whether a span of code names a file: no command, template, route, or piece of code."""
    looks = "/" in value or EXTENSION.search(value)
    route = METHOD.match(value) or (value.startswith("/") and not EXTENSION.search(value))
    code = PIECE_OF_CODE.search(value) or value.startswith("*")
    return bool(looks and not (COMMAND.match(value) or PLACEHOLDER.search(value) or route or code))


def claims_of(source: str, text: str) -> list[tuple]:
    """Claims of one document, line by line; front matter is skipped."""
    out: list[tuple] = []
    heading, fenced = None, False
    lines = text.split("\n")
    start = next((i + 1 for i, s in enumerate(lines[1:], 1) if s.strip() == "---"), 0) if lines[0].strip() == "---" else 0
    for number, s in enumerate(lines, 1):
        if number <= start:
            continue
        if s.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
            continue
        no = heading is not None and any(p in heading.lower() for p in NEGATED)
        add = lambda kind, value: out.append((source, kind, value, number, heading, no))  # noqa: B023, E731
        if fenced:
            if COMMAND.match(s.strip()):
                add("command", s.strip())
            continue
        if m := re.match(r"^#{1,6}\s+(.*?)\s*#*$", s):
            heading = m[1]
            continue
        for code in re.findall(r"(?<!`)`([^`\n]+)`(?!`)", s):
            if is_path(code):
                add("path", code)
            if COMMAND.match(code):
                add("command", code)
        if heading and DEPENDENCIES.search(heading):
            for bold in re.findall(r"\*\*([^*`\n]+)\*\*", s):
                m = VERSION.match(bold)
                add("dependency", m[1].strip() if m else bold)
                if m:
                    add("version", bold)
    return out


def _claims(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [r for s, t in zip(pdf["source"], pdf["text"], strict=True) for r in claims_of(s, t or "")]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CLAIM.split(", ")])


def claims(docs: DataFrame) -> DataFrame:
    """Claims of all documents (X09, X10); docs: source, text."""
    return docs.select("source", "text").mapInPandas(_claims, CLAIM)


def front_matter(docs: DataFrame) -> DataFrame:
    """source, front: the text between the two first lines of dashes; null without."""
    m = F.regexp_extract("text", r"^---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|$)", 1)
    return docs.select("source", F.when(m != "", m).alias("front"))


FRONT = "source string, fields map<string,string>, edges array<struct<target:string,condition:string>>, grounds array<struct<node_id:string,fingerprint:string>>"


def _fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = lambda a, b: pa.list_(pa.struct([(a, pa.string()), (b, pa.string())]))
    schema = pa.schema([("source", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("edges", pair("target", "condition")), ("grounds", pair("node_id", "fingerprint"))])
    for batch in batches:
        rows = []
        for source, text in zip(*(batch.column(c).to_pylist() for c in ("source", "text")), strict=True):
            found = front.read(text)
            if found is not None:
                # edges are taken one by one, groundings only all together
                given = found.get("edges") if isinstance(found.get("edges"), list) else []
                edges = [e for x in given for e in front.entries([x], ("target", "condition"), ("target",)) or ()]
                grounds = front.entries(found.get("grounds_to"), ("node", "fingerprint"), ("node", "fingerprint")) or []
                name = lambda names, rows: [dict(zip(names, r, strict=True)) for r in rows]
                rows.append({
                    "source": source, "fields": [(k, v) for k, v in found.items() if isinstance(v, str)],
                    "edges": name(("target", "condition"), edges), "grounds": name(("node_id", "fingerprint"), grounds),
                })
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def fronts(docs: DataFrame) -> DataFrame:
    """source, fields, edges, grounds of documents whose front matter is well formed (S11); docs: source, text."""
    return docs.select("source", "text").mapInArrow(_fronts, FRONT)


def front_edges(docs: DataFrame) -> DataFrame:
    """file, target of the front matter's edges (X11)."""
    return fronts(docs).select(F.col("source").alias("file"), F.explode("edges").alias("e")).select("file", "e.target")


def groundings(docs: DataFrame) -> DataFrame:
    """file, node_id, fingerprint of grounds_to; a list with a malformed entry counts as none."""
    return fronts(docs).select(F.col("source").alias("file"), F.inline("grounds"))


def links(docs: DataFrame) -> DataFrame:
    """file, line, target of links outside of fences and inline code."""
    from ..operators.drift import fenced, lines

    rows = fenced(lines(docs, "source"), "source").filter("not in_fence and not fence")
    bare = F.regexp_replace("s", r"`[^`]*`", "")
    t = F.regexp_extract_all(bare, F.lit(r"\[[^\]]*\]\(\s*<?([^)\s>]+)>?[^)]*\)"), F.lit(1))
    return rows.select(F.col("source").alias("file"), "line", F.explode(t).alias("target"))


def anchors(docs: DataFrame, scheme: str = "node") -> DataFrame:
    """file, line, node_id of links with a scheme of their own, such as node://ID."""
    prefix = f"{scheme}://"
    found = links(docs).filter(F.col("target").startswith(prefix))
    return found.select("file", "line", F.url_decode(F.expr(f"substring(target, {len(prefix) + 1})")).alias("node_id"))


def rewrite_anchor(text, old: str, new: str, scheme: str = "node"):
    """Column text with links to one node led to another; nothing else changes."""
    return F.replace(text, F.lit(f"]({scheme}://{old})"), F.lit(f"]({scheme}://{new})"))


def document_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (source, status, n_edges) and edges (file, target) of documents whose targets are documents."""
    e = front_edges(docs).join(docs.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("file", "target").distinct()
    body = F.trim(F.regexp_replace("text", r"^---[\s\S]*?\n---", ""))
    blank = F.col("text").rlike(r"\[[A-Z][^\]\n]*\]|<!--\s*(?:TODO|fill)")
    status = F.when(F.length(body) == 0, "empty").when(blank, "template").otherwise("populated")
    n = docs.select("source", status.alias("status")).join(e.groupBy(F.col("file").alias("source")).agg(F.count("*").alias("n_edges")), "source", "left")
    return n.select("source", "status", F.coalesce("n_edges", F.lit(0)).alias("n_edges")), e

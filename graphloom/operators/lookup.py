"""Lookups by ids, files and names, and the answers that consist of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


def nodes_by_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """id, found, and the node's other columns for each id asked for (S05, S07, C03); an unknown one is there with found = false."""
    known = nodes.withColumn("found", F.lit(True))
    return ids.select("id").distinct().join(known, "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def edges_at(edges: DataFrame, ids: DataFrame, end: str = "source", kinds: Sequence[str] = ()) -> DataFrame:
    """Edges with that end among ids, of these kinds or of any, in order of source, target and kind."""
    some = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    return some.join(ids.select(F.col("id").alias(end)).distinct(), end, "left_semi").orderBy("source", "target", "kind")


def nodes_of_files(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes of the files in paths (path), in order of id (S09); a leading "./" and backslashes don't count."""
    plain = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^\./", "")
    return nodes.join(paths.select(plain.alias("file_path")).distinct(), "file_path", "left_semi").orderBy("id")


def related(nodes: DataFrame, edges: DataFrame, names: DataFrame, callers: bool = True) -> DataFrame:
    """target, id of what calls the symbols of these names, or is called by them.

    names: name. A symbol is meant by its id, or else its name or qualified name.
    Each pair of a symbol and what is related to it comes once.
    """
    asked = names.select(F.col("name").alias("asked")).distinct()
    by_id = nodes.select("id").join(asked, F.col("id") == F.col("asked"))
    rest = asked.join(by_id.select("asked"), "asked", "left_anti")
    ways = nodes.select("id", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("asked"))
    target = by_id.select("id").unionByName(ways.join(rest, "asked").select("id")).distinct()
    found = graph.callers(edges, target) if callers else graph.callees(edges, target)
    return found.toDF("target", "id")


def python_import_targets(refs: DataFrame, files: DataFrame) -> DataFrame:
    """ref_id, file_path, imported_path of Python imports (J06): a module, or a package by its __init__ file.

    refs: ref_id, file_path, specifier. One leading dot means the file's own package, each further one the package
    around it; without a dot the project's root counts.
    """
    dots = F.length(F.regexp_extract("specifier", r"^\.*", 0))
    module = F.replace(F.regexp_replace("specifier", r"^\.+", ""), F.lit("."), F.lit("/"))
    folders = F.split("file_path", "/")
    package = F.array_join(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - F.greatest(dots, F.lit(1)), F.lit(0))), "/")
    base = F.when(dots == 0, module).otherwise(F.concat_ws("/", F.nullif(package, F.lit("")), F.nullif(module, F.lit(""))))
    r = refs.select("ref_id", "file_path", base.alias("base")).filter("base != ''")
    ways = F.array(F.col("base"), F.concat("base", F.lit(".py")), F.concat("base", F.lit("/__init__.py")))
    c = r.select("ref_id", "file_path", F.posexplode(ways).alias("pos", "candidate"))
    met = c.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    return met.groupBy("ref_id", "file_path").agg(F.min_by("candidate", "pos").alias("imported_path"))


def grounded_files(affected: DataFrame, baselines: DataFrame) -> DataFrame:
    """file, node_id, depth of documents that rest on affected nodes (J12), in order; affected: id, depth; baselines: file, node_id."""
    return baselines.select("file", "node_id").distinct().join(affected.select(F.col("id").alias("node_id"), "depth"), "node_id").orderBy("file", "node_id")


def score_delta(before: DataFrame, after: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., before, after, delta of scores (A16); without issues a score is 100."""
    full = F.lit(100).cast("long")
    j = before.select(*by, F.col("score").alias("before")).join(after.select(*by, F.col("score").alias("after")), list(by), "full_outer")
    j = j.select(*by, F.coalesce("before", full).alias("before"), F.coalesce("after", full).alias("after"))
    return j.withColumn("delta", F.col("after") - F.col("before"))


def filtered(hits: DataFrame, kinds: Sequence[str] = (), languages: Sequence[str] = ()) -> DataFrame:
    """Nodes of these kinds and languages (F01); no list means any."""
    out = hits.filter(F.col("kind").isin(*kinds)) if kinds else hits
    return out.filter(F.col("language").isin(*languages)) if languages else out

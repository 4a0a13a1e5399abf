"""A kept code graph: built once, then brought up to date file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import Versions, checkpoint
from ..functions.text import last_segment
from ..sources import extract
from . import graph

#: What a candidate is judged by; where none of it changes, no reference binds otherwise.
JUDGED = ("id", "kind", "name", "file_path", "is_exported")
TABLES = {
    "nodes": "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, docstring string, signature string, is_exported boolean, is_async boolean, "
    "body_hash string, ord long, visibility string, return_type string, is_static boolean, is_abstract boolean",
    "refs": "ref_id long, from_node_id string, reference_name string, reference_kind string, file_path string, line int",
    "bound": "ref_id long, source string, target string, kind string",
    "imports": "ref_id long, file_path string, imported_path string",
    "paths": "file_path string",
}
#: The keys by which rows of a table are made void.
VOID = {"nodes": ("void_files", "file_path"), "refs": ("void_files", "file_path"), "paths": ("void_files", "file_path"), "bound": ("void_refs", "ref_id"), "imports": ("void_refs", "ref_id")}


class GraphStore:
    """Nodes, references and what these are bound to, in versions below path; a reader sees one version however long it reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)
        self.now = self.versions.current()

    def table(self, name: str) -> DataFrame:
        return self.versions.layers(self.now, name, *VOID[name], TABLES[name])

    def edges(self) -> DataFrame:
        return extract.edges_of(self.table("bound"), self.table("nodes"))

    def _write(self, tables: dict[str, DataFrame], keep: bool) -> None:
        told = {n: tables[n].select(*[c.strip().split()[0] for c in TABLES[n].split(",")]) for n in TABLES} | {n: tables[n] for n in ("void_files", "void_refs")}
        self.versions.write(told, keep=keep)
        self.now = self.versions.current()

    def _read(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        raw = checkpoint(extract.extract(files))
        n = checkpoint(graph.upsert_latest(extract.nodes(raw)))
        return n, checkpoint(extract.references(raw, n))

    def build(self, files: DataFrame) -> GraphStore:
        """The graph of these files (path, text, language) and no others."""
        n, refs = self._read(files)
        imports = checkpoint(extract.imported(refs, files))
        none = self.spark.createDataFrame([], "file_path string"), self.spark.createDataFrame([], "ref_id long")
        paths = files.select(F.col("path").alias("file_path"))
        self._write({"nodes": n, "refs": refs, "bound": extract.bound(refs, n, imports), "imports": imports, "paths": paths, "void_files": none[0], "void_refs": none[1]}, False)
        return self

    def sync(self, changed: DataFrame, removed: DataFrame | None = None) -> GraphStore:
        """Files that were added or edited (path, text, language) take the place of those with their paths; those in removed (path) go.

        Only these files are parsed. References are bound anew where that may come out otherwise: those of the files; those whose name is that
        of a candidate that came, went or changed; and those of files whose imports lead elsewhere since a file
        came or went. All other rows stay as they were written.
        """
        if self.now is None:
            return self.build(changed)
        came = changed.select(F.col("path").alias("file_path"))
        gone = self.spark.createDataFrame([], "file_path string") if removed is None else removed.select(F.col("path").alias("file_path"))
        touched = checkpoint(came.unionByName(gone).distinct())
        fresh, fresh_refs = self._read(changed)
        old, old_refs, known = self.table("nodes"), self.table("refs"), self.table("paths")
        kept_nodes, kept_refs = old.join(touched, "file_path", "left_anti"), old_refs.join(touched, "file_path", "left_anti")
        paths = known.join(touched, "file_path", "left_anti").unionByName(came)

        was = old.join(touched, "file_path", "left_semi").select(*JUDGED)
        names = checkpoint(was.exceptAll(fresh.select(*JUDGED)).unionByName(fresh.select(*JUDGED).exceptAll(was)).select("name").distinct())
        named = kept_refs.join(names, last_segment(F.col("reference_name")) == names["name"], "left_semi")
        affected = named.select("ref_id")
        moved = came.join(known, "file_path", "left_anti").unionByName(gone)
        before = self.table("imports")
        if not moved.isEmpty():
            # only then may an import of an untouched file lead elsewhere
            asked = kept_refs.filter("reference_kind = 'imports'")
            now = extract.imported(asked, paths.withColumnRenamed("file_path", "path")).select("ref_id", "file_path", "imported_path")
            then = before.join(asked.select("ref_id"), "ref_id", "left_semi").select("ref_id", "file_path", "imported_path")
            elsewhere = now.exceptAll(then).unionByName(then.exceptAll(now)).select("file_path").distinct()
            affected = affected.unionByName(kept_refs.join(elsewhere, "file_path", "left_semi").select("ref_id"))
        affected = checkpoint(affected.distinct())

        again = checkpoint(kept_refs.join(affected, "ref_id", "left_semi").unionByName(fresh_refs))
        # candidates for the names that are asked for, and the nodes that ask
        nodes = kept_nodes.unionByName(fresh)
        asked = again.select(last_segment(F.col("reference_name")).alias("name")).distinct()
        askers = again.select(F.col("from_node_id").alias("id")).distinct()
        some = nodes.join(asked, "name", "left_semi").unionByName(nodes.join(askers, "id", "left_semi")).dropDuplicates(["id"])
        # all imports of the files whose references are bound, as they are now
        asks = kept_refs.unionByName(fresh_refs).filter("reference_kind = 'imports'").join(again.select("file_path").distinct(), "file_path", "left_semi")
        lead = checkpoint(extract.imported(asks, paths.withColumnRenamed("file_path", "path")))
        rebound = extract.bound(again, some, lead)
        void_refs = affected.unionByName(old_refs.join(touched, "file_path", "left_semi").select("ref_id"))
        mine = lead.join(again.select("ref_id"), "ref_id", "left_semi")
        self._write({"nodes": fresh, "refs": fresh_refs, "bound": rebound, "imports": mine, "paths": came, "void_files": touched, "void_refs": void_refs.distinct()}, True)
        return self

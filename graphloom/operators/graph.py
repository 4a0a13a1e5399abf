"""The code graph: nodes and edges as DataFrames, resolution, and traversal by joins."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import checkpoint
from ..functions.text import last_segment, posix_dirname, posix_join

#: Kinds of node that a kind of reference may bind to; other kinds bind to any.
ALLOWED_TARGETS = {
    "calls": ("function", "method"),
    "extends": ("class", "interface"),
    "implements": ("interface", "class"),
    "instantiates": ("class",),
    "function_ref": ("function", "method"),
}
#: What a relative import may stand for, in order.
IMPORT_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
IMPORT_SUFFIXES = ("", *IMPORT_EXTENSIONS, *("/index" + x for x in IMPORT_EXTENSIONS))


def upsert_latest(rows: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """One row per key, the latest by order."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def delete_where(rows: DataFrame, gone: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows without those whose key is in gone."""
    return rows.join(gone.select(*on).distinct(), list(on), "left_anti")


def delete_files(nodes: DataFrame, edges: DataFrame, refs: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of the files in paths (file_path) go, and with them their edges and references."""
    lost = nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("id")
    kept = nodes.join(lost, "id", "left_anti")
    e = edges.join(lost.withColumnRenamed("id", "source"), "source", "left_anti").join(lost.withColumnRenamed("id", "target"), "target", "left_anti")
    return kept, e, refs.join(lost.withColumnRenamed("id", "from_node_id"), "from_node_id", "left_anti")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def first_edges(edges: DataFrame, order: str = "ord") -> DataFrame:
    """The first edge of each (source, target, kind)."""
    w = Window.partitionBy("source", "target", "kind").orderBy(order)
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def callers(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct (id, caller) for each id in ids."""
    calls = edges.filter("kind = 'calls'").select(F.col("target").alias("id"), F.col("source").alias("caller"))
    return calls.join(ids.select("id").distinct(), "id", "left_semi").distinct()


def callees(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct (id, callee) for each id in ids."""
    calls = edges.filter("kind = 'calls'").select(F.col("source").alias("id"), F.col("target").alias("callee"))
    return calls.join(ids.select("id").distinct(), "id", "left_semi").distinct()


def link_counts(edges: DataFrame) -> DataFrame:
    """id, n_callers, n_callees of all ends of calls."""
    calls = edges.filter("kind = 'calls'").select("source", "target").distinct()
    ends = calls.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        calls.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    return ends.groupBy("id").agg(F.sum("i").alias("n_callers"), F.sum("o").alias("n_callees"))


def impact(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """Rows (root, id, depth) of what calls each root, over at most depth steps.

    Every root has its own visited set, which holds the root: a root may be
    affected by another. One join a level; the level joins only what was new, and is
    written out where another level follows. Calls are taken once after they are joined, so that those of the
    first level are shuffled by their target alone.
    """
    calls = edges.filter("kind = 'calls'").select(F.col("target").alias("id"), F.col("source").alias("caller"))
    level = roots.select("id").distinct()
    seen = level.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        if d == 1:
            nxt = calls.join(level, "id", "left_semi").select(F.col("id").alias("root"), F.col("caller").alias("id"))
            level = nxt.filter("root != id").distinct()
        else:
            nxt = level.join(calls, "id").select("root", F.col("caller").alias("id")).distinct()
            level = nxt.join(seen.select("root", "id"), ["root", "id"], "left_anti")
        level = checkpoint(level) if d < depth else level
        seen = seen.unionByName(level.withColumn("depth", F.lit(d)))
    return seen.filter("depth > 0")


def merged_impact(found: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per node the smallest depth, and of the roots at that depth the first."""
    best = F.min(F.struct("depth", "root"))
    return found.groupBy(*by, "id").agg(best.alias("b")).select(*by, "id", F.col("b.depth").alias("depth"), F.col("b.root").alias("root"))


def nearest_roots(calls: Mapping[tuple[str, str], DataFrame], kind: str, roots: DataFrame, depth: int = 2, by: Sequence[str] = (), name: Callable[[Column], Column] = lambda r: r) -> dict[str, DataFrame]:
    """by..., id, depth, root for each kind of node: merged_impact of impact, each group of roots by itself, without a row for each root that affects a node.

    calls: id, caller for each kind that is called and kind that calls it. roots: by..., id of nodes of that kind. Ids need be
    unique in their kind only, and may be numbers, which are shuffled in fewer bytes than names; name(id) is
    a root's name, by which the first is found.

    A level holds the least root that reaches a node in so many steps, for each group; the two least where roots' kind
    calls, too, as a root that comes back to itself does not count there. No visited set is needed, as the smallest depth wins. A level is
    shuffled by the node alone, which serves its cut, the next level's join, and the merge.
    """
    calls = {ends: c.filter("id is not null and caller is not null") for ends, c in calls.items()}
    level = {kind: roots.filter("id is not null").select(*by, "id", F.col("id").alias("root"))}
    again = any(far == kind for _, far in calls)
    least = Window.partitionBy("id", *by).orderBy("_name")
    found: dict[str, list[DataFrame]] = {}
    for d in range(1, depth + 1):
        met: dict[str, list[DataFrame]] = {}
        for (near, far), c in calls.items():
            if near in level:
                met.setdefault(far, []).append(c.join(level[near], "id").select(*by, F.col("caller").alias("id"), "root"))
        level = {}
        for k, parts in met.items():
            rows = reduce(DataFrame.unionByName, parts).repartition("id").withColumn("_name", name(F.col("root")))
            found.setdefault(k, []).append(rows.withColumn("depth", F.lit(d)))
            if again:
                # the first row of each root, and of these two, in one sort
                rows = rows.withColumn("_last", F.lag("_name").over(least)).filter("_last is null or _last != _name")
            level[k] = rows.withColumn("_n", F.row_number().over(least)).filter(F.col("_n") <= 1 + again).select(*by, "id", "root")

    def merged(k: str, parts: list[DataFrame]) -> DataFrame:
        best = F.struct("depth", F.col("_name").alias("root"))
        best = F.min(F.when(F.col("root") != F.col("id"), best) if k == kind else best).alias("b")
        rows = reduce(DataFrame.unionByName, parts).groupBy("id", *by).agg(best).filter("b is not null")
        return rows.select(*by, "id", F.col("b.depth").alias("depth"), F.col("b.root").alias("root"))

    return {k: merged(k, parts) for k, parts in found.items()}


def neighbourhood(edges: DataFrame, seeds: DataFrame, cap: int | None = None) -> DataFrame:
    """Rows (seed, id, relation): callers and callees one step away, at most cap of each."""
    c = edges.filter("kind = 'calls'")
    s = seeds.select(F.col("id").alias("seed")).distinct()

    def near(seed: str, other: str, relation: str) -> DataFrame:
        """Joined, taken once and cut by seed, so that one shuffle serves all three."""
        met = c.select(F.col(seed).alias("seed"), F.col(other).alias("id")).join(s, "seed", "left_semi").distinct()
        if cap is not None:
            w = Window.partitionBy("seed").orderBy("id")
            met = met.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")
        return met.withColumn("relation", F.lit(relation))

    return near("target", "source", "caller").unionByName(near("source", "target", "callee"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges both of whose ends are among ids."""
    return valid_edges(edges, ids)


def allowed(reference_kind: Column, node_kind: Column) -> Column:
    """Whether a reference of that kind may bind to a node of that kind."""
    out = F.lit(True)
    for k, kinds in ALLOWED_TARGETS.items():
        out = F.when(reference_kind == k, node_kind.isin(*kinds)).otherwise(out)
    return out


def reference_class(kind: Column) -> Column:
    return F.when(kind.isin(*ALLOWED_TARGETS), kind).otherwise("any")


def resolve(refs: DataFrame, nodes: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """ref_id, target, rule of the references that bind.

    refs: ref_id, from_node_id, reference_name, reference_kind, file_path.
    nodes: id (once each), kind, name, file_path, is_exported, ord. imports: file_path,
    imported_path. Candidates have the last segment of the reference's name. In
    this order: the first in the same file; the only one in an imported file, or
    the only exported one of these; the only candidate; the only exported one.

    Nodes are counted by name first, for all kinds of reference that may bind to them, so that a
    reference meets a row for its name and one for its file, however many nodes bear the name.
    """
    known = sorted({k for kinds in ALLOWED_TARGETS.values() for k in kinds})
    classes = [("any", k) for k in [*known, "other"]] + [(c, k) for c, kinds in ALLOWED_TARGETS.items() for k in kinds]
    # joined and not exploded: Spark 4.1 loses a column beside an explode of what it finds to be constant, as where all nodes are of one kind
    of_kind = nodes.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(map(str, classes))} AS v(class, bound_kind)")
    cand = nodes.filter("kind != 'file'").withColumn("bound_kind", F.when(F.col("kind").isin(*known), F.col("kind")).otherwise("other"))
    cand = cand.join(F.broadcast(of_kind), "bound_kind").select("class", "name", F.col("file_path").alias("path"), F.col("id").alias("target"), "is_exported", "ord")

    def counted(prefix: str) -> list[Column]:
        exported = F.when(F.col("is_exported"), F.col("target"))
        return [
            F.struct(F.count("target").alias("n"), F.min("target").alias("lo"), F.max("target").alias("hi")).alias(prefix),
            F.struct(F.count(exported).alias("n"), F.min(exported).alias("lo"), F.max(exported).alias("hi")).alias(prefix + "_exp"),
        ]

    by_name = cand.groupBy("class", "name").agg(*counted("all"))
    first = Window.partitionBy("class", "name", "path").orderBy("ord")
    of_file = cand.withColumn("nth", F.row_number().over(first)).filter("nth <= 2").groupBy("class", "name", F.col("path").alias("file_path"))
    of_file = of_file.agg(F.min_by("target", "nth").alias("first"), F.max_by("target", "nth").alias("second"))

    self_ = nodes.select(F.col("id").alias("from_node_id"), F.col("name").alias("own_name"), F.col("kind").alias("own_kind"), F.col("file_path").alias("own_path"), F.col("is_exported").alias("own_exp"))
    r = refs.select("ref_id", "from_node_id", last_segment(F.col("reference_name")).alias("name"), reference_class(F.col("reference_kind")).alias("class"), "reference_kind", "file_path")
    r = r.join(self_, "from_node_id", "left")
    own = (F.col("own_kind") != "file") & (F.col("own_name") == F.col("name")) & allowed(F.col("reference_kind"), F.col("own_kind"))
    r = r.withColumn("own", F.coalesce(own, F.lit(False)))
    r = r.join(by_name, ["class", "name"], "left").join(of_file, ["class", "name", "file_path"], "left")
    if imports is None:
        r = r.withColumn("own_imported", F.lit(False)).withColumn("imp", F.lit(None).cast("struct<n:long,lo:string,hi:string>")).withColumn("imp_exp", F.col("imp"))
    else:
        i = imports.select("file_path", F.col("imported_path").alias("path")).distinct()
        asked = r.select("class", "name", "file_path").distinct()
        # counted by file before they meet those who import it
        ways, parts = ("imp", "imp_exp"), ("n", "lo", "hi")
        by_path = cand.groupBy("class", "name", "path").agg(*counted("imp")).select("class", "name", "path", *[F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in ways for x in parts])
        met = asked.join(i, "file_path").join(by_path, ["class", "name", "path"]).groupBy("class", "name", "file_path")
        met = met.agg(*[F.struct(F.sum(f"{c}_n").alias("n"), F.min(f"{c}_lo").alias("lo"), F.max(f"{c}_hi").alias("hi")).alias(c) for c in ways])
        r = r.join(met, ["class", "name", "file_path"], "left")
        r = r.join(i.select("file_path", F.col("path").alias("own_path"), F.lit(True).alias("own_imported")), ["file_path", "own_path"], "left")

    def only(c: str, own: Column) -> Column:
        """The only candidate besides the node itself."""
        x, me = F.col(c), F.coalesce(own, F.lit(False))
        other = F.when(me & (x["lo"] == F.col("from_node_id")), x["hi"]).otherwise(x["lo"])
        return F.when(x["n"] - me.cast("int") == 1, other)

    own, exp, imp = F.col("own"), F.col("own_exp"), F.col("own_imported")
    p1 = F.when(F.col("first") != F.col("from_node_id"), F.col("first")).when(F.col("second") != F.col("first"), F.col("second"))
    picked = r.select(
        "ref_id", p1.alias("p1"), F.coalesce(only("imp", own & imp), only("imp_exp", own & imp & exp)).alias("p2"), only("all", own).alias("p3"), only("all_exp", own & exp).alias("p4")
    )
    rule = (
        F.when(F.col("p1").isNotNull(), "same_file").when(F.col("p2").isNotNull(), "imported").when(F.col("p3").isNotNull(), "unique").otherwise("unique_exported")
    )
    return picked.select("ref_id", F.coalesce("p1", "p2", "p3", "p4").alias("target"), rule.alias("rule")).filter("target is not null")


def framework_first(base: DataFrame, framework: DataFrame) -> DataFrame:
    """A framework's answer (ref_id, target) wins over the base one."""
    f = framework.select("ref_id", F.col("target").alias("f_target"))
    both = base.select("ref_id", "target").join(f, "ref_id", "full_outer")
    return both.select(
        "ref_id",
        F.coalesce("f_target", "target").alias("target"),
        F.when(F.col("f_target").isNotNull(), "heuristic").otherwise("tree-sitter").alias("provenance"),
    )


def route_targets(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Handlers named by routes: the only one in the same file, else the only one at all.

    Handlers are counted by name, and by name and file, first, so that a route meets one row of each, however many bear its name.
    """
    cand = nodes.filter(F.col("kind").isin("function", "method")).filter("name is not null")
    bearers = lambda n, name, *by: cand.groupBy(F.col("name").alias("reference_name"), *by).agg(F.count("*").alias(n), F.max("id").alias(name))
    met = refs.select("ref_id", "reference_name", "file_path").join(bearers("n", "any"), "reference_name")
    met = met.join(bearers("n_own", "own", "file_path"), ["reference_name", "file_path"], "left")
    picked = met.groupBy("ref_id").agg(
        F.when(F.sum("n_own") == 1, F.max("own")).alias("own"),
        F.when(F.sum("n") == 1, F.max("any")).alias("any"),
    )
    return picked.select("ref_id", F.coalesce("own", "any").alias("target")).filter("target is not null")


def import_targets(refs: DataFrame, files: DataFrame, suffixes: Sequence[str] = IMPORT_SUFFIXES) -> DataFrame:
    """ref_id, file_path, imported_path: the first candidate of each import that is a file.

    refs: ref_id, file_path, specifier. A specifier that is not relative never
    resolves. Extensions are appended, never swapped.
    """
    base = posix_join(posix_dirname(F.col("file_path")), F.col("specifier"))
    r = refs.filter(F.col("specifier").startswith(".")).withColumn("base", base)
    c = r.select("ref_id", "file_path", F.posexplode(F.transform(F.array(*map(F.lit, suffixes)), lambda s: F.concat(F.col("base"), s))).alias("pos", "candidate"))
    met = c.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    return met.groupBy("ref_id", "file_path").agg(F.min_by("candidate", "pos").alias("imported_path"))


def changed_files(tracked: DataFrame, current: DataFrame) -> DataFrame:
    """path, change of files added, edited (size or time differs) or deleted."""
    t = tracked.select("path", F.col("size").alias("size0"), F.col("modified_at").alias("at0"), F.lit(True).alias("known"))
    c = current.select("path", "size", "modified_at", F.lit(True).alias("there"))
    j = t.join(c, "path", "full_outer")
    change = (
        F.when(F.col("known").isNull(), "added")
        .when(F.col("there").isNull(), "deleted")
        .when(~F.col("size").eqNullSafe(F.col("size0")) | ~F.col("modified_at").eqNullSafe(F.col("at0")), "edited")
    )
    return j.select("path", change.alias("change")).filter("change is not null")


def nodes_by_file(nodes: DataFrame) -> DataFrame:
    """file_path, first (smallest ord), ids in that order."""
    at = F.array_sort(F.collect_list(F.struct("ord", "id")))
    return nodes.groupBy("file_path").agg(F.min("ord").alias("first"), F.transform(at, lambda x: x["id"]).alias("ids"))


def affected(roots: DataFrame, found: DataFrame) -> DataFrame:
    """id, depth of the roots (depth 0) and all that a change of them affects, in order of depth and id."""
    all_ = roots.select("id", F.lit(0).alias("depth")).unionByName(found.select("id", "depth"))
    return all_.groupBy("id").agg(F.min("depth").alias("depth")).orderBy("depth", "id")

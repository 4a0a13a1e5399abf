"""User-facing compositions: answers under a token budget, the whole check, doctor, dashboard, incremental sync."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import checkpoint
from ..functions.text import token_estimate
from . import drift, events, graph

RESERVE = 140
SCHEMA_VERSION = 1


def answer(
    facts: DataFrame, edges: DataFrame, command: str, budget: int = 1500, max_nodes: int = 10, sections: Sequence[tuple[str, DataFrame]] = ()
) -> DataFrame:
    """part, n, record: JSON lines of an answer (M10): meta, the facts that fit in order of ord, edges among them, further sections, summary.

    facts: id, ord, record (a struct). Facts stop at the first that does not fit
    (W11); of edges and sections, in this order, records that do not fit are skipped (W12). sections: name, and rows of ord (a string) and
    record (a struct). RESERVE tokens are kept for the frame; if they exceed the budget, the budget is raised and the answer marked
    as truncated.

    All of it is one plan. What is in one task is max_nodes facts, the edges among these, and the sections, which belong to them.
    """
    most = max(budget, 2 * RESERVE)
    room = most - RESERVE
    told = lambda kind, *fields: F.to_json(F.struct(F.lit(kind).alias("type"), *fields))
    first = facts.select("ord", "id", told("fact", "record.*").alias("record")).orderBy("ord", "id").limit(max_nodes)
    running = Window.partitionBy(F.lit(0)).orderBy("ord", "id")
    kept = first.withColumn("spent", F.sum(token_estimate(F.col("record"))).over(running.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("spent") <= room)
    kept = checkpoint(kept.withColumn("n", F.row_number().over(running)))
    facts_kept = F.array_sort(F.collect_list(F.struct("n", "record")))
    one = kept.agg(F.coalesce(F.max("spent"), F.lit(0)).alias("spent"), F.transform(facts_kept, lambda x: x["record"]).alias("facts"))

    among = graph.induced(edges, kept.select("id")).select("source", "target", "kind").distinct()
    rows = among.select(F.lit(0).alias("section"), F.lit("").alias("ord"), told("edge", "kind", "source", "target", F.lit("static").alias("provenance")).alias("record"))
    for k, (name, more) in enumerate(sections, 1):
        rows = rows.unionByName(more.select(F.lit(k).alias("section"), F.col("ord").cast("string").alias("ord"), told(name, "record.*").alias("record")))
    others = rows.agg(F.array_sort(F.collect_list(F.struct("section", "ord", "record"))).alias("others"))
    matched = facts.agg(F.count("*").alias("matched"))
    j = one.join(F.broadcast(others)).join(F.broadcast(matched))

    none = F.struct(F.col("spent").alias("spent"), F.slice("others", 1, 0).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        cost = token_estimate(x["record"])
        took = F.struct((acc["spent"] + cost).alias("spent"), F.concat(acc["kept"], F.array(x)).alias("kept"))
        return F.when(acc["spent"] + cost <= room, took).otherwise(acc)

    j = j.withColumn("r", F.aggregate("others", none, step))
    n_facts, n_edges = F.size("facts"), F.size(F.filter("r.kept", lambda x: x["section"] == 0))
    cut = (n_facts < F.col("matched")) | (F.size("r.kept") < F.size("others")) | F.lit(most > budget)
    meta = told("meta", F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(command).alias("command"), F.lit(max_nodes).alias("maxNodes"), F.lit(most).alias("maxOutputTokens"))
    summary = told(
        "summary", F.col("matched").alias("matchedNodes"), n_facts.alias("returnedNodes"), n_edges.alias("returnedEdges"), F.lit(most).alias("maxOutputTokens"), cut.alias("truncated"),
        (F.col("r.spent") + RESERVE).alias("estimatedOutputTokens"),
    )
    line = lambda part, n, record: F.struct(F.lit(part).alias("part") if isinstance(part, int) else part.alias("part"), n.cast("long").alias("n"), record.alias("record"))
    zero = F.lit(0)
    # positions within a section
    place = lambda x, i: i - F.size(F.filter("r.kept", lambda y: y["section"] < x["section"]))
    lines = F.concat(
        F.array(line(0, zero, meta)),
        F.transform("facts", lambda x, i: line(1, i, x)),
        F.transform("r.kept", lambda x, i: line(x["section"] + 2, place(x, i), x["record"])),
        F.array(line(3 + len(sections), zero, summary)),
    )
    return j.select(F.inline(lines))


def not_found(asked: DataFrame) -> DataFrame:
    """An error section of ids that no node has; asked: id, found (lookup.nodes_by_id)."""
    return asked.filter("not found").select(F.col("id").alias("ord"), F.struct(F.lit("NODE_NOT_FOUND").alias("code"), F.col("id").alias("target")).alias("record"))


def ambiguous(name: str, found: DataFrame) -> DataFrame:
    """An error section if a name means several nodes: one record with their number (C05); found: id."""
    n = found.select("id").distinct().agg(F.count("*").alias("n")).filter("n > 1")
    return n.select(F.lit(name).alias("ord"), F.struct(F.lit("TARGET_AMBIGUOUS").alias("code"), F.lit(name).alias("target"), F.col("n").alias("candidates")).alias("record"))


def check(parts: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All issues, and the report: score, errors, warnings, infos."""
    issues = drift.unite(parts)
    report = drift.severity_counts(issues).join(F.broadcast(drift.score(issues)))
    return issues, report


def doctor(report: DataFrame, heartbeat: DataFrame, log: DataFrame) -> DataFrame:
    """what, ok, n of the drift score, the heartbeat and the log (C10): at least 80 points and no error."""
    d = report.select(F.lit("drift").alias("what"), ((F.col("score") >= 80) & (F.col("errors") == 0)).alias("ok"), F.col("score").cast("long").alias("n"))
    stale = F.count(F.when(F.col("stale"), 1))
    h = heartbeat.agg((stale == 0).alias("ok"), stale.alias("n")).select(F.lit("heartbeat").alias("what"), "ok", "n")
    e = log.agg(F.count("*").alias("n")).select(F.lit("events").alias("what"), F.lit(True).alias("ok"), "n")
    return d.unionByName(h).unionByName(e)


def dashboard(report: DataFrame, activity: DataFrame) -> DataFrame:
    """score, bar (18 places), bars (activity of the days in order)."""
    bars = activity.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "bar"))), lambda x: x["bar"]), "").alias("bars"))
    return report.select("score", events.progress_bar(F.col("score")).alias("bar")).join(F.broadcast(bars))


def dashboard_lists(issues: DataFrame, log: DataFrame, n: int = 8) -> DataFrame:
    """what, place (from 1), line of the first n issues and the latest n events.

    issues: ord, severity, code, file; log: at, event_id, kind. No more than n rows of either come into one task.
    """

    def numbered(what: str, rows: DataFrame, *order: Column) -> DataFrame:
        first = rows.orderBy(*order).limit(n)
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
        return first.select(F.lit(what).alias("what"), place.alias("place"), "line")

    told = issues.select("ord", F.concat_ws(" ", "severity", "code", "file").alias("line"))
    said = log.select("at", "event_id", F.concat_ws(" ", F.date_format("at", "yyyy-MM-dd HH:mm"), "kind").alias("line"))
    return numbered("issue", told, F.col("ord")).unionByName(numbered("event", said, F.desc("at"), F.col("event_id")))


def sync(nodes: DataFrame, edges: DataFrame, refs: DataFrame, changed: DataFrame, fresh_nodes: DataFrame, fresh_refs: DataFrame, imports: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges, refs after some files changed (M08): their rows are replaced, all references resolved anew.

    changed: file_path of edited and deleted files. Edges of kind contains stay
    where their ends do (M04); others follow from the references.
    """
    n, e, _ = graph.delete_files(nodes, edges, refs, changed)
    n = n.unionByName(fresh_nodes)
    r = graph.delete_where(refs, changed, ["file_path"]).unionByName(fresh_refs)
    met = r.join(graph.resolve(r, n, imports), "ref_id").select(F.col("from_node_id").alias("source"), "target", F.col("reference_kind").alias("kind"), F.col("ref_id").alias("ord"))
    kept = e.filter("kind = 'contains'").select("source", "target", "kind", F.lit(0).cast(dict(met.dtypes)["ord"]).alias("ord"))
    return n, graph.valid_edges(graph.first_edges(met.unionByName(kept)), n), r


def contained(tokens: DataFrame, ranges: DataFrame, width: int = 64) -> DataFrame:
    """Tokens (file, at, until) within ranges (id, file, start, end), both ends included.

    A range join by buckets of width lines: a range is put into each bucket that
    it meets, a token into that of its first line.
    """
    r = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    t = tokens.withColumn("bucket", F.floor(F.col("at") / width))
    return t.join(r, ["file", "bucket"]).filter("at >= start and until <= end").drop("bucket")


def completeness(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., n, populated, per_cent of documents by status."""
    n = F.count("*")
    full = F.count(F.when(F.col("status") == "populated", 1))
    return nodes.groupBy(*by).agg(n.alias("n"), full.alias("populated"), F.round(full * 100 / n).cast("long").alias("per_cent"))

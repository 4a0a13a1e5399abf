"""The check of a whole scaffold: which documents belong to it, all checkers over them, and what is to be mended."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.store import checkpoint
from ..functions.text import escapes_root, glob_regex, posix_join
from ..sources import documents, files as sources
from . import drift

#: Documents of a scaffold below its folder, and those beside it.
PATTERNS = ("context/*.md", "patterns/*.md", "ROUTER.md", "AGENTS.md", "SETUP.md", "SYNC.md")
ROOT_FILES = ("CLAUDE.md", ".cursorrules", ".windsurfrules")
#: Documents whose age a heartbeat looks at.
HEARTBEAT_PATTERNS = ("ROUTER.md", "AGENTS.md", "context/*.md", "patterns/*.md")
#: Copies of one text for different tools; the first that is there is the model.
TOOL_CONFIGS = ("CLAUDE.md", "AGENTS.md", ".cursorrules", ".windsurfrules", ".github/copilot-instructions.md")
CHECKERS = (
    "edges", "staleness", "grounding", "paths", "commands", "dependencies", "cross-file", "index-sync", "script-coverage", "tool-config-sync",
    "todo-fixme", "broken-link",
)
MEMORY_DAYS, CLEANUP_DAYS = 14, 7


def _below(path: Column, scaffold: str) -> Column:
    """path without the scaffold's folder; null if it lies elsewhere."""
    return F.when(path.startswith(scaffold + "/"), F.substring(path, len(scaffold) + 2, 1 << 30)) if scaffold else path


def scaffold_files(files: DataFrame, scaffold: str = "scaffold", patterns: Sequence[str] = PATTERNS, root_files: Sequence[str] = ROOT_FILES) -> DataFrame:
    """source, text of the documents that belong to a scaffold, each once."""
    inside = _below(F.col("path"), scaffold)
    met = reduce(lambda a, b: a | b, [F.coalesce(F.regexp_like(inside, glob_regex(F.lit(p))), F.lit(False)) for p in patterns])
    if scaffold:
        met = met | F.col("path").isin(*root_files)
    return files.filter(met).select(F.col("path").alias("source"), "text").dropDuplicates(["source"])


def only_if(rows: DataFrame, there: DataFrame) -> DataFrame:
    """rows, or none of them where the other frame is empty."""
    return rows.withColumn("_any", F.lit(1)).join(F.broadcast(there.select(F.lit(1).alias("_any")).limit(1)), "_any", "left_semi").drop("_any")


def ages(docs: DataFrame, now: Column, commits: DataFrame | None = None) -> DataFrame:
    """file, days, commits, updated_days of documents (S19, F14): by the commit log, and by last_updated of the front matter."""
    said = F.try_to_date(F.regexp_extract("front", r"(?m)^last_updated:[ \t]*[\"']?(\d{4}-\d{2}-\d{2})", 1))
    rows = documents.front_matter(docs).select(F.col("source").alias("file"), F.datediff(F.to_date(now), said).alias("updated_days"))
    if commits is None:
        return rows.select("file", F.lit(None).cast("long").alias("days"), F.lit(None).cast("long").alias("commits"), "updated_days")
    return rows.join(sources.commit_age(commits, now), "file", "left").select("file", "days", "commits", "updated_days")


def index_entries(index: DataFrame) -> DataFrame:
    """name of the documents that an index links or names between backticks; comments don't count."""
    bare = F.regexp_replace("text", r"<!--[\s\S]*?-->", "")
    linked = F.regexp_extract_all(bare, F.lit(r"\[[^\]\n]*\]\(([^)\n]+?\.md)(?:#[\w-]+)?\)"), F.lit(1))
    named = F.regexp_extract_all(bare, F.lit(r"`([\w-]+\.md)`"), F.lit(1))
    return index.select(F.explode(F.array_union(linked, named)).alias("name"))


def index_issues(docs: DataFrame, paths: DataFrame, scaffold: str = "scaffold") -> DataFrame:
    """Pattern documents that the index lacks, and its entries that lead to no file (J15); no index, no check."""
    folder = f"{scaffold}/patterns" if scaffold else "patterns"
    index = docs.filter(F.col("source") == f"{folder}/INDEX.md")
    name = F.regexp_extract("path", rf"^{folder}/([^./][^/]*\.md)$", 1)
    own = paths.select(name.alias("name")).filter(~F.col("name").isin("", "INDEX.md", "README.md"))
    # an entry that leads to a file of another folder is no orphan, and stands for no pattern
    e = index_entries(index).join(own, "name", "left_semi").unionByName(
        index_entries(index).withColumn("path", posix_join(F.lit(folder), F.col("name"))).join(paths.select("path"), "path", "left_anti").select("name")
    )
    return only_if(drift.index_sync(e, own), index)


def tool_config_issues(files: DataFrame) -> DataFrame:
    """Copies of the tools' text that are not equal to the first that there is."""
    copies = files.filter(F.col("path").isin(*TOOL_CONFIGS)).select("path", "text", F.array_position(F.array(*map(F.lit, TOOL_CONFIGS)), F.col("path")).alias("ord"), F.lit(1).alias("all"))
    off = drift.differs_from_first(copies, ["all"], "ord", "text")
    return off.select(*drift.issue("TOOL_CONFIG_DRIFT", "warning", F.col("path"), None, F.lit("not equal to the first tool config")))


def marker_issues(docs: DataFrame) -> DataFrame:
    """TODO_FIXME for each mark."""
    return drift.markers(drift.lines(docs, "source"), key="source").select(*drift.issue("TODO_FIXME", "warning", F.col("source"), F.col("line"), F.col("marker")))


def run(
    files: DataFrame, now: Column, scaffold: str = "scaffold", commits: DataFrame | None = None, limits: dict = drift.STALE, grounding: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Issues (checker, code, severity, file, line, message) of all twelve checkers, and the claims they rest on.

    files: path, text of the whole project. grounding: issues of groundings and
    anchors, where there is a code graph (operators.grounding). Paths are claimed
    by ROUTER.md alone (F06). What lacks its manifest is not checked.
    """
    docs = checkpoint(scaffold_files(files, scaffold))
    claims = checkpoint(documents.claims(docs))
    paths = files.select("path").distinct()
    known = paths.unionByName(paths.select(_below(F.col("path"), scaffold).alias("path")).filter("path is not null")).distinct()
    router = claims.filter(F.col("source").rlike("(^|/)ROUTER\\.md$"))
    manifest = sources.manifest(files)
    parts = {
        "edges": drift.dead_edges(documents.front_edges(docs), known),
        "staleness": drift.staleness(ages(docs, now, commits), limits),
        "paths": drift.missing_paths(router, paths, scaffold, sources.workspace_names(files)),
        "commands": drift.dead_commands(claims, sources.scripts(files), sources.make_targets(files)),
        "dependencies": only_if(drift.dependencies(claims, manifest), manifest),
        "cross-file": drift.version_conflicts(claims).unionByName(drift.manager_conflicts(claims)),
        "index-sync": index_issues(docs, paths, scaffold),
        "script-coverage": drift.undocumented_scripts(sources.scripts(files), docs.select("text")),
        "tool-config-sync": tool_config_issues(files),
        "todo-fixme": marker_issues(docs),
        "broken-link": drift.broken_links(documents.links(docs), paths, scaffold),
    }
    if grounding is not None:
        parts["grounding"] = grounding
    found = [p.select(F.lit(k).alias("checker"), *drift.COLUMNS) for k, p in parts.items()]
    return reduce(DataFrame.unionByName, found), claims


def counts(issues: DataFrame, claims: DataFrame) -> DataFrame:
    """what, name, n: claims by kind, and issues of every checker, those that found none too."""
    all_ = issues.sparkSession.createDataFrame([(c,) for c in CHECKERS], "name string")
    found = issues.groupBy(F.col("checker").alias("name")).agg(F.count("*").alias("n"))
    told = F.broadcast(all_).join(found, "name", "left").select(F.lit("issues").alias("what"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    return claims.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).select(F.lit("claims").alias("what"), "name", "n").unionByName(told)


def repair_targets(issues: DataFrame, warnings: bool = False) -> DataFrame:
    """file, first, issues of the files to be mended (C07): those with an error, and what concerns groundings; with warnings, all.

    issues has ord, the order in which they were found.
    """
    return drift.by_file(issues if warnings else drift.in_error_files(issues))


def in_order(issues: DataFrame) -> DataFrame:
    """issues with ord: by checker, file, line, code and message."""
    place = F.array_position(F.array(*map(F.lit, CHECKERS)), F.col("checker"))
    return issues.withColumn("ord", F.struct(place.alias("p"), "file", F.coalesce("line", F.lit(0)).alias("line"), "code", "message"))


def heartbeat_files(files: DataFrame, scaffold: str = "scaffold") -> DataFrame:
    """key, last_updated of the documents that a heartbeat looks at (S22); null where none is told."""
    docs = scaffold_files(files, scaffold, HEARTBEAT_PATTERNS, ())
    said = F.regexp_extract("front", r"(?m)^last_updated:[ \t]*[\"']?(\d{4}-\d{2}-\d{2})", 1)
    return documents.front_matter(docs).select(F.col("source").alias("key"), F.try_to_timestamp(said).alias("last_updated"))


def old_memory(files: DataFrame, now: Column, days: int = MEMORY_DAYS) -> DataFrame:
    """path, days of daily notes memory/YYYY-MM-DD.md that are older than days."""
    day = F.try_to_date(F.regexp_extract("path", r"^memory/(\d{4}-\d{2}-\d{2})\.md$", 1))
    return files.select("path", F.datediff(F.to_date(now), day).alias("days")).filter(F.col("days") > days)


def cleanup_due(files: DataFrame, now: Column, days: int = CLEANUP_DAYS) -> DataFrame:
    """due: whether the last clean-up that is told was more than days ago (S22); one row, false without one."""
    said = F.try_to_timestamp(F.get_json_object("text", "$.lastCleanup"))
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(said)) / 86400)
    return files.filter("path = 'memory/.last-cleanup.json'").agg(F.coalesce(F.max(age > days), F.lit(False)).alias("due"))


def read_files(files: DataFrame, asked: DataFrame, scaffold: str = "scaffold") -> DataFrame:
    """file, status (ok, missing, escapes), text of documents asked for by paths below the scaffold.

    A path that leads out of the folder is refused, whether it is absolute or has too many "..".
    """
    a = asked.select("file").distinct().withColumn("out", escapes_root(F.col("file")))
    a = a.withColumn("path", F.when(~F.col("out"), posix_join(F.lit(scaffold), F.col("file"))))
    j = a.join(files.select("path", "text", F.lit(True).alias("there")), "path", "left")
    status = F.when(F.col("out"), "escapes").when(F.col("there").isNull(), "missing").otherwise("ok")
    return j.select("file", status.alias("status"), "text")


def thresholds(text: str | None) -> dict:
    """Limits of drift.staleness from a configuration's JSON.

    Numbers of 0 or more under "staleness" count, others are as by default. Limits that would
    never warn, since the error comes first, are dropped as a whole.
    """
    names = {"warnDays": "warn_days", "errorDays": "error_days", "warnCommits": "warn_commits", "errorCommits": "error_commits"}
    try:
        said = json.loads(text or "null")
    except ValueError:
        said = None
    said = said.get("staleness") if isinstance(said, dict) else None
    said = said if isinstance(said, dict) else {}
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v < float("inf")
    out = drift.STALE | {mine: said[k] for k, mine in names.items() if number(said.get(k))}
    inverted = out["error_days"] < out["warn_days"] or out["error_commits"] < out["warn_commits"]
    return dict(drift.STALE) if inverted else out


def adjacency(edges: DataFrame) -> DataFrame:
    """file, targets: the documents that each one leads to, each once, in order."""
    return edges.groupBy("file").agg(F.array_sort(F.collect_set("target")).alias("targets"))

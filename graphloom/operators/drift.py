"""Checks of documents against reality, as DataFrames of issues, and the score.

Every check returns code, severity, file, line, message (U05 unites them).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.store import checkpoint
from ..sources.documents import NEGATED
from . import patterns

#: What an issue costs.
COST = {"error": 10, "warning": 3, "info": 1}
#: Runtimes, platforms, databases, protocols and tools that need no entry in a manifest.
RUNTIMES = (
    "node.js", "node", "nodejs", "python", "cpython", "go", "golang", "rust", "ruby", "java", "jdk", "jre", "deno", "bun",
    "swift", "kotlin", "elixir", "erlang", "php", ".net", "dotnet", "c#", "csharp", "sqlite", "sqlite3", "postgresql",
    "postgres", "mysql", "mariadb", "mongodb", "mongo", "redis", "elasticsearch", "dynamodb", "cassandra", "neo4j",
    "supabase", "neon", "docker", "kubernetes", "k8s", "vercel", "netlify", "railway", "fly.io", "render", "aws", "gcp",
    "azure", "cloudflare", "s3", "ec2", "lambda", "ecs", "fargate", "rest", "rest api", "graphql", "grpc", "websocket",
    "websockets", "oauth", "oauth2", "jwt", "saml", "oidc", "http", "https", "tcp", "udp", "tailwind", "tailwind css",
    "tailwindcss", "bootstrap", "sass", "less", "postcss", "webpack", "vite", "esbuild", "turbopack", "rollup", "parcel",
    "git", "github", "gitlab", "ci/cd", "nginx", "apache", "caddy", "linux", "macos", "windows", "wasm", "webassembly",
)
#: Scripts that run by themselves.
LIFECYCLE = (
    "preinstall", "install", "postinstall", "preuninstall", "uninstall", "postuninstall", "prepublish", "prepublishOnly",
    "publish", "postpublish", "prepack", "pack", "postpack", "prepare", "preshrinkwrap", "shrinkwrap", "postshrinkwrap",
)
STALE = {"warn_days": 30, "error_days": 90, "warn_commits": 50, "error_commits": 200}
#: How claims state a version, and how they run a script.
VERSION_CLAIM = r"^(.+?)\s+v?(\d[\d.]*\S*)$"
RUN_CLAIM = r"^(?:npm\s+run|yarn|pnpm|bun\s+run)\s+(\S+)"
#: What is no path of a file system, what names a package, and words of a path that stand for others.
URL = r"^(?:https?|ftp|file)://|^//"
SCOPED_PACKAGE = r"^(@[\w-]+/[\w-]+)(?:/.*)?$"
PLACEHOLDER_WORDS = r"(?i)(?:^|[/_-])(?:new|example|your|sample|my|foo|bar|placeholder|template)(?:[/_.-]|$)"
COLUMNS = ("code", "severity", "file", "line", "message")


def issue(code: str, severity: Column | str, file: Column, line: Column | None, message: Column) -> list[Column]:
    s = F.lit(severity) if isinstance(severity, str) else severity
    return [
        F.lit(code).alias("code"), s.alias("severity"), file.alias("file"),
        (F.lit(None) if line is None else line).cast("int").alias("line"), message.alias("message"),
    ]


def unite(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])


def score(issues: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., score from 0 to 100 (A01). Without by, no issues score 100."""
    cost = F.coalesce(*[F.when(F.col("severity") == s, F.lit(c)) for s, c in COST.items()], F.lit(0))
    total = F.coalesce(F.sum(cost), F.lit(0))
    return issues.groupBy(*by).agg(F.greatest(F.lit(0), F.least(F.lit(100), 100 - total)).cast("long").alias("score"))


def severity_counts(issues: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """errors, warnings, infos."""
    n = lambda s: F.count(F.when(F.col("severity") == s, 1))
    return issues.groupBy(*by).agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"))


def in_error_files(issues: DataFrame) -> DataFrame:
    """Issues of files that have an error, and all grounding issues."""
    bad = issues.filter("severity = 'error'").select("file").distinct()
    return issues.join(bad.withColumn("bad", F.lit(True)), "file", "left").filter("bad or code like 'GROUNDING%'").drop("bad")


def by_file(issues: DataFrame) -> DataFrame:
    """file, first (smallest ord), issues in order (A05); issues has ord."""
    return issues.groupBy("file").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "code", "severity"))).alias("issues"))


def by_severity(issues: DataFrame) -> DataFrame:
    """severity, file, n, first: issues by severity and within that by file (A04); issues has ord. Counts and places only, so that a file
    with very many issues is no long row."""
    return issues.groupBy("severity", "file").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


def missing_paths(claims: DataFrame, paths: DataFrame, scaffold: str = "scaffold", packages: DataFrame | None = None) -> DataFrame:
    """Claimed paths of which no alternative exists (J13): as given, below the folder of documents, without that
    folder, and a bare file name anywhere. URLs are no paths, and neither is what a package of the project's
    workspaces holds (packages: name) (F07). Of patterns and placeholders it is a warning (F12)."""
    c = claims.filter("kind = 'path' and not negated").filter(~F.col("value").rlike(URL)).dropDuplicates(["source", "line", "value"])
    if packages is not None:
        c = c.withColumn("package", F.regexp_extract("value", SCOPED_PACKAGE, 1)).join(packages.select(F.col("name").alias("package")).distinct(), "package", "left_anti")
    tried = F.array_distinct(F.array("value", F.concat(F.lit(scaffold + "/"), "value"), F.when(F.col("value").startswith(scaffold + "/"), F.substring("value", len(scaffold) + 2, 1 << 30)).otherwise(F.col("value")), F.regexp_replace("value", r"^\./", "")))
    alt = c.select("source", "line", "value", F.explode(tried).alias("path"))
    bare = paths.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("bare")).distinct()
    found = alt.join(paths.select("path").distinct(), "path", "left_semi").select("source", "line", "value")
    named = c.join(bare, (F.col("value") == F.col("bare")) & ~F.col("value").contains("/"), "left_semi").select("source", "line", "value")
    gone = c.select("source", "line", "value").join(found.unionByName(named).distinct(), ["source", "line", "value"], "left_anti")
    soft = F.col("source").contains("patterns/") | F.col("value").rlike(r"[<>\[\]{}]") | F.col("value").rlike(PLACEHOLDER_WORDS)
    return gone.select(*issue("MISSING_PATH", F.when(soft, "warning").otherwise("error"), F.col("source"), F.col("line"), F.concat(F.lit("no such path: "), "value")))


def dead_edges(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Front-matter edges whose target is no file (J14); edges: file, target."""
    gone = edges.join(paths.select(F.col("path").alias("target")), "target", "left_anti")
    return gone.select(*issue("DEAD_EDGE", "error", F.col("file"), None, F.concat(F.lit("no such document: "), "target")))


def index_sync(entries: DataFrame, files: DataFrame, index: str = "patterns/INDEX.md") -> DataFrame:
    """Files without an entry, and entries without a file (J15); both: name."""
    e, f = entries.select("name").distinct(), files.select("name").distinct()
    lost = f.join(e, "name", "left_anti").select(*issue("INDEX_MISSING_ENTRY", "warning", F.lit(index), None, F.col("name")))
    orphan = e.join(f, "name", "left_anti").select(*issue("INDEX_ORPHAN_ENTRY", "warning", F.lit(index), None, F.col("name")))
    return lost.unionByName(orphan)


def dead_commands(claims: DataFrame, scripts: DataFrame, targets: DataFrame) -> DataFrame:
    """Commands that name no script or make target (J16); a check is skipped where its manifest has none at all."""
    c = claims.filter("kind = 'command' and not negated")
    run = c.withColumn("name", F.regexp_extract("value", r"^(?:npm run|bun run|yarn|pnpm)\s+([\w:.-]+)", 1)).filter("name != ''")
    make = c.withColumn("name", F.regexp_extract("value", r"^make\s+([\w-]+)", 1)).filter("name != ''")

    def check(rows: DataFrame, known: DataFrame) -> DataFrame:
        any_ = F.broadcast(known.select(F.lit(1).alias("any")).limit(1))
        return rows.join(known.select("name").distinct(), "name", "left_anti").withColumn("any", F.lit(1)).join(any_, "any", "left_semi")

    gone = check(run, scripts).unionByName(check(make, targets))
    return gone.select(*issue("DEAD_COMMAND", "error", F.col("source"), F.col("line"), F.col("value")))


def dependencies(claims: DataFrame, manifest: DataFrame) -> DataFrame:
    """Claimed dependencies that the manifest lacks, and versions that differ (J17, J18); manifest: name, version."""
    m = manifest.select(F.lower("name").alias("low"), "version")
    d = claims.filter("kind = 'dependency' and not negated").withColumn("low", F.lower("value")).filter(~F.col("low").isin(*RUNTIMES))
    lost = d.join(m, "low", "left_anti").select(*issue("DEPENDENCY_MISSING", "warning", F.col("source"), F.col("line"), F.col("value")))
    v = versions(claims).withColumnRenamed("dep", "low")
    off = v.join(m, "low").filter(~F.col("version").contains(F.col("said")))
    return lost.unionByName(off.select(*issue("VERSION_MISMATCH", "warning", F.col("source"), F.col("line"), F.col("value"))))


def versions(claims: DataFrame) -> DataFrame:
    """Version claims split: dep (lower case), said. Signs before the number other than v are not understood."""
    p = VERSION_CLAIM
    v = claims.filter(F.col("kind").eqNullSafe("version") & ~F.col("negated") & F.col("value").rlike(p))
    return v.withColumn("dep", F.lower(F.trim(F.regexp_extract("value", p, 1)))).withColumn("said", F.regexp_extract("value", p, 2))


def version_conflicts(claims: DataFrame) -> DataFrame:
    """Dependencies of which different values are claimed; whole values count."""
    g = versions(claims).groupBy("dep").agg(
        F.count("*").alias("n"), F.count_distinct("value").alias("k"), F.min(F.struct("source", "line")).alias("at"),
        F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("said"),
    )
    return g.filter("n > 1 and k > 1").select(*issue("CROSS_FILE_CONFLICT", "error", F.col("at.source"), F.col("at.line"), F.concat_ws(": ", "dep", "said")))


def manager_conflicts(claims: DataFrame) -> DataFrame:
    """Scripts that several files run with different package managers."""
    p = RUN_CLAIM
    c = claims.filter((F.col("kind") == "command") & ~F.col("negated")).withColumn("script", F.regexp_extract("value", p, 1)).filter("script != ''")
    g = c.groupBy("script").agg(F.count_distinct("source").alias("files"), F.count_distinct(F.regexp_extract("value", r"^(\S+)", 1)).alias("managers"), F.min(F.struct("source", "line")).alias("at"))
    return g.filter("files > 1 and managers > 1").select(*issue("CROSS_FILE_CONFLICT", "warning", F.col("at.source"), F.col("at.line"), F.col("script")))


def uncovered(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Names that occur in no text (J19): name. Each text is read once for all of them."""
    return names.select("name").distinct().join(patterns.occurring(names, texts).select("name"), "name", "left_anti")


def undocumented_scripts(names: DataFrame, texts: DataFrame) -> DataFrame:
    """UNDOCUMENTED_SCRIPT, without lifecycle scripts, pre/post variants of known ones, and variants a:b of a documented a."""
    known = names.select(F.col("name").alias("of")).distinct()
    n = names.filter(~F.col("name").isin(*LIFECYCLE)).withColumn("of", F.regexp_extract("name", "^(?:pre|post)(.+)$", 1))
    own = n.join(known, "of", "left_anti").select("name").distinct()
    base = own.select(F.regexp_extract("name", "^([^:]+):", 1).alias("base"), "name").filter("base != ''")
    bases = base.join(known, base["base"] == known["of"], "left_semi").select(F.col("base").alias("name")).distinct()
    # texts are searched once for all names
    missing = checkpoint(uncovered(own.unionByName(bases), texts))
    told = bases.join(missing, "name", "left_anti").select(F.col("name").alias("base"))
    variants = base.join(told, "base", "left_semi").select("name")
    return missing.join(own, "name", "left_semi").join(variants, "name", "left_anti").select(*issue("UNDOCUMENTED_SCRIPT", "warning", F.lit("package.json"), None, F.col("name")))


def differs_from_first(copies: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Copies that are not equal to the first one of their group."""
    w = Window.partitionBy(*by).orderBy(order)
    return copies.withColumn("_f", F.first(value).over(w)).filter(~F.col(value).eqNullSafe(F.col("_f"))).drop("_f")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 1), s."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "s")).select(key, (F.col("pos") + 1).alias("line"), "s")


def fenced(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds in_fence: whether a line stands within a fence, which a line that starts with ``` opens or closes."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.ltrim("s").startswith("```")
    return rows.withColumn("fence", mark).withColumn("in_fence", F.sum(mark.cast("int")).over(w) % 2 == 1)


def sections(rows: DataFrame, heading: Column, key: str = "doc_id") -> DataFrame:
    """Adds section: the last heading up to the line (W10); heading is null on other lines."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def negated(section: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(section).contains(p) for p in NEGATED])


def markers(rows: DataFrame, pattern: str = "TODO|FIXME", key: str = "doc_id") -> DataFrame:
    """key, line, marker: one row for each mark, several on a line too (the to-do check); ASCII word bounds."""
    whole = F.lit(rf"(?<![A-Za-z0-9_])({pattern})(?![A-Za-z0-9_])")
    return rows.select(key, "line", F.explode(F.regexp_extract_all("s", whole, F.lit(1))).alias("marker"))


def broken_links(links: DataFrame, paths: DataFrame, scaffold: str = "scaffold") -> DataFrame:
    """Links of which no alternative exists (J22): links: file, line, target; relative to the file and to the root."""
    from ..functions.text import posix_dirname, posix_join

    own = links.filter(~F.col("target").rlike(r"(?i)^(https?://|mailto:|node://|#)"))
    bare = F.regexp_replace("target", r"[#?].*$", "")
    own = own.withColumn("bare", bare).filter("bare != ''")
    tried = F.array(posix_join(posix_dirname(F.col("file")), F.col("bare")), posix_join(F.lit(""), F.col("bare")), F.concat(F.lit(scaffold + "/"), posix_join(F.lit(""), F.col("bare"))))
    alt = own.select("file", "line", "target", F.explode(tried).alias("path")).join(paths.select("path").distinct(), "path", "left_semi")
    gone = own.join(alt.select("file", "line", "target").distinct(), ["file", "line", "target"], "left_anti")
    severity = F.when(F.col("file").contains("patterns/"), "warning").otherwise("error")
    return gone.select(*issue("BROKEN_LINK", severity, F.col("file"), F.col("line"), F.col("target")))


def staleness(files: DataFrame, limits: dict = STALE) -> DataFrame:
    """One issue for each stale file (A12): files: file, days, commits, updated_days; any may be null."""
    signal = lambda c, k: F.when(F.col(c) >= limits[f"error_{k}"], "error").when(F.col(c) >= limits[f"warn_{k}"], "warning")
    rows = files.withColumn("s1", signal("days", "days")).withColumn("s2", signal("commits", "commits")).withColumn("s3", signal("updated_days", "days"))
    told = F.concat_ws(
        "; ",
        F.when(F.col("s1").isNotNull(), F.concat(F.col("days").cast("string"), F.lit(" days since last change"))),
        F.when(F.col("s2").isNotNull(), F.concat(F.col("commits").cast("string"), F.lit(" commits since last change"))),
        F.when(F.col("s3").isNotNull(), F.concat(F.col("updated_days").cast("string"), F.lit(" days since last update"))),
    )
    some = rows.filter("coalesce(s1, s2, s3) is not null")
    worst = F.when(F.array_contains(F.array_compact(F.array("s1", "s2", "s3")), "error"), "error").otherwise("warning")
    return some.select(*issue("STALE_FILE", worst, F.col("file"), None, told))


def grounding_issues(states: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Issues of groundings: drifted bodies, and missing nodes by their verdict."""
    j = states.join(verdicts.select(F.col("id").alias("node_id"), "verdict"), "node_id", "left")
    code = (
        F.when((F.col("state") == "drifted") | (F.col("verdict") == "MOVED"), "GROUNDING_DRIFT")
        .when(F.col("verdict") == "AMBIGUOUS", "GROUNDING_AMBIGUOUS")
        .otherwise("GROUNDING_GONE")
    )
    bad = j.filter("state in ('drifted', 'missing')").withColumn("code", code)
    severity = F.when(F.col("code") == "GROUNDING_GONE", "error").otherwise("warning")
    return bad.select("code", severity.alias("severity"), "file", F.lit(None).cast("int").alias("line"), F.col("node_id").alias("message"))

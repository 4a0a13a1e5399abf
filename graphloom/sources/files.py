"""Scans of source trees and documents, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of source files, and folders that are left out.
SOURCE_EXTENSIONS = ("ts", "mts", "cts", "tsx", "js", "mjs", "cjs", "jsx", "py", "rs")
IGNORED_FOLDERS = ("node_modules", ".git", "dist", "build", "coverage", ".next", "out")
LANGUAGES = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript",
    "cjs": "javascript", "jsx": "jsx", "py": "python", "rs": "rust",
}


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = SOURCE_EXTENSIONS, ignored: tuple[str, ...] = IGNORED_FOLDERS) -> DataFrame:
    """path (below root), text, size, modified_at, language of the source files below root."""
    glob = "*.{" + ",".join(extensions) + "}"
    # a text source takes the whole file as one row; names and times come with it
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    meta = F.col("_metadata")
    full = F.regexp_replace(F.url_decode(F.regexp_replace(meta["file_path"], r"\+", "%2B")), "^file:/*", "/")
    base = F.lit("/" + root.removeprefix("file:").strip("/") + "/")
    rows = rows.select(full.alias("full"), F.col("value").alias("text"), meta["file_size"].alias("size"), meta["file_modification_time"].alias("modified_at"))
    rows = rows.withColumn("path", F.substring(F.col("full"), F.length(base) + 1, F.length("full")))
    away = "(^|/)(" + "|".join(x.replace(".", r"\.") for x in ignored) + ")/"
    return rows.filter(~F.col("path").rlike(away)).select("path", "text", "size", "modified_at", language(F.col("path")).alias("language"))


def language(path):
    """The language of a path by its extension; unknown for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit("unknown")
    for k, v in LANGUAGES.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def listing(rows: DataFrame) -> DataFrame:
    """path, size, modified_at: what a changed-file scan compares."""
    return rows.select("path", "size", "modified_at")


def source_range(files: DataFrame, ranges: DataFrame, max_lines: int = 120) -> DataFrame:
    """path, start_line, end_line, source, truncated: lines of files, 1-based, both ends included.

    max_lines 0 means all.
    """
    n = F.col("end_line") - F.col("start_line") + 1
    take = F.greatest(F.when(F.lit(max_lines) == 0, n).otherwise(F.least(n, F.lit(max_lines))), F.lit(0))
    j = ranges.join(files.select("path", "text"), "path")
    body = F.array_join(F.slice(F.split("text", "\n"), F.col("start_line"), take), "\n")
    return j.select("path", "start_line", "end_line", body.alias("source"), (n > take).alias("truncated"))


#: What the beginning of a folder's name tells; the first that fits counts.
FOLDER_KINDS = {
    "routes": "(routes?|pages?|api|endpoints?)",
    "models": "(models?|entities|schemas?|types?)",
    "services": "(services?|providers?|handlers?|controllers?|actions?)",
    "tests": "(tests?|__tests__|spec|__spec__)",
    "config": "(config|configs?|settings?)",
    "utils": "(utils?|helpers?|lib|shared|common)",
    "views": "(views?|components?|templates?|layouts?|ui)",
}


def folders(files: DataFrame, depth: int = 4) -> DataFrame:
    """folder, category, n: top folders by number of files down to a depth."""
    parts = F.split("path", "/")
    rows = files.filter(F.size(parts) > 1).select(F.get(parts, 0).alias("folder"), (F.size(parts) - 1).alias("d"))
    g = rows.groupBy("folder").agg(F.count(F.when(F.col("d") <= depth, 1)).alias("n"))
    cat = F.lit("other")
    for k, p in reversed(FOLDER_KINDS.items()):
        cat = F.when(F.col("folder").rlike("(?i)^" + p), k).otherwise(cat)
    return g.select("folder", cat.alias("category"), "n").orderBy(F.col("n").desc(), "folder")


def first_existing(files: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """what, path: for each thing the first of its names that exists."""
    rows = [(what, i, p) for what, names in wanted.items() for i, p in enumerate(names)]
    w = files.sparkSession.createDataFrame(rows, "what string, pos int, path string")
    return files.select("path").join(F.broadcast(w), "path").groupBy("what").agg(F.min_by("path", "pos").alias("path"))


def manifest(files: DataFrame) -> DataFrame:
    """name, version of the dependencies in package.json, dev ones too."""
    p = files.filter("path = 'package.json'").select(F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    both = p.select(F.explode(F.map_entries("j.dependencies")).alias("e")).unionByName(p.select(F.explode(F.map_entries("j.devDependencies")).alias("e")))
    return both.select(F.col("e.key").alias("name"), F.col("e.value").alias("version"))


def scripts(files: DataFrame) -> DataFrame:
    """name: scripts of package.json."""
    p = files.filter("path = 'package.json'").select(F.from_json("text", "scripts map<string,string>").alias("j"))
    return p.select(F.explode(F.map_keys("j.scripts")).alias("name"))


def make_targets(files: DataFrame) -> DataFrame:
    """name: targets of Makefile."""
    return files.filter("path = 'Makefile'").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^(\w[\w-]*):"), F.lit(1))).alias("name"))


def commit_age(commits: DataFrame, now) -> DataFrame:
    """file, days, commits since each file's last change (S19, W08); commits: id, at, files.

    A commit's place is the number of later days' commits and its place within its day: only
    the sums of days, not the commits, pass through one window.
    """
    from pyspark.sql import Window

    c = commits.withColumn("day", F.to_date("at"))
    later = Window.partitionBy(F.lit(0)).orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = c.groupBy("day").agg(F.count("*").alias("n")).select("day", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("day").orderBy(F.col("at").desc(), "id")) - 1
    ranked = c.withColumn("nth", within).join(days, "day").withColumn("pos", F.col("before") + F.col("nth"))
    touched = ranked.select(F.explode("files").alias("file"), "pos", "at")
    return touched.groupBy("file").agg(F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.max("at"))) / 86400).alias("days"), F.min("pos").alias("commits"))


def write_records(rows: DataFrame, path: str, order: str) -> None:
    """JSON lines in an order: meta, data, summary (M10); an answer is small, so that one file takes it."""
    rows.orderBy(order).drop(order).coalesce(1).write.mode("overwrite").json(path)


def entry_points(files: DataFrame, kinds: dict[str, tuple[str, ...]], caps: dict[str, int] | None = None) -> DataFrame:
    """path, type of the files that a kind's patterns (Java regular expressions) find; the first kind counts.

    caps limits how many of a kind are reported, by path, such as ten tests.
    """
    from pyspark.sql import Window

    kind = F.lit(None).cast("string")
    for k, patterns in reversed(kinds.items()):
        kind = F.when(F.col("path").rlike("|".join(f"(?:{p})" for p in patterns)), k).otherwise(kind)
    rows = files.select("path", kind.alias("type")).filter("type is not null").distinct()
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("type").orderBy("path")))
    most = F.coalesce(*[F.when(F.col("type") == k, F.lit(c)) for k, c in (caps or {}).items()], F.lit(1 << 30))
    return ranked.filter(F.col("n") <= most).select("path", "type")


def readme(files: DataFrame, names: tuple[str, ...] = ("README.md", "readme.md", "README", "README.txt"), limit: int = 3000) -> DataFrame:
    """path, text of the first readme that there is, cut at limit characters with a mark."""
    best = first_existing(files, {"readme": names})
    text = F.when(F.length("text") > limit, F.concat(F.left("text", F.lit(limit)), F.lit("\n...(truncated)"))).otherwise(F.col("text"))
    return files.join(best, "path").select("path", text.alias("text"))


def workspace_patterns(files: DataFrame) -> DataFrame:
    """pattern: folders of workspaces by package.json, as a list or under packages; else by pnpm-workspace.yaml."""
    said = F.get_json_object("text", "$.workspaces")
    listed = F.when(said.startswith("["), said).otherwise(F.get_json_object("text", "$.workspaces.packages"))
    first = files.filter("path = 'package.json'").select(F.lit(1).alias("way"), F.from_json(listed, "array<string>").alias("p"))
    block = F.regexp_extract("text", r"(?m)^packages:[ \t]*\r?\n((?:[ \t]*-[^\n]*(?:\n|$)|[ \t]*(?:#[^\n]*)?\n)+)", 1)
    items = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]*[\"']?([^\"'\s#]+)"), F.lit(1))
    second = files.filter("path = 'pnpm-workspace.yaml'").select(F.lit(2).alias("way"), items.alias("p"))
    best = first.unionByName(second).filter(F.size("p") > 0).agg(F.min_by("p", "way").alias("p"))
    return best.select(F.explode("p").alias("pattern"))


def workspace_names(files: DataFrame) -> DataFrame:
    """path, name of the packages in workspaces that have a name (S20); one manifest's patterns are broadcast."""
    from ..functions.text import glob_regex

    p = files.filter("path like '%/package.json'").select(F.regexp_replace("path", "/package.json$", "").alias("path"), F.get_json_object("text", "$.name").alias("name"))
    bare = F.regexp_replace("pattern", r"^\./|/+$", "")
    globs = workspace_patterns(files).filter("pattern not like '!%'").select(glob_regex(bare).alias("glob"))
    return p.filter("name is not null").join(F.broadcast(globs), F.expr("regexp_like(path, glob)"), "left_semi")


#: The files by which a project's tools are told; of each kind the first that is there counts.
TOOLS = {
    "test_runner": {
        "vitest": ("vitest.config.ts", "vitest.config.js"), "jest": ("jest.config.ts", "jest.config.js", "jest.config.json"),
        "pytest": ("pytest.ini", "pyproject.toml"), "mocha": (".mocharc.yml", ".mocharc.json"),
    },
    "build_tool": {
        "tsup": ("tsup.config.ts", "tsup.config.js"), "vite": ("vite.config.ts", "vite.config.js"), "next": ("next.config.ts", "next.config.js", "next.config.mjs"),
        "webpack": ("webpack.config.ts", "webpack.config.js"), "rollup": ("rollup.config.ts", "rollup.config.js"), "esbuild": ("esbuild.config.ts",), "make": ("Makefile",),
    },
    "linter": {
        "eslint": ("eslint.config.js", "eslint.config.mjs", ".eslintrc.js", ".eslintrc.json", ".eslintrc.yml"), "pylint": (".pylintrc", "pylintrc"),
        "flake8": (".flake8",), "golangci-lint": (".golangci.yml",),
    },
    "formatter": {"prettier": (".prettierrc", ".prettierrc.json", ".prettierrc.js", "prettier.config.js"), "biome": ("biome.json",), "editorconfig": (".editorconfig",)},
    "package_manager": {"bun": ("bun.lockb", "bun.lock"), "pnpm": ("pnpm-lock.yaml",), "yarn": ("yarn.lock",), "npm": ("package-lock.json", "package.json")},
}


def tooling(files: DataFrame, tools: dict[str, dict[str, tuple[str, ...]]] = TOOLS) -> DataFrame:
    """category, tool that a project uses."""
    rows = [(c, i, t, p) for c, of in tools.items() for i, (t, names) in enumerate(of.items()) for p in names]
    w = files.sparkSession.createDataFrame(rows, "category string, pos int, tool string, path string")
    return files.select("path").join(F.broadcast(w), "path").groupBy("category").agg(F.min_by("tool", "pos").alias("tool"))


def write_results(rows: DataFrame, path: str, form: str = "json") -> None:
    """Measured results as JSON lines or as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).format(form).save(path)


def project(files: DataFrame) -> DataFrame:
    """manifest, name, version from the first of four manifests (S14); the last three by pattern."""
    first = first_existing(files, {"manifest": ("package.json", "pyproject.toml", "go.mod", "Cargo.toml")}).withColumnRenamed("path", "manifest")
    rows = first.join(files.select(F.col("path").alias("manifest"), "text"), "manifest")
    toml = lambda k: F.regexp_extract("text", rf'(?m)^{k}\s*=\s*"([^"]+)"', 1)
    name = F.when(F.col("manifest") == "package.json", F.get_json_object("text", "$.name")).when(F.col("manifest") == "go.mod", F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1)).otherwise(toml("name"))
    version = F.when(F.col("manifest") == "package.json", F.get_json_object("text", "$.version")).when(F.col("manifest") == "go.mod", F.regexp_extract("text", r"(?m)^go\s+(\S+)", 1)).otherwise(toml("version"))
    return rows.select("manifest", name.alias("name"), version.alias("version"))

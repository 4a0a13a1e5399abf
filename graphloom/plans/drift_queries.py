"""Drift checks over documents, pages and the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import checkpoint
from ..operators import composite, drift, events, patterns
from ..sources import bridge, documents
from .registry import ORACLES, QUERIES, query

LINKS = """links AS (
  SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/+$', '') AS file, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as issues: errors, sign-ups as warnings, views as notes; the user is the file."""
    log = bridge.log(spark, sf_dir).filter("kind in ('error', 'signup', 'view')")
    severity = F.when(F.col("kind") == "error", "error").when(F.col("kind") == "signup", "warning").otherwise("info")
    return log.select(F.when(F.col("value") > 90, "GROUNDING_DRIFT").otherwise("STALE_FILE").alias("code"), severity.alias("severity"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.col("event_id").cast("int").alias("line"), F.col("props").alias("message"), F.to_date("at").alias("day"), F.col("event_id").alias("ord"))


ISSUES = """issues AS (
  SELECT CASE WHEN value > 90 THEN 'GROUNDING_DRIFT' ELSE 'STALE_FILE' END AS code, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity,
    'u' || user_id AS file, event_id AS ord, ts::DATE AS day FROM events WHERE event_type IN ('error', 'signup', 'view'))"""


@query(
    f"""WITH {LINKS}, files AS (SELECT DISTINCT file FROM links)
    SELECT page_id, target, count(*) AS n FROM links WHERE target LIKE '/%' AND substr(target, 2) NOT IN (SELECT file FROM files) GROUP BY page_id, target"""
)
def missing_targets_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute links to paths that no page has."""
    links = bridge.page_links(spark, sf_dir)
    rooted = links.filter(F.col("target").startswith("/")).withColumn("path", F.expr("substring(target, 2)"))
    gone = rooted.join(links.select(F.col("file").alias("path")).distinct(), "path", "left_anti")
    return gone.groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT DISTINCT o_custkey AS name FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT c_custkey AS name FROM customer WHERE c_acctbal > 0)
    SELECT 'INDEX_MISSING_ENTRY' AS code, 'c' || name AS message FROM f WHERE name NOT IN (SELECT name FROM e)
    UNION ALL SELECT 'INDEX_ORPHAN_ENTRY', 'c' || name FROM e WHERE name NOT IN (SELECT name FROM f)"""
)
def index_sync_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with finished orders against customers in credit, both ways."""
    e = bridge.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(bridge.key("c", "o_custkey").alias("name"))
    f = bridge.table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(bridge.key("c", "c_custkey").alias("name"))
    return drift.index_sync(e, f).select("code", "message")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that parts' names and sizes make: version claims "name size" by brand, and commands."""
    p = bridge.table(spark, sf_dir, "part")
    row = lambda kind, value: p.select(F.lit(kind).alias("kind"), value.alias("value"), F.col("p_brand").alias("source"), F.col("p_partkey").cast("int").alias("line"), (F.col("p_type") == "PROMO").alias("negated"))
    manager = F.element_at(F.array(F.lit("npm run"), F.lit("yarn"), F.lit("pnpm")), (F.col("p_size") % 3 + 1).cast("int"))
    return row("version", F.concat_ws(" ", "p_name", F.concat(F.lit("v"), F.col("p_size").cast("string")))).unionByName(row("command", F.concat_ws(" ", manager, F.regexp_replace("p_name", " ", "-"))))


@query(
    """SELECT p_name AS dep, count(DISTINCT p_size) AS k FROM part WHERE p_type <> 'PROMO' GROUP BY p_name HAVING count(*) > 1 AND count(DISTINCT p_size) > 1"""
)
def version_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are claimed in several versions."""
    found = drift.version_conflicts(_claims(spark, sf_dir))
    return found.select(F.regexp_extract("message", "^(.*?): ", 1).alias("dep"), F.size(F.split(F.regexp_extract("message", "^.*?: (.*)$", 1), ", ")).cast("long").alias("k"))


@query(
    """SELECT replace(p_name, ' ', '-') AS script FROM part WHERE p_type <> 'PROMO' GROUP BY p_name HAVING count(DISTINCT p_brand) > 1 AND count(DISTINCT p_size % 3) > 1"""
)
def manager_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts that several brands run with different managers."""
    return drift.manager_conflicts(_claims(spark, sf_dir)).select(F.col("message").alias("script"))


@query(
    """WITH n AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT event_type FROM events),
    t AS (SELECT p_name || ' ' || p_type AS text FROM part WHERE p_size > 40 UNION ALL SELECT text FROM documents)
    SELECT name FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE contains(t.text, n.name))"""
)
def substring_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that occur in no text."""
    p = bridge.table(spark, sf_dir, "part")
    names = p.select(F.col("p_type").alias("name")).union(p.select("p_brand")).union(bridge.table(spark, sf_dir, "events").select("event_type"))
    texts = p.filter("p_size > 40").select(F.concat_ws(" ", "p_name", "p_type").alias("text")).unionByName(bridge.table(spark, sf_dir, "documents").select("text"))
    return drift.uncovered(names, texts)


@query(
    """WITH f AS (SELECT *, first_value(p_type) OVER (PARTITION BY p_name ORDER BY p_partkey) AS x FROM part) SELECT p_partkey, p_name, p_type FROM f WHERE p_type <> x"""
)
def compare_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose type is not that of the first part of their name."""
    return drift.differs_from_first(bridge.table(spark, sf_dir, "part"), ["p_name"], "p_partkey", "p_type").select("p_partkey", "p_name", "p_type")


DOC_LINES = """rows AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"""


@query(
    f"""WITH {DOC_LINES}, h AS (SELECT *, CASE WHEN length(s) < 40 THEN s END AS heading FROM rows),
    c AS (SELECT doc_id, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h)
    SELECT doc_id, section, count(*) AS n FROM c GROUP BY doc_id, section"""
)
def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the short line before them, their heading."""
    rows = drift.lines(bridge.table(spark, sf_dir, "documents"))
    rows = drift.sections(rows, F.when(F.length("s") < 40, F.col("s")))
    return rows.groupBy("doc_id", "section").agg(F.count("*").alias("n"))


@query(
    f"""WITH r AS (SELECT doc_id, unnest(string_split(replace(text, '. ', chr(10) || '```' || chr(10)), chr(10))) AS s, generate_subscripts(string_split(replace(text, '. ', chr(10) || '```' || chr(10)), chr(10)), 1) AS line FROM documents),
    f AS (SELECT doc_id, s, sum(starts_with(ltrim(s), '```')::INT) OVER (PARTITION BY doc_id ORDER BY line) % 2 = 1 AS in_fence FROM r)
    SELECT doc_id, count(*) FILTER (in_fence) AS inside, count(*) FILTER (NOT in_fence) AS outside FROM f GROUP BY doc_id"""
)
def fence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within and outside of fences, where each sentence of a line puts one."""
    d = bridge.table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("\n```\n")).alias("text"))
    f = drift.fenced(drift.lines(d))
    return f.groupBy("doc_id").agg(F.count(F.when(F.col("in_fence"), 1)).alias("inside"), F.count(F.when(~F.col("in_fence"), 1)).alias("outside"))


@query(
    rf"""WITH {DOC_LINES}, m AS (SELECT doc_id, line, unnest(regexp_extract_all(s, '\b(The|In)\b', 1)) AS marker FROM rows) SELECT doc_id, line::INT AS line, marker, count(*) AS n FROM m GROUP BY ALL"""
)
def todo_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks on each line; the tables hold no TODO, so that two frequent words stand for them."""
    rows = drift.markers(drift.lines(bridge.table(spark, sf_dir, "documents")), "The|In")
    return rows.groupBy("doc_id", "line", "marker").agg(F.count("*").alias("n"))


@query(
    f"""WITH {LINKS}, files AS (SELECT DISTINCT file AS path FROM links), own AS (SELECT DISTINCT file, target, regexp_replace(target, '[#?].*$', '') AS bare FROM links WHERE NOT regexp_matches(target, '(?i)^(https?://|mailto:|node://|#)')),
    alt AS (SELECT file, target, ltrim(bare, '/') AS path FROM own UNION ALL SELECT file, target, 'scaffold/' || ltrim(bare, '/') FROM own
      UNION ALL SELECT file, target, CASE WHEN contains(file, '/') THEN regexp_extract(file, '^(.*)/[^/]*$', 1) || '/' ELSE '' END || ltrim(bare, '/') FROM own)
    SELECT file, target, 'error' AS severity FROM own WHERE bare <> '' AND (file, target) NOT IN (SELECT (file, target) FROM alt JOIN files USING (path))"""
)
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages that lead to no page, relative to the page or to the root."""
    links = bridge.page_links(spark, sf_dir)
    found = drift.broken_links(links, links.select(F.col("file").alias("path")))
    return found.select("file", F.col("message").alias("target"), "severity").distinct()


@query(
    """WITH u AS (SELECT user_id, date_diff('day', max(ts)::DATE, DATE '2024-04-15') AS days, count(*) AS commits, date_diff('day', max(ts) FILTER (event_type = 'purchase')::DATE, DATE '2024-04-15') AS upd FROM events GROUP BY user_id),
    s AS (SELECT *, CASE WHEN days >= 90 THEN 'error' WHEN days >= 30 THEN 'warning' END AS s1, CASE WHEN commits >= 200 THEN 'error' WHEN commits >= 50 THEN 'warning' END AS s2, CASE WHEN upd >= 90 THEN 'error' WHEN upd >= 30 THEN 'warning' END AS s3 FROM u)
    SELECT 'u' || user_id AS file, CASE WHEN 'error' IN (s1, s2, s3) THEN 'error' ELSE 'warning' END AS severity,
      concat_ws('; ', CASE WHEN s1 IS NOT NULL THEN days || ' days since last change' END, CASE WHEN s2 IS NOT NULL THEN commits || ' commits since last change' END, CASE WHEN s3 IS NOT NULL THEN upd || ' days since last update' END) AS message
    FROM s WHERE coalesce(s1, s2, s3) IS NOT NULL"""
)
def staleness_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as files: days since the last event, number of events, days since the last purchase."""
    day = F.lit("2024-04-15").cast("date")
    log = bridge.log(spark, sf_dir)
    files = log.groupBy("user_id").agg(
        F.datediff(day, F.to_date(F.max("at"))).alias("days"), F.count("*").alias("commits"), F.datediff(day, F.to_date(F.max(F.when(F.col("kind") == "purchase", F.col("at"))))).alias("updated_days")
    )
    return drift.staleness(files.withColumn("file", F.concat(F.lit("u"), F.col("user_id").cast("string")))).select("file", "severity", "message")


@query(f"WITH {ISSUES} SELECT file, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM issues GROUP BY file")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by severity for each file."""
    return drift.severity_counts(_issues(spark, sf_dir), ["file"])


SCORE = "greatest(0, least(100, 100 - coalesce(sum(CASE severity WHEN 'error' THEN 10 WHEN 'warning' THEN 3 ELSE 1 END), 0)))::BIGINT AS score"


@query(f"WITH {ISSUES} SELECT {SCORE} FROM issues")
def drift_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of all issues."""
    return drift.score(_issues(spark, sf_dir))


@query(f"WITH {ISSUES} SELECT day, {SCORE} FROM issues GROUP BY day UNION ALL SELECT NULL, {SCORE} FROM issues")
def drift_score_every_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each day's issues and, with a null day, that of all issues."""
    issues = _issues(spark, sf_dir)
    whole = drift.score(issues).select(F.lit(None).cast("date").alias("day"), "score")
    return drift.score(issues, ["day"]).select("day", "score").unionByName(whole)


@query(f"WITH {ISSUES} SELECT file, day, {SCORE} FROM issues GROUP BY file, day")
def drift_score_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each file on each day."""
    return drift.score(_issues(spark, sf_dir), ["file", "day"])


@query(
    f"""WITH {ISSUES}, d AS (SELECT code, severity, file || day AS file, ord FROM issues)
    SELECT ord, file FROM d WHERE code LIKE 'GROUNDING%' OR file IN (SELECT file FROM d WHERE severity = 'error')"""
)
def issues_in_error_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of files with an error, and all of groundings; a file is a user's day."""
    rows = _issues(spark, sf_dir).withColumn("file", F.concat("file", F.col("day").cast("string")))
    return drift.in_error_files(rows).select("ord", "file")


@query(
    f"WITH {ISSUES} SELECT file, min(ord) AS first, string_agg(severity, ',' ORDER BY ord) AS severities FROM issues GROUP BY file"
)
def issues_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of each file in order."""
    return drift.by_file(_issues(spark, sf_dir)).select("file", "first", F.array_join(F.transform("issues", lambda i: i["severity"]), ",").alias("severities"))


@query(
    """WITH t AS (SELECT user_id AS file, epoch(ts)::BIGINT // 600 AS x FROM events WHERE event_type <> 'signup'),
    r AS (SELECT event_id AS id, user_id AS file, epoch(ts)::BIGINT // 600 AS lo FROM events WHERE event_type = 'signup')
    SELECT id, count(*) AS n FROM t JOIN r ON t.file = r.file AND x BETWEEN lo AND lo + 300 GROUP BY id"""
)
def range_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in the fifty hours after each sign-up."""
    # seconds are rounded, as SQL's cast rounds them, before they are put into units of ten minutes
    log = bridge.log(spark, sf_dir).withColumn("at", F.floor(F.rint(F.unix_micros(F.col("at").cast("timestamp")) / 1_000_000) / 600))
    tokens = log.filter("kind != 'signup'").select(F.col("user_id").alias("file"), "at", F.col("at").alias("until"))
    ranges = log.filter("kind = 'signup'").select(F.col("event_id").alias("id"), F.col("user_id").alias("file"), F.col("at").alias("start"), (F.col("at") + 300).alias("end"))
    return composite.contained(tokens, ranges).groupBy("id").agg(F.count("*").alias("n"))


@query(
    f"""WITH {ISSUES}, s AS (SELECT {SCORE}, count(*) FILTER (severity = 'error') AS errors FROM issues),
    u AS (SELECT user_id, max(ts) FILTER (event_type = 'signup') AS t FROM events GROUP BY user_id),
    h AS (SELECT count(*) FILTER (floor(epoch(TIMESTAMP '2024-01-30 12:00:00' - t) / 86400) > 3) AS n FROM u)
    SELECT 'drift' AS what, score >= 80 AND errors = 0 AS ok, score AS n FROM s UNION ALL SELECT 'heartbeat', n = 0, n FROM h UNION ALL SELECT 'events', true, count(*) FROM events"""
)
def doctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of all issues, stale users, and the number of events."""
    _, report = composite.check([_issues(spark, sf_dir)])
    log = bridge.log(spark, sf_dir)
    last = log.groupBy(F.col("user_id").alias("key")).agg(F.max(F.when(F.col("kind") == "signup", F.col("at"))).alias("last_updated"))
    return composite.doctor(report, events.heartbeat(last, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), 3), log)


@query(
    r"""WITH w AS (SELECT regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
    names AS (SELECT DISTINCT w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS name FROM w, unnest(range(greatest(len(w) - 2, 0))) u(i)),
    met AS (SELECT name, count(*) AS n FROM names JOIN documents ON contains(lower(text), name) GROUP BY name)
    SELECT name, coalesce(n, 0) AS n_texts FROM names LEFT JOIN met USING (name)"""
)
def names_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All phrases of three words of the benchmark, and how many documents each occurs in."""
    w = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    items = bridge.table(spark, sf_dir, "benchmark").select(w.alias("w")).filter(F.size("w") > 2)
    phrase = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    names = checkpoint(items.select(F.explode(phrase).alias("name")).distinct())
    found = patterns.occurring(names, bridge.table(spark, sf_dir, "documents").select(F.lower("text").alias("text")))
    return names.join(found, "name", "left").select("name", F.coalesce("n_texts", F.lit(0).cast("long")).alias("n_texts"))


@query(
    """WITH e AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS t, url FROM pages),
    u AS (SELECT page_id, unnest(list_concat(t, ['quote " and \\ slash #' || page_id])) AS target FROM e)
    SELECT page_id::VARCHAR AS file, target, count(*) AS n FROM u WHERE target <> '' GROUP BY page_id, target"""
)
def front_matter_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of each page, written as the edges of a document's front matter and read from it again."""
    said = lambda c: F.concat(F.lit('  - target: "'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"\n    condition: it is linked # on the page\n'))
    p = bridge.table(spark, sf_dir, "pages")
    targets = F.concat(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), F.array(F.concat(F.lit('quote " and \\ slash #'), F.col("page_id").cast("string"))))
    text = F.concat(F.lit("---\ntitle: page\nedges:\n"), F.array_join(F.transform(targets, said), ""), F.lit("---\n"), F.col("html"))
    docs = p.select(F.col("page_id").cast("string").alias("source"), text.alias("text"))
    return documents.front_edges(docs).groupBy("file", "target").agg(F.count("*").alias("n"))


@query(f"WITH {ISSUES} SELECT severity, file, count(*) AS n, min(ord) AS first FROM issues GROUP BY severity, file")
def issues_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by severity and file."""
    return drift.by_severity(_issues(spark, sf_dir))


@query(
    f"""WITH {ISSUES}, i AS (SELECT 'issue' AS what, row_number() OVER (ORDER BY ord)::INT AS place, severity || ' ' || code || ' ' || file AS line FROM issues),
    e AS (SELECT 'event', row_number() OVER (ORDER BY ts DESC, event_id)::INT AS place, strftime(ts, '%Y-%m-%d %H:%M') || ' ' || event_type FROM events)
    SELECT * FROM i WHERE place <= 8 UNION ALL SELECT * FROM e WHERE place <= 8"""
)
def dashboard_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's first eight issues and latest eight events."""
    return composite.dashboard_lists(_issues(spark, sf_dir), bridge.log(spark, sf_dir))


QUERIES["doctor_all_issues"], ORACLES["doctor_all_issues"] = doctor, ORACLES["doctor"]


@query(
    """SELECT source, count(*) AS n, count(*) FILTER (n_chars > 2000) AS populated, round(count(*) FILTER (n_chars > 2000) * 100.0 / count(*))::BIGINT AS per_cent FROM documents GROUP BY source"""
)
def completeness_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of long documents by source, as status counts."""
    d = bridge.table(spark, sf_dir, "documents").withColumn("status", F.when(F.col("n_chars") > 2000, "populated").otherwise("empty"))
    return composite.completeness(d, ["source"])

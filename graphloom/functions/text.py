"""Column functions: identities, token estimates, search terms, path arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operators of the search syntax, which a query's terms may not be.
SEARCH_OPERATORS = ("AND", "OR", "NOT", "NEAR")


def node_id(kind: Column, path: Column, name: Column) -> Column:
    """kind:hash. Lines play no part, so that equal names in one file share an id (the later one wins)."""
    digest = F.sha2(F.concat_ws(":", path, kind, name), 256)
    return F.when(kind == "file", F.concat(F.lit("file:"), path)).otherwise(F.concat(kind, F.lit(":"), F.substring(digest, 1, 32)))


def body_hash(body: Column) -> Column:
    """SHA-256 of a body with white space squeezed and trimmed: reformatting does not change it."""
    return F.sha2(F.trim(F.regexp_replace(body, r"\s+", " ")), 256)


def token_estimate(record: Column) -> Column:
    """A record's cost in tokens: a quarter of its characters, rounded up."""
    return F.ceil(F.length(record) / 4).cast("long")


def search_terms(query: str) -> list[str]:
    """Prefix terms of a query: punctuation of the search syntax splits, operators are dropped."""
    for mark in "[.\"'*():^-]":
        query = query.replace(mark, " ")
    return [t.lower() for t in query.split() if t not in SEARCH_OPERATORS]


def task_tokens(task: str) -> list[str]:
    """Distinct identifiers of two characters or more in a task's words, in order."""
    kept = "".join(c if c.isascii() and (c.isalnum() or c in "_$") else " " for c in task)
    return list(dict.fromkeys(t for t in kept.split() if len(t) >= 2))


def tokens(text: Column) -> Column:
    """Search tokens: lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def is_test_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(__tests__|tests?)/|\.(test|spec)\.")


def posix_dirname(path: Column) -> Column:
    """All before the last slash; empty without one."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), r"/+$", "")


def posix_join(base: Column, rest: Column) -> Column:
    """base/rest with "." and empty segments dropped and ".." taking one away."""
    parts = F.split(F.concat(base, F.lit("/"), rest), "/")

    def step(acc: Column, p: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(p == "..", up).when((p == "") | (p == "."), acc).otherwise(F.concat(acc, F.array(p)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of term in text; none for an empty term."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, gone / F.length(term)).otherwise(0).cast("long")


def utc_days(later: Column, earlier: Column) -> Column:
    """Whole days between two UTC times; null if negative."""
    d = F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000))
    return F.when(d >= 0, d)


def regex_quote(text: Column) -> Column:
    """text as a regular expression that finds just it."""
    return F.regexp_replace(text, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def glob_regex(pattern: Column) -> Column:
    """The regular expression of a glob: * and ? stay within a folder, ** spans folders; a leading * finds no hidden file."""
    p = F.regexp_replace(pattern, r"([\\^$.|+()\[\]{}])", r"\\$1")
    p = F.replace(F.replace(p, F.lit("**/"), F.lit("\x01")), F.lit("**"), F.lit("\x02"))
    p = F.replace(p, F.lit("?"), F.lit("[^/]"))
    p = F.regexp_replace(p, "(^|/|\x01)\\*", r"$1(?!\\.)*")
    p = F.replace(p, F.lit("*"), F.lit("[^/]*"))
    p = F.replace(F.replace(p, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit(".*"))
    return F.concat(F.lit("^"), p, F.lit("$"))


def escapes_root(path: Column) -> Column:
    """Whether a path leads out of the folder that it starts from, at any of its segments' end; absolute ones do."""
    depth = F.struct(F.lit(0).alias("at"), F.lit(0).alias("low"))

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.when(p == "..", -1).when((p == "") | (p == "."), 0).otherwise(1)
        return F.struct(at.alias("at"), F.least(acc["low"], at).alias("low"))

    return path.startswith("/") | (F.aggregate(F.split(path, "/"), depth, step)["low"] < 0)

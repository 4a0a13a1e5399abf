"""The event log: permissive reading, timelines, activity, staleness of heartbeats."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of event.
KINDS = ("decision", "note", "risk", "todo")
LEVELS = "▁▂▃▄▅▆▇█"


def parse_log(lines: DataFrame, kinds: tuple[str, ...] | None = KINDS, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Event rows of JSON lines; lines that aren't events are skipped.

    An event is an object with strings timestamp, kind (one of kinds) and
    message. Of files only the strings stay; a missing cwd is ".".
    """
    v = F.try_parse_json(F.col(column))
    text = lambda p: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{p}", "variant")) == "STRING", F.try_variant_get(v, f"$.{p}", "string"))
    items = F.coalesce(F.try_variant_get(v, "$.files", "array<variant>"), F.array().cast("array<variant>"))
    strings = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    rows = lines.select(
        text("timestamp").alias("timestamp"), text("kind").alias("kind"), text("message").alias("message"),
        F.transform(strings, lambda x: F.try_variant_get(x, "$", "string")).alias("files"),
        F.coalesce(text("cwd"), F.lit(".")).alias("cwd"),
        text("trace").alias("trace"), text("source").alias("source"), text("status").alias("status"), *keep,
    )
    ok = F.col("timestamp").isNotNull() & F.col("kind").isNotNull() & F.col("message").isNotNull()
    return rows.filter(ok if kinds is None else ok & F.col("kind").isin(*kinds))


def log_lines(events: DataFrame) -> DataFrame:
    """The sink's lines: JSON in a fixed order of fields, without null ones."""
    return events.select(F.to_json(F.struct("timestamp", "kind", "message", "files", "cwd", "trace", "source", "status")).alias("value"))


def append(events: DataFrame, folder: str, batch: int) -> None:
    """Add events to the log in folder (M09, C08): a batch's lines in a folder of its own.

    A batch that is written again, since a task or the driver failed, takes its own place, so that no event is there twice; a stream
    writes with foreachBatch(lambda rows, batch: append(rows, folder, batch)).
    """
    log_lines(events).write.mode("overwrite").text(f"{folder}/batch={batch}")


def read_log(spark: SparkSession, folder: str, kinds: tuple[str, ...] | None = KINDS) -> DataFrame:
    """Events of a log, with batch."""
    lines = spark.read.schema("value string, batch long").option("basePath", folder).text(folder)
    return parse_log(lines, kinds, keep=("batch",))


def since(spec: str, now: str) -> Column:
    """The time from which on events count: YYYY-MM-DD (UTC midnight), or Nd, N days before now to the second."""
    if m := re.fullmatch(r"(\d+)d", spec):
        return F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(int(m[1])))
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", spec):
        return F.try_to_timestamp(F.lit(spec), F.lit("yyyy-MM-dd"))
    raise ValueError(f"neither a date nor a number of days: {spec}")


def timeline(events: DataFrame, at: str = "at", kind: str | None = None, since_: Column | None = None, limit: int | None = None) -> DataFrame:
    """Events, latest first."""
    out = events
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    if since_ is not None:
        out = out.filter(F.col(at) >= since_)
    out = out.orderBy(F.col(at).desc(), "event_id")
    return out if limit is None else out.limit(limit)


def last_n(events: DataFrame, n: int, order: str) -> DataFrame:
    """The last n in file order, in that order."""
    return events.orderBy(F.col(order).desc()).limit(n).orderBy(order)


def activity(events: DataFrame, now: Column, at: str = "at", days: int = 7) -> DataFrame:
    """day, n, bar of the last days, empty ones too."""
    last = F.to_date(now)
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    counts = events.select(F.to_date(at).alias("day")).groupBy("day").agg(F.count("*").alias("n"))
    rows = F.broadcast(spine).join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))
    peak = rows.agg(F.greatest(F.max("n"), F.lit(1)).alias("peak"))
    j = rows.join(F.broadcast(peak))
    return j.select("day", "n", F.substring(F.lit(LEVELS), F.ceil(F.col("n") / F.col("peak") * 7).cast("int") + 1, F.lit(1)).alias("bar"))


def progress_bar(value: Column, width: int = 18) -> Column:
    """A14."""
    full = F.round(value / 100 * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def heartbeat(files: DataFrame, now: Column, stale_days: int = 7) -> DataFrame:
    """key, age_days, stale: strictly older than stale_days (F11, C09); files: key, last_updated."""
    from ..functions.text import utc_days

    age = utc_days(now, F.col("last_updated"))
    return files.select("key", age.alias("age_days"), F.coalesce(age > stale_days, F.lit(False)).alias("stale"))

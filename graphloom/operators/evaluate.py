"""Retrieval metrics and their gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expected_recall(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """task, recall: share of expected symbols that were returned (A18); both: task, name."""
    r = returned.select("task", "name").distinct().withColumn("hit", F.lit(1))
    return expected.select("task", "name").distinct().join(r, ["task", "name"], "left").groupBy("task").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def ratios(rows: DataFrame, by: list[str], num: Column, den: Column) -> DataFrame:
    """by..., median, mean, least of a ratio."""
    r = rows.withColumn("_r", num / den)
    return r.groupBy(*by).agg(F.round(F.median("_r"), 6).alias("median"), F.round(F.avg("_r"), 6).alias("mean"), F.round(F.min("_r"), 6).alias("least"))


def gates(metrics: DataFrame, floors: dict[str, float]) -> DataFrame:
    """metric, value, floor, ok (A24); metrics: metric, value. A metric without a floor is always ok."""
    floor = F.coalesce(*[F.when(F.col("metric") == k, F.lit(v)) for k, v in floors.items()])
    return metrics.select("metric", "value", floor.alias("floor"), F.coalesce(F.col("value") >= floor, F.lit(True)).alias("ok"))


def transcript_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """run, turns, tools, cost of agent transcripts in JSON lines with run."""
    v = F.try_parse_json(F.col(column))
    kind = F.try_variant_get(v, "$.type", "string")
    content = F.coalesce(F.try_variant_get(v, "$.message.content", "array<variant>"), F.array().cast("array<variant>"))
    used = F.size(F.filter(content, lambda x: F.try_variant_get(x, "$.type", "string") == "tool_use"))
    return lines.groupBy("run").agg(
        F.max(F.when(kind == "result", F.try_variant_get(v, "$.num_turns", "long"))).alias("turns"),
        F.sum(F.when(kind == "assistant", used).otherwise(0)).alias("tools"),
        F.max(F.when(kind == "result", F.try_variant_get(v, "$.total_cost_usd", "double"))).alias("cost"),
    )


def found_rank(returned: DataFrame, wanted: Column, *order: Column | str) -> DataFrame:
    """task, rank, found: the place of a task's first result that is wanted (A20); null if there is none."""
    from pyspark.sql import Window

    rows = returned.withColumn("_n", F.row_number().over(Window.partitionBy("task").orderBy(*order)))
    hit = F.min(F.when(wanted, F.col("_n"))).cast("long")
    return rows.groupBy("task").agg(hit.alias("rank"), hit.isNotNull().alias("found"))


def variant_means(runs: DataFrame, values: list[str], best: str) -> DataFrame:
    """variant, n, means of values, place from 1 by the mean of best, the least first (A21); runs of one variant each."""
    from pyspark.sql import Window

    means = [F.round(F.avg(v), 6).alias(v) for v in values]
    g = runs.groupBy("variant").agg(F.count("*").alias("n"), *means)
    # variants are few: one row each
    return g.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(best).asc_nulls_last(), "variant")))

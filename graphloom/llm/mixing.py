"""Mixing sources to target weights by hierarchical token budgets.

The leaves of a tree (domain, language, source) hold documents. A token budget
goes down the tree: each node shares what it has among its children in
proportion to their weights, but gives none more than its capacity, which is
what its leaves hold times the number of epochs allowed. What a child can't take
goes to its siblings; since a node's own share is limited by its subtree's
capacity beforehand, a shortage reaches the level above only after the siblings
are full. Integers throughout: shares are exact and add up to the budget.

A leaf takes whole epochs first, then the prefix of one more epoch: documents in
an order seeded by seed, epoch and doc_id, until the rest of its tokens is
reached. The last document may be taken in part (taken < n_tokens).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, n_tokens

#: Leaves up to this number are broadcast; beyond it the join is shuffled.
BROADCAST_LEAVES = 50_000
#: Rows of a leaf's slice that are summed in order by one task.
SLICE_ROWS = 50_000


def weight_of(name: Column, weights: Mapping[str, int], default: int = 1) -> Column:
    """The weight of a node by its name; weights are positive integers."""
    out = F.lit(default)
    for k, w in weights.items():
        out = F.when(name == k, F.lit(w)).otherwise(out)
    return out.cast("long")


def fill(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Share column `given` of each parent among its children; adds column `share`.

    nodes: parents..., name, cap, weight, given (the same for all of a parent).
    The children whose capacity per weight is smallest fill up first, so that the
    full ones are a prefix in that order, and running sums find where it ends.
    Ties are ordered by name.
    """
    ways = list(parents) or [F.lit(0)]
    order = [F.col("cap") / F.col("weight"), F.col(name)]
    before = Window.partitionBy(*ways).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*ways).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*ways)
    wide = lambda c: c.cast("decimal(19,0)")
    rest = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    out = nodes.withColumn("room", F.col("given") - rest("cap")).withColumn(
        "heft", F.sum("weight").over(whole) - rest("weight")
    )
    here = wide(F.col("cap")) * wide(F.col("heft")) <= wide(F.col("weight")) * wide(F.col("room"))
    out = out.withColumn("full", F.min(here.cast("int")).over(upto) == 1)
    left = F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))
    open_weight = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight"))).over(whole)
    out = out.withColumn("left", left).withColumn("open_weight", open_weight)
    out = out.withColumn(
        "least",
        F.expr("case when full then cap else cast(weight as decimal(19,0)) * cast(left as decimal(19,0)) div open_weight end"),
    )
    # the tokens that rounding left over, one each to the first of those not full
    over = F.col("given") - F.sum("least").over(whole)
    nth = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.lit(1))).over(upto)
    out = out.withColumn("share", F.col("least") + F.when(~F.col("full") & (nth <= over), 1).otherwise(0))
    return out.drop("room", "heft", "full", "left", "open_weight", "least")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]], per_mille: int, max_epochs: int) -> DataFrame:
    """levels..., leaf_tokens, quota for each leaf; leaves: levels..., leaf_tokens."""
    tree = leaves.withColumn("leaf_cap", F.col("leaf_tokens") * max_epochs)
    top = tree.groupBy(levels[0]).agg(F.sum("leaf_tokens").alias("leaf_tokens"), F.sum("leaf_cap").alias("cap"))
    budget = F.expr(f"cast(sum(leaf_tokens) over (partition by 0) as decimal(19,0)) * {int(per_mille)} div 1000")
    cap_all = F.sum("cap").over(Window.partitionBy(F.lit(0)))
    node = top.withColumn("given", F.least(budget, cap_all)).drop("leaf_tokens")
    for depth, level in enumerate(levels):
        above = list(levels[:depth])
        if depth:
            inner = tree.groupBy(*levels[: depth + 1]).agg(F.sum("leaf_cap").alias("cap"))
            node = inner.join(node.select(*above, F.col("share").alias("given")), above)
        node = fill(node.withColumn("weight", weight_of(F.col(level), weights[depth])), above, level)
    return leaves.join(node.select(*levels, F.col("share").alias("quota")), list(levels))


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Sequence[Mapping[str, int]],
    per_mille: int = 600,
    max_epochs: int = 2,
    seed: int = 42,
) -> DataFrame:
    """Rows (levels..., doc_id, epoch, n_tokens, taken, quota) of what is selected.

    levels: names and expressions over docs, root first. per_mille: the budget
    in thousandths of all tokens; it may be above 1000 when epochs repeat. A
    null on a level is a node named "". Documents without tokens (null, empty or
    blank text) are never selected. Repeated rows count as documents of their
    own; between rows that tie in the seeded order either may come first. An empty
    table gives no rows. Columns of docs other than doc_id, text and those in
    levels are ignored. A leaf's running sum is made in slices of the seeded
    order, 4,096 or as many more as keep them below about SLICE_ROWS rows, so that a
    leaf with a third of all rows is not one task. Very long texts count whole.
    """
    names = list(levels)
    rows = docs.select(
        *[F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in levels.items()],
        "doc_id",
        n_tokens(F.col("text")).alias("n_tokens"),
    ).filter("n_tokens > 0")
    # read the texts once: what follows needs only a few short columns
    rows = checkpoint(rows)
    quotas = checkpoint(budgets(rows.groupBy(*names).agg(F.sum("n_tokens").alias("leaf_tokens")), names, weights, per_mille, max_epochs))
    small = quotas.count() <= BROADCAST_LEAVES
    near = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    d = rows.join(near(quotas), names)
    d = d.withColumn("rounds", F.expr("quota div leaf_tokens")).withColumn("rest", F.expr("quota % leaf_tokens"))
    out = [*names, "doc_id", "epoch", "n_tokens", "taken", "quota"]
    whole = d.filter("rounds > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, rounds - 1)")))
    whole = whole.withColumn("taken", F.col("n_tokens")).select(*out)

    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rounds").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    digits, n = 3, rows.count()
    while 16**digits * SLICE_ROWS < n:
        digits += 1
    part = d.filter("rest > 0").withColumn("u", order).withColumn("slice", F.substring("u", 1, digits))
    sums = part.groupBy(*names, "slice").agg(F.sum("n_tokens").alias("slice_tokens"))
    ahead = F.coalesce(F.sum("slice_tokens").over(Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("ahead", ahead).drop("slice_tokens")
    within = Window.partitionBy(*names, "slice").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    part = part.join(sums, [*names, "slice"]).filter("ahead < rest")
    part = part.withColumn("start", F.col("ahead") + F.sum("n_tokens").over(within) - F.col("n_tokens")).filter("start < rest")
    part = part.withColumn("taken", F.least("n_tokens", F.col("rest") - F.col("start"))).withColumn("epoch", F.col("rounds")).select(*out)
    return whole.unionByName(part)

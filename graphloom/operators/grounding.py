"""Documents grounded in code: fingerprints of bodies, baselines, verdicts on lost nodes, and rebinding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.store import checkpoint
from ..functions.text import regex_quote
from . import composite, drift, identity


def code_prints(nodes: DataFrame, edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """id, minhash, neighbors, token_count of each node that has a body.

    leaves: path, pos, line, end_line, type (sources.extract.leaves). A body's tokens
    are the types of the leaves within its lines, so that new names leave its
    print as it is. Neighbours are what calls a node and what it calls; their
    array is part of the print, whatever its length. The prints are written out, since
    they are used several times.
    """
    bodies = nodes.filter("body_hash is not null").select("id", F.col("file_path").alias("file"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    tokens = leaves.select(F.col("path").alias("file"), F.col("line").alias("at"), F.col("end_line").alias("until"), "pos", "type")
    words = composite.contained(tokens, bodies).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "type"))).alias("w"))
    none = F.array().cast("array<string>")
    words = bodies.select("id").join(words, "id", "left").select("id", F.coalesce(F.transform("w", lambda x: x["type"]), none).alias("w"))
    calls = edges.filter("kind = 'calls'").select("source", "target")
    ends = calls.toDF("id", "other").unionByName(calls.select(F.col("target").alias("id"), F.col("source").alias("other")))
    near = ends.groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("neighbors"))
    prints = checkpoint(identity.minhash(checkpoint(words), F.col("w")))
    return prints.join(near, "id", "left").select("id", "minhash", F.coalesce("neighbors", none).alias("neighbors"), "token_count").transform(checkpoint)


def upsert_prints(prints: DataFrame, fresh: DataFrame) -> DataFrame:
    """prints with the fresh ones in place of those of the same ids (M05); identity.bands gives the buckets anew."""
    return prints.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def serialized(prints: DataFrame) -> DataFrame:
    """id, fingerprint as text."""
    return prints.select("id", identity.serialize(F.struct("minhash", "neighbors", F.col("token_count").alias("tokenCount"))).alias("fingerprint"))


def wanted(groundings: DataFrame, anchors: DataFrame) -> DataFrame:
    """file, node_id, fingerprint, grounded: nodes that documents rest on, each once a document.

    An anchor alone has no fingerprint; of several groundings of one node the greatest fingerprint counts.
    """
    a = anchors.select("file", "node_id", F.lit(None).cast("string").alias("fingerprint"), F.lit(False).alias("grounded"))
    both = groundings.select("file", "node_id", "fingerprint", F.lit(True).alias("grounded")).unionByName(a)
    return both.groupBy("file", "node_id").agg(F.max("fingerprint").alias("fingerprint"), F.max("grounded").alias("grounded"))


def capture(asked: DataFrame, nodes: DataFrame, prints: DataFrame, update: bool = False) -> DataFrame:
    """file, node_id, state, body_hash, fingerprint: what a baseline is to hold from now on.

    asked: as of wanted; nodes: id, body_hash; prints: id, fingerprint as text. Only
    rows whose state is captured are baselines. Others are unavailable (no such
    node, or no print), changed (the grounding has another fingerprint, and update
    isn't set) or bodiless.
    """
    j = asked.join(nodes.select(F.col("id").alias("node_id"), "body_hash", F.lit(True).alias("there")), "node_id", "left")
    j = j.join(prints.select(F.col("id").alias("node_id"), F.col("fingerprint").alias("now")), "node_id", "left")
    off = F.col("grounded") & ~F.col("fingerprint").eqNullSafe(F.col("now"))
    state = (
        F.when(F.col("there").isNull() | F.col("now").isNull(), "unavailable")
        .when(off & F.lit(not update), "changed")
        .when(F.col("body_hash").isNull(), "bodiless")
        .otherwise("captured")
    )
    return j.select("file", "node_id", state.alias("state"), "body_hash", F.col("now").alias("fingerprint"))


def save_baselines(baselines: DataFrame, fresh: DataFrame) -> DataFrame:
    """baselines with the fresh ones in place of those of the same file and node."""
    return baselines.join(fresh.select("file", "node_id"), ["file", "node_id"], "left_anti").unionByName(fresh.select(*baselines.columns))


def lost(asked: DataFrame, nodes: DataFrame, baselines: DataFrame) -> DataFrame:
    """id, minhash, neighbors, token_count of nodes that documents rest on and that are gone, if a fingerprint is known.

    The document's own fingerprint counts before the baseline's; of several documents the first by name.
    """
    gone = asked.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti")
    j = gone.join(baselines.select("file", "node_id", F.col("fingerprint").alias("stored")), ["file", "node_id"], "left")
    known = j.select("file", F.col("node_id").alias("id"), F.coalesce(identity.deserialize(F.col("fingerprint")), identity.deserialize(F.col("stored"))).alias("p")).filter("p is not null")
    first = known.groupBy("id").agg(F.min_by("p", "file").alias("p"))
    return checkpoint(first.select("id", "p.minhash", "p.neighbors", F.col("p.tokenCount").alias("token_count")))


def verdicts(missing: DataFrame, prints: DataFrame) -> DataFrame:
    """id, verdict, node_id, score of lost nodes among the prints of today (W05): candidates share a band."""
    m = identity.bands(missing).withColumnRenamed("id", "a")
    c = identity.bands(prints).withColumnRenamed("id", "b")
    return checkpoint(identity.reconcile(missing, prints, m.join(c, ["band", "band_hash"]).select("a", "b").distinct()))


def anchor_issues(anchors: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Issues of inline anchors to nodes that are gone (J11); found: as of verdicts. All are warnings."""
    gone = anchors.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti")
    j = gone.join(found.select(F.col("id").alias("node_id"), "verdict", F.col("node_id").alias("candidate")), "node_id", "left")
    code = F.when(F.col("verdict") == "MOVED", "GROUNDING_DRIFT").when(F.col("verdict") == "AMBIGUOUS", "GROUNDING_AMBIGUOUS").otherwise("GROUNDING_GONE")
    told = F.concat_ws(" -> ", "node_id", F.when(code != "GROUNDING_GONE", F.col("candidate")))
    rows = j.select(code.alias("code"), "file", told.alias("message"))
    return rows.select("code", F.lit("warning").alias("severity"), "file", F.lit(None).cast("int").alias("line"), "message")


def grounding_issues(asked: DataFrame, nodes: DataFrame, baselines: DataFrame, found: DataFrame) -> DataFrame:
    """Issues of groundings (J10): bodies that changed, and nodes that are gone, as drift.grounding_issues tells them.

    A node that moved is rebound and no issue, and so is one without any fingerprint.
    """
    states = identity.body_drift(asked.filter("grounded"), nodes, baselines)
    known = found.select(F.col("id").alias("node_id"), "verdict").filter("verdict != 'MOVED'")
    told = states.filter("state != 'missing'").unionByName(states.join(known.select("node_id"), "node_id", "left_semi").filter("state = 'missing'").select(*states.columns))
    return drift.grounding_issues(told, found)


def moves(asked: DataFrame, nodes: DataFrame, found: DataFrame, prints: DataFrame) -> DataFrame:
    """file, old, new, fingerprint of what documents rest on and that has surely moved (M12); other verdicts stay for a reader."""
    gone = asked.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("file", F.col("node_id").alias("old"))
    sure = found.filter("verdict = 'MOVED'").select(F.col("id").alias("old"), F.col("node_id").alias("new"))
    j = gone.join(sure, "old").join(prints.select(F.col("id").alias("new"), "fingerprint"), "new", "left")
    return j.select("file", "old", "new", "fingerprint").distinct()


def rebind(baselines: DataFrame, moved: DataFrame, nodes: DataFrame) -> DataFrame:
    """baselines (file, node_id, body_hash, fingerprint) after the moves (M12): the old node's goes, the new node's comes once."""
    kept = baselines.join(moved.select("file", F.col("old").alias("node_id")), ["file", "node_id"], "left_anti")
    fresh = moved.join(nodes.select(F.col("id").alias("new"), "body_hash"), "new").select("file", F.col("new").alias("node_id"), "body_hash", "fingerprint").distinct()
    return save_baselines(kept, fresh)


def rewrite(docs: DataFrame, moved: DataFrame, scheme: str = "node") -> DataFrame:
    """source, text with groundings and anchors of moved nodes led to the new ones (M11, M12); nothing else changes.

    A grounding is a line "node: OLD" with a line "fingerprint: ..." after it. An old
    node is gone and a new one is there, so that no move leads on to another.
    """
    of = moved.groupBy(F.col("file").alias("source")).agg(F.array_sort(F.collect_set(F.struct("old", "new", "fingerprint"))).alias("moved"))
    plain = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")

    def step(text: Column, m: Column) -> Column:
        whole = F.concat(F.lit(r"(?m)^([ \t]*(?:-[ \t]*)?node:[ \t]*[\"']?)"), regex_quote(m["old"]), F.lit(r"([\"']?[ \t]*\r?\n[ \t]+fingerprint:[ \t]*[\"']?)([^\"'\s]+)"))
        led = F.regexp_replace(text, whole, F.concat(F.lit("$1"), plain(m["new"]), F.lit("$2"), F.coalesce(plain(m["fingerprint"]), F.lit("$3"))))
        for form in (lambda c: c, F.url_encode):
            led = F.replace(led, F.concat(F.lit(f"]({scheme}://"), form(m["old"]), F.lit(")")), F.concat(F.lit(f"]({scheme}://"), form(m["new"]), F.lit(")")))
        return led

    j = docs.select("source", "text").join(of, "source", "left")
    return j.select("source", F.when(F.col("moved").isNull(), F.col("text")).otherwise(F.aggregate("moved", F.col("text"), step)).alias("text"))

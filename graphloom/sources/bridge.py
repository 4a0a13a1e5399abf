"""The driver's tables seen as a code graph, documents, links and a log.

Regions are files, nations namespaces, customers methods, suppliers classes, orders
and parts functions; customers call their orders, orders and suppliers the parts of
their lines. Events are the log, pages and documents the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, name, qualified_name, file_path, docstring, signature, is_exported, ord."""
    t = lambda n: table(spark, sf_dir, n)

    def plain(df: DataFrame, kind: str, id_, name, path, order) -> DataFrame:
        return df.select(
            id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), F.concat(path, F.lit("::"), name).alias("qualified_name"),
            path.alias("file_path"), F.lit(None).cast("string").alias("docstring"), F.concat(name, F.lit("()")).alias("signature"), F.lit(True).alias("is_exported"), order.cast("long").alias("ord"),
        )

    supplier = plain(t("supplier"), "class", key("class:s", "s_suppkey"), F.col("s_name"), key("nation/", "s_nationkey"), F.col("s_suppkey"))
    customer = plain(t("customer"), "method", key("method:c", "c_custkey"), F.col("c_name"), key("tests/", "c_nationkey"), F.col("c_custkey"))
    nation = plain(t("nation"), "namespace", key("namespace:n", "n_nationkey"), F.col("n_name"), key("region/", "n_regionkey"), F.col("n_nationkey"))
    orders = plain(t("orders"), "function", key("function:o", "o_orderkey"), key("order_", "o_orderkey"), key("customer/", "o_custkey"), F.col("o_orderkey"))
    return parts(spark, sf_dir).unionByName(supplier).unionByName(customer).unionByName(nation).unionByName(orders)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, kind: calls between customers, orders, suppliers and parts, and what contains what.

    Edges repeat, as lines do; the operators take each once where it matters.
    """
    t = lambda n: table(spark, sf_dir, n)
    e = lambda df, s, d, k: df.select(s.alias("source"), d.alias("target"), F.lit(k).alias("kind"))
    line = t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    return (
        e(t("orders"), key("method:c", "o_custkey"), key("function:o", "o_orderkey"), "calls")
        .unionByName(e(line, key("function:o", "l_orderkey"), key("function:p", "l_partkey"), "calls"))
        .unionByName(e(line, key("class:s", "l_suppkey"), key("function:p", "l_partkey"), "calls"))
        .unionByName(e(t("customer"), key("namespace:n", "c_nationkey"), key("method:c", "c_custkey"), "contains"))
        .unionByName(e(t("supplier"), key("namespace:n", "s_nationkey"), key("class:s", "s_suppkey"), "contains"))
    )


def calls(spark: SparkSession, sf_dir: str) -> dict[tuple[str, str], DataFrame]:
    """id, caller of the calls among edges, as numbers, for each beginning of the called id and of the caller's."""
    pairs = lambda name, called, caller: table(spark, sf_dir, name).select(F.col(called).alias("id"), F.col(caller).alias("caller"))
    return {
        ("function:o", "method:c"): pairs("orders", "o_orderkey", "o_custkey"),
        ("function:p", "function:o"): pairs("lineitem", "l_partkey", "l_orderkey"),
        ("function:p", "class:s"): pairs("lineitem", "l_partkey", "l_suppkey"),
    }


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that are parts, from their own table alone."""
    return table(spark, sf_dir, "part").select(
        key("function:p", "p_partkey").alias("id"), F.lit("function").alias("kind"), F.col("p_name").alias("name"),
        F.concat_ws("::", "p_brand", "p_name").alias("qualified_name"), F.concat(F.lit("brand/"), "p_brand").alias("file_path"),
        F.col("p_type").alias("docstring"), F.concat(F.col("p_name"), F.lit("("), F.col("p_size").cast("string"), F.lit(")")).alias("signature"),
        (F.col("p_size") > 25).alias("is_exported"), F.col("p_partkey").alias("ord"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, at (UTC), kind, user_id, value, props."""
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("at"), F.col("event_type").alias("kind"), "user_id", "value", "props")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, file (path part of the page's URL), line (its number), target (each href)."""
    p = table(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1), "/+$", "")
    return p.select("page_id", path.alias("file"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("line", "target"))

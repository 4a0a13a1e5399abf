"""Helpers that the training-data operators share."""

from __future__ import annotations

import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of the two word definitions, as character classes.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
NON_WORD_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ship(name: str) -> None:
    """Send a module's functions to executors by value, so that they need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out anew when a small input has fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def fresh(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no column of that name, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def told(column: str = "doc_id") -> Column:
    """An id as text, for its way through pandas, which makes inexact doubles of whole numbers that stand beside a null."""
    return F.col(column).cast("string").alias(column)


def untold(df: DataFrame, column: str = "doc_id") -> DataFrame:
    """df with an id that told() made a text of as a number again."""
    return df.withColumn(column, F.col(column).cast("long"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, one is chosen if Spark is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does the same, and faster, where a text is all ASCII."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters, digits and non-ASCII characters; null text has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD_CLASS)
    # only the first and the last part can be empty
    return F.filter(parts, lambda w: w != "")


def text_key(text: Column) -> Column:
    """A 128-bit hash of a text; with doc_id it tells rows apart unless these hold the same text. Null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def n_tokens(text: Column) -> Column:
    """Number of white-space separated words; null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")

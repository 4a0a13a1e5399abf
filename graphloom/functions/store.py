"""Results that are written: lineage cut where one is used several times, and tables in versions."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir, which all executors share; where that is unset, one is chosen if Spark is local."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one is chosen if Spark is local."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Versions:
    """Tables that change as a whole: what is written is never overwritten, and one row in a manifest makes it the current version.

    A reader asks once for the current version and then reads folders that don't change any more, so that it never sees a mix
    of versions. There is one writer at a time. Folders of old versions stay until someone removes them.
    """

    ROW = "version long, folders map<string,array<string>>, numbers map<string,long>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def current(self) -> Row | None:
        """version, folders (for each table those that hold it), numbers; None before the first version."""
        try:
            rows = self.spark.read.schema(self.ROW).parquet(f"{self.path}/manifest")
            return rows.orderBy(F.desc("version")).first()
        except AnalysisException:
            return None

    def write(self, tables: dict[str, DataFrame], by: dict[str, str] | None = None, keep: bool = False, numbers: dict[str, int] | None = None) -> int:
        """Write tables, those in by partitioned, and make them current; keep: beside the folders of the version before."""
        now = self.current()
        version = now["version"] + 1 if now else 0
        folders = dict(now["folders"]) if now and keep else {}
        for name, df in tables.items():
            folder = f"{self.path}/{name}/v{version}-{uuid.uuid4().hex[:8]}"
            w = df.write.partitionBy(by[name]) if by and name in by else df.write
            w.parquet(folder)
            folders[name] = [*folders.get(name, []), folder] if keep else [folder]
        # one row in one file, which appears when it is whole
        self.spark.createDataFrame([(version, folders, numbers or {})], self.ROW).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return version

    def layers(self, now: Row, name: str, dead: str, key: str, schema: str, keep: Column | None = None) -> DataFrame:
        """The rows of a table that no later layer of the table dead, which has the column key, has made void; keep is applied where rows are read."""
        folders, void = now["folders"][name], now["folders"][dead]
        at = dict(zip((s.strip().split()[0] for s in schema.split(",")), (s.strip() for s in schema.split(",")), strict=True))
        parts = []
        for place, folder in enumerate(folders):
            df = self.spark.read.schema(schema).parquet(folder)
            df = df if keep is None else df.filter(keep)
            later = [self.spark.read.schema(at[key]).parquet(f) for f in void[place + 1 :]]
            parts.append(df.join(reduce(DataFrame.unionByName, later).distinct(), key, "left_anti") if later else df)
        return reduce(DataFrame.unionByName, parts)

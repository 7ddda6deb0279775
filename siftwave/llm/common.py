"""What the operators of this subpackage share: scratch tables and word rules."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are none of these.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where spark.checkpoint.dir is unset, a local one is set once for the context if all runs in one process, as in tests; elsewhere that is an error, as parts of tables would be missing."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\[]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not context.getCheckpointDir():
            context.setCheckpointDir(f"file:///tmp/siftwave-scratch-{uuid.uuid4().hex[:12]}")
        root = context.getCheckpointDir()
    return root


class Scratch:
    """Tables of one run in the shared folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_root(spark).rstrip('/')}/siftwave/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return the table as it was written."""
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def boxed(df: DataFrame, **more: Column) -> DataFrame:
    """All of df's columns as one struct, ``row``, beside ``more`` columns: no name of df's can clash with those. ``select("row.*")`` gives them back."""
    return df.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in more.items()])


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; nothing else changes."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

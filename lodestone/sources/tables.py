"""Readers. All of them are lazy and leave pruning and pushdown to Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTING = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType())])


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a folder of tables."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``path, length`` of the files below ``root``; their bodies are not read.

    Names that begin with a dot or an underscore are not listed, as by all of Spark's readers of files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").cast("long"))


def rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Ordered path rules from JSON lines ``{"class": ..., "pattern": ...}``.

    A rule set is a small hand-written file, so it becomes part of the plan.
    """
    schema = T.StructType([T.StructField("class", T.StringType()), T.StructField("pattern", T.StringType())])
    return [(r["class"], r["pattern"]) for r in spark.read.schema(schema).json(path).collect()]

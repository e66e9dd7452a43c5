"""The release audit over documents that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import patterns as P
from lodestone.operators.text import release_status


def document_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of documents as they arrive in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def status_counts(stream: DataFrame) -> DataFrame:
    """``status, n`` so far; the state is one row per status. For update or complete mode."""
    return release_status(stream).groupBy("status").agg(F.count("*").alias("n"))


def marker_counts(events: DataFrame, time: str, text: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, family, hits`` per time window. Rows later than ``late`` are left out, and closed windows are emitted once (append mode)."""
    families = F.array(*[F.struct(F.lit(f).alias("family"), P.hits(F.col(text), p).cast("long").alias("hits")) for f, p in P.CREDENTIALS.items()])
    rows = events.withWatermark(time, late).select(time, F.inline(families))
    counts = rows.groupBy(F.window(time, width), "family").agg(F.sum("hits").alias("hits"))
    return counts.select(F.col("window.start").alias("start"), "family", "hits")

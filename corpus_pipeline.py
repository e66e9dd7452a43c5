"""A training corpus from ``documents``, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``, and further ones whatever their names.
Stages work on whatever their predecessors kept; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontamination, langid, lines, minhash
from lodestone.llm.shared import Scratch

#: Documents whose words are less certain of their language than this on average have none that can be told.
LEAST_SCORE = 0.5
#: The language model can't be written in SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the corpus's labelled languages; without any label nothing can be told, and all stay."""
    model = langid.fit(docs)
    return langid.keep(docs, model, least=LEAST_SCORE) if model.labels else docs


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines, and documents that had nothing else; a null text and an empty one stay."""
    gone = "_gone"
    while gone in docs.columns:
        gone += "_"
    kept = lines.dedup(docs, equal=lines.EQUAL_CHARS, gone=gone)
    emptied = F.col(gone).isNotNull() & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    return kept.filter(~emptied | F.col("text").isNull()).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group.

    Rows without an id stay. Of rows with one id that with the longest text
    stays, and of equally long ones that with the greatest columns as JSON. Only
    such rows are grouped; the others pass through one join.
    """
    judged = minhash.near_duplicates(docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    kept = Scratch(spark, "near_duplicates").write(judged.filter("kept").select("doc_id", (F.col("rows") > 1).alias("several")))
    known = lambda several: docs.join(kept.filter(F.col("several") == several).select("doc_id").hint("merge"), "doc_id", "left_semi").select(docs.columns)
    out = docs.filter("doc_id IS NULL").unionByName(known(False))
    if not kept.filter("several").head(1):
        return out
    whole = F.struct(*docs.columns)
    best = known(True).groupBy(F.col("doc_id").alias("_")).agg(F.max_by(whole, F.struct(F.length("text").alias("n"), F.to_json(whole).alias("row"))).alias("row"))
    return out.unionByName(best.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that the benchmark contaminates; without words, or with an empty benchmark, a document stays."""
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256``: the tokens, and proof that they decode to the text. A null text has none."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("minhash_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written, and read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Pointer files resolved against the bodies that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import patterns as P

# The two lines that a pointer of the public format must have.
OID = r"(?m)^oid sha256:([0-9a-f]{64})$"
SIZE = r"(?m)^size ([0-9]{1,18})$"


def digests(bodies: DataFrame, body: str) -> DataFrame:
    """``oid, bytes, copies``: the distinct bodies by SHA-256, their lengths, and how many rows hold each. Null bodies are none.

    Digests are taken in the scan, and copies merge before the shuffle.
    """
    raw = F.col(body).cast("binary")
    named = bodies.filter(F.col(body).isNotNull()).select(F.sha2(raw, 256).alias("oid"), F.octet_length(raw).cast("long").alias("bytes"))
    return named.groupBy("oid").agg(F.max("bytes").alias("bytes"), F.count("*").alias("copies"))


def resolve(pointers: DataFrame, bodies: DataFrame, key: str, text: str, body: str) -> DataFrame:
    """``key, status, oid, size, copies`` for each pointer row.

    ``resolved``: a body has its digest and size; ``size_differs``: its digest
    alone; ``missing``: none has it; ``malformed``: a pointer without a digest or
    size; ``no_pointer``: a text that isn't one; a null text is ``no_pointer``. A
    pointer is resolved by content alone, so copies of a body are one, and a
    repeated pointer is judged each time. Where very many pointers name one
    body, the join is split by adaptive execution.
    """
    take = lambda pattern: F.nullif(F.regexp_extract(F.col(text), pattern, 1), F.lit(""))
    if key in ("status", "oid", "size", "copies", "bytes"):
        raise ValueError(f"the key is named as a result: {key}")
    mark = P.spare("_pointer", [key])
    is_pointer = F.coalesce(F.col(text).rlike(P.STUB), F.lit(False))
    read = pointers.select(F.col(key).alias(key), is_pointer.alias(mark), F.when(is_pointer, take(OID)).alias("oid"), F.when(is_pointer, take(SIZE)).cast("long").alias("size"))
    joined = read.join(digests(bodies, body).hint("merge"), "oid", "left")
    status = (
        F.when(~F.col(mark), "no_pointer")
        .when(F.col("oid").isNull() | F.col("size").isNull(), "malformed")
        .when(F.col("bytes").isNull(), "missing")
        .when(F.col("bytes") == F.col("size"), "resolved")
        .otherwise("size_differs")
    )
    return joined.select(key, status.alias("status"), "oid", "size", F.coalesce("copies", F.lit(0)).alias("copies"))

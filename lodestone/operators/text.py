"""Audit of document bodies: each operator is one pass over the text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import patterns as P


def marker_scan(corpus: DataFrame, families: dict[str, str] = P.CREDENTIALS, text: str = "text") -> DataFrame:
    """``family, hits, docs``; families without a hit stay, with 0.

    The counts of all families are made in one scan, as one row, which is then
    turned into a row per family: nothing but partial sums is shuffled. No
    matched text is ever returned. Null texts count nothing.
    """
    counted = corpus.select(*[P.hits(F.col(text), p, P.needs(f, p)).alias(f) for f, p in families.items()])
    sums = counted.agg(
        *[F.struct(F.lit(f).alias("family"), F.coalesce(F.sum(F.col(f).cast("long")), F.lit(0)).alias("hits"), F.count_if(F.col(f) > 0).alias("docs")).alias(f) for f in families]
    )
    return sums.select(F.inline(F.array(*families)))


def body_markers(pieces: DataFrame, families: dict[str, str] = P.CREDENTIALS, path: str = "path", text: str = "text") -> DataFrame:
    """``family, hits, bodies`` from pieces of bodies that no marker reaches over (``sources.ranges``); families without a hit stay, with 0.

    A body's pieces are added up before bodies are counted, so one with very many
    pieces is a row for each task. A null path is a body of its own.
    """
    counted = pieces.select(F.col(path).alias("path"), *[P.hits(F.col(text), p, P.needs(f, p)).cast("long").alias(f) for f, p in families.items()])
    each = counted.groupBy("path").agg(*[F.sum(f).alias(f) for f in families])
    sums = each.agg(*[F.struct(F.lit(f).alias("family"), F.coalesce(F.sum(f), F.lit(0)).alias("hits"), F.count_if(F.col(f) > 0).alias("bodies")).alias(f) for f in families])
    return sums.select(F.inline(F.array(*families)))


def stub_status(corpus: DataFrame, text: str = "text") -> DataFrame:
    """``status, n`` for pointer-only bodies, bodies with content and missing bodies (null)."""
    status = F.when(F.col(text).isNull(), "missing").when(F.col(text).rlike(P.STUB), "pointer_only").otherwise("content")
    return corpus.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def licence_lines(corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``line, n, docs``: licence statements, their number and that of the documents with them.

    The lines of a document are counted before the shuffle, so it carries one
    row for each document and distinct line, and both counts are plain sums.
    """
    lines = corpus.select(P.licence_lines_of(F.col(text)).alias("lines")).filter(F.size("lines") > 0)
    per_doc = lines.select(F.explode(F.array_distinct("lines")).alias("line"), "lines").select("line", F.size(F.filter("lines", lambda x: x == F.col("line"))).cast("long").alias("n"))
    return per_doc.groupBy("line").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


def personal_data(corpus: DataFrame, kinds: dict[str, str] = P.PERSONAL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and a count per kind, for documents with any hit. No shuffle.

    The counts are one struct, made once for each text and dropped where it is
    all zeros; a filter above a projection would count twice.
    """
    counted = F.struct(*[P.hits(F.col(text), p, P.needs(k, p)).alias(k) for k, p in kinds.items()])
    some = F.filter(F.array(counted), lambda c: F.greatest(*[c[k] for k in kinds], F.lit(0)) > 0)
    return corpus.select(key, F.inline(some))


def _status(body: Column) -> Column:
    return (
        F.when(P.any_of(body, P.CREDENTIALS), "blocked_credential").when(P.any_of(body, P.PERSONAL), "review_personal").when(body.rlike(P.LICENCE), "review_licence").otherwise("no_marker_found")
    )


def release_status(corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, status`` per document: the most severe finding of the three scans; a null text has none."""
    return corpus.select(key, _status(F.coalesce(F.col(text), F.lit(""))).alias("status"))


def release_gate(corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``status, n``. ``no_marker_found`` is no proof of safety: the scan is no complete audit."""
    return release_status(corpus, key, text).groupBy("status").agg(F.count("*").alias("n"))


def document_audit(corpus: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, hits of each credential family and kind of personal data, licence lines, and the status that they give.

    All scans of the audit in one pass over the texts, without a shuffle; the
    status is derived from the counts. Null texts have 0 everywhere.
    """
    body = F.col(text)
    families, kinds = list(P.CREDENTIALS), list(P.PERSONAL)
    counted = F.struct(
        *[P.hits(body, p, P.needs(k, p)).cast("long").alias(k) for k, p in (P.CREDENTIALS | P.PERSONAL).items()],
        F.coalesce(F.size(P.licence_lines_of(body)), F.lit(0)).cast("long").alias("licence_lines"),
    )
    rows = corpus.select(key, F.inline(F.array(counted)))
    total = lambda names: sum((F.col(n) for n in names), F.lit(0))
    status = F.when(total(families) > 0, "blocked_credential").when(total(kinds) > 0, "review_personal").when(F.col("licence_lines") > 0, "review_licence").otherwise("no_marker_found")
    return rows.withColumn("status", status)

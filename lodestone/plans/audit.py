"""The audit's queries over the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import patterns as P
from lodestone.operators import lineage, listing, text
from lodestone.sources.tables import table

#: Rules for URLs, the listing at hand; the first match decides.
URL_RULES = [("fragment", "#"), ("query", r"\?"), ("mobile_host", "^https?://m\\.")]
#: Items above so many bytes must be on the list of tracked items.
LARGE = 8192
REQUIRED_LANGS = ["en", "fr", "de", "es", "zh"]
Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents")


def size_census(spark: SparkSession, root: str) -> DataFrame:
    return listing.size_census(_documents(spark, root), "source", "doc_id", F.octet_length("text"))


def oversize_untracked(spark: SparkSession, root: str) -> DataFrame:
    return listing.oversize_untracked(_documents(spark, root), table(spark, root, "labels"), "doc_id", F.octet_length("text"), LARGE)


def required_coverage(spark: SparkSession, root: str) -> DataFrame:
    required = spark.createDataFrame([(x,) for x in REQUIRED_LANGS], "lang string")
    return listing.required_coverage(required, _documents(spark, root), "lang")


def golden_diff(spark: SparkSession, root: str) -> DataFrame:
    """Orders against themselves with the totals of one customer in 1,000 changed and one status left out."""
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    total = F.when(F.col("o_custkey") % 1000 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    altered = orders.withColumn("o_totalprice", total).filter("o_orderstatus <> 'P'")
    return lineage.golden_diff(altered, orders)


QUERIES: dict[str, Query] = {
    "size_census": size_census,
    "marker_scan": lambda s, d: text.marker_scan(_documents(s, d)),
    "oversize_untracked": oversize_untracked,
    "stub_status": lambda s, d: text.stub_status(_documents(s, d)),
    "path_class": lambda s, d: listing.path_class(table(s, d, "pages"), URL_RULES, "url", "plain"),
    "tracked_but_excluded": lambda s, d: listing.tracked_but_excluded(table(s, d, "pages"), URL_RULES, "url"),
    "required_coverage": required_coverage,
    "licence_lines": lambda s, d: text.licence_lines(_documents(s, d)),
    "personal_data": lambda s, d: text.personal_data(_documents(s, d)),
    "trace_orphans": lambda s, d: lineage.trace_orphans(table(s, d, "labels"), _documents(s, d), "doc_id"),
    "trace_coverage": lambda s, d: lineage.trace_coverage(table(s, d, "labels"), _documents(s, d), "doc_id", "source"),
    "snapshot_reconcile": lambda s, d: lineage.snapshot_reconcile(table(s, d, "orders"), table(s, d, "lineitem"), "o_orderkey", "l_orderkey"),
    "release_gate": lambda s, d: text.release_gate(_documents(s, d)),
    "golden_diff": golden_diff,
    "document_audit": lambda s, d: text.document_audit(_documents(s, d)),
}


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _count(pattern: str, column: str = "text") -> str:
    return f"coalesce(len(regexp_extract_all({column}, {_q(pattern)})), 0)"


def _any(patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches(coalesce(text, ''), {_q(p)})" for p in patterns) + ")"


def _document_audit() -> str:
    counts = ", ".join(f"CAST({_count(p)} AS BIGINT) AS {k}" for k, p in (P.CREDENTIALS | P.PERSONAL).items())
    total = lambda names: " + ".join(names)
    return (
        f"SELECT *, CASE WHEN {total(P.CREDENTIALS)} > 0 THEN 'blocked_credential' WHEN {total(P.PERSONAL)} > 0 THEN 'review_personal' WHEN licence_lines > 0 THEN 'review_licence' ELSE 'no_marker_found' END AS status "
        f"FROM (SELECT doc_id, {counts}, (SELECT count(*) FROM (SELECT unnest(string_split(text, chr(10))) AS line) WHERE regexp_matches(line, {_q(P.LICENCE)})) AS licence_lines FROM documents)"
    )


def _case(rules: list[tuple[str, str]], column: str, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {_q(p)}) THEN '{c}'" for c, p in rules) + f" ELSE '{other}' END"


ORACLE: dict[str, str] = {
    "size_census": "SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes, max(strlen(text)) AS max_bytes, arg_max(doc_id, {'b': strlen(text), 'i': -doc_id}) AS largest_id FROM documents GROUP BY source",
    "marker_scan": " UNION ALL ".join(f"SELECT '{f}' AS family, CAST(coalesce(sum({_count(p)}), 0) AS BIGINT) AS hits, count(*) FILTER (WHERE {_count(p)} > 0) AS docs FROM documents" for f, p in P.CREDENTIALS.items()),
    "oversize_untracked": f"SELECT doc_id, strlen(text) AS bytes FROM documents WHERE strlen(text) > {LARGE} AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "stub_status": f"SELECT CASE WHEN text IS NULL THEN 'missing' WHEN regexp_matches(text, {_q(P.STUB)}) THEN 'pointer_only' ELSE 'content' END AS status, count(*) AS n FROM documents GROUP BY 1",
    "path_class": f"SELECT {_case(URL_RULES, 'url', 'plain')} AS class, count(*) AS n FROM pages GROUP BY 1",
    "tracked_but_excluded": f"SELECT * FROM (SELECT url, {_case(URL_RULES, 'url', 'kept')} AS class FROM pages) WHERE class <> 'kept'",
    "required_coverage": "SELECT r.lang AS lang, count(d.lang) AS n FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('zh')) r(lang) LEFT JOIN documents d ON r.lang = d.lang GROUP BY r.lang",
    "licence_lines": f"SELECT line, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, {_q(P.LICENCE)}) GROUP BY line",
    "personal_data": f"SELECT * FROM (SELECT doc_id, {', '.join(f'CAST({_count(p)} AS INTEGER) AS {k}' for k, p in P.PERSONAL.items())} FROM documents) WHERE email + phone + ipv4 > 0",
    "trace_orphans": "SELECT l.doc_id FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id WHERE d.doc_id IS NULL",
    "trace_coverage": "SELECT d.source AS source, count(*) AS n, count(l.doc_id) AS traced FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY d.source",
    "snapshot_reconcile": "SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN b.k IS NULL THEN 'missing_in_snapshot' ELSE 'unexpected' END AS status FROM (SELECT DISTINCT o_orderkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) b ON a.k = b.k) GROUP BY status",
    "release_gate": f"SELECT CASE WHEN {_any(P.CREDENTIALS.values())} THEN 'blocked_credential' WHEN {_any(P.PERSONAL.values())} THEN 'review_personal' WHEN {_any([P.LICENCE])} THEN 'review_licence' ELSE 'no_marker_found' END AS status, count(*) AS n FROM documents GROUP BY 1",
    "golden_diff": "WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders), a AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_custkey % 1000 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM o WHERE o_orderstatus <> 'P'), d AS (SELECT *, 1 AS d FROM a UNION ALL SELECT *, -1 AS d FROM o) SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CASE WHEN sum(d) > 0 THEN 'actual' ELSE 'expected' END AS side, CAST(abs(sum(d)) AS BIGINT) AS copies FROM d GROUP BY 1, 2, 3, 4 HAVING sum(d) <> 0",
    "document_audit": _document_audit(),
}

"""Queries about a repository's paths, bodies and history, over the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import globs
from lodestone.functions import patterns as P
from lodestone.operators import ignore, pointers, provenance, rule_index, snapshot, text, tree
from lodestone.sources import ranges
from lodestone.sources.scratch import Scratch
from lodestone.sources.tables import table

#: Ignore files for the listing at hand: one at the root, and one in each host's directory by the kind of host.
IGNORE_ROOT = "# pages that are made anew\n*.html\n!148.html\n*#top\n**/es/\n!es/1*\n/spam-farm.example.*/\n"
IGNORE_HOSTS = {
    "blog.": "/de/\n!/en/*.html\n*page=[0-9]*\n",
    "www.": "*\n!*/\n!*.html\n",
    "m.": "en/[0-4]*\n!en/2*\nfr\n",
}
#: Attribute files: what is tracked as a large file.
ATTRIBUTES = {"": "*.html filter=lfs diff=lfs -text\n**/en/** filter=lfs\n*#top -filter\n", "spam-farm.example.org": "* !filter\n"}
#: Pages above so many bytes must be tracked.
LARGE = 2048
#: Bytes in a range and in a piece of the bodies that are scanned.
RANGE_BYTES, PIECE_BYTES = 4 << 20, 256 << 10
Query = Callable[[SparkSession, str], DataFrame]


def _paths(spark: SparkSession, root: str) -> DataFrame:
    """Pages as files: their URLs without the scheme."""
    return table(spark, root, "pages").withColumn("path", F.regexp_replace("url", "^[a-z]+://", ""))


def _tree(spark: SparkSession, root: str) -> DataFrame:
    """Pages as files of a deeper tree: each digit begins a directory of its own."""
    return _paths(spark, root).withColumn("path", F.regexp_replace(F.regexp_replace("path", "([0-9])", "/$1"), "/+", "/"))


def ignored_paths(spark: SparkSession, root: str) -> DataFrame:
    items = _paths(spark, root)
    host = F.substring_index("path", "/", 1)
    body = None
    for start, rules in IGNORE_HOSTS.items():
        body = (F.when if body is None else body.when)(host.startswith(start), F.lit(rules))
    hosts = items.select(F.concat(host, F.lit("/.gitignore")).alias("path"), body.alias("text")).filter("text IS NOT NULL").distinct()
    files = spark.createDataFrame([(".gitignore", IGNORE_ROOT)], "path string, text string").unionByName(hosts)
    # Written, so that its size is known where the join is planned.
    return ignore.ignored(items, Scratch(spark, "ignore").write(ignore.ignore_rules(files)))


def oversize_by_pattern(spark: SparkSession, root: str) -> DataFrame:
    files = spark.createDataFrame([(f"{d}/.gitattributes", t) for d, t in ATTRIBUTES.items()], "path string, text string")
    return ignore.oversize_by_pattern(_paths(spark, root), ignore.attribute_rules(files, "filter"), F.octet_length("html"), LARGE)


def large_rule_set(spark: SparkSession, root: str) -> DataFrame:
    """Pages by a rule for each order: the page with the order's number has its priority as class."""
    pattern = F.concat(F.lit("/(?:en|fr|de)/"), F.col("o_orderkey").cast("string"), F.lit(r"(?:\.html)?(?:[/?#]|$)"))
    rules = table(spark, root, "orders").select(F.col("o_orderkey").alias("priority"), F.col("o_orderpriority").alias("class"), pattern.alias("pattern"))
    return rule_index.classify(table(spark, root, "pages"), rules, "url")


def pointer_status(spark: SparkSession, root: str) -> DataFrame:
    """A pointer for each document, with its number of characters as size; the store holds the texts of the labelled ones."""
    docs = table(spark, root, "documents")
    pointer = F.concat(F.lit("version https://git-lfs.github.com/spec/v1\noid sha256:"), F.sha2(F.col("text").cast("binary"), 256), F.lit("\nsize "), F.col("n_chars").cast("string"), F.lit("\n"))
    stored = docs.join(table(spark, root, "labels").select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    return pointers.resolve(docs.select("doc_id", pointer.alias("pointer")), stored, "doc_id", "pointer", "text")


def snapshot_merge(spark: SparkSession, root: str) -> DataFrame:
    """Orders that aren't pending as the snapshot, line items as changes; those before 1997 are in it, those after the last commit aren't changes yet."""
    base = table(spark, root, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", "o_totalprice")
    log = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("o_custkey"), F.col("l_extendedprice").alias("o_totalprice"), "l_shipdate", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
    committed = F.expr("l_linestatus = 'F' AND l_shipdate < TIMESTAMP '2001-01-01 00:00:00'")
    return snapshot.merge_log(base, log, ["o_orderkey"], ["l_shipdate", "l_partkey", "l_linenumber"], F.col("l_returnflag") == "R", committed, F.expr("l_shipdate >= TIMESTAMP '1997-01-01 00:00:00'"))


def origin_of_events(spark: SparkSession, root: str) -> DataFrame:
    """Events that come from the same user's event before; errors name one that doesn't exist."""
    before = F.expr("lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
    events = table(spark, root, "events").select("event_id", F.when(F.col("event_type") == "error", -1 - F.col("event_id")).otherwise(before).alias("source"))
    return provenance.origins(events, "event_id", "source")


def body_scan(spark: SparkSession, root: str) -> DataFrame:
    """All documents as lines of text files, which are scanned by ranges."""
    path = Scratch(spark, "bodies").path("text")
    table(spark, root, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    return text.body_markers(ranges.read_pieces(spark, path, RANGE_BYTES, PIECE_BYTES)).select("family", "hits")


QUERIES: dict[str, Query] = {
    "ignored_paths": ignored_paths,
    "body_scan": body_scan,
    "large_rule_set": large_rule_set,
    "pointer_status": pointer_status,
    "directory_sizes": lambda s, d: tree.directory_sizes(_tree(s, d), F.octet_length("html"), without=("fr",)),
    "nearest_licence": lambda s, d: tree.nearest_licence(_tree(s, d), names=r"\.html$"),
    "snapshot_merge": snapshot_merge,
    "origin_of_events": origin_of_events,
    "oversize_by_pattern": oversize_by_pattern,
}


def _q(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (bool, int)) else "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows) + ")"


def _ignore_rows() -> list[tuple]:
    rows = []
    for kind, body in {"": IGNORE_ROOT, **IGNORE_HOSTS}.items():
        rows += [(kind, line, pattern, negated, glob.regex, glob.directories) for line, negated, pattern in globs.lines(body) if (glob := globs.translate(pattern))]
    return rows


def _attribute_rows() -> list[tuple]:
    return [(d, line, given["filter"], globs.translate(pattern).regex) for d, body in ATTRIBUTES.items() for line, pattern, given in globs.attribute_lines(body) if "filter" in given]


_PATH = "regexp_replace(url, '^[a-z]+://', '')"
_TREE = f"regexp_replace(regexp_replace({_PATH}, '([0-9])', '/\\1', 'g'), '/+', '/', 'g')"
_PARENT = "regexp_replace(regexp_replace({0}, '^/+|/+$', '', 'g'), '/*[^/]*$', '')"
_PARTS = "list_filter(string_split({0}, '/'), lambda x: x <> '')"

ORACLE: dict[str, str] = {
    "ignored_paths": f"""
        WITH p AS (SELECT DISTINCT {_PATH} AS path FROM pages),
        kinds AS (SELECT * FROM {_values(_ignore_rows())} k(kind, line, pattern, negated, regex, directories)),
        hosts AS (SELECT DISTINCT string_split(path, '/')[1] AS host FROM p),
        r AS (
            SELECT '' AS directory, line, pattern, negated, regex, directories FROM kinds WHERE kind = ''
            UNION ALL SELECT host, line, pattern, negated, regex, directories FROM hosts JOIN kinds ON kind <> '' AND starts_with(host, kind)
        ),
        c AS (SELECT path, {_PARTS.format("path")} AS c, path LIKE '%/' AS folder FROM p),
        s AS (SELECT path, c, level, folder OR level < len(c) AS is_directory, len(c) AS levels FROM (SELECT *, unnest(range(1, len(c) + 1)) AS level FROM c)),
        x AS (SELECT *, array_to_string(c[1:depth], '/') AS directory, array_to_string(c[depth + 1:level], '/') AS below FROM (SELECT *, unnest(range(0, level)) AS depth FROM s)),
        m AS (SELECT path, level, levels, depth, r.* FROM x JOIN r USING (directory) WHERE regexp_matches(below, regex) AND (is_directory OR NOT directories)),
        d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY path, level ORDER BY depth DESC, line DESC) = 1),
        v AS (SELECT * FROM d WHERE NOT negated OR level = levels QUALIFY row_number() OVER (PARTITION BY path ORDER BY negated, level) = 1)
        SELECT path, coalesce(NOT negated, false) AS ignored, directory, CAST(line AS INT) AS line, pattern FROM p LEFT JOIN v USING (path)
    """,
    "body_scan": " UNION ALL ".join(f"SELECT '{f}' AS family, CAST(coalesce(sum(len(regexp_extract_all(text, {_q(p)}))), 0) AS BIGINT) AS hits FROM documents" for f, p in P.CREDENTIALS.items()),
    "large_rule_set": r"""
        WITH u AS (SELECT url, count(*) AS n FROM pages GROUP BY url),
        k AS (SELECT url, n, TRY_CAST(regexp_extract(url, '/(?:en|fr|de)/([0-9]+)(?:\.html)?(?:[/?#]|$)', 1) AS BIGINT) AS o_orderkey FROM u)
        SELECT url AS path, n, coalesce(o_orderpriority, 'kept') AS class FROM k LEFT JOIN orders USING (o_orderkey)
    """,
    "pointer_status": """
        WITH d AS (SELECT doc_id, sha256(text) AS oid, CAST(n_chars AS BIGINT) AS size, strlen(text) AS bytes FROM documents),
        b AS (SELECT oid, bytes, count(*) AS copies FROM d WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY oid, bytes)
        SELECT doc_id, CASE WHEN b.bytes IS NULL THEN 'missing' WHEN b.bytes = size THEN 'resolved' ELSE 'size_differs' END AS status, oid, size, coalesce(copies, 0) AS copies
        FROM d LEFT JOIN b USING (oid)
    """,
    "directory_sizes": f"""
        WITH d AS (SELECT {_PARTS.format(_PARENT.format(_TREE))} AS c, strlen(html) AS b FROM pages)
        SELECT array_to_string(c[1:depth], '/') AS directory, CAST(depth AS INT) AS depth, count(*) AS files, CAST(sum(b) AS BIGINT) AS bytes
        FROM (SELECT c, b, unnest(range(0, len(c) + 1)) AS depth FROM d WHERE NOT list_contains(c, 'fr')) GROUP BY 1, 2
    """,
    "nearest_licence": f"""
        WITH p AS (SELECT row_number() OVER () AS no, {_TREE} AS path FROM pages),
        d AS (SELECT no, path, {_PARENT.format("path")} AS directory FROM p),
        h AS (SELECT directory, min(path) AS licence FROM d WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '\\.html$') GROUP BY directory),
        a AS (SELECT no, depth, array_to_string(c[1:depth], '/') AS directory FROM (SELECT no, c, unnest(range(0, len(c) + 1)) AS depth FROM (SELECT no, {_PARTS.format("directory")} AS c FROM d))),
        n AS (SELECT no, licence FROM a JOIN h USING (directory) QUALIFY row_number() OVER (PARTITION BY no ORDER BY depth DESC) = 1)
        SELECT path, licence FROM d LEFT JOIN n USING (no)
    """,
    "snapshot_merge": """
        WITH l AS (
            SELECT * FROM lineitem
            WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND row(l_shipdate, l_partkey, l_linenumber) <= (SELECT max(row(l_shipdate, l_partkey, l_linenumber)) FROM lineitem WHERE l_linestatus = 'F' AND l_shipdate < TIMESTAMP '2001-01-01')
        ),
        last AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC, l_linenumber DESC, l_returnflag = 'R', l_suppkey DESC, l_extendedprice DESC) = 1),
        base AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P')
        SELECT o_orderkey, o_custkey, o_totalprice, 'unchanged' AS change FROM base WHERE o_orderkey NOT IN (SELECT l_orderkey FROM last)
        UNION ALL
        SELECT l_orderkey, l_suppkey, l_extendedprice, CASE WHEN o_orderkey IS NULL THEN 'inserted' ELSE 'updated' END FROM last LEFT JOIN base ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R'
    """,
    "origin_of_events": """
        WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, CASE WHEN event_type = 'error' THEN -1 - event_id ELSE lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS source FROM events),
        walk(event_id, origin, source, hops) AS (
            SELECT event_id, event_id, source, 0 FROM e
            UNION ALL SELECT w.event_id, e.event_id, e.source, w.hops + 1 FROM walk w JOIN e ON e.event_id = w.source
        )
        SELECT event_id, CASE WHEN source IS NULL THEN 'rooted' ELSE 'broken' END AS state, origin, CAST(hops AS BIGINT) AS hops
        FROM walk WHERE source IS NULL OR source < 0
    """,
    "oversize_by_pattern": f"""
        WITH p AS (SELECT {_PATH} AS path, strlen(html) AS bytes FROM pages WHERE strlen(html) > {LARGE}),
        r AS (SELECT * FROM {_values(_attribute_rows())} r(directory, line, value, regex)),
        c AS (SELECT path, {_PARTS.format("path")} AS c FROM (SELECT DISTINCT path FROM p)),
        x AS (SELECT path, depth, array_to_string(c[1:depth], '/') AS directory, array_to_string(c[depth + 1:], '/') AS below FROM (SELECT *, unnest(range(0, len(c))) AS depth FROM c)),
        v AS (SELECT path, value FROM x JOIN r USING (directory) WHERE regexp_matches(below, regex) QUALIFY row_number() OVER (PARTITION BY path ORDER BY depth DESC, line DESC) = 1)
        SELECT path, bytes FROM p WHERE path NOT IN (SELECT path FROM v WHERE value = 'lfs')
    """,
}

"""The subpackage's registered queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontamination, embeddings, langid, lines, maintext, minhash, mixture, phrases, pii, repeats, search, warc
from lodestone.llm.shared import Scratch


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, root: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, root, "documents"), percent=85)


def op2_byte_bpe(spark: SparkSession, root: str) -> DataFrame:
    return bpe.round_trip(_table(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    return lines.counts(_table(spark, root, "documents"), equal=lines.EQUAL_CHARS)


def op4_language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = langid.fit(docs.filter(part != 2))
    return langid.predict(docs, model).select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_repeated_bytes(spark: SparkSession, root: str) -> DataFrame:
    """Beside the contract's columns, the outcome in plain form: whether anything was removed, and what is left (cut characters become U+FFFD)."""
    cut = repeats.remove(_table(spark, root, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("changed"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op6_embedding_dedup(spark: SparkSession, root: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, root, "embeddings"))


def op7_warc(spark: SparkSession, root: str) -> DataFrame:
    folder = Scratch(spark, "warc").root
    warc.write(_table(spark, root, "pages"), folder)
    return warc.pages(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontamination(spark: SparkSession, root: str) -> DataFrame:
    return decontamination.digest(decontamination.scan(_table(spark, root, "documents"), _table(spark, root, "benchmark")))


def op9_main_text(spark: SparkSession, root: str) -> DataFrame:
    return maintext.extract(_table(spark, root, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_pii(spark: SparkSession, root: str) -> DataFrame:
    """The key is a stand-in: whoever runs this on real data passes a secret one."""
    marked = pii.pseudonymise(_table(spark, root, "documents"), key="not a secret")
    count = lambda *kinds: sum((F.coalesce(F.col("pii_counts")[k], F.lit(0)) for k in kinds), F.lit(0))
    return marked.select("doc_id", "text", count(*pii.PATTERNS).alias("n_values"), count("date").alias("n_dates"), count("email").alias("n_emails"))


def op11_phrase_mining(spark: SparkSession, root: str) -> DataFrame:
    return phrases.mine(_table(spark, root, "documents"))


def op12_source_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixture.mix(_table(spark, root, "documents")).taken()


def op13_lexical_search(spark: SparkSession, root: str) -> DataFrame:
    return search.search(_table(spark, root, "documents"), _table(spark, root, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_repeated_bytes": op5_repeated_bytes,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_warc": op7_warc,
    "op8_decontamination": op8_decontamination,
    "op9_main_text": op9_main_text,
    "op10_pii": op10_pii,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_source_mix": op12_source_mix,
    "op13_lexical_search": op13_lexical_search,
}

_UPPER, _LOWER = ("".join(chr(c + k) for c in range(65, 91)) for k in (0, 32))
_NOT_SPACE, _NOT_ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, pattern: str) -> str:
    """SQL for the words of a text in lower case, as a list."""
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


#: UTF-8 in hexadecimal digits: runs of whole characters; and these, beginnings of one, or a byte that is neither.
_CHARACTERS = r"(?:[0-7].|(?:C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|E[1-9A-CEF](?:[89AB].){2}|ED[89].[89AB].|F0[9AB].(?:[89AB].){2}|F[123](?:[89AB].){3}|F48.(?:[89AB].){2})+"
_UTF8 = _CHARACTERS + r"|F0[9AB].(?:[89AB].)?|F[123](?:[89AB].){1,2}|F48.(?:[89AB].)?|E0[AB].|E[1-9A-CEF][89AB].|ED[89].|.."

ORACLE: dict[str, str] = {
    "op1_minhash_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_words("text", _NOT_SPACE)} AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS sh
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS MATERIALIZED (
            SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
            JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * common >= 85 * (x.n + y.n - common)
        ),
        reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        root AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM root LEFT JOIN n USING (doc_id)
    """,
    # Lines within two edits have one of three segments in common, moved by two places at most; distances are of
    # characters, which stand for their number in the pair's alphabet since the function compares bytes.
    "op3_line_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
        x AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d WHERE doc_id IS NOT NULL)),
        e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY line) AS id, line, length(line) AS n FROM (SELECT DISTINCT line FROM x WHERE length(line) >= {lines.MIN_CHARS})),
        k AS (SELECT unnest(range(3)) AS k),
        segments AS (SELECT id, n, k, substring(line, k * n // 3 + 1, (k + 1) * n // 3 - k * n // 3) AS s FROM e, k),
        probes AS (
            SELECT DISTINCT id, t AS n, k, substring(line, k * t // 3 + 1 + move, (k + 1) * t // 3 - k * t // 3) AS s
            FROM (SELECT id, line, n - less AS t, k, move FROM e, k, (SELECT unnest(range(3)) AS less), (SELECT unnest(range(-2, 3)) AS move))
            WHERE k * t // 3 + move >= 0
        ),
        pairs AS (SELECT DISTINCT p.id AS a, s.id AS b FROM probes p JOIN segments s USING (n, k, s) WHERE p.id <> s.id),
        known AS (SELECT a, b, x.line AS p, y.line AS q, list_distinct(string_split(x.line || y.line, '')) AS abc FROM pairs JOIN e x ON x.id = a JOIN e y ON y.id = b),
        near AS (
            SELECT a, b FROM known
            WHERE levenshtein(list_aggregate(list_transform(string_split(p, ''), lambda c: chr(list_position(abc, c))), 'string_agg', ''),
                list_aggregate(list_transform(string_split(q, ''), lambda c: chr(list_position(abc, c))), 'string_agg', '')) <= {lines.EDITS}
        ),
        links AS MATERIALIZED (SELECT a, b FROM near UNION SELECT b, a FROM near),
        reach(a, b) AS (SELECT id, id FROM e UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        root AS (SELECT line, CAST(min(b) AS VARCHAR) AS class FROM reach JOIN e ON id = a GROUP BY line),
        judged AS (
            SELECT doc_id, line_no, line, CASE WHEN length(line) >= {lines.MIN_CHARS} THEN 'g' || class WHEN regexp_matches(line, '[^\\s\\pZ\\x0B\\x1C-\\x1F\\x85]') THEN 's' || line END AS class
            FROM x LEFT JOIN root USING (line)
        ),
        marked AS (SELECT *, class IS NULL OR row(doc_id, line_no) = min(row(doc_id, line_no)) OVER (PARTITION BY class) AS stays FROM judged),
        kept AS (SELECT doc_id, count(*) FILTER (NOT stays) AS n_removed, string_agg(line, chr(10) ORDER BY line_no) FILTER (stays) AS t FROM marked GROUP BY doc_id)
        SELECT d.doc_id, coalesce(len(l), 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(CASE WHEN d.doc_id IS NULL THEN text ELSE t END, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    # Bytes are pairs of hexadecimal digits; what is no character of UTF-8 in the rest becomes U+FFFD.
    "op5_repeated_bytes": f"""
        WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT doc_id, c, substring(h, 2 * c + 1, {2 * (repeats.LENGTH + 255)}) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 256)) AS c FROM d)),
        w AS (
            SELECT doc_id, c + i AS i, md5(substring(h, 2 * i + 1, {2 * repeats.LENGTH})) AS m
            FROM (SELECT doc_id, c, h, unnest(range(least(256, len(h) // 2 - {repeats.LENGTH - 1}))) AS i FROM c WHERE len(h) >= {2 * repeats.LENGTH})
        ),
        s AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
        g AS (SELECT doc_id, i, i > lag(i, 1, -{repeats.LENGTH + 1}) OVER (PARTITION BY doc_id ORDER BY i) + {repeats.LENGTH} AS opens FROM s),
        runs AS (
            SELECT doc_id, min(i) AS lo, max(i) + {repeats.LENGTH} AS hi
            FROM (SELECT doc_id, i, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run
        ),
        gaps AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS behind FROM runs),
        cut AS (
            SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, string_agg(substring(h, 2 * behind + 1, 2 * (lo - behind)), '' ORDER BY lo) || substring(any_value(h), 2 * max(hi) + 1) AS rest
            FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
        ),
        kept AS (SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(rest, h) AS rest FROM d LEFT JOIN cut USING (doc_id)),
        parts AS (SELECT *, regexp_extract_all(rest, '{_UTF8}') AS u FROM kept)
        SELECT doc_id, n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(rest)) AS kept_sha256, n_removed > 0 AS changed,
            coalesce(decode(unhex(list_aggregate(list_transform(u, lambda x: CASE WHEN regexp_full_match(x, '{_CHARACTERS}') THEN x ELSE 'EFBFBD' END), 'string_agg', ''))), '') AS text
        FROM parts
    """,
    "op6_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        links AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
        ),
        reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
            (SELECT min(b) FROM reach WHERE a = vec_id) AS component_id, vec_id = (SELECT min(b) FROM reach WHERE a = vec_id) AS kept
        FROM v
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
        r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM r
    """,
    "op8_decontamination": f"""
        WITH d AS (SELECT doc_id, {_words("text", _NOT_ALNUM)} AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text", _NOT_ALNUM)} AS w FROM benchmark),
        known AS (
            SELECT DISTINCT item, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s
            FROM (SELECT item, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0)
        ),
        hits AS (
            SELECT doc_id, p, k, item FROM (
                SELECT doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s
                FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM known) WHERE len(w) >= k)
            ) JOIN known USING (k, s)
        ),
        words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    # Longer candidates are one word longer: phrases have three words at most.
    "op11_phrase_mining": f"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
            FROM documents
        ),
        g AS (
            SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
        ),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {phrases.LEAST}),
        longer AS (
            SELECT lang, phrase, max(a) AS longer
            FROM (SELECT lang, a, array_to_string(list_slice(w, 1, 2), ' ') AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(list_slice(w, 2, 3), ' ') AS phrase FROM c WHERE k = 3)
            GROUP BY lang, phrase
        ),
        cuts AS (
            SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
            JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, cut), ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, cut + 1, c.k), ' ')
        ),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.longer IS NULL OR 100 * o.longer < {phrases.PERCENT} * b.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN n USING (lang) QUALIFY rank <= {phrases.TOP}
    """,
    # What the mix takes is the first words of each source's stream; the schedule only orders them.
    "op12_source_mix": f"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_NOT_SPACE}')) AS size, substr(md5('{mixture.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS mark
            FROM documents
        ),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no, 2 * source_size AS most FROM s),
        v AS (SELECT *, list_extract([3, 1, 2], CAST((no - 1) % 3 + 1 AS INT)) AS weight FROM w),
        o AS (
            SELECT *, 150 * sum(source_size) OVER () - 100 * coalesce(sum(most) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unspent,
                sum(weight) OVER (k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER k AS place
            FROM v WINDOW k AS (ORDER BY source_size / weight, no)
        ),
        c AS (SELECT *, unspent * weight >= most * rest * 100 AS is_full FROM o),
        f AS (SELECT unspent, rest FROM c WHERE NOT is_full ORDER BY place LIMIT 1),
        t AS (
            SELECT source, source_size, CASE WHEN is_full THEN CAST(most AS DOUBLE) ELSE CAST((SELECT unspent FROM f) * weight AS DOUBLE) / CAST((SELECT rest FROM f) * 100 AS DOUBLE) END AS target
            FROM c
        ),
        p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY mark, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
        SELECT doc_id, size, source_size, target, CAST(greatest(0, least(start + size, floor(target)) - start) + greatest(0, least(start + source_size + size, floor(target)) - start - source_size) AS BIGINT) AS taken
        FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
    """,
    "op13_lexical_search": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS no, {_words("text", _NOT_ALNUM)} AS w FROM documents),
        k AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_words("text", _NOT_ALNUM)}) AS term FROM benchmark) GROUP BY ALL),
        t AS (SELECT no, term, count(*) AS tf FROM (SELECT no, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        g AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM t GROUP BY term), k),
        m AS (SELECT doc_id, no, 25 + (75 * len(w) * docs) // terms AS m FROM d, k),
        s AS (
            SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
            FROM q JOIN t USING (term) JOIN g USING (term) JOIN m USING (no) GROUP BY item_id, no, doc_id
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= {search.TOP}
    """,
}

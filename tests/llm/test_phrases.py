"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

from lodestone.llm import phrases as P
from lodestone.llm import registry
from tests.oracle import same

lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(docs, longest=3, least=10, percent=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    longer = Counter()
    for (lang, *w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[(lang, *w[i : i + k])] = max(longer[(lang, *w[i : i + k])], a)
    rows = {}
    for p, a in candidates.items():
        if 100 * longer[p] < percent * a:
            lang, *w = p
            cuts = [(f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
            score, _, l, r = min((10**6 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, own in rows.items() for k, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1))


def mined(docs, **more):
    return sorted(map(tuple, P.mine(docs, **more).select(COLUMNS).collect()))


def say(rng, n):
    out = []
    for _ in range(n):
        out.append(rng.choice(["the", "The", "New", "new", "york", "city", "été", "É", "a", "of", "naïve", "x" * 40, "日本"]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", ";x ", "\r", " "]))
    return "".join(out)


def test_against_brute_force(spark):
    rng = random.Random(11)
    docs = [(rng.choice(["en", "en", None, "und", "zh"]), say(rng, rng.randrange(120))) for _ in range(120)] + [("en", None), (None, ""), ("en", ".,;"), ("fr", "one two"), ("en", say(rng, 3000))]
    docs += docs[:20]  # repeated rows count each time
    frame = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string").selectExpr("*", "1 AS prefix", "'x' AS next", "map('a', 1) AS n", "doc_id AS state").repartition(5)
    want = brute(docs)
    assert len(want) > 100 and mined(frame) == want
    assert mined(frame, longest=5, least=4, percent=80, top=30) == brute(docs, 5, 4, 80, 30)
    assert mined(frame, longest=2) == brute(docs, 2)


def test_chunks_and_parts(spark):
    """Merging in any chunks gives the same stripes."""
    rng = random.Random(3)
    docs = [("en", say(rng, 60)) for _ in range(50)]
    frame = spark.createDataFrame([(t, lang) for lang, t in docs], "text string, lang string")
    rows = frame.coalesce(1).mapInArrow(P._stripes(0, None, None), P.STRIPE).toArrow().sort_by([("prefix", "ascending"), ("part", "ascending")])
    double = P.pa.concat_tables([rows, rows, rows]).sort_by([("prefix", "ascending"), ("part", "ascending")])
    whole = P._merge_rows(double, 0, 1, True)[0].to_pylist()
    for step in (1, 2, 7, 500):
        held, out = [], []
        for k in range(0, double.num_rows, step):
            merged, rest = P._merge_rows(P.pa.concat_tables([*held, double.slice(k, step)]), 0, 1, False)
            out, held = out + merged.to_pylist(), [rest]
        out += P._merge_rows(held[0], 0, 1, True)[0].to_pylist()
        assert out == whole
    assert sum(sum(r["n"]) for r in whole) == 3 * sum(len(re.findall(r"[^ \t.,;:!?\n\r]+", t)) for _, t in docs)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert mined(none) == [] and P.mine(none).columns == COLUMNS
    assert mined(spark.createDataFrame([(1, None, None), (2, " ", "en")], none.schema)) == []


def test_large_counts(spark):
    """Products beyond 64 bits stay exact."""
    row = spark.sql("SELECT 40000000000000L AS a, 40000000000001L AS l, 40000000000003L AS r")
    assert row.select(P.score().alias("s")).first().s == 10**6 * 40000000000000**2 // (40000000000001 * 40000000000003) == 999999


def test_query_against_brute_force(spark):
    docs = [(r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = registry.op11_phrase_mining(spark, "/root/testdata/sf0.001")
    assert got.columns == COLUMNS and sorted(map(tuple, got.collect())) == brute(docs)


def test_against_sql(spark):
    same(spark, "op11_phrase_mining", registry.QUERIES["op11_phrase_mining"], registry.ORACLE["op11_phrase_mining"])

"""The search against scores of all documents for all items."""

import math
import random
import re
from collections import Counter

import numpy as np

from lodestone.llm import registry
from lodestone.llm import search as S
from tests.oracle import same

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return Counter(t.translate(lower) for t in TERM.findall(text or ""))


def brute(docs, items, top=10):
    bags = [(d, terms(t)) for d, t in docs]
    n, total = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scores = []
        for d, b in bags:
            m = 25 + 75 * b.total() * n // max(total, 1)
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, c in terms(text).items() if b[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS terms", "1 AS hash", "map('a', 1) AS class", "2 AS m", "3 AS item").repartition(6)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "'y' AS rank")
    got = S.search(a, b, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    return sorted(map(tuple, got.collect()), key=repr)


def cases():
    rng = random.Random(4)
    words = ["Été", "naïve", "a", "B", "the", "THE", "x9", "日本", "zz", "co"] + [f"w{k}" for k in range(30)]
    say = lambda n: rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(words, k=n))
    docs = [(k, say(rng.randrange(30))) for k in range(300)]
    docs += [(1000 + k, "the same bag of words: w1 w2 w3") for k in rng.sample(range(400), 60)]  # one class, ids in no order
    docs += [(2000 + k, rng.choice(["w1 w2 other", "W2, w1; words"])) for k in range(20)]  # equal vectors and lengths, other texts
    docs += [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (5, "w1 w1"), (5, "w1 w1"), (3000, None), (3001, ""), (3002, "?!"), (3003, "w7 " * 4000 + "w8")]
    items = [(k, say(rng.choice([1, 2, 8, 40]))) for k in range(25)] + [(50, None), (51, "..."), (52, "nowhere"), (53, "w1 w2"), (53, "w1 w2"), (53, "w3 w3 w3"), (None, "w5 zz")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    want = brute(docs, items)
    assert len(want) > 200 and found(spark, docs, items) == want
    assert found(spark, docs, items, block_bytes=700) == want
    assert found(spark, docs, items, top=3) == brute(docs, items, 3)


def test_small_pieces_of_work():
    """Sums and scores in many pieces give the same best classes."""
    rng = np.random.default_rng(1)
    items = S.Items.of(["a b c", "a a d", "e", "b d e a"])
    shared = type("B", (), {"value": items})
    weights = type("B", (), {"value": rng.integers(1, 9, len(items.terms))})
    terms_ = [sorted(rng.choice(5, rng.integers(1, 6), replace=False).tolist()) for _ in range(60)]
    rows = S.pa.record_batch(
        {
            "terms": S.pa.array(terms_, S.pa.list_(S.pa.int32())),
            "tfs": S.pa.array([rng.integers(1, 4, len(t)).tolist() for t in terms_], S.pa.list_(S.pa.int32())),
            "m": S.pa.array(rng.integers(25, 200, 60)),
            "class": S.pa.array(range(60), S.pa.int64()),
            "least": S.pa.array([None if k % 9 == 0 else 100 - k for k in range(60)], S.pa.int64()),
        }
    )
    best = lambda step: S.pa.Table.from_batches(S._best(shared, weights, 4)(iter([rows.slice(k, step) for k in range(0, 60, step)]))).to_pylist()
    want = best(60)
    old = S.SUMS, S.SCORES
    try:
        S.SUMS, S.SCORES = 3, 8
        assert best(60) == want == best(7) and len(want) == 16
    finally:
        S.SUMS, S.SCORES = old


def test_empty(spark):
    docs, items = cases()
    assert found(spark, [(1, None)], items) == [] == found(spark, docs[:5], [(1, None)])
    assert S.search(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_query_against_brute_force(spark):
    root = "/root/testdata/sf0.001"
    plain = lambda t, k: [(r[k], r.text) for r in spark.read.parquet(f"{root}/{t}.parquet").collect()]
    got = registry.op13_lexical_search(spark, root)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(plain("documents", "doc_id"), plain("benchmark", "item_id"))


def test_against_sql(spark):
    same(spark, "op13_lexical_search", registry.QUERIES["op13_lexical_search"], registry.ORACLE["op13_lexical_search"])

"""Removed bytes against a plain count of all windows; the order against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import registry
from lodestone.llm import repeats as R
from tests.llm.test_minhash import twins
from tests.oracle import same


def brute(docs, length):
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(hash(t[k : k + length]) for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[hash(t[k : k + length])] > 1:
                gone[k : k + length] = True
        gone = gone[:-1]
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digest(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def texts(rng):
    say = lambda n, a="abcdé ": "".join(rng.choices(a, k=n))
    shared = [say(rng.randrange(30, 160)) for _ in range(8)]
    out = ["", None, "a" * 300, "ab" * 150, "ab" * 151, "\x00" * 90, say(40), say(41)]
    for _ in range(40):
        out.append("".join(rng.choice([say(rng.randrange(60)), rng.choice(shared), rng.choice(shared)[10:]]) for _ in range(rng.randrange(1, 6))))
    return out + out[10:14] + [out[9] + say(9), say(3) + out[12]]


@pytest.mark.parametrize("length, gram, crowd", [(40, 8, 4096), (33, 32, 4096), (40, 8, 2), (40, 8, 1)])
def test_removed_bytes(spark, monkeypatch, length, gram, crowd):
    monkeypatch.setattr(R, "CROWD", crowd)
    monkeypatch.setattr(R, "SORTED", 300)
    rng = random.Random(length + crowd)
    docs = [(k, t) for k, t in enumerate(texts(rng))]
    docs += [(None, docs[15][1]), docs[20], (777, "q" * 20 + docs[21][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS t", "'x' AS ranges", "2 AS u", "3 AS piece").repartition(5)
    assert digest(R.remove(frame, length, gram)) == brute(docs, length)


def test_twins_are_told_apart(spark):
    """Texts, and parts of texts, that a polynomial hash modulo 2**64 takes for equal."""
    x, y = twins()
    docs = [(1, x), (2, y), (3, x), (4, "q" * 30 + y[:900]), (5, x[:512] + "é" + y[512:])]
    got = digest(R.remove(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute(docs, 400)


@pytest.mark.parametrize("crowd", [2, 5])
def test_crowded_anchor(spark, monkeypatch, crowd):
    """Many texts share one passage, with all sorts of text around it."""
    monkeypatch.setattr(R, "CROWD", crowd)
    rng = random.Random(crowd)
    say = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    core, before, after = say(20), [say(30) for _ in range(4)], [say(30) for _ in range(4)]
    docs = [(k, say(rng.randrange(8)) + rng.choice(before) + core + rng.choice(after) + say(rng.randrange(8))) for k in range(70)]
    docs += [(100 + k, say(40) + core + say(40)) for k in range(20)]
    assert digest(R.remove(spark.createDataFrame(docs, "doc_id long, text string"), 40, 8)) == brute(docs, 40)


@pytest.mark.parametrize("size", [399, 400, 401])
def test_passage_of_over_50_words(spark, size):
    """A passage in two documents goes if it has 400 bytes, however many words; ``n_bytes`` stays the length of the input."""
    rng = random.Random(size)
    say = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passage = " ".join(say(6) for _ in range(57)) + say(size - 398)
    assert len(passage.split()) > 50 and len(passage) == size
    docs = [(1, "x" + say(80) + "q" + passage + "r"), (2, "y" + passage + "s" + say(200)), (3, " ".join(say(6) for _ in range(80)))]
    got = digest(R.remove(spark.createDataFrame(docs, "doc_id long, text string")))
    assert [r[:3] for r in got] == [(d, len(t), size if size >= 400 and d < 3 else 0) for d, t in docs] and got == brute(docs, 400)


def test_small_batches(spark):
    """Groups of runs that go over many batches."""
    rng = random.Random(9)
    docs = [(k, ("".join(rng.choices("ab", k=50)) if k % 2 else "c" * 60) + "d" * 50) for k in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert digest(R.remove(spark.createDataFrame(docs, "doc_id long, text string"), 40, 8)) == brute(docs, 40)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty(spark):
    assert R.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "a", "abcdefgh", "\x00\x01"])
def test_order_and_prefixes(alphabet):
    rng = random.Random(len(alphabet))
    for length in (1, 7, 8, 19):
        pieces = ["".join(rng.choices(alphabet, k=rng.randrange(length, 90))).encode() for _ in range(30)]
        data, ends = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(p) for p in pieces])
        place = np.array([e - len(p) + k for p, e in zip(pieces, ends.tolist(), strict=True) for k in range(len(p) - length + 1)])
        order = R.suffix_order(data, place, length)
        raw = data.tobytes()
        sorted_ = [raw[p : p + length] for p in place[order].tolist()]
        assert sorted(order.tolist()) == list(range(len(place))) and sorted_ == sorted(sorted_)
        lcp = [next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), length) for a, b in zip(sorted_, sorted_[1:])]
        assert R.common_prefixes(data, place[order], length).tolist() == lcp


@pytest.mark.parametrize("root", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, root):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    got = digest(registry.op5_repeated_bytes(spark, root))
    assert got == brute(docs, 400) and sum(r[2] for r in got) > 10_000


def test_query_and_sql(spark):
    got = same(spark, "op5_repeated_bytes", registry.op5_repeated_bytes, registry.ORACLE["op5_repeated_bytes"])
    assert sum(r["changed"] for r in got) > 50


def test_sql_on_cut_characters(spark, tmp_path):
    """Runs that begin or end within a character, touch, overlap, or are a whole text."""
    shared = "".join(random.Random(4).choices("abcdé€😀 ", k=600))
    raw = shared.encode()
    docs = [(k, None if k == 5 else "" if k == 6 else t) for k, t in enumerate(["é" + shared + "x", "ê" + shared, "😀q" + shared[1:] + "😁", shared[3:500], shared, "", ""])]
    docs += [(50, "a" * 401), (51, shared[:300] + "b" * 399), (52, raw[:450].decode(errors="ignore") + "😁"), (53, raw[:450].decode(errors="ignore") + "😂")]
    docs += [(60 + k, x + "c" * 399) for k, x in enumerate("éèàñ€₤😁😂")]
    spark.createDataFrame(docs, "doc_id long, text string").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    got = same(spark, "op5_repeated_bytes", registry.op5_repeated_bytes, registry.ORACLE["op5_repeated_bytes"], str(tmp_path))
    assert any("\ufffd" in r["text"] for r in got)

"""Encoding against the tiktoken library, decoding against the texts."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})


ENCODER = bpe.Encoder(PATH, P.PATTERN)
ODD = ["", " ", "  a  b\n\n c\t", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "l'été d'où I'll WE'LL", "x" * 5000, "日本語 ١٢٣ ½ \u3000\u00a0\x1c\x1d\x85 z", "<|endoftext|>", "🙂👍🏽 e\u0301", "\x00\x01", "ab" * 999 + "   "]


def test_odd_texts(library):
    for text, ids in zip(ODD, ENCODER.encode(ODD), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert ENCODER.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60) | st.text(alphabet="abet' \n.1é", max_size=200))
def test_any_text(library, text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_forgets_when_full(monkeypatch, library):
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 500)
    small = bpe.Encoder(PATH, P.PATTERN)
    for n in range(20):
        assert np.frombuffer(small.encode([f"word{n} and more"])[0], "<u4").tolist() == library.encode_ordinary(f"word{n} and more")


def test_frames(spark, library):
    docs = spark.createDataFrame([*enumerate(ODD), (None, "a"), (3, None), (3, None)], "doc_id long, text string").withColumn("ids", docs_literal())
    got = bpe.round_trip(docs, PATH, P.PATTERN).collect()
    assert len(got) == len(ODD) + 3
    want = {(d, len(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in [*enumerate(ODD), (None, "a"), (3, None)]}
    assert {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in got} == want
    back = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    assert sorted(bytes(r.text) for r in back.collect()) == sorted((t or "").encode() for t in [*ODD, "a", None, None])
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0


def docs_literal():
    from pyspark.sql import functions as F

    return F.lit("a clashing column")


def test_unknown_id():
    with pytest.raises(ValueError):
        ENCODER.decode(np.array([10**6], "<u4").tobytes())

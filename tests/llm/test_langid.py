"""Forward-backward against enumeration, and accuracy on documents kept from training."""

import itertools
import zlib

import numpy as np
import regex

from lodestone.llm import langid as L
from lodestone.llm import registry

EN, FR = "the cat sat on the mat and then the dog came".split(), "le chat est sur le tapis et puis le chien vient".split()


def model():
    return L.train([("en", EN[k:] + EN[:k]) for k in range(9)] + [("fr", FR[k:] + FR[:k]) for k in range(9)], steps=30)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 5, 3, 5, 2])
    emit, moves, start = rng.normal(size=(16, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    p, expected, _, normaliser = L.marginals(emit, sizes, moves, start)
    want, pairs, total, at = np.zeros_like(p), np.zeros((3, 3)), 0.0, 0
    for n in sizes:
        scores = {}
        for path in itertools.product(range(3), repeat=int(n)):
            scores[path] = np.exp(start[path[0]] + sum(emit[at + k, y] for k, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        z = sum(scores.values())
        total += np.log(z)
        for path, s in scores.items():
            for k, y in enumerate(path):
                want[at + k, y] += s / z
            for a, b in itertools.pairwise(path):
                pairs[a, b] += s / z
        at += n
    assert np.allclose(p, want) and np.allclose(expected, pairs) and np.isclose(total, normaliser)


def one_by_one(m, text):
    """A text's language and score with plain sums over its words' features and a forward-backward of its own, in logarithms."""
    words = regex.findall(r"\p{L}[\p{L}\p{M}'’]*", (text or "").lower())
    if not words:
        return L.UND, 0.0
    whole = (1 << 64) - 1

    def place(tag, part):
        code = tag
        for c in part:
            code = (code * 0x9E3779B97F4A7C15 + ord(c)) & whole
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            code = ((code ^ code >> shift) * factor) & whole
        return (code ^ code >> 31) % L.TABLE

    def emit(w):
        framed = f"^{w}$"
        at = [place(k, framed[i : i + k]) for k in (2, 3) for i in range(len(framed) - k + 1)]
        at += [place(10 + k, w[:k]) for k in (1, 2, 3) if len(w) >= k] + [place(20 + k, w[-k:]) for k in (1, 2, 3) if len(w) >= k]
        at += [zlib.crc32(w.encode()) % L.TABLE] if w in m.lexicon else []
        return m.weights[at].sum(0)

    e = np.array([emit(w) for w in words])
    add = lambda x, axis: np.logaddexp.reduce(x, axis)
    ahead, back = [m.start + e[0]], [np.zeros(len(m.labels))]
    for row in e[1:]:
        ahead.append(add(ahead[-1][:, None] + m.moves, 0) + row)
    for row in e[:0:-1]:
        back.append(add(m.moves + (row + back[-1])[None, :], 1))
    logs = np.array(ahead) + np.array(back[::-1])
    mean = np.exp(logs - add(logs, 1)[:, None]).mean(0)
    return m.labels[int(mean.argmax())], float(mean.max())


def test_predictions_against_one_by_one(spark):
    """The whole prediction, batched and cached, against each document by itself."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, None), (-2, "12 ?!", "en"), (-3, "ǅ İstanbul l’été", None), (-4, "a", None), (-5, "the le der " * 500, None)], docs.schema)
    m = L.fit(docs, steps=8)
    both = docs.unionByName(odd).repartition(3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(both, m).collect()}
    rows = both.collect()
    assert len(got) == len(rows) and len({n for n, _ in got.values()}) == 5
    for r in rows:
        name, score = one_by_one(m, r.text)
        assert got[r.doc_id][0] == name and abs(got[r.doc_id][1] - score) < 1e-4, r.doc_id


def test_ties_go_to_the_label_that_sorts_first():
    m = model()
    m = m._replace(weights=0 * m.weights, moves=0 * m.moves)
    assert L.Tagger(m).predict(["whatever it says"]) == (["en"], [0.5])


def test_edge_texts_and_long_text():
    tagger = L.Tagger(model())
    names, scores = tagger.predict([None, "", "12 ?!", "the dog", "Le CHIEN", "the cat " * 30_000, "ç", "中文"])
    assert names[:3] == [L.UND] * 3 and scores[:3] == [0.0] * 3
    assert names[3:6] == ["en", "fr", "en"] and all(0 <= s <= 1 for s in scores) and names[6] in ("en", "fr")
    assert tagger.predict([]) == ([], [])


def test_forgets_when_full(monkeypatch):
    want = L.Tagger(m := model()).predict(["the dog", "le chat"])
    monkeypatch.setattr(L, "KNOWN_WORDS", 3)
    tagger = L.Tagger(m)
    assert [tagger.predict([t])[0][0] for t in ("the dog", "le chat", "the cat")] == ["en", "fr", "en"]
    assert tagger.predict(["the dog", "le chat"]) == want


def test_frames(spark):
    m = model()
    docs = spark.createDataFrame([(1, "the cat and the dog", "x"), (2, "le chat et le chien", "x"), (None, None, None), (4, "7", None), (4, "7", None)], "doc_id long, text string, score string")
    got = sorted(((r.doc_id, r.lang_pred) for r in L.predict(docs, m).collect()), key=str)
    assert got == [(1, "en"), (2, "fr"), (4, "und"), (4, "und"), (None, "und")]
    assert sorted(r.doc_id for r in L.keep(docs, m).collect()) == [1, 2] and L.keep(docs, m).columns == docs.columns
    assert [r.doc_id for r in L.keep(docs, m, ["fr"]).collect()] == [2]
    assert L.predict(docs.limit(0), m).count() == L.spans(docs.limit(0), m).count() == 0
    both = spark.createDataFrame([(9, " ".join(EN + FR))], "doc_id long, text string")
    got = sorted((r.first_word, r.lang) for r in L.spans(both, m).collect())
    assert [x for _, x in got] == ["en", "fr"] and abs(got[1][0] - len(EN)) <= 1


def test_clean_mixtures_stay(spark):
    """An even mix of two languages and one of three, beside a text whose words no label fits better than another."""
    de = "die katze sitzt auf der matte und dann kommt ein hund".split()
    m = L.train([(x, ws[k:] + ws[:k]) for x, ws in (("en", EN), ("fr", FR), ("de", de)) for k in range(9)], steps=60)
    docs = spark.createDataFrame([(1, " ".join(EN + FR)), (2, " ".join(EN + FR + de)), (3, "12 ?!")], "doc_id long, text string")
    assert max(L.Tagger(m).predict([" ".join(EN + FR + de)])[1]) < 0.5
    assert sorted(r.doc_id for r in L.keep(docs, m, least=0.5).collect()) == [1, 2]
    assert L.keep(docs, m._replace(weights=0 * m.weights, moves=0 * m.moves), least=0.5).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "the cat", None), (2, None, "en")], "doc_id long, text string, lang string")
    m = L.fit(docs)
    assert m.labels == [] and {r.lang_pred for r in L.predict(docs, m).collect()} == {"und"}


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, " ".join(EN * 40), "en") for k in range(30)] + [(99, "le chat", "fr")], "doc_id long, text string, lang string")
    blocks = L.training_blocks(docs.repartition(5), blocks=7)
    assert sorted(x for x, _ in blocks) == ["en"] * 7 + ["fr"] and blocks == L.training_blocks(docs.repartition(2), blocks=7)


def test_held_out_accuracy(spark):
    root = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in registry.op4_language_id(spark, root).collect() if r.held_out]
    assert len(held) > 2000 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.99

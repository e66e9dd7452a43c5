"""Language identification with a linear-chain conditional random field over words.

Every word of a text (a run of letters and the marks and apostrophes within
it) has a language as its label. A word's features are its form if that is in
the lexicon, its prefixes and suffixes of 1 to 3 characters, and its n-grams of
2 and 3 characters within word ends; features are hashed into a table of fixed
size. Weights of features and of transitions between neighbouring words are
learned together from labelled documents by gradient ascent on the conditional
likelihood. Forward-backward gives each word's label probabilities in a whole
text. A document has the label with the greatest mean probability, and that as
its score; the words' labels show where a text switches.

Training reads a bounded sample: of each label about ``DOCUMENTS`` documents by
the hash of their ids, and of these ``BLOCKS`` blocks of ``BLOCK`` neighbouring
words at most, by the smallest hashes, from anywhere in the texts. Half of them are split and joined with halves of other
labels, so that transitions are learned from switches too. Prediction covers all
words of all texts, in one pass without a shuffle.

Defined cases: a null or empty text, or one without letters, is ``und`` with
score 0; without any labelled words, as in an empty table, every text is
``und``; a null label is no label; equal means go to the label that sorts first;
repeated rows get equal results, and a null id is an id like others. ``keep``
carries all columns along, whatever their names; nothing else looks at them.
"""

from __future__ import annotations

import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import worker
from lodestone.llm.textbytes import mix, slices

BLOCK = 24
#: Training blocks for each label, and documents that they are taken from, about.
BLOCKS = 3000
DOCUMENTS = 4000
TABLE = 1 << 18
LEXICON = 20_000
STEPS = 60
UND = "und"
#: Words that a worker remembers before it starts afresh, and the bytes of text that it labels together.
KNOWN_WORDS = 200_000
SLICE = 1 << 20
#: Training blocks of all labels together, which bound what the driver holds; beyond 13 labels each gets fewer.
ALL_BLOCKS = 40_000
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’]*")


class Model(NamedTuple):
    labels: list[str]
    lexicon: frozenset[str]
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # labels x labels
    start: np.ndarray


def features(words: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """The table places of the features of lower-case words, word after word, and where each word's begin."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    start = np.cumsum(sizes + 2) - sizes - 2
    owner = np.repeat(np.arange(len(words)), sizes + 2)
    found, owners = [], []

    def put(tag: int, at: np.ndarray, k: int, own: np.ndarray) -> None:
        code = np.full(len(at), tag, np.uint64)
        for i in range(k):
            code = code * np.uint64(0x9E3779B97F4A7C15) + codes[at + i]
        found.append((mix(code) % np.uint64(TABLE)).astype(np.int64))
        owners.append(own)

    for k in (2, 3):
        at = np.flatnonzero(owner[: 1 - k] == owner[k - 1 :])
        put(k, at, k, owner[at])
    for k in (1, 2, 3):
        own = np.flatnonzero(sizes >= k)
        put(10 + k, start[own] + 1, k, own)
        put(20 + k, start[own] + 1 + sizes[own] - k, k, own)
    known = [k for k, w in enumerate(words) if w in lexicon]
    found.append(np.array([zlib.crc32(words[k].encode()) % TABLE for k in known], np.int64))
    owners.append(np.array(known, np.int64))
    order = np.argsort(np.concatenate(owners), kind="stable")
    counts = np.bincount(np.concatenate(owners), minlength=len(words))
    return np.concatenate(found)[order], np.concatenate([[0], np.cumsum(counts)])


def emissions(model: Model, words: list[str]) -> np.ndarray:
    """The summed feature weights of each word, for each label."""
    flat, first = features(words, model.lexicon)
    return np.add.reduceat(model.weights[flat], first[:-1]) if len(words) else np.zeros((0, len(model.labels)))


def marginals(emit: np.ndarray, sizes: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Label probabilities of every word, by forward-backward over all texts at once.

    ``emit`` holds the texts' words end to end, ``sizes`` their numbers (none 0).
    Texts are taken longest first, so that those with a t-th word are always the
    first ones, and step t is one product for all of them. Also returns the
    expected moves, the order of texts, and the log-likelihood's normaliser.
    """
    order = np.argsort(-sizes, kind="stable")
    length = sizes[order]
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    ends = np.cumsum(alive)
    heads = ends - alive
    # Words lie by step, and within one by text: step t of all texts is one run of rows.
    text = np.repeat(np.arange(len(length)), length)
    step = np.arange(len(emit)) - np.repeat(np.cumsum(length) - length, length)
    place = np.empty(len(emit), np.int64)
    place[heads[step] + text] = np.repeat((np.cumsum(sizes) - sizes)[order], length) + step
    top = emit.max(1, keepdims=True)
    node, edge = np.exp(emit - top)[place], np.exp(moves)
    forward = np.empty_like(node)
    scale, ones = np.empty((len(node), 1)), np.ones((node.shape[1], 1))  # products with ones are the fastest sums of short rows
    state = np.exp(start)[None, :]
    for t, (a, b) in enumerate(zip(heads.tolist(), ends.tolist(), strict=True)):
        state = (state[: b - a] @ edge if t else np.repeat(state, b - a, 0)) * node[a:b]
        np.matmul(state, ones, out=scale[a:b])
        state /= scale[a:b]
        forward[a:b] = state
    expected = np.zeros_like(edge)
    by_step = np.empty_like(node)
    back = np.ones((0, node.shape[1]))
    for t in range(len(alive) - 1, -1, -1):
        a, b = int(heads[t]), int(ends[t])
        if len(back) < b - a:
            back = np.concatenate([back, np.ones((b - a - len(back), node.shape[1]))])
        np.multiply(forward[a:b], back, out=by_step[a:b])
        if t:
            ahead = node[a:b] * back / scale[a:b]
            before = int(heads[t - 1])
            expected += forward[before : before + b - a].T @ ahead * edge
            back = ahead @ edge.T
    by_step /= by_step @ ones
    out = np.empty_like(by_step)
    out[place] = by_step
    return out, expected, order, float(np.log(scale).sum() + top.sum())


def train(blocks: list[tuple[str, list[str]]], steps: int = STEPS, seed: int = 7) -> Model:
    """A model from labelled blocks of lower-case words."""
    rng = np.random.default_rng(seed)
    labels = sorted({label for label, words in blocks if words})
    blocks = [(labels.index(label), words) for label, words in sorted(blocks) if words]
    counts: dict[str, int] = {}
    for _, words in blocks:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    lexicon = frozenset(sorted((w for w, n in counts.items() if n > 1), key=lambda w: (-counts[w], w))[:LEXICON])
    model = Model(labels, lexicon, np.zeros((TABLE, len(labels))), np.zeros((len(labels),) * 2), np.zeros(len(labels)))
    if len(labels) < 2:
        return model
    sequences = [(words, [y] * len(words)) for y, words in blocks]
    mixed = rng.permutation(len(sequences))[: len(sequences) // 2 * 2]
    for a, b in zip(mixed[::2].tolist(), mixed[1::2].tolist(), strict=False):
        (wa, ya), (wb, yb) = sequences[a], sequences[b]
        i, j = len(wa) // 2, len(wb) // 2
        if rng.random() < 0.5:
            sequences[a], sequences[b] = (wa[:i] + wb[j:], ya[:i] + yb[j:]), (wb[:j] + wa[i:], yb[:j] + ya[i:])
    words = sorted(counts)
    place = {w: k for k, w in enumerate(words)}
    flat, first = features(words, lexicon)
    owner = np.repeat(np.arange(len(words)), np.diff(first))
    token = np.array([place[w] for ws, _ in sequences for w in ws])
    truth = np.array([y for _, ys in sequences for y in ys])
    sizes = np.array([len(ws) for ws, _ in sequences])
    heads = np.cumsum(sizes) - sizes
    inner = np.setdiff1d(np.arange(len(token)), heads)
    k, n = len(labels), len(token)
    seen = np.zeros((k, k))
    np.add.at(seen, (truth[inner - 1], truth[inner]), 1)
    used, at = np.unique(flat, return_inverse=True)
    weights, moves = np.zeros((len(used), k)), np.zeros((k, k))
    memory = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, moves)]
    one_hot = np.eye(k)[truth]
    for step in range(1, steps + 1):
        emit = np.add.reduceat(weights[at], first[:-1])[token]
        p, expected, _, _ = marginals(emit, sizes, moves, model.start)
        by_word = [np.bincount(token, rest, len(words)) for rest in np.ascontiguousarray((one_hot - p).T)]
        slope = np.stack([np.bincount(at, x[owner], len(used)) for x in by_word], 1) / n - 1e-6 * weights
        for x, g, (m, v), rate in ((weights, slope, memory[0], 0.3), (moves, (seen - expected) / n, memory[1], 0.2)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights[used] = weights
    return model._replace(moves=moves)


def training_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", blocks: int = BLOCKS) -> list[tuple[str, list[str]]]:
    """At most ``blocks`` blocks of words for each label: those with the smallest hashes of place and text.

    Labels are counted first, which reads their column alone; then only the
    sampled documents' texts are read. What is shuffled and what reaches the
    driver has the documented bounds, whatever the number of rows.
    """
    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).cast("string").alias("id")).filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = labelled.groupBy("lang").count().collect()
    if not rows:
        return []
    blocks = max(1, min(blocks, ALL_BLOCKS // len(rows)))
    shares = [x for r in rows for x in (F.lit(r["lang"]), F.lit(min(1.0, DOCUMENTS / r["count"])))]
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.create_map(*shares)[F.col("lang")] * (1 << 30)
    labelled = labelled.filter(drawn)

    def cut(batches):
        best: dict[str, list[tuple[int, str]]] = {}
        for rows, _, _ in slices(batches, "text"):
            for label, body, own in zip(*(rows.column(c).to_pylist() for c in ("lang", "text", "id")), strict=True):
                words = _WORD.findall(body.lower())
                held = best.setdefault(label, [])
                for b in range(0, len(words), BLOCK):
                    part = " ".join(words[b : b + BLOCK])
                    held.append((zlib.crc32(f"{own}/{b}/{part}".encode()), part))
                if len(held) > 4 * blocks:
                    held.sort()
                    del held[blocks:]
        rows = [(label, h, part) for label, held in best.items() for h, part in sorted(held)[:blocks]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["lang", "hash", "words"])

    ranked = labelled.mapInArrow(cut, "lang string, hash long, words string").distinct().selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY hash, words) AS n").filter(F.col("n") <= blocks)
    return [(r.lang, r.words.split(" ")) for r in ranked.select("lang", "words").collect()]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", blocks: int = BLOCKS, steps: int = STEPS) -> Model:
    """A model from the documents with a label."""
    return train(training_blocks(docs, key, text, lang, blocks), steps)


class Tagger:
    """A model with the words that it has met."""

    def __init__(self, model: Model):
        self.model = model
        self._place: dict[str, int] = {}
        self._emit = np.zeros((1024, len(model.labels)), np.float32)

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of the words of all texts, and each text's number of words."""
        words = [_WORD.findall((t or "").lower()) for t in texts]
        new = list(dict.fromkeys(w for ws in words for w in ws if w not in self._place))
        if len(new) + len(self._place) > KNOWN_WORDS:
            self._place.clear()
            new = list(dict.fromkeys(w for ws in words for w in ws))
        if new:
            held = len(self._place)
            self._place.update(zip(new, range(held, held + len(new)), strict=True))
            if len(self._place) > len(self._emit):
                self._emit = np.concatenate([self._emit[:held], np.zeros((2 * len(self._place) - held, self._emit.shape[1]), np.float32)])
            for k in range(0, len(new), 5000):
                part = new[k : k + 5000]
                self._emit[held + k : held + k + len(part)] = emissions(self.model, part)
        sizes = np.array([len(ws) for ws in words], np.int64)
        token = np.fromiter((self._place[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
        if not len(token):
            return np.zeros((0, len(self.model.labels))), sizes
        return marginals(self._emit[token].astype(np.float64), sizes[sizes > 0], self.model.moves, self.model.start)[0], sizes

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """The language of each text, its mean probability, and the words' own certainty: the mean of their greatest probabilities."""
        if not self.model.labels:
            return [UND] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        p, sizes = self.tag(texts)
        full = np.flatnonzero(sizes)
        mean, sure = np.zeros((len(texts), len(self.model.labels))), np.zeros(len(texts))
        if len(full):
            heads = (np.cumsum(sizes) - sizes)[full]
            mean[full] = np.add.reduceat(p, heads) / sizes[full][:, None]
            sure[full] = np.add.reduceat(p.max(1), heads) / sizes[full]
        best = mean.argmax(1)
        names = [self.model.labels[b] if s else UND for b, s in zip(best.tolist(), sizes.tolist(), strict=True)]
        return names, np.clip(mean[np.arange(len(texts)), best], 0, 1).tolist(), np.clip(sure, 0, 1).tolist()

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and its mean probability."""
        return self.judge(texts)[:2]


def _tagger(docs: DataFrame, model: Model):
    """Broadcasts the model, whose size the constants bound. A worker keeps its tagger from task to task."""
    shared = docs.sparkSession.sparkContext.broadcast(model._replace(weights=model.weights.astype(np.float32)))
    name = uuid.uuid4().hex
    return lambda: worker.keep(name, lambda: Tagger(shared.value))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` for each whole text."""
    narrow, tagger = docs.select(key, text), _tagger(docs, model)

    def run(batches):
        own = tagger()
        for rows, _, _ in slices(batches, text, SLICE):
            names, scores = own.predict(rows.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [key, "lang_pred", "score"])

    return narrow.mapInArrow(run, f"{key} {narrow.schema[key].dataType.simpleString()}, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, accept: list[str] | None = None, least: float = 0.0, text: str = "text") -> DataFrame:
    """The documents, with all their columns, whose language is accepted (any known one if None), and whose words are at least that certain of theirs."""
    tagger = _tagger(docs, model)

    def run(batches):
        own = tagger()
        for rows, _, _ in slices(batches, text, SLICE):
            names, _, sure = own.judge(rows.column(text).to_pylist())
            yield rows.filter(pa.array([(n in accept if accept is not None else n != UND) and s >= least for n, s in zip(names, sure, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang, first_word, n_words``: the runs of words of one language in each text."""
    narrow, tagger = docs.select(key, text), _tagger(docs, model)

    def run(batches):
        own = tagger()
        for rows, _, _ in slices(batches, text, SLICE):
            p, sizes = own.tag(rows.column(text).to_pylist()) if own.model.labels else (None, [])
            out, at = [], 0
            for row, size in enumerate(sizes):
                best = p[at : at + size].argmax(1)
                heads = np.flatnonzero(np.diff(best, prepend=-1))
                out += [(row, own.model.labels[best[h]], int(h), int(e - h)) for h, e in zip(heads, np.append(heads[1:], size), strict=True)]
                at += size
            if out:
                row, lang, head, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([rows.column(key).take(pa.array(row)), pa.array(lang), pa.array(head, pa.int64()), pa.array(n, pa.int64())], [key, "lang", "first_word", "n_words"])

    return narrow.mapInArrow(run, f"{key} {narrow.schema[key].dataType.simpleString()}, lang string, first_word long, n_words long")

"""Toxic spans by a linear-chain conditional random field over the words of a text.

Labels come per document, so the words to learn from are labelled first: in a toxic document, a word is toxic if
chance can't explain how often that word stands in toxic documents of the sample (a binomial tail, over all
words). All others are clean. The field has two states; a word's evidence is the sum of weights of hashed features (the word, its
first three to five and last three and four letters), and four transition weights tie neighbours. It is trained by
full-batch gradient steps on its log-likelihood.

Forward-backward gives each word's marginal probability of being toxic. It runs over all texts of a batch as one chain
cut at text borders, in blocks: products of the blocks' 2x2 matrices, a scan over blocks, then all blocks side by side.
A text's score is a calibrated logistic of its largest marginal and its length; spans are runs of words with a marginal
of at least SPAN, with character offsets.

Fitting uses a bounded sample (MOST clean and toxic rows of at most MAX_CHARS characters, none held out). Scoring
covers whole texts.

Nulls: null and empty texts have no words and get the calibrated score of no evidence. Without rows of both classes every
score is 0. Rows with a null or repeated doc_id are scored like any others; of a repeated doc_id one text is learnt from. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.chunks import Cache
from graphloom.llm.common import held_out, in_arrow, small_batches, texts_of, training_rows

MOST, MAX_CHARS, BITS, STEPS, BLOCK, SPAN, BATCH = (4000, 2000), 10_000, 18, 25, 64, 0.5, 2 << 20
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def feature_ids(word: str) -> list[int]:
    parts = ["w" + word, *(f"{k}{word[:k]}" for k in (3, 4, 5) if len(word) >= k), *(f"-{k}{word[-k:]}" for k in (3, 4) if len(word) >= k)]
    return [0, *(1 + zlib.crc32(p.encode("utf-8", "surrogatepass")) % ((1 << BITS) - 1) for p in parts)]


def marginals(evidence: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each word, and the expected number of each transition (2 x 2).

    `evidence`: the toxic state's score of each word; `first`: whether a word begins a text; `steps`: transition scores.
    """
    n = len(evidence)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    rows = -(-n // BLOCK)
    pad = rows * BLOCK - n
    odds = np.exp(np.clip(np.concatenate([evidence, np.zeros(pad)]), -30, 30)).reshape(rows, BLOCK)
    cut = np.concatenate([first, np.ones(pad, bool)]).reshape(rows, BLOCK)
    m = np.exp(steps)
    # The matrix of a step: m, or ones where a text begins; its second column times the word's odds.
    step = [[np.where(cut, 1.0, m[a, b]) * (odds if b else 1.0) for b in (0, 1)] for a in (0, 1)]
    p = [[np.ones(rows), np.zeros(rows)], [np.zeros(rows), np.ones(rows)]]
    for j in range(BLOCK):
        p = [[p[a][0] * step[0][b][:, j] + p[a][1] * step[1][b][:, j] for b in (0, 1)] for a in (0, 1)]
        big = np.maximum(np.maximum(p[0][0], p[0][1]), np.maximum(p[1][0], p[1][1]))
        p = [[x / big for x in r] for r in p]
    q = [[x.tolist() for x in r] for r in p]
    into, out = np.empty((rows, 2)), np.empty((rows, 2))
    a, b = 0.5, 0.5
    for r in range(rows):
        into[r] = a, b
        a, b = a * q[0][0][r] + b * q[1][0][r], a * q[0][1][r] + b * q[1][1][r]
        s = a + b
        a, b = a / s, b / s
    a, b = 1.0, 1.0
    for r in range(rows - 1, -1, -1):
        out[r] = a, b
        a, b = q[0][0][r] * a + q[0][1][r] * b, q[1][0][r] * a + q[1][1][r] * b
        s = a + b
        a, b = a / s, b / s
    alpha, beta = np.empty((2, rows, BLOCK)), np.empty((2, rows, BLOCK))
    x, y = into[:, 0], into[:, 1]
    for j in range(BLOCK):
        x, y = x * step[0][0][:, j] + y * step[1][0][:, j], x * step[0][1][:, j] + y * step[1][1][:, j]
        s = x + y
        x, y = x / s, y / s
        alpha[0, :, j], alpha[1, :, j] = x, y
    x, y = out[:, 0], out[:, 1]
    for j in range(BLOCK - 1, -1, -1):
        beta[0, :, j], beta[1, :, j] = x, y
        x, y = step[0][0][:, j] * x + step[0][1][:, j] * y, step[1][0][:, j] * x + step[1][1][:, j] * y
        s = x + y
        x, y = x / s, y / s
    both = alpha * beta
    toxic = (both[1] / both.sum(0)).reshape(-1)[:n]
    flat_a, flat_b, flat_o = alpha.reshape(2, -1)[:, :n], beta.reshape(2, -1)[:, :n], odds.reshape(-1)[:n]
    inner = np.flatnonzero(~first[1:]) + 1
    pair = [[flat_a[a, inner - 1] * m[a, b] * (flat_o[inner] if b else 1.0) * flat_b[b, inner] for b in (0, 1)] for a in (0, 1)]
    z = pair[0][0] + pair[0][1] + pair[1][0] + pair[1][1]
    return toxic, np.array([[(pair[a][b] / z).sum() for b in (0, 1)] for a in (0, 1)])


class Model:
    """Feature and transition weights and the calibration; 2^BITS numbers."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray, curve: np.ndarray):
        self.weights, self.steps, self.curve = weights, steps, curve

    def evidence(self, word: str) -> float:
        return float(self.weights[feature_ids(word)].sum())

    def tag(self, texts: list[list[str]], cache: Cache) -> list[np.ndarray]:
        """The marginals of each text's words."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(lengths)
        first = np.zeros(int(lengths.sum()), bool)
        first[(ends - lengths)[lengths > 0]] = True
        known = np.fromiter((x for t in texts for x in map(cache.__getitem__, t)), np.float64, len(first))
        toxic, _ = marginals(known, first, self.steps)
        return np.split(toxic, ends[:-1]) if len(ends) else []

    def score(self, tagged: list[np.ndarray]) -> np.ndarray:
        x = np.array([_told(t) for t in tagged]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -40, 40)))


def _told(toxic: np.ndarray) -> tuple[float, float, float]:
    top = min(max(float(toxic.max()), 1e-6), 1 - 1e-6) if len(toxic) else 1e-6
    return 1.0, math.log(top / (1 - top)), math.log(1 + len(toxic)) / 10


def toxic_words(texts: Iterable[set[str]], y: np.ndarray, chance: float = 0.01) -> set[str]:
    """Words that stand in toxic documents more often than `chance` allows over all words, and hardly in others."""
    bad, all_ = Counter(), Counter()
    for t, v in zip(texts, y):
        all_.update(t)
        if v:
            bad.update(t)
    share, limit = float(np.mean(y)), math.log(chance / max(1, len(all_)))

    def tail(k: int, n: int) -> float:
        """Log of a bound on P(at least k of n): Chernoff's."""
        p = k / n
        return -n * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0))

    return {w for w, k in bad.items() if k > 0.8 * all_[w] and k > share * all_[w] and tail(k, all_[w]) < limit}


def train(texts: list[list[str]], labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that maximise the penalised likelihood of the labelled words."""
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for t in texts for w in t], dtype=np.int64)
    y = np.concatenate(labels).astype(float) if labels else np.zeros(0)
    lengths = np.array([len(t) for t in texts])
    first = np.zeros(len(ids), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    feats = [feature_ids(w) for w in index]
    cols = np.array([i for f in feats for i in f], dtype=np.int64)
    rows = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    w, steps = np.zeros(1 << BITS), np.zeros((2, 2))
    w[0] = -3.0
    inner = np.flatnonzero(~first[1:]) + 1
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    size, was = [np.full(w.shape, 0.5), np.full((2, 2), 0.1)], [np.zeros(w.shape), np.zeros((2, 2))]
    for _ in range(STEPS):
        evidence = np.bincount(rows, w[cols], len(feats))[ids]
        toxic, pairs = marginals(evidence, first, steps)
        g = np.bincount(cols, np.bincount(ids, y - toxic, len(feats))[rows], len(w)) - 0.05 * w
        for k, (x, grad) in enumerate(((w, g), (steps, seen - pairs - 0.05 * steps))):  # steps by sign, sized by how it changes
            turn = np.sign(grad) * was[k]
            size[k] = np.clip(size[k] * np.where(turn > 0, 1.3, np.where(turn < 0, 0.5, 1.0)), 1e-4, 2.0)
            was[k] = np.where(turn < 0, 0, np.sign(grad))
            x += size[k] * was[k]
    return w, steps


def fit_rows(texts: list[str], y: np.ndarray) -> Model:
    none = Model(np.zeros(1 << BITS), np.zeros((2, 2)), np.array([-40.0, 0, 0]))
    if not len(y) or y.min() == y.max():
        return none
    one: dict[str, str] = {}  # a word is held once, however often it stands in the sample
    split = [[one.setdefault(w, w) for w in words(t)] for t in texts]
    learn = np.arange(len(y)) % 4 != 3
    known = toxic_words((set(t) for t, k in zip(split, learn) if k), y[learn])
    mine = [t for t, k in zip(split, learn) if k]
    marks = [np.array([v and w in known for w in t], bool) for t, v in zip(mine, y[learn])]
    weights, steps = train(mine, marks)
    model = Model(weights, steps, np.zeros(3))
    tagged = model.tag(split, Cache(model.evidence))
    x, curve = np.array([_told(t) for t in tagged]), np.zeros(3)
    part = ~learn if 5 <= y[~learn].sum() < (~learn).sum() else np.ones(len(y), bool)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x[part] @ curve, -40, 40)))
        h = (x[part] * (p * (1 - p))[:, None]).T @ x[part] + 0.1 * np.eye(3)
        curve -= np.linalg.solve(h, x[part].T @ (p - y[part]) + 0.1 * curve)
    model.curve = curve
    return model


def fit(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = MOST, max_chars: int = MAX_CHARS) -> Model:
    rows = training_rows(docs, labels, "toxic", most, max_chars)
    return fit_rows([r.text for r in rows], np.array([r.y for r in rows], dtype=float))


def spans_of(text: str, toxic: np.ndarray, least: float = SPAN) -> list[tuple[int, int]]:
    """Character offsets (begin, end) in `text` of runs of words with a marginal of at least `least`."""
    out: list[tuple[int, int]] = []
    low, before = text.lower(), -2
    for k, m in enumerate(WORD.finditer(low)):
        if toxic[k] >= least:
            if before == k - 1:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append((m.start(), m.end()))
            before = k
    if len(low) != len(text):  # a few letters have lower cases of two characters
        whose = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
        out = [(int(whose[a]), int(whose[b - 1]) + 1) for a, b in out]
    return out


def _scored(model: Model, texts: list[str], cache: Cache) -> tuple[np.ndarray, list[np.ndarray]]:
    tagged = model.tag([words(t) for t in texts], cache)
    return model.score(tagged), tagged


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` without its text, with `score` and `spans`, an array of (begin, end)."""
    kept = [c for c in docs.columns if c not in ("text", "score", "spans")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "score double, spans array<struct<begin:int,end:int>>"])
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cache = Cache(own.evidence, 120_000)
        for batch in small_batches(batches, len(kept), BATCH):
            texts = texts_of(batch, len(kept))
            scores, tagged = _scored(own, texts, cache)
            spans = [[{"begin": a, "end": b} for a, b in spans_of(t, p)] if len(p) and p.max() >= SPAN else [] for t, p in zip(texts, tagged)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(scores), pa.array(spans, kind)], names=[*kept, "score", "spans"])

    return in_arrow(docs.select(*kept, "text"), run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every row."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` with a score below `threshold`, with the same columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(shared.value.evidence, 120_000)
        for batch in small_batches(batches, at, BATCH):
            yield batch.filter(pa.array(_scored(shared.value, texts_of(batch, at), cache)[0] < threshold))

    return in_arrow(docs, run, docs.schema)

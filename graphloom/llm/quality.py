"""Quality by compression: zstandard dictionaries built from good and from bad labelled text.

Either side has SIDES dictionaries (fewer where it has under TEXTS texts for each). Its texts are dealt to them, a dictionary is trained on those dealt to it, and each text goes to the
one that compresses it best, ROUNDS times over: so they come to stand for kinds of text, such as languages. A text's size on a
side is the least that one of its dictionaries compresses it to; the difference of the two sizes, divided by their sum, says which
side it resembles. A logistic curve of that difference and nothing else, fitted on labelled rows that the dictionaries have not seen,
makes it the score; rows of a class weigh as many as the labels have of it, so that the score is a probability there.

Fitting uses a bounded sample: PER_CLASS rows of each class of at most MAX_CHARS characters, none held out. By a hash
of their texts, half of them make the dictionaries, half fit the curve. A dictionary has DICTIONARY bytes and is trained on
whole texts; where too few are dealt to it, it is made of equal shares from the middles of its texts. Scoring
compresses whole texts of any length in pieces of PIECE bytes, of which the sizes add up.

Nulls: null and empty texts have difference zero and get the curve's value there. Without rows of both classes
the score is 0.5 for every text. Rows with a null or repeated doc_id are scored like any others; of a repeated doc_id one text is
learnt from. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import held_out, in_arrow, rows_of, small_batches, training_rows

PER_CLASS, MAX_CHARS, DICTIONARY, SIDES, TEXTS, ROUNDS, LEVEL, PIECE, SEED = 3000, 10_000, 16_000, 6, 30, 4, 3, 1 << 17, 42


class Model:
    """Dictionaries of the good and the bad side and a fitted curve; a few hundred kilobytes."""

    def __init__(self, good: list[bytes], bad: list[bytes], weights: np.ndarray):
        self.good, self.bad, self.weights = good, bad, weights

    def sides(self) -> tuple[list[zstandard.ZstdCompressor], list[zstandard.ZstdCompressor]]:
        return [_compressor(d) for d in self.good], [_compressor(d) for d in self.bad]

    def score(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_terms(differences) @ self.weights, -30, 30)))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(dictionary)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False)


def _size(text: bytes, by: zstandard.ZstdCompressor) -> int:
    return sum(len(by.compress(text[at : at + PIECE])) for at in range(0, len(text), PIECE))


def differences(texts: list[bytes], sides: tuple[list[zstandard.ZstdCompressor], list[zstandard.ZstdCompressor]]) -> np.ndarray:
    """For each text (least size on the bad side - least size on the good side) / their sum; 0 for an empty one."""
    out = np.zeros(len(texts))
    for k, text in enumerate(texts):
        if text and sides[0]:
            good, bad = (min(_size(text, c) for c in side) for side in sides)
            out[k] = (bad - good) / (bad + good)
    return out


def _terms(differences: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(differences)), 10 * differences], 1)


def _trained(texts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, texts).as_bytes() if len(texts) > 20 else _dictionary(texts, DICTIONARY)
    except zstandard.ZstdError:  # too little text
        return _dictionary(texts, DICTIONARY)


def build(texts: list[bytes], sides: int = SIDES, rounds: int = ROUNDS) -> list[bytes]:
    """The dictionaries of one side."""
    sides = max(1, min(sides, len(texts) // TEXTS))
    parts = [texts[k::sides] for k in range(sides)]
    made = [_trained(p) for p in parts]
    for _ in range(rounds):
        by = [_compressor(d) for d in made]
        best = np.argmin([[_size(t, c) for c in by] for t in texts], axis=1)
        made = [_trained(p) for p in ([t for t, b in zip(texts, best) if b == k] for k in range(len(made))) if p]
    return made


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """The middle of every text, `size` bytes in all, as the raw content of a dictionary; what short texts leave goes to longer ones."""
    parts, left = [b""] * len(texts), size
    for done, k in enumerate(sorted(range(len(texts)), key=lambda k: len(texts[k]))):
        t, each = texts[k], max(0, left // (len(texts) - done) - 1)
        at = max(0, len(t) - each) // 2
        parts[k] = t[at : at + each]
        left -= len(parts[k]) + 1
    return b"\n".join(parts)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def good_share(labels: DataFrame) -> float:
    """The share of good ones among all labels that may be learnt from."""
    return labels.filter(F.col("quality").isin(0, 1) & ~held_out()).agg(F.avg("quality")).first()[0]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    rows = training_rows(docs, labels, "quality", (per_class, per_class), max_chars)
    rows.sort(key=lambda r: xxhash.xxh64_intdigest(r.text.encode(), SEED))  # the halves below don't follow doc_id
    split = [[r.text.encode() for r in rows if r.y == side and r.text] for side in (1, 0)]
    if not all(split):
        return Model([], [], np.zeros(2))
    model = Model(*(build(t[: (len(t) + 1) // 2]) for t in split), np.zeros(2))
    rest = [t[(len(t) + 1) // 2 :] or t for t in split]
    x = differences(rest[0] + rest[1], model.sides())
    y = np.array([1.0] * len(rest[0]) + [0.0] * len(rest[1]))
    share = good_share(labels)
    model.weights = _logistic(_terms(x), y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    return model


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` without its text, with column `name` from 0 to 1."""
    kept = [c for c in docs.columns if c not in ("text", name)]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), f"`{name}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = model.sides()
        for batch in small_batches(batches, len(kept), 1 << 20):
            s = model.score(differences(rows_of(batch, len(kept)), sides))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(s)], names=[*kept, name])

    return in_arrow(docs.select(*kept, "text"), run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` with a score of at least `threshold`, with the same columns."""
    model = fit(docs, labels)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = model.sides()
        for batch in small_batches(batches, at, 1 << 20):
            yield batch.filter(pa.array(model.score(differences(rows_of(batch, at), sides)) >= threshold))

    return in_arrow(docs, run, docs.schema)

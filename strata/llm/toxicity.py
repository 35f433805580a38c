"""Toxicity by a convolutional text classifier, trained in numpy.

Words and their first letters are hashed into an embedding table, where a word's vector is the sum of
its rows; filters of several widths run over the words, each filter's maximum over the whole text is
a feature, and a logistic layer scores the features. Training starts from random weights. Words are
dropped at random from what it sees, so that a filter can't rest on one word of a text, and rows of the
table move by plain gradients, so that words which many toxic texts share outweigh rare ones. The
score is shifted so that 0.7 is the threshold that serves held-back training rows best; a threshold
for each language is found in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.words import Words, bytes_of, mixed, portions, released

BUCKETS, WIDTH_EMBEDDING, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 32
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 20_000  # labelled rows that training reads at most, and their longest text
STEPS, BATCH, TOXIC_SHARE = 700, 64, 0.3  # of each batch
DROPPED, CROP = 0.4, 400  # the share of words that a step leaves out, and the words of a long text that it sees
RATE, TABLE_RATE, DECAY = 0.02, 5.0, 1e-5
THRESHOLD = 0.7
PAD = 3
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


STEMS = (4, 5)  # leading bytes of a word that have rows of their own, since insults inflect


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table for the words of all texts, PAD rows of zeros after each text, and where each text begins, the end last."""
    data, offsets = bytes_of(texts)
    words = Words(PLAIN[data], offsets, lower=True)
    counts = np.diff(words.first)
    begins = np.concatenate(([0], np.cumsum(counts + PAD)))
    out = np.zeros((begins[-1], 1 + len(STEMS)), np.int32)
    where = np.arange(len(words.starts)) + np.repeat(np.arange(len(counts)) * PAD, counts)
    out[where, 0] = (words.hashes(21) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    stem, last = np.zeros(len(where), np.uint64), len(words.data) - 1
    for j in range(max(STEMS)):
        letter = np.where(words.starts + j < words.ends, words.data[np.minimum(words.starts + j, last)], 0) if len(where) else stem
        stem = stem << np.uint64(8) | letter.astype(np.uint64)
        if j + 1 in STEMS:
            out[where, 1 + STEMS.index(j + 1)] = (mixed(stem) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    return out, begins


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, embedding, filters)
    bias: list[np.ndarray]
    out: np.ndarray
    base: float = 0.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        total = self.embedding[ids[..., 0]]
        for j in range(1, ids.shape[-1]):
            total += self.embedding[ids[..., j]]
        return total

    def activations(self, ids: np.ndarray) -> np.ndarray:
        """(positions, all filters): each filter at each word, 0 at pads."""
        vectors = self.vectors(ids)
        parts = []
        for filters, bias in zip(self.filters, self.bias, strict=True):
            total = vectors @ filters[0]
            for j in range(1, len(filters)):
                total[:-j] += vectors[j:] @ filters[j]
            parts.append(total + bias)
        found = np.maximum(np.concatenate(parts, axis=1), 0)
        found[ids[:, 0] == 0] = 0
        return found

    def logits(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        features = np.maximum.reduceat(self.activations(ids), begins[:-1], axis=0)
        return features @ self.out + self.base

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*tokens(texts)) + self.shift, -40, 40).astype(np.float64)))


def fit(texts: list[str], labels: np.ndarray, languages: list[str | None], seed: int = 5) -> Model:
    """A model of the labelled texts; a fifth of them are held back to set the thresholds."""
    rng = np.random.default_rng(seed)
    model = started(rng)
    if not len(labels) or labels.min() == labels.max():
        model.out[:] = 0
        model.base = 4.0 if len(labels) and labels[0] else -4.0
        return model
    order = rng.permutation(len(texts))
    back, train = order[: len(order) // 5], order[len(order) // 5 :]
    toxic, clean = (train[labels[train] == y] if (labels[train] == y).any() else np.flatnonzero(labels == y) for y in (1, 0))
    ids, begins = tokens(pa.array(texts, pa.string()))
    model.base = float(np.log(TOXIC_SHARE / (1 - TOXIC_SHARE)))
    squares: list = [1e-6] * (2 * len(WIDTHS) + 1)
    for step in range(STEPS):
        fade = 1 - step / STEPS
        part = np.concatenate([rng.choice(toxic, int(BATCH * TOXIC_SHARE)), rng.choice(clean, BATCH - int(BATCH * TOXIC_SHARE))])
        pieces = [_crop(ids[begins[i] : begins[i + 1]], rng) for i in part]
        own = np.concatenate(pieces)
        own[rng.random(len(own)) < DROPPED] = 0
        (rows, table), slopes, base = gradients(model, own, np.cumsum([0, *map(len, pieces)]), labels[part])
        model.embedding[rows] -= TABLE_RATE * fade * table
        model.embedding *= 1 - DECAY
        model.embedding[0] = 0
        for k, (w, g) in enumerate(zip([*model.filters, *model.bias, model.out], slopes, strict=True)):
            squares[k] = squares[k] + g**2
            w -= RATE * fade * g / np.sqrt(squares[k])
        model.base -= RATE * fade * base
    logits = np.array([model.logits(ids[begins[i] : begins[i + 1]], np.array([0, begins[i + 1] - begins[i]]))[0] for i in back])
    model.shift = float(np.log(THRESHOLD / (1 - THRESHOLD))) - _threshold(logits, labels[back])
    spoken = np.array([languages[i] or "" for i in back])
    for name in sorted(set(spoken.tolist())):
        of = spoken == name
        if labels[back][of].sum() >= 10:
            model.thresholds[name] = max(0.5, float(1 / (1 + np.exp(-(_threshold(logits[of], labels[back][of]) + model.shift)))))
    return model


def started(rng: np.random.Generator) -> Model:
    n = WIDTH_EMBEDDING
    model = Model(
        rng.normal(0, 0.1, (BUCKETS, n)).astype(np.float32),
        [rng.normal(0, 0.3 / np.sqrt(w), (w, n, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
    )
    model.embedding[0] = 0
    return model


def _crop(ids: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The words of a text, or CROP of them from a drawn place on; with pads after them."""
    spare = len(ids) - PAD - CROP
    at = int(rng.integers(0, spare + 1)) if spare > 0 else 0
    out = ids[at : at + CROP + PAD].copy()
    out[-PAD:] = 0
    return out


def gradients(model: Model, ids: np.ndarray, begins: np.ndarray, labels: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], list[np.ndarray], float]:
    """Of the mean log loss of texts: rows of the table and their gradients; those of filters, biases and the last layer; that of base."""
    found = model.activations(ids)
    best = np.stack([a + found[a:b].argmax(0) for a, b in zip(begins[:-1], begins[1:], strict=True)])
    features = np.take_along_axis(found, best, 0)
    miss = (1 / (1 + np.exp(-np.clip(features @ model.out + model.base, -30, 30))) - labels) / len(labels)
    down = np.where(features > 0, miss[:, None] * model.out, 0).astype(model.out.dtype)
    rows, pushes, slopes = [], [], []
    width = model.out.size // len(model.filters)
    for k, filters in enumerate(model.filters):
        at, push = (x[:, k * width : (k + 1) * width] for x in (best, down))
        slope = np.empty_like(filters)
        for j in range(len(filters)):
            token = ids[np.minimum(at + j, len(ids) - 1)]
            slope[j] = np.einsum("df,dfe->ef", push, model.vectors(token))
            back = (push[:, :, None] * filters[j].T).reshape(-1, filters.shape[1])
            for column in range(token.shape[-1]):
                rows.append(token[..., column].ravel())
                pushes.append(back)
        slopes.append(slope)
    slopes += [down[:, k * width : (k + 1) * width].sum(0) for k in range(len(model.filters))]
    row, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    table = np.zeros((len(row), model.embedding.shape[1]), model.embedding.dtype)
    np.add.at(table, inverse, np.concatenate(pushes))
    return (row, table), [*slopes, (features.T @ miss).astype(model.out.dtype)], float(miss.sum())


def _threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit, amid the gap between two rows, from which on calling rows toxic gives the best F0.5; 0 if few rows are toxic."""
    if labels.sum() < 10:
        return 0.0
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    worth = 1.25 * hits / (np.arange(1, len(order) + 1) + 0.25 * labels.sum())  # wrong rejections weigh more
    at = int(worth.argmax())
    low = logits[order[at + 1]] if at + 1 < len(order) else logits[order[at]] - 2
    return max(-0.5, float((logits[order[at]] + low) / 2))  # never rejects what the model itself thinks fine


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """A model of at most rows labelled texts of at most chars, those of the smallest hash of their id.

    Rows whose crc32(doc_id) mod 3 is 1 are never read. Only the text and, for thresholds, the
    language are used. Of rows that repeat an id one is read, the one of the smallest text hash; where labels repeat an
    id, any toxic one counts. Null ids, null labels and null texts are left out; without any row, or with rows
    of one label alone, the model gives every text the same score.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text", "lang").join(F.broadcast(known), "doc_id").where(F.length("text") <= chars)
    one = F.min_by(F.struct("text", "lang", "toxic"), F.struct(F.xxhash64("text"), "text")).alias("row")
    found = sorted(sample.groupBy("doc_id").agg(one).collect(), key=lambda r: r["doc_id"])  # at most rows
    return fit([r["row"]["text"] for r in found], np.array([int(r["row"]["toxic"] > 0) for r in found]), [r["row"]["lang"] for r in found])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(doc_id, score, rejected), a row for each row of docs; score in 0..1 from the whole text alone.

    rejected: the score reaches its language's threshold, or THRESHOLD where the language has none.
    Nulls and texts without words get the score of no features. Rows are scored one by one, so null and repeated
    ids are carried through, and an empty table gives an empty result. Columns besides these three aren't read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        with released():
            for whole in batches:
                for batch in portions(whole, 1, 1 << 18):
                    scores = model.scores(batch.column(1))
                    limits = np.array([model.thresholds.get(x or "", THRESHOLD) for x in batch.column(2).to_pylist()])
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(scores >= limits)], ["doc_id", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col), F.col(text_col).cast("string"), lang).mapInArrow(score, f"doc_id {kind}, score double, rejected boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that the model rejects, in docs' own columns; rows are judged one by one."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at, lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        with released():
            for whole in batches:
                for batch in portions(whole, at, 1 << 18):
                    limits = np.array([model.thresholds.get(x or "", THRESHOLD) for x in batch.column(lang).to_pylist()])
                    yield batch.filter(pa.array(model.scores(batch.column(at)) < limits))

    return docs.mapInArrow(keep, docs.schema)

"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Every coordinate has a learning rate of its own that falls with the gradients it has seen, and L1 leaves exact zeros
wherever words say nothing; so the fitted weights are a short list of hash bins, broadcast with the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.samples import sample_labels
from docloom.llm.textblocks import Words, blocks, mix64

#: Hash bins of the features.
BITS = 20
#: Labelled rows that the model is fitted on, at most about, of each label.
TRAIN_ROWS = {0: 4000, 1: 2000}
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 10.0, 1.0, 4
#: Documents of the sample that must have a feature before it is included, and folds for placing the cut.
LEAST_SEEN, FOLDS = 3, 3
#: Scores from here on count as toxic.
THRESHOLD = 0.7

#: ASCII characters other than letters and digits separate words here, so that punctuation makes no new words.
APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Document and bin of each word, each pair of successive words and each pair with one word between."""
    h, n = words.hash, len(words.hash)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    rows, bins = [doc], [h]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if n > gap:
            same = doc[gap:] == doc[:-gap]
            rows.append(doc[gap:][same])
            bins.append(mix64(h[:-gap][same] * np.uint64(salt) + h[gap:][same]))
    return np.concatenate(rows), (np.concatenate(bins) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Model:
    """Non-zero weights by ascending bin, and the bias; the score is the logistic function of their sum."""

    bins: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.bins] = self.weights
        return out


def ftrl(examples: list[tuple[np.ndarray, int]], seed: int = 3) -> Model:
    """FTRL-proximal over examples (distinct bins, label), each seen EPOCHS times in seeded orders."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    rng = np.random.default_rng(seed)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0.0
        return w

    def bias() -> float:
        return -zb / ((BETA + math.sqrt(nb)) / ALPHA)

    for _ in range(EPOCHS):
        for at in rng.permutation(len(examples)):
            i, y = examples[at]
            w, b = weights(i), bias()
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum() + b))))
            g = p - y
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / ALPHA * b
            nb += g * g
    every = np.flatnonzero(np.abs(z) > L1)
    return Model(every.astype(np.int32), weights(every).astype(np.float32), bias())


def fitted(examples: list[tuple[np.ndarray, int]], shares: dict[int, float]) -> Model:
    """A model of all examples, with the bias moved so that THRESHOLD is the cut with the best F1 over the sample,
    each label at its true share, by margins from models that had not seen the document."""
    seen = np.bincount(np.concatenate([i for i, _ in examples]), minlength=1 << BITS) >= LEAST_SEEN
    examples = [(i[seen[i]], y) for i, y in examples]
    model, margin = ftrl(examples), np.zeros(len(examples))
    for fold in range(FOLDS):
        part = ftrl([x for at, x in enumerate(examples) if at % FOLDS != fold])
        table = part.table()
        for at in range(fold, len(examples), FOLDS):
            margin[at] = float(table[examples[at][0]].sum()) + part.bias
    label = np.array([y for _, y in examples])
    weight = np.array([shares[y] for y in label])
    order = np.argsort(-margin, kind="stable")
    hit, all_ = np.cumsum((weight * (label == 1))[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (weight * (label == 1)).sum())
    best = int(np.argmax(f1))
    low = margin[order[min(best + 1, len(order) - 1)]]
    cut = (margin[order[best]] + low) / 2
    return Model(model.bins, model.weights, float(model.bias - cut + math.log(THRESHOLD / (1 - THRESHOLD))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model fitted on a bounded sample of ``labels`` (doc_id, label 0 or 1); None if a label has no document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column(1)):
                row, bins = _features(Words(texts, APART))
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(len(texts) + 1))
                parts = [np.unique(bins[order[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(parts, pa.list_(pa.int32())), batch.column(2).slice(first, len(texts))], ["doc_id", "bins", "label"])

    chosen = F.broadcast(sample_labels(labels, TRAIN_ROWS))  # TRAIN_ROWS bounds it
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, "doc_id")
    rows = text.mapInArrow(run, "doc_id long, bins array<int>, label int").toArrow().sort_by("doc_id")
    examples = [(b.values.to_numpy(), y.as_py()) for b, y in zip(rows["bins"], rows["label"], strict=True)]
    seen = {y: sum(label == y for _, label in examples) for y in (0, 1)}
    if not all(seen.values()):
        return None
    total = {r["label"]: r["count"] for r in labels.where("label in (0, 1)").groupBy("label").count().collect()}
    return fitted(examples, {y: total[y] / seen[y] for y in (0, 1)})


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row: 0 to 1, from the distinct features of the whole text.

    A null or empty text has no features, so its score is the bias's.  Without a model every score is 0.  Repeated
    rows give equal rows; other columns are ignored; an empty table gives an empty result.
    """
    if model is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 8 bytes for each of 2**BITS bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value.table(), sent.value.bias
        for batch in batches:
            for first, texts in blocks(batch.column(1)):
                row, bins = _features(Words(texts, APART))
                w = weights[bins]
                hit = np.flatnonzero(w)
                pairs, at = np.unique(row[hit].astype(np.int64) << BITS | bins[hit], return_index=True)
                margin = bias + np.bincount(pairs >> BITS, w[hit][at], len(texts))
                out = 1 / (1 + np.exp(-np.clip(margin, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(out)], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")

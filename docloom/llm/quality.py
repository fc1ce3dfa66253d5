"""Quality by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text.  Of each preference pair the probability that the
better document wins is the logistic function of the difference of strengths, fitted by Newton steps on feature
differences.  The cut between good and poor is a quantile of the strengths: the share of poor documents among the
labelled ones.

Every labelled document takes part.  Their features are kept in blocks, in which the pairs are drawn; a pass over the
blocks sums what a Newton step, a mean or a quantile needs, so the driver holds sums only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.samples import clean_labels
from docloom.llm.textblocks import LOWER, SPACE, Words, blocks
from docloom.sources.tables import BROADCAST_BYTES, cut_lineage, forget

#: Better documents met by each poor one.
RIVALS = 8
#: Labelled documents of a block, about; of the rarer label a block has so many at least, about, or all there are.
BLOCK_ROWS, LEAST_ROWS = 4096, 64
#: Pairs in a matrix at once; tasks of a pass, at most, each of which sends one sum to the driver.
PAIRS, TASKS = 8192, 64
#: Quantile steps of a feature, whose indicators let a strength bend.
STEPS = 8
#: The score of a document at the cut.
THRESHOLD = 0.3

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "space": (32,), "line": (10,),
    "stop": b".?", "comma": b",;", "bang": b"!", "bar": b"|", "symbol": b"#$%&*+<=>@^_`{}~\\", "quote": b"\"'()[]", "slash": b"/:-",
}
_OF_CLASS = np.zeros((len(_CLASSES), 256), bool)
for _i, _chars in enumerate(_CLASSES.values()):
    _OF_CLASS[_i, list(_chars)] = True
_END = np.zeros(256, bool)
_END[list(b"!|#$%&*+<=>@^_~")] = True


def features(texts: list[bytes]) -> np.ndarray:
    """One row of numbers per text: character shares, word and line statistics, repetition, length."""
    out = []
    words = Words(texts, SPACE, LOWER)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    limits = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    counts = np.stack([np.add.reduceat(row[raw], limits[:-1], dtype=np.int64) for row in _OF_CLASS])
    width = (words.end - words.start).astype(float)
    ends = _END[words.data[words.end - 1]] if len(words.end) else np.zeros(0, bool)
    for i, text in enumerate(texts):
        a, b = words.first[i], words.first[i + 1]
        n, size = int(b - a), len(text)
        own, c = width[a:b], counts[:, i] - (np.arange(len(_CLASSES)) == list(_CLASSES).index("line"))
        if not n:
            out.append([0.0] * (len(_CLASSES) + 13))
            continue
        distinct, times = np.unique(words.hash[a:b], return_counts=True)
        lines = [x for x in text.split(b"\n") if x.strip()]
        pairs = words.hash[a : b - 1] * np.uint64(3) + words.hash[a + 1 : b]
        letters = c[0] + c[1] + c[3]
        out.append(
            [
                *(c / size), math.log1p(n), math.log1p(size), own.mean(), own.std(), (own <= 3).mean(), (own > 14).mean(), len(distinct) / n, times.max() / n,
                1 - len(np.unique(pairs)) / max(1, n - 1), 1 - len(set(lines)) / len(lines), c[0] / max(1, letters), ends[a:b].mean(), len(lines) / n,
            ]
        )
    return np.array(out)


@dataclass
class Model:
    """Steps of each feature, scales, and the weights of scaled features and step indicators; ``cut`` is the quantile."""

    mean: np.ndarray
    scale: np.ndarray
    steps: np.ndarray
    weights: np.ndarray
    cut: float = 0.0

    def expand(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.scale, -5, 5)
        beyond = (x[:, :, None] > self.steps[None]).reshape(len(x), -1)
        return np.concatenate([scaled, beyond], axis=1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.strength(x) - self.cut + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, features, labels and marks of first copies of each block, whose rows follow one another."""

    def whole(parts: list[pa.RecordBatch]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(parts)
        x = np.frombuffer(b"".join(rows["x"].to_pylist())).reshape(rows.num_rows, -1)
        return rows["block"][0].as_py(), x, rows["label"].to_numpy(), rows["copy"].to_numpy() == 0

    held: list[pa.RecordBatch] = []
    for batch in batches:
        number = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and a < b and held[0].column("block")[0].as_py() != number[a]:
                yield whole(held)
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield whole(held)


def _total(rows: DataFrame, part: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` (an array of floats) over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((part(*block) for block in _blocks_of(batches)), np.zeros(()))
        if total.shape:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["sum"])

    return sum(np.frombuffer(r["sum"]) for r in rows.coalesce(TASKS).mapInArrow(run, "sum binary").collect())


def order_statistics(rows: DataFrame, values: Callable[[np.ndarray], np.ndarray], ranks: np.ndarray) -> np.ndarray:
    """The exact values with these ranks (from 0; a row of them for each column of ``values``) over all documents.

    Floats are taken as whole numbers in the same order, of which each pass finds the next byte by counting.
    """
    top, found, left = np.uint64(1 << 63), np.zeros(ranks.shape, np.uint64), ranks.astype(np.int64)
    for shift in map(np.uint64, range(56, -8, -8)):

        def part(block: int, x: np.ndarray, y: np.ndarray, own: np.ndarray) -> np.ndarray:
            bits = np.ascontiguousarray(values(x[own]) + 0.0).view(np.uint64)
            bits = np.where(bits & top, ~bits, bits | top)
            out = np.zeros((*ranks.shape, 256))
            for i, column in enumerate(bits.T):
                for start in np.unique(found[i]):
                    beyond = (column ^ start) >> shift  # below 256 where all bytes found so far agree
                    out[i, found[i] == start] = np.bincount(beyond[beyond < 256].astype(np.int64), minlength=256)
            return out.ravel()

        upto = _total(rows, part).reshape(*ranks.shape, 256).cumsum(2)
        byte = (upto <= left[..., None]).sum(2, keepdims=True)
        left = left - np.where(byte > 0, np.take_along_axis(upto, np.maximum(byte - 1, 0), 2), 0)[..., 0].astype(np.int64)
        found = found | byte[..., 0].astype(np.uint64) << shift
    return np.where(found & top, found ^ top, ~found).view(np.float64)


def pairs(y: np.ndarray, block: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Winners and losers of a block: each poor document meets RIVALS better ones, and a better one that none has met a poor one."""
    good, bad, rng = np.flatnonzero(y == 1), np.flatnonzero(y == 0), np.random.default_rng(seed + block)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    wins = rng.choice(good, len(bad) * RIVALS)
    unmet = np.setdiff1d(good, wins)
    return np.concatenate([wins, unmet]), np.concatenate([np.repeat(bad, RIVALS), rng.choice(bad, len(unmet))])


def fit(rows: DataFrame, count: dict[int, int]) -> Model:
    """A model from all rows (block, label, copy, x), of which ``count`` of each label are first copies."""
    n = count[0] + count[1]
    mean = _total(rows, lambda block, x, y, own: x[own].sum(0)) / n
    scale = np.sqrt(_total(rows, lambda block, x, y, own: ((x[own] - mean) ** 2).sum(0)) / n) + 1e-9
    at = np.arange(1, STEPS) / STEPS * (n - 1)
    low = np.floor(at).astype(np.int64)
    ranks = np.concatenate([low, np.minimum(low + 1, n - 1)])
    below, above = np.split(order_statistics(rows, lambda x: x, np.tile(ranks, (len(mean), 1))), 2, axis=1)
    model = Model(mean, scale, below + (above - below) * (at - low), np.zeros(0))
    size = model.expand(mean[None]).shape[1]
    w = np.zeros(size)
    for _ in range(12):  # Newton steps with a ridge

        def part(block: int, x: np.ndarray, y: np.ndarray, own: np.ndarray) -> np.ndarray:
            full, (better, worse) = model.expand(x), pairs(y, block)
            gradient, curve = np.zeros(size), np.zeros((size, size))
            for first in range(0, len(better), PAIRS):
                wins = full[better[first : first + PAIRS]] - full[worse[first : first + PAIRS]]
                p = 1 / (1 + np.exp(np.clip(wins @ w, -35, 35)))
                gradient += wins.T @ p
                curve += (wins * (p * (1 - p))[:, None]).T @ wins
            return np.concatenate([gradient, curve.ravel()])

        total = _total(rows, part)
        step = np.linalg.solve(total[size:].reshape(size, size) + np.eye(size), total[:size] - w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    model.cut = float(order_statistics(rows, lambda x: model.strength(x)[:, None], np.array([[count[0] - 1, count[0]]])).mean())
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model fitted on every row of ``docs`` that ``labels`` (doc_id, label 0 or 1) names; None if a label has no document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([x.tobytes() for x in features(texts)], pa.binary())], ["doc_id", "x"])

    clean = cut_lineage(clean_labels(labels).where("label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label")))
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    count = {r["label"]: r["count"] for r in text.select("doc_id").join(clean, "doc_id").groupBy("label").count().collect()}
    if len(count) < 2:
        forget(clean)
        return None
    if clean.count() * 32 <= BROADCAST_BYTES:  # else features of all rows are made, as narrow rows are cheaper to shuffle than texts
        text = text.join(F.broadcast(clean.select("doc_id")), "doc_id", "left_semi")
    number = max(1, sum(count.values()) // BLOCK_ROWS)
    rare = min(count, key=count.get)
    copies = min(number, -(-LEAST_ROWS * number // count[rare]))
    copy = F.explode(F.sequence(F.lit(0), F.when(F.col("label") == rare, F.lit(copies - 1)).otherwise(F.lit(0)))).alias("copy")
    named = text.mapInArrow(run, "doc_id long, x binary").join(clean, "doc_id").select("*", copy)
    placed = named.withColumn("block", F.pmod(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(number)) + F.col("copy"), F.lit(number)).cast("int"))
    rows = cut_lineage(placed.repartition("block").sortWithinPartitions("block", "doc_id", "x"))
    model = fit(rows, count)
    forget(rows)
    forget(clean)
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row: 0 to 1, higher where quality is likelier, from the whole text.

    A null or empty text has features of zero and a score like any other.  Without a model every score is 1.
    Repeated rows give equal rows; other columns are ignored; an empty table gives an empty result.
    """
    if model is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(1.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(sent.value.score(features(texts)))], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")

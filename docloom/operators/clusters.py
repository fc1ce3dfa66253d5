"""Clustering of vectors: number of clusters, labels, silhouettes, projection, names."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.vectors import dot, k_range, unit
from docloom.operators.relations import cluster_topic_matrix
from docloom.operators.sums import dealt, summed


#: Rows of vectors that are compared with all centres at once; the most iterations, and the distance that a centre moves at the last one.
HELD_ROWS, MOST_ITERATIONS, TOLERANCE = 2048, 50, 1e-4


def _prepared(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("__v", array_to_vector(unit(F.col(vector))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _held(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A batch's row numbers and unit vectors, HELD_ROWS at once."""
    for i in range(0, len(batch), HELD_ROWS):
        part = batch.slice(i, HELD_ROWS)
        yield part.column(0).to_numpy(), _matrix(part.column(1))


def _luck(row: np.ndarray, key: int) -> np.ndarray:
    """Numbers from 0 to 1 that follow from row numbers and a key."""
    with np.errstate(over="ignore"):
        x = (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)) * np.uint64(0xD1B54A32D192ED03)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


def _per_centre(units: DataFrame, centres: dict[int, np.ndarray], sums: bool) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Of each model: the sum (if asked for) and number of the vectors nearest to each centre, and all vectors' distances."""
    width = next(iter(centres.values())).shape[1] if sums else 0
    sent, at, ends = units.sparkSession.sparkContext.broadcast(centres), {}, 0
    for m, c in centres.items():
        at[m], ends = ends, ends + len(c) * (width + 1) + 1

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for _, x in _held(batch):
            for m, c in sent.value.items():
                near = x @ c.T
                which = near.argmax(1)
                own = total[at[m] : at[m] + len(c) * (width + 1) + 1]
                own[-1] += len(x) - near[np.arange(len(x)), which].sum()
                own[len(c) * width : -1] += np.bincount(which, minlength=len(c))
                if width:
                    one = np.zeros((len(c), len(x)))
                    one[which, np.arange(len(x))] = 1
                    own[: len(c) * width] += (one @ x).ravel()

    total = summed(units, ends, add)
    sent.destroy()
    parts = {m: total[at[m] : at[m] + len(c) * (width + 1) + 1] for m, c in centres.items()}
    return {m: (p[: len(centres[m]) * width].reshape(len(centres[m]), width), p[len(centres[m]) * width : -1], p[-1]) for m, p in parts.items()}


def _drawn(units: DataFrame, models: dict[int, int], centres: dict[int, np.ndarray], costs: dict[int, float], seed: int, step: int) -> dict[int, np.ndarray]:
    """Vectors drawn for each model: by the share of their distance in all distances, twice its number of clusters on average;
    without centres one, at random."""
    sent = units.sparkSession.sparkContext.broadcast((models, centres, costs))
    width = len(units.first()["v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, centres, costs = sent.value
        least: dict[int, tuple[float, np.ndarray]] = {}
        for batch in batches:
            for row, x in _held(batch):
                for m, k in models.items():
                    luck = _luck(row, seed + 7919 * m + step)
                    if m in centres:
                        chosen = np.flatnonzero(luck * costs[m] < 2 * k * (1 - (x @ centres[m].T).max(1)))
                        for i in chosen:
                            yield _one(m, luck[i], x[i])
                    elif luck.min() < least.get(m, (2.0, x))[0]:
                        least[m] = luck.min(), x[luck.argmin()].copy()
        for m, (luck, x) in least.items():
            yield _one(m, luck, x)

    found = units.mapInArrow(run, "m int, luck double, v binary").toArrow().sort_by([("m", "ascending"), ("luck", "ascending")])
    sent.destroy()
    m, v = found["m"].to_numpy(), np.frombuffer(b"".join(found["v"].to_pylist())).reshape(-1, width)
    return {i: v[m == i] if i in centres else v[m == i][:1] for i in models}


def _one(m: int, luck: float, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([luck]), pa.array([x.tobytes()], pa.binary())], ["m", "luck", "v"])


def _first_centres(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ among weighted candidates, then their own k-means."""
    random = np.random.default_rng(seed)
    near, chosen = candidates @ candidates.T, [int(random.choice(len(candidates), p=weights / weights.sum()))]
    while len(chosen) < k:
        p = weights * np.maximum(0.0, 1 - near[:, chosen].max(1))
        rest = np.setdiff1d(np.arange(len(candidates)), chosen)
        if not len(rest):
            break
        chosen.append(int(random.choice(len(candidates), p=p / p.sum())) if p.sum() > 1e-12 else int(rest[0]))
    centres = candidates[chosen]
    for _ in range(30):
        one = np.zeros((len(centres), len(candidates)))
        one[(candidates @ centres.T).argmax(1), np.arange(len(candidates))] = weights
        moved = _moved(one @ candidates, centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _moved(sums: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Sums at length 1; a centre without vectors stays."""
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.where(size > 1e-12, sums / np.where(size > 1e-12, size, 1.0), centres)


def _units(df: DataFrame, vector: str) -> DataFrame:
    return dealt(df.select(F.monotonically_increasing_id().alias("row"), unit(F.col(vector)).alias("v"))).persist()


def fitted(units: DataFrame, ks: Sequence[int], starts: int, seed: int) -> dict[int, np.ndarray]:
    """Of each number of clusters the centres of the best of several starts of k-means by cosine.

    All starts of all numbers go through the vectors together.  Each begins with k-means|| of two rounds over all
    vectors and ends when no centre moves, or after MOST_ITERATIONS; what is compared are the costs of the last centres.
    """
    models = {i: k for i, k in enumerate(k for k in ks for _ in range(starts))}
    found = _drawn(units, models, {}, {}, seed, 0)
    for step in (1, 2):
        costs = {m: max(x[2], 1e-300) for m, x in _per_centre(units, found, False).items()}
        more = _drawn(units, models, found, costs, seed, step)
        found = {m: np.concatenate([found[m], more[m]]) for m in models}
    weights = _per_centre(units, found, False)
    centres = {m: _first_centres(found[m], weights[m][1], k, seed + m) for m, k in models.items()}
    going = set(models)
    for _ in range(MOST_ITERATIONS):
        told = _per_centre(units, {m: centres[m] for m in going}, True)
        for m in sorted(going):
            moved = _moved(told[m][0], centres[m])
            if (1 - (moved * centres[m]).sum(1)).max() <= TOLERANCE:
                going.discard(m)
            centres[m] = moved
        if not going:
            break
    costs = _per_centre(units, centres, False)
    return {k: centres[min((m for m in models if models[m] == k), key=lambda m: (costs[m][2], m))] for k in ks}


def kmeans(df: DataFrame, k: int, vector: str = "embedding", starts: int = 3, seed: int = 42) -> DataFrame:
    """``df`` with ``cluster``: the best of several starts of k-means by cosine."""
    units = _units(df, vector)
    centres = fitted(units, [k], starts, seed)[k]
    units.unpersist()
    names, place = df.columns, len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = (_matrix(batch.column(place)) @ centres.T).argmax(1) if len(batch) else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], pa.array(which, pa.int32())], [*names, "cluster"])

    return df.withColumn("__v", unit(F.col(vector))).mapInArrow(run, T.StructType([*df.schema, T.StructField("cluster", T.IntegerType())]))


def k_scores(df: DataFrame, ks: Sequence[int], vector: str = "embedding", starts: int = 1, seed: int = 42) -> list[tuple[int, float]]:
    """The mean silhouette of each number of clusters, over all rows: all numbers in one pass."""
    units = _units(df, vector)
    centres = fitted(units, ks, starts, seed)
    told = _per_centre(units, centres, True)
    sent = units.sparkSession.sparkContext.broadcast({k: (centres[k], *told[k][:2]) for k in ks})

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for _, x in _held(batch):
            for i, k in enumerate(ks):
                c, sums, n = sent.value[k]
                at, own = np.arange(len(x)), (x @ c.T).argmax(1)
                d = x @ sums.T
                b = 1 - d / np.where(n > 0, n, np.nan)
                b[at, own] = np.nan
                b = np.fmin.reduce(b, 1)
                a = 1 - (d[at, own] - 1) / np.maximum(n[own] - 1, 1)
                most = np.maximum(a, b)
                total[i] += np.where((n[own] > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1.0), 0.0).sum()
            total[-1] += len(x)

    total = summed(units, len(ks) + 1, add)
    sent.destroy()
    units.unpersist()
    return [(k, float(total[i] / total[-1])) for i, k in enumerate(ks)]


def select_k(df: DataFrame, least: int = 5, most: int = 50, vector: str = "embedding", starts: int = 1, seed: int = 42) -> tuple[int, float]:
    """The number of clusters with the best silhouette (the smallest of equals), and that."""
    scores = k_scores(df, k_range(least, most, df.count()), vector, starts, seed)
    return max(scores, key=lambda x: (x[1], -x[0]))


def select_view(views: dict[str, DataFrame], least: int = 5, most: int = 50, vector: str = "embedding", starts: int = 1) -> tuple[str, int, float]:
    """Of several views of the same rows the one with the best silhouette, and its number of clusters."""
    best: tuple[str, int, float] | None = None
    for name, df in views.items():
        k, score = select_k(df, least, most, vector, starts)
        if best is None or score > best[2]:
            best = (name, k, score)
    if best is None:
        raise ValueError("no view")
    return best


def silhouettes(df: DataFrame, key: str, cluster: str, vector: str = "embedding") -> DataFrame:
    """``key, cluster, silhouette`` by cosine distance.  The mean distance to a cluster follows from the sum of its unit
    vectors, so the work is rows times clusters; a cluster of one has silhouette 0."""
    own = df.select(F.col(key).alias("__key"), F.col(cluster).alias("c"), unit(F.col(vector)).alias("v"))
    sums = own.select("c", F.posexplode("v").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = sums.groupBy("c").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("s"))
    every = F.broadcast(sums.agg(F.collect_list(F.struct(F.col("c").alias("o"), "n", "s")).alias("cs")))  # one vector per cluster
    pairs = own.join(every).select("__key", "c", "v", F.explode("cs").alias("k")).select("__key", "c", F.col("k.o").alias("o"), F.col("k.n").alias("n"), dot(F.col("v"), F.col("k.s")).alias("d"))
    same = F.col("c") == F.col("o")
    means = pairs.groupBy("__key", "c").agg(
        F.max(F.when(same, F.col("n"))).alias("n"),
        F.max(F.when(same & (F.col("n") > 1), 1 - (F.col("d") - 1) / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~same, 1 - F.col("d") / F.col("n"))).alias("b"),
    )
    value = F.when((F.col("n") == 1) | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return means.select(F.col("__key").alias(key), F.col("c").alias(cluster), value.alias("silhouette"))


def projection(df: DataFrame, key: str, vector: str = "embedding", dimensions: int = 2) -> DataFrame:
    """``key`` and principal components of unit vectors.  (A neighbour map has no counterpart in Spark.)"""
    ready = _prepared(df, vector)
    model = PCA(k=dimensions, inputCol="__v", outputCol="__p").fit(ready)
    at = vector_to_array("__p")
    return model.transform(ready).select(key, *[at[i].alias(f"pc{i + 1}") for i in range(dimensions)])


def cluster_names(df: DataFrame, cluster: str = "cluster", topic: str = "topic", default: str = "Кластер") -> DataFrame:
    """``cluster, name``: clusters named by the topics they lead in.

    Each topic goes to the cluster with its largest share; each cluster takes the best topic it got.  A cluster that
    got none takes its most frequent topic that no other has, else its most frequent one, else a default name.
    """
    counts = cluster_topic_matrix(df.where(F.trim(F.coalesce(topic, F.lit(""))) != ""), cluster, topic)
    shares = counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(cluster)))
    to = F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("share"), cluster))
    best = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("share"), topic))
    named = {r[cluster]: r[topic] for r in shares.withColumn("r", to).where("r = 1").withColumn("s", best).where("s = 1").collect()}
    every = [r[0] for r in df.select(cluster).distinct().orderBy(cluster).collect()]
    rest = [c for c in every if c not in named]
    used = set(named.values())
    if rest:
        # the clusters are few; each brings no more topics than are used, and one
        order = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("count"), topic))
        own: dict = {}
        for r in counts.where(F.col(cluster).isin(rest)).withColumn("r", order).where(F.col("r") <= len(every) + 1).orderBy(cluster, "r").collect():
            own.setdefault(r[cluster], []).append(r[topic])
        for c in rest:
            topics = own.get(c, [])
            named[c] = next((t for t in topics if t not in used), topics[0] if topics else f"{default} {c}")
            used.add(named[c])
    return df.sparkSession.createDataFrame(sorted(named.items()), f"`{cluster}` {df.schema[cluster].dataType.simpleString()}, name string")

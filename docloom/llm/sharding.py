"""Sharding by a two-pass external shuffle.

First pass: records are scattered uniformly, by a seeded hash, into buckets that fit in memory.  Second pass: each
bucket is shuffled by Fisher and Yates' method and takes its place after the buckets before it.  The method draws the
places of a bucket's ranks; the records themselves are sorted to these places by Spark.  Record number p of
the whole order goes to slot p // shards of shard p % shards, so shards differ by one record at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.samples import free_prefix
from docloom.sources.tables import cut_lineage

#: UTF-8 bytes of text that a bucket holds on average.
BUCKET_BYTES = 64 << 20


def fisher_yates(n: int, rng: np.random.Generator) -> list[int]:
    """A uniform permutation of range(n): from the last place down, each swaps with a random one up to itself."""
    order = list(range(n))
    draws = rng.random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def external_shuffle(docs: DataFrame, shards: int = 8, seed: int = 23, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (0 on, gapless within a shard), in a random order.

    Buckets and their order depend on the id, the text and the seed only, and so does the result up to rows that are
    equal in both.  Null ids and texts are values like others.  Rows of equal id and text share a bucket, but for those
    that would fill one: they are spread over all.  An empty table gives an empty result.  A column of ``docs`` named
    shard or slot is replaced.
    """
    docs = docs.drop("shard", "slot")
    spark, p = docs.sparkSession, free_prefix(docs.columns)
    tie, bucket, size, rows = f"{p}tie", f"{p}bucket", f"{p}size", f"{p}rows"
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)), F.count("*")).first()
    # at least one bucket for each partition of a shuffle: the more, the smaller
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((total[0] + total[1]) / bucket_bytes))
    keyed = docs.withColumn(tie, F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))
    ties = keyed.groupBy(tie).agg(F.count("*").alias(rows), F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).alias(size)).where(F.col(rows) > 1)
    full = ties.where(F.col(size) > bucket_bytes).select(tie, F.lit(True).alias(size))
    place = F.pmod(F.xxhash64(F.lit(seed), tie), F.lit(buckets)).cast("int")
    if full.isEmpty():
        keyed = keyed.withColumn(bucket, place)
    else:  # each fills a bucket, so there are no more of them than buckets; places of such rows are kept, as they depend on partitions
        spread = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
        keyed = cut_lineage(keyed.withColumn(rows, spread).join(F.broadcast(full), tie, "left").withColumn(bucket, F.when(F.col(size), F.col(rows)).otherwise(place)).drop(rows, size))
    sizes = np.zeros(buckets, np.int64)
    for at, n in keyed.groupBy(bucket).count().collect():  # one number per bucket of bucket_bytes
        sizes[at] = n
    first, held = np.cumsum(sizes) - sizes, {}

    # only numbers go to Python: rows are sorted where they may spill, and no process holds a bucket's texts at once
    @F.arrow_udf("long")
    def taken(which: pa.Array, rank: pa.Array) -> pa.Array:
        which, rank = which.to_numpy(), rank.to_numpy()
        out = np.empty(len(which), np.int64)
        edges = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a < b and (of := int(which[a])) not in held:
                held.clear()
                order = fisher_yates(int(sizes[of]), np.random.Generator(np.random.PCG64([seed, of])))
                held[of] = np.empty(len(order), np.int64)
                held[of][order] = first[of] + np.arange(len(order))
            if a < b:
                out[a:b] = held[of][rank[a:b]]
        return pa.array(out)

    ranked = keyed.withColumn(rows, (F.row_number().over(Window.partitionBy(bucket).orderBy(tie)) - 1).cast("long"))
    placed = ranked.withColumn(size, taken(bucket, rows)).sortWithinPartitions(size)
    at = F.col(size)
    return placed.withColumn("shard", F.pmod(at, F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"`{size}` div {shards}").cast("long")).drop(tie, bucket, rows, size)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder ``shard=N`` per shard; each bucket writes its records of a shard in the order of their slots."""
    sharded.write.mode("overwrite").partitionBy("shard").parquet(path)

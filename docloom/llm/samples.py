"""Bounded, reproducible samples of labelled rows, for fitting models on the driver; names and keys for rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n)), F.lit(0))


def free_prefix(columns: list[str]) -> str:
    """A prefix that begins none of these column names, whatever their case."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A hash of all columns that can be hashed, for an order of rows that depends on nothing else."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{f.name}`") for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))])


def clean_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, label`` of every id that has one label; one with several teaches nothing.  Null ids and labels are left out."""
    return labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")


def sample_labels(labels: DataFrame, per_label: dict[int, int], seed: int = 5) -> DataFrame:
    """``doc_id, label`` of at most about ``per_label[label]`` rows of each label, chosen by a hash of the id.

    Rows with a null id or label, or with a label not asked for, are left out.  The choice depends on ids and counts
    only.  An id with several labels is left out too, as it teaches nothing.
    """
    clean = clean_labels(labels)
    counts = {r["label"]: r["count"] for r in clean.groupBy("label").count().collect()}  # one row per label
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for label, most in per_label.items():
        if counts.get(label):
            share = F.when(F.col("label") == label, min(1.0, most / counts[label])).otherwise(share)
    return clean.where(draw < share)

"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, sharding.

Each stage calls one operator of ``docloom.llm`` on all that its predecessor kept.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import language
from docloom.llm.decontaminate import WINDOW, contamination, word_array
from docloom.llm.jaccard_join import jaccard_components
from docloom.llm.mixing import mix, take_copies
from docloom.llm.samples import free_prefix, row_hash
from docloom.llm.sharding import external_shuffle
from docloom.sources.tables import cut_lineage, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; those without a letter or text go.

    Where no row has a language to learn from, nothing is told and only those go.
    """
    model = language.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{IsAlphabetic}"))
    found = language.identify(docs, model)
    return found.where(F.col("lang_pred") != language.UNKNOWN).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of five-word shingles (Jaccard 0.8 or more) hang together, the smallest id stays.

    Rows that repeat an id are one document, of which the row with the least hash stays; rows without an id stay.
    """
    groups = cut_lineage(jaccard_components(docs, n=5, percent=80).select("doc_id", "component_id"))
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    if not groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        at = f"{free_prefix(docs.columns)}at"
        order = Window.partitionBy("doc_id").orderBy(row_hash(docs))
        named = kept.where("doc_id is not null").withColumn(at, F.row_number().over(order)).where(F.col(at) == 1).drop(at)
        kept = named.unionByName(kept.where("doc_id is null"))
    return kept.select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no eight successive words of a benchmark item occur."""
    items = table(spark, sf_dir, "benchmark").where(F.size(word_array(F.col("text"))) >= WINDOW)
    bad = contamination(docs, items, min_items=1).where("contaminated").select("doc_id", "text_hash").distinct()
    same = docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["text_hash"])
    return docs.join(bad, same, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return take_copies(mix(docs)).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a random order over eight shards, with ``shard`` and ``slot``."""
    return external_shuffle(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the stages; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each one's rows kept in the checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs

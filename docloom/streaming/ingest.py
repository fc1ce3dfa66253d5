"""Streams of new articles into a store: each micro-batch is an insert in which known titles are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.articles import parse_articles
from docloom.operators.store import Store
from docloom.schemas import SCHEMAS


def article_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Article rows from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(SCHEMAS["articles"]).parquet(folder)


def ingest(rows: DataFrame, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Insert a stream of article rows (ordered by ``id`` within a micro-batch) into the store.

    A batch that is run again after a failure inserts nothing twice, as its titles are there already.
    """

    def insert(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.insert("articles", batch.withColumnRenamed("id", "ingest_seq"), "ingest_seq")

    writer = rows.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_pages(pages: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Parse whole files of page texts as they arrive, and insert their articles."""

    def insert(batch: DataFrame, _: int) -> None:
        rows = parse_articles(batch).withColumn("ingest_seq", F.struct("source", "seq"))
        if not rows.isEmpty():
            store.insert("articles", rows, "ingest_seq")

    return pages.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

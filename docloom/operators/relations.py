"""Relational building blocks: lookups, joins, constraints, change points, as-of joins, percentages, tops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import TOPIC_ABSENT, TOPIC_UNDEFINED, squeeze_ends


def by_key(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows with a value, pushed down to the scan."""
    return df.where(F.col(column) == value)


def find_by_title(df: DataFrame, title: str, order: str, column: str = "title") -> DataFrame:
    """The first row, in the order of ``order``, whose title is the same but for white space at the ends."""
    return df.where(squeeze_ends(F.col(column)) == title.strip()).orderBy(order).limit(1)


def find_by_index(df: DataFrame, index: int, order: str) -> DataFrame:
    """The row at a position (from 0) in the order of ``order``: the last of the first ``index + 1`` rows."""
    return df.orderBy(order).limit(index + 1).orderBy(F.desc(order)).limit(1) if index >= 0 else df.limit(0)


def left_columns(articles: DataFrame, results: DataFrame, key: str, other: str, columns: Sequence[str]) -> DataFrame:
    """All articles with columns of their result rows, null where there is none."""
    right = results.select(F.col(other).alias("__k"), *columns)
    return articles.join(right, articles[key] == right["__k"], "left").drop("__k")


def missing_parents(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose parent does not exist."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def cascade(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def first_by(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Of the rows of each key the first; a hot key only costs its partial minimum, never a sort of its rows."""
    names = [*order, *[c for c in df.columns if c not in order]]
    return df.groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(*names)).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in df.columns])


def new_rows(batch: DataFrame, existing: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows of a batch to insert: non-null keys that don't exist yet, the first of each."""
    return first_by(batch.where(F.col(key).isNotNull()), key, order).join(existing.select(key), key, "left_anti").select(batch.columns)


def share_of_group(df: DataFrame, group: str, item: str) -> DataFrame:
    """Count of each (group, item), items that are null left out, and its percentage of the group's counted rows."""
    counts = df.where(F.col(item).isNotNull()).groupBy(group, item).agg(F.count("*").alias("article_count"))
    total = F.sum("article_count").over(Window.partitionBy(group))
    return counts.withColumn("percentage", F.col("article_count").cast("double") / total * 100)


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], most: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= most)


def change_points(df: DataFrame, source: str, order: Sequence[str], value: str, page: str) -> DataFrame:
    """Rows whose value is not that of the row before, blank values and pages left out."""
    kept = df.where((F.coalesce(F.trim(F.col(value).cast("string")), F.lit("")) != "") & (F.coalesce(F.col(page), F.lit(0)) != 0))
    before = F.lag(value).over(Window.partitionBy(source).orderBy(*order))
    return kept.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__b") != F.col(value))).drop("__b")


def as_of(rows: DataFrame, points: DataFrame, key: str, at: str, point_at: str, value: str) -> DataFrame:
    """Each row with the value of the last point at or before it; of the first point if there is none before.

    Points and rows are merged and carried forward, so the work is a sort of each key, not a product.  A row whose
    position is null has no value.
    """
    given = points.select(F.col(key), F.col(point_at).alias("__at"), F.lit(0).alias("__kind"), F.col(value).alias("__value"), F.lit(None).cast(f"struct<{','.join(f'`{c}`:{t}' for c, t in rows.dtypes)}>").alias("__row"))
    asked = rows.select(F.col(key), F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(points.schema[value].dataType).alias("__value"), F.struct(*rows.columns).alias("__row"))
    order = Window.partitionBy(key).orderBy(F.col("__at").asc_nulls_first(), "__kind")
    merged = given.unionByName(asked).withColumn("__last", F.last("__value", True).over(order)).withColumn("__first", F.first("__value", True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    found = F.when(F.col("__at").isNotNull(), F.coalesce("__last", "__first")).alias(value)
    return merged.where("__kind = 1").select("__row.*", found)


def defined_topics(df: DataFrame, topic: str = "topic", absent: Sequence[str] = (TOPIC_ABSENT, TOPIC_UNDEFINED)) -> tuple[DataFrame, DataFrame]:
    """Rows with a topic, and how many were left out for each reason."""
    t = squeeze_ends(F.col(topic))
    reason = F.when(F.col(topic).isNull(), "null").when(t == "", "blank").when(F.col(topic).isin(*absent), F.col(topic))
    return df.where(reason.isNull()), df.where(reason.isNotNull()).groupBy(reason.alias("reason")).agg(F.count("*").alias("removed"))


def cluster_topic_matrix(df: DataFrame, cluster: str, topic: str) -> DataFrame:
    return df.groupBy(cluster, topic).agg(F.count("*").alias("count"))

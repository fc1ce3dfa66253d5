"""Reports over clusters, classes and saved classifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.relations import share_of_group, top_per_group


def cluster_class_distribution(clusters: DataFrame, classes: DataFrame, code: str) -> DataFrame:
    """``cluster_name, class_code, article_count, percentage`` of articles that have both a cluster and a class."""
    both = clusters.join(classes, "article_id").select("cluster_name", F.col(code).alias("class_code"))
    return share_of_group(both, "cluster_name", "class_code")


def of_cluster(distribution: DataFrame, cluster: str | None = None) -> DataFrame:
    """A cluster's classes by count, or all clusters'."""
    if cluster is not None:
        return distribution.where(F.col("cluster_name") == cluster).orderBy(F.desc("article_count"), "class_code")
    return distribution.orderBy("cluster_name", F.desc("article_count"), "class_code")


def of_class(distribution: DataFrame, code: str | None = None) -> DataFrame:
    """A class's clusters by count; without a class, how many clusters and articles each class has."""
    if code is not None:
        return distribution.where(F.col("class_code") == code).orderBy(F.desc("article_count"), "cluster_name")
    sums = distribution.groupBy("class_code").agg(F.countDistinct("cluster_name").alias("cluster_count"), F.sum("article_count").alias("total_articles"))
    return sums.orderBy(F.desc("total_articles"), "class_code")


def cluster_summary(distribution: DataFrame) -> DataFrame:
    """How many classes and articles each cluster has."""
    return distribution.groupBy("cluster_name").agg(F.countDistinct("class_code").alias("class_count"), F.sum("article_count").alias("total_articles"))


def top_classes(distribution: DataFrame, most: int = 3) -> DataFrame:
    return top_per_group(distribution, "cluster_name", [F.desc("article_count"), F.col("class_code")], most)


def compare_methods(tfidf: DataFrame, embed: DataFrame) -> DataFrame:
    """Both distributions, one below the other, with the method's name."""
    return tfidf.withColumn("method", F.lit("tfidf")).unionByName(embed.withColumn("method", F.lit("embed")))


def saved_list(saved: DataFrame, limit: int = 100, code: str | None = None) -> DataFrame:
    """The latest saved classifications, of those with a class by either method if one is given."""
    if code is not None:
        saved = saved.where((F.col("tfidf_code") == code) | (F.col("embed_code") == code))
    return saved.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def saved_totals(saved: DataFrame) -> DataFrame:
    """Counts of all, ambiguous and disagreeing saved classifications; 0 for an empty table."""
    flag = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return saved.agg(F.count("*").alias("total"), flag("is_ambiguous").alias("ambiguous"), flag("has_discrepancy").alias("discrepancy"))


def top_codes(saved: DataFrame, code: str, title: str, most: int = 5) -> DataFrame:
    return saved.where(F.col(code).isNotNull()).groupBy(code, title).agg(F.count("*").alias("count")).orderBy(F.desc("count"), code, title).limit(most)


def saved_statistics(saved: DataFrame, most: int = 5) -> dict[str, object]:
    """The totals and the most frequent classes by each method."""
    out: dict[str, object] = saved_totals(saved).first().asDict()
    for method in ("tfidf", "embed"):
        out[f"top_{method}"] = [r.asDict() for r in top_codes(saved, f"{method}_code", f"{method}_title", most).collect()]
    return out


def flag_rates(df: DataFrame, *flags: str) -> DataFrame:
    """Of each flag how many rows have it, and their percentage; nulls count as not having it."""
    parts = []
    for f in flags:
        value = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        parts += [F.sum(value).cast("long").alias(f"{f}_count"), (F.avg(value) * 100).alias(f"{f}_percent")]
    return df.agg(*parts)

"""Vectors, numbers and JSON over columns."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    size = norm(a)
    return F.when(size == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / size))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def min_max(c: Column, *group: str) -> Column:
    """Scaled to 0..1 within a group, by a range that is never zero."""
    w = Window.partitionBy(*group)
    return (c - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + 1e-9)


def page_bonus(a: Column, b: Column, top: float, reach: int, step: float) -> Column:
    """``max(0, top - min(distance, reach) * step)`` of two page numbers; 0 where one is missing or 0."""
    ok = (F.coalesce(a, F.lit(0)) != 0) & (F.coalesce(b, F.lit(0)) != 0)
    return F.when(ok, F.greatest(F.lit(0.0), F.lit(top) - F.least(F.abs(a - b), F.lit(reach)) * step)).otherwise(0.0)


def top_by_rank(json: Column, rank: str = "rank_tfidf", code: str = "code", score: str = "match_score") -> Column:
    """Struct (code, score) of the first element with rank 1 in a JSON array; empty and 0 for none or bad JSON."""
    items = F.from_json(json, f"array<struct<{code}:string,{score}:double,{rank}:int>>")
    first = F.try_element_at(F.filter(items, lambda x: x[rank] == 1), F.lit(1))
    return F.struct(F.coalesce(first[code], F.lit("")).alias("code"), F.coalesce(first[score], F.lit(0.0)).alias("score"))


def json_flag(json: Column, path: str) -> Column:
    """A number in a JSON text as 0 or 1; 0 where there is none, or no JSON."""
    return (F.coalesce(F.get_json_object(json, path).try_cast("double"), F.lit(0.0)) != 0).cast("int")


def items_json(items: Column) -> Column:
    """An array of structs as JSON text, as saved classifications are shown and exchanged; ``[]`` for null."""
    return F.coalesce(F.to_json(items), F.lit("[]"))


def k_range(least: int, most: int, n: int) -> range:
    """Cluster counts that ``n`` rows allow."""
    low, high = max(2, min(least, n - 2)), min(most, n - 1)
    if low > high:
        raise ValueError("too few rows to cluster")
    return range(low, high + 1)


def plot_dimensions(n: int, width: int, most: int = 50) -> tuple[int, int]:
    """Components for a projection and neighbours (perplexity) for a map of ``n`` rows of ``width`` numbers."""
    return min(most, width, n), min(30, max(10, n // 25))

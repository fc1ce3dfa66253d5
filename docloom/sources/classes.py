"""The dictionary of classes that documents are scored against."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import class_code, class_title
from docloom.schemas import SCHEMAS

# Codes and titles of the default classes, in the order that decides ties.
DEFAULT_CLASSES = (
    "1.2.2. Математическое моделирование, численные методы и комплексы программ",
    "2.3.1. Системный анализ, управление и обработка информации",
    "2.3.3. Автоматизация и управление технологическими процессами и производствами",
    "2.3.5. Математическое и программное обеспечение вычислительных систем, комплексов и компьютерных сетей",
    "2.4.5. Энергетические системы и комплексы",
)


def class_dictionary(spark: SparkSession, rows: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """``class_idx, code, title, description`` of (name, description) pairs; by default names without descriptions."""
    given = rows or [(name, "") for name in DEFAULT_CLASSES]
    df = spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(given)], "class_idx int, name string, description string")
    return df.select("class_idx", class_code(F.col("name")).alias("code"), class_title(F.col("name")).alias("title"), "description").select(*SCHEMAS["classes"].names)

"""Tables in a folder: insert, update, delete with the constraints that Parquet does not have.

A change writes the new table beside the old one, puts the old one aside and takes its place.  Whatever step fails, the
old rows are in one of two known places, and the next reader puts them back.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.relations import cascade, first_by, missing_parents, new_rows
from docloom.schemas import CHILDREN, DEFAULTS, SCHEMAS, UNIQUE
from docloom.sources.tables import cut_lineage


class Store:
    """The engine's tables under one folder of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def create(self) -> None:
        """Empty tables where there are none."""
        for name, schema in SCHEMAS.items():
            if not self._there(name):
                self.spark.createDataFrame([], schema).write.parquet(f"{self.folder}/{name}")

    def exists(self) -> bool:
        return self._there("articles")

    def _there(self, name: str) -> bool:
        """Whether the table exists; one that a broken change has put aside is put back."""
        if not self._fs.exists(self._path(name)) and self._fs.exists(self._path(f"_old_{name}")):
            self._fs.rename(self._path(f"_old_{name}"), self._path(name))
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> DataFrame:
        """A table; FileNotFoundError if it was never created."""
        if not self._there(name):
            raise FileNotFoundError(f"{self.folder}/{name}")
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """All rows of a table, columns in the schema's order; unique and parent columns are checked first."""
        rows = self._shaped(name, rows)
        if key := UNIQUE.get(name):
            twice = rows.groupBy(key).count().where("count > 1").limit(1).collect()
            if twice:
                raise ValueError(f"{name}.{key} is not unique: {twice[0][0]!r}")
        if name in CHILDREN and not missing_parents(rows, self.read("articles"), "article_id", "id").isEmpty():
            raise ValueError(f"{name} has rows of articles that don't exist")
        rows.write.mode("overwrite").parquet(f"{self.folder}/_new_{name}")
        self._fs.delete(self._path(f"_old_{name}"), True)  # of a change that broke after its last rename
        for old, new in ((name, f"_old_{name}"), (f"_new_{name}", name)):
            self._move(old, new)
        self._fs.delete(self._path(f"_old_{name}"), True)

    def _move(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"could not rename {self.folder}/{old} to {new}")

    def _shaped(self, name: str, rows: DataFrame) -> DataFrame:
        columns = []
        for f in SCHEMAS[name]:
            default = DEFAULTS.get(name, {}).get(f.name)
            value = F.col(f.name) if f.name in rows.columns else F.lit(None)
            if f.name == "timestamp":
                value = F.coalesce(value, F.current_timestamp())
            columns.append((F.coalesce(value, F.lit(default)) if default is not None else value).cast(f.dataType).alias(f.name))
        return rows.select(columns)

    def _numbered(self, name: str, rows: DataFrame, order: str) -> DataFrame:
        """New ids after the largest one.  Ranks within range partitions, and where each partition begins.  Lineage is cut,
        so that partitions are those that were counted."""
        last = self.read(name).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        ordered = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
        ordered = cut_lineage(ordered)
        counts = sorted((r["__p"], r["count"]) for r in ordered.groupBy("__p").count().collect())  # one row per partition
        start, at = {}, last
        for p, n in counts:
            start[p], at = at, at + n
        offset = F.create_map(*[F.lit(x) for kv in start.items() for x in kv]) if start else F.create_map(F.lit(0), F.lit(last))
        return ordered.withColumn("id", (F.try_element_at(offset, F.col("__p")) + F.col("__i") + 1).cast("long")).drop("__p", "__i")

    def insert(self, name: str, batch: DataFrame, order: str, strict: bool = False) -> dict[str, int]:
        """Append rows in the order of ``order`` with new ids.  Of a unique value the first row counts.

        Returns how many rows were inserted, were duplicates, had a null key, or had no parent.  With ``strict`` any
        such row raises instead (one insert of one row).
        """
        total, key = batch.count(), UNIQUE.get(name) or ("title" if name == "saved_classifications" else None)
        rows, nulls, orphans = batch, 0, 0
        if key:
            rows = batch.where(F.col(key).isNotNull())
            nulls = total - rows.count()
        if name in CHILDREN:
            parents = self.read("articles")
            orphans = missing_parents(rows, parents, "article_id", "id").count()
            rows = cascade(rows, parents, "article_id", "id")
        if name in UNIQUE:
            rows = new_rows(rows, self.read(name), UNIQUE[name], [order])
        rows = self._shaped(name, self._numbered(name, rows, order)).persist()
        counts = {"inserted": rows.count(), "nulls": nulls, "orphans": orphans}
        counts["duplicates"] = total - sum(counts.values())
        if strict and counts["inserted"] < total:
            raise ValueError(f"not inserted into {name}: {counts}")
        rows.write.mode("append").parquet(f"{self.folder}/{name}")
        rows.unpersist()
        return counts

    def update(self, name: str, row_id: int, values: Mapping[str, object]) -> int:
        """Set columns of a row by id; how many rows there were.  No columns, or unknown ones, raise ValueError."""
        if not values or not set(values) <= set(SCHEMAS[name].names) - {"id"}:
            raise ValueError(f"no such columns to update: {sorted(values)}")
        df = self.read(name)
        n = df.where(F.col("id") == row_id).count()
        if n:
            self.replace(name, updated(df, row_id, values))
        return n

    def delete(self, name: str, row_id: int) -> int:
        """Delete a row by id, and of an article its results too; how many rows there were."""
        df = self.read(name)
        n = df.where(F.col("id") == row_id).count()
        if n:
            self.replace(name, df.where(F.col("id") != row_id))
            if name == "articles":
                for child in CHILDREN:
                    self.replace(child, cascade(self.read(child), self.read("articles"), "article_id", "id"))
        return n


def updated(df: DataFrame, row_id: int, values: Mapping[str, object], key: str = "id") -> DataFrame:
    """The rows with columns of one of them set."""
    return df.withColumns({c: F.when(F.col(key) == row_id, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


__all__ = ["Store", "first_by", "updated"]

"""Parquet tables by name, and the place of intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of narrow rows that are sent to all tasks at most.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a directory, by Spark's own reader, so that any store Spark knows will do."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed now and kept in the session's shared checkpoint folder.

    The folder is the one that ``spark.checkpoint.dir`` names.  A session of one process (a test) may do without that
    setting and gets a temporary one; on a cluster a local folder would be out of the others' reach, so it is an error.
    """
    spark = df.sparkSession
    _checkpoint_folder(spark)
    with deleting_shuffles(spark):
        return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Delete the kept rows of a result of :func:`cut_lineage` that nothing refers to any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        _delete(df.sparkSession, file.get())


@contextmanager
def deleting_shuffles(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files that are made meanwhile, as what is computed from them is kept elsewhere."""
    context = spark.sparkContext._jsc.sc()
    first = context.newShuffleId()
    yield
    cleaner = context.cleaner()
    if cleaner.isDefined():
        for number in range(first + 1, context.newShuffleId()):
            cleaner.get().doCleanupShuffle(number, False)


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context.getCheckpointDir() is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
    return context.getCheckpointDir()


def joined_to_small(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The inner join of ``rows`` with narrow rows already computed: these are counted and sent to all tasks where they are
    few enough for that (BROADCAST_BYTES); if not, both sides are shuffled."""
    width = sum(16 if f.dataType.typeName() in ("long", "integer", "double") else 1 << 20 for f in few.schema.fields)
    return rows.join(F.broadcast(few) if few.count() * width <= BROADCAST_BYTES else few, key)


class KeptTable:
    """Rows written to the checkpoint folder as Parquet, for wide rows that are read more than once; to be dropped."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, f"{_checkpoint_folder(df.sparkSession)}/docloom-{uuid.uuid4().hex}"
        with deleting_shuffles(self.spark):
            df.write.parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)

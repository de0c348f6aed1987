"""Shared helpers of the training-data operators: table access, checkpoints, text splitting, checked broadcasts."""

from __future__ import annotations

import itertools
import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The blanks that separate words: space and U+0009 to U+000D.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of a batch of rows for a Python worker.
BATCH_BYTES = 4 << 20

_names = itertools.count()


def shipped(module: str) -> None:
    """Pickle a module's functions by value, so that Python workers need not be able to import this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; Spark's reader takes the path, so any Hadoop file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the setting spark.checkpoint.dir. Only where that is unset, as in local tests, is a temporary folder made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cleanloom-"))
        return spark.sparkContext.getCheckpointDir()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the rows are in the shared folder, so a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_batches(spark: SparkSession) -> None:
    """Bound by bytes what Spark hands to a Python worker at once, for the session; rows may hold very long texts.

    It changes memory only, never a result, and stays set as tables are computed after their operator has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{app}-{next(_names)}"


def written(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path for removed(); smaller than a checkpoint of many rows."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def input_bytes(df: DataFrame) -> int:
    """The size of the files behind df, as the planner knows it; where it does not, half the bytes of all texts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else (df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """The number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def words(text: Column) -> Column:
    """The words in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{BLANKS}]+"), lambda w: w != "")


def bounded(df: DataFrame, rows: int) -> DataFrame | None:
    """df marked for broadcast if it is shown to hold at most so many rows (narrow ones are meant), else None."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else None


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int = 100_000) -> DataFrame:
    """A join that broadcasts the right side only after its size is checked; beyond that it shuffles both."""
    small = bounded(right, rows)
    return left.join(right if small is None else small, on, how)

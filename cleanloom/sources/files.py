"""Tables from files by suffix, two small demo tables, and sinks."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.core import ROW_ID, CleaningError
from cleanloom.operators.standardize import normalize_missing_tokens
from cleanloom.plans.pipeline import CleaningPipeline
from cleanloom.sources import xlsx


def read_any(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A table by the path's suffix: csv, json (rows, or {column: {row: value}}), jsonl, parquet, orc, xlsx.

    Quoted fields of a csv file may hold line breaks, which makes the file one task; with multi_line=False it is split.
    """
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".csv":
        df = spark.read.option("header", True).option("inferSchema", True).option("multiLine", multi_line).option("escape", '"').csv(path)
        return normalize_missing_tokens(df)[0]
    if kind == ".jsonl":
        return spark.read.json(path)
    if kind == ".json":
        return _column_json(spark, path) or spark.read.option("multiLine", True).json(path)
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind == ".orc":
        return spark.read.orc(path)
    if kind == ".xlsx":
        return _read_excel(spark, path)
    raise CleaningError(f"no reader for {kind or 'a file without suffix'}")


def _column_json(spark: SparkSession, path: str) -> DataFrame | None:
    """{column: {row: value}} turned into rows; None for any other form."""
    df = spark.read.option("multiLine", True).json(path)
    kinds = [f.dataType for f in df.schema]
    if not kinds or any(k.typeName() != "struct" for k in kinds) or len({tuple(k.names) for k in kinds}) != 1:
        return None
    rows = kinds[0].names
    cell = lambda c, r: F.col(f"`{c}`").getField(r)
    return df.select(F.explode(F.array(*(F.struct(*(cell(c, r).alias(c) for c in df.columns)) for r in rows))).alias("r")).select("r.*")


def _read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet; a column of cells of several kinds is text. A workbook is read on the driver, as a sheet's size is bounded by its format."""
    head, *rows = xlsx.read_sheet(bytes(spark.read.format("binaryFile").load(path).select("content").first().content)) or [[]]
    names = [f"column_{i + 1}" if h is None else str(h) for i, h in enumerate(head)]
    rows = [[*r[: len(names)], *[None] * (len(names) - len(r))] for r in rows]
    kinds = []
    for i in range(len(names)):
        found = {type(r[i]) for r in rows if r[i] is not None}
        kinds.append({int: "long", float: "double", bool: "boolean", datetime: "timestamp_ntz"}.get(found.pop(), "string") if len(found) == 1 else "double" if found == {int, float} else "string")
    fit = {"double": float, "string": str}
    rows = [tuple(v if v is None else fit.get(k, lambda x: x)(v) for v, k in zip(r, kinds, strict=True)) for r in rows]
    return spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in zip(names, kinds, strict=True)))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header and without row ids; one file only on request, as it takes one task."""
    out = df.drop(ROW_ID)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_excel(df: DataFrame, path: str, sheet: str = "CleanedData", max_rows: int = 1_048_575) -> None:
    """An Excel sheet, which holds max_rows rows at most; written on the driver, to any file system that Spark reaches."""
    out = df.drop(ROW_ID)
    if out.limit(max_rows + 1).count() > max_rows:
        raise CleaningError(f"an Excel sheet holds {max_rows} rows")
    data = xlsx.write_sheet(out.columns, (tuple(r) for r in out.toLocalIterator()), sheet)
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first rows, by row id where there is one."""
    return (df.orderBy(ROW_ID) if ROW_ID in df.columns else df).limit(n)


def clean(spark: SparkSession, path: str, **options) -> tuple[DataFrame, dict]:
    """Read a file and run the cleaning plan over it."""
    return CleaningPipeline(**options).run(read_any(spark, path))


def demo_customers(spark: SparkSession) -> DataFrame:
    """Eight messy rows: currency, brackets, sentinels, mixed dates, an outlier, casing, a copy."""
    rows = [
        (1, " Ann Lee ", "$1,200.50", "2023-01-05", 34.0, "active"),
        (2, "BOB STONE", "(300.00)", "05/02/2023", 41.0, "Active "),
        (3, "Cy Young", "N/A", "2023-03-09", None, "inactive"),
        (4, "dee  marsh", "€ 950", "unknown", 29.0, "ACTIVE"),
        (5, "Eve O'Neil", "1 100", "2023-04-30", 210.0, "-"),
        (6, "Flo Park", "$870.00", "2023-05-11", 38.0, "inactive"),
        (6, "Flo Park", "$870.00", "2023-05-11", 38.0, "inactive"),
        (7, None, "$1,010.25", "2023-06-21", 45.0, "active"),
    ]
    return spark.createDataFrame(rows, "`Customer ID` long, ` Full Name ` string, revenue string, signup_date string, age double, status string")


def demo_accounts(spark: SparkSession) -> DataFrame:
    """Six messy rows with truth values as text."""
    rows = [(1, "Ann Lee", "100", "2023-01-01", "yes"), (2, "ann lee ", "n/a", "2023-01-02", "no"), (3, "Bo", "$300", "2023-01-03", "Y"), (4, "Cy", "250", "", "false"), (5, "Di", "275", "2023-01-05", "1"), (6, "Ed", "90%", "2023-01-06", "0")]
    return spark.createDataFrame(rows, "`Customer ID` long, ` Full Name ` string, revenue string, signup_date string, active string")

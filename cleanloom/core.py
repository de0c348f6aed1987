"""The contract of every operator: (DataFrame, options) -> (DataFrame, report), errors, names and row order."""

from __future__ import annotations

import functools
import itertools
import logging
import math
import tempfile
import time
from collections.abc import Callable
from datetime import date, datetime, timezone
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger("cleanloom")
_scratch = itertools.count()

#: Carries a row's place where order matters; it is given at ingest and taken off at the end.
ROW_ID = "__row_id"


class CleaningError(Exception):
    """Anything this engine raises on purpose."""


class StepError(CleaningError):
    """An operator failed and errors="raise" was asked for."""


class MissingDependencyError(CleaningError):
    """An optional package is needed and absent."""


def configure_logging(level: int | str = logging.INFO) -> logging.Logger:
    """Set the level of the engine's logger, with one handler however often it is called."""
    if not log.handlers:
        log.addHandler(logging.StreamHandler())
    log.setLevel(level)
    return log


def json_safe(value):
    """A copy that json.dumps takes: not-a-number and infinities become null, dates ISO text, sets sorted lists."""
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, Decimal):
        return float(value) if value.is_finite() else None
    if isinstance(value, (datetime, date)):
        return value.isoformat() if value == value else None
    if isinstance(value, Row):
        return json_safe(value.asDict())
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted((json_safe(v) for v in value), key=str)
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if hasattr(value, "item"):
        return json_safe(value.item())
    return str(value)


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def check_frame(df: DataFrame, unique: bool = True) -> None:
    if not isinstance(df, DataFrame):
        raise TypeError(f"a Spark DataFrame is needed, not {type(df).__name__}")
    twice = sorted({c for c in df.columns if df.columns.count(c) > 1}) if unique else []
    if twice:
        raise ValueError(f"duplicate column names: {', '.join(twice)}; rename them first")


def resolve_columns(df: DataFrame, columns: list[str] | None, keep: Callable[[T.DataType], bool] | None = None) -> list[str]:
    """The named columns, or all that `keep` accepts; a name that is missing is an error."""
    if columns is not None:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise KeyError(f"columns not found: {missing}")
        return list(columns)
    return [f.name for f in df.schema if f.name != ROW_ID and (keep is None or keep(f.dataType))]


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def quoted(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One projection that puts new expressions in the place of columns, and further ones at the end."""
    have = [new[c].alias(c) if c in new else quoted(c) for c in df.columns]
    return df.select(*have, *(e.alias(c) for c, e in new.items() if c not in df.columns))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Not-a-number becomes null in every floating column: the engine knows one kind of missing value."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return replaced(df, {c: F.when(~F.isnan(quoted(c)), quoted(c)) for c in floating}) if floating else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, the setting spark.checkpoint.dir.

    Only where that is unset, as in local tests, is a temporary folder made.
    """
    context, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise CleaningError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cleanloom-"))
    return folder or context.getCheckpointDir()


def scratch(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{spark.sparkContext.applicationId}-{next(_scratch)}"


def stored(df: DataFrame) -> DataFrame:
    """df kept in the shared folder: ids and places drawn from it are the same whenever it is read, on any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_row_id(df: DataFrame, order_by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """df with ROW_ID: by the scan's own order, or by ranges of the given sort order.

    Ids grow with the order but have gaps; no window over the whole table is needed. The upper bits are the number of the
    partition that gave the id. With keep the ids are stored, as operators need that read them more than once.
    """
    if ROW_ID in df.columns:
        return df
    if order_by:
        df = df.orderBy(*(quoted(c) for c in order_by))
    df = df.withColumn(ROW_ID, F.monotonically_increasing_id())
    return stored(df) if keep else df


def ingest(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """What the plans start from: row ids given and stored, not-a-number turned into null."""
    check_frame(df)
    return with_row_id(nan_to_null(df), order_by, keep=True)


def percent(part: float, whole: float) -> float:
    return round(100 * part / whole, 2) if whole else 0.0


REGISTRY: dict[str, Callable] = {}


def step(name: str, unique: bool = True):
    """Make a table function an operator: checked input, errors="raise" or "coerce", a timed JSON-safe report, a registry entry.

    Under "coerce" a failure returns the input unchanged and a report of status failed. Row counts for the shapes are
    taken only with measure=True, as each costs a job.
    """

    def wrap(f):
        @functools.wraps(f)
        def run(df: DataFrame, *args, errors: str = "raise", measure: bool = False, **options):
            if errors not in ("raise", "coerce"):
                raise ValueError("errors must be 'raise' or 'coerce'")
            began = time.perf_counter()
            shape = lambda d: [d.count() if measure else None, len(data_columns(d))]
            head = {"step": name, "status": "success", "timestamp": datetime.now(timezone.utc).isoformat()}
            try:
                check_frame(df, unique)
                head["input_shape"] = shape(df)
                out, report = f(df, *args, **options)
                head["output_shape"] = shape(out)
            except Exception as e:
                if errors == "raise":
                    raise StepError(f"{name}: {e}") from e
                log.warning("%s failed: %s", name, e)
                out, report = df, {"status": "failed", "error": f"{type(e).__name__}: {e}"}
            return out, json_safe(head | report | {"duration_seconds": round(time.perf_counter() - began, 4)})

        REGISTRY[name] = run
        return run

    return wrap

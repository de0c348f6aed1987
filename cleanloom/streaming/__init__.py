"""Row-wise operators with frozen parameters, for streams as for tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.core import is_text, quoted, replaced
from cleanloom.functions import text as X


def clean_rows(df: DataFrame, fences: dict[str, tuple[float, float]] | None = None, fills: dict[str, object] | None = None, case: str | None = None) -> DataFrame:
    """Null tokens, text form, clipping to given fences and constant fills: one projection without any job.

    It works on a streaming DataFrame as on a batch one, since nothing is learnt from the rows.
    """
    new = {}
    for f in df.schema:
        e = quoted(f.name)
        if is_text(f.dataType):
            e = X.strip(X.squash(X.without_controls(F.when(~X.is_null_token(e), e))))
            e = F.nullif({"lower": F.lower, "upper": F.upper, None: lambda x: x}[case](e), F.lit(""))
        if fences and f.name in fences:
            lo, hi = fences[f.name]
            e = F.when(e.isNotNull(), F.least(F.greatest(e.cast("double"), F.lit(float(lo))), F.lit(float(hi))))
        if fills and f.name in fills:
            e = F.coalesce(e, F.lit(fills[f.name]))
        new[f.name] = e
    return replaced(df, new)

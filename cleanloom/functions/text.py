"""Text expressions; all but three stay in the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The tokens and patterns that results depend on.
NULL_TOKENS = (
    "", "na", "n/a", "n.a.", "#n/a", "#na", "null", "none", "nil", "nan", "not available", "not applicable", "missing", "unknown",
    "undefined", "-", "--", "---", "?", "??", ".", "\\n", "<na>", "<null>", "(blank)",
)
TRUE_TOKENS = ("true", "t", "yes", "y", "1", "1.0", "on", "si", "sim")
FALSE_TOKENS = ("false", "f", "no", "n", "0", "0.0", "off", "nao", "não")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITY = r"(?i)^[+-]?inf(inity)?$"
CURRENCY = "$€£¥₹₽¢₩₪₺R"
EMAIL = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"
URL = r"(?i)^(https?://|www\.)\S+$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
PHONE = r"^\+?\(?\d[\d\s().-]{6,19}$"
DATE_LIKE = r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}$"

_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(c, _EDGES, "")


def squash(c: Column) -> Column:
    """Runs of blanks become one space."""
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def is_null_token(c: Column, extra: tuple[str, ...] = ()) -> Column:
    return F.lower(strip(c)).isin(*sorted({*NULL_TOKENS, *(t.strip().lower() for t in extra)}))


def number_text(c: Column) -> Column:
    """Text of a number without currency signs, thousands separators, blanks, underscores, percent signs and accounting brackets."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), "%+$", ""), r"^\((.+)\)$", "-$1")
    return F.regexp_replace(bare, rf"(?U)[{CURRENCY},_\s]", "")


def parse_number(c: Column, percent_to_fraction: bool = False) -> Column:
    """The number in a text, null where there is none."""
    bare = number_text(c)
    endless = F.when(bare.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    number = F.when(bare.rlike(NUMBER), bare.try_cast("double")).when(bare.rlike(INFINITY), endless)
    return F.when(strip(c).endswith("%"), number / 100).otherwise(number) if percent_to_fraction else number


def parse_boolean(c: Column) -> Column:
    token = F.lower(strip(c))
    return F.when(token.isin(*TRUE_TOKENS), F.lit(True)).when(token.isin(*FALSE_TOKENS), F.lit(False))


_DATES = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/M/d", "MMM d, yyyy", "d MMM yyyy")


def parse_datetime(c: Column, fmt: str | None = None, dayfirst: bool = False) -> Column:
    """The timestamp in a text by the given format, or by an ordered list of common ones."""
    monthly = ("d/M/yyyy", "M/d/yyyy") if dayfirst else ("M/d/yyyy", "d/M/yyyy")
    formats = (fmt,) if fmt else (*_DATES[:4], *monthly, *_DATES[4:])
    text = F.regexp_replace(strip(c), r"(\d{2}:\d{2}:\d{2})\.\d+$", "$1")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats)).cast("timestamp_ntz")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def title(s: pd.Series) -> pd.Series:
    """A capital after every character that is no letter; Spark's initcap looks at blanks only."""
    return s.map(lambda x: None if x is None else x.title())


def match_key(columns: list[Column]) -> Column:
    """Lower case, punctuation as blanks, squeezed, joined: what fuzzy matching compares."""
    part = lambda c: strip(squash(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"(?U)[^\p{L}\p{N}_\s]", " ")))
    return strip(squash(F.concat_ws(" ", *(part(c) for c in columns))))


def token_sorted(key: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(key, " "), lambda t: t != "")), " ")


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence; a row of the recurrence is one integer, a bit for each character of a."""

    def length(x: str, y: str) -> int:
        places: dict[str, int] = {}
        for i, c in enumerate(x):
            places[c] = places.get(c, 0) | 1 << i
        row = full = (1 << len(x)) - 1
        for c in y:
            same = row & places.get(c, 0)
            row = (row + same | row - same) & full
        return len(x) - row.bit_count()

    return pd.Series([length(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def column_name(raw: str, case: str = "snake", max_length: int = 64) -> str:
    """A plain ASCII identifier made of a column's name."""
    text = unicodedata.normalize("NFKD", raw.strip()).encode("ascii", "ignore").decode()
    if case == "snake":
        text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", text)
    text = re.sub(r"_+", "_", re.sub(r"[^0-9A-Za-z]+", "_", text)).strip("_")
    text = {"snake": text.lower(), "lower": text.lower(), "upper": text.upper()}.get(case, text) or "unnamed_column"
    return (f"col_{text}" if text[0].isdigit() else text)[:max_length]

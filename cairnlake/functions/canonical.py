"""Canonical JSON and digests of it: one text for equal documents."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _number(text: str) -> int | float:
    """Numbers that are whole stay as they are written out; others are rounded to six
    places, ties to even, on their exact binary value."""
    plain = format(Decimal(text), "f")
    return round(float(text), 6) if "." in plain else int(plain)


def canonical(text: str | None) -> str | None:
    """Keys in code point order, no blanks, ASCII only; null for what is no JSON."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text, parse_float=_number), sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)
    except (ValueError, ArithmeticError):
        return None


def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical)


def _digest(texts: pd.Series) -> pd.Series:
    return texts.map(canonical).map(lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest())


def canonical_json(column: Column) -> Column:
    """The canonical text of JSON texts."""
    return F.pandas_udf(_canonical, StringType())(column)


def canonical_digest(column: Column) -> Column:
    """SHA-256 of the canonical text, lower-case hex."""
    return F.pandas_udf(_digest, StringType())(column)


def section_digests(records: DataFrame, section: str, column: str) -> DataFrame:
    """(section, n, digest): a digest of each section's records that does not depend on
    their order: the sorted digests of the canonical records, digested."""
    each = records.select(section, canonical_digest(F.col(column)).alias("_d"))
    listed = F.array_sort(F.collect_list("_d"))
    return each.groupBy(section).agg(F.count("*").alias("n"), F.sha2(F.array_join(listed, ","), 256).alias("digest"))


"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.shared import clear_saved, own_dir, saved, shared_dir

__all__ = ["clear_saved", "own_dir", "saved", "shared_dir"]

#: One ASCII space character; words are the runs between them.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: At most so many keys count as hot, so what salted_join broadcasts is bounded.
HOT_KEYS = 5_000
#: Keys of fewer rows are never hot.
LEAST_HOT = 1_000


def salted_join(left: DataFrame, right: DataFrame, keys: str | list[str], count: str, total: int, spread: Column) -> DataFrame:
    """Inner join on ``keys`` that deals the rows of a hot key to many tasks.

    ``right`` has one row a key, whose ``count`` (not returned) is the number of rows
    that ``left`` has of it, of ``total`` in all. A key with more than a
    ``HOT_KEYS``-th of them is hot, so there are at most ``HOT_KEYS``, whose names
    are broadcast; their rows on the left take a salt by ``spread`` and the row
    on the right is repeated once a salt.
    """
    keys = [keys] if isinstance(keys, str) else keys
    most = max(LEAST_HOT, total // HOT_KEYS)
    salts, salt = unused(left, "_salts"), unused(left, "_salt")
    right = right.withColumn(salts, F.ceil(F.col(count) / most).cast("int")).drop(count)
    hot = F.broadcast(right.filter(F.col(salts) > 1).select(*keys, salts))
    # A constant salt for the others keeps the key's own hash in charge.
    dealt = left.join(hot, keys, "left").withColumn(salt, F.coalesce(F.pmod(spread, F.col(salts)), F.lit(0)).cast("int")).drop(salts)
    repeated = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(salts) - 1))).drop(salts)
    return dealt.join(repeated, [*keys, salt]).drop(salt)


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without building them: starts of words in the text."""
    squeezed = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), SPACE + "+", " ")
    body = F.rtrim(squeezed)
    return (F.length(body) - F.length(F.translate(body, " ", ""))).cast("long")


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (compared without case)."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name

"""Exchange of memories with another store: ordered sections out, mapped references in.

A section goes out sorted, in files that follow each other by ranges of its order,
and a footer tells its rows and a sum of their digests. Coming in, every reference
is mapped: to the memory here that says the same, or to a new id; what refers to
nothing is left out and told as a warning.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1"
#: Types that travel in sections of their own.
PROTECTED = ("worldview", "goal")
DIGEST = "decimal(38,0)"


def outgoing(memories: DataFrame, types: list[str] | None = None, since: Column | None = None, until: Column | None = None, show_private: bool = False) -> DataFrame:
    """The memories that leave: active or archived, of unprotected types, in a span of
    time, and without private ones unless these are asked for."""
    some = memories.filter(F.col("status").isin("active", "archived") & ~F.col("type").isin(*PROTECTED))
    some = some if types is None else some.filter(F.col("type").isin(types))
    some = some if show_private else some.filter(F.coalesce("sensitivity", F.lit("")) != "private")
    some = some if since is None else some.filter(F.col("created_at") >= since)
    return some if until is None else some.filter(F.col("created_at") <= until)


def _digest(line: Column) -> Column:
    """A number whose sum over rows does not depend on their order."""
    return F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast(DIGEST)


def export(sections: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """Write each section (table, order) as JSON lines under ``path/name``, in order over
    all its files, and ``path/footer`` with rows and digest per section. The footer is
    written last, so an export that was cut off has none."""
    spark = next(iter(sections.values()))[0].sparkSession
    for name, (df, order) in sections.items():
        ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
        ranged.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{path}/{name}")
    told = [_told(spark, path, name).withColumn("section", F.lit(name)) for name in sections]
    reduce(DataFrame.unionByName, told).withColumn("version", F.lit(VERSION)).coalesce(1).write.mode("overwrite").json(f"{path}/footer")


def _told(spark: SparkSession, path: str, name: str) -> DataFrame:
    lines = spark.read.text(f"{path}/{name}")
    return lines.agg(F.count("*").alias("rows"), F.coalesce(F.sum(_digest(F.col("value"))), F.lit(0)).cast(DIGEST).cast("string").alias("digest"))


def section(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A section as a table; one that is not what its footer tells is refused."""
    footer = spark.read.json(f"{path}/footer", schema="section string, rows long, digest string").filter(F.col("section") == name).first()
    found = _told(spark, path, name).first()
    if footer is None or (footer["rows"], footer["digest"]) != (found["rows"], found["digest"]):
        raise ValueError(f"section {name} is incomplete or was changed")
    return spark.read.schema(schema).json(f"{path}/{name}")


def said(content: Column) -> Column:
    """Content as it is compared: without case and with blanks squeezed; null is none."""
    bare = F.btrim(F.regexp_replace(F.translate(F.lower(content), "\t\n\x0b\x0c\r", "     "), " +", " "))
    return F.nullif(bare, F.lit(""))


@dataclass(frozen=True)
class Imported:
    """``refs`` (ref, id, known): where each reference leads, and whether it was here;
    ``memories`` that are new, under their new ids; ``edges`` with both ends mapped;
    ``warnings`` (section, ref, other, reason)."""

    refs: DataFrame
    memories: DataFrame
    edges: DataFrame
    warnings: DataFrame


def imported(memories: DataFrame, edges: DataFrame, here: DataFrame, batch: str) -> Imported:
    """What an import brings: ``memories`` (ref, content, ..) and ``edges`` (src, dst, ..)
    of another store, into the memories ``here`` (id, content, created_at).

    A memory that says what the earliest one here says leads to that one. Others get
    an id from the name of the ``batch`` and their reference, so a repeated import
    makes no second copy. Memories without a reference or content, and all but one of a
    repeated reference, are told and left out, and so are edges with an end that the
    import does not have.
    """
    first = here.withColumn("_said", said(F.col("content"))).filter("_said is not null").groupBy("_said")
    first = first.agg(F.min_by(F.col("id").cast("string"), F.struct("created_at", F.col("id").cast("string"))).alias("_here"))
    rows = memories.withColumn("ref", F.nullif(F.col("ref").cast("string"), F.lit(""))).withColumn("_said", said(F.col("content")))
    fit = F.col("ref").isNotNull() & F.col("_said").isNotNull()
    bad = rows.filter(~fit).select(F.lit("memories").alias("section"), "ref", F.lit(None).cast("string").alias("other"), F.lit("no reference or content").alias("reason"))
    columns = [c for c in memories.columns if c != "ref"]
    one = rows.filter(fit).groupBy("ref").agg(F.min(F.struct("_said", *columns)).alias("_m"), F.count("*").alias("_n"))
    twice = one.filter("_n > 1").select(F.lit("memories").alias("section"), "ref", F.lit(None).cast("string").alias("other"), F.lit("repeated reference").alias("reason"))
    new_id = F.concat(F.lit(f"{batch}:"), F.substring(F.sha2(F.concat(F.lit(f"{batch}:"), F.col("ref")), 256), 1, 32))
    mapped = one.select("ref", "_m.*").join(first, "_said", "left").withColumn("id", F.coalesce("_here", new_id)).withColumn("known", F.col("_here").isNotNull())
    refs = mapped.select("ref", "id", "known")
    new = mapped.filter("not known").select(F.col("id"), *columns)

    ends = [refs.select(F.col("ref").alias(c), F.col("id").alias(f"_{c}")) for c in ("src", "dst")]
    joined = edges.withColumns({c: F.col(c).cast("string") for c in ("src", "dst")}).join(ends[0], "src", "left").join(ends[1], "dst", "left")
    whole = F.col("_src").isNotNull() & F.col("_dst").isNotNull()
    kept = joined.filter(whole).select(*[F.col(f"_{c}").alias(c) if c in ("src", "dst") else F.col(c) for c in edges.columns])
    reason = F.when(F.col("_src").isNull() & F.col("_dst").isNull(), "both ends are unknown").when(F.col("_src").isNull(), "source is unknown").otherwise("target is unknown")
    lost = joined.filter(~whole).select(F.lit("edges").alias("section"), F.col("src").alias("ref"), F.col("dst").alias("other"), reason.alias("reason"))
    return Imported(refs, new, kept, bad.unionByName(twice).unionByName(lost))

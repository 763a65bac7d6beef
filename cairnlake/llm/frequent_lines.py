"""Line dedup by levelled sorted runs of line hashes.

Documents come in batches. Each batch's lines are hashed and counted, anti-joined
by a merge with the runs (keys that a run already has often enough need no more
counting), and the rest is written as a run of its own, sorted by hash inside
hash buckets, so that runs meet each other and the next batch without being
moved. Whenever a level has ``fanout`` runs, these are compacted to one of the
next level. Lines whose key is frequent at the end go, in every document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.common import own_dir, salted_join, saved, table, unused

LEAST_DOCUMENTS = 10
LEAST_CHARS = 1
BATCHES = 8
FANOUT = 4
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """Array of the \\n-split lines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def digest(text: Column) -> Column:
    """128 bits of SHA-256 as hexadecimal text."""
    return F.substring(F.sha2(text, 256), 1, 32)


def line_digests(text: Column, least_chars: int) -> Column:
    """Digests of the lines' keys in order; null where a key is too short."""

    def of(line: Column) -> Column:
        key = F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)
        return digest(F.when(F.length(key) >= least_chars, key))

    return F.transform(lines_of(text), of)


class LineRuns:
    """Runs of (digest, n) by level, each a bucketed table in the shared folder.

    A key may be in several runs; its counts add up. ``least`` is the count at
    which a key is settled: ``add`` leaves such keys out, so a count is exact
    below it and at least it otherwise.
    """

    def __init__(self, spark: SparkSession, least: int, fanout: int = FANOUT) -> None:
        if fanout < 2:
            raise ValueError("runs are compacted two at a time at least")
        self.spark, self.least, self.fanout = spark, least, fanout
        self.levels: list[list[str]] = []

    def _written(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        run = keys.write.bucketBy(buckets, "digest").sortBy("digest").option("compression", "zstd")
        run.option("path", f"{own_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    @property
    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The ``keys`` (digest, ..) that no run has settled."""
        for run in self.runs:
            keys = keys.join(run.filter(F.col("n") >= self.least).select("digest"), "digest", "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Add a batch's ``keys`` (digest, n) as a run; compact full levels."""
        name, level = self._written(self.fresh(keys.groupBy("digest").agg(F.sum("n").alias("n")))), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            name = self._written(_summed([self.spark.table(x) for x in self.levels[level]]))
            for old in self.levels[level]:
                self.spark.sql(f"DROP TABLE {old}")
            self.levels[level] = []
            level += 1

    def settled(self) -> DataFrame:
        """(digest) of all keys whose counts reach ``least``."""
        if not self.runs:
            return self.spark.createDataFrame([], "digest string")
        return _summed(self.runs).filter(F.col("n") >= self.least).select("digest")


def _summed(runs: list[DataFrame]) -> DataFrame:
    """The runs merged two at a time, on the buckets they share."""
    merged = runs[0]
    for run in runs[1:]:
        n = F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))
        merged = merged.join(run.withColumnRenamed("n", "_n"), "digest", "full").select("digest", n.alias("n"))
    return merged


def drop_frequent_lines(
    docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``docs`` without the lines that many documents share, and with n_lines (of
    the text before) and dropped (numbers of the dropped lines, from 0), which are
    named otherwise where ``docs`` has such names.

    Lines are split at \\n. A line's key is the line without ASCII space at both
    ends and with A-Z in lower case. Keys of at least ``least_chars`` code points in
    at least ``least_documents`` rows lose all their lines, the first ones too; all
    other lines stay as they are, joined by \\n. A key that repeats inside a text
    counts once. Null and empty texts are one empty line, which stays, and a null
    text stays null. Every row counts, also where rows are equal, share a doc_id or
    have none. An empty table gives no rows. Texts are taken whole: all lines of
    one are in one row, with 32 bytes of digest each.
    """
    spark = docs.sparkSession
    th, n_lines, dropped = (unused(docs, stem) for stem in ("_text", "n_lines", "dropped"))
    docs = docs.withColumn(th, digest(F.coalesce("text", F.lit(""))))
    # Equal texts have equal lines: each is looked at once, with its number of rows.
    texts = docs.select(F.col(th).alias("th"), line_digests(F.col("text"), least_chars).alias("digests"))
    texts = texts.groupBy("th").agg(F.first("digests").alias("digests"), F.count("*").alias("copies"))
    texts = saved(texts.withColumn("batch", F.pmod(F.xxhash64("th"), F.lit(batches)).cast("int")), "lines", by="batch")

    runs = LineRuns(spark, least_documents, fanout)
    for k in range(batches):
        once = texts.filter(F.col("batch") == k).select(F.explode(F.array_distinct("digests")).alias("digest"), "copies")
        runs.add(once.filter("digest is not null").groupBy("digest").agg(F.sum("copies").alias("n")))
    settled = runs.settled()

    each = texts.select("th", F.posexplode("digests").alias("line", "digest")).filter("digest is not null")
    rows = saved(each.groupBy("digest").agg(F.count("*").alias("rows")).join(settled, "digest", "left_semi"), "lines-frequent")
    sizes = texts.agg(F.sum(F.size("digests")), F.sum("copies")).first()
    gone = salted_join(each, rows, "digest", "rows", sizes[0] or 0, F.xxhash64("th", "line"))
    gone = gone.groupBy("th").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    marks = texts.select("th", "copies", F.size("digests").cast("long").alias("n")).join(gone, "th", "left")
    marks = marks.select(F.col("th").alias(th), "copies", F.struct("n", F.coalesce("gone", F.array().cast("array<int>")).alias("gone")).alias(dropped))

    spread = F.xxhash64(F.monotonically_increasing_id())
    given = docs.withColumnRenamed("copies", "_copies") if "copies" in docs.columns else docs
    out = salted_join(given, marks, th, "copies", sizes[1] or 0, spread)
    return _cut(out, docs.drop(th).columns, given.drop(th).columns, n_lines, dropped)


def _cut(out: DataFrame, names: list[str], columns: list[str], n_lines: str, dropped: str) -> DataFrame:
    lines = unused(out, "_lines")
    out = out.withColumn(lines, lines_of(F.col("text")))
    gone = F.col(dropped)["gone"]
    # Stretches between dropped lines.
    begins = F.concat(F.array(F.lit(0)), F.transform(gone, lambda x: x + 1))
    ends = F.concat(gone, F.array(F.size(lines)))
    kept = F.array_join(F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(F.col(lines), a + 1, b - a))), "\n")
    text = F.when(F.size(gone) > 0, kept).otherwise(F.col("text"))
    shown = [(text if c == "text" else F.col(c)).alias(name) for c, name in zip(columns, names, strict=True)]
    return out.select(*shown, F.col(dropped)["n"].alias(n_lines), gone.alias(dropped))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), kept)


def op13_sql() -> str:
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, doc_id, string_split(text, chr(10)) AS lines FROM d),
line AS (SELECT r, doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS x FROM split),
keyed AS (SELECT *, translate(trim(x, {blanks}), '{UPPER}', '{LOWER}') AS k FROM line),
frequent AS (SELECT k FROM keyed WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
marked AS (SELECT a.*, f.k IS NOT NULL AS gone FROM keyed a LEFT JOIN frequent f ON a.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

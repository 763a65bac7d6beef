"""Filters and joins that relational engines have no single word for."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.shared import saved

#: Ids of a block, pairs of a task, and tasks that the pairs of frequent values are dealt to.
BLOCK, TASK_PAIRS, MOST_TASKS = 128, 1 << 25, 10_000


def optional(**wanted: object) -> Column:
    """All columns that have a wanted value have it; ``None`` asks for nothing."""
    return reduce(and_, [F.col(name) == value for name, value in wanted.items() if value is not None], F.lit(True))


def json_holds(column: Column, wanted: dict) -> Column:
    """Whether the JSON text has all of ``wanted`` (nested objects, lists of scalars, scalars)."""

    def holds(path: str, value: object) -> Column:
        if isinstance(value, dict):
            return reduce(and_, [holds(f"{path}.{k}", v) for k, v in value.items()], F.get_json_object(column, path).startswith("{"))
        found = F.get_json_object(column, path)
        if isinstance(value, list):
            items = F.from_json(found, "array<string>")
            return reduce(and_, [F.array_contains(items, _text(v)) for v in value], found.startswith("["))
        return found == _text(value)

    return F.coalesce(holds("$", wanted), F.lit(False))


def _text(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def json_has(column: Column, key: str) -> Column:
    """Whether the JSON object has the key, whatever its value is, null too."""
    return F.coalesce(F.array_contains(F.json_object_keys(column), key), F.lit(False))


def like_any(column: Column, prefixes: list[str]) -> Column:
    return reduce(or_, [column.startswith(p) for p in prefixes], F.lit(False))


def ranges_meet(low: Column, high: Column, other_low: Column | None, other_high: Column | None) -> Column:
    """Whether the closed ranges share a point; an end that is ``None`` is open."""
    out = F.lit(True)
    out = out if other_low is None else out & (high >= other_low)
    return out if other_high is None else out & (low <= other_high)


def not_private(sensitivity: Column, exclude: bool = True) -> Column:
    """Rows that may be shown; rows without a sensitivity may."""
    return F.coalesce(sensitivity, F.lit("")) != "private" if exclude else F.lit(True)


def any_key_join(rows: DataFrame, keys: DataFrame, row_id: str, by: dict[str, str]) -> DataFrame:
    """Pairs (row_id, key_id) where any of the columns named in ``by`` (of ``rows``: of
    ``keys``) are equal: a union of equi-joins, each pair once.

    A pair is given by the first column that joins it, and by the least value that its
    ids share there, so pairs are neither shuffled nor compared with each other. Values
    with many pairs are joined by blocks of ids, whose pairs are dealt to tasks.
    """
    mine, theirs = _sets(rows, row_id, "_id", list(by)), _sets(keys, "key_id", "_k", list(by.values()))
    pairs = [pairs for i in range(len(by)) for pairs in _joined(_taken(mine, theirs, i), theirs.withColumn("_v", F.explode(F.col("_s")[i])), i)]
    return reduce(DataFrame.unionByName, pairs).select(F.col("_id").alias(row_id), F.col("_k").alias("key_id"))


def _sets(df: DataFrame, id_col: str, name: str, columns: list[str]) -> DataFrame:
    """An id's values (as text) in each of the columns: ``_s``, an array of sets."""
    values = df.select(F.col(id_col).alias(name), *[F.col(c).cast("string").alias(f"_s{i}") for i, c in enumerate(columns)])
    sets = values.groupBy(name).agg(*[F.collect_set(f"_s{i}").alias(f"_s{i}") for i in range(len(columns))])
    return saved(sets.select(name, F.array(*[f"_s{i}" for i in range(len(columns))]).alias("_s")), "any-key")


def _taken(mine: DataFrame, theirs: DataFrame, i: int) -> DataFrame:
    """A row per id and value of column i. ``_m``, the id's sets, is null where none of its
    pairs can be met twice: it has no other value, and no key has its earlier values."""
    twice, earlier = F.size(F.col("_s")[i]) > 1, [F.col("_s")[j] for j in range(i)]
    rows = mine.filter(F.size(F.col("_s")[i]) > 0)
    for j, values in enumerate(earlier):
        known = theirs.select(F.explode(F.col("_s")[j]).alias(f"_w{j}")).distinct().withColumn(f"_known{j}", F.lit(True))
        rows = rows.withColumn(f"_w{j}", F.get(values, F.lit(0))).join(known, f"_w{j}", "left")
        twice = twice | (F.size(values) > 1) | F.col(f"_known{j}").isNotNull()
    return rows.select("_id", F.explode(F.col("_s")[i]).alias("_v"), F.when(twice, F.col("_s")).alias("_m"))


def _joined(left: DataFrame, right: DataFrame, i: int) -> list[DataFrame]:
    """Pairs (_id, _k) of one value of column i that no earlier column or lesser value gives."""
    m, t, plain = F.col("_m"), F.col("_s"), F.col("_m").isNull().alias("_plain")

    def shared(j: int) -> Column:
        single = (F.size(m[j]) == 1) & (F.size(t[j]) == 1)
        return F.when(single, F.get(m[j], F.lit(0)) == F.get(t[j], F.lit(0))).otherwise(F.arrays_overlap(m[j], t[j]))

    least = (F.size(m[i]) == 1) | (F.size(t[i]) == 1) | (F.col("_v") == F.array_min(F.array_intersect(m[i], t[i])))
    first = m.isNull() | reduce(and_, [~shared(j) for j in range(i)], least)

    counts = left.groupBy("_v", plain).agg(F.count("*").alias("_rows")).join(right.groupBy("_v").agg(F.count("*").alias("_keys")), "_v")
    frequent = saved(counts.filter(F.col("_rows") * F.col("_keys").cast("double") > BLOCK * BLOCK), "any-key-values")
    n_pairs = {r["_plain"]: r["n"] for r in frequent.groupBy("_plain").agg(F.sum(F.col("_rows") * F.col("_keys").cast("double")).alias("n")).collect()}
    if not n_pairs:
        return [left.join(right, "_v").filter(first).select("_id", "_k")]
    rest = left.withColumn("_plain", plain).join(frequent, ["_v", "_plain"], "left_anti")
    out = [rest.join(right, "_v").filter(first).select("_id", "_k")]
    for one, n in n_pairs.items():
        asked = frequent.filter(F.col("_plain") == one)
        rows, held = left.filter(m.isNull() == one), [] if one else ["_m"]
        x = _blocks(rows, asked, "_rows", "_id", held).withColumnsRenamed({"_block": "_i", "_of": "_x"})
        y = _blocks(right, asked, "_keys", "_k", [] if one else ["_s"]).withColumnsRenamed({"_block": "_j", "_of": "_y"})
        # Dealt by number: the size of two blocks says little of the work on their pairs.
        dealt = x.join(y, "_v").repartition(min(MOST_TASKS, int(n // TASK_PAIRS) + 1), "_v", "_i", "_j")
        if one:
            out.append(dealt.select(F.explode("_x").alias("_id"), "_y").select("_id", F.explode("_y").alias("_k")))
        else:
            out.append(dealt.select("_v", F.inline("_x"), "_y").select("_v", "_id", "_m", F.inline("_y")).filter(first).select("_id", "_k"))
    return out


def _blocks(df: DataFrame, asked: DataFrame, count: str, id_col: str, held: list[str]) -> DataFrame:
    """The ids of each value asked for, in blocks of about ``BLOCK``, with the columns held."""
    block = F.pmod(F.xxhash64(id_col), F.ceil(F.col(count) / BLOCK)).alias("_block")
    ids = F.collect_list(F.struct(id_col, *held))
    if not held:
        # Lists leave out nulls, and an id may be null.
        ids = F.when(F.count_if(F.col(id_col).isNull()) > 0, F.array_append(F.collect_list(id_col), F.lit(None))).otherwise(F.collect_list(id_col))
    return df.join(asked.select("_v", count), "_v").groupBy("_v", block).agg(ids.alias("_of"))


def guarded_cast_join(left: DataFrame, text_key: str, right: DataFrame, key: str) -> DataFrame:
    """Join a text column that may hold anything to a number: other texts match nothing."""
    number = F.when(F.col(text_key).rlike(r"^[0-9]{1,18}$"), F.col(text_key)).cast("long")
    return left.withColumn("_n", number).join(right.withColumnRenamed(key, "_n"), "_n").withColumnRenamed("_n", key)


def member_join(lists: DataFrame, list_col: str, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``lists`` with each row of ``right`` whose key is in their array (once)."""
    each = lists.withColumn(key, F.explode(F.array_distinct(list_col)))
    return each.join(right, key)


def pairs_within(rows: DataFrame, group: str, at: str, reach: float, id_col: str = "id") -> DataFrame:
    """Pairs (a, b), a < b, of rows of a group whose ``at`` differ by ``reach`` at most.

    Rows are dealt to cells of that length and meet those of their own and the
    next cell, so no group is paired with itself as a whole.
    """
    cell = F.floor(F.col(at) / reach).cast("long")
    rows = rows.select(F.col(id_col).alias("a"), F.col(group).alias("_g"), F.col(at).alias("_x"), cell.alias("_cell"))
    other = rows.select(F.col("a").alias("b"), "_g", F.col("_x").alias("_y"), F.explode(F.array(F.col("_cell"), F.col("_cell") - 1)).alias("_cell"))
    met = rows.join(other, ["_g", "_cell"]).filter((F.col("a") != F.col("b")) & (F.abs(F.col("_x") - F.col("_y")) <= reach))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def json_items(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """A row per element of a JSON array of scalars, with its place from 1."""
    items = F.from_json(column, "array<string>")
    return df.select(*keep, F.posexplode(items).alias("ord", "item")).withColumn("ord", F.col("ord") + 1)


def json_pairs(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """A row per key and value (as text) of a JSON object; JSON null is null."""
    return df.select(*keep, F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))


def sampled(df: DataFrame, key: str, share: float, seed: int = 7) -> DataFrame:
    """A share of the rows by a hash of the key: the same rows in every run."""
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < share * float(1 << 30))

"""Quality rules: learned decision lists over text statistics.

Statistics of the text are Spark expressions inside one row (no shuffle).
Labelled rows are binned at data quantiles. Sequential covering grows threshold
conjunctions condition by condition: Spark counts the rows that the rule so far
covers per statistic and bin, a few hundred numbers, which say what each further
condition would cover. Rules are pruned on rows they did not grow on, and the
result is one ordered conditional expression that Spark evaluates on every row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.common import SPACE, saved, table, words

#: Ratios that rules may test, by name; each is a function of the statistics.
FEATURES = ("symbols_per_word", "dup_lines_per_line", "repeat_per_word", "chars_per_word", "upper_per_char", "marks_per_word")


@dataclass(frozen=True)
class Rule:
    """Reject where all (feature, '>' or '<=', threshold) hold."""

    conditions: tuple[tuple[str, str, float], ...]
    rejected: int
    wrongly: int


def _covered(positions: Column, size: int) -> Column:
    """Words under windows of ``size`` that start at the sorted positions."""
    after = F.slice(positions, 2, F.greatest(F.size(positions), F.lit(1)))
    steps = F.zip_with(positions, after, lambda a, b: F.least(F.lit(size), F.coalesce(b - a, F.lit(size))))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


def text_statistics(docs: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and
    the counts ``n_lines, n_upper, n_marks``, all long; null text counts as empty.

    Repeated windows are found by hash first; where any hash repeats, the
    windows themselves are compared, so the count is exact.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_words", words(F.col(text_col))).withColumn("_lines", lines)
    bare = F.regexp_replace(text, SPACE, "")
    out = out.select(
        *docs.columns,
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (F.length(text) - F.length(F.translate(text, "!?", ""))).cast("long").alias("n_marks"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    at = lambda name, i, k: F.get(F.col(name), i + k)
    starts = F.when(F.col("n_words") >= window, F.sequence(F.lit(0), (F.col("n_words") - window).cast("int"))).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_starts", starts)
    out = out.withColumn("_keys", F.transform("_starts", lambda i: F.xxhash64(*[at("_hashes", i, k) for k in range(window)])))
    # Only a text in which a hash occurs again has its windows themselves sorted.
    again = F.size("_keys") > F.size(F.array_distinct("_keys"))
    pairs = F.transform("_starts", lambda i: F.struct(F.concat_ws(" ", *[at("_words", i, k) for k in range(window)]).alias("w"), i.alias("i")))
    out = out.withColumn("_sorted", F.when(again, F.sort_array(pairs)))
    same = lambda x, j: F.coalesce(F.get(F.col("_sorted"), j)["w"] == x["w"], F.lit(False))
    out = out.withColumn("_marked", F.transform("_sorted", lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])))
    out = out.withColumn("_at", F.sort_array(F.filter("_marked", lambda x: x.isNotNull())))
    out = out.withColumn("n_repeat_words", F.coalesce(_covered(F.col("_at"), window), F.lit(0)).cast("long"))
    return out.drop("_words", "_hashes", "_starts", "_keys", "_sorted", "_marked", "_at")


def features(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns(
        {
            "symbols_per_word": F.col("n_symbols") / n,
            "dup_lines_per_line": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_per_word": F.col("n_repeat_words") / n,
            "chars_per_word": F.col("word_chars") / n,
            "upper_per_char": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
            "marks_per_word": F.col("n_marks") / n,
        }
    )


def _gain(p0: float, n0: float, p1: float, n1: float) -> float:
    if p1 <= 0:
        return 0.0
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


#: A condition on binned statistics: the statistic is above ('>') or not above
#: ('<=') its cut of that number.
Test = tuple[str, str, int]


def _holds(test: Test) -> Column:
    name, op, cut = test
    return F.col(name) > cut if op == ">" else F.col(name) <= cut


def _all_hold(rule: list[Test]) -> Column:
    return reduce(and_, map(_holds, rule), F.lit(True))


def _histograms(rows: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """(bad, good) rows per statistic and bin."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("bin")) for f in FEATURES])).alias("x")
    counts = rows.select(each, "bad").groupBy("x.name", "x.bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n"))
    return {(r["name"], r["bin"]): (r["p"], r["n"]) for r in counts.collect()}


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]], rule: list[Test]) -> tuple[float, Test | None, tuple[int, int]]:
    """The condition with the most information gain, its gain, and (bad, good) of
    the rows that are covered without it."""
    seen = _histograms(rows)
    total = tuple(sum(x[k] for (f, _), x in seen.items() if f == FEATURES[0]) for k in (0, 1))
    best: tuple[float, Test | None] = (0.0, None)
    for f in FEATURES:
        for cut in range(len(cuts[f])):
            above = tuple(sum(x[k] for (g, bin), x in seen.items() if g == f and bin > cut) for k in (0, 1))
            for op, (p, n) in ((">", above), ("<=", (total[0] - above[0], total[1] - above[1]))):
                if (f, op, cut) not in rule and (gain := _gain(*total, p, n)) > best[0]:
                    best = gain, (f, op, cut)
    return *best, total


def learn_rules(labelled: DataFrame, label_col: str, bad_value: int = 0, bins: int = 8, max_rules: int = 8, max_conditions: int = 3, least_precision: float = 0.9, min_rows: int = 5) -> list[Rule]:
    """Sequential covering over labelled rows with ``FEATURES``.

    All labelled rows count. Two thirds of them (by hash of the statistics) grow
    a rule by the information gain of each added condition, the rest prune it; a
    rule stays if, over both, ``least_precision`` of what it newly rejects is bad.
    Ties go to the statistic that is named first and the lower cut. At most
    ``max_rules`` rules of ``max_conditions`` conditions are learned. Each step
    sends at most (bins + 3) numbers a statistic to the driver, however many rows
    there are. No labelled rows: no rules.
    """
    part = F.pmod(F.xxhash64(*FEATURES), F.lit(3)) == 0
    known = labelled.filter(F.col(label_col).isNotNull())
    grid = [i / bins for i in range(1, bins)] + [1 - 1 / (bins * 4)]
    bad = F.col(label_col) == bad_value
    first = known.agg(*[F.percentile_approx(f, grid, 2000).alias(f) for f in FEATURES], *[F.percentile_approx(F.when(bad, F.col(f)), [0.1, 0.5], 2000).alias(f"bad_{f}") for f in FEATURES]).first()
    cuts = {f: sorted({round(float(x), 9) for x in [*(first[f] or []), *(first[f"bad_{f}"] or [])]}) for f in FEATURES}
    coded = [reduce(add, [(F.col(f) > c).cast("int") for c in cuts[f]], F.lit(0)).alias(f) for f in FEATURES]
    left = saved(known.select(*coded, part.alias("prune"), bad.alias("bad")), "quality-labelled")

    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule: list[Test] = []
        while len(rule) < max_conditions:
            _, best, (p, n) = _best_condition(left.filter(~F.col("prune") & _all_hold(rule)), cuts, rule)
            if best is None or not p or not n:
                break
            rule.append(best)
        if not rule:
            break
        # Counts of every beginning of the rule, over all rows and those that prune.
        begun = [F.struct(*[F.count_if(_all_hold(rule[:k]) & (F.col("bad") == is_bad) & some).alias(name) for name, is_bad, some in (("p", True, F.lit(True)), ("n", False, F.lit(True)), ("pp", True, F.col("prune")), ("pn", False, F.col("prune")))]).alias(f"k{k}") for k in range(1, len(rule) + 1)]
        found = left.agg(*begun).first()
        worth = lambda k: (found[f"k{k}"]["pp"] - found[f"k{k}"]["pn"]) / (found[f"k{k}"]["pp"] + found[f"k{k}"]["pn"]) if found[f"k{k}"]["pp"] + found[f"k{k}"]["pn"] else -1.0
        k = len(rule)
        while k > 1 and worth(k - 1) >= worth(k):
            k -= 1
        rule, p, n = rule[:k], found[f"k{k}"]["p"], found[f"k{k}"]["n"]
        if p < min_rows or p < least_precision * (p + n):
            break
        rules.append(Rule(tuple((f, op, cuts[f][c]) for f, op, c in rule), p, n))
        left = left.filter(~_all_hold(rule))
    return rules


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(kept, number of the rule that decided, from 1; 0: none)."""
    cond = lambda r: reduce(and_, [(F.col(f) > t) if op == ">" else (F.col(f) <= t) for f, op, t in r.conditions])
    kept, number = None, None
    for i, r in enumerate(rules, 1):
        kept = F.when(cond(r), F.lit(False)) if kept is None else kept.when(cond(r), F.lit(False))
        number = F.when(cond(r), F.lit(i)) if number is None else number.when(cond(r), F.lit(i))
    if kept is None:
        return F.lit(True), F.lit(0)
    return kept.otherwise(F.lit(True)), number.otherwise(F.lit(0))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """Rows of ``docs`` (doc_id, text) with statistics, base verdict and ``kept``.

    Null or empty text has no words and fails the base rule. Repeated rows are
    judged one by one, alike. Labels with a null doc_id or quality teach
    nothing; a document labelled twice counts twice, and rows that share a doc_id
    all take its label. An empty table gives no rows; other columns are not read.
    A text is one row of one task with some hundred bytes a word.
    """
    stats = features(saved(text_statistics(docs.select("doc_id", "text")).drop("text"), "quality-stats"))
    taught = stats.filter(~base_failed()).join(labels.select("doc_id", "quality"), "doc_id")
    rules = learn_rules(taught, "quality")
    kept, number = verdict(rules)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & kept).withColumn("rule", number), rules


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")

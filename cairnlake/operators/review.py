"""Status reports, change decisions, claims without deeds, and answer scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.scoring import clamp
from cairnlake.functions.text import tokens
from cairnlake.operators.temporal import counted_within


def task_status(runs: DataFrame) -> DataFrame:
    """(task_type, latest_status, last_success, failures_since, running) of runs
    (run_id, task_type, status, started_at, finished_at): the last success first,
    a small table, then one pass over the runs."""
    done = runs.groupBy("task_type").agg(F.max(F.when(F.col("status") == "completed", F.col("finished_at"))).alias("last_success"))
    missed = (F.col("status") == "failed") & (F.col("last_success").isNull() | (F.col("started_at") > F.col("last_success")))
    return runs.join(done, "task_type").groupBy("task_type").agg(
        F.max_by("status", F.struct("started_at", "run_id")).alias("latest_status"), F.max("last_success").alias("last_success"),
        F.count_if(missed).alias("failures_since"), F.count_if(F.col("status") == "running").alias("running"),
    )


def outcome_scores(signals: DataFrame, key: str) -> DataFrame:
    """(key, score, tier) of signals (key, kind, amount): counts are capped, so
    many small deeds do not outweigh a few kinds of them."""
    n = lambda kind: F.least(F.count_if(F.col("kind") == kind), F.lit(2))
    liked = F.least(F.coalesce(F.sum(F.when(F.col("kind") == "user_feedback", F.col("amount"))), F.lit(0.0)), F.lit(1.0))
    score = n("durable_memory") * 0.35 + n("contradiction_resolved") * 0.5 + n("goal_advanced") * 0.3 + liked * 0.5
    tier = F.when(F.col("score") >= 1.0, "high_value").when(F.col("score") > 0, "useful").otherwise("none")
    return signals.groupBy(key).agg(score.alias("score")).withColumn("tier", tier)


def change_decisions(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(key, change, delta) of the rows of ``new`` whose change is to be told.

    Both are (key, status, contradictions, sources, confidence, trust,
    importance). The first rule that holds decides: new rows, status, more
    contradictions, more sources, then confidence, trust and importance by at
    least 0.1, 0.1 and 0.15.
    """
    o = old.select(key, *[F.col(c).alias(f"_{c}") for c in old.columns if c != key], F.lit(True).alias("_held"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    moved = lambda c: F.abs(none(c) - none(f"_{c}"))
    sure = F.abs(F.col("confidence") - F.col("_confidence"))
    rules = [
        (F.col("_held").isNull() & (none("contradictions") > 0), "contradiction", None), (F.col("_held").isNull(), "new_evidence", None),
        (~F.col("status").eqNullSafe(F.col("_status")), "status_change", None), (none("contradictions") > none("_contradictions"), "contradiction", None),
        (none("sources") > none("_sources"), "new_evidence", None), (sure >= 0.1, "confidence_change", sure),
        (moved("trust") >= 0.1, "confidence_change", moved("trust")), (moved("importance") >= 0.15, "importance_change", moved("importance")),
    ]
    change = F.coalesce(*[F.when(c, F.struct(F.lit(n).alias("change"), (F.lit(None) if d is None else d).cast("double").alias("delta"))) for c, n, d in rules])
    return new.join(o, key, "left").select(key, change.alias("_c")).filter("_c is not null").select(key, "_c.change", "_c.delta")


def unsupported_claims(turns: DataFrame, deeds: DataFrame, claims: dict[str, str], denial: str, id_col: str = "id", content: str = "text") -> DataFrame:
    """(id, tool, sentence): sentences that claim the use of a tool, do not deny
    or only promise it, and have no such deed (id, tool)."""
    each = turns.select(F.col(id_col).alias("id"), F.explode(F.split(F.coalesce(F.col(content), F.lit("")), r"[.!?\n]+")).alias("sentence"))
    each = each.select("id", F.btrim("sentence").alias("sentence")).filter(~F.rlike(F.lower("sentence"), F.lit(denial)))
    told = F.filter(F.array(*[F.when(F.rlike(F.lower("sentence"), F.lit(p)), F.lit(t)) for t, p in claims.items()]), lambda x: x.isNotNull())
    return each.select("id", F.explode(told).alias("tool"), "sentence").join(deeds.select("id", "tool"), ["id", "tool"], "left_anti")


def answer_scores(answers: DataFrame, dimension: str = "dimension", given: str = "given", wanted: str = "wanted") -> DataFrame:
    """(dimension, score): mean F1 of the token sets, by dimension."""
    a, b = F.array_distinct(tokens(F.col(given))), F.array_distinct(tokens(F.col(wanted)))
    all_of = F.size(a) + F.size(b)
    f1 = F.when(all_of > 0, 2.0 * F.size(F.array_intersect(a, b)) / all_of).otherwise(1.0)
    return answers.select(dimension, f1.alias("f1")).groupBy(dimension).agg(F.avg("f1").alias("score"))


def alignment(edges: DataFrame) -> DataFrame:
    """(node, alignment) of edges (src, dst, rel, weight) that lead to held views:
    weights of supporting less contradicting ones by their sum, -1 to 1, for the
    node they leave. Pass the edges to other nodes too and they would count."""
    w = lambda rel: F.sum(F.when(F.col("rel") == rel, F.col("weight")).otherwise(0.0))
    both = w("SUPPORTS") + w("CONTRADICTS")
    return edges.groupBy(F.col("src").alias("node")).agg(F.when(both > 0, clamp((w("SUPPORTS") - w("CONTRADICTS")) / both, -1.0, 1.0)).otherwise(0.0).alias("alignment"))


def trust_distribution(rows: DataFrame, kind: str, trust: Column, low: float = 0.5) -> DataFrame:
    """Per kind: rows, distinct trust to two places, rows of low trust, least, most and mean."""
    return rows.withColumn("_t", trust).groupBy(kind).agg(
        F.count("*").alias("n"), F.count_distinct(F.round("_t", 2)).alias("levels"), F.count_if(F.col("_t") < low).alias("low"), F.min("_t").alias("least"), F.max("_t").alias("most"), F.avg("_t").alias("mean"),
    )


def running_totals(log: DataFrame, key: str, ts: str, window_seconds: int, most: int) -> DataFrame:
    """Adds ``notify``: no more than ``most`` log rows of the key came in the window
    that ends with this one. Rows are never dropped."""
    return counted_within(log, key, ts, window_seconds, "_in_window").withColumn("notify", F.col("_in_window") <= most).drop("_in_window")

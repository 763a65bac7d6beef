"""Ledgers and health reports over what was sent, connected and spent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlake.operators.reports import meta, outcome_multiplier


def heartbeat_health(states: DataFrame, memories: DataFrame, calls: DataFrame, as_of: Column) -> DataFrame:
    """A row per instance of ``states`` (instance, beats, energy, last_at, next_at, paused),
    with what holds for all: active and queued goals, pending ``calls`` (status), the mean
    change of energy and the times the agent reached out in the last 24 hours of episodes."""
    live = memories.filter("status = 'active'")
    goal = (F.col("type") == "goal") & (F.col("status") == "active")
    late = (F.col("type") == "episodic") & meta("context.heartbeat_id").isNotNull() & (F.unix_micros("created_at") > F.unix_micros(as_of) - 86_400_000_000)
    change = meta("context.energy_end", "double") - meta("context.energy_start", "double")
    reached = F.exists(F.from_json(meta("context.actions_taken"), "array<string>"), lambda a: F.startswith(a, F.lit("reach_out")))
    counts = live.agg(
        F.count_if(goal & (meta("priority") == "active")).alias("active_goals"), F.count_if(goal & (meta("priority") == "queued")).alias("queued_goals"),
        F.avg(F.when(late, change)).alias("energy_change_24h"), F.count_if(F.coalesce(late & reached, F.lit(False))).alias("reach_outs_24h"),
    )
    pending = calls.filter("status = 'pending'").agg(F.count("*").alias("pending_calls"))
    # Two rows of sums beside the instances.
    return states.join(F.broadcast(counts.join(pending, F.lit(True))), F.lit(True))


def economy_status(states: DataFrame, outcomes: DataFrame, reserve: float = 20.0, bank_share: float = 1.5) -> DataFrame:
    """Per instance: energy, reserve, capacity of the bank, the latest ended outcome
    (instance, status, score, completed_at) and the rate at which energy comes back next."""
    ended = outcomes.filter(F.col("status").isin("completed", "error")).groupBy("instance")
    latest = ended.agg(F.max(F.struct(F.coalesce("completed_at", F.lit("0001-01-01").cast("timestamp")).alias("at"), "status", "score")).alias("_o"))
    both = states.join(latest, "instance", "left")
    rate = F.coalesce(outcome_multiplier(F.col("_o.score")), F.lit(1.0))
    return both.select(
        "instance", F.col("energy").alias("current_energy"), F.lit(reserve).alias("reserve_energy"), F.lit(reserve * bank_share).alias("bank_capacity"),
        F.col("_o.status").alias("latest_status"), F.col("_o.score").alias("latest_score"), rate.alias("next_regen_multiplier"),
    )


def grouped_counts(parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(part, key, count): counts of each table by its columns, keys as JSON; of every
    table one aggregation, whose groups are few."""
    out = None
    for name, (df, columns) in parts.items():
        key = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        one = df.groupBy(*columns).agg(F.count("*").alias("count")).select(F.lit(name).alias("part"), key.alias("key"), "count")
        out = one if out is None else out.unionByName(one)
    return out


def connector_cognition(items: DataFrame, progress: DataFrame, claims: DataFrame, labels: DataFrame, connector: str | None = None, account: str | None = None) -> DataFrame:
    """What was learned from connected sources: ``progress`` (item_id, status) and ``labels``
    (item_id, label, status) by connector and account of their ``items`` (id, connector,
    account), and ``claims`` (review_status, status); (part, key, count)."""
    some = items if connector is None else items.filter(F.col("connector") == connector)
    some = some if account is None else some.filter(F.col("account") == account)
    named = some.select(F.col("id").alias("item_id"), "connector", "account")
    return grouped_counts({
        "progress": (progress.join(named, "item_id"), ["connector", "account", "status"]), "importance": (labels.join(named, "item_id"), ["connector", "account", "label", "status"]),
        "review": (claims, ["review_status", "status"]), "claims": (claims.filter("status = 'active'"), ["status"]),
    })


def outbound_ledger(events: DataFrame, budgets: DataFrame, controls: DataFrame, most: int = 100, entity: str | None = None) -> DataFrame:
    """(entity, part, at, rank, body): the latest ``most`` contacts, up to 500, and the
    budgets and controls of those they are about, or of one ``entity``; each table is
    (entity, at, ..) and its other columns become JSON."""

    def told(df: DataFrame, part: str, limit: int | None = None) -> DataFrame:
        some = df if entity is None else df.filter(F.col("entity") == entity)
        some = some if limit is None else some.orderBy(F.desc("at"), "id").limit(limit)
        body = F.to_json(F.struct(*[c for c in df.columns if c not in ("entity", "at")]))
        return some.select("entity", F.lit(part).alias("part"), "at", F.col("id").alias("_id"), body.alias("body"))

    late = told(events, "event", min(max(most, 1), 500))
    about = late.select("entity").distinct()
    rest = [told(df, part).join(F.broadcast(about), "entity", "left_semi") for df, part in ((budgets, "budget"), (controls, "control"))]
    rows = late.unionByName(rest[0]).unionByName(rest[1])
    # A few hundred contacts, and what there is about their entities.
    order = W.partitionBy("part").orderBy(F.desc("at"), "_id")
    return rows.withColumn("rank", F.row_number().over(order)).drop("_id")


def integration_status(connectors: DataFrame, connections: DataFrame, attempts: DataFrame, connector: str | None = None, recent: int = 20) -> DataFrame:
    """A row per connector (id, name, status): its live connections (connector, account,
    status, last_error, updated_at), the latest of them, how many have an error, and its
    latest ``recent`` attempts (connector, status, at) by status."""
    one = connectors if connector is None else connectors.filter(F.col("id") == connector)
    live = connections.groupBy(F.col("connector").alias("id")).agg(
        F.count_if(F.col("status") == "connected").alias("connected"), F.count_if(F.col("last_error").isNotNull()).alias("failing"),
        F.max_by("account", F.struct("updated_at", "account")).alias("latest_account"),
    )
    tried = attempts.withColumn("_r", F.row_number().over(W.partitionBy("connector").orderBy(F.desc("at"), "status"))).filter(F.col("_r") <= recent)
    tried = tried.groupBy(F.col("connector").alias("id"), "status").agg(F.count("*").alias("n")).groupBy("id")
    tried = tried.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))).alias("attempts"))
    out = one.join(live, "id", "left").join(tried, "id", "left")
    zero = F.lit(0).cast("long")
    return out.select("id", "name", "status", F.coalesce("connected", zero).alias("connected"), F.coalesce("failing", zero).alias("failing"), "latest_account", F.coalesce("attempts", F.lit("{}")).alias("attempts"))

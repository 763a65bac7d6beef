"""Status reports as DataFrames: goals, episodes, drives, queues, workers, ledgers.

Rows of ``memories`` have id, type, status, content, importance, created_at and
``metadata`` (JSON text), and more where a report says so. Times are compared
with an explicit reference time. Reports of one row are aggregates that combine
on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlake.functions.scoring import clamp, strength


def meta(path: str, kind: str = "string", column: str = "metadata") -> Column:
    """A value of the JSON text, null if it is missing, JSON null or not of that kind."""
    return F.get_json_object(F.col(column), f"$.{path}").try_cast(kind)


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3_600_000_000.0)


def _active(kind: str) -> Column:
    return (F.col("type") == kind) & (F.col("status") == "active")


def active_goals(memories: DataFrame) -> DataFrame:
    """(id, title, source, last_touched, progress_count, is_blocked) of goals in work."""
    some = memories.filter(_active("goal") & (meta("priority") == "active"))
    steps = F.coalesce(F.json_array_length(meta("progress")), F.lit(0))
    return some.select("id", meta("title").alias("title"), meta("source").alias("source"), meta("last_touched", "timestamp").alias("last_touched"), steps.alias("progress_count"), meta("blocked_by").isNotNull().alias("is_blocked"))


def goal_backlog(memories: DataFrame) -> DataFrame:
    """(priority, n, goals) of goals that are not done; goals is a JSON list, the
    latest touched first."""
    some = memories.filter(_active("goal") & meta("priority").isin("active", "queued", "backburner"))
    item = F.struct((-F.unix_micros(meta("last_touched", "timestamp"))).alias("o"), F.col("id"), meta("title").alias("title"), meta("source").alias("source"))
    listed = F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), x["source"].alias("source"))))
    return some.groupBy(meta("priority").alias("priority")).agg(F.count("*").alias("n"), listed.alias("goals"))


def boundaries(memories: DataFrame) -> DataFrame:
    """(id, boundary_type, response_type, importance, flexibility) of held boundaries."""
    some = memories.filter(_active("worldview") & (meta("category") == "boundary"))
    loose = 1.0 - F.coalesce(meta("stability", "double"), F.lit(0.9))
    return some.select("id", F.coalesce(meta("subcategory"), F.lit("ethical")).alias("boundary_type"), meta("response_type").alias("response_type"), "importance", loose.alias("flexibility"))


def recent_beats(memories: DataFrame, most: int = 20) -> DataFrame:
    """The latest episodes that a heartbeat left: (id, heartbeat_id, heartbeat_number,
    started_at, action_count, valence)."""
    some = memories.filter((F.col("type") == "episodic") & meta("context.heartbeat_id").isNotNull())
    started = F.coalesce(meta("event_time", "timestamp"), F.col("created_at"))
    out = some.select("id", meta("context.heartbeat_id").alias("heartbeat_id"), meta("context.heartbeat_number", "int").alias("heartbeat_number"), started.alias("started_at"), F.coalesce(F.json_array_length(meta("context.actions_taken")), F.lit(0)).alias("action_count"), meta("emotional_valence", "double").alias("valence"))
    return out.orderBy(F.desc("started_at"), "id").limit(most)


def heartbeat_states(states: DataFrame) -> DataFrame:
    """Typed columns of the JSON ``value`` of heartbeat states (instance, key, value, updated_at)."""
    of = lambda path, kind: meta(path, kind, "value")
    return states.filter(F.col("key") == "heartbeat_state").select(
        "instance", F.coalesce(of("current_energy", "double"), F.lit(10.0)).alias("energy"), of("last_heartbeat_at", "timestamp").alias("last_heartbeat_at"),
        F.coalesce(of("heartbeat_count", "int"), F.lit(0)).alias("heartbeats"), F.coalesce(of("is_paused", "boolean"), F.lit(False)).alias("is_paused"), "updated_at",
    )


def emotional_states(states: DataFrame) -> DataFrame:
    """The affective part of heartbeat states, dominance one half where it is missing."""
    of = lambda path, kind="double": meta(f"affective_state.{path}", kind, "value")
    return states.filter(F.col("key") == "heartbeat_state").select(
        "instance", F.coalesce(of("updated_at", "timestamp"), F.col("updated_at")).alias("recorded_at"), of("valence").alias("valence"), of("arousal").alias("arousal"),
        F.coalesce(of("dominance"), F.lit(0.5)).alias("dominance"), of("primary_emotion", "string").alias("primary_emotion"), of("intensity").alias("intensity"),
    )


def drive_ratios(drives: DataFrame) -> DataFrame:
    """Drives with their level as a share of the urgency threshold; null for a threshold of zero."""
    share = F.try_divide(F.col("current_level"), F.col("urgency_threshold"))
    return drives.select("name", "current_level", "urgency_threshold", share.alias("ratio"), (F.col("current_level") >= F.col("urgency_threshold")).alias("is_urgent"))


def urgency(drives: DataFrame, least: float = 0.8) -> DataFrame:
    """One row: the greatest ratio, and the names of urgent drives, the most urgent first."""
    ratio = F.greatest(F.col("ratio"), F.lit(0.0))
    ranked = drive_ratios(drives).select("name", ratio.alias("ratio"))
    urgent = F.transform(F.array_sort(F.collect_list(F.when(F.col("ratio") >= least, F.struct((-F.col("ratio")).alias("r"), "name")))), lambda x: x["name"])
    return ranked.agg(F.coalesce(F.max("ratio"), F.lit(0.0)).alias("max_ratio"), F.array_join(urgent, ",").alias("urgent"))


def cognitive_health(memories: DataFrame, drives: DataFrame, as_of: Column) -> DataFrame:
    """One row of counts over memories and drives."""
    goal = _active("goal") & (meta("priority") == "active")
    beat = (F.col("type") == "episodic") & meta("context.heartbeat_id").isNotNull() & (F.coalesce(meta("event_time", "timestamp"), F.col("created_at")) > as_of - F.expr("interval 24 hours"))
    counts = memories.agg(F.count_if(goal).alias("active_goals"), F.count_if(goal & meta("blocked_by").isNotNull()).alias("blocked_goals"), F.count_if(F.col("status") == "active").alias("total_memories"), F.count_if(beat).alias("beats_24h"))
    of_drives = drives.agg(F.count_if(F.col("current_level") >= F.col("urgency_threshold")).alias("urgent_drives"), F.avg("current_level").alias("avg_drive_level"))
    # Both sides are one row.
    return counts.join(of_drives)


def unit_health(units: DataFrame, tasks: DataFrame, as_of: Column) -> DataFrame:
    """One row: how many raw units and consolidation tasks wait or failed, and mean ages in hours."""
    c = lambda **kv: F.count_if(_all(kv))
    waiting = {"embedding_status": "embedded", "route_status": "unrouted"}
    of_units = units.agg(
        c(status="active").alias("active_raw_units"), c(embedding_status="pending").alias("pending_embeddings"), c(embedding_status="failed").alias("failed_embeddings"),
        c(**waiting).alias("pending_routes"), c(route_status="route_failed").alias("failed_routes"),
        F.avg(F.when(F.col("embedding_status") == "pending", hours_between(F.col("created_at"), as_of))).alias("pending_embedding_age"),
        F.avg(F.when(_all(waiting), hours_between(F.col("embedded_at"), as_of))).alias("pending_route_age"),
    )
    of_tasks = tasks.agg(F.count_if((F.col("status") == "pending") & (F.col("next_attempt_at") <= as_of)).alias("pending_tasks"), c(status="failed").alias("failed_tasks"), c(status="dropped").alias("dropped_tasks"))
    return of_units.join(of_tasks)


def _all(wanted: dict[str, str]) -> Column:
    out = F.lit(True)
    for name, value in wanted.items():
        out = out & (F.col(name) == value)
    return out


def pending_work(units: DataFrame, tasks: DataFrame, as_of: Column) -> DataFrame:
    """(task_type, pending) of each kind of background work."""
    count = lambda df, name: df.agg(F.count("*").alias("pending")).select(F.lit(name).alias("task_type"), "pending")
    embed = count(units.filter(F.col("embedding_status") == "pending"), "embedding")
    route = count(units.filter(_all({"embedding_status": "embedded", "route_status": "unrouted"})), "routing")
    return embed.unionByName(route).unionByName(count(tasks.filter((F.col("status") == "pending") & (F.col("next_attempt_at") <= as_of)), "consolidation"))


def unhealthy_items(units: DataFrame, tasks: DataFrame) -> DataFrame:
    """(kind, id, attempts, last_seen) of failed embeddings, routes and tasks."""
    of = lambda df, kind, seen: df.select(F.lit(kind).alias("kind"), "id", "attempts", seen.alias("last_seen"))
    embeddings = of(units.filter((F.col("status") == "active") & (F.col("embedding_status") == "failed")), "embedding", F.col("updated_at"))
    routes = of(units.filter((F.col("status") == "active") & (F.col("route_status") == "route_failed")), "route", F.coalesce("last_routed_at", "updated_at"))
    return embeddings.unionByName(routes).unionByName(of(tasks.filter(F.col("status") == "failed"), "task", F.col("updated_at")))


def embedding_lifecycle(memories: DataFrame) -> DataFrame:
    """One row: counts by embedding status, and when the oldest pending one came."""
    kinds = ("pending", "in_progress", "embedded", "failed", "skipped")
    return memories.agg(*[F.count_if(F.col("embedding_status") == k).alias(k) for k in kinds], F.min(F.when(F.col("embedding_status") == "pending", F.col("created_at"))).alias("oldest_pending_at"))


def retention_status(memories: DataFrame, as_of: Column) -> DataFrame:
    """One row: active episodes and their mass (sum of strengths), archived rows, and
    documents that active memories name."""
    episode = _active("episodic")
    mass = F.sum(F.when(episode, strength(F.col("importance"), F.col("decay_rate"), F.col("created_at"), F.col("last_reinforced"), as_of)))
    return memories.agg(F.count_if(episode).alias("active"), F.coalesce(mass, F.lit(0.0)).alias("mass"), F.count_if(F.col("status") == "archived").alias("archived"), F.count_distinct(F.when(F.col("status") == "active", F.col("content_hash"))).alias("documents"))


def worker_status(workers: DataFrame, as_of: Column, silent_minutes: int = 3) -> DataFrame:
    """(worker, status, last_seen_age_s, is_stale) of worker instances."""
    age = F.floor((F.unix_micros(as_of) - F.unix_micros("last_seen_at")) / 1_000_000).cast("long")
    stale = F.col("status").isin("starting", "running", "stopping") & (F.unix_micros("last_seen_at") < F.unix_micros(as_of) - silent_minutes * 60_000_000)
    return workers.select("worker", "status", age.alias("last_seen_age_s"), stale.alias("is_stale"))


def interrupted(workers: DataFrame, runs: DataFrame, as_of: Column, silent_minutes: int = 3) -> DataFrame:
    """Runs (id, worker, status) that are still running on a stale worker."""
    lost = worker_status(workers, as_of, silent_minutes).filter("is_stale").select("worker").distinct()
    return runs.filter(F.col("status") == "running").join(lost, "worker", "left_semi")


def start_summary(starts: DataFrame, key: str, as_of: Column) -> DataFrame:
    """(key, starts_2m, starts_10m, latest_at, is_storming) of starts (key, created_at)."""
    since = lambda minutes: F.count_if(F.unix_micros("created_at") >= F.unix_micros(as_of) - minutes * 60_000_000)
    out = starts.filter(F.col("created_at") <= as_of).groupBy(key).agg(since(2).alias("starts_2m"), since(10).alias("starts_10m"), F.max("created_at").alias("latest_at"))
    return out.withColumn("is_storming", F.col("starts_2m") > 5)


def recent_actions(runs: DataFrame, as_of: Column, hours: int = 24, most: int = 30, context: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The latest runs of the window, and one row (total, failures, energy_total) of all of it."""
    hours, most = min(max(hours, 1), 168), min(max(most, 1), 100)
    some = runs.filter((F.unix_micros("created_at") >= F.unix_micros(as_of) - hours * 3_600_000_000) & (F.col("created_at") <= as_of))
    some = some if context is None else some.filter(F.col("tool_context") == context)
    latest = some.orderBy(F.desc("created_at"), "id").limit(most).select("id", "tool_name", "success", F.round(F.coalesce("duration_seconds", F.lit(0.0)), 2).alias("duration"), "created_at")
    return latest, some.agg(F.count("*").alias("total"), F.count_if(~F.col("success")).alias("failures"), F.coalesce(F.sum("energy_spent"), F.lit(0.0)).alias("energy_total"))


def reward_summary(events: DataFrame, as_of: Column, kind: str, value: str, ts: str, hours: int = 24) -> DataFrame:
    """One row: events of the window, their mean value, and a JSON object of counts by kind."""
    some = events.filter((F.unix_micros(ts) >= F.unix_micros(as_of) - hours * 3_600_000_000) & (F.col(ts) <= as_of))
    by_kind = some.groupBy(kind).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.count(value).alias("k"))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n"))))
    return by_kind.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.coalesce(F.round(F.try_divide(F.sum("s"), F.sum("k")), 4), F.lit(0.0)).alias("mean"), F.to_json(counts).alias("by_kind"))


def numbered_changes(changes: DataFrame, ts: str, since: Column | None = None, most: int = 20) -> DataFrame:
    """The latest changes after ``since``, numbered from 1, the newest first."""
    some = changes if since is None else changes.filter(F.col(ts) > since)
    some = some.orderBy(F.desc(ts), "id").limit(max(1, min(most, 100)))
    return some.withColumn("ord", F.row_number().over(W.orderBy(F.desc(ts), "id")))


def backlog(rows: DataFrame, most: int = 50, **wanted: str | None) -> DataFrame:
    """Rows (id, priority, created_at, ...) that have the wanted values (none: any),
    urgent ones first, then by age."""
    for name, value in wanted.items():
        rows = rows if value is None else rows.filter(F.col(name) == value)
    order = F.coalesce(*[F.when(F.col("priority") == p, F.lit(k)) for k, p in enumerate(("urgent", "high", "normal", "low"))])
    return rows.orderBy(order.asc_nulls_last(), "created_at", "id").limit(most)


def counts_as_json(rows: DataFrame, key: str) -> DataFrame:
    """One row: the number of rows, and a JSON object of counts by key, keys in order."""
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n"))))
    return rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.to_json(counts).alias("by_key"))


def cluster_insights(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters (id, name) with their number of members (cluster_id)."""
    n = members.groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("memory_count"))
    return clusters.join(n, "id", "left").select("id", "name", F.coalesce("memory_count", F.lit(0)).alias("memory_count"))


def episode_summary(episodes: DataFrame, members: DataFrame, memories: DataFrame) -> DataFrame:
    """Episodes (id, ...) with their number of members (episode_id, memory_id), and
    when the first and last of these came."""
    times = members.join(memories.select(F.col("id").alias("memory_id"), "created_at"), "memory_id", "left")
    per = times.groupBy(F.col("episode_id").alias("id")).agg(F.count("*").alias("memory_count"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    return episodes.join(per, "id", "left").withColumn("memory_count", F.coalesce("memory_count", F.lit(0)))


def stale_neighborhoods(neighborhoods: DataFrame, memories: DataFrame, as_of: Column) -> DataFrame:
    """(memory_id, type, computed_at, hours) of stale neighbourhoods (memory_id, computed_at, is_stale)."""
    stale = neighborhoods.filter("is_stale").join(memories.select(F.col("id").alias("memory_id"), "type"), "memory_id")
    return stale.select("memory_id", "type", "computed_at", hours_between(F.col("computed_at"), as_of).alias("hours"))


def effective_replacements(supersessions: DataFrame, memories: DataFrame) -> DataFrame:
    """(memory_id, replacement_id, reason, replacement_status) of active supersessions."""
    known = memories.select(F.col("id").alias("replacement_id"), F.col("status").alias("replacement_status"))
    return supersessions.filter(F.col("status") == "active").select("memory_id", "replacement_id", "reason").join(known, "replacement_id", "left")


def active_policies(corrections: DataFrame, memories: DataFrame) -> DataFrame:
    """(policy_key, id, action) of the latest correction per policy where that sets or
    reinforces one and its memory is active."""
    w = W.partitionBy("policy_key").orderBy(F.desc("created_at"), F.desc("id"))
    latest = corrections.withColumn("_r", F.row_number().over(w)).filter("_r = 1").filter(F.col("action").isin("set", "reinforce"))
    live = memories.filter(F.col("status") == "active").select(F.col("id").alias("memory_id"))
    return latest.join(live, "memory_id", "left_semi").select("policy_key", "id", "action")


def observed_per_week(contacts: DataFrame, entity: str, ts: str, as_of: Column, days: int = 90) -> DataFrame:
    """(entity, per_week) of contacts in the last days: by the weeks since the first, one at least."""
    since = F.unix_micros(as_of) - days * 86_400_000_000
    some = contacts.filter((F.unix_micros(ts) >= since) & (F.col(ts) <= as_of))
    weeks = F.greatest((F.unix_micros(as_of) - F.unix_micros(F.min(ts))) / 604_800_000_000, F.lit(1.0))
    return some.groupBy(entity).agg((F.count("*") / weeks).alias("per_week"))


def outcome_multiplier(score: Column, floor: float = 0.75, scale: float = 0.5, ceiling: float = 1.5) -> Column:
    """What the latest outcome makes of regained energy; 1 without one."""
    return F.when(score.isNull(), 1.0).otherwise(F.least(F.lit(max(ceiling, floor)), F.lit(floor) + F.greatest(score, F.lit(0.0)) * scale))


def new_mood(valence: Column, arousal: Column, mean_valence: Column, samples: Column, tonic: Column, decay: float = 0.1, rest: float = 0.3) -> tuple[Column, Column]:
    """Mood after a step: it decays by a rate that tonic damps, towards the mean of
    recent samples if there are any; arousal moves half as fast to rest."""
    rate = F.lit(decay) * (1.5 - F.coalesce(tonic, F.lit(0.5)))
    calm = F.coalesce(valence, F.lit(0.0)) * (1 - rate)
    return F.when(samples > 0, calm + F.coalesce(mean_valence, F.lit(0.0)) * rate).otherwise(calm), F.coalesce(arousal, F.lit(0.3)) * (1 - rate * 0.5) + F.lit(rest) * rate * 0.5


def default_trust(kind: Column, defaults: dict[str, float], otherwise: float = 0.45) -> Column:
    """Trust of a kind of source by name, without case or outer blanks."""
    name = F.lower(F.btrim(kind, F.lit(" ")))
    known = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair]) if defaults else F.lit(None).cast("map<string,double>")
    return clamp(F.coalesce(F.try_element_at(known, name), F.lit(float(otherwise))))

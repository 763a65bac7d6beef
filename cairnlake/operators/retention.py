"""Retention as a chain of passes over snapshots: each gives the state as it would be,
nothing is changed in place, so a dry run is the chain without writing its end."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.functions.scoring import age_in_days, strength
from cairnlake.operators.lifecycle import over_capacity
from cairnlake.operators.reports import meta
from cairnlake.operators.upkeep import borderline, protected, stale_documents
from cairnlake.shared import saved

#: Columns of memories that the passes read or write.
MEMORY = (
    "id", "type", "status", "content", "importance", "decay_rate", "created_at", "last_reinforced", "last_accessed", "metadata", "content_hash", "sensitivity",
    "episode", "superseded_by", "archived_at",
)


@dataclass(frozen=True)
class State:
    """What retention works on: ``memories`` (MEMORY), ``reviews`` (episode, ids, status),
    ``requests`` (content_hash, status, memory_count) to let documents fade, and
    ``documents`` (id, content_hash, status, acquisition, last_ingested_at, last_touched, on_desk)."""

    memories: DataFrame
    reviews: DataFrame
    requests: DataFrame
    documents: DataFrame


def _strength(as_of: Column) -> Column:
    return strength(F.col("importance"), F.col("decay_rate"), F.col("created_at"), F.col("last_reinforced"), as_of)


def candidates(memories: DataFrame, as_of: Column, min_age: float = 30, min_idle: float = 21, below: float = 0.4, least: int = 3) -> DataFrame:
    """(episode, ids, touchy): episodes with so many old, idle, faded episodic memories
    that no protection holds; ``touchy`` if one of them is near protection."""
    idle = F.col("last_reinforced").isNull() | (age_in_days(F.col("last_reinforced"), as_of) >= min_idle)
    some = memories.filter((F.col("type") == "episodic") & (F.col("status") == "active") & F.col("episode").isNotNull() & ~protected())
    some = some.filter((age_in_days(F.col("created_at"), as_of) >= min_age) & idle & (_strength(as_of) < below))
    out = some.groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("created_at", "id"))).alias("_m"), F.bool_or(borderline(as_of)).alias("touchy"))
    return out.filter(F.size("_m") >= least).select("episode", F.transform("_m", lambda x: x["id"]).alias("ids"), "touchy")


def rest_pass(state: State, as_of: Column, batch: int = 8, escalate: int = 3, budget: int = 1) -> State:
    """The first ``batch`` candidate episodes: such as wait for a review are left, some
    of the touchy ones are put up for review, and the others are merged into a gist
    whose originals are archived."""
    waiting = state.reviews.filter("status = 'pending'").select(F.explode("ids").alias("id")).distinct()
    group = candidates(state.memories, as_of).orderBy("episode").limit(batch)
    asked = group.select("episode", F.explode("ids").alias("id")).join(waiting, "id", "left_semi").select("episode").distinct()
    group = saved(group.join(asked, "episode", "left_anti"), "rest-groups")
    review = group.filter("touchy").orderBy("episode").limit(escalate if budget > 0 else 0)
    review = saved(review.select("episode", "ids", F.lit("pending").alias("status")), "rest-reviews")
    merge = group.join(review.select("episode"), "episode", "left_anti")

    members = merge.select(F.explode("ids").alias("id"), F.element_at("ids", 1).alias("_first"), F.size("ids").alias("_n")).filter("_n >= 2").drop("_n")
    gist_id = -F.col("_first") - 1
    of = state.memories.join(members, "id")
    listed = F.array_sort(F.collect_list(F.struct("created_at", "id", "content")))
    gist = of.groupBy("_first").agg(
        listed.alias("_m"), F.max("importance").alias("importance"), F.avg(meta("emotional_valence", "double")).alias("_v"),
        F.bool_or(F.coalesce(F.col("sensitivity") == "private", F.lit(False))).alias("_private"), F.first("episode").alias("episode"),
    )
    told = F.to_json(F.struct(F.struct(F.lit("merged").alias("role"), F.lit(False).alias("summarized")).alias("consolidation"), F.col("_v").alias("emotional_valence")))
    values = {
        "id": gist_id, "type": F.lit("episodic"), "status": F.lit("active"), "content": F.array_join(F.transform("_m", lambda x: x["content"]), "\n\n---\n\n"),
        "importance": F.least(F.lit(1.0), F.coalesce("importance", F.lit(0.5))), "created_at": as_of, "metadata": told,
        "sensitivity": F.when(F.col("_private"), "private"), "episode": F.col("episode"),
    }
    kinds = {f.name: f.dataType for f in state.memories.schema}
    gists = gist.select(*[values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in MEMORY])
    gone = members.select("id", gist_id.alias("_gist"))
    kept = state.memories.select(*MEMORY).join(gone, "id", "left")
    merged = F.col("_gist").isNotNull()
    changed = {"status": F.when(merged, "archived"), "superseded_by": F.col("_gist"), "archived_at": F.when(merged, as_of)}
    kept = kept.select(*[F.coalesce(changed[c], F.col(c)).cast(kinds[c]).alias(c) if c in changed else F.col(c) for c in MEMORY])
    return replace(state, memories=saved(kept.unionByName(gists), "rest-memories"), reviews=state.reviews.unionByName(review))


def gc_pass(state: State, as_of: Column, grace_days: float = 14, capacity: float = 0, irreversible: bool = True) -> State:
    """Without what was archived for longer than the grace time, and, beyond a
    ``capacity`` of strength, without the weakest unprotected episodic memories. Only
    where forgetting for good is allowed."""
    if not irreversible:
        return state
    old = (F.col("status") == "archived") & F.col("superseded_by").isNotNull() & (age_in_days(F.col("archived_at"), as_of) >= grace_days) & ~protected()
    left = saved(state.memories.filter(~F.coalesce(old, F.lit(False))), "gc-memories")
    if capacity > 0:
        live = left.filter("status = 'active' and type = 'episodic'").select("id", _strength(as_of).alias("strength"), protected().alias("held"))
        held = live.filter("held").agg(F.sum("strength")).first()[0] or 0.0
        if held < capacity:
            weakest = over_capacity(live.filter("not held").drop("held"), capacity - held)
        else:
            weakest = live.filter("not held")
        left = saved(left.join(weakest.select("id"), "id", "left_anti"), "gc-memories")
    return replace(state, memories=left)


def agent_source_pass(state: State, as_of: Column, idle_days: float = 60, escalate: int = 5, batch: int = 5) -> State:
    """Documents that the agent fetched for itself and nobody has used for so long, the
    ``batch`` longest ago: those that many memories rest on are put up for a decision,
    others are archived."""
    used = F.greatest("last_reinforced", "last_accessed", "created_at")
    cited = state.memories.filter("status = 'active' and content_hash is not null").groupBy("content_hash")
    cited = cited.agg(F.count("*").alias("memory_count"), F.min(age_in_days(used, as_of)).alias("_idle"))
    pending = state.requests.filter("status = 'pending'").select("content_hash").distinct()
    quiet = (age_in_days(F.col("last_ingested_at"), as_of) >= idle_days) & (F.col("last_touched").isNull() | (age_in_days(F.col("last_touched"), as_of) >= idle_days))
    due = state.documents.filter((F.col("status") == "active") & (F.col("acquisition") == "agent") & quiet & ~F.coalesce("on_desk", F.lit(False)))
    due = due.join(pending, "content_hash", "left_anti").join(cited, "content_hash", "left").filter(F.coalesce(F.col("_idle") >= idle_days, F.lit(True)))
    due = due.withColumn("memory_count", F.coalesce("memory_count", F.lit(0))).orderBy("last_ingested_at", "id").limit(batch)
    due = saved(due.select("id", "content_hash", "memory_count"), "agent-sources")
    asked = due.filter(F.col("memory_count") >= escalate).select("content_hash", F.lit("pending").alias("status"), "memory_count")
    asked = asked.join(state.requests.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"])
    archived = due.filter(F.col("memory_count") < escalate).select("id", F.lit("archived").alias("_s"))
    documents = state.documents.join(archived, "id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")
    return replace(state, documents=documents.select(*state.documents.columns), requests=state.requests.unionByName(asked))


def fade_pass(state: State, as_of: Column, old_days: float = 180, idle_days: float = 90) -> State:
    """With a request for every document that nothing has come back to for long."""
    new = stale_documents(state.memories, state.requests, as_of, old_days, idle_days)
    new = new.join(state.requests.select("content_hash"), "content_hash", "left_anti")
    return replace(state, requests=state.requests.unionByName(new.select("content_hash", F.lit("pending").alias("status"), "memory_count")))


def status(state: State, as_of: Column) -> DataFrame:
    """(measure, amount) of a state, a row for each measure."""
    live = (F.col("status") == "active") & (F.col("type") == "episodic")
    merged = (F.col("status") == "active") & (meta("consolidation.role") == "merged")
    counted = state.memories.agg(
        F.count_if(live).cast("double").alias("active"), F.round(F.coalesce(F.sum(F.when(live, _strength(as_of))), F.lit(0.0)), 2).alias("mass"),
        F.count_if(F.col("status") == "archived").cast("double").alias("archived"), F.count_if(F.coalesce(merged, F.lit(False))).cast("double").alias("gists"),
        F.count_distinct(F.when(F.col("status") == "active", F.col("content_hash"))).cast("double").alias("protected_documents"),
    )
    one = lambda df, name: df.agg(F.count("*").cast("double").alias(name))
    pending = F.col("status") == "pending"
    more = [
        one(candidates(state.memories, as_of), "candidate_groups"), one(state.reviews.filter(pending), "reviews_pending"),
        one(state.requests.filter(pending), "approvals_pending"), one(state.documents.filter("status = 'archived'"), "archived_documents"),
    ]
    parts = [counted, *more]
    long = [df.unpivot([], df.columns, "measure", "amount") for df in parts]
    out = long[0]
    for df in long[1:]:
        out = out.unionByName(df)
    return out


def cycle(state: State, as_of: Column, capacity: float = 0, irreversible: bool = True, budget: int = 1, batch: int = 8) -> State:
    """One whole rest: merging, pruning, the agent's own sources, and fading documents."""
    state = rest_pass(state, as_of, batch=batch, budget=budget)
    state = gc_pass(state, as_of, capacity=capacity, irreversible=irreversible)
    return fade_pass(agent_source_pass(state, as_of), as_of, 40, 30)


def dry_run(state: State, as_of: Column, **options) -> DataFrame:
    """(measure, before, after) of one cycle that is not carried out."""
    before, after = status(state, as_of), status(cycle(state, as_of, **options), as_of)
    return before.withColumnRenamed("amount", "before").join(after.withColumnRenamed("amount", "after"), "measure")

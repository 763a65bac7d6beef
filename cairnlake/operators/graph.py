"""Typed-edge graph operators as bounded rounds of joins.

Edges are (src, dst, rel, weight). Rounds are bounded by the depth; each keeps
one row per node (or per path), with the seed as part of the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnlake.functions.scoring import noisy_or
from cairnlake.shared import saved


def reached(edges: DataFrame, seeds: DataFrame, depth: int = 2, directed: bool = False) -> DataFrame:
    """(node, depth, relevance): nodes within ``depth`` edges of ``seeds`` (node),
    with the least depth and the largest product of weights found on a walk.

    Each round is written to the shared folder and goes on from what it has raised."""
    one = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    if not directed:
        one = one.unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "weight"))
    one = saved(one.groupBy("a", "b").agg(F.max("weight").alias("weight")), "steps")
    found = saved(seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(1.0).alias("relevance"), F.lit(True).alias("moved")), "reached")
    for k in range(1, depth + 1):
        # Only nodes that are new, or whose relevance rose, are left again.
        front = found.filter("moved").select("node", "relevance")
        step = front.join(one, F.col("node") == F.col("a")).groupBy(F.col("b").alias("node")).agg(F.max(F.col("relevance") * F.col("weight")).alias("_r"))
        both = found.drop("moved").join(step, "node", "full")
        better = F.col("_r").isNotNull() & (F.col("relevance").isNull() | (F.col("_r") > F.col("relevance")))
        found = both.select("node", F.coalesce("depth", F.lit(k)).alias("depth"), F.greatest("relevance", "_r").alias("relevance"), better.alias("moved"))
        found = saved(found, "reached")
        if found.filter("moved").isEmpty():
            break
    return found.drop("moved")


def _longer(front: DataFrame, step: DataFrame, k: int) -> DataFrame:
    """The paths of ``k`` edges that go on from those of one fewer."""
    on = front.join(step, F.col("node") == F.col("_a")).filter(~F.array_contains("path", F.col("_b")))
    return on.select("seed", F.col("_b").alias("node"), F.lit(k).alias("depth"), (F.col("weight") * F.col("_w")).alias("weight"), F.concat("path", F.array("_b")).alias("path"))


def paths(edges: DataFrame, seeds: DataFrame, depth: int = 4, most: int | None = None) -> DataFrame:
    """(seed, node, depth, weight, path): simple directed paths from each seed.

    With ``most`` only so many of each seed, the shortest first, then the heaviest, then
    by the path written out. A seed that has as many goes no further, and one that has
    fewer has all of its paths so far, so no hop starts from more than ``most`` of a
    seed. Each hop is written to the shared folder once.
    """
    step = edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), F.col("weight").alias("_w"))
    front = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth"), F.lit(1.0).alias("weight"), F.array("node").alias("path"))
    levels = []
    for k in range(1, depth + 1):
        front = _longer(front, step, k)
        if most is not None:
            written = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
            best = W.partitionBy("seed").orderBy(F.desc("weight"), written)
            front = front.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= most).drop("_r")
        front = saved(front, "paths")
        levels.append(front)
        if most is not None:
            found = reduce(DataFrame.unionByName, levels).groupBy("seed").agg(F.count("*").alias("_n"))
            front = front.join(found.filter(F.col("_n") < most).select("seed"), "seed", "left_semi")
    return reduce(DataFrame.unionByName, levels)


def causes(edges: DataFrame, effects: DataFrame, depth: int = 10) -> DataFrame:
    """(node, distance): ancestors of ``effects`` (node) along edges src -> dst."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return reached(turned, effects, depth, directed=True).filter("depth > 0").select("node", F.col("depth").alias("distance"))


def merged_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges of the nodes of a group (node, group) become edges of the group:
    inner ones go, parallel ones join their weights by noisy or."""
    a = groups.select(F.col("node").alias("src"), F.col("group").alias("_sg"))
    b = groups.select(F.col("node").alias("dst"), F.col("group").alias("_dg"))
    out = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("_sg", "src").alias("src"), F.coalesce("_dg", "dst").alias("dst"), "rel", "weight")
    return out.filter("src <> dst").groupBy("src", "dst", "rel").agg(noisy_or(F.col("weight")).alias("weight"), F.count("*").alias("edges"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is not among ``nodes`` (node); null ends are not."""
    known = nodes.select("node").distinct()
    ends = [known.select(F.col("node").alias(c), F.lit(True).alias(f"_{c}")) for c in ("src", "dst")]
    out = edges.join(ends[0], "src", "left").join(ends[1], "dst", "left")
    return out.filter("_src is null or _dst is null").select(*edges.columns)


def subgraph(edges: DataFrame, live: DataFrame, seeds: DataFrame, depth: int = 2, budget: int = 40, rels: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): what lies round ``seeds`` (node) within ``depth`` edges either way.

    ``live`` (node, alive) tells of the nodes that can be dead; an edge counts if both of
    its ends live. nodes are (node, depth, relevance): the least depth and the greatest
    product of weights on a way that meets no node twice (weights up to one, so the
    best way never does), of these the ``budget`` nearest and most relevant. Of the
    edges those are returned that run between them. Each hop is written to the shared
    folder and goes on from what it has raised.
    """
    depth, budget = min(max(depth, 0), 6), min(max(budget, 1), 500)
    some = edges if rels is None else edges.filter(F.col("rel").isin(*rels))
    dead = live.filter("not alive").select("node").distinct()
    for end in ("src", "dst"):
        some = some.join(dead.withColumnRenamed("node", end), end, "left_anti")
    some = saved(some.select("src", "dst", "rel", F.coalesce("weight", F.lit(1.0)).alias("weight")), "subgraph-edges")
    start = seeds.select("node").distinct().join(dead, "node", "left_anti")
    found = reached(some, start, depth)
    kept = saved(found.orderBy("depth", F.desc("relevance"), "node").limit(budget), "subgraph-nodes")
    # At most 500 nodes, so their names are small.
    names = F.broadcast(kept.select("node"))
    between = some.join(names.withColumnRenamed("node", "src"), "src", "left_semi").join(names.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return kept, between.select("src", "dst", "rel", "weight").distinct()


def together(members: DataFrame, item: int, k: int = 10) -> DataFrame:
    """(item, shared): other items that stand most often in the groups of ``item``;
    ``members`` is (group, item)."""
    own = members.filter(F.col("item") == item).select("group").distinct()
    return members.join(own, "group", "left_semi").filter(F.col("item") != item).groupBy("item").agg(F.count_distinct("group").alias("shared")).orderBy(F.desc("shared"), "item").limit(k)


def upserted_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, rel, weight, edges): one row per natural key, that of the greatest
    ``seq`` with a weight, and how many there were."""
    return edges.groupBy("src", "dst", "rel").agg(F.max_by("weight", F.when(F.col("weight").isNotNull(), F.col("seq"))).alias("weight"), F.count("*").alias("edges"))


def evidence(edges: DataFrame, node: int, rel: str = "SUPPORTS") -> DataFrame:
    """(id, strength) of what points at a node by such edges, the strongest first."""
    return edges.filter((F.col("dst") == node) & (F.col("rel") == rel)).groupBy(F.col("src").alias("id")).agg(F.max(F.coalesce("strength", F.lit(0.0))).alias("strength")).orderBy(F.desc("strength"), "id")


def members_of(edges: DataFrame, node: int, rel: str = "MEMBER_OF") -> DataFrame:
    """(id, strength) of the members of a cluster, strength 1 where none is given."""
    return edges.filter((F.col("dst") == node) & (F.col("rel") == rel)).select(F.col("src").alias("id"), F.coalesce("strength", F.lit(1.0)).alias("strength"))


def concept_members(links: DataFrame, memories: DataFrame, concept: int, k: int = 10) -> DataFrame:
    """(id, strength, importance) of memories linked to a concept (id, concept, strength),
    the strongest and then the most important first."""
    best = links.filter(F.col("concept") == concept).groupBy("id").agg(F.max("strength").alias("strength"))
    return best.join(memories.select("id", "importance"), "id").orderBy(F.desc_nulls_last("strength"), F.desc_nulls_last("importance"), "id").limit(k)


def best_edges(edges: DataFrame, key: str, k: int = 20) -> DataFrame:
    """The strongest edge of each value of ``key``, ties by the other end, and of
    these the k strongest: how a self model or the relationships are listed."""
    best = edges.groupBy(key).agg(F.min(F.struct((-F.coalesce("strength", F.lit(0.0))).alias("s"), "src", "rel")).alias("m"))
    return best.select(key, F.col("m.src").alias("src"), F.col("m.rel").alias("rel"), (-F.col("m.s")).alias("strength")).orderBy(F.desc("strength"), key).limit(k)


def contested_pairs(edges: DataFrame, ledger: DataFrame) -> DataFrame:
    """(a, b, origin) of contradicting pairs, a < b: pending ones of the ledger (a, b,
    status), and those of edges that the ledger does not know."""
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    known = ledger.select(*pair("a", "b"), "status")
    drawn = edges.filter(F.col("rel") == "CONTRADICTS").select(*pair("src", "dst")).filter("a <> b").distinct().join(known.select("a", "b").distinct(), ["a", "b"], "left_anti")
    pending = known.filter(F.col("status") == "pending").select("a", "b").distinct()
    return pending.withColumn("origin", F.lit("ledger")).unionByName(drawn.withColumn("origin", F.lit("graph")))


def reconsidered(edges: DataFrame, belief: int, size: int, offset: int = 0) -> DataFrame:
    """A page of what bears on a belief: contradicting edges first, then supporting ones."""
    order = F.when(F.col("rel") == "CONTRADICTS", 1).when(F.col("rel") == "SUPPORTS", 2)
    some = edges.filter(F.col("dst") == belief).select(F.col("src").alias("id"), order.alias("direction")).filter("direction is not null").distinct()
    return some.orderBy("direction", "id").offset(offset).limit(size)


def goal_links(edges: DataFrame, goal: int, names: dict[str, str]) -> DataFrame:
    """(id, link) of what an edge of a named kind joins to a goal, from either end."""
    link = F.coalesce(*[F.when(F.col("rel") == rel, F.lit(name)) for rel, name in names.items()])
    ends = edges.filter((F.col("src") == goal) | (F.col("dst") == goal)).filter(F.col("rel").isin(*names))
    return ends.select(F.when(F.col("src") == goal, F.col("dst")).otherwise(F.col("src")).alias("id"), link.alias("link")).distinct()


def plan_layers(steps: DataFrame, needs: DataFrame) -> DataFrame:
    """(step, layer) of steps in the order of what they need (step, needs): each is one
    layer after the last of those. Steps of a circle, or behind one, have none.

    Each round settles the steps whose last need was settled by the round before, so
    rounds are as many as layers, and a round reads the last layer and the needs that
    are still open. A step that needs what is not listed is never settled.
    """
    steps, needs = steps.select("step").distinct(), needs.select("step", "needs").distinct()
    wants = needs.groupBy("step").agg(F.count("*").alias("open"))
    layers = [saved(steps.join(wants, "step", "left_anti").withColumn("layer", F.lit(0)), "layer")]
    waiting = saved(steps.join(wants, "step"), "waiting")
    while True:
        met = needs.join(layers[-1].select(F.col("step").alias("needs")), "needs").groupBy("step").agg(F.count("*").alias("_met"))
        waiting = saved(waiting.join(met, "step", "left").select("step", (F.col("open") - F.coalesce("_met", F.lit(0))).alias("open")), "waiting")
        ready = saved(waiting.filter("open = 0").select("step", F.lit(len(layers)).alias("layer")), "layer")
        if ready.isEmpty():
            return reduce(DataFrame.unionByName, layers)
        layers.append(ready)
        waiting = waiting.filter("open > 0").select("step", "open")

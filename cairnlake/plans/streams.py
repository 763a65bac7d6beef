"""Queries that run streams over the given tables to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairnlake.plans.base import query, table
from cairnlake.shared import own_dir
from cairnlake.streaming import queue, runs
from cairnlake.streaming.episodes import episodes


def _stream(spark, sf_dir, name: str):
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query("""WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t FROM events WHERE epoch_us(ts) <= (SELECT (epoch_ms(max(ts)) - 600000) * 1000 FROM events)),
g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS episode FROM g)
SELECT user_id::VARCHAR AS key, event_id AS id, episode::INTEGER AS episode, (row_number() OVER (PARTITION BY user_id, episode ORDER BY t, event_id))::INTEGER AS sequence FROM n""")
def streamed_episodes(spark, sf_dir):
    events = _stream(spark, sf_dir, "events")
    found = episodes(events.withColumn("ts", F.col("ts").cast("timestamp")))
    out = runs.appended(found, f"{own_dir(spark)}/episodes-{uuid.uuid4().hex}")
    return out.select("key", "id", "episode", "sequence")


@query("""WITH c AS (SELECT event_id % 700 AS item, event_id AS seq, CASE event_type WHEN 'signup' THEN 'submit' WHEN 'view' THEN 'submit' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS action, ts FROM events)
SELECT item, CASE arg_max(action, {'t': ts, 's': seq}) WHEN 'submit' THEN 'pending' WHEN 'start' THEN 'processing' WHEN 'complete' THEN 'completed' ELSE 'failed' END AS status, min(ts) FILTER (action = 'submit') AS created_at,
count(*) FILTER (action = 'start') AS attempts, max(ts) FILTER (action IN ('complete', 'fail')) AS completed_at, 'error ' || arg_max(seq, ts) FILTER (action = 'fail') AS error FROM c GROUP BY item""")
def streamed_queue(spark, sf_dir):
    path = f"{own_dir(spark)}/queue-{uuid.uuid4().hex}"
    # In several files, so that the stream comes in several batches.
    table(spark, sf_dir, "events").repartition(6).write.parquet(f"{path}/source")
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/source")
    kind = F.col("event_type")
    action = F.when(kind.isin("signup", "view"), "submit").when(kind == "click", "start").when(kind == "purchase", "complete").otherwise("fail")
    i = F.col("event_id")
    commands = source.select((i % 700).alias("item"), i.alias("seq"), action.alias("action"), F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("error "), i.cast("string")).alias("error"))
    out = queue.follow(commands, path, fold_every=4)
    return out.select("item", "status", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "attempts", F.col("completed_at").cast("timestamp_ntz").alias("completed_at"), "error")

"""Feed queries over the events table, and its window extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.plans.data import table
from claimlens.streaming import feed as fd


def _releases(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        F.when(k % 3 == 0, "DOJ").when(k % 3 == 1, "OIG").otherwise("STATE").alias("source"), F.concat(F.lit("s"), (k % 4000).cast("string")).alias("source_id"), F.concat(F.lit("https://x.example/"), (k % 1500).cast("string"), F.lit("/")).alias("url"),
        F.when(k % 5 == 0, F.concat(F.lit("https://X.example/"), (k % 700).cast("string"))).alias("source_url"), F.concat(F.lit("t"), k.cast("string")).alias("title"), F.repeat(F.lit("b"), (k % 37).cast("int")).alias("body"), F.col("ts").alias("fetched_at"),
    )


def collapsed(spark, sf_dir):
    """Latest version of each release, then one release per event, then those not processed before."""
    x = fd.collapse(fd.latest(_releases(spark, sf_dir)))
    done = x.where(F.col("event_key").endswith("7")).select("event_key")
    return fd.new_events(x, done).select("event_key", "source", "source_id", "title")


COLLAPSED = """WITH r AS (SELECT CASE event_id % 3 WHEN 0 THEN 'DOJ' WHEN 1 THEN 'OIG' ELSE 'STATE' END AS source, 's' || event_id % 4000 AS source_id, 'https://x.example/' || event_id % 1500 || '/' AS url, CASE WHEN event_id % 5 = 0 THEN 'https://X.example/' || event_id % 700 END AS source_url,
  't' || event_id AS title, repeat('b', CAST(event_id % 37 AS INTEGER)) AS body, ts FROM events), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ts DESC, url DESC, title DESC) = 1),
k AS (SELECT *, lower(rtrim(coalesce(source_url, url), '/')) AS event_key FROM l), c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY (source = 'DOJ') DESC, length(body) DESC, source_id DESC) = 1)
SELECT event_key, source, source_id, title FROM c WHERE NOT event_key LIKE '%7'"""


def tumbling(spark, sf_dir):
    return fd.tumbling(table(spark, sf_dir, "events"))


TUMBLING = "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_c FROM events GROUP BY 1, 2"


def sessions(spark, sf_dir):
    return fd.sessions(table(spark, sf_dir, "events"))


SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""

QUERIES = {
    "feed_collapse": (collapsed, COLLAPSED),
    "feed_tumbling": (tumbling, TUMBLING),
    "feed_sessions": (sessions, SESSIONS),
}

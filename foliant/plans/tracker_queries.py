"""Tracker queries: events stand in for applications (purchase) and views, orders for tracked applications."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import tracker
from foliant.plans.registry import query


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def last_event(spark, sf_dir):
    return read(spark, sf_dir, "events").agg(F.max("ts")).first()[0]


@query("""WITH m AS (SELECT max(ts)::DATE AS d FROM events), c AS (SELECT unnest(generate_series(d - 29, d, INTERVAL 1 DAY))::DATE AS day FROM m)
SELECT c.day, count(*) FILTER (event_type = 'purchase') AS applied, count(*) FILTER (event_type = 'view') AS viewed
FROM c LEFT JOIN events e ON e.ts::DATE = c.day GROUP BY c.day""")
def tracker_trend30(spark, sf_dir):
    return tracker.dense_trend(read(spark, sf_dir, "events"), "ts", {"applied": F.col("event_type") == "purchase", "viewed": F.col("event_type") == "view"})


@query("""WITH m AS (SELECT max(ts)::DATE AS d FROM events), c AS (SELECT unnest(generate_series(d - 6, d, INTERVAL 1 DAY))::DATE AS day FROM m),
u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, c.day, count(*) FILTER (event_type = 'purchase') AS applied, count(*) FILTER (event_type = 'view') AS viewed
FROM u CROSS JOIN c LEFT JOIN events e ON e.ts::DATE = c.day AND e.user_id = u.user_id GROUP BY ALL""")
def tracker_trend7_by_user(spark, sf_dir):
    return tracker.dense_trend(read(spark, sf_dir, "events"), "ts", {"applied": F.col("event_type") == "purchase", "viewed": F.col("event_type") == "view"}, days=7, by=("user_id",))


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o,
count(*) FILTER (coalesce(o_orderstatus NOT IN ('F', 'O'), true)) AS n_other, count(*) FILTER (o_orderpriority = '1-URGENT') AS favourites, count(*) AS total
FROM orders GROUP BY o_custkey""")
def tracker_status_counts(spark, sf_dir):
    return tracker.status_counts(read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", F.col("o_orderpriority") == "1-URGENT", ("F", "O"))


@query("""WITH m AS (SELECT max(ts) AS now FROM events)
SELECT user_id, count(*) AS total, count(*) FILTER (ts >= date_trunc('month', now)) AS monthly, count(*) FILTER (ts >= now - INTERVAL 168 HOUR) AS last7
FROM events, m WHERE event_type = 'purchase' GROUP BY user_id""")
def tracker_totals(spark, sf_dir):
    now = F.lit(str(last_event(spark, sf_dir))).cast("timestamp_ntz")
    return tracker.totals(read(spark, sf_dir, "events").where("event_type = 'purchase'"), now, "user_id", "ts")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders
WHERE o_orderstatus = 'O' AND (contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderstatus), 'urgent'))
AND o_orderdate >= '1997-01-01' AND o_orderdate < '1998-01-01'""")
def tracker_list(spark, sf_dir):
    jobs = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    return tracker.job_list(jobs, "Urgent", ("o_orderpriority", "o_orderstatus"), "O", "o_orderstatus", "o_orderdate", "1997-01-01", "1997-12-31", ("o_orderkey",))


@query("""SELECT event_id, user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""")
def tracker_view_dedupe(spark, sf_dir):
    return tracker.first_per_day(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ("user_id", "event_type"), "ts", ("event_id",))


@query("""SELECT o_custkey, o_orderkey, o_orderdate, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 5""")
def tracker_recent5(spark, sf_dir):
    return tracker.recent(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", 5, (F.col("o_orderkey").desc(),))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS is_default FROM orders""")
def resume_default(spark, sf_dir):
    return tracker.with_default(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", ("o_orderkey",)).drop("o_orderdate")


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def tracker_upsert(spark, sf_dir):
    old = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return tracker.upsert(old, old.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query("""SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def tailor_lookup(spark, sf_dir):
    """A record looked up for its owner (equi-join), with an optional profile (left join)."""
    orders = read(spark, sf_dir, "orders")
    return orders.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("""WITH m AS (SELECT max(ts) AS now FROM events), s AS (SELECT event_id, ts, (epoch_us(now) // 1000000) - (epoch_us(ts) // 1000000) AS s FROM events, m)
SELECT event_id, CASE WHEN s // 60 < 1 THEN 'just now' WHEN s // 60 < 60 THEN (s // 60)::VARCHAR || 'm ago' WHEN s // 3600 < 24 THEN (s // 3600)::VARCHAR || 'h ago'
WHEN s // 86400 < 30 THEN (s // 86400)::VARCHAR || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS ago FROM s""")
def tracker_time_ago(spark, sf_dir):
    now = F.lit(str(last_event(spark, sf_dir))).cast("timestamp_ntz")
    return read(spark, sf_dir, "events").select("event_id", tracker.time_ago(F.col("ts"), now).alias("ago"))

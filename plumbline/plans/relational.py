"""Queries on the relational tables and on events: joins, roll-ups, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.session import table
from plumbline.streaming import incremental


def rel1_pricing_summary(spark, sf_dir):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count(F.lit(1)).alias("n")
    )


def rel2_revenue_rollup(spark, sf_dir):
    """Revenue by region and nation: dimension joins that Spark broadcasts by their size."""
    l, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    own = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return own.rollup("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


def rel3_top_orders(spark, sf_dir):
    """Each customer's three largest orders with the share of the customer's total."""
    o = table(spark, sf_dir, "orders")
    own = Window.partitionBy("o_custkey")
    rows = o.select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(own.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("place"), F.sum("o_totalprice").over(own).alias("total"))
    return rows.where("place <= 3").select("o_custkey", "o_orderkey", "place", F.round(F.col("o_totalprice") / F.col("total"), 6).alias("share"))


def stream_window_counts(spark, sf_dir):
    """The batch equivalent of the stream of tumbling windows."""
    return incremental.window_counts(table(spark, sf_dir, "events")).withColumn("window_start", F.unix_timestamp("window_start"))


def stream_sessions(spark, sf_dir):
    return incremental.sessions(table(spark, sf_dir, "events")).withColumn("session_start", F.unix_timestamp("session_start"))


QUERIES = {f.__name__: f for f in (rel1_pricing_summary, rel2_revenue_rollup, rel3_top_orders, stream_window_counts, stream_sessions)}

ORACLES = {
    "rel1_pricing_summary": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus
""",
    "rel2_revenue_rollup": """
SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, n_name)
""",
    "rel3_top_orders": """
SELECT o_custkey, o_orderkey, place, round(o_totalprice / total, 6) AS share FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS total FROM orders) WHERE place <= 3
""",
    "stream_window_counts": """
SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""",
    "stream_sessions": """
WITH e AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS session_start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k
""",
}

"""Canonical frames over the given tables, and the same expressions as SQL fragments.

events: user = user_id, order event = purchase, order value = value, platform from the user id.
orders: line items joined with orders, suppliers and nations; merchant = supplier, category = nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.functions.columns import US_PER_DAY, US_PER_HOUR
from tidelens.schema import Vocabulary
from tidelens.sources.normalise import match_deliveries

STEPS = ("signup", "view", "click", "purchase")

VOCAB = Vocabulary(
    homepage="signup",
    category_view="category",
    merchant_view="error",
    product_view="view",
    search="view",
    add="click",
    cart_created="cart_created",
    cart="error",
    checkout_button="checkout_button",
    payment="payment",
    payment_method_view="error",
    order="purchase",
    delivered="error",
    funnel=STEPS,
    full_funnel=STEPS,
    journey_stages=STEPS,
    scoring_stages=STEPS,
    conversion_stages=STEPS,
    touchpoints=("signup", "view", "click", "error"),
    post_conversion=("purchase",),
    order_events=("purchase", "error"),
    platforms=("android", "ios"),
    event_types=("signup", "view", "click", "purchase", "error"),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "user_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        "event_type",
        "event_id",
        F.when(F.col("user_id") % 2 == 0, "ios").otherwise("android").alias("platform"),
        F.col("props").alias("event_properties"),
        F.concat(F.lit("device_"), (F.col("user_id") % 12).cast("string")).alias("device_family"),
        F.col("value").alias("order_total"),
    )


EV = """ev AS (
  SELECT event_id, user_id, ts AS event_time, event_type, props, value AS order_total, epoch_us(ts) AS us,
         CASE WHEN user_id % 2 = 0 THEN 'ios' ELSE 'android' END AS platform,
         'device_' || CAST(user_id % 12 AS VARCHAR) AS device_family
  FROM events)"""


def searches(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("event_properties", "$.k")
    return (
        events(spark, sf)
        .where(F.col("event_type") == "view")
        .select(
            "user_id",
            "event_time",
            "event_id",
            F.concat(F.when(k.cast("int") % 3 == 0, "pizza ").when(k.cast("int") % 3 == 1, "sushi ").otherwise("q"), k).alias("query"),
            (k.cast("int") % 5).cast("double").alias("results_count"),
        )
        .withColumn("zero_results", F.col("results_count") == 0)
    )


SE = """se AS (
  SELECT user_id, event_time, event_id, us,
         CASE WHEN k % 3 = 0 THEN 'pizza ' WHEN k % 3 = 1 THEN 'sushi ' ELSE 'q' END || CAST(k AS VARCHAR) AS query,
         CAST(k % 5 AS DOUBLE) AS results_count, (k % 5) = 0 AS zero_results
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM ev WHERE event_type = 'view'))"""


def orders(spark: SparkSession, sf: str) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    at = F.timestamp_micros(
        F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("l_orderkey") % 24) * F.lit(US_PER_HOUR)
    )
    return (
        li.join(o, li["l_orderkey"] == o["o_orderkey"])
        .join(s, li["l_suppkey"] == s["s_suppkey"])
        .join(n, s["s_nationkey"] == n["n_nationkey"])
        .select(
            F.col("o_custkey").alias("user_id"),
            at.alias("event_time"),
            (
                ((F.col("l_orderkey") * 16 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")
            ).alias("event_id"),
            F.when(F.col("o_custkey") % 2 == 0, "ios").otherwise("android").alias("platform"),
            F.col("l_orderkey").cast("string").alias("order_id"),
            F.col("s_name").alias("merchant"),
            F.col("l_suppkey").cast("string").alias("merchant_id"),
            F.col("n_name").alias("category"),
            F.col("l_extendedprice").alias("order_total"),
            F.col("o_orderpriority").alias("order_type"),
            (F.col("l_tax") * 100).alias("delivery_fee"),
            F.col("l_quantity").alias("quantity"),
            F.concat("l_returnflag", "l_linestatus").alias("payment_method"),
            F.when(F.col("l_discount") >= 0.05, F.concat(F.lit("P"), F.rint(F.col("l_discount") * 100).cast("int").cast("string"))).alias("promo_code"),
            (F.col("l_discount") >= 0.05).alias("has_promo"),
            F.when(F.col("l_discount") >= 0.05, F.col("l_extendedprice") * F.col("l_discount")).otherwise(0.0).alias("discount_amount"),
        )
    )


ORD = """o AS (
  SELECT o_custkey AS user_id, o_orderdate + to_hours(l_orderkey % 24) AS event_time,
         epoch_us(o_orderdate + to_hours(l_orderkey % 24)) AS us,
         ((l_orderkey * 16 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS event_id,
         CASE WHEN o_custkey % 2 = 0 THEN 'ios' ELSE 'android' END AS platform,
         CAST(l_orderkey AS VARCHAR) AS order_id, s_name AS merchant, n_name AS category,
         l_extendedprice AS order_total, l_tax * 100 AS delivery_fee, l_quantity AS quantity,
         l_returnflag || l_linestatus AS payment_method,
         CASE WHEN l_discount >= 0.05 THEN 'P' || CAST(CAST(round_even(l_discount * 100, 0) AS INTEGER) AS VARCHAR) END AS promo_code,
         l_discount >= 0.05 AS has_promo,
         CASE WHEN l_discount >= 0.05 THEN l_extendedprice * l_discount ELSE 0.0 END AS discount_amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey)"""


def checkouts(spark: SparkSession, sf: str) -> DataFrame:
    at = F.timestamp_micros(
        F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 24) * F.lit(US_PER_HOUR)
    )
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"),
        at.alias("event_time"),
        F.col("o_orderkey").alias("event_id"),
        F.col("o_orderkey").alias("order_id"),
        F.concat(F.lit("shop_"), (F.col("o_custkey") % 40).cast("string")).alias("merchant"),
        F.col("o_totalprice").alias("order_total"),
        F.col("o_orderstatus").alias("order_type"),
        (F.col("o_orderkey") % 23).cast("double").alias("delivery_fee"),
    )


def delivered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").cast("timestamp").alias("delivered_at")
    )


def matched(spark: SparkSession, sf: str) -> DataFrame:
    """Order to shipment in days stands in for minutes."""
    return match_deliveries(checkouts(spark, sf), delivered(spark, sf), US_PER_DAY)


DEL = """c AS (
  SELECT o_custkey AS user_id, o_orderdate + to_hours(o_orderkey % 24) AS event_time, o_orderkey AS order_id,
         'shop_' || CAST(o_custkey % 40 AS VARCHAR) AS merchant, o_totalprice AS order_total,
         o_orderstatus AS order_type, CAST(o_orderkey % 23 AS DOUBLE) AS delivery_fee
  FROM orders),
m AS (
  SELECT c.*, (epoch_us(l_shipdate) - epoch_us(event_time)) / 86400000000.0::DOUBLE AS minutes
  FROM c LEFT JOIN lineitem ON order_id = l_orderkey),
v AS (SELECT * FROM m WHERE minutes > 0 AND minutes < 180)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier")
    return (
        li.join(o, li["l_orderkey"] == o["o_orderkey"])
        .join(p, li["l_partkey"] == p["p_partkey"])
        .join(s, li["l_suppkey"] == s["s_suppkey"])
        .select(
            F.col("l_orderkey").alias("order_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("l_suppkey").cast("string").alias("merchant_id"),
            F.col("s_name").alias("merchant"),
            F.col("l_partkey").cast("string").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("price"),
        )
    )


LIN = """l AS (
  SELECT l_orderkey AS order_id, o_custkey AS user_id, s_name AS merchant, p_name AS product_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey)"""


def pct(num: str, den: str, digits: int) -> str:
    """SQL twin of ``percent(num, den, digits)``."""
    return f"round_even(CAST({num} AS DOUBLE) / NULLIF({den}, 0) * 100 * 1e{digits}, 0) / 1e{digits}"


def r(expr: str, digits: int) -> str:
    """SQL twin of ``round_half_even``."""
    return f"round_even(({expr}) * 1e{digits}, 0) / 1e{digits}"


def values(labels) -> str:
    """A VALUES list of (position, label)."""
    return ", ".join(f"({i + 1}, '{x}')" for i, x in enumerate(labels))


def sql_bins(x: str, edges, labels) -> str:
    """SQL twin of ``bins``."""
    whens = []
    for lo, hi, label in zip(edges, edges[1:], labels):
        upper = "" if hi == float("inf") else f" AND {x} <= {hi}"
        whens.append(f"WHEN {x} > {lo}{upper} THEN '{label}'")
    return "CASE " + " ".join(whens) + " END"

"""Delivery performance over checkouts and their matched deliveries.

``checkouts`` has one row per order; ``matched`` is checkouts left-joined with deliveries and carries
``minutes`` from order to delivery.  Times count only inside (0, 180).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.columns import (
    INF,
    bins,
    label_rows,
    percent,
    ratio,
    round_half_even,
    time_slot,
)
from tidelens.functions.distributed import quantiles, scalar_quantile, scalar_row
from tidelens.operators.promos import rule_rows

# Report buckets.
TIME_EDGES = (0, 15, 30, 45, 60, 90, 120, INF)
TIME_LABELS = ("<15 min", "15-30 min", "30-45 min", "45-60 min", "60-90 min", "90-120 min", "120+ min")
REORDER_EDGES = (0, 30, 45, 60, 90, INF)
REORDER_LABELS = ("<30 min", "30-45 min", "45-60 min", "60-90 min", "90+ min")
FEE_EDGES = (0, 5, 10, 15, 20, INF)
FEE_LABELS = ("0-5 QAR", "5-10 QAR", "10-15 QAR", "15-20 QAR", "20+ QAR")
SLOTS = (("Breakfast", 6, 11), ("Lunch", 11, 15), ("Afternoon", 15, 18), ("Dinner", 18, 22))


def valid(matched: DataFrame) -> DataFrame:
    return matched.where((F.col("minutes") > 0) & (F.col("minutes") < 180))


def _median(df: DataFrame) -> Column:
    return scalar_quantile(df, "minutes", 0.5)


def delivery_summary(checkouts: DataFrame, matched: DataFrame, delivered: DataFrame) -> DataFrame:
    """``delivered`` is the delivery frame itself: every delivery counts as fulfilled."""
    v = valid(matched)
    base = checkouts.agg(F.count(F.lit(1)).alias("total_orders"), F.countDistinct("user_id").alias("unique_customers"))
    n = delivered.agg(F.count(F.lit(1)).alias("n")).scalar()
    mean = v.agg(F.avg("minutes").alias("m")).scalar()
    return base.select(
        "total_orders",
        "unique_customers",
        F.coalesce(percent(n, F.col("total_orders"), 1), F.lit(0.0)).alias("fulfillment_rate"),
        F.coalesce(round_half_even(mean, 1), F.lit(0.0)).alias("avg_delivery_time_min"),
        F.coalesce(round_half_even(_median(v), 1), F.lit(0.0)).alias("median_delivery_time_min"),
        (n > 0).alias("has_delivery_data"),
    )


def order_types(checkouts: DataFrame) -> DataFrame:
    return checkouts.groupBy("order_type").agg(F.count(F.lit(1)).alias("orders"))


def _with_labels(df: DataFrame, labels, name: str) -> DataFrame:
    return label_rows(df.sparkSession, labels, name).join(df, name, "left")


def time_distribution(matched: DataFrame) -> DataFrame:
    g = valid(matched).groupBy(bins(F.col("minutes"), TIME_EDGES, TIME_LABELS).alias("delivery_time")).agg(
        F.count(F.lit(1)).alias("n")
    )
    n = F.coalesce("n", F.lit(0))
    return _with_labels(g, TIME_LABELS, "delivery_time").select(
        "delivery_time", n.alias("orders"), percent(n, F.sum(n).over(Window.partitionBy()), 1).alias("pct")
    )


def delivery_by_hour(checkouts: DataFrame, matched: DataFrame) -> DataFrame:
    hour = F.hour("event_time").alias("hour")
    volume = checkouts.groupBy(hour).agg(F.count(F.lit(1)).alias("orders"))
    v = valid(matched).select(hour, "minutes")
    times = v.groupBy("hour").agg(F.avg("minutes").alias("avg_delivery_time"))
    med = quantiles(v, "minutes", {"median_delivery_time": 0.5}, ["hour"])
    return (
        volume.join(times, "hour", "left")
        .join(med, "hour", "left")
        .withColumn("time_slot", time_slot(F.col("hour"), SLOTS, "Late Night"))
    )


def peak_hours(checkouts: DataFrame) -> DataFrame:
    """Hour-of-day statistics over clock hours; peak where the mean reaches the 75th percentile of the means."""
    clock = checkouts.groupBy(F.date_trunc("hour", "event_time").alias("t")).agg(F.count(F.lit(1)).alias("orders"))
    # one row per clock hour of history: the plain percentile is over a bounded frame
    g = clock.groupBy(F.hour("t").alias("hour")).agg(
        F.avg("orders").alias("avg_orders"),
        F.percentile("orders", F.lit(0.5)).alias("median_orders"),
        F.max("orders").alias("max_orders"),
        F.percentile("orders", F.lit(0.95)).alias("p95_orders"),
    )
    return g.withColumn("is_peak", F.col("avg_orders") >= F.percentile("avg_orders", F.lit(0.75)).over(Window.partitionBy()))


def merchant_performance(checkouts: DataFrame, matched: DataFrame, min_orders: int = 10) -> DataFrame:
    g = (
        checkouts.where(F.col("merchant").isNotNull())
        .groupBy("merchant")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.avg("order_total").alias("avg_order_value"),
            F.avg("delivery_fee").alias("avg_delivery_fee"),
        )
        .where(F.col("orders") >= min_orders)
    )
    v = valid(matched).where(F.col("merchant").isNotNull()).select("merchant", "minutes")
    times = v.groupBy("merchant").agg(F.avg("minutes").alias("avg_delivery_time"), F.count(F.lit(1)).alias("delivered_orders"))
    med = quantiles(v, "minutes", {"median_delivery_time": 0.5}, ["merchant"])
    return g.join(times, "merchant", "left").join(med, "merchant", "left")


def fastest_merchants(performance: DataFrame, n: int = 15) -> DataFrame:
    return performance.where(F.col("avg_delivery_time").isNotNull()).orderBy("avg_delivery_time", "merchant").limit(n)


def slowest_merchants(performance: DataFrame, n: int = 15) -> DataFrame:
    return performance.where(F.col("avg_delivery_time").isNotNull()).orderBy(F.desc("avg_delivery_time"), "merchant").limit(n)


def reorder_impact(checkouts: DataFrame, matched: DataFrame) -> DataFrame:
    """Per delivery-time bucket: orders, users, and % of orders whose user has more than one order."""
    counts = checkouts.groupBy("user_id").agg((F.count(F.lit(1)) > 1).alias("again"))
    per_user = (
        valid(matched)
        .groupBy(bins(F.col("minutes"), REORDER_EDGES, REORDER_LABELS).alias("delivery_time"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(counts, "user_id", "left")
    )
    g = per_user.groupBy("delivery_time").agg(
        F.sum("n").alias("orders"),
        F.count(F.lit(1)).alias("unique_users"),
        F.sum(F.when(F.col("again"), F.col("n")).otherwise(0)).alias("again"),
    )
    return _with_labels(g, REORDER_LABELS, "delivery_time").select(
        "delivery_time",
        F.coalesce("orders", F.lit(0)).alias("orders"),
        F.coalesce("unique_users", F.lit(0)).alias("unique_users"),
        round_half_even(ratio(F.col("again"), F.col("orders")) * 100, 1).alias("reorder_rate"),
    )


def _by_key(df: DataFrame, key: Column, name: str, *sums: str) -> DataFrame:
    return (
        df.groupBy(key.alias(name), "user_id")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
        .groupBy(name)
        .agg(
            F.sum("n").alias("orders"),
            F.count(F.lit(1)).alias("unique_customers"),
            *[F.sum(c).alias(c) for c in sums],
        )
    )


def order_type_analysis(checkouts: DataFrame) -> DataFrame:
    g = _by_key(checkouts, F.col("order_type"), "order_type", "order_total", "delivery_fee")
    n = F.col("orders")
    return g.select(
        "order_type",
        "orders",
        "unique_customers",
        ratio(F.col("order_total"), n).alias("avg_order_value"),
        ratio(F.col("delivery_fee"), n).alias("avg_delivery_fee"),
        percent(n, F.sum("orders").over(Window.partitionBy()), 1).alias("pct_of_orders"),
    )


def fee_impact(checkouts: DataFrame) -> DataFrame:
    paid = checkouts.where(F.col("delivery_fee") > 0).withColumnRenamed("delivery_fee", "fee")
    g = _by_key(paid, bins(F.col("fee"), FEE_EDGES, FEE_LABELS), "delivery_fee", "order_total")
    n = F.coalesce("orders", F.lit(0))
    return _with_labels(g, FEE_LABELS, "delivery_fee").select(
        "delivery_fee",
        n.alias("orders"),
        F.coalesce("unique_customers", F.lit(0)).alias("unique_customers"),
        ratio(F.col("order_total"), F.col("orders")).alias("avg_order_value"),
        percent(n, F.sum(n).over(Window.partitionBy()), 1).alias("pct_of_orders"),
    )


def delivery_recommendations(checkouts: DataFrame, matched: DataFrame, delivered: DataFrame) -> DataFrame:
    peaks = peak_hours(checkouts).where("is_peak").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("hour")), 1, 5), lambda h: F.concat(h.cast("string"), F.lit(":00"))), ", ").alias("hours"),
    )
    impact = reorder_impact(checkouts, matched).agg(
        F.max(F.when(F.col("delivery_time") == REORDER_LABELS[0], F.col("reorder_rate"))).alias("fast"),
        F.max(F.when(F.col("delivery_time") == REORDER_LABELS[-1], F.col("reorder_rate"))).alias("slow"),
    )
    facts = delivery_summary(checkouts, matched, delivered).select(
        "*", scalar_row(peaks).alias("peaks"), scalar_row(impact).alias("impact")
    )
    gain = F.col("impact.fast") - F.col("impact.slow")
    return rule_rows(
        facts,
        [
            (
                F.col("has_delivery_data") & (F.col("fulfillment_rate") < 90),
                F.lit("warning"),
                F.format_string("Low Fulfillment Rate (%.1f%%)", F.col("fulfillment_rate")),
                F.lit("Some orders are not being marked as delivered"),
                F.lit("Investigate order tracking and driver app compliance"),
            ),
            (
                F.col("avg_delivery_time_min") > 45,
                F.lit("warning"),
                F.format_string("High Average Delivery Time (%.0f min)", F.col("avg_delivery_time_min")),
                F.lit("Delivery times are above optimal threshold"),
                F.lit("Review logistics, driver allocation, and restaurant prep times"),
            ),
            (
                F.col("peaks.n") > 0,
                F.lit("info"),
                F.format_string("%d Peak Hours Identified", F.col("peaks.n")),
                F.format_string("Peak hours: %s", F.col("peaks.hours")),
                F.lit("Ensure adequate driver coverage during peak hours"),
            ),
            (
                gain > 10,
                F.lit("insight"),
                F.lit("Fast Delivery Drives Retention"),
                F.format_string("Users with <30 min delivery have %.1f%% higher reorder rate", gain),
                F.lit("Prioritize delivery speed for first-time customers"),
            ),
        ],
    )

"""Merchant metrics, health, risk, comparison, categories, time slots and customer overlap.

Input is the canonical orders frame (``merchant``, ``user_id``, ``event_time``, ``category``, money).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.columns import (
    US_PER_HOUR,
    bins,
    count_if,
    label_rows,
    micros,
    percent,
    ratio,
    round_half_even,
    time_slot,
)
from tidelens.functions.distributed import percentile_ranks, scalar_row, top_per_group, value_positions

# Day slots and health tiers.
SLOTS = (("breakfast", 6, 11), ("lunch", 11, 15), ("afternoon", 15, 18), ("dinner", 18, 22), ("late_night", 22, 6))
HEALTH_EDGES = (0, 25, 50, 75, 100)
HEALTH_TIERS = ("At Risk", "Needs Attention", "Healthy", "Thriving")


def merchant_metrics(orders: DataFrame) -> DataFrame:
    """One row per merchant, from (merchant, user), (merchant, day) and (merchant, category) partials."""
    users = (
        orders.groupBy("merchant", "user_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("order_total").alias("rev"),
            F.sum("quantity").alias("qty"),
            F.sum("delivery_fee").alias("fee"),
        )
        .groupBy("merchant")
        .agg(
            F.sum("n").alias("order_count"),
            F.count(F.lit(1)).alias("unique_customers"),
            F.sum("rev").alias("total_revenue"),
            F.sum("qty").alias("qty"),
            F.sum("fee").alias("fee"),
            (F.avg((F.col("n") > 1).cast("double")) * 100).alias("repeat_rate"),
        )
    )
    days = (
        orders.groupBy("merchant", F.to_date("event_time").alias("d"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("merchant")
        .agg(F.min("d").alias("first_order_date"), F.max("d").alias("last_order_date"), F.count(F.lit(1)).alias("active_days"))
    )
    category = (
        orders.where(F.col("category").isNotNull())
        .groupBy("merchant", "category")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("merchant")
        .agg(F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("primary_category"))
    )
    n = F.col("order_count")
    return (
        users.join(days, "merchant")
        .join(category, "merchant", "left")
        .select(
            "merchant",
            "order_count",
            "unique_customers",
            "total_revenue",
            ratio(F.col("total_revenue"), n).alias("avg_order_value"),
            ratio(F.col("qty"), n).alias("avg_items_per_order"),
            ratio(F.col("fee"), n).alias("avg_delivery_fee"),
            "first_order_date",
            "last_order_date",
            "active_days",
            round_half_even(ratio(n, F.col("unique_customers")), 2).alias("orders_per_customer"),
            "repeat_rate",
            F.coalesce("primary_category", F.lit("Unknown")).alias("primary_category"),
        )
    )


def health_scores(metrics: DataFrame, top_n: int | None = 50) -> DataFrame:
    """Mean of four percentile ranks (volume, repeat rate, orders per customer, recency), merchants with 5 orders."""
    base = metrics.where(F.col("order_count") >= 5)
    latest = base.agg(F.max("last_order_date").alias("d")).scalar()
    base = base.withColumn("idle_days", F.datediff(latest, F.col("last_order_date")))
    ranked = percentile_ranks(
        base, {"order_count": "_v", "repeat_rate": "_r", "orders_per_customer": "_o", "idle_days": "_i"}
    )
    score = (
        F.col("_v") * 100 * 0.25 + F.col("_r") * 100 * 0.25 + F.col("_o") * 100 * 0.25 + (100 - F.col("_i") * 100) * 0.25
    )
    out = ranked.withColumn("health_score", round_half_even(score, 1)).withColumn(
        "health_tier", bins(F.col("health_score"), HEALTH_EDGES, HEALTH_TIERS)
    )
    out = out.select(
        "merchant",
        "primary_category",
        "health_score",
        "health_tier",
        "order_count",
        "unique_customers",
        "repeat_rate",
        "orders_per_customer",
    )
    return out if top_n is None else out.orderBy(F.desc("health_score"), "merchant").limit(top_n)


def _halves(orders: DataFrame) -> DataFrame:
    """Orders up to and after the median order time per merchant, read off the value positions."""
    times = orders.select("merchant", micros(F.col("event_time")).alias("us"))
    lo = F.floor((F.col("total") - 1) * 0.5)
    # hour ranges; only the hour that holds a merchant's median is sorted
    pos = value_positions(
        times,
        "us",
        ["merchant"],
        lambda below, inside, total: (below <= F.floor((total - 1) * 0.5)) & (F.floor((total - 1) * 0.5) < below + inside),
        US_PER_HOUR,
    )
    upto = F.col("before") + F.col("cnt")
    return pos.groupBy("merchant").agg(
        F.max(F.when((F.col("before") <= lo) & (lo < upto), upto)).alias("first_half"), F.max("total").alias("_all")
    )


def at_risk(orders: DataFrame, metrics: DataFrame, min_orders: int = 10) -> DataFrame:
    """Additive risk score with the reasons as text."""
    m = metrics.where(F.col("order_count") >= min_orders).join(_halves(orders), "merchant")
    fee = ratio(F.col("avg_delivery_fee"), F.col("avg_order_value")) * 100
    rules = [
        (F.col("repeat_rate") < 10, 30, F.lit("Very low repeat rate (<10%)")),
        (F.col("orders_per_customer") < 1.1, 25, F.lit("Almost no repeat orders")),
        (
            (F.col("order_count") > 10) & ((F.col("_all") - F.col("first_half")) < F.col("first_half") * 0.7),
            30,
            F.lit("Declining order volume (-30%+)"),
        ),
        (
            (F.col("avg_delivery_fee") > 0) & (F.col("avg_order_value") > 0) & (fee > 20),
            15,
            F.format_string("High delivery fee ratio (%.0f%%)", fee),
        ),
    ]
    score = sum((F.when(c, p).otherwise(0) for c, p, _ in rules), F.lit(0))
    return (
        m.withColumn("risk_score", score)
        .where(F.col("risk_score") > 0)
        .select(
            "merchant",
            F.col("primary_category").alias("category"),
            "risk_score",
            F.concat_ws("; ", *[F.when(c, t) for c, _, t in rules]).alias("risk_factors"),
            "order_count",
            round_half_even(F.col("repeat_rate"), 1).alias("repeat_rate"),
        )
    )


def comparison(metrics: DataFrame, merchant: str) -> DataFrame:
    """One merchant against its category and all merchants; no row when the merchant is unknown."""
    target = metrics.where(F.col("merchant") == merchant).select(
        "merchant", "primary_category", "order_count", "repeat_rate", "orders_per_customer", "avg_order_value"
    )
    t = F.col("t")
    same = F.col("primary_category") == t["primary_category"]
    below = F.col("order_count") <= t["order_count"]

    def cat(c: str, digits: int):
        return round_half_even(F.avg(F.when(same, F.col(c))), digits)

    g = metrics.withColumn("t", scalar_row(target)).where(t.isNotNull()).groupBy("t").agg(
        cat("order_count", 1).alias("order_count_category_avg"),
        count_if(same & below).alias("order_count_category_rank"),
        count_if(same).alias("category_total"),
        round_half_even(F.avg(below.cast("double")) * 100, 1).alias("overall_percentile"),
        cat("repeat_rate", 1).alias("repeat_rate_category_avg"),
        round_half_even(F.avg("repeat_rate"), 1).alias("repeat_rate_overall_avg"),
        F.avg(F.when(same, F.col("repeat_rate"))).alias("_cr"),
        cat("orders_per_customer", 2).alias("orders_per_customer_category_avg"),
        round_half_even(F.avg("orders_per_customer"), 2).alias("orders_per_customer_overall_avg"),
        cat("avg_order_value", 2).alias("avg_order_value_category_avg"),
        round_half_even(F.avg("avg_order_value"), 2).alias("avg_order_value_overall_avg"),
    )
    return g.select(
        t["merchant"].alias("merchant"),
        t["primary_category"].alias("category"),
        t["order_count"].alias("order_count"),
        "order_count_category_avg",
        "order_count_category_rank",
        "category_total",
        "overall_percentile",
        round_half_even(t["repeat_rate"], 1).alias("repeat_rate"),
        "repeat_rate_category_avg",
        "repeat_rate_overall_avg",
        F.when(t["repeat_rate"] > F.col("_cr"), "Above Average").otherwise("Below Average").alias("repeat_rate_status"),
        round_half_even(t["orders_per_customer"], 2).alias("orders_per_customer"),
        "orders_per_customer_category_avg",
        "orders_per_customer_overall_avg",
        round_half_even(t["avg_order_value"], 2).alias("avg_order_value"),
        "avg_order_value_category_avg",
        "avg_order_value_overall_avg",
    )


def category_performance(metrics: DataFrame) -> DataFrame:
    g = metrics.groupBy(F.col("primary_category").alias("category")).agg(
        F.count(F.lit(1)).alias("merchant_count"),
        F.sum("order_count").alias("total_orders"),
        F.avg("order_count").alias("avg_orders_per_merchant"),
        F.sum("unique_customers").alias("total_customers"),
        F.sum("total_revenue").alias("total_revenue"),
        F.avg("repeat_rate").alias("avg_repeat_rate"),
        F.avg("orders_per_customer").alias("avg_orders_per_customer"),
    )
    total = F.sum("total_orders").over(Window.partitionBy())  # one row per category
    return g.withColumn("market_share", percent(F.col("total_orders"), total, 1))


def time_performance(orders: DataFrame, merchant: str | None = None) -> DataFrame:
    o = orders.where(F.col("merchant") == merchant) if merchant else orders
    slot = time_slot(F.hour("event_time"), SLOTS, "other")
    # (slot, user) first: the distinct customers become a plain count
    g = (
        o.groupBy(slot.alias("time_slot"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("order_total").alias("rev"))
        .groupBy("time_slot")
        .agg(F.sum("n").alias("orders"), F.count(F.lit(1)).alias("unique_customers"), F.sum("rev").alias("rev"))
    )
    order = label_rows(orders.sparkSession, [s[0] for s in SLOTS], "time_slot")
    return (
        g.join(order, "time_slot")
        .withColumn("pct_of_orders", percent(F.col("orders"), F.sum("orders").over(Window.partitionBy()), 1))
        .orderBy("position")
        .select(
            "time_slot", "orders", "unique_customers", ratio(F.col("rev"), F.col("orders")).alias("avg_order_value"), "pct_of_orders"
        )
    )


def top_by_category(metrics: DataFrame, n: int = 5) -> DataFrame:
    top = top_per_group(metrics, ["primary_category"], [F.desc("order_count"), F.asc("merchant")], n)
    return top.select("primary_category", "merchant", "order_count", "unique_customers", "repeat_rate", "orders_per_customer")


def new_merchants(metrics: DataFrame, days_threshold: int = 7) -> DataFrame:
    latest = metrics.agg(F.max("last_order_date").alias("d")).scalar()
    return metrics.where(F.col("first_order_date") >= F.date_sub(latest, days_threshold)).select(
        "merchant", "primary_category", "first_order_date", "order_count", "unique_customers", "orders_per_customer"
    )


def customer_overlap(orders: DataFrame, a: str, b: str) -> DataFrame:
    """Customer sets of two merchants from one scan: two flags per user."""
    m = F.col("merchant")
    u = orders.where(m.isin(a, b)).groupBy("user_id").agg(F.max(m == a).alias("a"), F.max(m == b).alias("b"))
    fa, fb = F.col("a"), F.col("b")
    g = u.agg(
        F.coalesce(count_if(fa), F.lit(0)).alias("customers_a"),
        F.coalesce(count_if(fb), F.lit(0)).alias("customers_b"),
        F.coalesce(count_if(fa & fb), F.lit(0)).alias("overlap"),
    )
    both = F.col("overlap")
    return g.select(
        F.lit(a).alias("merchant_a"),
        F.lit(b).alias("merchant_b"),
        "customers_a",
        "customers_b",
        "overlap",
        F.coalesce(percent(both, F.col("customers_a"), 1), F.lit(0.0)).alias("overlap_pct_of_a"),
        F.coalesce(percent(both, F.col("customers_b"), 1), F.lit(0.0)).alias("overlap_pct_of_b"),
        (F.col("customers_a") - both).alias("only_a"),
        (F.col("customers_b") - both).alias("only_b"),
    )


def summary(orders: DataFrame, metrics: DataFrame) -> DataFrame:
    top = category_performance(metrics).agg(
        F.min_by("category", F.struct(-F.col("total_orders"), F.col("category"))).alias("c")
    )
    customers = orders.agg(F.countDistinct("user_id").alias("n"))
    return metrics.agg(
        F.count(F.lit(1)).alias("total_merchants"),
        F.sum("order_count").alias("total_orders"),
        F.sum("total_revenue").alias("total_revenue"),
        round_half_even(F.avg("repeat_rate"), 1).alias("avg_repeat_rate"),
        round_half_even(F.avg("orders_per_customer"), 2).alias("avg_orders_per_customer"),
    ).select(
        "*",
        customers.scalar().alias("total_customers"),
        F.coalesce(top.scalar(), F.lit("Unknown")).alias("top_category"),
    )


def tier_counts(health: DataFrame) -> DataFrame:
    return health.where(F.col("health_tier").isNotNull()).groupBy("health_tier").agg(F.count(F.lit(1)).alias("merchants"))


def merchant_names(orders: DataFrame) -> DataFrame:
    return orders.select("merchant").distinct().orderBy("merchant")

"""Promotion usage, retention, dependency and effectiveness.

Input is the canonical orders frame; a user's first order is marked by comparing each order with the
user's earliest (time, id), an aggregate joined back, instead of numbering all orders of a user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.columns import count_if, flag_mean, label_rows, percent, ratio, round_half_even
from tidelens.functions.distributed import percentile_ranks

# User types in display order.
USER_TYPES = (
    "Promo Dependent (100% promo)",
    "High Promo (70%+)",
    "Mixed (30-70% promo)",
    "Occasional Promo (<30%)",
    "Organic Only",
    "Single Order",
)


def with_first_order(orders: DataFrame) -> DataFrame:
    """Adds ``is_first_order``."""
    first = orders.groupBy("user_id").agg(F.min(F.struct("event_time", "event_id")).alias("_first"))
    at = F.struct("event_time", "event_id")
    return orders.join(first, "user_id").withColumn("is_first_order", at == F.col("_first")).drop("_first")


def promo_summary(orders: DataFrame) -> DataFrame:
    promo = F.col("has_promo")
    # per user first: promo users and users become counts
    u = orders.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        count_if(promo).alias("p"),
        F.sum("discount_amount").alias("d"),
        F.sum(F.when(promo, F.col("discount_amount"))).alias("pd"),
    )
    codes = orders.where(promo).agg(F.countDistinct("promo_code").alias("c"))
    g = u.agg(
        F.sum("n").alias("total_orders"),
        F.sum("p").alias("promo_orders"),
        count_if(F.col("p") > 0).alias("promo_users"),
        F.count(F.lit(1)).alias("total_users"),
        F.sum("d").alias("total_discount_given"),
        F.sum("pd").alias("pd"),
    )
    return g.select(
        "total_orders",
        "promo_orders",
        F.coalesce(percent(F.col("promo_orders"), F.col("total_orders"), 1), F.lit(0.0)).alias("promo_rate"),
        codes.scalar().alias("unique_promo_codes"),
        "promo_users",
        "total_users",
        F.coalesce(percent(F.col("promo_users"), F.col("total_users"), 1), F.lit(0.0)).alias("user_promo_rate"),
        "total_discount_given",
        F.coalesce(ratio(F.col("pd"), F.col("promo_orders")), F.lit(0.0)).alias("avg_discount"),
    )


def promo_performance(orders: DataFrame, min_uses: int = 5) -> DataFrame:
    """Per code; ``orders`` carries ``is_first_order`` (see :func:`with_first_order`)."""
    g = (
        orders.where(F.col("has_promo"))
        .groupBy("promo_code", "user_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("order_total").alias("rev"),
            F.sum("discount_amount").alias("disc"),
            F.sum(F.col("is_first_order").cast("int")).alias("f"),
        )
        .groupBy("promo_code")
        .agg(
            F.sum("n").alias("uses"),
            F.count(F.lit(1)).alias("unique_users"),
            F.sum("rev").alias("total_revenue"),
            F.sum("disc").alias("total_discount"),
            F.sum("f").alias("f"),
        )
        .where(F.col("uses") >= min_uses)
    )
    uses = F.col("uses")
    aov, avg_disc = ratio(F.col("total_revenue"), uses), ratio(F.col("total_discount"), uses)
    return g.select(
        "promo_code",
        "uses",
        "unique_users",
        round_half_even(ratio(uses, F.col("unique_users")), 2).alias("uses_per_user"),
        "total_revenue",
        aov.alias("avg_order_value"),
        "total_discount",
        avg_disc.alias("avg_discount"),
        round_half_even(F.try_divide(avg_disc, aov) * 100, 1).alias("discount_rate"),
        round_half_even(ratio(F.col("f"), uses) * 100, 1).alias("first_order_rate"),
        F.coalesce(round_half_even(ratio(F.col("total_revenue"), F.col("total_discount")), 2), F.lit(0.0)).alias("revenue_per_discount"),
    )


def first_order_promos(orders: DataFrame, min_first_orders: int = 3) -> DataFrame:
    """Codes used on first orders and the share of those users with a later order."""
    counts = orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("_orders"))
    first = orders.where(F.col("is_first_order") & F.col("has_promo")).join(counts, "user_id")
    g = first.groupBy("promo_code").agg(
        F.count(F.lit(1)).alias("first_orders"),
        F.avg("order_total").alias("avg_order_value"),
        F.avg("discount_amount").alias("avg_discount"),
        count_if(F.col("_orders") > 1).alias("users_returned"),
    )
    return g.where(F.col("first_orders") >= min_first_orders).select(
        "promo_code",
        "first_orders",
        "avg_order_value",
        "avg_discount",
        F.col("first_orders").alias("users_acquired"),
        "users_returned",
        percent(F.col("users_returned"), F.col("first_orders"), 1).alias("retention_rate"),
    )


def promo_vs_organic(orders: DataFrame) -> DataFrame:
    key = F.when(F.col("has_promo"), "Promo").otherwise("Organic").alias("has_promo")
    users = (
        orders.groupBy(key, "user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("order_total").alias("rev"))
        .groupBy("has_promo")
        .agg(F.sum("n").alias("orders"), F.count(F.lit(1)).alias("unique_users"), F.sum("rev").alias("rev"))
    )
    merchants = orders.groupBy(key).agg(F.countDistinct("merchant").alias("unique_merchants"))
    return users.join(merchants, "has_promo").select(
        "has_promo",
        "orders",
        "unique_users",
        ratio(F.col("rev"), F.col("orders")).alias("avg_order_value"),
        "unique_merchants",
        round_half_even(ratio(F.col("orders"), F.col("unique_users")), 2).alias("orders_per_user"),
    )


def promo_by_merchant(orders: DataFrame, top_n: int = 20, min_orders: int = 10) -> DataFrame:
    g = orders.groupBy("merchant").agg(
        F.count(F.lit(1)).alias("total_orders"),
        count_if(F.col("has_promo")).alias("promo_orders"),
        F.sum("discount_amount").alias("total_discount"),
        F.sum("order_total").alias("total_revenue"),
    )
    return (
        g.where(F.col("total_orders") >= min_orders)
        .orderBy(F.desc("promo_orders"), "merchant")
        .limit(top_n)
        .select(
            "merchant",
            "total_orders",
            "promo_orders",
            round_half_even(ratio(F.col("promo_orders"), F.col("total_orders")) * 100, 1).alias("promo_rate"),
            "total_discount",
            "total_revenue",
            F.coalesce(round_half_even(ratio(F.col("total_discount"), F.col("total_revenue")) * 100, 2), F.lit(0.0)).alias(
                "discount_pct_revenue"
            ),
        )
    )


def promo_cannibalization(orders: DataFrame) -> DataFrame:
    u = orders.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), flag_mean(F.col("has_promo")).alias("share"), F.avg("order_total").alias("aov")
    )
    share = F.col("share")
    kind = (
        F.when(F.col("n") == 1, USER_TYPES[5])
        .when(share == 1, USER_TYPES[0])
        .when(share >= 0.7, USER_TYPES[1])
        .when(share >= 0.3, USER_TYPES[2])
        .when(share > 0, USER_TYPES[3])
        .otherwise(USER_TYPES[4])
    )
    g = u.groupBy(kind.alias("user_type")).agg(
        F.count(F.lit(1)).alias("users"), F.avg("n").alias("avg_orders"), F.avg("aov").alias("avg_order_value")
    )
    return (
        g.withColumn("pct_of_users", percent(F.col("users"), F.sum("users").over(Window.partitionBy()), 1))
        .join(label_rows(orders.sparkSession, USER_TYPES, "user_type"), "user_type")
        .orderBy("position")
        .select("user_type", "users", "avg_orders", "avg_order_value", "pct_of_users")
    )


def promo_timing(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.hour("event_time").alias("hour")).agg(
        F.count(F.lit(1)).alias("orders"), round_half_even(flag_mean(F.col("has_promo")) * 100, 1).alias("promo_rate")
    )


def payment_methods(orders: DataFrame) -> DataFrame:
    return orders.groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("orders"),
        count_if(F.col("has_promo")).alias("promo_orders"),
        round_half_even(flag_mean(F.col("has_promo")) * 100, 1).alias("promo_rate"),
        F.avg("order_total").alias("avg_order_value"),
    )


def promo_effectiveness(orders: DataFrame) -> DataFrame:
    """Percentile ranks of acquisition, retention, efficiency and reach, weighted 30/30/25/15."""
    perf = promo_performance(orders, 3).join(
        first_order_promos(orders).select("promo_code", "retention_rate"), "promo_code", "left"
    )
    perf = perf.withColumn("retention_rate", F.coalesce("retention_rate", F.lit(0.0)))
    ranked = percentile_ranks(
        perf, {"first_order_rate": "_a", "retention_rate": "_r", "revenue_per_discount": "_e", "unique_users": "_u"}
    )
    score = F.col("_a") * 100 * 0.30 + F.col("_r") * 100 * 0.30 + F.col("_e") * 100 * 0.25 + F.col("_u") * 100 * 0.15
    return ranked.select(
        "promo_code",
        "uses",
        "unique_users",
        round_half_even(score, 1).alias("effectiveness_score"),
        "first_order_rate",
        "retention_rate",
        "revenue_per_discount",
        "avg_order_value",
        "avg_discount",
    )


def promo_recommendations(orders: DataFrame) -> DataFrame:
    """Rules that fire, one row each: type, title, message, action."""
    dependent = promo_cannibalization(orders).where(F.col("user_type") == USER_TYPES[0]).agg(F.max("pct_of_users").alias("d"))
    costly = promo_performance(orders, 3).where(F.col("discount_rate") > 30).agg(F.count(F.lit(1)).alias("h"))
    facts = promo_summary(orders).select(
        "promo_rate", dependent.scalar().alias("dependent"), costly.scalar().alias("costly")
    )
    return rule_rows(
        facts,
        [
            (
                F.col("dependent") > 10,
                F.lit("warning"),
                F.lit("High Promo Dependency"),
                F.format_string("%.1f%% of repeat users only order with promos", F.col("dependent")),
                F.lit("Consider limiting promo frequency for heavy promo users"),
            ),
            (
                F.col("promo_rate") < 5,
                F.lit("opportunity"),
                F.lit("Low Promo Utilization"),
                F.format_string("Only %.1f%% of orders use promos", F.col("promo_rate")),
                F.lit("Consider targeted promo campaigns to drive acquisition"),
            ),
            (
                F.col("costly") > 0,
                F.lit("warning"),
                F.lit("High Discount Promos"),
                F.format_string("%d promo codes have >30%% discount rate", F.col("costly")),
                F.lit("Review profitability of these high-discount promos"),
            ),
        ],
    )


def rule_rows(facts: DataFrame, rules) -> DataFrame:
    """Turns a one-row facts frame into the rows of the rules that hold."""
    cells = [
        F.when(cond, F.struct(kind.alias("type"), title.alias("title"), msg.alias("message"), act.alias("action")))
        for cond, kind, title, msg, act in rules
    ]
    return facts.select(F.explode(F.array_compact(F.array(*cells))).alias("r")).select("r.*")

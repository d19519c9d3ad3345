"""Dormant users: features, reactivation score, incentive, campaign segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.functions.columns import INF, bins, clip, count_if, days, micros, ratio
from tidelens.functions.distributed import first_rows, quantiles, scalar_row
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary
from tidelens.sources.normalise import with_order_value

# Tiers, campaign texts and the segment catalogue.
DORMANCY_EDGES = (0, 14, 30, 60, 90, INF)
DORMANCY_TIERS = ("2_weeks", "1_month", "2_months", "3_months", "3_months+")
SCORE_EDGES = (0, 25, 50, 75, 100)
SCORE_TIERS = ("low", "medium", "high", "very_high")
MESSAGES = {
    "reminder": "We miss you! Your favorites are waiting.",
    "free": "Come back for free delivery on your next order!",
    "percent": "We want you back! Enjoy %d%% off your next order.",
    "fixed": "Special offer: 20 QAR off your next order!",
    "skip": "User may not be worth reactivation cost",
}
CAMPAIGNS = (
    ("high_value_recently_dormant", "push_notification", "free_delivery", 1),
    ("frequent_orderers_churned", "email", "15%_discount", 2),
    ("one_time_buyers", "sms", "20%_first_reorder", 3),
    ("long_dormant_whales", "personal_call", "vip_offer", 4),
    ("never_converted", "retargeting_ads", "first_order_discount", 5),
)


def _inactive(events: DataFrame) -> Column:
    latest = events.agg(F.max(micros(F.col("event_time"))).alias("m")).scalar()
    return days(latest - F.col("last_us"))


def dormant_users(events: DataFrame, dormancy_days: float = 14) -> DataFrame:
    u = events.groupBy("user_id").agg(F.max(micros(F.col("event_time"))).alias("last_us"))
    return (
        u.withColumn("days_inactive", _inactive(events))
        .where(F.col("days_inactive") >= dormancy_days)
        .select(
            "user_id",
            F.timestamp_micros("last_us").alias("last_activity"),
            "days_inactive",
            bins(F.col("days_inactive"), DORMANCY_EDGES, DORMANCY_TIERS).alias("dormancy_tier"),
        )
    )


def dormant_features(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, dormancy_days: float = 14) -> DataFrame:
    """Behaviour of dormant users from one (user, day) then user aggregate over all events."""
    t, us = F.col("event_type"), micros(F.col("event_time"))
    src = with_order_value(events, vocab)
    daily = src.groupBy("user_id", F.to_date("event_time").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(t == vocab.order).alias("orders"),
        F.sum("order_value").alias("rev"),
        F.count("order_value").alias("priced"),
        F.collect_set("event_type").alias("types"),  # at most the vocabulary
        count_if(t.isin(vocab.add, vocab.cart_created, vocab.cart)).alias("cart"),
        count_if(t == vocab.search).alias("search"),
        F.min(us).alias("a"),
        F.max(us).alias("b"),
        F.min(F.when(t == vocab.order, us)).alias("oa"),
        F.max(F.when(t == vocab.order, us)).alias("ob"),
    )
    platforms = (
        events.where(F.col("platform").isNotNull())
        .groupBy("user_id", "platform")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("user_id")
        .agg(F.min_by("platform", F.struct(-F.col("n"), F.col("platform"))).alias("primary_platform"))
    )
    u = daily.groupBy("user_id").agg(
        F.sum("n").alias("total_events"),
        F.count("day").alias("total_sessions"),
        F.sum("orders").alias("total_orders"),
        F.coalesce(F.sum("rev"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(ratio(F.sum("rev"), F.sum("priced")), F.lit(0.0)).alias("avg_order_value"),
        F.size(F.array_distinct(F.flatten(F.collect_set("types")))).alias("unique_event_types"),
        F.sum("cart").alias("cart_events"),
        F.sum("search").alias("search_events"),
        F.min("a").alias("first_us"),
        F.max("b").alias("last_us"),
        F.min("oa").alias("oa"),
        F.max("ob").alias("ob"),
    )
    gap = F.when(F.col("total_orders") > 1, days(F.col("ob") - F.col("oa")) / (F.col("total_orders") - 1)).otherwise(0.0)
    return (
        u.withColumn("days_inactive", _inactive(events))
        .where(F.col("days_inactive") >= dormancy_days)
        .join(platforms, "user_id", "left")
        .select(
            "user_id",
            "total_events",
            "total_sessions",
            "total_orders",
            "total_revenue",
            "avg_order_value",
            "unique_event_types",
            "cart_events",
            "search_events",
            F.coalesce("primary_platform", F.lit("unknown")).alias("primary_platform"),
            F.timestamp_micros("first_us").alias("first_seen"),
            F.timestamp_micros("last_us").alias("last_seen"),
            days(F.col("last_us") - F.col("first_us")).alias("tenure_days"),
            gap.alias("avg_order_gap_days"),
            "days_inactive",
            bins(F.col("days_inactive"), DORMANCY_EDGES, DORMANCY_TIERS).alias("dormancy_tier"),
        )
    )


def reactivation_scores(features: DataFrame) -> DataFrame:
    def part(value: Column, weight: float) -> Column:
        return clip(value, 0, 1) * weight

    return (
        features.withColumn("order_score", part(F.col("total_orders") / F.lit(10.0), 30))
        .withColumn("revenue_score", part(F.col("total_revenue") / F.lit(500.0), 25))
        .withColumn("engagement_score", part(F.col("unique_event_types") / F.lit(10.0), 15))
        .withColumn("recency_score", part(1 - F.col("days_inactive") / F.lit(90.0), 20))
        .withColumn("tenure_score", part(F.col("tenure_days") / F.lit(60.0), 10))
        .withColumn(
            "reactivation_score",
            F.col("order_score") + F.col("revenue_score") + F.col("engagement_score") + F.col("recency_score") + F.col("tenure_score"),
        )
        .withColumn("reactivation_tier", bins(F.col("reactivation_score"), SCORE_EDGES, SCORE_TIERS))
    )


def with_incentives(scored: DataFrame) -> DataFrame:
    """Adds incentive type, value (raised by half, at most 30, beyond 60 days), message and priority."""
    s, aov = F.col("reactivation_score"), F.col("avg_order_value")
    kind = (
        F.when(s >= 75, "reminder")
        .when((s >= 50) & (aov > 100), "percentage_discount")
        .when(s >= 50, "free_delivery")
        .when(s >= 25, "percentage_discount")
        .when(F.col("total_orders") > 0, "fixed_discount")
        .otherwise("skip")
    )
    low = F.when(aov > 50, 15).otherwise(20)
    value = (
        F.when(s >= 75, 0)
        .when((s >= 50) & (aov > 100), 10)
        .when(s >= 50, 0)
        .when(s >= 25, low)
        .when(F.col("total_orders") > 0, 20)
        .otherwise(0)
        .cast("double")
    )
    text = (
        F.when(s >= 75, MESSAGES["reminder"])
        .when(s >= 50, MESSAGES["free"])
        .when(s >= 25, F.format_string(MESSAGES["percent"], low))
        .when(F.col("total_orders") > 0, MESSAGES["fixed"])
        .otherwise(MESSAGES["skip"])
    )
    raised = F.when(
        (F.col("days_inactive") > 60) & (F.col("incentive_type") != "skip"), F.least(value * 1.5, F.lit(30.0))
    ).otherwise(value)
    return (
        scored.withColumn("incentive_type", kind)
        .withColumn("incentive_value", raised)
        .withColumn("suggested_message", text)
        .withColumn("priority", F.when(s >= 50, "high").when(s >= 25, "medium").otherwise("low"))
    )


def _rules(scored: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Campaign predicates; revenue thresholds come from one scalar sub-query."""
    q = quantiles(scored, "total_revenue", {"median": 0.5, "p75": 0.75})
    # Revenue and thresholds come from two evaluations: compare without the last digits of the sums.
    rev, orders, idle = F.round("total_revenue", 6), F.col("total_orders"), F.col("days_inactive")
    with_q = scored.withColumn("_q", scalar_row(q))
    return with_q, {
        "high_value_recently_dormant": (rev > F.round("_q.median", 6)) & (idle <= 30),
        "frequent_orderers_churned": (orders >= 3) & (idle > 30),
        "one_time_buyers": (orders == 1) & (idle <= 45),
        "long_dormant_whales": (rev > F.round("_q.p75", 6)) & (idle > 60),
        "never_converted": orders == 0,
    }


def campaign_segments(scored: DataFrame) -> DataFrame:
    """Size, mean revenue and orders of each (overlapping) campaign segment that has users."""
    with_q, rules = _rules(scored)
    tags = F.array_compact(
        F.array(
            *[
                F.when(
                    rules[name],
                    F.struct(
                        F.lit(name).alias("segment"),
                        F.lit(channel).alias("recommended_channel"),
                        F.lit(incentive).alias("recommended_incentive"),
                        F.lit(priority).alias("priority"),
                    ),
                )
                for name, channel, incentive, priority in CAMPAIGNS
            ]
        )
    )
    rows = with_q.select(F.explode(tags).alias("t"), "total_revenue", "total_orders").select("t.*", "total_revenue", "total_orders")
    never = F.col("segment") == "never_converted"
    g = rows.groupBy("segment", "recommended_channel", "recommended_incentive", "priority").agg(
        F.count(F.lit(1)).alias("user_count"), F.avg("total_revenue").alias("r"), F.avg("total_orders").alias("o")
    )
    return g.select(
        "segment",
        "user_count",
        F.when(never, 0.0).otherwise(F.col("r")).alias("avg_revenue"),
        F.when(never, 0.0).otherwise(F.col("o")).alias("avg_orders"),
        "recommended_channel",
        "recommended_incentive",
        "priority",
    )


def export_for_campaign(scored: DataFrame, segment: str | None = None, limit: int | None = None) -> DataFrame:
    """All users of a segment, or the best ``limit`` of them.  Segments other than the first three names do not filter."""
    base = scored
    if segment in ("high_value_recently_dormant", "frequent_orderers_churned", "one_time_buyers"):
        with_q, rules = _rules(scored)
        base = with_q.where(rules[segment])
    return (
        first_rows(with_incentives(base), limit, F.desc("reactivation_score"), "user_id")
        .select(
            "user_id",
            "days_inactive",
            "dormancy_tier",
            "total_orders",
            "total_revenue",
            "avg_order_value",
            "reactivation_score",
            "reactivation_tier",
            "incentive_type",
            "incentive_value",
            "suggested_message",
            "priority",
            "primary_platform",
        )
    )


def reactivation_summary(scored: DataFrame) -> DataFrame:
    high = F.col("reactivation_tier").isin("high", "very_high")
    return scored.agg(
        F.count(F.lit(1)).alias("total_dormant_users"),
        F.avg("days_inactive").alias("avg_days_inactive"),
        *[count_if(F.col("dormancy_tier") == t).alias(f"dormant_{t.replace('+', '_plus')}") for t in DORMANCY_TIERS],
        *[count_if(F.col("reactivation_tier") == t).alias(f"potential_{t}") for t in SCORE_TIERS],
        count_if(high).alias("high_potential_users"),
        F.coalesce(F.sum(F.when(high, F.col("total_revenue"))), F.lit(0.0)).alias("potential_recoverable_revenue"),
    )

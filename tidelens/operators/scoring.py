"""Customer profiles, engagement and health scores, lifecycle stages, next best action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.columns import (
    bins,
    clip,
    count_if,
    literal_rows,
    micros,
    percent,
    ratio,
    round_half_even,
    whole_days,
)
from tidelens.functions.distributed import chunk_window, first_rows, with_chunks
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary

# Tiers, stage values and the action catalogue.
TIER_EDGES = (0, 25, 50, 75, 100)
ENGAGEMENT_TIERS = ("Dormant", "Low", "Medium", "High")
HEALTH_TIERS = ("Critical", "At Risk", "Healthy", "Champion")
STAGE_VALUES = (
    ("New - Exploring", 20),
    ("New - High Intent", 40),
    ("Browser - Recent", 15),
    ("Browser - Inactive", 5),
    ("Browser - Lost", 0),
    ("First Purchase - Recent", 60),
    ("First Purchase - Waiting", 45),
    ("First Purchase - At Risk", 25),
    ("Repeat - Active", 100),
    ("Repeat - Cooling", 70),
    ("Repeat - Lapsed", 30),
    ("Unknown", 10),
)
ACTIONS = (
    ("New - High Intent", "First Order Incentive", "Push/Email", "Complete your first order with 20% off", "High", "Conversion"),
    ("First Purchase - Recent", "Second Order Campaign", "Push/Email", "Welcome back! Try something new", "High", "Retention"),
    ("First Purchase - At Risk", "Win Back Offer", "Email/SMS", "We miss you! Here's a special offer", "Medium", "Reactivation"),
    ("Repeat - Active", "Loyalty Rewards", "In-App", "Earn points on every order", "Low", "LTV Increase"),
    ("Repeat - Lapsed", "Re-engagement Campaign", "Email/SMS", "Come back! Your favorites are waiting", "High", "Reactivation"),
    ("Browser - Recent", "Personalized Recommendations", "Push/Email", "Discover restaurants you'll love", "Medium", "Conversion"),
    ("Browser - Inactive", "Personalized Recommendations", "Push/Email", "Discover restaurants you'll love", "Medium", "Conversion"),
    ("Browser - Lost", "Personalized Recommendations", "Push/Email", "Discover restaurants you'll love", "Medium", "Conversion"),
)
DEFAULT_ACTION = ("General Engagement", "Push", "Check out what's new", "Low", "Engagement")


def _first_half_engagement(events: DataFrame, totals: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Add and order events among the first ``floor(n/2)`` events of each user.

    Whole time chunks before the midpoint are summed; only the one chunk per user that holds the
    midpoint is ranked row by row.
    """
    e = with_chunks(events.select("user_id", "event_time", "event_id", "event_type")).withColumn(
        "hit", F.col("event_type").isin(vocab.add, vocab.order).cast("int")
    )
    w = Window.partitionBy("user_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunks = (
        e.groupBy("user_id", "chunk")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
        .withColumn("upto", F.sum("n").over(w))
        .join(totals.select("user_id", F.floor(F.col("total_events") / 2).alias("mid")), "user_id")
    )
    whole = chunks.where(F.col("upto") <= F.col("mid")).groupBy("user_id").agg(F.sum("hits").alias("first_hits"))
    split = chunks.where((F.col("upto") > F.col("mid")) & (F.col("upto") - F.col("n") < F.col("mid"))).select(
        "user_id", "chunk", (F.col("mid") - (F.col("upto") - F.col("n"))).alias("k")
    )
    part = (
        e.join(split, ["user_id", "chunk"])
        .withColumn("rn", F.row_number().over(chunk_window()))
        .where(F.col("rn") <= F.col("k"))
        .groupBy("user_id")
        .agg(F.sum("hit").alias("first_hits"))
    )
    return whole.unionByName(part).groupBy("user_id").agg(F.sum("first_hits").alias("first_hits"))


def customer_profiles(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """One row per user: activity span, orders, engagement counts, funnel depth, platform, halves."""
    t = F.col("event_type")
    us = micros(F.col("event_time"))
    stages = vocab.scoring_stages
    depth = F.lit(0)
    for i, s in enumerate(stages):
        depth = F.when(t == s, i + 1).otherwise(depth)
    latest = events.agg(F.max(us).alias("m")).scalar()
    platforms = (
        events.where(F.col("platform").isNotNull())
        .groupBy("user_id", "platform")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("user_id")
        .agg(F.min_by("platform", F.struct(-F.col("n"), F.col("platform"))).alias("platform"))
    )
    g = events.groupBy("user_id").agg(
        F.min(us).alias("first_us"),
        F.max(us).alias("last_us"),
        F.count(F.lit(1)).alias("total_events"),
        count_if(t == vocab.order).alias("order_count"),
        count_if(t == vocab.product_view).alias("product_view_count"),
        count_if(t == vocab.add).alias("add_count"),
        count_if(t == vocab.search).alias("search_count"),
        count_if(t == vocab.merchant_view).alias("merchant_view_count"),
        count_if(t == vocab.homepage).alias("homes"),
        F.max(depth).alias("max_funnel_stage"),
    )
    halves = _first_half_engagement(events, g, vocab)
    return (
        g.join(platforms, "user_id", "left")
        .join(halves, "user_id", "left")
        .select(
            "user_id",
            F.timestamp_micros("first_us").alias("first_seen"),
            F.timestamp_micros("last_us").alias("last_seen"),
            "total_events",
            whole_days(latest - F.col("last_us")).alias("days_since_last"),
            whole_days(latest - F.col("first_us")).alias("days_since_first"),
            (whole_days(F.col("last_us") - F.col("first_us")) + 1).alias("active_days"),
            "order_count",
            "product_view_count",
            "add_count",
            "search_count",
            "merchant_view_count",
            F.when(F.col("homes") > 0, F.col("homes")).otherwise(1).alias("sessions"),
            "max_funnel_stage",
            F.coalesce("platform", F.lit("unknown")).alias("platform"),
            F.coalesce("first_hits", F.lit(0)).alias("first_hits"),
            (F.col("add_count") + F.col("order_count") - F.coalesce("first_hits", F.lit(0))).alias("second_hits"),
        )
    )


def _stage() -> Column:
    o, first, last, depth = (F.col(c) for c in ("order_count", "days_since_first", "days_since_last", "max_funnel_stage"))
    return (
        F.when((first <= 7) & (o == 0) & (depth >= 3), "New - High Intent")
        .when((first <= 7) & (o == 0), "New - Exploring")
        .when((o == 1) & (last <= 7), "First Purchase - Recent")
        .when((o == 1) & (last <= 30), "First Purchase - Waiting")
        .when(o == 1, "First Purchase - At Risk")
        .when((o >= 2) & (last <= 14), "Repeat - Active")
        .when((o >= 2) & (last <= 30), "Repeat - Cooling")
        .when(o >= 2, "Repeat - Lapsed")
        .when((o == 0) & (last <= 7), "Browser - Recent")
        .when((o == 0) & (last <= 30), "Browser - Inactive")
        .when(o == 0, "Browser - Lost")
        .otherwise("Unknown")
    )


def scored_profiles(profiles: DataFrame) -> DataFrame:
    """All scores, tiers, stage and stage value on the profile row itself: no joins."""
    variety = sum(
        ((F.col(c) > 0).cast("int") for c in ("add_count", "search_count", "merchant_view_count")),
        (F.col("product_view_count") > 0).cast("int"),
    )
    per_day = ratio(F.col("sessions"), F.greatest(F.col("active_days"), F.lit(1)))
    first, second = F.col("first_hits"), F.col("second_hits")
    trajectory = (
        F.when(F.col("total_events") < 4, 50.0)
        .when((first == 0) & (second > 0), 70.0)
        .when(first == 0, 50.0)
        .otherwise(clip(50 + (ratio(second, first) - 1) * 30, 0, 100))
    )
    values = F.create_map(*[F.lit(x) for pair in STAGE_VALUES for x in pair])
    return (
        profiles.withColumn("recency_score", clip(100 - F.col("days_since_last") * 100 / F.lit(30.0), 0, 100))
        .withColumn("frequency_score", clip(per_day * 50, 0, 100))
        .withColumn("depth_score", F.col("max_funnel_stage") / F.lit(6.0) * 100)
        .withColumn("breadth_score", variety / F.lit(4.0) * 100)
        .withColumn(
            "engagement_score",
            round_half_even(
                F.col("recency_score") * 0.25
                + F.col("frequency_score") * 0.25
                + F.col("depth_score") * 0.25
                + F.col("breadth_score") * 0.25,
                1,
            ),
        )
        .withColumn("engagement_tier", bins(F.col("engagement_score"), TIER_EDGES, ENGAGEMENT_TIERS))
        .withColumn("purchase_score", clip(F.col("order_count") * 15 + (40 - F.col("days_since_last")), 0, 100))
        .withColumn("lifecycle_score", clip(F.log1p(F.col("days_since_first")) * 20, 0, 100))
        .withColumn("trajectory_score", trajectory)
        .withColumn(
            "health_score",
            round_half_even(
                F.col("engagement_score") * 0.30
                + F.col("purchase_score") * 0.30
                + F.col("lifecycle_score") * 0.20
                + F.col("trajectory_score") * 0.20,
                1,
            ),
        )
        .withColumn("health_tier", bins(F.col("health_score"), TIER_EDGES, HEALTH_TIERS))
        .withColumn("lifecycle_stage", _stage())
        .withColumn("lifecycle_value", F.element_at(values, F.col("lifecycle_stage")))
    )


def engagement_scores(scored: DataFrame) -> DataFrame:
    return scored.select(
        "user_id", "engagement_score", "engagement_tier", "recency_score", "frequency_score", "depth_score", "breadth_score"
    )


def health_scores(scored: DataFrame) -> DataFrame:
    return scored.select(
        "user_id",
        "health_score",
        "health_tier",
        "engagement_score",
        "purchase_score",
        "lifecycle_score",
        "trajectory_score",
        "order_count",
        "days_since_last",
    )


def lifecycle_stages(scored: DataFrame) -> DataFrame:
    return scored.select("user_id", "lifecycle_stage", "lifecycle_value", "order_count", "days_since_first", "days_since_last")


def _with_actions(scored: DataFrame) -> DataFrame:
    names = ["action", "channel", "message", "priority", "expected_impact"]
    rules = literal_rows(scored.sparkSession, ["lifecycle_stage", *names], ACTIONS)
    joined = scored.join(F.broadcast(rules), "lifecycle_stage", "left")  # one row per stage
    for name, default in zip(names, DEFAULT_ACTION):
        joined = joined.withColumn(name, F.coalesce(name, F.lit(default)))
    return joined


def next_best_action(scored: DataFrame) -> DataFrame:
    return _with_actions(scored).select(
        "user_id", "lifecycle_stage", "health_tier", "health_score", "action", "channel", "message", "priority", "expected_impact"
    )


def segment_summary(scored: DataFrame) -> DataFrame:
    g = scored.groupBy("lifecycle_stage").agg(
        F.count(F.lit(1)).alias("users"),
        F.first("lifecycle_value").alias("stage_value"),
        F.avg("health_score").alias("avg_health_score"),
        F.avg("order_count").alias("avg_orders"),
        F.avg("days_since_last").alias("avg_days_inactive"),
    )
    return g.withColumn("pct_of_users", percent(F.col("users"), F.sum("users").over(Window.partitionBy()), 1))


def high_value_at_risk(scored: DataFrame, n: int | None = None) -> DataFrame:
    return (
        first_rows(scored.where((F.col("order_count") >= 2) & F.col("health_tier").isin("At Risk", "Critical")), n, F.desc("order_count"), "user_id")
        .select("user_id", "lifecycle_stage", "health_score", "health_tier", "order_count", "days_since_last")
    )


def conversion_opportunities(scored: DataFrame, n: int | None = None) -> DataFrame:
    return (
        first_rows(scored.where((F.col("order_count") == 0) & F.col("engagement_tier").isin("Medium", "High")), n, F.desc("engagement_score"), "user_id")
        .select("user_id", "lifecycle_stage", "engagement_score", "engagement_tier", "depth_score", "recency_score")
    )


def scoring_summary(scored: DataFrame) -> DataFrame:
    tier, stage = F.col("health_tier"), F.col("lifecycle_stage")
    return scored.agg(
        F.count(F.lit(1)).alias("total_customers"),
        count_if(F.col("order_count") > 0).alias("with_orders"),
        round_half_even(F.avg("health_score"), 1).alias("avg_health_score"),
        count_if(tier == "Champion").alias("champions"),
        count_if(tier.isin("At Risk", "Critical")).alias("at_risk"),
        count_if(stage == "Repeat - Active").alias("active_repeaters"),
        count_if(stage == "Repeat - Lapsed").alias("lapsed_repeaters"),
    )


def crm_export(scored: DataFrame) -> DataFrame:
    return _with_actions(scored).select(
        "user_id",
        "health_score",
        "health_tier",
        "engagement_score",
        "purchase_score",
        "lifecycle_score",
        "trajectory_score",
        "order_count",
        "days_since_last",
        "lifecycle_stage",
        "lifecycle_value",
        "action",
        "channel",
        "priority",
        "platform",
        "first_seen",
        "last_seen",
    )


def tier_counts(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("health_tier").isNotNull()).groupBy("health_tier").agg(F.count(F.lit(1)).alias("users"))


def action_counts(scored: DataFrame) -> DataFrame:
    return _with_actions(scored).groupBy("action", "priority").agg(F.count(F.lit(1)).alias("users"))

"""Funnels over an ordered list of event types.  All steps are answered by one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.columns import (
    label_rows,
    literal_rows,
    micros,
    minutes,
    percent,
    round_half_even,
)
from tidelens.functions.distributed import quantiles, top_per_group
from tidelens.schema import FUNNEL_7

# Advice shown per step of the default funnel.
LEAK_ADVICE = (
    ("homepage_viewed", "Improve homepage engagement, clearer CTAs"),
    ("product_page_viewed", "Better product discovery, personalization"),
    ("product_added", "Reduce friction in add-to-cart, show benefits"),
    ("cart_page_viewed", "Address cart abandonment (pricing, fees)"),
    ("checkout_button_pressed", "Simplify checkout flow"),
    ("payment_initiated", "Multiple payment options, trust signals"),
)


def _step_counts(events: DataFrame, steps: Sequence[str]) -> DataFrame:
    counts = (
        events.where(F.col("event_type").isin(list(steps)))
        .groupBy("event_type")
        .agg(F.countDistinct("user_id").alias("users"), F.count(F.lit(1)).alias("events"))
    )
    return (
        label_rows(events.sparkSession, steps, "step")
        .withColumnRenamed("position", "step_number")
        .join(counts, F.col("step") == F.col("event_type"), "left")
        .select(
            "step_number",
            "step",
            F.coalesce("users", F.lit(0)).alias("users"),
            F.coalesce("events", F.lit(0)).alias("events"),
        )
    )


def funnel(events: DataFrame, steps: Sequence[str] = FUNNEL_7) -> DataFrame:
    """Unordered funnel: users and events per step, shares, step conversion, drop-off."""
    by_step = Window.partitionBy().orderBy("step_number")  # as many rows as the funnel has steps
    prev = F.col("prev_users")
    conversion = F.when(prev.isNull() | (prev == 0), 100.0).otherwise(percent(F.col("users"), prev, 2))
    return (
        _step_counts(events, steps)
        .withColumn("prev_users", F.lag("users").over(by_step))
        .withColumn("first_users", F.first("users").over(by_step))
        .withColumn("step_conversion", conversion)
        .select(
            "step_number",
            "step",
            "users",
            "events",
            percent(F.col("users"), F.col("first_users"), 2).alias("pct_of_total"),
            "step_conversion",
            F.coalesce(prev - F.col("users"), F.lit(0)).alias("drop_off"),
            F.when(prev.isNull(), 0.0).otherwise(round_half_even(100 - F.col("step_conversion"), 2)).alias("drop_off_rate"),
        )
    )


def funnel_by_segment(events: DataFrame, segment: str, steps: Sequence[str] = FUNNEL_7) -> DataFrame:
    """The funnel per value of a column; every value gets every step."""
    seg = F.col(segment)
    named = events.where(seg.isNotNull()).select(seg.alias("segment"), "event_type", "user_id")
    counts = named.groupBy("segment", "event_type").agg(F.countDistinct("user_id").alias("users"))
    steps_array = F.array(*[F.struct(F.lit(i + 1).alias("step_number"), F.lit(s).alias("step")) for i, s in enumerate(steps)])
    grid = counts.select("segment").distinct().select("segment", F.explode(steps_array).alias("s")).select("segment", "s.*")
    joined = grid.join(counts.withColumnRenamed("event_type", "step"), ["segment", "step"], "left").withColumn(
        "users", F.coalesce("users", F.lit(0))
    )
    first = F.first("users").over(Window.partitionBy("segment").orderBy("step_number"))
    return joined.select("segment", "step_number", "step", "users", percent(F.col("users"), first, 2).alias("pct_of_total"))


def drop_off_analysis(events: DataFrame, steps: Sequence[str] = FUNNEL_7) -> DataFrame:
    """Per adjacent step pair: who continued, who dropped, and the dropped users' commonest first other event."""
    at = F.struct("event_time", "event_id")
    t = F.col("event_type")
    did = [F.max(t == s).alias(f"_did{i}") for i, s in enumerate(steps)]
    other = [F.min_by(t, F.when(t != s, at)).alias(f"_alt{i}") for i, s in enumerate(steps[:-1])]
    users = events.groupBy("user_id").agg(*did, *other)
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.col(f"_did{i}").alias("at"),
                F.col(f"_did{i + 1}").alias("next"),
                F.col(f"_alt{i}").alias("alt"),
            )
            for i in range(len(steps) - 1)
        ]
    )
    per_user = users.select(F.explode(pairs).alias("p")).select("p.*").where("at")
    # user rows are reduced to (pair, continued, alternative) counts before anything else
    counts = per_user.groupBy("i", "next", "alt").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("i").agg(
        F.sum("n").alias("users_at_step"), F.sum(F.when(F.col("next"), F.col("n")).otherwise(0)).alias("continued")
    )
    ranked = top_per_group(
        counts.where(~F.col("next") & F.col("alt").isNotNull()), ["i"], [F.desc("n"), F.asc("alt")], 2
    )
    tops = ranked.groupBy("i").agg(
        F.max(F.when(F.col("rank") == 1, F.col("alt"))).alias("top_alternative_1"),
        F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("alt_1_count"),
        F.max(F.when(F.col("rank") == 2, F.col("alt"))).alias("top_alternative_2"),
        F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("alt_2_count"),
    )
    grid = literal_rows(
        events.sparkSession, ["i", "from_step", "to_step"], [(i, a, b) for i, (a, b) in enumerate(zip(steps, steps[1:]))]
    )
    zero = F.lit(0)
    return (
        grid.join(totals, "i", "left")
        .join(tops, "i", "left")
        .withColumn("users_at_step", F.coalesce("users_at_step", zero))
        .withColumn("continued", F.coalesce("continued", zero))
        .withColumn("dropped", F.col("users_at_step") - F.col("continued"))
        .select(
            "from_step",
            "to_step",
            "users_at_step",
            "continued",
            "dropped",
            F.coalesce(percent(F.col("dropped"), F.col("users_at_step"), 1), F.lit(0.0)).alias("drop_rate"),
            "top_alternative_1",
            F.coalesce("alt_1_count", zero).alias("alt_1_count"),
            "top_alternative_2",
            F.coalesce("alt_2_count", zero).alias("alt_2_count"),
        )
    )


def time_between_steps(events: DataFrame, steps: Sequence[str] = FUNNEL_7) -> DataFrame:
    """Minutes from a user's first event of a step to the first of the next, kept in (0, 1440)."""
    t = F.col("event_type")
    firsts = events.where(t.isin(list(steps))).groupBy("user_id").agg(
        *[F.min(F.when(t == s, micros(F.col("event_time")))).alias(f"_t{i}") for i, s in enumerate(steps)]
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("from_step"), F.lit(b).alias("to_step"), minutes(F.col(f"_t{i + 1}") - F.col(f"_t{i}")).alias("m")
            )
            for i, (a, b) in enumerate(zip(steps, steps[1:]))
        ]
    )
    spans = firsts.select(F.explode(pairs).alias("p")).select("p.*").where((F.col("m") > 0) & (F.col("m") < 1440))
    keys = ["from_step", "to_step"]
    means = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("users"), F.avg("m").alias("avg_minutes"))
    q = quantiles(spans, "m", {"median_minutes": 0.5, "p75_minutes": 0.75}, keys)
    return means.join(q, keys).select(
        *keys, "users", *[round_half_even(F.col(c), 2).alias(c) for c in ("avg_minutes", "median_minutes", "p75_minutes")]
    )


def biggest_leaks(events: DataFrame, steps: Sequence[str] = FUNNEL_7, advice: Sequence[tuple[str, str]] = LEAK_ADVICE) -> DataFrame:
    f = funnel(events, steps).where(F.col("drop_off") > 0)
    tips = F.create_map(*[F.lit(x) for pair in advice for x in pair])
    return f.select(
        F.col("step").alias("after_step"),
        F.col("drop_off").alias("users_lost"),
        F.col("drop_off_rate").alias("drop_rate_pct"),
        (F.col("drop_off") * F.col("drop_off_rate") / 100).alias("impact_score"),
        F.try_element_at(tips, F.col("step")).alias("recommendation"),
    ).orderBy(F.desc("impact_score"), "after_step")

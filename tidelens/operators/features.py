"""Per-user features and RFM.

All feature blocks come from one two-level aggregate: (user, day) first, then user.  The first level
shrinks a very active user to one row per day before its rows meet in one place, and gives the
count of active days for free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelens.functions.columns import count_if, days, micros, percent, ratio, round_half_even
from tidelens.functions.distributed import ordinal_bin, ordinal_cuts, quantiles, scalar_row
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary
from tidelens.sources.normalise import order_properties, with_order_total


def reference_time(events: DataFrame) -> Column:
    """Latest event time in microseconds as a lazy scalar sub-query."""
    return events.agg(F.max(micros(F.col("event_time"))).alias("m")).scalar()


def _is(event_type: str) -> Column:
    return F.col("event_type") == event_type


def user_event_counts(events: DataFrame, event_types: tuple[str, ...] = DEFAULT_VOCABULARY.event_types) -> DataFrame:
    """Total events and one ``count_<type>`` column per known type (no distinct pass to find the types)."""
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_events"), *[count_if(_is(t)).alias(f"count_{t}") for t in event_types]
    )


def user_recency(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Fractional days since first event, last event and last order (NULL without orders)."""
    us = micros(F.col("event_time"))
    ref = reference_time(events)
    g = events.groupBy("user_id").agg(
        F.min(us).alias("a"), F.max(us).alias("b"), F.max(F.when(_is(vocab.order), us)).alias("c")
    )
    return g.select(
        "user_id",
        days(ref - F.col("a")).alias("days_since_first_event"),
        days(ref - F.col("b")).alias("days_since_last_event"),
        days(ref - F.col("c")).alias("days_since_last_order"),
    )


def user_order_features(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    o = with_order_total(order_properties(events.where(_is(vocab.order))))
    g = o.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("order_total").alias("total_revenue"),
        F.avg("order_total").alias("avg_order_value"),
        F.max("order_total").alias("max_order_value"),
        F.sum("products_quantity").alias("total_products"),
        F.avg("products_quantity").alias("avg_products_per_order"),
        count_if(F.col("uses_promo")).alias("promo_orders"),
        count_if(F.col("is_group_order")).alias("group_orders"),
        count_if(F.col("is_multi_cart")).alias("multi_cart_orders"),
        F.countDistinct("merchant_id").alias("unique_merchants"),
    )
    return g.withColumn("pct_promo_orders", ratio(F.col("promo_orders"), F.col("total_orders"))).withColumn(
        "pct_group_orders", ratio(F.col("group_orders"), F.col("total_orders"))
    )


def user_behaviour(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    roles = {
        "total_searches": vocab.search,
        "total_product_views": vocab.product_view,
        "total_products_added": vocab.add,
        "total_cart_views": vocab.cart,
        "total_sessions": vocab.homepage,
    }
    daily = events.groupBy("user_id", F.to_date("event_time").alias("day")).agg(
        *[count_if(_is(t)).alias(n) for n, t in roles.items()]
    )
    return daily.groupBy("user_id").agg(*[F.sum(n).alias(n) for n in roles], F.count("day").alias("days_active"))


def user_platform(events: DataFrame) -> DataFrame:
    """Most used platform (alphabetically first on ties) and the share of iOS events."""
    named = events.where(F.col("platform").isNotNull())
    per = named.groupBy("user_id", "platform").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("user_id").agg(
        F.min_by("platform", F.struct(-F.col("n"), F.col("platform"))).alias("primary_platform"),
        ratio(F.sum(F.when(F.col("platform") == "ios", F.col("n")).otherwise(0)), F.sum("n")).alias("pct_ios"),
    )


def user_funnel(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Deepest and mean funnel stage, and orders per homepage view (0 without homepage views)."""
    stage = _stage_index(vocab.full_funnel)
    g = events.where(F.col("event_type").isin(list(vocab.full_funnel))).groupBy("user_id").agg(
        F.max(stage).alias("max_funnel_stage"),
        F.avg(stage).alias("avg_funnel_stage"),
        count_if(_is(vocab.order)).alias("o"),
        count_if(_is(vocab.homepage)).alias("h"),
    )
    return g.select(
        "user_id",
        "max_funnel_stage",
        "avg_funnel_stage",
        F.coalesce(ratio(F.col("o"), F.col("h")), F.lit(0.0)).alias("user_conversion_rate"),
    )


def _stage_index(stages: tuple[str, ...]) -> Column:
    pairs = [x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))]
    return F.try_element_at(F.create_map(*pairs), F.col("event_type"))


def build_user_features(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """All feature blocks in one pass, one row per user, numeric NULLs as 0."""
    us = micros(F.col("event_time"))
    ref = reference_time(events)
    src = with_order_total(order_properties(events))
    order, stage = _is(vocab.order), _stage_index(vocab.full_funnel)
    roles = {
        "total_searches": vocab.search,
        "total_product_views": vocab.product_view,
        "total_products_added": vocab.add,
        "total_cart_views": vocab.cart,
        "total_sessions": vocab.homepage,
    }
    plat = F.col("platform")
    daily = src.groupBy("user_id", F.to_date("event_time").alias("day")).agg(
        F.count(F.lit(1)).alias("total_events"),
        *[count_if(_is(t)).alias(f"count_{t}") for t in vocab.event_types],
        F.min(us).alias("a"),
        F.max(us).alias("b"),
        F.max(F.when(order, us)).alias("c"),
        count_if(order).alias("total_orders"),
        F.sum(F.when(order, F.col("order_total"))).alias("rev"),
        F.max(F.when(order, F.col("order_total"))).alias("mx"),
        F.sum(F.when(order, F.col("products_quantity"))).alias("qty"),
        count_if(order & F.col("uses_promo")).alias("promo_orders"),
        count_if(order & F.col("is_group_order")).alias("group_orders"),
        count_if(order & F.col("is_multi_cart")).alias("multi_cart_orders"),
        *[count_if(_is(t)).alias(n) for n, t in roles.items()],
        *[count_if(plat == p).alias(f"_p_{p}") for p in vocab.platforms],
        F.max(stage).alias("smax"),
        F.sum(stage).alias("ssum"),
        F.count(stage).alias("scnt"),
    )
    summed = [
        "total_events",
        *[f"count_{t}" for t in vocab.event_types],
        "total_orders",
        "promo_orders",
        "group_orders",
        "multi_cart_orders",
        *roles,
        *[f"_p_{p}" for p in vocab.platforms],
    ]
    g = daily.groupBy("user_id").agg(
        *[F.sum(c).alias(c) for c in summed],
        F.count("day").alias("days_active"),
        F.min("a").alias("a"),
        F.max("b").alias("b"),
        F.max("c").alias("c"),
        F.sum("rev").alias("rev"),
        F.max("mx").alias("mx"),
        F.sum("qty").alias("qty"),
        F.max("smax").alias("smax"),
        F.sum("ssum").alias("ssum"),
        F.sum("scnt").alias("scnt"),
    )
    merchants = (
        src.where(order & F.col("merchant_id").isNotNull()).groupBy("user_id").agg(F.countDistinct("merchant_id").alias("unique_merchants"))
    )
    zero, platforms = F.lit(0.0), sorted(vocab.platforms)
    best = F.greatest(*[F.col(f"_p_{p}") for p in platforms])
    primary = F.lit(None).cast("string")
    for p in reversed(platforms):
        primary = F.when(F.col(f"_p_{p}") == best, p).otherwise(primary)
    named = sum((F.col(f"_p_{p}") for p in platforms[1:]), F.col(f"_p_{platforms[0]}"))
    out = g.join(merchants, "user_id", "left")
    return out.select(
        "user_id",
        "total_events",
        *[f"count_{t}" for t in vocab.event_types],
        days(ref - F.col("a")).alias("days_since_first_event"),
        days(ref - F.col("b")).alias("days_since_last_event"),
        F.coalesce(days(ref - F.col("c")), zero).alias("days_since_last_order"),
        "total_orders",
        F.coalesce("rev", zero).alias("total_revenue"),
        F.coalesce(ratio(F.col("rev"), F.col("total_orders")), zero).alias("avg_order_value"),
        F.coalesce("mx", zero).alias("max_order_value"),
        F.coalesce("qty", zero).alias("total_products"),
        F.coalesce(ratio(F.col("qty"), F.col("total_orders")), zero).alias("avg_products_per_order"),
        "promo_orders",
        "group_orders",
        "multi_cart_orders",
        F.coalesce("unique_merchants", F.lit(0)).alias("unique_merchants"),
        F.coalesce(ratio(F.col("promo_orders"), F.col("total_orders")), zero).alias("pct_promo_orders"),
        F.coalesce(ratio(F.col("group_orders"), F.col("total_orders")), zero).alias("pct_group_orders"),
        *roles,
        "days_active",
        primary.alias("primary_platform"),
        F.coalesce(ratio(F.col("_p_ios") if "ios" in platforms else F.lit(0), named), zero).alias("pct_ios"),
        F.coalesce("smax", F.lit(0)).alias("max_funnel_stage"),
        F.coalesce(ratio(F.col("ssum"), F.col("scnt")), zero).alias("avg_funnel_stage"),
        F.coalesce(ratio(F.col("total_orders"), F.col("total_sessions")), zero).alias("user_conversion_rate"),
    )


def rfm(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, n: int = 5) -> DataFrame:
    """Recency, frequency, monetary values, their quantile scores 1..n and the rule segment."""
    us = micros(F.col("event_time"))
    base = (
        with_order_total(events.where(_is(vocab.order)))
        .groupBy("user_id")
        # Rounded, so that every evaluation of the sum gives the same number and cuts compare exactly.
        .agg(F.max(us).alias("last"), F.count(F.lit(1)).alias("frequency"), F.round(F.sum("order_total"), 6).alias("monetary"))
        .select("user_id", days(reference_time(events) - F.col("last")).alias("recency"), "frequency", "monetary")
    )
    cuts = [f"q{i}" for i in range(1, n)]
    edges = quantiles(base, "recency", {c: (i + 1) / n for i, c in enumerate(cuts)})
    # Position of the value among the inner edges; equal edges give the highest matching label.
    r = F.lit(n)
    for c in cuts:
        r = r - F.when(F.col("recency") > F.col("_edges")[c], 1).otherwise(0)
    scored = (
        base.withColumn("_edges", scalar_row(edges))
        .withColumn("_f", scalar_row(ordinal_cuts(base, "frequency", "user_id", n)))
        .withColumn("_m", scalar_row(ordinal_cuts(base, "monetary", "user_id", n)))
        .withColumn("R_score", r.cast("int"))
        .withColumn("F_score", ordinal_bin(F.col("_f"), "frequency", "user_id", n))
        .withColumn("M_score", ordinal_bin(F.col("_m"), "monetary", "user_id", n))
    )
    R, Fq = F.col("R_score"), F.col("F_score")
    segment = (
        F.when((R >= 4) & (Fq >= 4), "Champions")
        .when((R >= 3) & (Fq >= 3), "Loyal")
        .when(R >= 4, "Recent")
        .when(Fq >= 4, "Frequent")
        .when((R <= 2) & (Fq <= 2), "At Risk")
        .otherwise("Regular")
    )
    return scored.select(
        "user_id",
        "recency",
        "frequency",
        "monetary",
        "R_score",
        "F_score",
        "M_score",
        (R * 100 + Fq * 10 + F.col("M_score")).alias("RFM_score"),
        segment.alias("RFM_segment"),
    )


def rfm_profile(scored: DataFrame) -> DataFrame:
    """Users, share and mean R/F/M per segment."""
    g = scored.groupBy(F.col("RFM_segment").alias("segment")).agg(
        F.count(F.lit(1)).alias("users"),
        round_half_even(F.avg("recency"), 2).alias("avg_recency"),
        round_half_even(F.avg("frequency"), 2).alias("avg_frequency"),
        round_half_even(F.avg("monetary"), 2).alias("avg_monetary"),
    )
    return g.withColumn("pct_of_users", percent(F.col("users"), F.sum("users").over(Window.partitionBy())))


def feature_summary(features: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of every numeric feature, one row per feature."""
    numeric = [f.name for f in features.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != "user_id"]
    parts = features.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(F.col(c).cast("double")).alias("min"),
                F.max(F.col(c).cast("double")).alias("max"),
            ).alias(f"s_{c}")
            for c in numeric
        ]
    )
    stats = parts.select(F.explode(F.array(*[F.col(f"s_{c}") for c in numeric])).alias("s")).select("s.*")
    long = features.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in numeric])
        ).alias("x")
    ).select("x.*")
    q = quantiles(long, "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["feature"])
    return stats.join(q, "feature").select("feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def churn_rule(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, window_days: float = 30) -> DataFrame:
    """Rule-based churn risk from days since the last order; users without orders keep their own label."""
    d = F.col("days_since_last_order")
    risk = (
        F.when(d.isNull(), "No Orders")
        .when(d > window_days, "High")
        .when(d > window_days / 2, "Medium")
        .otherwise("Low")
    )
    return user_recency(events, vocab).select("user_id", "days_since_last_order", risk.alias("churn_risk"))

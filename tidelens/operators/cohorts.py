"""Cohort assignment, retention, cumulative value, time to n-th order, frequency and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.columns import days, micros, ratio, whole_days
from tidelens.functions.distributed import quantiles, scalar_row, top_per_group
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary
from tidelens.sources.normalise import with_order_total, with_order_type


def _week(events: DataFrame, event_type: str) -> DataFrame:
    g = events.where(F.col("event_type") == event_type).groupBy("user_id").agg(F.min("event_time").alias("first_order_time"))
    monday = F.date_trunc("week", "first_order_time")
    label = F.concat_ws("/", F.date_format(monday, "yyyy-MM-dd"), F.date_format(F.date_add(F.to_date(monday), 6), "yyyy-MM-dd"))
    return g.select("user_id", "first_order_time", label.alias("cohort"), monday.alias("cohort_date"))


def first_order_week(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    return _week(events, vocab.order)


def first_visit_week(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    return _week(events, vocab.homepage)


def first_order_month(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    g = events.where(F.col("event_type") == vocab.order).groupBy("user_id").agg(F.min("event_time").alias("first_order_time"))
    month = F.date_trunc("month", "first_order_time")
    return g.select("user_id", "first_order_time", F.date_format(month, "yyyy-MM").alias("cohort"), month.alias("cohort_date"))


def first_platform(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    at = F.when(F.col("platform").isNotNull(), F.struct("event_time", "event_id"))
    g = events.groupBy("user_id").agg(F.min_by("platform", at).alias("p"), F.min("event_time").alias("first_order_time"))
    return g.select("user_id", "first_order_time", F.upper("p").alias("cohort"), F.col("first_order_time").alias("cohort_date"))


def _first_order(events: DataFrame, vocab: Vocabulary, column: str) -> DataFrame:
    at = F.struct("event_time", "event_id")
    return events.where(F.col("event_type") == vocab.order).groupBy("user_id").agg(
        F.min_by(column, F.when(F.col(column).isNotNull(), at)).alias("v"), F.min("event_time").alias("first_order_time")
    )


def first_aov_tier(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    v = F.col("v")
    tier = (
        F.when(v.isNull() | (v <= 0), "Unknown").when(v < 50, "Low (<50)").when(v < 100, "Medium (50-100)").otherwise("High (>100)")
    )
    g = _first_order(with_order_total(events), vocab, "order_total")
    return g.select("user_id", "first_order_time", tier.alias("cohort"), F.col("first_order_time").alias("cohort_date"))


def first_order_type(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    g = _first_order(with_order_type(events), vocab, "order_type")
    label = F.initcap(F.coalesce("v", F.lit("unknown")))
    return g.select("user_id", "first_order_time", label.alias("cohort"), F.col("first_order_time").alias("cohort_date"))


BUILDERS = {
    "first_order_week": first_order_week,
    "first_order_month": first_order_month,
    "first_visit_week": first_visit_week,
    "platform": first_platform,
    "first_aov_tier": first_aov_tier,
    "first_order_type": first_order_type,
}


def build_cohorts(events: DataFrame, cohort_type: str = "first_order_week", vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """User-level cohorts: ``user_id, first_order_time, cohort, cohort_date``."""
    if cohort_type not in BUILDERS:
        raise ValueError(f"unknown cohort type: {cohort_type}")
    return BUILDERS[cohort_type](events, vocab)


def _period(length_days: int) -> Column:
    elapsed = whole_days(micros(F.col("event_time")) - micros(F.col("cohort_date")))
    return F.greatest(F.floor(elapsed / length_days), F.lit(0)).cast("int")


def _cohort_orders(events: DataFrame, cohorts: DataFrame, vocab: Vocabulary, *cols) -> DataFrame:
    orders = events.where(F.col("event_type") == vocab.order).select("user_id", "event_time", *cols)
    return orders.join(cohorts.select("user_id", "cohort", "cohort_date"), "user_id")


def _grid(cohorts: DataFrame, name: str, periods: int) -> DataFrame:
    sizes = cohorts.where(F.col("cohort").isNotNull()).groupBy("cohort").agg(F.countDistinct("user_id").alias("cohort_size"))
    return sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(periods))).alias(name))


def retention_long(
    events: DataFrame,
    cohorts: DataFrame,
    period: str = "week",
    max_periods: int = 12,
    vocab: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Active users and retention per cohort and period (a month is 30 days), zero-filled."""
    o = _cohort_orders(events, cohorts, vocab).withColumn("period", _period(7 if period == "week" else 30))
    active = o.where(F.col("period") <= max_periods).groupBy("cohort", "period").agg(F.countDistinct("user_id").alias("active_users"))
    return (
        _grid(cohorts, "period", max_periods)
        .join(active, ["cohort", "period"], "left")
        .withColumn("active_users", F.coalesce("active_users", F.lit(0)))
        .withColumn("retention_rate", ratio(F.col("active_users"), F.col("cohort_size")) * 100)
    )


def retention(
    events: DataFrame,
    cohorts: DataFrame,
    period: str = "week",
    max_periods: int = 12,
    vocab: Vocabulary = DEFAULT_VOCABULARY,
) -> DataFrame:
    """Retention heat map: one row per cohort, one column ``p<k>`` per period."""
    long = retention_long(events, cohorts, period, max_periods, vocab)
    return long.groupBy("cohort").agg(
        *[F.max(F.when(F.col("period") == k, F.col("retention_rate"))).alias(f"p{k}") for k in range(max_periods + 1)]
    )


def cumulative_ltv(
    events: DataFrame, cohorts: DataFrame, max_periods: int = 12, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> DataFrame:
    o = _cohort_orders(with_order_total(events), cohorts, vocab, "order_total").withColumn("week", _period(7))
    rev = o.where(F.col("week") <= max_periods).groupBy("cohort", "week").agg(F.sum("order_total").alias("rev"))
    w = Window.partitionBy("cohort").orderBy("week").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        _grid(cohorts, "week", max_periods)
        .join(rev, ["cohort", "week"], "left")
        .withColumn("cumulative_revenue", F.sum(F.coalesce("rev", F.lit(0.0))).over(w))
        .select("cohort", "week", "cumulative_revenue", ratio(F.col("cumulative_revenue"), F.col("cohort_size")).alias("cumulative_ltv"))
    )


def time_to_nth_order(events: DataFrame, n: int = 2, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Fractional days from the first to the n-th order of users who have n orders."""
    first_n = top_per_group(
        events.where(F.col("event_type") == vocab.order).select("user_id", "event_time", "event_id"),
        ["user_id"],
        [F.asc("event_time"), F.asc("event_id")],
        n,
        "rn",
    )
    g = first_n.groupBy("user_id").agg(
        F.min("event_time").alias("first_order_time"), F.max(F.when(F.col("rn") == n, F.col("event_time"))).alias("nth_order_time")
    )
    return g.where(F.col("nth_order_time").isNotNull()).withColumn(
        "days_to_nth_order", days(micros(F.col("nth_order_time")) - micros(F.col("first_order_time")))
    )


def nth_order_stats(times: DataFrame) -> DataFrame:
    base = times.agg(F.count(F.lit(1)).alias("users"), F.avg("days_to_nth_order").alias("mean_days"))
    q = quantiles(times, "days_to_nth_order", {"median_days": 0.5, "p75_days": 0.75})
    return base.withColumn("_q", scalar_row(q)).select("users", "mean_days", "_q.*")


def order_frequency(events: DataFrame, cohorts: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    o = _cohort_orders(events, cohorts, vocab).where(F.col("cohort").isNotNull()).withColumn("week", _period(7))
    g = o.groupBy("cohort", "week").agg(F.countDistinct("user_id").alias("active_users"), F.count(F.lit(1)).alias("orders"))
    return g.withColumn("orders_per_user", ratio(F.col("orders"), F.col("active_users")))


def cohort_summary(events: DataFrame, cohorts: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    # one row per user before the join: cohorts are unique per user
    per_user = with_order_total(events).where(F.col("event_type") == vocab.order).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("order_total").alias("rev")
    )
    g = per_user.join(cohorts.where(F.col("cohort").isNotNull()).select("user_id", "cohort"), "user_id").groupBy("cohort").agg(
        F.count(F.lit(1)).alias("users"), F.sum("n").alias("orders"), F.sum("rev").alias("total_revenue")
    )
    return g.select(
        "cohort",
        "users",
        "orders",
        "total_revenue",
        ratio(F.col("total_revenue"), F.col("orders")).alias("avg_order_value"),
        ratio(F.col("orders"), F.col("users")).alias("orders_per_user"),
        ratio(F.col("total_revenue"), F.col("users")).alias("ltv"),
    )

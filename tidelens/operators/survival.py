"""Survival analysis over order histories.

Times are whole days, so after one aggregate per user every further step works on a frame with at
most one row per day of history; the windows over those frames are small by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.columns import (
    INF,
    bins,
    count_if,
    label_rows,
    micros,
    ratio,
    whole_days,
)
from tidelens.functions.distributed import top_per_group
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary

# Order-count buckets of the risk report.
ORDER_EDGES = (0, 1, 2, 5, 10, INF)
ORDER_LABELS = ("1 order", "2 orders", "3-5 orders", "6-10 orders", "10+ orders")


def _end(events: DataFrame):
    return events.agg(F.max(micros(F.col("event_time"))).alias("m")).scalar()


def user_orders(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    us = micros(F.col("event_time"))
    g = events.where(F.col("event_type") == vocab.order).groupBy("user_id").agg(
        F.min(us).alias("a"), F.max(us).alias("b"), F.count(F.lit(1)).alias("total_orders")
    )
    return g.select(
        "user_id",
        F.timestamp_micros("a").alias("first_order"),
        F.timestamp_micros("b").alias("last_order"),
        "total_orders",
        whole_days(_end(events) - F.col("b")).alias("days_since_last"),
        whole_days(F.col("b") - F.col("a")).alias("lifetime_days"),
    )


def time_to_second_order(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Whole days from first to second order; users with one order are censored at the last event."""
    two = top_per_group(
        events.where(F.col("event_type") == vocab.order).select("user_id", "event_time", "event_id"),
        ["user_id"],
        [F.asc("event_time"), F.asc("event_id")],
        2,
        "rn",
    )
    g = two.groupBy("user_id").agg(
        F.min("event_time").alias("first_order_time"), F.max(F.when(F.col("rn") == 2, F.col("event_time"))).alias("second_order_time")
    )
    until = F.coalesce(micros(F.col("second_order_time")), _end(events))
    return g.select(
        "user_id",
        "first_order_time",
        "second_order_time",
        whole_days(until - micros(F.col("first_order_time"))).alias("time_to_second_order_days"),
        F.col("second_order_time").isNotNull().alias("has_second_order"),
    )


def churn_data(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, churn_days: int = 30) -> DataFrame:
    u = user_orders(events, vocab).withColumn("churned", F.col("days_since_last") >= churn_days)
    return u.withColumn(
        "survival_time",
        F.when(F.col("churned"), F.col("lifetime_days") + churn_days).otherwise(F.col("days_since_last")),
    )


def kaplan_meier(
    events: DataFrame, event: str = "churn", vocab: Vocabulary = DEFAULT_VOCABULARY, churn_days: int = 30
) -> DataFrame:
    """Kaplan-Meier curve: one row per distinct positive time."""
    if event == "churn":
        d = churn_data(events, vocab, churn_days).select(F.col("survival_time").alias("time"), F.col("churned").alias("hit"))
    else:
        d = time_to_second_order(events, vocab).select(
            F.col("time_to_second_order_days").alias("time"), F.col("has_second_order").alias("hit")
        )
    t = d.where(F.col("time") > 0).groupBy("time").agg(
        count_if(F.col("hit")).alias("events"), count_if(~F.col("hit")).alias("censored")
    )
    later = Window.partitionBy().orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = Window.partitionBy().orderBy("time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = F.col("survival_probability")
    return (
        t.withColumn("n_at_risk", F.sum(F.col("events") + F.col("censored")).over(later))
        .withColumn("survival_probability", F.product(1 - ratio(F.col("events"), F.col("n_at_risk"))).over(upto))
        .select(
            "time",
            "n_at_risk",
            "events",
            "censored",
            "survival_probability",
            F.when(s > 0, -F.ln(s)).otherwise(F.lit(INF)).alias("cumulative_hazard"),
        )
    )


def median_survival(curve: DataFrame) -> DataFrame:
    """Median time, survival-weighted mean time, and survival at 7, 30 and 90 days."""
    t, s = F.col("time"), F.col("survival_probability")
    return curve.agg(
        F.min(F.when(s <= 0.5, t)).alias("median"),
        ratio(F.sum(t * s), F.sum(s)).alias("mean_survival"),
        *[F.min_by(s, F.when(t >= d, t)).alias(f"survival_at_{d}_days") for d in (7, 30, 90)],
    )


def _first_orders(events: DataFrame, vocab: Vocabulary) -> DataFrame:
    return events.where(F.col("event_type") == vocab.order).groupBy("user_id").agg(F.min("event_time").alias("first_order_time"))


def _since_first(events: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Order days since the user's first order, one row per user and day."""
    o = events.where(F.col("event_type") == vocab.order).select("user_id", micros(F.col("event_time")).alias("us"))
    f = o.groupBy("user_id").agg(F.min("us").alias("f"))
    return o.join(f, "user_id").select("user_id", whole_days(F.col("us") - F.col("f")).alias("day")).distinct()


def hazard_by_period(events: DataFrame, period: str = "week", vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Per period since first order: users seen up to it, users seen in it or later, churn between.

    Every buyer has an order in period 0, so the users seen up to any period are all buyers; the
    users seen later follow from each user's last period.
    """
    length, label = {"week": (7, "Week"), "month": (30, "Month")}.get(period, (1, "Day"))
    p = _since_first(events, vocab).select("user_id", F.floor(F.col("day") / length).alias("period")).distinct()
    present = p.groupBy("period").agg(F.count(F.lit(1)).alias("_n"))
    last = p.groupBy("user_id").agg(F.max("period").alias("period")).groupBy("period").agg(F.count(F.lit(1)).alias("ends"))
    later = Window.partitionBy().orderBy(F.desc("period")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start, remain = F.col("users_at_start"), F.col("users_remaining")
    return (
        present.join(last, "period", "left")
        .withColumn("ends", F.coalesce("ends", F.lit(0)))
        .withColumn("users_remaining", F.sum("ends").over(later))
        .withColumn("users_at_start", F.sum("ends").over(Window.partitionBy()))
        .withColumn("churned", F.when(F.col("period") > 0, start - remain).otherwise(0))
        .withColumn("hazard_rate", F.coalesce(ratio(F.col("churned"), start), F.lit(0.0)))
        .select(
            "period",
            F.concat_ws(" ", F.lit(label), F.col("period").cast("string")).alias("period_label"),
            "users_at_start",
            "users_remaining",
            "churned",
            "hazard_rate",
            (1 - F.col("hazard_rate")).alias("retention_rate"),
        )
    )


def cohort_survival(
    events: DataFrame,
    cohort_period: str = "week",
    vocab: Vocabulary = DEFAULT_VOCABULARY,
    cohorts: int = 8,
    weeks: int = 12,
    with_year: bool = False,
) -> DataFrame:
    """Share of a cohort with an order in week w or later, for the first cohorts.

    Weekly cohorts are ISO week numbers; years are merged unless ``with_year`` is set.
    """
    us = micros(F.col("event_time"))
    span = events.where(F.col("event_type") == vocab.order).groupBy("user_id").agg(F.min(us).alias("f"), F.max(us).alias("l"))
    first = F.timestamp_micros("f")
    if cohort_period == "week":
        number = F.weekofyear(first)
        if with_year:
            number = F.year(F.date_add(F.to_date(F.date_trunc("week", first)), 3)) * 100 + number
        label = F.concat_ws(" ", F.lit("Week"), number.cast("string"))
    else:
        number, label = F.month(first), F.date_format(first, "MMM")
    last_week = F.floor(whole_days(F.col("l") - F.col("f")) / 7)
    u = span.select(number.alias("cohort"), label.alias("cohort_label"), F.least(last_week, F.lit(weeks)).alias("week"))
    counts = u.groupBy("cohort", "cohort_label", "week").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("cohort", "cohort_label").agg(F.sum("n").alias("initial_users")).orderBy("cohort").limit(cohorts)
    grid = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(weeks).cast("long"))).alias("week"))
    later = Window.partitionBy("cohort").orderBy(F.desc("week")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        grid.join(counts.drop("cohort_label"), ["cohort", "week"], "left")
        .withColumn("active_users", F.sum(F.coalesce("n", F.lit(0))).over(later))
        .select(
            "cohort",
            "cohort_label",
            F.col("week").cast("int").alias("week"),
            "initial_users",
            "active_users",
            ratio(F.col("active_users"), F.col("initial_users")).alias("survival_rate"),
        )
    )


def cohort_survival_matrix(long: DataFrame, weeks: int = 12) -> DataFrame:
    return long.groupBy("cohort_label").agg(
        *[F.max(F.when(F.col("week") == w, F.col("survival_rate"))).alias(f"w{w}") for w in range(weeks + 1)]
    )


def _user_platform(events: DataFrame) -> DataFrame:
    at = F.when(F.col("platform").isNotNull(), F.struct("event_time", "event_id"))
    return events.groupBy("user_id").agg(F.min_by("platform", at).alias("platform"), F.count(F.lit(1)).alias("total_events"))


def user_features(events: DataFrame) -> DataFrame:
    """First platform and event count per user."""
    return _user_platform(events)


def risk_factors(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, churn_days: int = 30) -> DataFrame:
    d = churn_data(events, vocab, churn_days).select("user_id", "total_orders", "churned")
    stats = [count_if(F.col("churned")).alias("churned"), F.count(F.lit(1)).alias("total")]
    by_platform = (
        d.join(_user_platform(events), "user_id", "left")
        .where(F.col("platform").isNotNull())
        .groupBy(F.col("platform").alias("segment_value"))
        .agg(*stats)
        .withColumn("segment", F.lit("platform"))
    )
    got = d.groupBy(bins(F.col("total_orders"), ORDER_EDGES, ORDER_LABELS).alias("segment_value")).agg(*stats)
    zero = F.lit(0)
    by_orders = (
        label_rows(events.sparkSession, ORDER_LABELS, "segment_value")
        .join(got, "segment_value", "left")
        .select(
            "segment_value",
            F.coalesce("churned", zero).alias("churned"),
            F.coalesce("total", zero).alias("total"),
            F.lit("order_frequency").alias("segment"),
        )
    )
    return by_platform.unionByName(by_orders).withColumn("churn_rate", ratio(F.col("churned"), F.col("total")))


def retention_curve(
    events: DataFrame, by: str = "day", vocab: Vocabulary = DEFAULT_VOCABULARY, last_day: int | None = 90
) -> DataFrame:
    """Share of buyers with an order on day d after their first or later, d up to ``last_day`` (None: to the last order)."""
    us = micros(F.col("event_time"))
    last = (
        events.where(F.col("event_type") == vocab.order)
        .groupBy("user_id")
        .agg(whole_days(F.max(us) - F.min(us)).alias("day"))
        .groupBy((F.col("day") if last_day is None else F.least(F.col("day"), F.lit(last_day))).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    days = last.agg(F.max("day").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("day"))
    later = Window.partitionBy().orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = (
        days.join(last, "day", "left")
        .withColumn("users_retained", F.sum(F.coalesce("n", F.lit(0))).over(later))
        .withColumn("all", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy()))
        .select(
            F.col("day").alias("days_since_first_order"),
            "users_retained",
            ratio(F.col("users_retained"), F.col("all")).alias("retention_rate"),
        )
    )
    return curve.where(F.col("days_since_first_order") % 7 == 0) if by == "week" else curve


def repeat_purchase_stats(times: DataFrame) -> DataFrame:
    """Repeat purchase rate and mean days to the second order of repeaters."""
    return times.agg(
        F.count(F.lit(1)).alias("buyers"),
        count_if(F.col("has_second_order")).alias("repeat_buyers"),
        (F.avg(F.col("has_second_order").cast("double")) * 100).alias("repeat_rate"),
        F.avg(F.when(F.col("has_second_order"), F.col("time_to_second_order_days"))).alias("avg_days"),
    )

"""Popular and trending merchants over the canonical orders frame.

Every list starts from (merchant, user) counts: distinct customers become plain counts, and a
merchant with a large share of all orders is pre-aggregated before its rows meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.columns import US_PER_HOUR, micros, percent, ratio, round_half_even, time_slot
from tidelens.functions.distributed import top_per_group
from tidelens.operators.merchants import SLOTS

SLOT_NAMES = tuple(s[0] for s in SLOTS)


def order_partials(orders: DataFrame) -> DataFrame:
    """Orders summed by merchant, user, platform and hour: every list of this module takes them in place of the orders.

    ``event_time`` is the hour, ``orders_in`` the number of orders, ``first_us`` and ``last_us`` their exact times.
    """
    us = micros(F.col("event_time"))
    return orders.groupBy("merchant", "category", "user_id", "platform", F.date_trunc("hour", "event_time").alias("event_time")).agg(
        F.count(F.lit(1)).alias("orders_in"), F.sum("order_total").alias("order_total"), F.min(us).alias("first_us"), F.max(us).alias("last_us")
    )


def _number(orders: DataFrame) -> Column:
    return F.sum("orders_in") if "orders_in" in orders.columns else F.count(F.lit(1))


def _first_and_last(orders: DataFrame) -> tuple[Column, Column]:
    if "orders_in" in orders.columns:
        return F.min("first_us"), F.max("last_us")
    us = micros(F.col("event_time"))
    return F.min(us), F.max(us)


def _counts(orders: DataFrame, *extra) -> DataFrame:
    """Orders and distinct customers per merchant (and per extra key)."""
    per_user = orders.groupBy("merchant", *extra, "user_id").agg(_number(orders).alias("n"), F.sum("order_total").alias("rev"))
    group = [c for c in per_user.columns if c not in ("user_id", "n", "rev")]
    return per_user.groupBy(*group).agg(
        F.sum("n").alias("order_count"), F.count(F.lit(1)).alias("unique_customers"), F.sum("rev").alias("total_revenue")
    )


def base_stats(orders: DataFrame) -> DataFrame:
    return _counts(orders).withColumn("orders_per_customer", ratio(F.col("order_count"), F.col("unique_customers")))


def _ranked(df: DataFrame, order, n: int, *columns: str) -> DataFrame:
    """First n rows with their rank; only n rows reach the ranking window."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order))).select("rank", *columns)


def popular_now(orders: DataFrame, n: int = 20, min_orders: int = 5) -> DataFrame:
    return _ranked(
        base_stats(orders).where(F.col("order_count") >= min_orders),
        [F.desc("order_count"), F.asc("merchant")],
        n,
        "merchant",
        "order_count",
        "unique_customers",
        "orders_per_customer",
    )


def popular_by_slot(orders: DataFrame, n: int = 10) -> DataFrame:
    """Top merchants of every time slot in one pass."""
    c = _counts(orders, time_slot(F.hour("event_time"), SLOTS, "other").alias("time_slot"))
    return top_per_group(c, ["time_slot"], [F.desc("order_count"), F.asc("merchant")], n).select(
        "time_slot", "rank", "merchant", "order_count", "unique_customers"
    )


def popular_by_time(orders: DataFrame, slot: str = "lunch", n: int = 10) -> DataFrame:
    if slot not in SLOT_NAMES:
        raise ValueError(f"unknown time slot: {slot}")
    o = orders.where(time_slot(F.hour("event_time"), SLOTS, "other") == slot)
    return _ranked(_counts(o), [F.desc("order_count"), F.asc("merchant")], n, "merchant", "order_count", "unique_customers").withColumn(
        "time_slot", F.lit(slot)
    )


def popular_per_platform(orders: DataFrame, n: int = 10) -> DataFrame:
    """Top merchants of every platform in one pass."""
    c = _counts(orders.where(F.col("platform").isNotNull()), F.lower("platform").alias("platform"))
    return top_per_group(c, ["platform"], [F.desc("order_count"), F.asc("merchant")], n).select(
        "platform", "rank", "merchant", "order_count", "unique_customers"
    )


def popular_by_platform(orders: DataFrame, platform: str = "ios", n: int = 10) -> DataFrame:
    o = orders.where(F.lower("platform") == platform.lower())
    return _ranked(_counts(o), [F.desc("order_count"), F.asc("merchant")], n, "merchant", "order_count", "unique_customers").withColumn(
        "platform", F.lit(platform)
    )


def trending_velocity(orders: DataFrame, n: int = 10, min_orders: int = 3) -> DataFrame:
    """Orders per hour of the whole observed span (a span of 0 counts as one hour)."""
    first, last = _first_and_last(orders)
    hours = orders.agg(((last - first) / F.lit(float(US_PER_HOUR))).alias("h")).scalar()
    c = orders.groupBy("merchant").agg(_number(orders).alias("order_count")).where(F.col("order_count") >= min_orders)
    c = c.withColumn("orders_per_hour", F.col("order_count") / F.when(hours == 0, 1.0).otherwise(hours))
    return _ranked(c, [F.desc("order_count"), F.asc("merchant")], n, "merchant", "order_count", "orders_per_hour")


def category_breakdown(orders: DataFrame) -> DataFrame:
    named = orders.where(F.col("category").isNotNull())
    users = (
        named.groupBy("category", "user_id")
        .agg(_number(named).alias("n"))
        .groupBy("category")
        .agg(F.sum("n").alias("order_count"), F.count(F.lit(1)).alias("unique_customers"))
    )
    merchants = named.groupBy("category").agg(F.countDistinct("merchant").alias("merchant_count"))
    total = F.sum("order_count").over(Window.partitionBy())  # one row per category
    return users.join(merchants, "category").withColumn("pct_of_orders", percent(F.col("order_count"), total, 1))


def new_customer_favorites(orders: DataFrame, n: int = 10) -> DataFrame:
    """Merchants ordered from by users with exactly one order."""
    # A user with one order has one merchant row of count 1, so the order's merchant is that row's.
    single = orders.groupBy("user_id").agg(_number(orders).alias("n"), F.min("merchant").alias("merchant")).where(F.col("n") == 1)
    fav = single.groupBy("merchant").agg(F.count(F.lit(1)).alias("new_customer_orders"))
    top = _ranked(fav, [F.desc("new_customer_orders"), F.asc("merchant")], n, "merchant", "new_customer_orders")
    totals = orders.groupBy("merchant").agg(_number(orders).alias("order_count"))
    return (
        top.join(totals, "merchant", "left")
        .withColumn("new_customer_pct", percent(F.col("new_customer_orders"), F.col("order_count"), 1))
        .select("rank", "merchant", "new_customer_orders", "order_count", "new_customer_pct")
    )


def repeat_customer_favorites(orders: DataFrame, n: int = 10, min_customers: int = 5) -> DataFrame:
    c = (
        orders.groupBy("merchant", "user_id")
        .agg(_number(orders).alias("n"))
        .groupBy("merchant")
        .agg(F.count(F.lit(1)).alias("total_customers"), F.sum((F.col("n") > 1).cast("long")).alias("repeat_customers"))
        .where(F.col("total_customers") >= min_customers)
        .withColumn("repeat_rate", round_half_even(ratio(F.col("repeat_customers"), F.col("total_customers")) * 100, 1))
    )
    return _ranked(
        c, [F.desc("repeat_rate"), F.asc("merchant")], n, "merchant", "total_customers", "repeat_customers", "repeat_rate"
    )


def weekend_vs_weekday(orders: DataFrame, n: int = 10, weekend_days: tuple[int, ...] = (4, 5)) -> DataFrame:
    """Top merchants of weekend and weekday orders (Monday is 0; the default weekend is Friday, Saturday)."""
    period = F.when(F.weekday("event_time").isin(list(weekend_days)), "weekend").otherwise("weekday")
    c = orders.groupBy(period.alias("period"), "merchant").agg(_number(orders).alias("order_count"))
    return top_per_group(c, ["period"], [F.desc("order_count"), F.asc("merchant")], n).select(
        "period", "rank", "merchant", "order_count"
    )


def for_context(
    orders: DataFrame, hour: int, platform: str | None = None, is_new_user: bool = False, n: int = 10
) -> DataFrame:
    """Slot favourites for the hour, boosted by new-customer orders and by platform popularity."""
    slot = next(
        (s for s, a, b in SLOTS if (a <= hour < b if a < b else hour >= a or hour < b)), SLOT_NAMES[-1]
    )
    in_slot = popular_by_time(orders, slot, 2 * n).select("merchant", "order_count")
    # The global list stands in only when the slot has no orders at all.
    empty = F.coalesce(in_slot.agg((F.count(F.lit(1)) == 0).alias("e")).scalar(), F.lit(True))
    recs = in_slot.unionByName(popular_now(orders, 2 * n).select("merchant", "order_count").where(empty))
    order = [F.desc("order_count"), F.asc("merchant")]
    if is_new_user:
        fav = new_customer_favorites(orders, n).select("merchant", "new_customer_orders")
        recs = recs.join(fav, "merchant", "left").withColumn(
            "score", F.col("order_count") + F.coalesce("new_customer_orders", F.lit(0)) * 0.5
        )
        order = [F.desc("score"), F.asc("merchant")]
    if platform:
        liked = popular_by_platform(orders, platform, 2 * n).select("merchant", F.lit(1).alias("_m"))
        recs = recs.join(liked, "merchant", "left").withColumn("platform_match", F.col("_m").isNotNull())
        order = [F.desc("platform_match"), F.desc("order_count"), F.asc("merchant")]
    label = " | ".join(x for x in (slot, platform, "new_user" if is_new_user else None) if x)
    return _ranked(recs, order, n, "merchant", "order_count").withColumn("context", F.lit(label))


def summary(orders: DataFrame) -> DataFrame:
    first, last = _first_and_last(orders)
    g = orders.agg(
        _number(orders).alias("total_orders"),
        F.countDistinct("user_id").alias("unique_customers"),
        F.timestamp_micros(first).alias("start"),
        F.timestamp_micros(last).alias("end"),
    )
    merchants = orders.agg(F.countDistinct("merchant").alias("n")).scalar()
    return g.withColumn("unique_merchants", merchants).select(
        "total_orders",
        "unique_merchants",
        "unique_customers",
        "start",
        "end",
        ratio(F.col("total_orders"), F.col("unique_customers")).alias("avg_orders_per_customer"),
        ratio(F.col("total_orders"), F.col("unique_merchants")).alias("avg_orders_per_merchant"),
    )


def platform_overlap(orders: DataFrame, a: str = "ios", b: str = "android", n: int = 10) -> DataFrame:
    """Merchants in the top lists of both platforms or of one only."""
    x = popular_by_platform(orders, a, n).select("merchant", F.lit(True).alias("x"))
    y = popular_by_platform(orders, b, n).select("merchant", F.lit(True).alias("y"))
    side = F.when(F.col("x") & F.col("y"), "both").when(F.col("x"), f"{a}_only").otherwise(f"{b}_only")
    return x.join(y, "merchant", "full").select("merchant", side.alias("listed_on"))

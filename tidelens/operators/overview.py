"""Summary queries of the dashboard pages: headline numbers, distributions, histograms, platform and hour tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.columns import count_if, percent, ratio
from tidelens.functions.distributed import scalar_row
from tidelens.functions.tables import stored
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary

#: Grouping ids of the exploration's sets over (user, type, platform): a bit is set where the column is summed over.
BY_TYPE, BY_USER, BY_PLATFORM = 0b001, 0b011, 0b110


def counts_by_user(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """``user_id, n, h, o``: events, homepage views and orders."""
    t = F.col("event_type")
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), count_if(t == vocab.homepage).alias("h"), count_if(t == vocab.order).alias("o")
    )


def headline(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Events, users, conversion (buyers over homepage users, %), orders, orders per buyer."""
    return headline_of(counts_by_user(events, vocab))


def headline_of(users: DataFrame) -> DataFrame:
    g = users.agg(
        F.sum("n").alias("total_events"),
        F.count(F.lit(1)).alias("unique_users"),
        count_if(F.col("h") > 0).alias("homepage_users"),
        count_if(F.col("o") > 0).alias("buyers"),
        F.sum("o").alias("total_orders"),
    )
    zero = F.lit(0.0)
    return g.select(
        "*",
        ratio(F.col("total_events"), F.col("unique_users")).alias("events_per_user"),
        F.coalesce(percent(F.col("buyers"), F.col("homepage_users")), zero).alias("conversion_rate"),
        F.coalesce(ratio(F.col("total_orders"), F.col("buyers")), zero).alias("orders_per_buyer"),
    )


def event_shares(events: DataFrame) -> DataFrame:
    """Events, share and distinct users per event type."""
    return event_shares_of(events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")))


def event_shares_of(user_types: DataFrame) -> DataFrame:
    g = user_types.groupBy("event_type").agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("users"))
    return g.withColumn("pct", percent(F.col("events"), F.sum("events").over(Window.partitionBy())))  # one row per type


def explored(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> dict[str, DataFrame]:
    """The exploration tables from one pass: (user, type, platform) counts, then grouping sets of these.

    ``headline``, ``event_shares``, ``order_bands`` and ``platforms`` read the sets they need from one stored table.
    """
    cells = events.groupBy("user_id", "event_type", "platform").agg(F.count(F.lit(1)).alias("n")).withColumn("type", F.col("event_type"))

    def of(kind: str) -> Column:
        return F.sum(F.when(F.col("type") == kind, F.col("n")).otherwise(0))

    sets = cells.groupingSets([["user_id", "event_type"], ["user_id"], ["platform"]], "user_id", "event_type", "platform").agg(
        F.grouping_id().alias("kind"), F.sum("n").alias("n"), of(vocab.homepage).alias("h"), of(vocab.order).alias("o")
    )
    sets = stored(sets, "exploration")
    users = sets.where(F.col("kind") == BY_USER)
    return {
        "headline": headline_of(users.select("user_id", "n", "h", "o")),
        "event_shares": event_shares_of(sets.where(F.col("kind") == BY_TYPE).select("event_type", "user_id", "n")),
        "order_bands": order_bands_of(users.select("user_id", "o")),
        "platforms": sets.where((F.col("kind") == BY_PLATFORM) & F.col("platform").isNotNull()).select("platform", F.col("n").alias("events")),
    }


def orders_per_user(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, n: int | None = 10) -> DataFrame:
    """Users by number of orders, smallest numbers first."""
    u = events.where(F.col("event_type") == vocab.order).groupBy("user_id").agg(F.count(F.lit(1)).alias("orders"))
    g = u.groupBy("orders").agg(F.count(F.lit(1)).alias("users")).orderBy("orders")
    return g if n is None else g.limit(n)


def order_bands(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Users with 1, 2 and 3 or more orders, and the largest number."""
    return order_bands_of(events.where(F.col("event_type") == vocab.order).groupBy("user_id").agg(F.count(F.lit(1)).alias("o")))


def order_bands_of(users: DataFrame) -> DataFrame:
    o = F.col("o")
    u = users.where(o > 0)
    return u.agg(
        count_if(o == 1).alias("one_order"), count_if(o == 2).alias("two_orders"), count_if(o >= 3).alias("three_or_more"), F.max("o").alias("max_orders")
    )


def histogram(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Equal-width histogram between the smallest and largest value; the largest falls in the last bucket."""
    edges = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    v = F.col(column).cast("double")
    lo, hi = F.col("_e.lo"), F.col("_e.hi")
    position = F.coalesce(F.floor(F.try_divide(v - lo, hi - lo) * buckets), F.lit(0))
    b = df.where(F.col(column).isNotNull()).withColumn("_e", scalar_row(edges)).select(
        F.least(position, F.lit(buckets - 1)).cast("int").alias("bucket"), lo.alias("lo"), hi.alias("hi")
    )
    g = b.groupBy("bucket", "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
    width = (F.col("hi") - F.col("lo")) / buckets
    return g.select("bucket", (F.col("lo") + width * F.col("bucket")).alias("bucket_start"), "count")


def risk_bands(predictions: DataFrame, column: str = "churn_probability") -> DataFrame:
    p = F.col(column)
    return predictions.agg(
        F.count(F.lit(1)).alias("total_users"),
        count_if(p >= 0.7).alias("high_risk"),
        count_if((p >= 0.4) & (p < 0.7)).alias("medium_risk"),
        count_if(p < 0.4).alias("low_risk"),
    )


def top_scored(predictions: DataFrame, column: str, n: int = 100) -> DataFrame:
    return predictions.orderBy(F.desc(column), "user_id").limit(n)


def conversion_overview(predictions: DataFrame, threshold: float = 0.7) -> DataFrame:
    p = F.col("conversion_probability")
    return predictions.agg(
        F.count(F.lit(1)).alias("total_users"),
        count_if(p > threshold).alias("high_intent"),
        F.sum("conversion_prediction").alias("predicted_converters"),
    )


def ltv_overview(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("total_revenue").alias("total_revenue"),
        F.avg("predicted_ltv").alias("avg_predicted_ltv"),
        F.sum("predicted_ltv").alias("total_predicted_ltv"),
    )


def order_headline(orders: DataFrame) -> DataFrame:
    u = orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("order_total").alias("rev"))
    return u.agg(F.sum("n").alias("orders"), F.sum("rev").alias("revenue"), F.count(F.lit(1)).alias("buyers")).withColumn(
        "avg_order_value", ratio(F.col("revenue"), F.col("orders"))
    )


def top_counts(df: DataFrame, key: str, name: str, n: int = 10) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), key).limit(n)


def platform_table(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    t = F.col("event_type")
    u = events.where(F.col("platform").isNotNull()).groupBy("platform", "user_id").agg(
        count_if(t == vocab.homepage).alias("h"), count_if(t == vocab.order).alias("o")
    )
    g = u.groupBy(F.upper("platform").alias("platform")).agg(
        count_if(F.col("h") > 0).alias("users"), count_if(F.col("o") > 0).alias("buyers"), F.sum("o").alias("orders")
    )
    zero = F.lit(0.0)
    return g.select(
        "*",
        F.coalesce(percent(F.col("buyers"), F.col("users")), zero).alias("cvr"),
        F.coalesce(ratio(F.col("orders"), F.col("buyers")), zero).alias("opu"),
    )


def hourly_table(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """24 rows: homepage views, orders and orders per view."""
    t = F.col("event_type")
    g = events.where(t.isin(vocab.homepage, vocab.order)).groupBy(F.hour("event_time").alias("hour")).agg(
        count_if(t == vocab.homepage).alias("h"), count_if(t == vocab.order).alias("o")
    )
    grid = events.sparkSession.range(0, 24, 1, 1).select(F.col("id").cast("int").alias("hour"))
    h, o = F.coalesce("h", F.lit(0)), F.coalesce("o", F.lit(0))
    return grid.join(g, "hour", "left").select(
        "hour", h.alias("homepage_views"), o.alias("orders"), F.coalesce(percent(o, h), F.lit(0.0)).alias("cvr")
    )


def peak_hours(hourly: DataFrame) -> DataFrame:
    """Hour with most traffic, most orders, best conversion; the earliest on ties."""

    def peak(c: str) -> Column:
        return F.min_by("hour", F.struct(-F.col(c), F.col("hour")))

    return hourly.agg(
        peak("homepage_views").alias("peak_traffic_hour"), peak("orders").alias("peak_order_hour"), peak("cvr").alias("peak_cvr_hour")
    )


def adjacent_conversion(drop_off: DataFrame) -> DataFrame:
    """Share of each step's users who also did the next one."""
    return drop_off.select(
        "from_step",
        "to_step",
        F.col("continued").alias("users_continued"),
        F.coalesce(percent(F.col("continued"), F.col("users_at_step")), F.lit(0.0)).alias("conversion_rate"),
    )

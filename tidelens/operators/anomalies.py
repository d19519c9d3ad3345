"""Anomaly detection on hourly, daily and per-user series.

Hourly and daily series hold one row per hour or day of history, so windows over the whole series
are small.  Per-user limits are exact quantiles from the distributed kernel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.columns import US_PER_HOUR, count_if, micros, ratio, round_half_even
from tidelens.functions.distributed import quantiles, scalar_row
from tidelens.functions.graph import components
from tidelens.functions.tables import stored
from tidelens.operators.journeys import union_all
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary

SEVERITY = {"low": 1, "medium": 2, "high": 3}


def z_score(value: Column, window) -> Column:
    """Signed z with the population deviation; NULL on constant series or fewer than three rows."""
    filled = F.coalesce(value, F.avg(value).over(window))
    z = F.try_divide(filled - F.avg(value).over(window), F.stddev_pop(filled).over(window))
    return F.when(F.count(F.lit(1)).over(window) >= 3, z)


def iqr_outliers(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Flags values outside Q1 - 1.5 IQR .. Q3 + 1.5 IQR, one flag column per ``source -> flag``."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = df
    for source, flag in columns.items():
        q = quantiles(df, source, {"q1": 0.25, "q3": 0.75})
        out = out.withColumn("_q", scalar_row(q))
        spread = (F.col("_q.q3") - F.col("_q.q1")) * 1.5
        v = F.col(source)
        outside = (v < F.col("_q.q1") - spread) | (v > F.col("_q.q3") + spread)
        out = out.withColumn(flag, (n >= 3) & outside).drop("_q")
    return out


def volume_anomalies(events: DataFrame, sensitivity: float = 2.0) -> DataFrame:
    hourly = events.groupBy(F.date_trunc("hour", "event_time").alias("datetime")).agg(F.count(F.lit(1)).alias("events"))
    every = Window.partitionBy()
    n = F.col("events")
    s = F.lit(float(sensitivity))
    mean, spread = F.avg("events").over(every), F.stddev_samp("events").over(every)
    flagged = (
        hourly.withColumn("z_score", F.abs(z_score(n, every)))
        .withColumn("expected_min", F.greatest(F.lit(0.0), mean - s * spread))
        .withColumn("expected_max", mean + s * spread)
        .where(F.col("z_score") > s)
    )
    kind = F.when(n > F.col("expected_max"), "spike").when(n < F.col("expected_min"), "drop").otherwise("normal")
    return flagged.select(
        "datetime",
        F.to_date("datetime").alias("date"),
        F.hour("datetime").alias("hour"),
        "events",
        "z_score",
        kind.alias("anomaly_type"),
        "expected_min",
        "expected_max",
    )


def user_anomalies(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Users with at least two of four suspicious traits."""
    us = micros(F.col("event_time"))
    u = events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        ((F.max(us) - F.min(us)) / F.lit(float(US_PER_HOUR))).alias("session_duration_hours"),
        count_if(F.col("event_type") == vocab.order).alias("checkouts"),
    )
    hours = F.col("session_duration_hours")
    u = u.withColumn("events_per_hour", F.col("total_events") / F.greatest(hours, F.lit(0.1)))
    f = (
        iqr_outliers(u, {"events_per_hour": "high_event_rate", "checkouts": "high_checkouts"})
        .withColumn("fast_heavy_usage", (hours < 0.1) & (F.col("total_events") > 50))
        .withColumn("checkout_heavy", ratio(F.col("checkouts"), F.col("total_events")) > 0.5)
    )
    names = {
        "high_event_rate": "High Event Rate",
        "high_checkouts": "High Checkouts",
        "fast_heavy_usage": "Fast Heavy Usage",
        "checkout_heavy": "Checkout Heavy",
    }
    total = sum((F.col(c).cast("int") for c in list(names)[1:]), F.col("high_event_rate").cast("int"))
    return (
        f.withColumn("total_flags", total)
        .where(F.col("total_flags") >= 2)
        .select(
            "user_id",
            "total_events",
            "checkouts",
            "events_per_hour",
            "session_duration_hours",
            "total_flags",
            F.concat_ws(", ", *[F.when(F.col(c), F.lit(t)) for c, t in names.items()]).alias("flags"),
        )
    )


def merchant_anomalies(orders: DataFrame, sensitivity: float = 2.0) -> DataFrame:
    """Days on which a merchant's orders leave its own baseline (at least three active days)."""
    daily = orders.groupBy("merchant", F.to_date("event_time").alias("date")).agg(F.count(F.lit(1)).alias("orders"))
    w = Window.partitionBy("merchant")  # one row per active day
    s = F.lit(float(sensitivity))
    z = (F.col("orders") - F.col("avg_daily_orders")) / F.greatest(F.col("_sd"), F.lit(1.0))
    return (
        daily.withColumn("avg_daily_orders", F.avg("orders").over(w))
        .withColumn("_sd", F.stddev_samp("orders").over(w))
        .withColumn("_days", F.count(F.lit(1)).over(w))
        .where(F.col("_days") >= 3)
        .withColumn("z_score", z)
        .where(F.abs("z_score") > s)
        .select(
            "date",
            "merchant",
            "orders",
            "avg_daily_orders",
            "z_score",
            F.when(F.col("z_score") > s, "surge").otherwise("drop").alias("anomaly_type"),
        )
    )


def conversion_anomalies(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, sensitivity: float = 2.0) -> DataFrame:
    # one row per (hour, user) first: distinct users become plain counts
    users = events.groupBy(F.date_trunc("hour", "event_time").alias("datetime"), "user_id").agg(
        F.max((F.col("event_type") == vocab.order).cast("int")).alias("bought")
    )
    hourly = users.groupBy("datetime").agg(F.count(F.lit(1)).alias("unique_users"), F.sum("bought").alias("checkout_users"))
    every = Window.partitionBy()
    rate = F.col("conversion_rate")
    flagged = (
        hourly.withColumn("conversion_rate", round_half_even(ratio(F.col("checkout_users"), F.col("unique_users")) * 100, 2))
        .withColumn("z_score", F.abs(z_score(rate, every)))
        .withColumn("expected_cvr", F.avg("conversion_rate").over(every))
        .where(F.col("z_score") > float(sensitivity))
    )
    kind = F.when(rate > F.col("expected_cvr"), "high").when(rate < F.col("expected_cvr"), "low").otherwise("normal")
    return flagged.select(
        "datetime", "unique_users", "checkout_users", "conversion_rate", "expected_cvr", "z_score", kind.alias("anomaly_type")
    )


def payment_anomalies(orders: DataFrame, sensitivity: float = 2.0) -> DataFrame:
    """Days on which a payment method's share of orders is unusual for that method."""
    daily = orders.groupBy(F.to_date("event_time").alias("date"), "payment_method").agg(F.count(F.lit(1)).alias("n"))
    methods = daily.agg(F.array_sort(F.collect_set("payment_method")).alias("m")).scalar()  # a short vocabulary
    grid = daily.groupBy("date").agg(F.sum("n").alias("day_total")).select("*", F.explode(methods).alias("payment_method"))
    full = grid.join(daily, ["date", "payment_method"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_method = Window.partitionBy("payment_method")
    share = full.withColumn("s", ratio(F.col("n"), F.col("day_total"))).withColumn("z", z_score(F.col("s"), by_method))
    overall = share.withColumn("expected", ratio(F.sum("n").over(by_method), F.sum("n").over(Window.partitionBy())))
    return overall.where(F.abs("z") > float(sensitivity)).select(
        "date",
        "payment_method",
        (F.col("s") * 100).alias("share"),
        (F.col("expected") * 100).alias("expected_share"),
        F.when(F.col("s") > F.col("expected"), "high").otherwise("low").alias("anomaly_type"),
    )


def anomalies_report(
    events: DataFrame, orders: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, sensitivity: float = 2.0
) -> dict[str, DataFrame]:
    return {
        "volume_anomalies": volume_anomalies(events, sensitivity),
        "user_anomalies": user_anomalies(events, vocab),
        "merchant_anomalies": merchant_anomalies(orders, sensitivity),
        "conversion_anomalies": conversion_anomalies(events, vocab, sensitivity),
        "payment_anomalies": payment_anomalies(orders, sensitivity),
    }


def anomaly_summary(
    events: DataFrame, orders: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, sensitivity: float = 2.0
) -> DataFrame:
    r = anomalies_report(events, orders, vocab, sensitivity)
    kind = F.col("anomaly_type")

    def size(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    v = r["volume_anomalies"].agg(
        F.count(F.lit(1)).alias("volume_anomalies"),
        count_if(kind == "spike").alias("volume_spikes"),
        count_if(kind == "drop").alias("volume_drops"),
    )
    return v.select(
        "volume_anomalies",
        F.coalesce("volume_spikes", F.lit(0)).alias("volume_spikes"),
        F.coalesce("volume_drops", F.lit(0)).alias("volume_drops"),
        size(r["user_anomalies"]).alias("suspicious_users"),
        size(r["merchant_anomalies"]).alias("merchant_anomalies"),
        size(r["conversion_anomalies"]).alias("conversion_anomalies"),
        F.lit(float(sensitivity)).alias("sensitivity"),
    )


def alerts(
    events: DataFrame,
    orders: DataFrame,
    vocab: Vocabulary = DEFAULT_VOCABULARY,
    sensitivity: float = 2.0,
    severity_threshold: str = "medium",
) -> DataFrame:
    """One row per alert whose rule fires, severest first."""
    kind = F.col("anomaly_type")

    def row(df: DataFrame, cond: Column, type_: str, level: Column, title: Column, message: Column, action: Column) -> DataFrame:
        name = F.when(level == 3, "high").when(level == 2, "medium").otherwise("low")
        return df.where(cond).select(
            F.lit(type_).alias("type"),
            name.alias("severity"),
            level.alias("severity_level"),
            title.alias("title"),
            message.alias("message"),
            action.alias("action"),
        )

    volume = volume_anomalies(events, sensitivity)
    at = F.date_format(F.col("x.datetime"), "yyyy-MM-dd HH:mm:ss")
    whole = F.struct("datetime", "events", "expected_min", "expected_max")
    spike = volume.where(kind == "spike").agg(F.max_by(whole, F.struct("events", -F.unix_micros("datetime"))).alias("x"))
    drop = volume.where(kind == "drop").agg(F.min_by(whole, F.struct("events", "datetime")).alias("x"))
    users = user_anomalies(events, vocab).agg(F.count(F.lit(1)).alias("n"))
    merchants = (
        merchant_anomalies(orders, sensitivity)
        .where(kind == "drop")
        .groupBy("merchant")
        .agg(F.min("date").alias("d"))
    )
    # Number of merchants and the three with the earliest drop; only these three names are gathered.
    first3 = merchants.orderBy("d", "merchant").limit(3).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "merchant"))), lambda s: s["merchant"]), ", ").alias("names")
    )
    dropped = merchants.agg(F.count(F.lit(1)).alias("n")).withColumn("names", first3.scalar())
    low = conversion_anomalies(events, vocab, sensitivity).agg(count_if(kind == "low").alias("n"))
    n = F.col("n")
    level = F.when(n > 10, 3).otherwise(2)
    rows = [
        row(
            spike,
            F.col("x").isNotNull(),
            "volume_spike",
            F.lit(2),
            F.lit("Traffic Spike Detected"),
            F.format_string("Unusual traffic spike at %s: %d events (expected max: %.0f)", at, F.col("x.events"), F.col("x.expected_max")),
            F.lit("Monitor system performance and capacity"),
        ),
        row(
            drop,
            F.col("x").isNotNull(),
            "volume_drop",
            F.lit(3),
            F.lit("Traffic Drop Detected"),
            F.format_string("Significant traffic drop at %s: %d events (expected min: %.0f)", at, F.col("x.events"), F.col("x.expected_min")),
            F.lit("Investigate potential outage or tracking issues"),
        ),
        row(
            users,
            n > 0,
            "suspicious_activity",
            level,
            F.format_string("%d Suspicious Users Detected", n),
            F.when(n > 10, "Users showing potential bot/fraud behavior").otherwise("Users showing unusual behavior patterns"),
            F.when(n > 10, "Review user accounts and consider blocking").otherwise("Monitor and investigate if pattern continues"),
        ),
        row(
            dropped,
            n > 0,
            "merchant_drop",
            F.lit(2),
            F.format_string("%d Merchants with Order Drops", n),
            F.format_string("Unusual order decline for: %s", F.col("names")),
            F.lit("Check merchant status and availability"),
        ),
        row(
            low,
            n > 0,
            "low_conversion",
            F.lit(3),
            F.lit("Low Conversion Rate Detected"),
            F.format_string("%d periods with abnormally low conversion", n),
            F.lit("Check checkout flow and payment systems"),
        ),
    ]
    return union_all(rows).where(F.col("severity_level") >= SEVERITY.get(severity_threshold, 2)).orderBy(F.desc("severity_level"), "type")


def fraud_patterns(
    events: DataFrame, attributes: Sequence[str], vocab: Vocabulary = DEFAULT_VOCABULARY, min_users: int = 3, min_orders: int = 1
) -> DataFrame:
    """Rings of users linked by values they share, such as a device, an address or a card.

    Users of one value are linked through the smallest of them, so a value shared by very many users makes as many links as it has users.
    Rings are the connected components of at least ``min_users`` users and ``min_orders`` orders: ``ring`` (smallest user), ``users``,
    ``shared_values``, ``events``, ``orders``, ``revenue``, ``orders_per_user`` and the share of the ring's users who ordered.
    Null values link nobody.
    """
    one = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in attributes])
    held = events.where(F.col("user_id").isNotNull()).select("user_id", F.explode(one).alias("v")).select("user_id", "v.*")
    held = stored(held.where(F.col("value").isNotNull()).distinct(), "user-values")
    first = held.groupBy("attribute", "value").agg(F.min("user_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    links = held.join(first, ["attribute", "value"]).where("user_id <> a").select("a", F.col("user_id").alias("b"))
    rings = components(links)
    is_order = F.col("event_type") == vocab.order
    per_user = events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"),
        count_if(is_order).alias("orders"),
        F.sum(F.when(is_order, F.col("order_total"))).alias("revenue"),
    )
    by_ring = (
        rings.join(per_user, F.col("node") == F.col("user_id"))
        .groupBy(F.col("component").alias("ring"))
        .agg(
            F.count(F.lit(1)).alias("users"),
            F.sum("events").alias("events"),
            F.sum("orders").alias("orders"),
            F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
            F.avg((F.col("orders") > 0).cast("double")).alias("ordering_share"),
        )
    )
    values = first.join(rings, F.col("a") == F.col("node")).groupBy(F.col("component").alias("ring")).agg(F.count(F.lit(1)).alias("shared_values"))
    kept = by_ring.where((F.col("users") >= min_users) & (F.col("orders") >= min_orders))
    return kept.join(values, "ring").select(
        "ring", "users", "shared_values", "events", "orders", "revenue", ratio(F.col("orders"), F.col("users")).alias("orders_per_user"), "ordering_share"
    )


def hourly_series(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """``metric, hour, value``: events, orders and orders per event of every hour with events."""
    hourly = events.groupBy(F.date_trunc("hour", "event_time").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("event_type") == vocab.order).alias("o")
    )
    cells = F.array(
        F.struct(F.lit("events").alias("metric"), F.col("n").cast("double").alias("value")),
        F.struct(F.lit("orders").alias("metric"), F.col("o").cast("double").alias("value")),
        F.struct(F.lit("order_share").alias("metric"), ratio(F.col("o"), F.col("n")).alias("value")),
    )
    return hourly.where(F.col("hour").isNotNull()).select("hour", F.explode(cells).alias("c")).select("c.metric", "hour", "c.value")


def systemic_issues(series: DataFrame, slack: float = 0.5, limit: float = 5.0) -> DataFrame:
    """Lasting shifts of a series (metric, hour, value): cumulative sums of its standardised values, upwards and downwards.

    A sum S grows by the value's distance from the mean beyond ``slack`` deviations and never falls below 0; an alarm is an hour at which it
    passes ``limit``.  S is the running total minus its smallest earlier value (or 0), so no recursion is needed.  ``onset`` is the hour after the last one at which S was
    0.  A metric has one row an hour, so a window over it is small.  Constant series have no alarms.
    """
    by = Window.partitionBy("metric")
    z = F.try_divide(F.col("value") - F.avg("value").over(by), F.stddev_pop("value").over(by))
    signs = F.array(F.struct(F.lit("up").alias("direction"), F.lit(1.0).alias("sign")), F.struct(F.lit("down").alias("direction"), F.lit(-1.0).alias("sign")))
    scored = series.withColumn("z", z).where(F.col("z").isNotNull())
    steps = scored.select("metric", "hour", "value", "z", F.explode(signs).alias("d")).select(
        "metric", "hour", "value", "d.direction", round_half_even(F.col("d.sign") * F.col("z") - F.lit(float(slack)), 9).alias("step")
    )
    run = Window.partitionBy("metric", "direction").orderBy("hour")
    upto = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = steps.withColumn("total", round_half_even(F.sum("step").over(upto), 6))
    sums = total.withColumn("score", round_half_even(F.col("total") - F.least(F.lit(0.0), F.min("total").over(upto)), 6))
    zero = F.max(F.when(F.col("score") <= 0, F.col("hour"))).over(upto)
    marked = sums.withColumn("zero", zero).withColumn("before", F.coalesce(F.lag("score").over(run), F.lit(0.0)))
    start = F.min("hour").over(Window.partitionBy("metric", "direction", "zero").orderBy("hour").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # the hours that follow a zero share it; the first of them begins the shift
    shifts = marked.where("score > 0").withColumn("onset", start)
    return shifts.where((F.col("score") > limit) & (F.col("before") <= limit)).select("metric", "direction", "onset", F.col("hour").alias("alarm"), "score")

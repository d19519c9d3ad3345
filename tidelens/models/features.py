"""Model features: (user, day) partials, then one row per user; sessions from linked partials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.functions.columns import US_PER_HOUR, count_if, days, micros, minutes, ratio
from tidelens.functions.distributed import scalar_quantile
from tidelens.operators.sessions import chunked_events, link_partials
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary
from tidelens.sources.normalise import order_properties, with_order_value


def _is(t: str) -> Column:
    return F.col("event_type") == t


def session_counts(events: DataFrame, timeout_minutes: float = 30) -> DataFrame:
    """Number of gap sessions per user."""
    partials = (
        chunked_events(events.select("user_id", "event_time", "event_id"), timeout_minutes)
        .groupBy("user_id", "chunk", "local")
        .agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    )
    return link_partials(partials, timeout_minutes).groupBy("user_id").agg(F.max("session_no").alias("total_sessions"))


def _daily(events: DataFrame, vocab: Vocabulary, *extra: Column) -> DataFrame:
    us, hour, dow = micros(F.col("event_time")), F.hour("event_time"), F.weekday("event_time")
    return events.groupBy("user_id", F.to_date("event_time").alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(us).alias("a"),
        F.max(us).alias("b"),
        F.collect_set("event_type").alias("types"),  # at most the vocabulary
        *[count_if(F.col("platform") == p).alias(f"p_{p}") for p in vocab.platforms],
        F.sum(hour).alias("h1"),
        F.sum(hour * hour).alias("h2"),
        F.min(hour).alias("hmin"),
        F.first(dow).alias("dow"),
        *extra,
    )


def _users(daily: DataFrame, vocab: Vocabulary, *extra: Column) -> DataFrame:
    dow, n = F.col("dow"), F.col("n")
    return daily.groupBy("user_id").agg(
        F.sum("n").alias("total_events"),
        F.size(F.array_distinct(F.flatten(F.collect_set("types")))).alias("unique_event_types"),
        F.count("day").alias("active_days"),
        F.min("a").alias("a"),
        F.max("b").alias("b"),
        *[F.sum(f"p_{p}").alias(f"p_{p}") for p in vocab.platforms],
        F.sum("h1").alias("h1"),
        F.sum("h2").alias("h2"),
        F.min("hmin").alias("hmin"),
        F.sum(dow * n).alias("d1"),
        F.sum(dow * dow * n).alias("d2"),
        *[F.sum(F.when(dow == d, n).otherwise(0)).alias(f"dow{d}") for d in range(7)],
        *extra,
    )


def _latest(events: DataFrame) -> Column:
    return events.agg(F.max(micros(F.col("event_time"))).alias("m")).scalar()


def _std(s1: str, s2: str) -> Column:
    """Sample deviation from integer sums; 0 where there is one row."""
    n = F.col("total_events").cast("double")
    var = F.try_divide(n * F.col(s2) - F.col(s1).cast("double") * F.col(s1), n * (n - 1))
    return F.coalesce(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0))


def _mean(s1: str) -> Column:
    return ratio(F.col(s1), F.col("total_events"))


def _first_max(names: list[str], values: list, default) -> Column:
    """Value whose count is the largest, the first listed on ties, ``default`` when all are 0."""
    best = F.greatest(*[F.col(c) for c in names]) if len(names) > 1 else F.col(names[0])
    out = F.lit(default)
    for c, v in reversed(list(zip(names, values))):
        out = F.when(F.col(c) == best, F.lit(v)).otherwise(out)
    return F.when(best > 0, out).otherwise(F.lit(default))


def platform_mode(vocab: Vocabulary) -> Column:
    names = sorted(vocab.platforms)
    return _first_max([f"p_{p}" for p in names], names, "unknown")


def churn_features(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    roles = {
        "homepage_views": vocab.homepage,
        "product_views": vocab.product_view,
        "cart_adds": vocab.add,
        "checkouts": vocab.order,
        "orders_delivered": vocab.delivered,
    }
    daily = _daily(events, vocab, *[count_if(_is(t)).alias(n) for n, t in roles.items()])
    u = _users(daily, vocab, *[F.sum(n).alias(n) for n in roles])
    weekend = F.col("dow5") + F.col("dow6")
    one = F.lit(1)
    return (
        u.join(session_counts(events), "user_id")
        .withColumn("_latest", _latest(events))
        .select(
            "user_id",
            "total_events",
            "unique_event_types",
            days(F.col("_latest") - F.col("b")).alias("days_since_last_event"),
            days(F.col("_latest") - F.col("a")).alias("account_age_days"),
            "active_days",
            ratio(F.col("total_events"), F.greatest("active_days", one)).alias("events_per_day"),
            "total_sessions",
            ratio(F.col("total_events"), F.greatest("total_sessions", one)).alias("events_per_session"),
            *roles,
            (F.col("checkouts") > 0).cast("int").alias("has_ordered"),
            (F.col("checkouts") > 1).cast("int").alias("has_multiple_orders"),
            F.least(ratio(F.col("cart_adds"), F.greatest("product_views", one)), F.lit(1.0)).alias("view_to_cart_rate"),
            F.least(ratio(F.col("checkouts"), F.greatest("cart_adds", one)), F.lit(1.0)).alias("cart_to_checkout_rate"),
            *[F.col(f"p_{p}").alias(f"platform_{p}") for p in vocab.platforms],
            _mean("h1").alias("avg_hour"),
            _std("h1", "h2").alias("hour_std"),
            _mean("d1").alias("avg_dayofweek"),
            _std("d1", "d2").alias("dayofweek_std"),
            ratio(weekend, F.col("total_events")).alias("weekend_ratio"),
        )
    )


def churn_labels(history: DataFrame, future: DataFrame) -> DataFrame:
    """1 for users of the history without events in the future period, else 0."""
    later = future.select("user_id").distinct().withColumn("_f", F.lit(1))
    return history.select("user_id").distinct().join(later, "user_id", "left").select(
        "user_id", F.when(F.col("_f").isNull(), 1).otherwise(0).alias("label")
    )


def conversion_user_features(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    stages = {f"n_{s}": s for s in vocab.full_funnel}
    extra = {
        "n_searches": _is(vocab.search),
        "cart_interactions": F.col("event_type").isin(vocab.add, vocab.cart, vocab.cart_created),
        "payment_changes": _is(vocab.payment_method_view),
        "merchants_viewed": _is(vocab.merchant_view),
        "products_viewed": _is(vocab.product_view),
        "_adds": _is(vocab.add),
        "_orders": _is(vocab.order),
    }
    daily = _daily(
        events, vocab, *[count_if(_is(t)).alias(n) for n, t in stages.items()], *[count_if(c).alias(n) for n, c in extra.items()]
    )
    u = _users(daily, vocab, *[F.sum(n).alias(n) for n in [*stages, *extra]])
    names = list(stages)
    depth = sum(((F.col(n) > 0).cast("int") for n in names[1:]), (F.col(names[0]) > 0).cast("int"))
    span = F.least(minutes(F.col("b") - F.col("a")), F.lit(180.0))
    dow = _first_max([f"dow{d}" for d in range(7)], list(range(7)), 3)
    one = F.lit(1)
    base = u.withColumn("session_duration_mins", span).withColumn("avg_hour", _mean("h1")).withColumn("_platform", platform_mode(vocab))
    return base.select(
        "user_id",
        "total_events",
        "unique_event_types",
        *names,
        depth.alias("funnel_depth"),
        "session_duration_mins",
        ratio(F.col("total_events"), F.greatest("session_duration_mins", F.lit(1.0))).alias("events_per_minute"),
        "n_searches",
        (F.col("n_searches") > 0).cast("int").alias("has_searched"),
        "cart_interactions",
        "payment_changes",
        (F.col("payment_changes") > 0).cast("int").alias("had_payment_friction"),
        *[(F.col("_platform") == p).cast("int").alias(f"platform_{p}") for p in vocab.platforms],
        "avg_hour",
        F.col("hmin").alias("first_hour"),
        F.col("avg_hour").between(11, 14).cast("int").alias("is_lunch_time"),
        F.col("avg_hour").between(18, 22).cast("int").alias("is_dinner_time"),
        dow.alias("dayofweek"),
        dow.isin(5, 6).cast("int").alias("is_weekend"),
        "merchants_viewed",
        "products_viewed",
        F.least(ratio(F.col("_adds"), F.greatest("products_viewed", one)), F.lit(1.0)).alias("view_to_add_ratio"),
        F.least(ratio(F.col("_orders"), F.greatest("_adds", one)), F.lit(1.0)).alias("add_to_checkout_ratio"),
    )


def conversion_session_features(
    events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, timeout_minutes: float = 30
) -> DataFrame:
    flags = {
        f"has_{t}": t for t in (vocab.homepage, vocab.product_view, vocab.add, vocab.checkout_button, vocab.order)
    }
    partials = (
        chunked_events(events.select("user_id", "event_time", "event_type", "event_id"), timeout_minutes)
        .groupBy("user_id", "chunk", "local")
        .agg(
            F.min("us").alias("start_us"),
            F.max("us").alias("end_us"),
            F.count(F.lit(1)).alias("n"),
            F.collect_set("event_type").alias("types"),  # at most the vocabulary
            *[F.max(_is(t).cast("int")).alias(n) for n, t in flags.items()],
        )
    )
    s = link_partials(partials, timeout_minutes).groupBy("user_id", "session_no").agg(
        F.sum("n").alias("events_in_session"),
        F.size(F.array_distinct(F.flatten(F.collect_set("types")))).alias("unique_events"),
        F.least(minutes(F.max("end_us") - F.min("start_us")), F.lit(120.0)).alias("session_duration_mins"),
        *[F.max(n).alias(n) for n in flags],
    )
    names = list(flags)
    return s.select(
        F.concat_ws("_", F.col("user_id").cast("string"), F.col("session_no").cast("string")).alias("session_key"),
        "user_id",
        "events_in_session",
        "unique_events",
        "session_duration_mins",
        *names,
        (F.col(names[0]) + F.col(names[1]) + F.col(names[2]) + F.col(names[3])).alias("funnel_depth"),
    )


def conversion_features(events: DataFrame, level: str = "user", vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    if level == "user":
        return conversion_user_features(events, vocab)
    if level == "session":
        return conversion_session_features(events, vocab)
    raise ValueError(f"unknown level: {level}")


def conversion_labels(features: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, events: DataFrame | None = None) -> DataFrame:
    """Adds ``label``: the order flag from the features, or from raw events when they lack it."""
    for name in (f"n_{vocab.order}", f"has_{vocab.order}"):
        if name in features.columns:
            return features.withColumn("label", (F.col(name) > 0).cast("int"))
    buyers = events.where(_is(vocab.order)).select("user_id").distinct().withColumn("_b", F.lit(1))
    return features.join(buyers, "user_id", "left").withColumn("label", F.col("_b").isNotNull().cast("int")).drop("_b")


def without_leaks(features: DataFrame, patterns=("checkout_completed", "checkout", "add_to_checkout", "payment")) -> DataFrame:
    """Drops columns that give the conversion label away."""
    return features.drop(*[c for c in features.columns if any(p in c.lower() for p in patterns)])


def ltv_features(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, drop_leaky: bool = False) -> DataFrame:
    """About 30 features per user.  ``drop_leaky`` removes the columns whose product is the target."""
    roles = {
        "homepage_views": vocab.homepage,
        "searches": vocab.search,
        "merchant_views": vocab.merchant_view,
        "product_views": vocab.product_view,
        "cart_adds": vocab.add,
    }
    src = with_order_value(order_properties(events), vocab, absent=0.0)
    us, order, v = micros(F.col("event_time")), _is(vocab.order), F.col("order_value")
    daily = _daily(
        src,
        vocab,
        *[count_if(_is(t)).alias(n) for n, t in roles.items()],
        count_if(order).alias("order_count"),
        F.min(F.when(order, us)).alias("oa"),
        F.sum(v).alias("v1"),
        F.sum(v * v).alias("v2"),
        F.count(v).alias("vn"),
        F.min(v).alias("vmin"),
        F.max(v).alias("vmax"),
    )
    sums = ("order_count", "v1", "v2", "vn", *roles)
    u = _users(daily, vocab, *[F.sum(n).alias(n) for n in sums], F.min("oa").alias("oa"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))
    merchants = src.where(order & F.col("merchant_id").isNotNull()).groupBy("user_id").agg(
        F.countDistinct("merchant_id").alias("unique_merchants_ordered")
    )
    zero, n = F.lit(0.0), F.col("vn").cast("double")
    var = F.try_divide(F.col("v2") - F.col("v1") * F.col("v1") / F.nullif(n, F.lit(0.0)), n - 1)
    first_days = F.coalesce(days(F.col("_latest") - F.col("oa")), F.lit(-1.0))
    base = (
        u.join(session_counts(events), "user_id")
        .join(merchants, "user_id", "left")
        .withColumn("_latest", _latest(events))
        .withColumn("total_revenue", F.coalesce("v1", zero))
        .withColumn("avg_order_value", F.coalesce(ratio(F.col("v1"), F.col("vn")), zero))
        .withColumn("days_since_first_order", first_days)
        .withColumn("account_age_days", days(F.col("_latest") - F.col("a")))
        .withColumn("_platform", platform_mode(vocab))
    )
    age = F.greatest(F.col("account_age_days"), F.lit(1.0))
    orders = F.col("order_count")
    out = base.select(
        "user_id",
        "total_events",
        "unique_event_types",
        "order_count",
        "total_revenue",
        "avg_order_value",
        F.coalesce("vmin", zero).alias("min_order_value"),
        F.coalesce("vmax", zero).alias("max_order_value"),
        F.coalesce(F.sqrt(F.greatest(var, zero)), zero).alias("order_value_std"),
        F.coalesce((F.col("oa") - F.col("a")) / F.lit(float(US_PER_HOUR)), F.lit(-1.0)).alias("time_to_first_order_hours"),
        "days_since_first_order",
        "account_age_days",
        days(F.col("_latest") - F.col("b")).alias("days_since_last_activity"),
        "active_days",
        ratio(orders, F.greatest("active_days", F.lit(1))).alias("order_frequency"),
        F.when(F.col("days_since_first_order") > 0, F.try_divide("total_revenue", "days_since_first_order"))
        .otherwise(F.col("total_revenue"))
        .alias("revenue_velocity"),
        (F.col("total_events") / age).alias("events_per_day"),
        "total_sessions",
        (F.col("total_sessions") / age).alias("sessions_per_day"),
        *roles,
        F.coalesce(ratio(F.col("product_views"), orders), F.col("product_views").cast("double")).alias("views_per_order"),
        F.coalesce(ratio(F.col("searches"), orders), F.col("searches").cast("double")).alias("searches_per_order"),
        F.coalesce("unique_merchants_ordered", F.lit(0)).alias("unique_merchants_ordered"),
        *[(F.col("_platform") == p).cast("int").alias(f"platform_{p}") for p in vocab.platforms],
        _mean("h1").alias("avg_hour"),
        ratio(F.col("dow5") + F.col("dow6"), F.col("total_events")).alias("weekend_ratio"),
        (orders > 1).cast("int").alias("is_repeat_customer"),
    )
    median = scalar_quantile(base.select("avg_order_value"), "avg_order_value", 0.5)
    # The value and the median come from two evaluations whose sums may differ in the last digit.
    out = out.withColumn("is_high_value", (F.round("avg_order_value", 6) > F.round(median, 6)).cast("int"))
    return out.drop("avg_order_value", "revenue_velocity") if drop_leaky else out

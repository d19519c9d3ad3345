"""Summary queries of the dashboard pages that are not covered by an operator of another family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelens.catalog import bindings as b
from tidelens.catalog.behaviour import _DROP, _JOURNEYS, _LIFT, _TOP_JOURNEYS, _journeys
from tidelens.catalog.bindings import EV, ORD, STEPS
from tidelens.catalog.registry import query
from tidelens.catalog.users import REA, SURV, _NTH, _dormant
from tidelens.operators import cohorts, funnels, journeys, overview, survival

V = b.VOCAB

_U = "uu AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'signup') AS h, count(*) FILTER (WHERE event_type = 'purchase') AS o FROM ev GROUP BY 1)"


@query(
    "dsh01_headline",
    f"""WITH {EV}, {_U}, g AS (SELECT CAST(sum(n) AS BIGINT) AS total_events, count(*) AS unique_users, count(*) FILTER (WHERE h > 0) AS homepage_users,
 count(*) FILTER (WHERE o > 0) AS buyers, CAST(sum(o) AS BIGINT) AS total_orders FROM uu)
SELECT *, total_events::DOUBLE / unique_users AS events_per_user, buyers::DOUBLE / homepage_users * 100 AS conversion_rate, total_orders::DOUBLE / buyers AS orders_per_buyer FROM g""",
    "events_per_user conversion_rate orders_per_buyer",
)
def _(spark, sf):
    return overview.headline(b.events(spark, sf), V)


@query("dsh01_top_event_types", "SELECT event_type, count(*) AS events FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf):
    return overview.top_counts(b.events(spark, sf), "event_type", "events")


@query("dsh01_orders_per_user", f"WITH {EV}, {_U} SELECT o AS orders, count(*) AS users FROM uu WHERE o > 0 GROUP BY 1 ORDER BY 1 LIMIT 10")
def _(spark, sf):
    return overview.orders_per_user(b.events(spark, sf), V)


@query(
    "src33_order_bands",
    f"""WITH {EV}, {_U} SELECT count(*) FILTER (WHERE o = 1) AS one_order, count(*) FILTER (WHERE o = 2) AS two_orders, count(*) FILTER (WHERE o >= 3) AS three_or_more, max(o) AS max_orders
FROM uu WHERE o > 0""",
)
def _(spark, sf):
    return overview.order_bands(b.events(spark, sf), V)


def hist_sql(source: str, column: str, buckets: int) -> str:
    return f"""SELECT bucket, lo + (hi - lo) / {buckets} * bucket AS bucket_start, count(*) AS count FROM (
 SELECT CAST(least(floor(coalesce(({column} - lo) / NULLIF(hi - lo, 0) * {buckets}, 0)), {buckets - 1}) AS BIGINT) AS bucket, lo, hi
 FROM {source}, (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {source}) WHERE {column} IS NOT NULL) GROUP BY bucket, lo, hi"""


# Scores of stored prediction tables: derived from the events so that the pages have input.
_PRED = """pr AS (SELECT user_id, avg(value) / (1 + avg(value)) AS p, sum(value) AS v, count(*) AS n FROM events GROUP BY 1),
pp AS (SELECT user_id, (user_id * 37 % 101) / 100.0::DOUBLE AS churn_probability, (user_id * 53 % 101) / 100.0::DOUBLE AS conversion_probability,
 ((user_id * 53 % 101) >= 50)::BIGINT AS conversion_prediction, v AS total_revenue, v * 2 AS predicted_ltv FROM pr)"""


def _pred(spark, sf):
    u = b.table(spark, sf, "events").groupBy("user_id").agg(F.sum("value").alias("v"))
    return u.select(
        "user_id",
        ((F.col("user_id") * 37 % 101) / 100.0).alias("churn_probability"),
        ((F.col("user_id") * 53 % 101) / 100.0).alias("conversion_probability"),
        ((F.col("user_id") * 53 % 101) >= 50).cast("int").alias("conversion_prediction"),
        F.col("v").alias("total_revenue"),
        (F.col("v") * 2).alias("predicted_ltv"),
    )


@query(
    "dsh02_risk_bands",
    f"""WITH {_PRED} SELECT count(*) AS total_users, count(*) FILTER (WHERE churn_probability >= 0.7) AS high_risk,
 count(*) FILTER (WHERE churn_probability >= 0.4 AND churn_probability < 0.7) AS medium_risk, count(*) FILTER (WHERE churn_probability < 0.4) AS low_risk FROM pp""",
)
def _(spark, sf):
    return overview.risk_bands(_pred(spark, sf))


@query("dsh02_churn_histogram", f"WITH {_PRED} {hist_sql('pp', 'churn_probability', 50)}", "bucket_start")
def _(spark, sf):
    return overview.histogram(_pred(spark, sf), "churn_probability", 50)


@query("dsh02_top_risk", f"WITH {_PRED} SELECT user_id, churn_probability FROM pp ORDER BY 2 DESC, 1 LIMIT 100")
def _(spark, sf):
    return overview.top_scored(_pred(spark, sf), "churn_probability").select("user_id", "churn_probability")


@query(
    "dsh03_conversion",
    f"""WITH {_PRED} SELECT count(*) AS total_users, count(*) FILTER (WHERE conversion_probability > 0.7) AS high_intent,
 CAST(sum(conversion_prediction) AS BIGINT) AS predicted_converters FROM pp""",
)
def _(spark, sf):
    return overview.conversion_overview(_pred(spark, sf))


@query(
    "dsh04_ltv",
    f"""WITH {_PRED} SELECT count(*) AS customers, sum(total_revenue) AS total_revenue, avg(predicted_ltv) AS avg_predicted_ltv, sum(predicted_ltv) AS total_predicted_ltv FROM pp""",
    "total_revenue:3 avg_predicted_ltv total_predicted_ltv:3",
)
def _(spark, sf):
    return overview.ltv_overview(_pred(spark, sf))


@query(
    "dsh05_adjacent_conversion",
    """WITH st AS (SELECT * FROM (VALUES ('signup', 'view'), ('view', 'click'), ('click', 'purchase')) t(from_step, to_step)),
d AS (SELECT DISTINCT user_id, event_type FROM events)
SELECT from_step, to_step, count(z.user_id) AS users_continued, count(z.user_id)::DOUBLE / count(*) * 100 AS conversion_rate
FROM st JOIN d a ON a.event_type = from_step LEFT JOIN d z ON z.user_id = a.user_id AND z.event_type = to_step GROUP BY 1, 2""",
    "conversion_rate",
)
def _(spark, sf):
    return overview.adjacent_conversion(funnels.drop_off_analysis(b.events(spark, sf), STEPS))


@query("dsh07_second_order_histogram", f"WITH {_NTH} {hist_sql('nth', 'days_to_nth_order', 30)}", "bucket_start")
def _(spark, sf):
    return overview.histogram(cohorts.time_to_nth_order(b.events(spark, sf), 2, V), "days_to_nth_order", 30)


@query("dsh23_second_order_histogram", f"WITH {SURV} {hist_sql('t2', 'time_to_second_order_days', 30)}", "bucket_start")
def _(spark, sf):
    return overview.histogram(survival.time_to_second_order(b.events(spark, sf), V), "time_to_second_order_days", 30)


@query(
    "dsh09_order_headline",
    f"WITH {ORD} SELECT count(*) AS orders, sum(order_total) AS revenue, count(DISTINCT user_id) AS buyers, avg(order_total) AS avg_order_value FROM o",
    "revenue:3 avg_order_value",
)
def _(spark, sf):
    return overview.order_headline(b.orders(spark, sf))


@query("dsh09_top_merchants", f"WITH {ORD} SELECT merchant, count(*) AS orders FROM o GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf):
    return overview.top_counts(b.orders(spark, sf), "merchant", "orders")


@query("dsh09_top_orderers", f"WITH {ORD} SELECT user_id, count(*) AS orders FROM o GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf):
    return overview.top_counts(b.orders(spark, sf), "user_id", "orders")


@query("dsh09_value_histogram", f"WITH {ORD}, ov AS (SELECT * FROM o WHERE order_total > 0) {hist_sql('ov', 'order_total', 50)}", "bucket_start")
def _(spark, sf):
    return overview.histogram(b.orders(spark, sf).where(F.col("order_total") > 0), "order_total", 50)


@query(
    "dsh10_platform_table",
    f"""WITH {EV}, p AS (SELECT upper(platform) AS platform, count(DISTINCT user_id) FILTER (WHERE event_type = 'signup') AS users,
 count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS buyers, count(*) FILTER (WHERE event_type = 'purchase') AS orders FROM ev GROUP BY 1)
SELECT *, buyers::DOUBLE / users * 100 AS cvr, orders::DOUBLE / buyers AS opu FROM p""",
    "cvr opu",
)
def _(spark, sf):
    return overview.platform_table(b.events(spark, sf), V)


_HOURLY = f"""{EV}, hr AS (SELECT h.hour, count(*) FILTER (WHERE event_type = 'signup') AS homepage_views, count(*) FILTER (WHERE event_type = 'purchase') AS orders
 FROM range(0, 24) h(hour) LEFT JOIN ev ON hour(event_time) = h.hour GROUP BY 1),
ht AS (SELECT *, coalesce(orders::DOUBLE / NULLIF(homepage_views, 0) * 100, 0) AS cvr FROM hr)"""


@query("dsh11_hourly_table", f"WITH {_HOURLY} SELECT * FROM ht", "cvr")
def _(spark, sf):
    return overview.hourly_table(b.events(spark, sf), V)


@query(
    "dsh11_peak_hours",
    f"""WITH {_HOURLY} SELECT (SELECT hour FROM ht ORDER BY homepage_views DESC, hour LIMIT 1) AS peak_traffic_hour, (SELECT hour FROM ht ORDER BY orders DESC, hour LIMIT 1) AS peak_order_hour,
 (SELECT hour FROM ht ORDER BY cvr DESC, hour LIMIT 1) AS peak_cvr_hour""",
)
def _(spark, sf):
    return overview.peak_hours(overview.hourly_table(b.events(spark, sf), V))


@query("dsh20_tier_counts", f"WITH {REA} SELECT reactivation_tier, count(*) AS users FROM ds WHERE reactivation_tier IS NOT NULL GROUP BY 1")
def _(spark, sf):
    d = _dormant(spark, sf)
    return d.where(F.col("reactivation_tier").isNotNull()).groupBy("reactivation_tier").agg(F.count(F.lit(1)).alias("users"))


@query("dsh20_score_histogram", f"WITH {REA} {hist_sql('ds', 'reactivation_score', 20)}", "bucket_start")
def _(spark, sf):
    return overview.histogram(_dormant(spark, sf), "reactivation_score", 20)


@query("dsh22_worst_stages", f"WITH {_DROP} SELECT stage, drop_off_rate FROM sd ORDER BY drop_off_rate DESC, stage LIMIT 3", "drop_off_rate")
def _(spark, sf):
    s = journeys.stage_drop_off(_journeys(spark, sf), V)
    return s.orderBy(F.desc("drop_off_rate"), "stage").limit(3).select("stage", "drop_off_rate")


@query(
    "dsh22_top_journey_summary",
    f"""WITH {_JOURNEYS}, tj AS ({_TOP_JOURNEYS})
SELECT avg(length) AS avg_length, avg(conversion_rate) AS avg_conversion_rate, CAST(sum(occurrences) AS BIGINT) AS sessions FROM tj""",
    "avg_length avg_conversion_rate",
)
def _(spark, sf):
    return journeys.top_journeys(_journeys(spark, sf)).agg(
        F.avg("length").alias("avg_length"), F.avg("conversion_rate").alias("avg_conversion_rate"), F.sum("occurrences").alias("sessions")
    )


@query("dsh22_finite_lifts", f"WITH {_LIFT} SELECT event_type, lift FROM lf WHERE NOT isinf(lift)", "lift")
def _(spark, sf):
    return journeys.event_lift(_journeys(spark, sf)).where(F.col("lift") < float("inf")).orderBy(F.desc("lift"))



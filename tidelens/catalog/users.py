"""Per-user operators over the events table: features, cohorts, segments, scores, survival, dormancy, anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelens.catalog import bindings as b
from tidelens.catalog.bindings import EV, ORD, pct, r, sql_bins, values
from tidelens.catalog.registry import query
from tidelens.operators import anomalies, cohorts, features, reactivation, scoring, segments, survival

V = b.VOCAB
DAY = "86400000000.0::DOUBLE"


def _ev(spark, sf):
    return b.events(spark, sf)


def cnt(t: str) -> str:
    return f"count(*) FILTER (WHERE event_type = '{t}')"


# --- features ---------------------------------------------------------------------------------

TYPES = ("signup", "view", "click", "purchase", "error")
_COUNTS = ", ".join(f"{cnt(t)} AS count_{t}" for t in TYPES)
_STAGE = "list_position(['signup', 'view', 'click', 'purchase'], event_type) - 1"
_REF = "(SELECT max(us) FROM ev)"


@query("fea03_event_counts", f"WITH {EV} SELECT user_id, count(*) AS total_events, {_COUNTS} FROM ev GROUP BY 1")
def _(spark, sf):
    return features.user_event_counts(_ev(spark, sf), V.event_types)


_RECENCY = f"""({_REF} - min(us)) / {DAY} AS days_since_first_event, ({_REF} - max(us)) / {DAY} AS days_since_last_event,
 ({_REF} - max(us) FILTER (WHERE event_type = 'purchase')) / {DAY} AS days_since_last_order"""


@query("fea04_recency", f"WITH {EV} SELECT user_id, {_RECENCY} FROM ev GROUP BY 1")
def _(spark, sf):
    return features.user_recency(_ev(spark, sf), V)


@query(
    "fea05_order_features",
    f"""WITH {EV} SELECT user_id, count(*) AS total_orders, sum(order_total) AS total_revenue, avg(order_total) AS avg_order_value,
 max(order_total) AS max_order_value, 0.0::DOUBLE AS total_products, 0.0::DOUBLE AS avg_products_per_order, 0::BIGINT AS promo_orders,
 0::BIGINT AS group_orders, 0::BIGINT AS multi_cart_orders, 0::BIGINT AS unique_merchants, 0.0::DOUBLE AS pct_promo_orders,
 0.0::DOUBLE AS pct_group_orders FROM ev WHERE event_type = 'purchase' GROUP BY 1""",
    "total_revenue:3 avg_order_value",
)
def _(spark, sf):
    return features.user_order_features(_ev(spark, sf), V)


@query(
    "fea06_behaviour",
    f"""WITH {EV} SELECT user_id, {cnt('view')} AS total_searches, {cnt('view')} AS total_product_views, {cnt('click')} AS total_products_added,
 {cnt('error')} AS total_cart_views, {cnt('signup')} AS total_sessions, count(DISTINCT event_time::DATE) AS days_active FROM ev GROUP BY 1""",
)
def _(spark, sf):
    return features.user_behaviour(_ev(spark, sf), V)


@query(
    "fea07_platform",
    f"""WITH {EV} SELECT user_id, mode(platform ORDER BY platform) AS primary_platform,
 count(*) FILTER (WHERE platform = 'ios')::DOUBLE / count(*) AS pct_ios FROM ev GROUP BY 1""",
)
def _(spark, sf):
    return features.user_platform(_ev(spark, sf))


@query(
    "fea08_funnel",
    f"""WITH {EV} SELECT user_id, max({_STAGE})::BIGINT AS max_funnel_stage, avg({_STAGE}) AS avg_funnel_stage,
 coalesce({cnt('purchase')}::DOUBLE / NULLIF({cnt('signup')}, 0), 0) AS user_conversion_rate
FROM ev WHERE event_type <> 'error' GROUP BY 1""",
    "avg_funnel_stage user_conversion_rate",
)
def _(spark, sf):
    return features.user_funnel(_ev(spark, sf), V)


_FEATURES = f"""SELECT user_id, count(*) AS total_events, {_COUNTS},
 ({_REF} - min(us)) / {DAY} AS days_since_first_event, ({_REF} - max(us)) / {DAY} AS days_since_last_event,
 coalesce(({_REF} - max(us) FILTER (WHERE event_type = 'purchase')) / {DAY}, 0) AS days_since_last_order,
 {cnt('purchase')} AS total_orders, coalesce(sum(order_total) FILTER (WHERE event_type = 'purchase'), 0) AS total_revenue,
 coalesce(avg(order_total) FILTER (WHERE event_type = 'purchase'), 0) AS avg_order_value,
 coalesce(max(order_total) FILTER (WHERE event_type = 'purchase'), 0) AS max_order_value,
 0.0::DOUBLE AS total_products, 0.0::DOUBLE AS avg_products_per_order, 0::BIGINT AS promo_orders, 0::BIGINT AS group_orders,
 0::BIGINT AS multi_cart_orders, 0::BIGINT AS unique_merchants, 0.0::DOUBLE AS pct_promo_orders, 0.0::DOUBLE AS pct_group_orders,
 {cnt('view')} AS total_searches, {cnt('view')} AS total_product_views, {cnt('click')} AS total_products_added,
 {cnt('error')} AS total_cart_views, {cnt('signup')} AS total_sessions, count(DISTINCT event_time::DATE) AS days_active,
 mode(platform ORDER BY platform) AS primary_platform, count(*) FILTER (WHERE platform = 'ios')::DOUBLE / count(*) AS pct_ios,
 coalesce(max({_STAGE}) FILTER (WHERE event_type <> 'error'), 0)::BIGINT AS max_funnel_stage,
 coalesce(avg({_STAGE}) FILTER (WHERE event_type <> 'error'), 0) AS avg_funnel_stage,
 coalesce({cnt('purchase')}::DOUBLE / NULLIF({cnt('signup')}, 0), 0) AS user_conversion_rate FROM ev GROUP BY 1"""


@query("fea01_user_features", f"WITH {EV} {_FEATURES}", "total_revenue:3 avg_order_value avg_funnel_stage user_conversion_rate")
def _(spark, sf):
    return features.build_user_features(_ev(spark, sf), V)


_SUMMARY_COLS = ("total_events", "total_orders", "total_revenue", "days_active")
_SUMMARY = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min,
 quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS p50, quantile_cont({c}::DOUBLE, 0.75) AS p75, max({c})::DOUBLE AS max FROM uf"""
    for c in _SUMMARY_COLS
)


@query("fea10_feature_summary", f"WITH {EV}, uf AS ({_FEATURES}) {_SUMMARY}", "mean std min p25 p50 p75 max")
def _(spark, sf):
    f = features.build_user_features(_ev(spark, sf), V).select("user_id", *_SUMMARY_COLS)
    return features.feature_summary(f)


_QCUT = " + ".join(f"CASE WHEN {{x}} > 1 + (n - 1) * {q}::DOUBLE THEN 1 ELSE 0 END" for q in (0.2, 0.4, 0.6, 0.8))
RFM = f"""{EV},
rb AS (SELECT user_id, ({_REF} - max(us)) / {DAY} AS recency, count(*) AS frequency, round(sum(order_total), 6) AS monetary
       FROM ev WHERE event_type = 'purchase' GROUP BY 1),
rq AS (SELECT quantile_cont(recency, [0.2, 0.4, 0.6, 0.8]) AS q, count(*) AS n FROM rb),
rk AS (SELECT rb.*, n, q, row_number() OVER (ORDER BY frequency, user_id) AS fr, row_number() OVER (ORDER BY monetary, user_id) AS mr
       FROM rb CROSS JOIN rq),
rs AS (SELECT user_id, recency, frequency, monetary,
              (5 - (q[1] < recency)::INT - (q[2] < recency)::INT - (q[3] < recency)::INT - (q[4] < recency)::INT)::BIGINT AS R_score,
              (1 + {_QCUT.format(x='fr')})::BIGINT AS F_score, (1 + {_QCUT.format(x='mr')})::BIGINT AS M_score FROM rk),
rfm AS (SELECT *, R_score * 100 + F_score * 10 + M_score AS RFM_score,
               CASE WHEN R_score >= 4 AND F_score >= 4 THEN 'Champions' WHEN R_score >= 3 AND F_score >= 3 THEN 'Loyal'
                    WHEN R_score >= 4 THEN 'Recent' WHEN F_score >= 4 THEN 'Frequent'
                    WHEN R_score <= 2 AND F_score <= 2 THEN 'At Risk' ELSE 'Regular' END AS RFM_segment FROM rs)"""


@query("fea09_rfm", f"WITH {RFM} SELECT * FROM rfm", "monetary:3")
def _(spark, sf):
    return features.rfm(_ev(spark, sf), V)


@query(
    "src35_rfm_profile",
    f"""WITH {RFM} SELECT RFM_segment AS segment, count(*) AS users, {r('avg(recency)', 2)} AS avg_recency,
 {r('avg(frequency)', 2)} AS avg_frequency, {r('avg(monetary)', 2)} AS avg_monetary,
 count(*)::DOUBLE / (SELECT count(*) FROM rfm) * 100 AS pct_of_users FROM rfm GROUP BY 1""",
    "pct_of_users",
)
def _(spark, sf):
    return features.rfm_profile(features.rfm(_ev(spark, sf), V))


@query(
    "src36_churn_rule",
    f"""WITH {EV}, u AS (SELECT user_id, {_RECENCY} FROM ev GROUP BY 1)
SELECT user_id, days_since_last_order, CASE WHEN days_since_last_order IS NULL THEN 'No Orders' WHEN days_since_last_order > 4 THEN 'High'
 WHEN days_since_last_order > 2 THEN 'Medium' ELSE 'Low' END AS churn_risk FROM u""",
)
def _(spark, sf):
    return features.churn_rule(_ev(spark, sf), V, 4)


# --- cohorts ----------------------------------------------------------------------------------

_WEEK = """SELECT user_id, min(event_time) AS first_order_time,
 strftime(date_trunc('week', min(event_time)), '%Y-%m-%d') || '/' || strftime(date_trunc('week', min(event_time)) + INTERVAL 6 DAY, '%Y-%m-%d') AS cohort,
 date_trunc('week', min(event_time))::TIMESTAMP AS cohort_date FROM ev WHERE event_type = '{t}' GROUP BY 1"""
_FO = "first_order AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM ev WHERE event_type = 'purchase')"


@query("coh02_first_order_week", f"WITH {EV} " + _WEEK.format(t="purchase"))
def _(spark, sf):
    return cohorts.build_cohorts(_ev(spark, sf), "first_order_week", V)


@query(
    "coh03_first_order_month",
    f"""WITH {EV} SELECT user_id, min(event_time) AS first_order_time, strftime(min(event_time), '%Y-%m') AS cohort,
 date_trunc('month', min(event_time))::TIMESTAMP AS cohort_date FROM ev WHERE event_type = 'purchase' GROUP BY 1""",
)
def _(spark, sf):
    return cohorts.build_cohorts(_ev(spark, sf), "first_order_month", V)


@query("coh04_first_visit_week", f"WITH {EV} " + _WEEK.format(t="signup"))
def _(spark, sf):
    return cohorts.build_cohorts(_ev(spark, sf), "first_visit_week", V)


@query(
    "coh05_platform",
    f"""WITH {EV} SELECT user_id, min(event_time) AS first_order_time, upper(first(platform ORDER BY us, event_id)) AS cohort,
 min(event_time) AS cohort_date FROM ev GROUP BY 1""",
)
def _(spark, sf):
    return cohorts.build_cohorts(_ev(spark, sf), "platform", V)


@query(
    "coh06_first_aov_tier",
    f"""WITH {EV}, {_FO} SELECT user_id, event_time AS first_order_time, CASE WHEN order_total <= 0 THEN 'Unknown' WHEN order_total < 50 THEN 'Low (<50)'
 WHEN order_total < 100 THEN 'Medium (50-100)' ELSE 'High (>100)' END AS cohort, event_time AS cohort_date FROM first_order WHERE k = 1""",
)
def _(spark, sf):
    return cohorts.build_cohorts(_ev(spark, sf), "first_aov_tier", V)


@query(
    "coh07_first_order_type",
    f"""WITH {EV}, {_FO} SELECT user_id, event_time AS first_order_time,
 CASE WHEN json_extract_string(props, '$.k')::INT % 2 = 0 THEN 'Delivery' ELSE 'Take Away' END AS cohort, event_time AS cohort_date FROM first_order WHERE k = 1""",
)
def _(spark, sf):
    k = F.get_json_object("event_properties", "$.k").cast("int")
    e = _ev(spark, sf).withColumn("order_type", F.when(k % 2 == 0, "delivery").otherwise("take away"))
    return cohorts.build_cohorts(e, "first_order_type", V)


_COH = f"""{EV}, co AS ({_WEEK.format(t='signup')}),
sz AS (SELECT cohort, count(DISTINCT user_id) AS cohort_size FROM co GROUP BY 1),
od AS (SELECT ev.user_id, cohort, order_total, CAST(greatest(floor(floor((us - epoch_us(cohort_date)) / {DAY}) / {{n}}), 0) AS BIGINT) AS period
       FROM ev JOIN co USING (user_id) WHERE event_type = 'purchase'),
gr AS (SELECT cohort, cohort_size, period FROM sz CROSS JOIN range(0, 13) t(period)),
rt AS (SELECT cohort, period, cohort_size, count(DISTINCT user_id) AS active_users
       FROM gr LEFT JOIN od USING (cohort, period) GROUP BY 1, 2, 3)"""


def _cohorts(spark, sf):
    return cohorts.build_cohorts(_ev(spark, sf), "first_visit_week", V)


@query(
    "coh08_retention_long",
    f"WITH {_COH.format(n=7)} SELECT cohort, period, cohort_size, active_users, active_users::DOUBLE / cohort_size * 100 AS retention_rate FROM rt",
    "retention_rate",
)
def _(spark, sf):
    return cohorts.retention_long(_ev(spark, sf), _cohorts(spark, sf), "week", 12, V)


_HEAT = ", ".join(f"max(CASE WHEN period = {k} THEN active_users::DOUBLE / cohort_size * 100 END) AS p{k}" for k in range(13))


@query("coh08_retention", f"WITH {_COH.format(n=7)} SELECT cohort, {_HEAT} FROM rt GROUP BY 1", " ".join(f"p{k}" for k in range(13)))
def _(spark, sf):
    return cohorts.retention(_ev(spark, sf), _cohorts(spark, sf), "week", 12, V)


@query(
    "coh08_retention_month",
    f"WITH {_COH.format(n=30)} SELECT cohort, period, cohort_size, active_users, active_users::DOUBLE / cohort_size * 100 AS retention_rate FROM rt",
    "retention_rate",
)
def _(spark, sf):
    return cohorts.retention_long(_ev(spark, sf), _cohorts(spark, sf), "month", 12, V)


@query(
    "coh09_cumulative_ltv",
    f"""WITH {_COH.format(n=7)}, rv AS (SELECT cohort, period, cohort_size, coalesce(sum(order_total), 0) AS rev FROM gr LEFT JOIN od USING (cohort, period) GROUP BY 1, 2, 3)
SELECT cohort, period AS week, sum(rev) OVER w AS cumulative_revenue, sum(rev) OVER w / cohort_size AS cumulative_ltv
FROM rv WINDOW w AS (PARTITION BY cohort ORDER BY period ROWS UNBOUNDED PRECEDING)""",
    "cumulative_revenue:3 cumulative_ltv",
)
def _(spark, sf):
    return cohorts.cumulative_ltv(_ev(spark, sf), _cohorts(spark, sf), 12, V)


_NTH = f"""{EV}, {_FO}, nth AS (SELECT user_id, min(event_time) FILTER (WHERE k = 1) AS first_order_time, min(event_time) FILTER (WHERE k = 2) AS nth_order_time,
 (min(us) FILTER (WHERE k = 2) - min(us) FILTER (WHERE k = 1)) / {DAY} AS days_to_nth_order FROM first_order GROUP BY 1 HAVING count(*) >= 2)"""


@query("coh10_time_to_second_order", f"WITH {_NTH} SELECT * FROM nth")
def _(spark, sf):
    return cohorts.time_to_nth_order(_ev(spark, sf), 2, V)


@query(
    "dsh07_second_order_stats",
    f"""WITH {_NTH} SELECT count(*) AS users, avg(days_to_nth_order) AS mean_days, quantile_cont(days_to_nth_order, 0.5) AS median_days,
 quantile_cont(days_to_nth_order, 0.75) AS p75_days FROM nth""",
    "mean_days median_days p75_days",
)
def _(spark, sf):
    return cohorts.nth_order_stats(cohorts.time_to_nth_order(_ev(spark, sf), 2, V))


@query(
    "coh11_order_frequency",
    f"""WITH {_COH.format(n=7)} SELECT cohort, period AS week, count(DISTINCT user_id) AS active_users, count(*) AS orders,
 count(*)::DOUBLE / count(DISTINCT user_id) AS orders_per_user FROM od GROUP BY 1, 2""",
    "orders_per_user",
)
def _(spark, sf):
    return cohorts.order_frequency(_ev(spark, sf), _cohorts(spark, sf), V)


@query(
    "coh12_summary",
    f"""WITH {_COH.format(n=7)} SELECT cohort, count(DISTINCT user_id) AS users, count(*) AS orders, sum(order_total) AS total_revenue,
 avg(order_total) AS avg_order_value, count(*)::DOUBLE / count(DISTINCT user_id) AS orders_per_user,
 sum(order_total) / count(DISTINCT user_id) AS ltv FROM od GROUP BY 1""",
    "total_revenue:3 avg_order_value orders_per_user ltv",
)
def _(spark, sf):
    return cohorts.cohort_summary(_ev(spark, sf), _cohorts(spark, sf), V)


# --- segments ---------------------------------------------------------------------------------

_PROFILE = f"""{EV}, pf AS (SELECT user_id, {_COUNTS}, bool_or(platform = 'ios') AS ios, max(us) AS last_us,
 min(event_time) FILTER (WHERE event_type = 'purchase') AS first_order FROM ev GROUP BY 1)"""
_CUT = "(SELECT max(us) FROM ev) - {n} * 86400000000"


def segment(name: str, where: str, build):
    @query(name, f"WITH {_PROFILE} SELECT user_id FROM pf WHERE {where}")
    def _(spark, sf):
        return build(segments.Segment(_ev(spark, sf), V)).users()


segment("seg01_all_users", "TRUE", lambda s: s)
segment("seg02_did_event", "count_click > 0", lambda s: s.did_event("click"))
segment("seg03_did_not_event", "count_click = 0", lambda s: s.did_not_event("click"))
segment("seg04_event_count", "count_click BETWEEN 1 AND 12", lambda s: s.event_count("click", "lte", 12))
segment("seg05_ordered_exactly", "count_purchase = 12", lambda s: s.ordered_exactly(12))
segment("seg06_ordered_at_least", "count_purchase >= 15", lambda s: s.ordered_at_least(15))
segment("seg07_ordered_less_than", "count_purchase < 12", lambda s: s.ordered_less_than(12))
segment("seg08_never_ordered", "count_purchase = 0", lambda s: s.never_ordered())
segment("seg09_platform", "ios", lambda s: s.on_platform("iOS"))
segment("seg10_active_in_last_days", "last_us >= " + _CUT.format(n=1), lambda s: s.active_in_last_days(1))
segment("seg11_inactive_for_days", "last_us < " + _CUT.format(n=1), lambda s: s.inactive_for_days(1))
segment(
    "seg12_first_order_between",
    "first_order BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-04'",
    lambda s: s.first_order_between("2024-01-02", "2024-01-04"),
)
segment("seg19_cart_abandoners", "count_click > 0 AND count_purchase = 0", lambda s: segments.cart_abandoners(s.events, s.vocab))
segment("seg20_one_time_buyers", "count_purchase = 1", lambda s: segments.one_time_buyers(s.events, s.vocab))
segment("seg21_repeat_buyers", "count_purchase >= 2", lambda s: segments.repeat_buyers(s.events, s.vocab))
segment("seg22_power_users", "count_purchase >= 5", lambda s: segments.power_users(s.events, s.vocab))
segment("seg23_browsers_not_buyers", "count_view > 0 AND count_purchase = 0", lambda s: segments.browsers_not_buyers(s.events, s.vocab))
segment(
    "seg24_lapsed_customers",
    "count_purchase > 0 AND last_us < " + _CUT.format(n=1),
    lambda s: segments.lapsed_customers(s.events, s.vocab, 1),
)
segment("seg26_engaged_non_converters", "count_signup >= 3 AND count_purchase = 0", lambda s: segments.engaged_non_converters(s.events, s.vocab))
segment("seg27_ios_power_users", "ios AND count_purchase >= 3", lambda s: segments.ios_power_users(s.events, s.vocab))
segment(
    "seg16_combined_users",
    "count_click > 0 AND count_purchase >= 10 AND ios AND last_us >= " + _CUT.format(n=3),
    lambda s: s.did_event("click").ordered_at_least(10).on_platform("ios").active_in_last_days(3),
)


@query("seg17_describe", f"WITH {_PROFILE} SELECT count(*) AS users, 'did click AND purchase gte 10' AS filters FROM pf WHERE count_click > 0 AND count_purchase >= 10")
def _(spark, sf):
    return segments.Segment(_ev(spark, sf), V).did_event("click").ordered_at_least(10).describe()


@query("seg15_count", f"WITH {_PROFILE} SELECT count(*) AS users FROM pf WHERE count_purchase >= 10")
def _(spark, sf):
    return segments.Segment(_ev(spark, sf), V).ordered_at_least(10).count()


@query("seg18_reset", f"WITH {_PROFILE} SELECT count(*) AS users FROM pf")
def _(spark, sf):
    return segments.Segment(_ev(spark, sf), V).ordered_at_least(10).reset().count()


# Stored scores stand in for model output: acceptance of any score table is what is tested.
@query(
    "seg13_with_churn_risk",
    f"WITH {_PROFILE} SELECT user_id FROM pf WHERE count_click > 0 AND (user_id % 10) / 10.0::DOUBLE >= 0.7",
)
def _(spark, sf):
    scores = b.table(spark, sf, "events").select("user_id", ((F.col("user_id") % 10) / 10.0).alias("churn_probability")).distinct()
    return segments.Segment(_ev(spark, sf), V).did_event("click").with_churn_risk(scores, 0.7).users()


_TIER = "CASE WHEN user_id % 4 = 0 THEN 'Diamond' ELSE 'Gold' END"


@query("seg14_with_ltv_tier", f"WITH {_PROFILE} SELECT user_id FROM pf WHERE {_TIER} = 'Diamond'")
def _(spark, sf):
    tiers = b.table(spark, sf, "events").select("user_id").distinct().withColumn("ltv_tier", F.when(F.col("user_id") % 4 == 0, "Diamond").otherwise("Gold"))
    return segments.Segment(_ev(spark, sf), V).with_ltv_tier(tiers, "Diamond").users()


@query("seg25_high_value_at_risk", f"WITH {_PROFILE} SELECT user_id FROM pf WHERE {_TIER} = 'Diamond' AND (user_id % 10) / 10.0::DOUBLE >= 0.6")
def _(spark, sf):
    u = b.table(spark, sf, "events").select("user_id").distinct()
    tiers = u.withColumn("ltv_tier", F.when(F.col("user_id") % 4 == 0, "Diamond").otherwise("Gold"))
    churn = u.withColumn("churn_probability", (F.col("user_id") % 10) / 10.0)
    return segments.high_value_at_risk(_ev(spark, sf), tiers, churn, V).users()


_SIZES = {
    "cart_abandoners": "count_click > 0 AND count_purchase = 0",
    "one_time_buyers": "count_purchase = 1",
    "repeat_buyers": "count_purchase >= 2",
    "power_users": "count_purchase >= 5",
    "browsers_not_buyers": "count_view > 0 AND count_purchase = 0",
    "lapsed_customers": "count_purchase > 0 AND last_us < " + _CUT.format(n=1),
    "engaged_non_converters": "count_signup >= 3 AND count_purchase = 0",
    "ios_power_users": "ios AND count_purchase >= 3",
}


@query(
    "dsh08_predefined_sizes",
    f"WITH {_PROFILE} " + " UNION ALL ".join(f"SELECT '{n}' AS segment, count(*) AS users FROM pf WHERE {w}" for n, w in _SIZES.items()),
)
def _(spark, sf):
    return segments.predefined_sizes(_ev(spark, sf), V, 1)


# --- scoring ----------------------------------------------------------------------------------

_CLIP = "greatest(least({x}, 100.0::DOUBLE), 0.0::DOUBLE)"


def clip(x: str) -> str:
    return _CLIP.format(x=x)


SCORE = f"""{EV},
er AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
cp AS (SELECT user_id, min(event_time) AS first_seen, max(event_time) AS last_seen, count(*) AS total_events,
  CAST(floor(({_REF} - max(us)) / {DAY}) AS BIGINT) AS days_since_last, CAST(floor(({_REF} - min(us)) / {DAY}) AS BIGINT) AS days_since_first,
  CAST(floor((max(us) - min(us)) / {DAY}) AS BIGINT) + 1 AS active_days, {cnt('purchase')} AS order_count, {cnt('view')} AS product_view_count,
  {cnt('click')} AS add_count, {cnt('view')} AS search_count, {cnt('error')} AS merchant_view_count,
  CASE WHEN {cnt('signup')} > 0 THEN {cnt('signup')} ELSE 1 END AS sessions,
  max(coalesce(list_position(['signup', 'view', 'click', 'purchase'], event_type), 0))::BIGINT AS max_funnel_stage,
  mode(platform ORDER BY platform) AS platform,
  count(*) FILTER (WHERE rn <= n // 2 AND event_type IN ('click', 'purchase')) AS first_hits,
  count(*) FILTER (WHERE rn > n // 2 AND event_type IN ('click', 'purchase')) AS second_hits FROM er GROUP BY 1),
s1 AS (SELECT *, {clip('100 - days_since_last * 100 / 30.0::DOUBLE')} AS recency_score,
  {clip('sessions::DOUBLE / greatest(active_days, 1) * 50')} AS frequency_score, max_funnel_stage / 6.0::DOUBLE * 100 AS depth_score,
  ((product_view_count > 0)::INT + (add_count > 0)::INT + (search_count > 0)::INT + (merchant_view_count > 0)::INT) / 4.0::DOUBLE * 100 AS breadth_score FROM cp),
s2 AS (SELECT *, {r('recency_score * 0.25 + frequency_score * 0.25 + depth_score * 0.25 + breadth_score * 0.25', 1)} AS engagement_score,
  {clip('(order_count * 15 + (40 - days_since_last))::DOUBLE')} AS purchase_score, {clip('ln(1 + days_since_first) * 20')} AS lifecycle_score,
  CASE WHEN total_events < 4 THEN 50.0::DOUBLE WHEN first_hits = 0 AND second_hits > 0 THEN 70.0 WHEN first_hits = 0 THEN 50.0
       ELSE {clip('50 + (second_hits::DOUBLE / first_hits - 1) * 30')} END AS trajectory_score FROM s1),
s3 AS (SELECT *, {r('engagement_score * 0.30 + purchase_score * 0.30 + lifecycle_score * 0.20 + trajectory_score * 0.20', 1)} AS health_score,
  CASE WHEN days_since_first <= 7 AND order_count = 0 AND max_funnel_stage >= 3 THEN 'New - High Intent'
       WHEN days_since_first <= 7 AND order_count = 0 THEN 'New - Exploring'
       WHEN order_count = 1 AND days_since_last <= 7 THEN 'First Purchase - Recent' WHEN order_count = 1 AND days_since_last <= 30 THEN 'First Purchase - Waiting'
       WHEN order_count = 1 THEN 'First Purchase - At Risk' WHEN order_count >= 2 AND days_since_last <= 14 THEN 'Repeat - Active'
       WHEN order_count >= 2 AND days_since_last <= 30 THEN 'Repeat - Cooling' WHEN order_count >= 2 THEN 'Repeat - Lapsed'
       WHEN days_since_last <= 7 THEN 'Browser - Recent' WHEN days_since_last <= 30 THEN 'Browser - Inactive' ELSE 'Browser - Lost' END AS lifecycle_stage FROM s2),
sc AS (SELECT s3.*, {sql_bins('engagement_score', scoring.TIER_EDGES, scoring.ENGAGEMENT_TIERS)} AS engagement_tier,
  {sql_bins('health_score', scoring.TIER_EDGES, scoring.HEALTH_TIERS)} AS health_tier, CAST(lifecycle_value AS BIGINT) AS lifecycle_value
  FROM s3 JOIN (VALUES {", ".join(f"('{a}', {v})" for a, v in scoring.STAGE_VALUES)}) sv(lifecycle_stage, lifecycle_value) USING (lifecycle_stage))"""


def _q(text: str) -> str:
    return text.replace("'", "''")


_RULES = ", ".join("(" + ", ".join(f"'{_q(x)}'" for x in row) + ")" for row in scoring.ACTIONS)
_NAMES = ("action", "channel", "message", "priority", "expected_impact")
ACT = f"""{SCORE}, ac AS (SELECT sc.*, {", ".join(f"coalesce(rl.{n}, '{_q(d)}') AS {n}" for n, d in zip(_NAMES, scoring.DEFAULT_ACTION))}
 FROM sc LEFT JOIN (VALUES {_RULES}) rl(lifecycle_stage, {", ".join(_NAMES)}) USING (lifecycle_stage))"""


def _scored(spark, sf):
    return scoring.scored_profiles(scoring.customer_profiles(_ev(spark, sf), V))


@query("sco01_profiles", f"WITH {SCORE} SELECT * FROM cp")
def _(spark, sf):
    return scoring.customer_profiles(_ev(spark, sf), V)


@query(
    "sco02_engagement",
    f"WITH {SCORE} SELECT user_id, engagement_score, engagement_tier, recency_score, frequency_score, depth_score, breadth_score FROM sc",
    "recency_score frequency_score depth_score breadth_score",
)
def _(spark, sf):
    return scoring.engagement_scores(_scored(spark, sf))


_HEALTH = "user_id, health_score, health_tier, engagement_score, purchase_score, lifecycle_score, trajectory_score, order_count, days_since_last"


@query("sco03_health", f"WITH {SCORE} SELECT {_HEALTH} FROM sc", "lifecycle_score trajectory_score")
def _(spark, sf):
    return scoring.health_scores(_scored(spark, sf))


@query("sco04_lifecycle", f"WITH {SCORE} SELECT user_id, lifecycle_stage, lifecycle_value, order_count, days_since_first, days_since_last FROM sc")
def _(spark, sf):
    return scoring.lifecycle_stages(_scored(spark, sf))


@query(
    "sco05_next_best_action",
    f"WITH {ACT} SELECT user_id, lifecycle_stage, health_tier, health_score, action, channel, message, priority, expected_impact FROM ac",
)
def _(spark, sf):
    return scoring.next_best_action(_scored(spark, sf))


@query(
    "sco06_segment_summary",
    f"""WITH {SCORE} SELECT lifecycle_stage, count(*) AS users, first(lifecycle_value) AS stage_value, avg(health_score) AS avg_health_score,
 avg(order_count) AS avg_orders, avg(days_since_last) AS avg_days_inactive, {pct('count(*)', '(SELECT count(*) FROM sc)', 1)} AS pct_of_users FROM sc GROUP BY 1""",
    "avg_health_score avg_orders avg_days_inactive",
)
def _(spark, sf):
    return scoring.segment_summary(_scored(spark, sf))


@query(
    "sco07_high_value_at_risk",
    f"""WITH {SCORE} SELECT user_id, lifecycle_stage, health_score, health_tier, order_count, days_since_last FROM sc
WHERE order_count >= 2 AND health_tier IN ('At Risk', 'Critical') ORDER BY order_count DESC, user_id LIMIT 100""",
)
def _(spark, sf):
    return scoring.high_value_at_risk(_scored(spark, sf), 100)


@query(
    "sco08_conversion_opportunities",
    f"""WITH {SCORE} SELECT user_id, lifecycle_stage, engagement_score, engagement_tier, depth_score, recency_score FROM sc
WHERE order_count = 0 AND engagement_tier IN ('Medium', 'High') ORDER BY engagement_score DESC, user_id LIMIT 100""",
)
def _(spark, sf):
    return scoring.conversion_opportunities(_scored(spark, sf), 100)


@query(
    "sco09_summary",
    f"""WITH {SCORE} SELECT count(*) AS total_customers, count(*) FILTER (WHERE order_count > 0) AS with_orders, {r('avg(health_score)', 1)} AS avg_health_score,
 count(*) FILTER (WHERE health_tier = 'Champion') AS champions, count(*) FILTER (WHERE health_tier IN ('At Risk', 'Critical')) AS at_risk,
 count(*) FILTER (WHERE lifecycle_stage = 'Repeat - Active') AS active_repeaters, count(*) FILTER (WHERE lifecycle_stage = 'Repeat - Lapsed') AS lapsed_repeaters FROM sc""",
)
def _(spark, sf):
    return scoring.scoring_summary(_scored(spark, sf))


@query(
    "sco10_crm_export",
    f"WITH {ACT} SELECT {_HEALTH}, lifecycle_stage, lifecycle_value, action, channel, priority, platform, first_seen, last_seen FROM ac",
    "lifecycle_score trajectory_score",
)
def _(spark, sf):
    return scoring.crm_export(_scored(spark, sf))


@query("dsh19_tier_counts", f"WITH {SCORE} SELECT health_tier, count(*) AS users FROM sc WHERE health_tier IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return scoring.tier_counts(_scored(spark, sf))


@query("dsh19_action_counts", f"WITH {ACT} SELECT action, priority, count(*) AS users FROM ac GROUP BY 1, 2")
def _(spark, sf):
    return scoring.action_counts(_scored(spark, sf))


# --- survival ---------------------------------------------------------------------------------

CHURN = 2  # days without an order, fitting a 30-day table of very active users
SURV = f"""{EV},
uo AS (SELECT user_id, min(event_time) AS first_order, max(event_time) AS last_order, count(*) AS total_orders,
  CAST(floor(({_REF} - max(us)) / {DAY}) AS BIGINT) AS days_since_last, CAST(floor((max(us) - min(us)) / {DAY}) AS BIGINT) AS lifetime_days
  FROM ev WHERE event_type = 'purchase' GROUP BY 1),
cd AS (SELECT *, days_since_last >= {CHURN} AS churned, CASE WHEN days_since_last >= {CHURN} THEN lifetime_days + {CHURN} ELSE days_since_last END AS survival_time FROM uo),
{_FO},
t2 AS (SELECT user_id, min(event_time) FILTER (WHERE k = 1) AS first_order_time, min(event_time) FILTER (WHERE k = 2) AS second_order_time,
  CAST(floor((coalesce(min(us) FILTER (WHERE k = 2), {_REF}) - min(us)) / {DAY}) AS BIGINT) AS time_to_second_order_days,
  count(*) >= 2 AS has_second_order FROM first_order GROUP BY 1)"""


def km(source: str, time: str, hit: str) -> str:
    return f"""kt AS (SELECT {time} AS time, count(*) FILTER (WHERE {hit}) AS events, count(*) FILTER (WHERE NOT {hit}) AS censored FROM {source} WHERE {time} > 0 GROUP BY 1),
kn AS (SELECT *, CAST(sum(events + censored) OVER (ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_at_risk FROM kt),
kp AS (SELECT *, product(1 - events::DOUBLE / n_at_risk) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS survival_probability FROM kn),
kc AS (SELECT time, n_at_risk, events, censored, survival_probability,
       CASE WHEN survival_probability > 0 THEN -ln(survival_probability) ELSE 'inf'::DOUBLE END AS cumulative_hazard FROM kp)"""


@query("sur01_user_orders", f"WITH {SURV} SELECT * FROM uo")
def _(spark, sf):
    return survival.user_orders(_ev(spark, sf), V)


@query("sur02_time_to_second_order", f"WITH {SURV} SELECT * FROM t2")
def _(spark, sf):
    return survival.time_to_second_order(_ev(spark, sf), V)


@query("sur03_kaplan_meier", f"WITH {SURV}, {km('cd', 'survival_time', 'churned')} SELECT * FROM kc", "survival_probability cumulative_hazard")
def _(spark, sf):
    return survival.kaplan_meier(_ev(spark, sf), "churn", V, CHURN)


@query(
    "sur03_kaplan_meier_second_order",
    f"WITH {SURV}, {km('t2', 'time_to_second_order_days', 'has_second_order')} SELECT * EXCLUDE (cumulative_hazard) FROM kc",
    "survival_probability",
)
def _(spark, sf):
    return survival.kaplan_meier(_ev(spark, sf), "second_order", V).drop("cumulative_hazard")


@query("sur04_churn_data", f"WITH {SURV} SELECT * FROM cd")
def _(spark, sf):
    return survival.churn_data(_ev(spark, sf), V, CHURN)


_SINCE = f"""{EV}, fo AS (SELECT user_id, min(us) AS f FROM ev WHERE event_type = 'purchase' GROUP BY 1),
sd AS (SELECT user_id, CAST(floor((us - f) / {DAY}) AS BIGINT) AS d FROM ev JOIN fo USING (user_id) WHERE event_type = 'purchase')"""


@query(
    "sur05_hazard_by_week",
    f"""WITH {_SINCE}, pr AS (SELECT DISTINCT d // 7 AS period FROM sd), ua AS (SELECT user_id, min(d // 7) AS lo, max(d // 7) AS hi FROM sd GROUP BY 1),
hz AS (SELECT period, count(*) FILTER (WHERE lo <= period) AS s, count(*) FILTER (WHERE hi >= period) AS rm FROM pr CROSS JOIN ua GROUP BY 1)
SELECT period, 'Week ' || period AS period_label, s AS users_at_start, rm AS users_remaining, CASE WHEN period > 0 THEN s - rm ELSE 0 END AS churned,
 CASE WHEN period > 0 THEN (s - rm)::DOUBLE / s ELSE 0 END AS hazard_rate, 1 - CASE WHEN period > 0 THEN (s - rm)::DOUBLE / s ELSE 0 END AS retention_rate FROM hz""",
    "hazard_rate retention_rate",
)
def _(spark, sf):
    return survival.hazard_by_period(_ev(spark, sf), "week", V)


_COHORT_SURV = f"""{_SINCE}, uc AS (SELECT user_id, CAST(week(make_timestamp(min(f))) AS BIGINT) AS cohort, max(d // 7) AS hi FROM sd JOIN fo USING (user_id) GROUP BY 1),
c8 AS (SELECT cohort, count(*) AS initial_users FROM uc GROUP BY 1 ORDER BY 1 LIMIT 8),
cs AS (SELECT c8.cohort, 'Week ' || c8.cohort AS cohort_label, w.week, initial_users, count(*) FILTER (WHERE hi >= w.week) AS active_users
  FROM c8 CROSS JOIN range(0, 13) w(week) JOIN uc ON uc.cohort = c8.cohort GROUP BY 1, 2, 3, 4)"""


@query("sur06_cohort_survival", f"WITH {_COHORT_SURV} SELECT *, active_users::DOUBLE / initial_users AS survival_rate FROM cs", "survival_rate")
def _(spark, sf):
    return survival.cohort_survival(_ev(spark, sf), "week", V)


_W = ", ".join(f"max(CASE WHEN week = {w} THEN active_users::DOUBLE / initial_users END) AS w{w}" for w in range(13))


@query("dsh23_cohort_matrix", f"WITH {_COHORT_SURV} SELECT cohort_label, {_W} FROM cs GROUP BY 1", " ".join(f"w{w}" for w in range(13)))
def _(spark, sf):
    return survival.cohort_survival_matrix(survival.cohort_survival(_ev(spark, sf), "week", V))


_AT = ", ".join(f"min_by(survival_probability, time) FILTER (WHERE time >= {d}) AS survival_at_{d}_days" for d in (7, 30, 90))


@query(
    "sur07_median_survival",
    f"""WITH {SURV}, {km('cd', 'survival_time', 'churned')} SELECT min(time) FILTER (WHERE survival_probability <= 0.5) AS median,
 sum(time * survival_probability) / NULLIF(sum(survival_probability), 0) AS mean_survival, {_AT} FROM kc""",
    "mean_survival survival_at_7_days survival_at_30_days survival_at_90_days",
)
def _(spark, sf):
    return survival.median_survival(survival.kaplan_meier(_ev(spark, sf), "churn", V, CHURN))


_RISK = f"""{SURV}, up AS (SELECT user_id, first(platform ORDER BY us, event_id) AS platform FROM ev GROUP BY 1),
rk AS (SELECT platform AS segment_value, count(*) FILTER (WHERE churned) AS churned, count(*) AS total, 'platform' AS segment FROM cd JOIN up USING (user_id) GROUP BY 1
 UNION ALL SELECT label, count(user_id) FILTER (WHERE churned), count(user_id), 'order_frequency'
 FROM (VALUES {values(survival.ORDER_LABELS)}) t(position, label) LEFT JOIN cd ON {sql_bins('total_orders', survival.ORDER_EDGES, survival.ORDER_LABELS)} = label GROUP BY 1)"""


@query("sur08_risk_factors", f"WITH {_RISK} SELECT *, churned::DOUBLE / NULLIF(total, 0) AS churn_rate FROM rk", "churn_rate")
def _(spark, sf):
    return survival.risk_factors(_ev(spark, sf), V, CHURN)


@query(
    "dsh23_risk_extremes",
    f"""WITH {_RISK}, q AS (SELECT segment_value, churned::DOUBLE / total AS c FROM rk WHERE total > 0)
SELECT min_by(segment_value, (-c, segment_value)) AS highest_risk, min_by(segment_value, (c, segment_value)) AS lowest_risk FROM q""",
)
def _(spark, sf):
    rate = F.col("churn_rate")
    return survival.risk_factors(_ev(spark, sf), V, CHURN).where(rate.isNotNull()).agg(
        F.min_by("segment_value", F.struct(-rate, F.col("segment_value"))).alias("highest_risk"),
        F.min_by("segment_value", F.struct(rate, F.col("segment_value"))).alias("lowest_risk"),
    )


@query("sur09_user_features", f"WITH {EV} SELECT user_id, first(platform ORDER BY us, event_id) AS platform, count(*) AS total_events FROM ev GROUP BY 1")
def _(spark, sf):
    return survival.user_features(_ev(spark, sf))


_CURVE = f"""{_SINCE}, ul AS (SELECT user_id, max(d) AS hi FROM sd GROUP BY 1),
dy AS (SELECT unnest(range(0, least(90, (SELECT max(hi) FROM ul)) + 1)) AS days_since_first_order),
cu AS (SELECT days_since_first_order, count(*) FILTER (WHERE hi >= days_since_first_order) AS users_retained,
 count(*) FILTER (WHERE hi >= days_since_first_order)::DOUBLE / count(*) AS retention_rate FROM dy CROSS JOIN ul GROUP BY 1)"""


@query("sur10_retention_curve", f"WITH {_CURVE} SELECT * FROM cu", "retention_rate")
def _(spark, sf):
    return survival.retention_curve(_ev(spark, sf), "day", V)


# Customers of the orders table come back for years.
_LONG = f"""{ORD}, ol AS (SELECT user_id, CAST(floor((max(us) - min(us)) / {DAY}) AS BIGINT) AS hi FROM o GROUP BY 1),
dy AS (SELECT unnest(range(0, (SELECT max(hi) FROM ol) + 1)) AS days_since_first_order), hc AS (SELECT hi, count(*) AS n FROM ol GROUP BY 1)
SELECT days_since_first_order, CAST(sum(n) FILTER (WHERE hi >= days_since_first_order) AS BIGINT) AS users_retained,
 sum(n) FILTER (WHERE hi >= days_since_first_order)::DOUBLE / sum(n) AS retention_rate FROM dy CROSS JOIN hc GROUP BY 1"""


@query("sur10_whole_curve", f"WITH {_LONG}", "retention_rate")
def _(spark, sf):
    """The curve to the last order of the slowest customer."""
    orders = b.orders(spark, sf).withColumn("event_type", F.lit("purchase"))
    return survival.retention_curve(orders, "day", V, last_day=None)


@query("sur10_retention_curve_weekly", f"WITH {_CURVE} SELECT * FROM cu WHERE days_since_first_order % 7 = 0", "retention_rate")
def _(spark, sf):
    return survival.retention_curve(_ev(spark, sf), "week", V)


@query(
    "dsh23_repeat_purchase",
    f"""WITH {SURV} SELECT count(*) AS buyers, count(*) FILTER (WHERE has_second_order) AS repeat_buyers,
 avg(has_second_order::INT) * 100 AS repeat_rate, avg(time_to_second_order_days) FILTER (WHERE has_second_order) AS avg_days FROM t2""",
    "repeat_rate avg_days",
)
def _(spark, sf):
    return survival.repeat_purchase_stats(survival.time_to_second_order(_ev(spark, sf), V))


# --- reactivation -----------------------------------------------------------------------------

IDLE = 0.25  # days; users of these tables are rarely idle for long
REA = f"""{EV},
du AS (SELECT user_id, max(event_time) AS last_activity, ({_REF} - max(us)) / {DAY} AS days_inactive FROM ev GROUP BY 1 HAVING ({_REF} - max(us)) / {DAY} >= {IDLE}),
dt AS (SELECT *, {sql_bins('days_inactive', reactivation.DORMANCY_EDGES, reactivation.DORMANCY_TIERS)} AS dormancy_tier FROM du),
df AS (SELECT user_id, count(*) AS total_events, count(DISTINCT event_time::DATE) AS total_sessions, {cnt('purchase')} AS total_orders,
  coalesce(sum(order_total) FILTER (WHERE event_type = 'purchase'), 0) AS total_revenue, coalesce(avg(order_total) FILTER (WHERE event_type = 'purchase'), 0) AS avg_order_value,
  count(DISTINCT event_type) AS unique_event_types, {cnt('click')} + {cnt('error')} AS cart_events, {cnt('view')} AS search_events,
  mode(platform ORDER BY platform) AS primary_platform, min(event_time) AS first_seen, max(event_time) AS last_seen, (max(us) - min(us)) / {DAY} AS tenure_days,
  CASE WHEN {cnt('purchase')} > 1 THEN (max(us) FILTER (WHERE event_type = 'purchase') - min(us) FILTER (WHERE event_type = 'purchase')) / {DAY} / ({cnt('purchase')} - 1) ELSE 0 END AS avg_order_gap_days,
  first(days_inactive) AS days_inactive, first(dormancy_tier) AS dormancy_tier FROM ev JOIN dt USING (user_id) GROUP BY 1),
d1 AS (SELECT *, greatest(least(total_orders / 10.0::DOUBLE, 1), 0) * 30 AS order_score, greatest(least(total_revenue / 500.0::DOUBLE, 1), 0) * 25 AS revenue_score,
  greatest(least(unique_event_types / 10.0::DOUBLE, 1), 0) * 15 AS engagement_score, greatest(least(1 - days_inactive / 90.0::DOUBLE, 1), 0) * 20 AS recency_score,
  greatest(least(tenure_days / 60.0::DOUBLE, 1), 0) * 10 AS tenure_score FROM df),
d2 AS (SELECT *, order_score + revenue_score + engagement_score + recency_score + tenure_score AS reactivation_score FROM d1),
ds AS (SELECT *, {sql_bins('reactivation_score', reactivation.SCORE_EDGES, reactivation.SCORE_TIERS)} AS reactivation_tier FROM d2)"""


def _dormant(spark, sf):
    return reactivation.reactivation_scores(reactivation.dormant_features(_ev(spark, sf), V, IDLE))


@query("rea01_dormant_users", f"WITH {REA} SELECT * FROM dt")
def _(spark, sf):
    return reactivation.dormant_users(_ev(spark, sf), IDLE)


@query("rea02_features", f"WITH {REA} SELECT * FROM df", "total_revenue:3 avg_order_value")
def _(spark, sf):
    return reactivation.dormant_features(_ev(spark, sf), V, IDLE)


@query("rea03_scores", f"WITH {REA} SELECT * FROM ds", "total_revenue:3 avg_order_value order_score revenue_score engagement_score recency_score tenure_score reactivation_score")
def _(spark, sf):
    return _dormant(spark, sf)


_INC = """di AS (SELECT *, CASE WHEN reactivation_score >= 75 THEN 'reminder' WHEN reactivation_score >= 50 AND avg_order_value > 100 THEN 'percentage_discount'
  WHEN reactivation_score >= 50 THEN 'free_delivery' WHEN reactivation_score >= 25 THEN 'percentage_discount' WHEN total_orders > 0 THEN 'fixed_discount' ELSE 'skip' END AS incentive_type,
  CASE WHEN reactivation_score >= 75 THEN 0 WHEN reactivation_score >= 50 AND avg_order_value > 100 THEN 10 WHEN reactivation_score >= 50 THEN 0
  WHEN reactivation_score >= 25 AND avg_order_value > 50 THEN 15 WHEN reactivation_score >= 25 THEN 20 WHEN total_orders > 0 THEN 20 ELSE 0 END::DOUBLE AS v,
  CASE WHEN reactivation_score >= 50 THEN 'high' WHEN reactivation_score >= 25 THEN 'medium' ELSE 'low' END AS priority FROM ds),
dx AS (SELECT *, CASE WHEN days_inactive > 60 AND incentive_type <> 'skip' THEN least(v * 1.5, 30) ELSE v END AS incentive_value FROM di)"""


@query("rea04_incentives", f"WITH {REA}, {_INC} SELECT user_id, incentive_type, incentive_value, priority FROM dx")
def _(spark, sf):
    return reactivation.with_incentives(_dormant(spark, sf)).select("user_id", "incentive_type", "incentive_value", "priority")


_CAMP = {
    "high_value_recently_dormant": "round(total_revenue, 6) > round((SELECT quantile_cont(total_revenue, 0.5) FROM ds), 6) AND days_inactive <= 30",
    "frequent_orderers_churned": "total_orders >= 3 AND days_inactive > 30",
    "one_time_buyers": "total_orders = 1 AND days_inactive <= 45",
    "long_dormant_whales": "round(total_revenue, 6) > round((SELECT quantile_cont(total_revenue, 0.75) FROM ds), 6) AND days_inactive > 60",
    "never_converted": "total_orders = 0",
}
_CAMP_SQL = " UNION ALL ".join(
    f"""SELECT '{n}' AS segment, count(*) AS user_count, {"0.0::DOUBLE" if n == "never_converted" else "avg(total_revenue)"} AS avg_revenue,
 {"0.0::DOUBLE" if n == "never_converted" else "avg(total_orders)"} AS avg_orders, '{c}' AS recommended_channel, '{i}' AS recommended_incentive, {p}::BIGINT AS priority
 FROM ds WHERE {_CAMP[n]} HAVING count(*) > 0"""
    for n, c, i, p in reactivation.CAMPAIGNS
)


@query("rea05_campaign_segments", f"WITH {REA} {_CAMP_SQL}", "avg_revenue avg_orders")
def _(spark, sf):
    return reactivation.campaign_segments(_dormant(spark, sf))


@query(
    "rea06_export",
    f"""WITH {REA}, {_INC} SELECT user_id, days_inactive, dormancy_tier, total_orders, total_revenue, avg_order_value, reactivation_score, reactivation_tier,
 incentive_type, incentive_value, priority, primary_platform FROM dx
WHERE {_CAMP['high_value_recently_dormant']}""",
    "total_revenue:3 avg_order_value reactivation_score",
)
def _(spark, sf):
    return reactivation.export_for_campaign(_dormant(spark, sf), "high_value_recently_dormant").drop("suggested_message")


_T = ", ".join(f"count(*) FILTER (WHERE dormancy_tier = '{t}') AS dormant_{t.replace('+', '_plus')}" for t in reactivation.DORMANCY_TIERS)
_T += ", " + ", ".join(f"count(*) FILTER (WHERE reactivation_tier = '{t}') AS potential_{t}" for t in reactivation.SCORE_TIERS)


@query(
    "rea07_summary",
    f"""WITH {REA} SELECT count(*) AS total_dormant_users, avg(days_inactive) AS avg_days_inactive, {_T},
 count(*) FILTER (WHERE reactivation_tier IN ('high', 'very_high')) AS high_potential_users,
 coalesce(sum(total_revenue) FILTER (WHERE reactivation_tier IN ('high', 'very_high')), 0) AS potential_recoverable_revenue FROM ds""",
    "avg_days_inactive potential_recoverable_revenue:3",
)
def _(spark, sf):
    return reactivation.reactivation_summary(_dormant(spark, sf))


# --- anomalies --------------------------------------------------------------------------------

S = 1.5
VOL = f"""{EV}, hv AS (SELECT date_trunc('hour', event_time)::TIMESTAMP AS datetime, count(*) AS events FROM ev GROUP BY 1),
hz AS (SELECT *, abs((events - avg(events) OVER ()) / NULLIF(stddev_pop(events) OVER (), 0)) AS z_score,
  greatest(0.0::DOUBLE, avg(events) OVER () - {S} * stddev_samp(events) OVER ()) AS expected_min, avg(events) OVER () + {S} * stddev_samp(events) OVER () AS expected_max FROM hv),
va AS (SELECT datetime, datetime::DATE::VARCHAR AS date, hour(datetime) AS hour, events, z_score,
  CASE WHEN events > expected_max THEN 'spike' WHEN events < expected_min THEN 'drop' ELSE 'normal' END AS anomaly_type, expected_min, expected_max FROM hz WHERE z_score > {S})"""


@query("ano03_volume", f"WITH {VOL} SELECT * FROM va", "z_score expected_min expected_max")
def _(spark, sf):
    return anomalies.volume_anomalies(_ev(spark, sf), S)


@query("ano01_zscore_flags", f"WITH {VOL} SELECT datetime, events, z_score > {S} AS is_anomaly FROM hz")
def _(spark, sf):
    from pyspark.sql import Window

    h = _ev(spark, sf).groupBy(F.date_trunc("hour", "event_time").alias("datetime")).agg(F.count(F.lit(1)).alias("events"))
    return h.select("datetime", "events", (F.abs(anomalies.z_score(F.col("events"), Window.partitionBy())) > S).alias("is_anomaly"))


USR = f"""{EV}, ua AS (SELECT user_id, count(*) AS total_events, {cnt('purchase')} AS checkouts, (max(us) - min(us)) / 3600000000.0::DOUBLE AS session_duration_hours FROM ev GROUP BY 1),
ub AS (SELECT *, total_events / greatest(session_duration_hours, 0.1::DOUBLE) AS events_per_hour FROM ua),
uq AS (SELECT quantile_cont(events_per_hour, 0.25) AS e1, quantile_cont(events_per_hour, 0.75) AS e3, quantile_cont(checkouts::DOUBLE, 0.25) AS c1,
  quantile_cont(checkouts::DOUBLE, 0.75) AS c3, count(*) AS n FROM ub),
uf AS (SELECT ub.*, n >= 3 AND (events_per_hour < e1 - (e3 - e1) * 1.5 OR events_per_hour > e3 + (e3 - e1) * 1.5) AS f1,
  n >= 3 AND (checkouts < c1 - (c3 - c1) * 1.5 OR checkouts > c3 + (c3 - c1) * 1.5) AS f2, session_duration_hours < 0.1 AND total_events > 50 AS f3,
  checkouts::DOUBLE / total_events > 0.5 AS f4 FROM ub CROSS JOIN uq),
us2 AS (SELECT user_id, total_events, checkouts, events_per_hour, session_duration_hours, (f1::INT + f2::INT + f3::INT + f4::INT)::BIGINT AS total_flags,
  concat_ws(', ', CASE WHEN f1 THEN 'High Event Rate' END, CASE WHEN f2 THEN 'High Checkouts' END, CASE WHEN f3 THEN 'Fast Heavy Usage' END,
  CASE WHEN f4 THEN 'Checkout Heavy' END) AS flags FROM uf WHERE f1::INT + f2::INT + f3::INT + f4::INT >= 2)"""


@query("ano04_users", f"WITH {USR} SELECT * FROM us2")
def _(spark, sf):
    return anomalies.user_anomalies(_ev(spark, sf), V)


@query("ano02_iqr_flags", f"WITH {USR} SELECT user_id, events_per_hour, f1 AS is_outlier, f2 AS many_checkouts FROM uf")
def _(spark, sf):
    from tidelens.functions.columns import count_if, micros

    us = micros(F.col("event_time"))
    hours = (F.max(us) - F.min(us)) / F.lit(3_600_000_000.0)
    u = _ev(spark, sf).groupBy("user_id").agg(
        (F.count(F.lit(1)) / F.greatest(hours, F.lit(0.1))).alias("events_per_hour"), count_if(F.col("event_type") == "purchase").alias("c")
    )
    return anomalies.iqr_outliers(u, {"events_per_hour": "is_outlier", "c": "many_checkouts"}).drop("c")


MAN = f"""{ORD}, md AS (SELECT merchant, event_time::DATE AS date, count(*) AS orders FROM o GROUP BY 1, 2),
mz AS (SELECT *, avg(orders) OVER w AS avg_daily_orders, stddev_samp(orders) OVER w AS sd, count(*) OVER w AS dn FROM md WINDOW w AS (PARTITION BY merchant)),
ma AS (SELECT date::VARCHAR AS date, merchant, orders, avg_daily_orders, (orders - avg_daily_orders) / greatest(sd, 1.0::DOUBLE) AS z_score,
  CASE WHEN (orders - avg_daily_orders) / greatest(sd, 1.0::DOUBLE) > {S} THEN 'surge' ELSE 'drop' END AS anomaly_type FROM mz
  WHERE dn >= 3 AND abs((orders - avg_daily_orders) / greatest(sd, 1.0::DOUBLE)) > {S})"""


@query("ano05_merchants", f"WITH {MAN} SELECT * FROM ma", "avg_daily_orders z_score")
def _(spark, sf):
    return anomalies.merchant_anomalies(b.orders(spark, sf), S)


CON = f"""hu AS (SELECT date_trunc('hour', event_time)::TIMESTAMP AS datetime, count(DISTINCT user_id) AS unique_users,
  count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS checkout_users FROM ev GROUP BY 1),
hc AS (SELECT *, {r('checkout_users::DOUBLE / unique_users * 100', 2)} AS conversion_rate FROM hu),
hy AS (SELECT *, abs((conversion_rate - avg(conversion_rate) OVER ()) / NULLIF(stddev_pop(conversion_rate) OVER (), 0)) AS z_score, avg(conversion_rate) OVER () AS expected_cvr FROM hc),
ca AS (SELECT *, CASE WHEN conversion_rate > expected_cvr THEN 'high' WHEN conversion_rate < expected_cvr THEN 'low' ELSE 'normal' END AS anomaly_type FROM hy WHERE z_score > {S})"""


@query("ano06_conversion", f"WITH {EV}, {CON} SELECT * FROM ca", "z_score expected_cvr")
def _(spark, sf):
    return anomalies.conversion_anomalies(_ev(spark, sf), V, S)


@query(
    "ano07_payment",
    f"""WITH {ORD}, dm AS (SELECT date, payment_method, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_time::DATE AS date FROM o) CROSS JOIN (SELECT DISTINCT payment_method FROM o)
  LEFT JOIN (SELECT event_time::DATE AS date, payment_method, count(*) AS n FROM o GROUP BY 1, 2) USING (date, payment_method)),
sh AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY date) AS s FROM dm),
sz AS (SELECT *, (s - avg(s) OVER w) / NULLIF(stddev_pop(s) OVER w, 0) AS z, sum(n) OVER w::DOUBLE / sum(n) OVER () AS expected FROM sh WINDOW w AS (PARTITION BY payment_method))
SELECT date::VARCHAR AS date, payment_method, s * 100 AS share, expected * 100 AS expected_share, CASE WHEN s > expected THEN 'high' ELSE 'low' END AS anomaly_type
FROM sz WHERE abs(z) > 2""".replace("sum(n) OVER w::DOUBLE", "(sum(n) OVER w)::DOUBLE"),
    "share expected_share",
)
def _(spark, sf):
    return anomalies.payment_anomalies(b.orders(spark, sf), 2.0)


@query(
    "ano08_summary",
    f"""WITH {VOL}, {USR[len(EV) + 2:]}, {MAN}, {CON}
SELECT (SELECT count(*) FROM va) AS volume_anomalies, (SELECT count(*) FROM va WHERE anomaly_type = 'spike') AS volume_spikes,
 (SELECT count(*) FROM va WHERE anomaly_type = 'drop') AS volume_drops, (SELECT count(*) FROM us2) AS suspicious_users,
 (SELECT count(*) FROM ma) AS merchant_anomalies, (SELECT count(*) FROM ca) AS conversion_anomalies, {S}::DOUBLE AS sensitivity""",
)
def _(spark, sf):
    return anomalies.anomaly_summary(_ev(spark, sf), b.orders(spark, sf), V, S)


@query(
    "ano09_alerts",
    f"""WITH {VOL}, {USR[len(EV) + 2:]}, {MAN}, {CON},
md2 AS (SELECT merchant, min(date) AS d FROM ma WHERE anomaly_type = 'drop' GROUP BY 1)
SELECT * FROM (
SELECT 'volume_spike' AS type, 'medium' AS severity, 2::BIGINT AS severity_level, 'Traffic Spike Detected' AS title FROM va WHERE anomaly_type = 'spike' HAVING count(*) > 0
UNION ALL SELECT 'volume_drop', 'high', 3, 'Traffic Drop Detected' FROM va WHERE anomaly_type = 'drop' HAVING count(*) > 0
UNION ALL SELECT 'suspicious_activity', CASE WHEN count(*) > 10 THEN 'high' ELSE 'medium' END, CASE WHEN count(*) > 10 THEN 3 ELSE 2 END, count(*) || ' Suspicious Users Detected' FROM us2 HAVING count(*) > 0
UNION ALL SELECT 'merchant_drop', 'medium', 2, count(*) || ' Merchants with Order Drops' FROM md2 HAVING count(*) > 0
UNION ALL SELECT 'low_conversion', 'high', 3, 'Low Conversion Rate Detected' FROM ca WHERE anomaly_type = 'low' HAVING count(*) > 0)""",
)
def _(spark, sf):
    return anomalies.alerts(_ev(spark, sf), b.orders(spark, sf), V, S).drop("message", "action")

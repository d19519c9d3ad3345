"""Model features with SQL twins, and trained models with the facts about them that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.catalog import bindings as b
from tidelens.catalog.behaviour import sess
from tidelens.catalog.commerce import rank_pct
from tidelens.catalog.registry import query
from tidelens.catalog.users import DAY, _REF, cnt
from tidelens.functions.tables import new_path, stored
from tidelens.models import features as feats
from tidelens.models import predictors as pred
from tidelens.plans import jobs

V = b.VOCAB
FUTURE = "2024-01-30 12:00:00"

_HOURS = "avg(hour(event_time)) AS avg_hour"
_SESS = "sn2 AS (SELECT user_id, max(sno) AS total_sessions FROM sx GROUP BY 1)"
_WEEKEND = "avg((isodow(event_time) IN (6, 7))::INT) AS weekend_ratio"


def churn_sql(where: str = "") -> str:
    e = sess(30).replace("FROM events)", f"FROM events {where})")
    return f"""{e}, {_SESS},
cf AS (SELECT user_id, count(*) AS total_events, count(DISTINCT event_type) AS unique_event_types, ({_REF} - max(us)) / {DAY} AS days_since_last_event,
 ({_REF} - min(us)) / {DAY} AS account_age_days, count(DISTINCT event_time::DATE) AS active_days, count(*)::DOUBLE / count(DISTINCT event_time::DATE) AS events_per_day,
 first(total_sessions) AS total_sessions, count(*)::DOUBLE / first(total_sessions) AS events_per_session, {cnt('signup')} AS homepage_views, {cnt('view')} AS product_views,
 {cnt('click')} AS cart_adds, {cnt('purchase')} AS checkouts, {cnt('error')} AS orders_delivered, ({cnt('purchase')} > 0)::BIGINT AS has_ordered,
 ({cnt('purchase')} > 1)::BIGINT AS has_multiple_orders, least({cnt('click')}::DOUBLE / greatest({cnt('view')}, 1), 1) AS view_to_cart_rate,
 least({cnt('purchase')}::DOUBLE / greatest({cnt('click')}, 1), 1) AS cart_to_checkout_rate, count(*) FILTER (WHERE platform = 'android') AS platform_android,
 count(*) FILTER (WHERE platform = 'ios') AS platform_ios, {_HOURS}, coalesce(stddev_samp(hour(event_time)), 0) AS hour_std, avg(isodow(event_time) - 1) AS avg_dayofweek,
 coalesce(stddev_samp(isodow(event_time) - 1), 0) AS dayofweek_std, {_WEEKEND} FROM ev JOIN sn2 USING (user_id) GROUP BY 1)"""


@query(
    "mlb08_churn_features",
    f"WITH {churn_sql()} SELECT * FROM cf",
    "events_per_day events_per_session view_to_cart_rate cart_to_checkout_rate avg_hour hour_std avg_dayofweek dayofweek_std weekend_ratio",
)
def _(spark, sf):
    return feats.churn_features(b.events(spark, sf), V)


def _split(spark, sf):
    e = b.events(spark, sf)
    cut = F.to_timestamp(F.lit(FUTURE))
    return e.where(F.col("event_time") < cut), e.where(F.col("event_time") >= cut)


@query(
    "mlb09_churn_labels",
    f"""SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '{FUTURE}') THEN 0 ELSE 1 END::BIGINT AS label
FROM events WHERE ts < TIMESTAMP '{FUTURE}' GROUP BY 1""",
)
def _(spark, sf):
    return feats.churn_labels(*_split(spark, sf))


_N = ", ".join(f"{cnt(s)} AS n_{s}" for s in ("signup", "view", "click", "purchase"))
_DEPTH = " + ".join(f"({cnt(s)} > 0)::BIGINT" for s in ("signup", "view", "click", "purchase"))
CONV = f"""{sess(30)},
cu AS (SELECT user_id, count(*) AS total_events, count(DISTINCT event_type) AS unique_event_types, {_N}, {_DEPTH} AS funnel_depth,
 least((max(us) - min(us)) / 60000000.0::DOUBLE, 180) AS session_duration_mins, count(*) / greatest(least((max(us) - min(us)) / 60000000.0::DOUBLE, 180), 1.0::DOUBLE) AS events_per_minute,
 {cnt('view')} AS n_searches, ({cnt('view')} > 0)::BIGINT AS has_searched, {cnt('click')} + {cnt('error')} AS cart_interactions, {cnt('error')} AS payment_changes,
 ({cnt('error')} > 0)::BIGINT AS had_payment_friction, (mode(platform ORDER BY platform) = 'android')::BIGINT AS platform_android, (mode(platform ORDER BY platform) = 'ios')::BIGINT AS platform_ios,
 {_HOURS}, min(hour(event_time)) AS first_hour, (avg(hour(event_time)) BETWEEN 11 AND 14)::BIGINT AS is_lunch_time, (avg(hour(event_time)) BETWEEN 18 AND 22)::BIGINT AS is_dinner_time,
 mode(isodow(event_time) - 1 ORDER BY isodow(event_time)) AS dayofweek, (mode(isodow(event_time) - 1 ORDER BY isodow(event_time)) IN (5, 6))::BIGINT AS is_weekend,
 {cnt('error')} AS merchants_viewed, {cnt('view')} AS products_viewed, least({cnt('click')}::DOUBLE / greatest({cnt('view')}, 1), 1) AS view_to_add_ratio,
 least({cnt('purchase')}::DOUBLE / greatest({cnt('click')}, 1), 1) AS add_to_checkout_ratio FROM ev GROUP BY 1)"""


@query("mlb14_conversion_user_features", f"WITH {CONV} SELECT * FROM cu", "events_per_minute avg_hour view_to_add_ratio add_to_checkout_ratio")
def _(spark, sf):
    return feats.conversion_features(b.events(spark, sf), "user", V)


@query("mlb16_conversion_labels", f"WITH {CONV} SELECT user_id, (n_purchase > 0)::BIGINT AS label FROM cu")
def _(spark, sf):
    return feats.conversion_labels(feats.conversion_features(b.events(spark, sf), "user", V), V).select("user_id", "label")


def has(t: str) -> str:
    return f"bool_or(event_type = '{t}')::BIGINT"


@query(
    "mlb15_conversion_session_features",
    f"""WITH {sess(30)} SELECT user_id || '_' || sno AS session_key, user_id, count(*) AS events_in_session, count(DISTINCT event_type) AS unique_events,
 least((max(us) - min(us)) / 60000000.0::DOUBLE, 120) AS session_duration_mins, {has('signup')} AS has_signup, {has('view')} AS has_view, {has('click')} AS has_click,
 0::BIGINT AS has_checkout_button, {has('purchase')} AS has_purchase, {has('signup')} + {has('view')} + {has('click')} AS funnel_depth FROM sx GROUP BY user_id, sno""",
)
def _(spark, sf):
    return feats.conversion_features(b.events(spark, sf), "session", V)


P = "FILTER (WHERE event_type = 'purchase')"
LTV = f"""{sess(30)}, {_SESS},
lb AS (SELECT user_id, count(*) AS total_events, count(DISTINCT event_type) AS unique_event_types, {cnt('purchase')} AS order_count,
 coalesce(sum(order_total) {P}, 0) AS total_revenue, coalesce(avg(order_total) {P}, 0) AS avg_order_value, coalesce(min(order_total) {P}, 0) AS min_order_value,
 coalesce(max(order_total) {P}, 0) AS max_order_value, coalesce(stddev_samp(order_total) {P}, 0) AS order_value_std,
 coalesce((min(us) {P} - min(us)) / 3600000000.0::DOUBLE, -1) AS time_to_first_order_hours, coalesce(({_REF} - min(us) {P}) / {DAY}, -1) AS days_since_first_order,
 ({_REF} - min(us)) / {DAY} AS account_age_days, ({_REF} - max(us)) / {DAY} AS days_since_last_activity, count(DISTINCT event_time::DATE) AS active_days,
 first(total_sessions) AS total_sessions, {cnt('signup')} AS homepage_views, {cnt('view')} AS searches, {cnt('error')} AS merchant_views, {cnt('view')} AS product_views,
 {cnt('click')} AS cart_adds, 0::BIGINT AS unique_merchants_ordered, (mode(platform ORDER BY platform) = 'android')::BIGINT AS platform_android,
 (mode(platform ORDER BY platform) = 'ios')::BIGINT AS platform_ios, {_HOURS}, {_WEEKEND} FROM ev JOIN sn2 USING (user_id) GROUP BY 1),
lt AS (SELECT *, order_count::DOUBLE / active_days AS order_frequency, CASE WHEN days_since_first_order > 0 THEN total_revenue / days_since_first_order ELSE total_revenue END AS revenue_velocity,
 total_events / greatest(account_age_days, 1.0::DOUBLE) AS events_per_day, total_sessions / greatest(account_age_days, 1.0::DOUBLE) AS sessions_per_day,
 CASE WHEN order_count > 0 THEN product_views::DOUBLE / order_count ELSE product_views END AS views_per_order,
 CASE WHEN order_count > 0 THEN searches::DOUBLE / order_count ELSE searches END AS searches_per_order, (order_count > 1)::BIGINT AS is_repeat_customer,
 (round(avg_order_value, 6) > round((SELECT quantile_cont(avg_order_value, 0.5) FROM lb), 6))::BIGINT AS is_high_value FROM lb)"""


@query(
    "mlb20_ltv_features",
    f"WITH {LTV} SELECT * FROM lt",
    "total_revenue:3 avg_order_value order_value_std order_frequency revenue_velocity events_per_day sessions_per_day views_per_order searches_per_order avg_hour weekend_ratio",
)
def _(spark, sf):
    return feats.ltv_features(b.events(spark, sf), V)


# Tiers over exact revenue as the prediction: a fixed input for the percentile rank.


def _tiers(spark, sf):
    e = b.events(spark, sf).where(F.col("event_type") == "purchase")
    u = e.groupBy("user_id").agg(
        F.sum(F.col("order_total").cast("decimal(18,2)")).cast("double").alias("total_revenue"), F.count(F.lit(1)).alias("order_count")
    )
    return pred.segment_by_ltv(u.withColumn("predicted_ltv", F.col("total_revenue")))


_TIER_BASE = f"""WITH sp AS (SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total_revenue, count(*) AS order_count,
 CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS predicted_ltv FROM events WHERE event_type = 'purchase' GROUP BY 1),
sr AS (SELECT *, {rank_pct('predicted_ltv')} AS ltv_percentile FROM sp),
st AS (SELECT *, CASE WHEN ltv_percentile >= 0.9 THEN 'Diamond' WHEN ltv_percentile >= 0.7 THEN 'Gold' WHEN ltv_percentile >= 0.4 THEN 'Silver' ELSE 'Bronze' END AS ltv_tier FROM sr)"""


@query("mlb26_ltv_tiers", f"{_TIER_BASE} SELECT * FROM st", "ltv_percentile")
def _(spark, sf):
    return _tiers(spark, sf)


@query("src40_ltv_tier_summary", f"{_TIER_BASE} SELECT ltv_tier, count(*) AS users, avg(total_revenue) AS avg_revenue, avg(order_count) AS avg_orders FROM st GROUP BY 1", "avg_revenue avg_orders", 1)
def _(spark, sf):
    return pred.ltv_tier_summary(_tiers(spark, sf)).select("ltv_tier", "users", "avg_revenue", "avg_orders")


# --- fitted models: what must hold for them whatever their numbers -----------------------------


def held_out(key: str) -> str:
    """SQL twin of ``predictors.hold_out`` for a fifth of the keys."""
    return f"('0x' || substr(md5({key}::VARCHAR), 1, 8))::BIGINT % 10000 < 2000"


def classifier_facts(tables: dict, probability: str) -> DataFrame:
    """One row: rows scored, rows and positives of the hold-out, and whether probabilities, decisions, ratios and importances fit together."""
    p = F.col(probability)
    scored = tables["predictions"].agg(
        F.count(F.lit(1)).alias("scored"),
        F.bool_and(p.between(0, 1)).alias("in_range"),
        F.bool_and((p > 0.5).cast("int") == F.col(probability.replace("probability", "prediction"))).alias("decided"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    right = F.col("accuracy") * F.col("test_size")
    metrics = tables["metrics"].select(
        (tp + fp + fn + tn).alias("test_rows"), (tp + fn).alias("test_positives"), (F.abs(right - (tp + tn)) < 1e-6).alias("accurate"), F.col("auc_roc").between(0, 1).alias("auc_in_range")
    )
    ranked = tables["feature_importance"].agg(F.bool_and(F.col("importance") >= 0).alias("ok")).scalar()
    row = metrics.select(F.struct("*").alias("m")).scalar()
    return scored.withColumn("m", row).select("scored", "in_range", "decided", "m.*", ranked.alias("ranked"))


_TRUE = "true AS in_range, true AS decided, {rows} AS test_rows, {pos} AS test_positives, true AS accurate, true AS auc_in_range, true AS ranked"
CHURN_FACTS = f"""WITH la AS (SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '{FUTURE}') THEN 0 ELSE 1 END::BIGINT AS label, {held_out('user_id')} AS test
 FROM events WHERE ts < TIMESTAMP '{FUTURE}' GROUP BY 1)
SELECT count(*) AS scored, {_TRUE.format(rows="count(*) FILTER (WHERE test)", pos="count(*) FILTER (WHERE test AND label = 1)")} FROM la"""
SESSION_FACTS = f"""WITH {sess(30)}, la AS (SELECT session_key, converted, {held_out('session_key')} AS test FROM ss)
SELECT count(*) AS scored, {_TRUE.format(rows="count(*) FILTER (WHERE test)", pos="count(*) FILTER (WHERE test AND converted)")} FROM la"""
USER_FACTS = f"""WITH la AS (SELECT user_id, bool_or(event_type = 'purchase') AS converted, {held_out('user_id')} AS test FROM events GROUP BY 1)
SELECT count(*) AS scored, {_TRUE.format(rows="count(*) FILTER (WHERE test)", pos="count(*) FILTER (WHERE test AND converted)")} FROM la"""


@query("mlb10_churn_model", CHURN_FACTS)
def _(spark, sf):
    """A random forest on all users; the future is the last half day."""
    return classifier_facts(pred.ChurnPredictor("random_forest", V, rounds=20).run(*_split(spark, sf)), "churn_probability")


@query("mlb10_churn_logistic", CHURN_FACTS)
def _(spark, sf):
    return classifier_facts(pred.ChurnPredictor("logistic", V).run(*_split(spark, sf)), "churn_probability")


@query("mlb17_conversion_model", SESSION_FACTS)
def _(spark, sf):
    """A boosted model on sessions."""
    return classifier_facts(pred.ConversionPredictor("gradient_boosting", V, rounds=8).run(b.events(spark, sf), "session"), "conversion_probability")


@query("mlb17_conversion_forest", USER_FACTS)
def _(spark, sf):
    """A random forest on users."""
    return classifier_facts(pred.ConversionPredictor("random_forest", V, rounds=20).run(b.events(spark, sf), "user"), "conversion_probability")


def value_facts(tables: dict) -> DataFrame:
    """One row: users scored and held out, their mean revenue, and whether predictions and errors are possible ones."""
    scored = tables["predictions"].agg(F.count(F.lit(1)).alias("scored"), F.bool_and(F.col("predicted_ltv") >= 0).alias("clipped"), F.sum("order_count").alias("orders"))
    possible = (F.col("mae") >= 0) & (F.col("rmse") >= F.col("mae") - 1e-9) & (F.col("r2") <= 1)
    row = tables["metrics"].select(F.struct(F.col("test_size").alias("test_rows"), F.col("mean_actual"), possible.alias("possible")).alias("m")).scalar()
    return scored.withColumn("m", row).select("scored", "clipped", "orders", "m.*")


VALUE_FACTS = f"""WITH la AS (SELECT user_id, count(*) AS n, sum(value) AS r, {held_out('user_id')} AS test FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT count(*) AS scored, true AS clipped, CAST(sum(n) AS BIGINT) AS orders, count(*) FILTER (WHERE test) AS test_rows, avg(r) FILTER (WHERE test) AS mean_actual, true AS possible FROM la"""


def _value(name: str, model: str, rounds: int) -> None:
    @query(name, VALUE_FACTS, "mean_actual:3")
    def _(spark, sf):
        return value_facts(pred.LtvPredictor(model, V, rounds=rounds).run(b.events(spark, sf)))


_value("mlb25_ltv_model", "gradient_boosting", 8)
_value("mlb25_ltv_forest", "random_forest", 20)
_value("mlb25_ltv_ridge", "ridge", 1)


@query(
    "mlb11_at_risk_users",
    f"""SELECT count(*) AS scored, true AS split, true AS sorted_out FROM (SELECT DISTINCT user_id FROM events WHERE ts < TIMESTAMP '{FUTURE}')""",
)
def _(spark, sf):
    """Users at risk are those who reach the threshold, and no others."""
    scores = stored(pred.ChurnPredictor("logistic", V).run(*_split(spark, sf))["predictions"], "churn-scores")
    risky = pred.at_risk_users(scores, 0.6)
    inside = risky.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("churn_probability"), F.lit(1.0)).alias("least"))
    row = inside.select(F.struct("n", "least").alias("r")).scalar()
    return scores.agg(F.count(F.lit(1)).alias("scored"), F.sum((F.col("churn_probability") >= 0.6).cast("long")).alias("n")).withColumn("r", row).select(
        "scored", (F.col("n") == F.col("r.n")).alias("split"), (F.col("r.least") >= 0.6).alias("sorted_out")
    )


@query("mlb05_saved_and_loaded", f"SELECT user_id, true AS same FROM events WHERE ts < TIMESTAMP '{FUTURE}' GROUP BY 1")
def _(spark, sf):
    """A saved and loaded forest gives every user the score it gave before."""
    history, future = _split(spark, sf)
    model = pred.ChurnPredictor("random_forest", V, rounds=5)
    before = stored(model.run(history, future)["predictions"], "churn-scores")
    path = new_path(spark, "churn-model")
    model.save(path)
    again = pred.ChurnPredictor("random_forest", V).load(path).predict(feats.churn_features(history, V), "churn")
    after = again.select("user_id", F.col("churn_probability").alias("p"))
    return before.join(after, "user_id").select("user_id", (F.abs(F.col("p") - F.col("churn_probability")) < 1e-6).alias("same"))


# --- jobs run to their end --------------------------------------------------------------------


def _read(spark, paths: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(path) for name, path in paths.items()}


@query("src38_churn_training_job", CHURN_FACTS)
def _(spark, sf):
    """The churn job with a future period: trained, scored and saved; read back from its tables."""
    return classifier_facts(_read(spark, jobs.churn_prediction(*_split(spark, sf), new_path(spark, "churn-job"), V, "random_forest", rounds=10)), "churn_probability")


@query("src39_conversion_prediction_job", SESSION_FACTS.replace("true AS ranked", "true AS ranked, true AS intent"))
def _(spark, sf):
    """The conversion job on sessions; its list of high intent is that part of its scores."""
    tables = _read(spark, jobs.conversion_prediction(b.events(spark, sf), new_path(spark, "conversion-job"), V, "logistic", "session"))
    listed = tables["high_intent"].agg(F.count(F.lit(1))).scalar()
    wanted = tables["predictions"].agg(F.sum((F.col("conversion_probability") > 0.7).cast("long"))).scalar()
    return classifier_facts(tables, "conversion_probability").withColumn("intent", listed == wanted)


@query("src40_ltv_job", VALUE_FACTS.replace("true AS possible", "true AS possible, true AS tiered"), "mean_actual:3")
def _(spark, sf):
    """The value job to its end; tiers hold every scored user once."""
    tables = _read(spark, jobs.ltv_prediction(b.events(spark, sf), new_path(spark, "ltv-job"), V, "gradient_boosting", rounds=5))
    tiers = tables["ltv_tiers"].agg(F.sum("users")).scalar()
    return value_facts(tables).withColumn("tiered", tiers == F.col("scored"))

"""Merchants, promotions, searches, deliveries and trending lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelens.catalog import bindings as b
from tidelens.catalog.bindings import DEL, EV, ORD, SE, pct, r, sql_bins, values
from tidelens.catalog.registry import query
from tidelens.operators import deliveries, merchants, promos, searches, trending

V = b.VOCAB


def slot_sql(x: str, slots, default: str) -> str:
    whens = " ".join(
        f"WHEN {x} >= {s} {'AND' if s < e else 'OR'} {x} < {e} THEN '{n}'" for n, s, e in slots
    )
    return f"CASE {whens} ELSE '{default}' END"


SLOT = slot_sql("hour(event_time)", merchants.SLOTS, "other")

# --- merchants --------------------------------------------------------------------------------

MM = f"""{ORD},
mu AS (SELECT merchant, user_id, count(*) AS n FROM o GROUP BY 1, 2),
mr AS (SELECT merchant, avg((n > 1)::INT) * 100 AS repeat_rate FROM mu GROUP BY 1),
mm AS (SELECT merchant, count(*) AS order_count, count(DISTINCT user_id) AS unique_customers, sum(order_total) AS total_revenue,
  avg(order_total) AS avg_order_value, avg(quantity) AS avg_items_per_order, avg(delivery_fee) AS avg_delivery_fee,
  min(event_time)::DATE AS first_order_date, max(event_time)::DATE AS last_order_date, count(DISTINCT event_time::DATE) AS active_days,
  {r('count(*)::DOUBLE / count(DISTINCT user_id)', 2)} AS orders_per_customer, first(repeat_rate) AS repeat_rate, mode(category) AS primary_category
  FROM o JOIN mr USING (merchant) GROUP BY 1)"""


def _metrics(spark, sf):
    return merchants.merchant_metrics(b.orders(spark, sf))


@query(
    "mer01_metrics",
    f"WITH {MM} SELECT * REPLACE (first_order_date::VARCHAR AS first_order_date, last_order_date::VARCHAR AS last_order_date) FROM mm",
    "total_revenue:3 avg_order_value avg_items_per_order avg_delivery_fee repeat_rate",
)
def _(spark, sf):
    return _metrics(spark, sf)


def rank_pct(c: str) -> str:
    return f"((rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE) / count(*) OVER ())"


HEALTH = f"""{MM},
mb AS (SELECT *, date_diff('day', last_order_date, max(last_order_date) OVER ()) AS idle FROM mm WHERE order_count >= 5),
mh AS (SELECT *, {r(f"{rank_pct('order_count')} * 100 * 0.25 + {rank_pct('repeat_rate')} * 100 * 0.25 + {rank_pct('orders_per_customer')} * 100 * 0.25 + (100 - {rank_pct('idle')} * 100) * 0.25", 1)} AS health_score FROM mb),
he AS (SELECT merchant, primary_category, health_score, {sql_bins('health_score', merchants.HEALTH_EDGES, merchants.HEALTH_TIERS)} AS health_tier,
  order_count, unique_customers, repeat_rate, orders_per_customer FROM mh)"""


@query("mer02_health", f"WITH {HEALTH} SELECT * FROM he ORDER BY health_score DESC, merchant LIMIT 50", "repeat_rate")
def _(spark, sf):
    return merchants.health_scores(_metrics(spark, sf))


@query("dsh24_tier_counts", f"WITH {HEALTH} SELECT health_tier, count(*) AS merchants FROM he WHERE health_tier IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return merchants.tier_counts(merchants.health_scores(_metrics(spark, sf), None))


@query("dsh24_merchant_names", f"WITH {ORD} SELECT DISTINCT merchant FROM o")
def _(spark, sf):
    return merchants.merchant_names(b.orders(spark, sf))


# Fees here are at most 8 and revenue is large; the thresholds below are exercised through the orders per customer.
@query(
    "mer03_at_risk",
    f"""WITH {MM},
md AS (SELECT merchant, quantile_disc(us, 0.5) AS lo FROM o GROUP BY 1),
hf AS (SELECT merchant, count(*) FILTER (WHERE us <= lo) AS f, count(*) AS a FROM o JOIN md USING (merchant) GROUP BY 1),
rk AS (SELECT mm.*, repeat_rate < 10 AS r1, orders_per_customer < 1.1 AS r2, order_count > 10 AND (a - f) < f * 0.7 AS r3,
  avg_delivery_fee > 0 AND avg_order_value > 0 AND avg_delivery_fee / avg_order_value * 100 > 20 AS r4 FROM mm JOIN hf USING (merchant) WHERE order_count >= 10)
SELECT merchant, primary_category AS category, (r1::INT * 30 + r2::INT * 25 + r3::INT * 30 + r4::INT * 15)::BIGINT AS risk_score,
 concat_ws('; ', CASE WHEN r1 THEN 'Very low repeat rate (<10%)' END, CASE WHEN r2 THEN 'Almost no repeat orders' END,
 CASE WHEN r3 THEN 'Declining order volume (-30%+)' END, CASE WHEN r4 THEN 'High delivery fee ratio' END) AS risk_factors, order_count, {r('repeat_rate', 1)} AS repeat_rate
FROM rk WHERE r1 OR r2 OR r3 OR r4""",
)
def _(spark, sf):
    return merchants.at_risk(b.orders(spark, sf), _metrics(spark, sf))


M1, M2 = "Supplier#000000003", "Supplier#000000007"


@query(
    "mer04_comparison",
    f"""WITH {MM}, t AS (SELECT * FROM mm WHERE merchant = '{M1}'), c AS (SELECT * FROM mm WHERE primary_category = (SELECT primary_category FROM t))
SELECT merchant, primary_category AS category, order_count, {r('(SELECT avg(order_count) FROM c)', 1)} AS order_count_category_avg,
 (SELECT count(*) FROM c WHERE c.order_count <= t.order_count) AS order_count_category_rank, (SELECT count(*) FROM c) AS category_total,
 {r('(SELECT avg((mm.order_count <= t.order_count)::INT) FROM mm) * 100', 1)} AS overall_percentile, {r('repeat_rate', 1)} AS repeat_rate,
 {r('(SELECT avg(repeat_rate) FROM c)', 1)} AS repeat_rate_category_avg, {r('(SELECT avg(repeat_rate) FROM mm)', 1)} AS repeat_rate_overall_avg,
 CASE WHEN repeat_rate > (SELECT avg(repeat_rate) FROM c) THEN 'Above Average' ELSE 'Below Average' END AS repeat_rate_status,
 {r('orders_per_customer', 2)} AS orders_per_customer, {r('(SELECT avg(orders_per_customer) FROM c)', 2)} AS orders_per_customer_category_avg,
 {r('(SELECT avg(orders_per_customer) FROM mm)', 2)} AS orders_per_customer_overall_avg, {r('avg_order_value', 2)} AS avg_order_value,
 {r('(SELECT avg(avg_order_value) FROM c)', 2)} AS avg_order_value_category_avg, {r('(SELECT avg(avg_order_value) FROM mm)', 2)} AS avg_order_value_overall_avg FROM t""",
)
def _(spark, sf):
    return merchants.comparison(_metrics(spark, sf), M1)


@query(
    "mer05_categories",
    f"""WITH {MM} SELECT primary_category AS category, count(*) AS merchant_count, CAST(sum(order_count) AS BIGINT) AS total_orders,
 avg(order_count) AS avg_orders_per_merchant, CAST(sum(unique_customers) AS BIGINT) AS total_customers, sum(total_revenue) AS total_revenue,
 avg(repeat_rate) AS avg_repeat_rate, avg(orders_per_customer) AS avg_orders_per_customer,
 {pct('sum(order_count)', '(SELECT sum(order_count) FROM mm)', 1)} AS market_share FROM mm GROUP BY 1""",
    "avg_orders_per_merchant total_revenue:3 avg_repeat_rate avg_orders_per_customer",
)
def _(spark, sf):
    return merchants.category_performance(_metrics(spark, sf))


@query(
    "mer06_time_slots",
    f"""WITH {ORD} SELECT {SLOT} AS time_slot, count(*) AS orders, count(DISTINCT user_id) AS unique_customers, avg(order_total) AS avg_order_value,
 {pct('count(*)', '(SELECT count(*) FROM o)', 1)} AS pct_of_orders FROM o GROUP BY 1""",
    "avg_order_value",
)
def _(spark, sf):
    return merchants.time_performance(b.orders(spark, sf))


@query(
    "mer07_top_by_category",
    f"""WITH {MM} SELECT primary_category, merchant, order_count, unique_customers, repeat_rate, orders_per_customer FROM
 (SELECT *, row_number() OVER (PARTITION BY primary_category ORDER BY order_count DESC, merchant) AS k FROM mm) WHERE k <= 5""",
    "repeat_rate",
)
def _(spark, sf):
    return merchants.top_by_category(_metrics(spark, sf))


@query(
    "mer08_new_merchants",
    f"""WITH {MM} SELECT merchant, primary_category, first_order_date::VARCHAR AS first_order_date, order_count, unique_customers, orders_per_customer
FROM mm WHERE first_order_date >= (SELECT max(last_order_date) FROM mm) - 2400""",
)
def _(spark, sf):
    return merchants.new_merchants(_metrics(spark, sf), 2400)


@query(
    "mer09_overlap",
    f"""WITH {ORD}, u AS (SELECT user_id, bool_or(merchant = '{M1}') AS a, bool_or(merchant = '{M2}') AS z FROM o GROUP BY 1),
g AS (SELECT count(*) FILTER (WHERE a) AS customers_a, count(*) FILTER (WHERE z) AS customers_b, count(*) FILTER (WHERE a AND z) AS overlap FROM u)
SELECT '{M1}' AS merchant_a, '{M2}' AS merchant_b, customers_a, customers_b, overlap, {pct('overlap', 'customers_a', 1)} AS overlap_pct_of_a,
 {pct('overlap', 'customers_b', 1)} AS overlap_pct_of_b, customers_a - overlap AS only_a, customers_b - overlap AS only_b FROM g""",
)
def _(spark, sf):
    return merchants.customer_overlap(b.orders(spark, sf), M1, M2)


@query(
    "mer10_summary",
    f"""WITH {MM} SELECT count(*) AS total_merchants, CAST(sum(order_count) AS BIGINT) AS total_orders, sum(total_revenue) AS total_revenue,
 {r('avg(repeat_rate)', 1)} AS avg_repeat_rate, {r('avg(orders_per_customer)', 2)} AS avg_orders_per_customer,
 (SELECT count(DISTINCT user_id) FROM o) AS total_customers,
 (SELECT primary_category FROM mm GROUP BY 1 ORDER BY sum(order_count) DESC, 1 LIMIT 1) AS top_category FROM mm""",
    "total_revenue:3",
)
def _(spark, sf):
    return merchants.summary(b.orders(spark, sf), _metrics(spark, sf))


# --- promotions -------------------------------------------------------------------------------

PRO = f"""{ORD}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS order_number FROM o),
pp AS (SELECT promo_code, count(*) AS uses, count(DISTINCT user_id) AS unique_users, sum(order_total) AS total_revenue, sum(discount_amount) AS total_discount,
  count(*) FILTER (WHERE order_number = 1) AS f FROM p WHERE has_promo GROUP BY 1),
pf AS (SELECT promo_code, uses, unique_users, {r('uses::DOUBLE / unique_users', 2)} AS uses_per_user, total_revenue, total_revenue / uses AS avg_order_value,
  total_discount, total_discount / uses AS avg_discount, {r('total_discount / uses / (total_revenue / uses) * 100', 1)} AS discount_rate,
  {r('f::DOUBLE / uses * 100', 1)} AS first_order_rate, {r('total_revenue / total_discount', 2)} AS revenue_per_discount FROM pp),
fp AS (SELECT a.promo_code, count(*) AS first_orders, avg(a.order_total) AS avg_order_value, avg(a.discount_amount) AS avg_discount,
  count(*) AS users_acquired, count(*) FILTER (WHERE n > 1) AS users_returned, {pct('count(*) FILTER (WHERE n > 1)', 'count(*)', 1)} AS retention_rate
  FROM p a JOIN (SELECT user_id, count(*) AS n FROM p GROUP BY 1) USING (user_id) WHERE order_number = 1 AND has_promo GROUP BY 1 HAVING count(*) >= 3)"""


def _promo(spark, sf):
    return promos.with_first_order(b.orders(spark, sf))


PSUM = f"""ps AS (SELECT count(*) AS total_orders, count(*) FILTER (WHERE has_promo) AS promo_orders,
 {pct('count(*) FILTER (WHERE has_promo)', 'count(*)', 1)} AS promo_rate, count(DISTINCT promo_code) FILTER (WHERE has_promo) AS unique_promo_codes,
 count(DISTINCT user_id) FILTER (WHERE has_promo) AS promo_users, count(DISTINCT user_id) AS total_users,
 {pct('count(DISTINCT user_id) FILTER (WHERE has_promo)', 'count(DISTINCT user_id)', 1)} AS user_promo_rate,
 sum(discount_amount) AS total_discount_given, avg(discount_amount) FILTER (WHERE has_promo) AS avg_discount FROM o)"""


@query("pro01_summary", f"WITH {ORD}, {PSUM} SELECT * FROM ps", "total_discount_given:5 avg_discount")
def _(spark, sf):
    return promos.promo_summary(b.orders(spark, sf))


@query("pro02_performance", f"WITH {PRO} SELECT * FROM pf WHERE uses >= 5", "total_revenue:3 avg_order_value total_discount:5 avg_discount")
def _(spark, sf):
    return promos.promo_performance(_promo(spark, sf))


@query("pro03_first_order_promos", f"WITH {PRO} SELECT * FROM fp", "avg_order_value avg_discount")
def _(spark, sf):
    return promos.first_order_promos(_promo(spark, sf))


@query(
    "pro04_promo_vs_organic",
    f"""WITH {ORD} SELECT CASE WHEN has_promo THEN 'Promo' ELSE 'Organic' END AS has_promo, count(*) AS orders, count(DISTINCT user_id) AS unique_users,
 avg(order_total) AS avg_order_value, count(DISTINCT merchant) AS unique_merchants, {r('count(*)::DOUBLE / count(DISTINCT user_id)', 2)} AS orders_per_user FROM o GROUP BY 1""",
    "avg_order_value",
)
def _(spark, sf):
    return promos.promo_vs_organic(b.orders(spark, sf))


_BYM = f"""{ORD}, g AS (SELECT merchant, count(*) AS total_orders, count(*) FILTER (WHERE has_promo) AS promo_orders, sum(discount_amount) AS total_discount,
 sum(order_total) AS total_revenue FROM o GROUP BY 1 HAVING count(*) >= 10)
SELECT merchant, total_orders, promo_orders, {r('promo_orders::DOUBLE / total_orders * 100', 1)} AS promo_rate, total_discount, total_revenue,
 {r('total_discount / total_revenue * 100', 2)} AS discount_pct_revenue FROM g"""


@query("pro05_by_merchant", f"WITH {_BYM} ORDER BY promo_orders DESC, merchant LIMIT 20", "total_discount:5 total_revenue:3")
def _(spark, sf):
    return promos.promo_by_merchant(b.orders(spark, sf))


@query("dsh17_top_promo_rate", f"WITH {_BYM} ORDER BY promo_rate DESC, merchant LIMIT 10", "total_discount:5 total_revenue:3")
def _(spark, sf):
    all_merchants = promos.promo_by_merchant(b.orders(spark, sf), 1_000_000)
    return all_merchants.orderBy(F.desc("promo_rate"), "merchant").limit(10)


CAN = f"""pu AS (SELECT user_id, count(*) AS n, avg(has_promo::INT) AS s, avg(order_total) AS aov FROM o GROUP BY 1),
pk AS (SELECT *, CASE WHEN n = 1 THEN '{promos.USER_TYPES[5]}' WHEN s = 1 THEN '{promos.USER_TYPES[0]}' WHEN s >= 0.7 THEN '{promos.USER_TYPES[1]}'
  WHEN s >= 0.3 THEN '{promos.USER_TYPES[2]}' WHEN s > 0 THEN '{promos.USER_TYPES[3]}' ELSE '{promos.USER_TYPES[4]}' END AS user_type FROM pu),
pc AS (SELECT user_type, count(*) AS users, avg(n) AS avg_orders, avg(aov) AS avg_order_value, {pct('count(*)', '(SELECT count(*) FROM pk)', 1)} AS pct_of_users FROM pk GROUP BY 1)"""


@query("pro06_cannibalization", f"WITH {ORD}, {CAN} SELECT * FROM pc", "avg_orders avg_order_value")
def _(spark, sf):
    return promos.promo_cannibalization(b.orders(spark, sf))


@query(
    "pro07_timing",
    f"WITH {ORD} SELECT hour(event_time) AS hour, count(*) AS orders, {r('avg(has_promo::INT) * 100', 1)} AS promo_rate FROM o GROUP BY 1",
)
def _(spark, sf):
    return promos.promo_timing(b.orders(spark, sf))


@query(
    "pro08_payment_methods",
    f"""WITH {ORD} SELECT payment_method, count(*) AS orders, count(*) FILTER (WHERE has_promo) AS promo_orders, {r('avg(has_promo::INT) * 100', 1)} AS promo_rate,
 avg(order_total) AS avg_order_value FROM o GROUP BY 1""",
    "avg_order_value",
)
def _(spark, sf):
    return promos.payment_methods(b.orders(spark, sf))


@query(
    "pro09_effectiveness",
    f"""WITH {PRO}, j AS (SELECT pf.*, coalesce(fp.retention_rate, 0) AS retention_rate FROM pf LEFT JOIN fp USING (promo_code) WHERE uses >= 3)
SELECT promo_code, uses, unique_users, {r(f"{rank_pct('first_order_rate')} * 100 * 0.30 + {rank_pct('retention_rate')} * 100 * 0.30 + {rank_pct('revenue_per_discount')} * 100 * 0.25 + {rank_pct('unique_users')} * 100 * 0.15", 1)} AS effectiveness_score,
 first_order_rate, retention_rate, revenue_per_discount, avg_order_value, avg_discount FROM j""",
    "avg_order_value avg_discount",
)
def _(spark, sf):
    return promos.promo_effectiveness(_promo(spark, sf))


@query(
    "pro10_recommendations",
    f"""WITH {PRO}, {PSUM}, {CAN},
f AS (SELECT promo_rate, (SELECT max(pct_of_users) FROM pc WHERE user_type = '{promos.USER_TYPES[0]}') AS d, (SELECT count(*) FROM pf WHERE uses >= 3 AND discount_rate > 30) AS h FROM ps)
SELECT 'warning' AS type, 'High Promo Dependency' AS title FROM f WHERE d > 10
UNION ALL SELECT 'opportunity', 'Low Promo Utilization' FROM f WHERE promo_rate < 5
UNION ALL SELECT 'warning', 'High Discount Promos' FROM f WHERE h > 0""",
)
def _(spark, sf):
    return promos.promo_recommendations(_promo(spark, sf)).select("type", "title")


# --- searches ---------------------------------------------------------------------------------

SRCH = f"{EV}, {SE}, bu AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'purchase' AND user_id % 3 > 0)"


def _buying_events(spark, sf):
    """Every user buys in these tables; a third are treated as non-buyers so that rates vary."""
    return b.events(spark, sf).where((F.col("event_type") != "purchase") | (F.col("user_id") % 3 > 0))


SSUM = f"""sm AS (SELECT count(*) AS total_searches, count(DISTINCT user_id) AS unique_searchers, count(DISTINCT query) AS unique_queries,
 {r('count(*)::DOUBLE / count(DISTINCT user_id)', 2)} AS searches_per_user, {pct('count(*) FILTER (WHERE zero_results)', 'count(*)', 1)} AS zero_result_rate,
 {pct('(SELECT count(DISTINCT user_id) FROM se SEMI JOIN bu USING (user_id))', 'count(DISTINCT user_id)', 1)} AS search_to_order_rate,
 {r('avg(results_count)', 1)} AS avg_results_per_search FROM se)"""
STOP = f"""st AS (SELECT query, count(*) AS searches, count(DISTINCT se.user_id) AS unique_users, {r('avg(results_count)', 1)} AS avg_results,
 {r('count(*) FILTER (WHERE zero_results)::DOUBLE / count(*) * 100', 1)} AS zero_result_rate,
 {r('count(DISTINCT bu.user_id)::DOUBLE / count(DISTINCT se.user_id) * 100', 1)} AS conversion_rate FROM se LEFT JOIN bu ON bu.user_id = se.user_id GROUP BY 1),
tp AS (SELECT row_number() OVER (ORDER BY searches DESC, query) AS rank, * FROM st)"""


@query("sea01_summary", f"WITH {SRCH}, {SSUM} SELECT * FROM sm")
def _(spark, sf):
    return searches.search_summary(b.searches(spark, sf), _buying_events(spark, sf), V)


@query("sea02_top_searches", f"WITH {SRCH}, {STOP} SELECT * FROM tp WHERE rank <= 50")
def _(spark, sf):
    return searches.top_searches(b.searches(spark, sf), _buying_events(spark, sf), V)


@query(
    "sea03_zero_results",
    f"""WITH {SRCH}, z AS (SELECT query, count(*) AS occurrences, count(DISTINCT user_id) AS unique_users FROM se WHERE zero_results GROUP BY 1)
SELECT *, {sql_bins('occurrences', searches.PRIORITY_EDGES, searches.PRIORITIES)} AS priority FROM z ORDER BY occurrences DESC, query LIMIT 30""",
)
def _(spark, sf):
    return searches.zero_result_searches(b.searches(spark, sf))


@query(
    "sea04_funnel",
    f"""WITH {SRCH}, w AS (SELECT DISTINCT user_id FROM se),
e2 AS (SELECT user_id, event_type FROM ev WHERE event_type <> 'purchase' OR user_id % 3 > 0)
SELECT t.n::BIGINT AS step_number, label AS step, count(DISTINCT e2.user_id) AS searchers, count(DISTINCT e2.user_id)::DOUBLE / (SELECT count(*) FROM w) * 100 AS pct_of_searchers
FROM (VALUES (1, 'view', 'View'), (2, 'view', 'View'), (3, 'click', 'Click'), (4, 'purchase', 'Purchase')) t(n, ty, label)
LEFT JOIN (e2 SEMI JOIN w USING (user_id)) ON e2.event_type = ty GROUP BY 1, 2""",
    "pct_of_searchers",
)
def _(spark, sf):
    return searches.search_funnel(b.searches(spark, sf), _buying_events(spark, sf), V)


@query(
    "sea05_by_hour",
    f"""WITH {SRCH} SELECT hour(event_time) AS hour, count(*) AS searches, count(DISTINCT user_id) AS unique_searchers,
 {r('count(*) FILTER (WHERE zero_results)::DOUBLE / count(*) * 100', 1)} AS zero_result_rate, {r('count(*)::DOUBLE / count(DISTINCT user_id)', 2)} AS searches_per_user FROM se GROUP BY 1""",
)
def _(spark, sf):
    return searches.searches_by_hour(b.searches(spark, sf))


_CATS = "CASE " + " ".join(f"WHEN regexp_matches(query, '{'|'.join(ws)}') THEN '{n}'" for n, ws in searches.CATEGORIES) + " ELSE 'Other' END"


@query(
    "sea06_categories",
    f"""WITH {SRCH}, c AS (SELECT *, {_CATS} AS category FROM se) SELECT category, count(*) AS searches, count(DISTINCT user_id) AS unique_users,
 {r('count(*) FILTER (WHERE zero_results)::DOUBLE / count(*) * 100', 1)} AS zero_result_rate, {pct('count(*)', '(SELECT count(*) FROM se)', 1)} AS pct_of_searches FROM c GROUP BY 1""",
)
def _(spark, sf):
    return searches.search_categories(b.searches(spark, sf))


@query(
    "sea07_refinements",
    f"""WITH {SRCH}, g AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM se),
n AS (SELECT user_id, sum(CASE WHEN gap IS NULL OR gap > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g),
c AS (SELECT count(*) AS search_count FROM n GROUP BY user_id, s)
SELECT search_count, count(*) AS sessions, {pct('count(*)', '(SELECT count(*) FROM c)', 1)} AS pct,
 {pct('(SELECT count(*) FROM c WHERE search_count >= 2)', '(SELECT count(*) FROM c)', 1)} AS refinement_rate FROM c GROUP BY 1""",
)
def _(spark, sf):
    return searches.search_refinements(b.searches(spark, sf), 720)


@query(
    "sea08_recommendations",
    f"""WITH {SRCH}, {SSUM}, {STOP}, f AS (SELECT *, (SELECT count(*) FROM tp WHERE rank <= 20 AND searches >= 10 AND conversion_rate < 10) AS weak FROM sm)
SELECT 'warning' AS type, 'High Zero-Result Rate (' || zero_result_rate || '%)' AS title FROM f WHERE zero_result_rate > 10
UNION ALL SELECT 'opportunity', 'Low Search Conversion (' || search_to_order_rate || '%)' FROM f WHERE search_to_order_rate < 30
UNION ALL SELECT 'opportunity', 'High-Volume Low-Converting Searches' FROM f WHERE weak > 0""",
)
def _(spark, sf):
    return searches.search_recommendations(b.searches(spark, sf), _buying_events(spark, sf), V).select("type", "title")


# --- deliveries -------------------------------------------------------------------------------


def _c(spark, sf):
    return b.checkouts(spark, sf)


def _m(spark, sf):
    return b.matched(spark, sf)


DSUM = f"""ds AS (SELECT count(*) AS total_orders, count(DISTINCT user_id) AS unique_customers, {pct('(SELECT count(*) FROM lineitem)', 'count(*)', 1)} AS fulfillment_rate,
 {r('(SELECT avg(minutes) FROM v)', 1)} AS avg_delivery_time_min, {r('(SELECT quantile_cont(minutes, 0.5) FROM v)', 1)} AS median_delivery_time_min, true AS has_delivery_data FROM c)"""


@query("del01_summary", f"WITH {DEL}, {DSUM} SELECT * FROM ds")
def _(spark, sf):
    return deliveries.delivery_summary(_c(spark, sf), _m(spark, sf), b.delivered(spark, sf))


@query("del01_order_types", f"WITH {DEL} SELECT order_type, count(*) AS orders FROM c GROUP BY 1")
def _(spark, sf):
    return deliveries.order_types(_c(spark, sf))


@query(
    "del02_time_distribution",
    f"""WITH {DEL}, g AS (SELECT {sql_bins('minutes', deliveries.TIME_EDGES, deliveries.TIME_LABELS)} AS bk, count(*) AS n FROM v GROUP BY 1)
SELECT label AS delivery_time, coalesce(n, 0) AS orders, {pct('coalesce(n, 0)', '(SELECT sum(n) FROM g)', 1)} AS pct FROM (VALUES {values(deliveries.TIME_LABELS)}) t(position, label) LEFT JOIN g ON bk = label""",
)
def _(spark, sf):
    return deliveries.time_distribution(_m(spark, sf))


@query(
    "del03_by_hour",
    f"""WITH {DEL}, h AS (SELECT hour(event_time) AS hour, avg(minutes) AS avg_delivery_time, quantile_cont(minutes, 0.5) AS median_delivery_time FROM v GROUP BY 1)
SELECT q.hour, orders, avg_delivery_time, median_delivery_time, {slot_sql('q.hour', deliveries.SLOTS, 'Late Night')} AS time_slot
FROM (SELECT hour(event_time) AS hour, count(*) AS orders FROM c GROUP BY 1) q LEFT JOIN h ON h.hour = q.hour""",
    "avg_delivery_time median_delivery_time",
)
def _(spark, sf):
    return deliveries.delivery_by_hour(_c(spark, sf), _m(spark, sf))


PEAK = """ph AS (SELECT hour(t) AS hour, avg(n) AS avg_orders, quantile_cont(n::DOUBLE, 0.5) AS median_orders, max(n) AS max_orders, quantile_cont(n::DOUBLE, 0.95) AS p95_orders
 FROM (SELECT date_trunc('hour', event_time) AS t, count(*) AS n FROM c GROUP BY 1) GROUP BY 1),
pk AS (SELECT *, avg_orders >= (SELECT quantile_cont(avg_orders, 0.75) FROM ph) AS is_peak FROM ph)"""


@query("del04_peak_hours", f"WITH {DEL}, {PEAK} SELECT * FROM pk", "avg_orders median_orders p95_orders")
def _(spark, sf):
    return deliveries.peak_hours(_c(spark, sf))


MDEL = """md AS (SELECT g.*, avg_delivery_time, median_delivery_time, delivered_orders FROM
 (SELECT merchant, count(*) AS orders, avg(order_total) AS avg_order_value, avg(delivery_fee) AS avg_delivery_fee FROM c GROUP BY 1 HAVING count(*) >= 10) g
 LEFT JOIN (SELECT merchant, avg(minutes) AS avg_delivery_time, quantile_cont(minutes, 0.5) AS median_delivery_time, count(*) AS delivered_orders FROM v GROUP BY 1) h USING (merchant))"""
_MD = "avg_order_value avg_delivery_fee avg_delivery_time median_delivery_time"


def _perf(spark, sf):
    return deliveries.merchant_performance(_c(spark, sf), _m(spark, sf))


@query("del05_merchants", f"WITH {DEL}, {MDEL} SELECT * FROM md", _MD)
def _(spark, sf):
    return _perf(spark, sf)


@query("dsh18_fastest", f"WITH {DEL}, {MDEL} SELECT * FROM md WHERE avg_delivery_time IS NOT NULL ORDER BY avg_delivery_time, merchant LIMIT 15", _MD)
def _(spark, sf):
    return deliveries.fastest_merchants(_perf(spark, sf))


@query("dsh18_slowest", f"WITH {DEL}, {MDEL} SELECT * FROM md WHERE avg_delivery_time IS NOT NULL ORDER BY avg_delivery_time DESC, merchant LIMIT 15", _MD)
def _(spark, sf):
    return deliveries.slowest_merchants(_perf(spark, sf))


RE = f"""rc AS (SELECT user_id, count(*) > 1 AS again FROM c GROUP BY 1),
rg AS (SELECT {sql_bins('minutes', deliveries.REORDER_EDGES, deliveries.REORDER_LABELS)} AS bk, count(*) AS orders, count(DISTINCT user_id) AS unique_users,
 {r('avg(again::INT) * 100', 1)} AS reorder_rate FROM v JOIN rc USING (user_id) GROUP BY 1),
ri AS (SELECT label AS delivery_time, coalesce(orders, 0) AS orders, coalesce(unique_users, 0) AS unique_users, reorder_rate
 FROM (VALUES {values(deliveries.REORDER_LABELS)}) t(position, label) LEFT JOIN rg ON bk = label)"""


@query("del06_reorder_impact", f"WITH {DEL}, {RE} SELECT * FROM ri")
def _(spark, sf):
    return deliveries.reorder_impact(_c(spark, sf), _m(spark, sf))


@query(
    "del07_order_types",
    f"""WITH {DEL} SELECT order_type, count(*) AS orders, count(DISTINCT user_id) AS unique_customers, avg(order_total) AS avg_order_value, avg(delivery_fee) AS avg_delivery_fee,
 {pct('count(*)', '(SELECT count(*) FROM c)', 1)} AS pct_of_orders FROM c GROUP BY 1""",
    "avg_order_value avg_delivery_fee",
)
def _(spark, sf):
    return deliveries.order_type_analysis(_c(spark, sf))


@query(
    "del08_fee_impact",
    f"""WITH {DEL}, g AS (SELECT {sql_bins('delivery_fee', deliveries.FEE_EDGES, deliveries.FEE_LABELS)} AS bk, count(*) AS n, count(DISTINCT user_id) AS u, avg(order_total) AS a FROM c WHERE delivery_fee > 0 GROUP BY 1)
SELECT label AS delivery_fee, coalesce(n, 0) AS orders, coalesce(u, 0) AS unique_customers, a AS avg_order_value, {pct('coalesce(n, 0)', '(SELECT sum(n) FROM g)', 1)} AS pct_of_orders
FROM (VALUES {values(deliveries.FEE_LABELS)}) t(position, label) LEFT JOIN g ON bk = label""",
    "avg_order_value",
)
def _(spark, sf):
    return deliveries.fee_impact(_c(spark, sf))


@query(
    "del09_recommendations",
    f"""WITH {DEL}, {DSUM}, {PEAK}, {RE},
f AS (SELECT *, (SELECT count(*) FROM pk WHERE is_peak) AS n, (SELECT max(reorder_rate) FROM ri WHERE delivery_time = '<30 min') - (SELECT max(reorder_rate) FROM ri WHERE delivery_time = '90+ min') AS gain FROM ds)
SELECT 'warning' AS type, 'Low Fulfillment Rate (' || fulfillment_rate || '%)' AS title FROM f WHERE fulfillment_rate < 90
UNION ALL SELECT 'warning', 'High Average Delivery Time (' || CAST(round_even(avg_delivery_time_min, 0) AS BIGINT) || ' min)' FROM f WHERE avg_delivery_time_min > 45
UNION ALL SELECT 'info', n || ' Peak Hours Identified' FROM f WHERE n > 0
UNION ALL SELECT 'insight', 'Fast Delivery Drives Retention' FROM f WHERE gain > 10""",
)
def _(spark, sf):
    return deliveries.delivery_recommendations(_c(spark, sf), _m(spark, sf), b.delivered(spark, sf)).select("type", "title")


# --- trending ---------------------------------------------------------------------------------

_T = "count(*) AS order_count, count(DISTINCT user_id) AS unique_customers"


def top_sql(inner: str, order: str, n: int, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"SELECT * FROM (SELECT row_number() OVER ({p}ORDER BY {order}) AS rank, * FROM ({inner})) WHERE rank <= {n}"


@query(
    "tre01_base_stats",
    f"WITH {ORD} SELECT merchant, {_T}, sum(order_total) AS total_revenue, count(*)::DOUBLE / count(DISTINCT user_id) AS orders_per_customer FROM o GROUP BY 1",
    "total_revenue:3 orders_per_customer",
)
def _(spark, sf):
    return trending.base_stats(b.orders(spark, sf))


@query(
    "tre02_popular_now",
    f"WITH {ORD} " + top_sql(f"SELECT merchant, {_T}, count(*)::DOUBLE / count(DISTINCT user_id) AS orders_per_customer FROM o GROUP BY 1 HAVING count(*) >= 5", "order_count DESC, merchant", 20),
    "orders_per_customer",
)
def _(spark, sf):
    return trending.popular_now(b.orders(spark, sf))


@query("tre03_popular_by_slot", f"WITH {ORD} " + top_sql(f"SELECT {SLOT} AS time_slot, merchant, {_T} FROM o GROUP BY 1, 2", "order_count DESC, merchant", 10, "time_slot"))
def _(spark, sf):
    return trending.popular_by_slot(b.orders(spark, sf))


@query("tre03_popular_late_night", f"WITH {ORD} " + top_sql(f"SELECT merchant, {_T}, 'late_night' AS time_slot FROM o WHERE {SLOT} = 'late_night' GROUP BY 1", "order_count DESC, merchant", 10))
def _(spark, sf):
    return trending.popular_by_time(b.orders(spark, sf), "late_night")


@query("tre04_popular_per_platform", f"WITH {ORD} " + top_sql(f"SELECT platform, merchant, {_T} FROM o GROUP BY 1, 2", "order_count DESC, merchant", 10, "platform"))
def _(spark, sf):
    return trending.popular_per_platform(b.orders(spark, sf))


@query("tre04_popular_ios", f"WITH {ORD} " + top_sql(f"SELECT merchant, {_T}, 'ios' AS platform FROM o WHERE platform = 'ios' GROUP BY 1", "order_count DESC, merchant", 10))
def _(spark, sf):
    return trending.popular_by_platform(b.orders(spark, sf), "ios")


@query(
    "tre05_velocity",
    f"WITH {ORD} " + top_sql("SELECT merchant, count(*) AS order_count, count(*) / (SELECT (max(us) - min(us)) / 3600000000.0::DOUBLE FROM o) AS orders_per_hour FROM o GROUP BY 1 HAVING count(*) >= 3", "order_count DESC, merchant", 10),
    "orders_per_hour",
)
def _(spark, sf):
    return trending.trending_velocity(b.orders(spark, sf))


@query(
    "tre06_categories",
    f"WITH {ORD} SELECT category, {_T}, count(DISTINCT merchant) AS merchant_count, {pct('count(*)', '(SELECT count(*) FROM o)', 1)} AS pct_of_orders FROM o GROUP BY 1",
)
def _(spark, sf):
    return trending.category_breakdown(b.orders(spark, sf))


# Single-order customers are rare in these tables: orders of one in ten users are cut to their first line.
def with_new_customers(spark, sf):
    o = b.orders(spark, sf)
    f = o.groupBy("user_id").agg(F.min(F.struct("event_time", "event_id")).alias("_f"))
    return o.join(f, "user_id").where((F.col("user_id") % 10 > 0) | (F.struct("event_time", "event_id") == F.col("_f"))).drop("_f")


NEW = f"""{ORD}, o2 AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS k FROM o) WHERE user_id % 10 > 0 OR k = 1),
nw AS (SELECT merchant, count(*) AS new_customer_orders FROM o2 WHERE user_id IN (SELECT user_id FROM o2 GROUP BY 1 HAVING count(*) = 1) GROUP BY 1)"""


@query(
    "tre07_new_customer_favorites",
    f"""WITH {NEW} SELECT rank, merchant, new_customer_orders, order_count, {pct('new_customer_orders', 'order_count', 1)} AS new_customer_pct
FROM ({top_sql('SELECT * FROM nw', 'new_customer_orders DESC, merchant', 10)}) JOIN (SELECT merchant, count(*) AS order_count FROM o2 GROUP BY 1) USING (merchant)""",
)
def _(spark, sf):
    return trending.new_customer_favorites(with_new_customers(spark, sf))


@query(
    "tre08_repeat_favorites",
    f"WITH {ORD}, mu AS (SELECT merchant, user_id, count(*) AS n FROM o GROUP BY 1, 2) "
    + top_sql(f"SELECT merchant, count(*) AS total_customers, count(*) FILTER (WHERE n > 1) AS repeat_customers, {r('count(*) FILTER (WHERE n > 1)::DOUBLE / count(*) * 100', 1)} AS repeat_rate FROM mu GROUP BY 1 HAVING count(*) >= 5", "repeat_rate DESC, merchant", 10),
)
def _(spark, sf):
    return trending.repeat_customer_favorites(b.orders(spark, sf))


@query(
    "tre09_weekend_weekday",
    f"WITH {ORD} " + top_sql("SELECT CASE WHEN isodow(event_time) IN (5, 6) THEN 'weekend' ELSE 'weekday' END AS period, merchant, count(*) AS order_count FROM o GROUP BY 1, 2", "order_count DESC, merchant", 10, "period"),
)
def _(spark, sf):
    return trending.weekend_vs_weekday(b.orders(spark, sf))


@query(
    "tre10_for_context",
    f"""WITH {NEW}, sl AS ({top_sql("SELECT merchant, count(*) AS order_count FROM o2 WHERE hour(event_time) >= 11 AND hour(event_time) < 15 GROUP BY 1", 'order_count DESC, merchant', 20)}),
io AS ({top_sql("SELECT merchant, count(*) AS c FROM o2 WHERE platform = 'ios' GROUP BY 1", 'c DESC, merchant', 20)})
SELECT row_number() OVER (ORDER BY (io.merchant IS NOT NULL) DESC, order_count DESC, sl.merchant) AS rank, sl.merchant AS merchant, order_count, 'lunch | ios | new_user' AS context
FROM sl LEFT JOIN io ON io.merchant = sl.merchant ORDER BY rank LIMIT 10""",
)
def _(spark, sf):
    return trending.for_context(with_new_customers(spark, sf), 12, "ios", True)


@query(
    "tre11_summary",
    f"""WITH {ORD} SELECT count(*) AS total_orders, count(DISTINCT merchant) AS unique_merchants, count(DISTINCT user_id) AS unique_customers, min(event_time) AS start, max(event_time) AS "end",
 count(*)::DOUBLE / count(DISTINCT user_id) AS avg_orders_per_customer, count(*)::DOUBLE / count(DISTINCT merchant) AS avg_orders_per_merchant FROM o""",
    "avg_orders_per_customer avg_orders_per_merchant",
)
def _(spark, sf):
    return trending.summary(b.orders(spark, sf))


@query(
    "dsh15_platform_overlap",
    f"""WITH {ORD}, a AS ({top_sql("SELECT merchant, count(*) AS c FROM o WHERE platform = 'ios' GROUP BY 1", 'c DESC, merchant', 10)}),
z AS ({top_sql("SELECT merchant, count(*) AS c FROM o WHERE platform = 'android' GROUP BY 1", 'c DESC, merchant', 10)})
SELECT coalesce(a.merchant, z.merchant) AS merchant, CASE WHEN a.merchant IS NOT NULL AND z.merchant IS NOT NULL THEN 'both' WHEN a.merchant IS NOT NULL THEN 'ios_only' ELSE 'android_only' END AS listed_on
FROM a FULL JOIN z ON a.merchant = z.merchant""",
)
def _(spark, sf):
    return trending.platform_overlap(b.orders(spark, sf))

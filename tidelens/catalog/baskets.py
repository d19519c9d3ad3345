"""Basket affinity over line items: basket = order, product = part name, merchant = supplier."""

from __future__ import annotations

from tidelens.catalog import bindings as b
from tidelens.catalog.bindings import LIN, ORD
from tidelens.catalog.registry import query
from tidelens.operators import affinity

_SAME_DAY = f"""{ORD}, ud AS (SELECT DISTINCT user_id, event_time::DATE AS d, merchant FROM o),
pr AS (SELECT x.merchant AS merchant_1, y.merchant AS merchant_2, count(*) AS n FROM ud x JOIN ud y ON x.user_id = y.user_id AND x.d = y.d AND x.merchant < y.merchant GROUP BY 1, 2)"""


@query("aff01_merchant_affinity", f"WITH {_SAME_DAY} SELECT merchant_1, merchant_2, n AS co_occurrence FROM pr")
def _(spark, sf):
    return affinity.merchant_affinity(b.orders(spark, sf))


@query("aff01_top_affinity", f"WITH {_SAME_DAY} SELECT merchant_1, merchant_2, n AS co_occurrence FROM pr ORDER BY n DESC, 1, 2 LIMIT 50")
def _(spark, sf):
    """The 50 most frequent pairs, found with bounds instead of all pairs."""
    return affinity.merchant_affinity(b.orders(spark, sf), n=50)


@query("aff10_complementary", f"WITH {_SAME_DAY} SELECT merchant_1, merchant_2, n AS same_day_orders FROM pr ORDER BY n DESC, 1, 2 LIMIT 20")
def _(spark, sf):
    return affinity.complementary_merchants(b.orders(spark, sf))


@query(
    "aff09_substitutes",
    f"""WITH {ORD}, q AS (SELECT merchant, lag(merchant) OVER (PARTITION BY user_id ORDER BY us, event_id) AS p FROM o)
SELECT least(merchant, p) AS merchant_1, greatest(merchant, p) AS merchant_2, count(*) AS switch_count FROM q
WHERE p IS NOT NULL AND p <> merchant GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""",
)
def _(spark, sf):
    return affinity.merchant_substitutes(b.orders(spark, sf))


BK = f"""{LIN}, bk AS (SELECT DISTINCT order_id, product_name FROM l), tot AS (SELECT count(DISTINCT order_id) AS n FROM l),
pc AS (SELECT x.product_name AS a, y.product_name AS z, count(*) AS c FROM bk x JOIN bk y ON x.order_id = y.order_id AND x.product_name < y.product_name GROUP BY 1, 2),
fq AS (SELECT product_name, count(*) AS f FROM bk GROUP BY 1)"""


@query(
    "aff02_product_pairs",
    f"WITH {BK} SELECT a AS product_1, z AS product_2, c AS co_occurrence, c::DOUBLE / n * 100 AS support FROM pc, tot WHERE c >= 2",
    "support",
)
def _(spark, sf):
    return affinity.product_pairs(b.lines(spark, sf))


MIN_SUPPORT, MIN_CONFIDENCE = 0.004, 0.07
RULES = f"""{BK}, bo AS (SELECT a AS antecedent, z AS consequent, c FROM pc UNION ALL SELECT z, a, c FROM pc),
ru AS (SELECT antecedent, consequent, c::DOUBLE / n * 100 AS support, c::DOUBLE / fa.f * 100 AS confidence, (c::DOUBLE / fa.f) / (fb.f::DOUBLE / n) AS lift, c AS count
  FROM bo CROSS JOIN tot JOIN fq fa ON fa.product_name = antecedent JOIN fq fb ON fb.product_name = consequent
  WHERE c::DOUBLE / n >= {MIN_SUPPORT} AND c::DOUBLE / fa.f >= {MIN_CONFIDENCE})"""
_BEST = "round(lift, 9) DESC, count DESC, antecedent, consequent"


def _rules(spark, sf):
    return affinity.association_rules(b.lines(spark, sf), MIN_SUPPORT, MIN_CONFIDENCE)


@query("aff03_association_rules", f"WITH {RULES} SELECT * FROM ru", "support confidence lift")
def _(spark, sf):
    return _rules(spark, sf)


@query("dsh21_positive_rules", f"WITH {RULES} SELECT * FROM ru WHERE lift > 1", "support confidence lift")
def _(spark, sf):
    return affinity.positive_rules(_rules(spark, sf))


@query(
    "aff04_bundles",
    f"""WITH {RULES}, t AS (SELECT *, row_number() OVER (ORDER BY {_BEST}) AS k FROM ru WHERE lift > 1.5 QUALIFY k <= 20),
d AS (SELECT *, row_number() OVER (PARTITION BY least(antecedent, consequent), greatest(antecedent, consequent) ORDER BY k) AS j FROM t)
SELECT antecedent AS product_1, consequent AS product_2, lift, confidence, 'Customers who buy ''' || antecedent || ''' often also buy ''' || consequent || '''' AS recommendation,
 CASE WHEN lift > 2 THEN 'strong' ELSE 'moderate' END AS bundle_strength FROM d WHERE j = 1 ORDER BY k LIMIT 10""",
    "lift confidence",
)
def _(spark, sf):
    return affinity.bundles(_rules(spark, sf))


@query(
    "aff05_cross_sell",
    f"WITH {RULES} SELECT consequent AS recommended_product, confidence, lift FROM ru WHERE lower(antecedent) = 'red widget' ORDER BY {_BEST} LIMIT 5",
    "lift confidence",
)
def _(spark, sf):
    return affinity.cross_sell(_rules(spark, sf), "Red Widget").drop("reason")


@query(
    "aff06_merchant_bundles",
    f"""WITH {LIN}, bk AS (SELECT DISTINCT merchant, order_id, product_name FROM l),
pc AS (SELECT x.merchant, x.product_name AS a, y.product_name AS z, count(*) AS c FROM bk x JOIN bk y ON x.merchant = y.merchant AND x.order_id = y.order_id AND x.product_name < y.product_name GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY c DESC, a, z) AS k FROM pc)
SELECT merchant, a AS product_1, z AS product_2, c AS co_occurrence, total_orders FROM t JOIN (SELECT merchant, count(DISTINCT order_id) AS total_orders FROM l GROUP BY 1) USING (merchant) WHERE k = 1""",
)
def _(spark, sf):
    return affinity.merchant_top_bundles(b.lines(spark, sf))


@query(
    "aff07_upsell",
    f"""WITH {LIN}, sz AS (SELECT order_id, count(*) AS n FROM l GROUP BY 1),
al AS (SELECT product_name AS base_product, count(*) AS single_orders FROM l JOIN sz USING (order_id) WHERE n = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
ml AS (SELECT order_id, product_name FROM l JOIN sz USING (order_id) WHERE n > 1),
bo AS (SELECT DISTINCT order_id, base_product FROM ml JOIN al ON product_name = base_product),
co AS (SELECT base_product, product_name, count(*) AS c FROM bo JOIN ml USING (order_id) WHERE product_name <> base_product GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY base_product ORDER BY c DESC, product_name) AS k FROM co)
SELECT base_product, single_orders, max(product_name) FILTER (WHERE k = 1) AS upsell_suggestion_1, max(product_name) FILTER (WHERE k = 2) AS upsell_suggestion_2,
 max(product_name) FILTER (WHERE k = 3) AS upsell_suggestion_3 FROM al JOIN rk USING (base_product) GROUP BY 1, 2""",
)
def _(spark, sf):
    return affinity.upsell(b.lines(spark, sf))


@query(
    "aff08_summary",
    f"""WITH {LIN}, po AS (SELECT order_id, count(*) AS n FROM l GROUP BY 1)
SELECT count(*) AS total_transactions, avg(n) AS avg_basket_size, max(n) AS max_basket_size, avg((n > 1)::INT) * 100 AS multi_item_order_rate,
 (SELECT count(DISTINCT product_name) FROM l) AS unique_products, (SELECT count(DISTINCT merchant) FROM l) AS unique_merchants FROM po""",
    "avg_basket_size multi_item_order_rate",
)
def _(spark, sf):
    return affinity.affinity_summary(b.lines(spark, sf))

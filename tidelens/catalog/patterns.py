"""Rings of users, lasting shifts of hourly series, customer trajectories, and ranges of a partitioned event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelens.catalog import bindings as b
from tidelens.catalog.bindings import EV
from tidelens.catalog.registry import query
from tidelens.catalog.scans import RAW, _RAW_SQL
from tidelens.functions.tables import new_path
from tidelens.operators import anomalies, trajectories
from tidelens.sources import events as ev
from tidelens.sources.sinks import write_events

V = b.VOCAB

# Users who do the same thing within the same second share a value, and so do those of one purchase amount.
SHARED = f"""{EV}, av AS (SELECT DISTINCT user_id, 's' AS attribute, event_type || (us // 1000000)::VARCHAR AS value FROM ev
 UNION SELECT DISTINCT user_id, 'v', (round_even(order_total * 100, 0)::BIGINT)::VARCHAR FROM ev WHERE event_type = 'purchase'),
gr AS (SELECT attribute, value, min(user_id) AS a FROM av GROUP BY 1, 2 HAVING count(*) > 1),
ln AS (SELECT a, user_id AS b FROM av JOIN gr USING (attribute, value) WHERE user_id <> a),
eg AS (SELECT a, b FROM ln UNION SELECT b, a FROM ln),
re AS (SELECT a AS id, a AS reached FROM eg UNION SELECT re.id, eg.b FROM re JOIN eg ON eg.a = re.reached),
co AS (SELECT id, min(reached) AS ring FROM re GROUP BY 1),
pu AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS o, sum(order_total) FILTER (WHERE event_type = 'purchase') AS r FROM ev GROUP BY 1),
br AS (SELECT ring, count(*) AS users, CAST(sum(n) AS BIGINT) AS events, CAST(sum(o) AS BIGINT) AS orders, coalesce(sum(r), 0) AS revenue, avg((o > 0)::INT) AS ordering_share
 FROM co JOIN pu ON id = user_id GROUP BY 1 HAVING count(*) >= 3 AND sum(o) >= 1),
vs AS (SELECT ring, count(*) AS shared_values FROM gr JOIN co ON id = a GROUP BY 1)"""


@query(
    "ano10_fraud_patterns",
    f"WITH RECURSIVE {SHARED} SELECT ring, users, shared_values, events, orders, revenue, orders::DOUBLE / users AS orders_per_user, ordering_share FROM br JOIN vs USING (ring)",
    "revenue:3 orders_per_user ordering_share",
)
def _(spark, sf):
    e = b.events(spark, sf)
    second = F.concat("event_type", F.floor(F.unix_micros("event_time") / F.lit(1_000_000)).cast("string"))
    amount = F.when(F.col("event_type") == "purchase", F.rint(F.col("order_total") * 100).cast("long"))
    return anomalies.fraud_patterns(e.withColumn("second", second).withColumn("amount", amount), ["second", "amount"], V)


SLACK, LIMIT = 0.25, 3.0
HOURLY = f"""{EV}, hv AS (SELECT date_trunc('hour', event_time) AS hour, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS o FROM ev GROUP BY 1),
se AS (SELECT 'events' AS metric, hour, n::DOUBLE AS value FROM hv UNION ALL SELECT 'orders', hour, o::DOUBLE FROM hv UNION ALL SELECT 'order_share', hour, o::DOUBLE / n FROM hv)"""
CUSUM = f"""{HOURLY}, z AS (SELECT *, (value - avg(value) OVER m) / nullif(stddev_pop(value) OVER m, 0) AS z FROM se WINDOW m AS (PARTITION BY metric)),
st AS (SELECT metric, hour, direction, round_even((CASE WHEN direction = 'up' THEN z ELSE -z END - {SLACK}::DOUBLE) * 1e9, 0) / 1e9 AS step FROM z CROSS JOIN (VALUES ('up'), ('down')) d(direction) WHERE z IS NOT NULL),
tt AS (SELECT *, round_even(sum(step) OVER r * 1e6, 0) / 1e6 AS total FROM st WINDOW r AS (PARTITION BY metric, direction ORDER BY hour)),
sc AS (SELECT *, round_even((total - least(0.0::DOUBLE, min(total) OVER r)) * 1e6, 0) / 1e6 AS score FROM tt WINDOW r AS (PARTITION BY metric, direction ORDER BY hour)),
zr AS (SELECT *, max(CASE WHEN score <= 0 THEN hour END) OVER r AS zero, coalesce(lag(score) OVER r, 0) AS before FROM sc WINDOW r AS (PARTITION BY metric, direction ORDER BY hour)),
al AS (SELECT *, min(hour) OVER (PARTITION BY metric, direction, zero) AS onset FROM zr WHERE score > 0)"""


@query(
    "ano11_systemic_issues",
    f"WITH {CUSUM} SELECT metric, direction, onset, hour AS alarm, score FROM al WHERE score > {LIMIT} AND before <= {LIMIT}",
    "score:4",
)
def _(spark, sf):
    return anomalies.systemic_issues(anomalies.hourly_series(b.events(spark, sf), V), SLACK, LIMIT)


TIERS = (("low", 1), ("medium", 8), ("high", 16))
SLICES = f"""{EV}, mx AS (SELECT max(us // 604800000000) AS m FROM ev),
pt AS (SELECT user_id, us // 604800000000 AS slice, CAST(sum(CASE WHEN event_type = 'purchase' THEN 5 ELSE 1 END) AS BIGINT) AS points FROM ev GROUP BY 1, 2),
al AS (SELECT user_id, unnest(range(min(slice), (SELECT m FROM mx) + 1)) AS slice FROM pt GROUP BY 1),
ti AS (SELECT user_id, slice, coalesce(points, 0) AS points, CASE WHEN points >= 16 THEN 'high' WHEN points >= 8 THEN 'medium' WHEN points >= 1 THEN 'low' ELSE 'inactive' END AS tier FROM al LEFT JOIN pt USING (user_id, slice)),
nx AS (SELECT tier AS from_tier, lead(tier) OVER (PARTITION BY user_id ORDER BY slice) AS to_tier FROM ti),
tr AS (SELECT from_tier, to_tier, count(*) AS moves, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY from_tier) AS probability FROM nx WHERE to_tier IS NOT NULL GROUP BY 1, 2),
sh AS (SELECT tier, count(*) AS users, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM ti WHERE slice = (SELECT m FROM mx) GROUP BY 1),
s1 AS (SELECT to_tier AS tier, sum(share * probability) AS share FROM sh JOIN tr ON tier = from_tier GROUP BY 1),
s2 AS (SELECT to_tier AS tier, sum(share * probability) AS share FROM s1 JOIN tr ON tier = from_tier GROUP BY 1),
s3 AS (SELECT to_tier AS tier, sum(share * probability) AS share FROM s2 JOIN tr ON tier = from_tier GROUP BY 1),
s4 AS (SELECT to_tier AS tier, sum(share * probability) AS share FROM s3 JOIN tr ON tier = from_tier GROUP BY 1)"""


def _slices(spark, sf):
    return trajectories.slice_tiers(b.events(spark, sf), 7, V, TIERS)


@query("sco11_tier_transitions", f"WITH {SLICES} SELECT * FROM tr", "probability")
def _(spark, sf):
    return trajectories.transitions(_slices(spark, sf))


@query(
    "sco11_trajectories",
    f"WITH {SLICES} SELECT 0::BIGINT AS step, tier, share FROM sh UNION ALL SELECT 1, * FROM s1 UNION ALL SELECT 2, * FROM s2 UNION ALL SELECT 4, * FROM s4",
    "share",
)
def _(spark, sf):
    """Shares of the tiers now and after one, two and four weeks; the settled shares have a query of their own."""
    return trajectories.trajectories(_slices(spark, sf)).where("step >= 0")


@query(
    "sco11_settled_shares",
    f"""WITH RECURSIVE {SLICES}, po AS (SELECT 0 AS k, tier, share FROM sh UNION ALL
 SELECT DISTINCT k + 1, to_tier, sum(share * probability) OVER (PARTITION BY to_tier) FROM po JOIN tr ON tier = from_tier WHERE k < 64)
SELECT tier, share FROM po WHERE k = 64""",
    "share",
)
def _(spark, sf):
    """Shares after 64 weeks, by repeated squaring of the matrix."""
    return trajectories.trajectories(_slices(spark, sf), ()).where("step = -1").drop("step")


@query(
    "sco11_score_changes",
    f"""WITH {SLICES} SELECT user_id, min_by(tier, slice) AS first_tier, max_by(tier, slice) AS last_tier, count(*) AS active_slices,
 min_by(points, slice) AS first_points, max_by(points, slice) AS last_points, max_by(points, slice) - min_by(points, slice) AS change FROM ti WHERE points > 0 GROUP BY 1""",
)
def _(spark, sf):
    return trajectories.score_changes(_slices(spark, sf))


@query("src03_partitioned_range", _RAW_SQL + " WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11'")
def _(spark, sf):
    """The same range from a table that the event sink partitioned by date: other days' folders are not read."""
    raw = b.table(spark, sf, "events")
    path = write_events(raw, new_path(spark, "events-by-date"), RAW.time)
    return ev.load_date_range(spark, path, "2024-01-05", "2024-01-10", "*.parquet", RAW).drop("_source_file")

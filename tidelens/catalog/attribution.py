"""Attribution over the events table: touches are signup, view, click and error, the order is purchase."""

from __future__ import annotations

from tidelens.catalog import bindings as b
from tidelens.catalog.bindings import EV
from tidelens.catalog.registry import query
from tidelens.operators import attribution as att

V = b.VOCAB

# The SQL states the plain definition: every touch of the user in [t - 24h, t).
TOUCHES = f"""{EV},
cv AS (SELECT user_id, us AS t, event_id AS cid FROM ev WHERE event_type = 'purchase'),
tt AS (SELECT cv.user_id, cid, t, us, e.event_type, row_number() OVER (PARTITION BY cid ORDER BY us, e.event_id) AS rn,
              count(*) OVER (PARTITION BY cid) AS n
       FROM cv JOIN ev e ON e.user_id = cv.user_id AND e.us >= t - 86400000000 AND e.us < t
       WHERE e.event_type IN ('signup', 'view', 'click', 'error')),
w AS (SELECT *, pow(2.0, -((t - us) / 3600000000.0::DOUBLE) / 6.0) AS dw FROM tt),
cr AS (SELECT cid, event_type, n, CASE WHEN rn = 1 THEN 1.0::DOUBLE ELSE 0 END AS first_touch,
              CASE WHEN rn = n THEN 1.0::DOUBLE ELSE 0 END AS last_touch, 1.0::DOUBLE / n AS linear,
              dw / sum(dw) OVER (PARTITION BY cid) AS time_decay,
              CASE WHEN n = 1 THEN 1.0::DOUBLE WHEN n = 2 THEN 0.5::DOUBLE WHEN rn = 1 OR rn = n THEN 0.4::DOUBLE
                   ELSE 0.2::DOUBLE / (n - 2) END AS position_based FROM w),
cs AS (SELECT event_type AS touchpoint, sum(first_touch) AS first_touch, sum(last_touch) AS last_touch, sum(linear) AS linear,
              sum(time_decay) AS time_decay, sum(position_based) AS position_based FROM cr GROUP BY 1)"""


def _touches(spark, sf):
    return att.conversion_touches(b.events(spark, sf), V)


def _one(model: str) -> str:
    return f"""WITH {TOUCHES} SELECT '{model}' AS model, touchpoint, {model} AS conversions,
 {model} / sum({model}) OVER () * 100 AS attribution_pct FROM cs WHERE {model} > 1e-9"""


@query(
    "att01_journeys",
    f"""WITH {TOUCHES} SELECT user_id, make_timestamp(t) AS conversion_time, cid AS event_id, count(*) AS journey_length,
 (t - min(us)) / 60000000.0::DOUBLE AS journey_duration_mins FROM tt GROUP BY user_id, t, cid""",
    "journey_duration_mins",
)
def _(spark, sf):
    from pyspark.sql import functions as F

    return _touches(spark, sf).select(
        "user_id", "conversion_time", "event_id", F.col("n").alias("journey_length"), F.col("duration_mins").alias("journey_duration_mins")
    )


@query("att02_first_touch", _one("first_touch"), "conversions attribution_pct")
def _(spark, sf):
    return att.first_touch(_touches(spark, sf), V)


@query("att03_last_touch", _one("last_touch"), "conversions attribution_pct")
def _(spark, sf):
    return att.last_touch(_touches(spark, sf), V)


@query("att04_linear", _one("linear"), "conversions attribution_pct")
def _(spark, sf):
    return att.linear(_touches(spark, sf), V)


@query("att05_time_decay", _one("time_decay"), "conversions attribution_pct")
def _(spark, sf):
    return att.time_decay(_touches(spark, sf), V)


@query("att06_position_based", _one("position_based"), "conversions attribution_pct")
def _(spark, sf):
    return att.position_based(_touches(spark, sf), V)


_PCTS = ", ".join(f"coalesce({m} / sum({m}) OVER () * 100, 0) AS {m}_pct" for m in att.MODELS)


@query(
    "att07_compare_models",
    f"""WITH {TOUCHES} SELECT touchpoint, {_PCTS}
FROM (VALUES ('signup'), ('view'), ('click'), ('error')) t(touchpoint) LEFT JOIN cs USING (touchpoint)""",
    " ".join(f"{m}_pct" for m in att.MODELS),
)
def _(spark, sf):
    return att.compare_models(_touches(spark, sf), V)


@query(
    "att08_journey_stats",
    f"""WITH {TOUCHES}, j AS (SELECT cid, count(*) AS n, (t - min(us)) / 60000000.0::DOUBLE AS d FROM tt GROUP BY cid, t)
SELECT count(*) AS total_conversions, avg(n) AS avg_journey_length, quantile_cont(n::DOUBLE, 0.5) AS median_journey_length,
       avg(d) AS avg_journey_duration_mins, quantile_cont(d, 0.5) AS median_journey_duration_mins FROM j""",
    "avg_journey_length median_journey_length avg_journey_duration_mins median_journey_duration_mins",
)
def _(spark, sf):
    return att.journey_stats(_touches(spark, sf))


@query(
    "att08_top_paths",
    f"""WITH {TOUCHES}, p AS (SELECT cid, string_agg(event_type, ' -> ' ORDER BY rn) AS path FROM tt GROUP BY 1)
SELECT path, count(*) AS count FROM p GROUP BY 1 ORDER BY count DESC, path LIMIT 10""",
)
def _(spark, sf):
    return att.top_paths(b.events(spark, sf), V)


@query(
    "att09_channel_influence",
    f"""WITH {TOUCHES}, f AS (SELECT cid, event_type, n, min(rn) AS p, count(*) AS c FROM tt GROUP BY 1, 2, 3)
SELECT event_type AS touchpoint, CAST(sum(c) AS BIGINT) AS total_appearances, count(*) FILTER (WHERE p = 1) AS as_first_touch,
       count(*) FILTER (WHERE p > 1 AND p = n) AS as_last_touch, count(*) FILTER (WHERE p > 1 AND p < n) AS as_middle_touch,
       sum(c)::DOUBLE / (SELECT count(DISTINCT cid) FROM tt) * 100 AS appearance_rate FROM f GROUP BY 1""",
    "appearance_rate",
)
def _(spark, sf):
    return att.channel_influence(_touches(spark, sf), V)


@query(
    "att10_platform",
    f"""WITH {EV}, g AS (SELECT platform, count(*) FILTER (WHERE event_type = 'purchase') AS conversions, count(DISTINCT user_id) AS total_users
 FROM ev GROUP BY 1)
SELECT platform, conversions, conversions::DOUBLE / sum(conversions) OVER () * 100 AS conversion_pct, total_users,
       conversions::DOUBLE / total_users * 100 AS cvr FROM g WHERE conversions > 0""",
    "conversion_pct cvr",
)
def _(spark, sf):
    return att.platform_attribution(b.events(spark, sf), V)


@query(
    "att11_device",
    f"""WITH {EV}, o AS (SELECT * FROM ev WHERE event_type = 'purchase')
SELECT device_family, count(*) AS conversions, count(*)::DOUBLE / (SELECT count(*) FROM o) * 100 AS conversion_pct
FROM o GROUP BY 1 ORDER BY conversions DESC, device_family LIMIT 10""",
    "conversion_pct",
)
def _(spark, sf):
    return att.device_attribution(b.events(spark, sf), V)


@query(
    "att12_customer_status",
    f"""WITH {EV}, bu AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'purchase'),
h AS (SELECT ev.user_id, coalesce(json_extract_string(props, '$.k'), 'unknown') AS customer_status, bu.user_id IS NOT NULL AS c
      FROM ev LEFT JOIN bu USING (user_id) WHERE event_type = 'signup')
SELECT customer_status, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE c) AS conversions,
       count(*) FILTER (WHERE c)::DOUBLE / count(DISTINCT user_id) * 100 AS cvr FROM h GROUP BY 1""",
    "cvr",
)
def _(spark, sf):
    return att.customer_status_attribution(b.events(spark, sf), V, "k")

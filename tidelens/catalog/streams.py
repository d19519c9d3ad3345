"""Streaming queries: the events table read as a stream, drained, and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelens.catalog import bindings as b
from tidelens.catalog.bindings import EV
from tidelens.catalog.behaviour import sess
from tidelens.catalog.registry import query, twin
from tidelens.models import predictors as pred
from tidelens.operators import sessions
from tidelens.streaming import live_state, streams

V = b.VOCAB
# Rows leave the state when the watermark (one hour behind the latest event) has passed their end.
MARK = "(SELECT max(us) FROM ev) - 3600000000"


def _stream(spark, sf):
    schema = b.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(
        "user_id",
        F.col("ts").cast("timestamp").alias("event_time"),
        "event_type",
        "event_id",
        F.get_json_object("props", "$.k").alias("merchant"),
    )


@query(
    "str01_session_metrics",
    f"""WITH {sess(30)} SELECT user_id, session_start, session_end, event_count, converted, is_bounce FROM ss
WHERE epoch_us(session_end) + 1800000000 <= {MARK}""",
)
def _(spark, sf):
    return streams.run_available(streams.session_metrics(_stream(spark, sf), V))


@query(
    "str02_volume_flags",
    f"""WITH {EV}, h AS (SELECT date_trunc('hour', event_time)::TIMESTAMP AS datetime, hour(event_time) AS hour, count(*) AS events, count(DISTINCT user_id) AS users,
 count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS buyers FROM ev GROUP BY 1, 2),
r AS (SELECT *, buyers::DOUBLE / users AS conversion_rate FROM h),
bl AS (SELECT hour, avg(events) AS mean, stddev_pop(events) AS deviation, avg(conversion_rate) AS sm, stddev_pop(conversion_rate) AS sd FROM r GROUP BY 1),
z AS (SELECT datetime, hour, events, users, buyers, conversion_rate, (events - mean) / NULLIF(deviation, 0) AS z_score, (conversion_rate - sm) / NULLIF(sd, 0) AS conversion_z_score
 FROM r JOIN bl USING (hour) WHERE epoch_us(datetime) + 3600000000 <= {MARK})
SELECT *, CASE WHEN z_score > 1.5 THEN 'spike' WHEN z_score < -1.5 THEN 'drop' ELSE 'normal' END AS anomaly_type,
 CASE WHEN conversion_z_score > 1.5 THEN 'high' WHEN conversion_z_score < -1.5 THEN 'low' ELSE 'normal' END AS conversion_anomaly FROM z""",
    "z_score conversion_rate conversion_z_score",
)
def _(spark, sf):
    base = streams.volume_baseline(b.events(spark, sf), V)
    flags = streams.volume_flags(_stream(spark, sf), base, V, 1.5)
    return streams.run_available(flags)


@query(
    "str03_live_features",
    f"""WITH {sess(30)}, w AS (SELECT *, min(us) OVER s AS s0, count(*) OVER s AS n, max(us) OVER s AS s1,
 max((event_type = 'signup')::INT) OVER s AS a, max((event_type = 'view')::INT) OVER s AS v, max((event_type = 'click')::INT) OVER s AS c,
 max((event_type = 'purchase')::INT) OVER s AS p, max((event_type = 'error')::INT) OVER s AS e
 FROM sx WINDOW s AS (PARTITION BY user_id, sno ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, s0 AS session_start_us, us AS event_us, n AS events_in_session, (a + v + c + p + e)::BIGINT AS unique_events,
 least((s1 - s0) / 60000000.0::DOUBLE, 120) AS session_duration_mins, a::BIGINT AS has_signup, v::BIGINT AS has_view, c::BIGINT AS has_click, 0::BIGINT AS has_checkout_button,
 p::BIGINT AS has_purchase, (a + v + c)::BIGINT AS funnel_depth FROM w""",
)
def _(spark, sf):
    return streams.run_available(streams.live_session_features(_stream(spark, sf), V))


@twin("str03_live_by_state", "str03_live_features")
def _(spark, sf):
    """The same features from a state store."""
    return streams.run_available(live_state.live_session_features(_stream(spark, sf), V))


@query(
    "str03_live_scores",
    f"""WITH {sess(30)} SELECT user_id, min(us) AS session_start_us, count(*) AS events_in_session, true AS as_in_batch FROM sx GROUP BY user_id, sno""",
)
def _(spark, sf):
    """The last live score of every session, and whether it is the batch score of the whole session."""
    model = pred.ConversionPredictor("logistic", V)
    events = b.events(spark, sf)
    batch = model.run(events, "session")["predictions"]
    live = streams.run_available(streams.score_live(streams.live_session_features(_stream(spark, sf), V), model.model, model.columns))
    last = live.groupBy("user_id", "session_start_us").agg(
        F.max("events_in_session").alias("events_in_session"), F.max_by("conversion_probability", "events_in_session").alias("live")
    )
    starts = sessions.sessions(events).select("user_id", "session_key", F.unix_micros("session_start").alias("session_start_us"))
    both = last.join(starts, ["user_id", "session_start_us"]).join(batch.select("session_key", "conversion_probability"), "session_key")
    return both.select("user_id", "session_start_us", "events_in_session", (F.abs(F.col("live") - F.col("conversion_probability")) < 1e-9).alias("as_in_batch"))


@query(
    "str04_trending",
    f"""WITH {EV}, o AS (SELECT json_extract_string(props, '$.k') AS merchant, us FROM ev WHERE event_type = 'purchase'),
w AS (SELECT merchant, (us // 3600000000 - i) * 3600000000 AS ws FROM o CROSS JOIN range(0, 24) t(i)),
c AS (SELECT make_timestamp(ws) AS window_start, make_timestamp(ws + 86400000000) AS window_end, merchant, count(*) AS order_count FROM w
  WHERE ws + 86400000000 <= (SELECT max(us) FROM o) - 3600000000 GROUP BY ws, merchant)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY order_count DESC, merchant) AS rank FROM c) WHERE rank <= 5""",
)
def _(spark, sf):
    orders = _stream(spark, sf).where(F.col("event_type") == "purchase")
    return streams.top_of_windows(streams.run_available(streams.trending_counts(orders)), 5)


@query(
    "str05_delivery_match",
    f"""WITH {EV}, o AS (SELECT user_id, event_time, event_id, us FROM ev WHERE event_type = 'purchase'), d AS (SELECT user_id, event_time AS delivered_at, us AS dus FROM ev WHERE event_type = 'error'),
mk AS (SELECT least((SELECT max(us) FROM o), (SELECT max(dus) FROM d)) - 3600000000 AS m),
j AS (SELECT o.*, delivered_at FROM o LEFT JOIN d ON d.user_id = o.user_id AND dus > us AND dus <= us + 10800000000)
SELECT user_id, event_time, event_id, delivered_at FROM j, mk WHERE delivered_at IS NOT NULL OR us + 10800000000 < m""",
)
def _(spark, sf):
    """Purchases matched with a later 'error' event of the user within three hours; unmatched rows follow the watermark."""
    s = _stream(spark, sf)
    orders = s.where(F.col("event_type") == "purchase").select("user_id", "event_time", "event_id")
    late = _stream(spark, sf).where(F.col("event_type") == "error").select("user_id", F.col("event_time").alias("delivered_at"))
    return streams.run_available(streams.match_deliveries(orders, late, "user_id"))

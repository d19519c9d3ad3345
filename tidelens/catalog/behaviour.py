"""Sessions, funnels, paths and journeys over the events table."""

from __future__ import annotations

from tidelens.catalog import bindings as b
from tidelens.catalog.bindings import EV, STEPS, pct, r, sql_bins, values
from tidelens.catalog.registry import query
from tidelens.operators import funnels, journeys, paths, sessions
from tidelens.operators.sessions import DEPTH_EDGES, DEPTH_LABELS, DURATION_EDGES, DURATION_LABELS

V = b.VOCAB
# A 12-hour timeout gives sessions of several events on these tables; 30 minutes gives mostly single ones.
LONG = 720

_STEPS = values(STEPS)
_LEAD_STEPS = "st AS (SELECT * FROM (VALUES " + _STEPS + ") t(step_number, step))"


def sess(timeout: int) -> str:
    """Session CTEs: numbered events ``sx`` and sessions ``ss``."""
    return f"""{EV},
sg AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM ev),
sn AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > {timeout * 60000000} THEN 1 ELSE 0 END)
              OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sno FROM sg),
sx AS (SELECT *, row_number() OVER (PARTITION BY user_id, sno ORDER BY us, event_id) AS rn FROM sn),
ss AS (SELECT user_id || '_' || sno AS session_key, user_id, min(event_time) AS session_start, max(event_time) AS session_end,
              count(*) AS event_count, first(platform ORDER BY us, event_id) AS platform,
              (max(us) - min(us)) / 60000000.0::DOUBLE AS duration_minutes,
              first(event_type ORDER BY us, event_id) AS entry_event, last(event_type ORDER BY us, event_id) AS exit_event,
              bool_or(event_type = 'purchase') AS converted, count(*) = 1 AS is_bounce
       FROM sx GROUP BY user_id, sno)"""


def _sessions(spark, sf, timeout=LONG):
    return sessions.sessions(b.events(spark, sf), V, timeout)


# --- sessions ---------------------------------------------------------------------------------


@query("ses01_sessions", f"WITH {sess(30)} SELECT * FROM ss")
def _(spark, sf):
    return _sessions(spark, sf, 30)


_SUMMARY = """SELECT count(*) AS total_sessions, count(DISTINCT user_id) AS total_users,
 count(*)::DOUBLE / count(DISTINCT user_id) AS avg_sessions_per_user, avg(duration_minutes) AS avg_session_duration,
 quantile_cont(duration_minutes, 0.5) AS median_session_duration, avg(event_count) AS avg_events_per_session,
 avg(CASE WHEN is_bounce THEN 1.0::DOUBLE ELSE 0 END) * 100 AS bounce_rate,
 avg(CASE WHEN converted THEN 1.0::DOUBLE ELSE 0 END) * 100 AS conversion_rate FROM ss"""


@query(
    "ses02_summary",
    f"WITH {sess(LONG)} {_SUMMARY}",
    "avg_sessions_per_user avg_session_duration median_session_duration avg_events_per_session bounce_rate conversion_rate",
)
def _(spark, sf):
    return sessions.session_summary(_sessions(spark, sf))


@query(
    "ses03_duration_distribution",
    f"""WITH {sess(LONG)},
g AS (SELECT {sql_bins('duration_minutes', DURATION_EDGES, DURATION_LABELS)} AS bk, count(*) AS n,
             {r("avg(CASE WHEN converted THEN 1.0::DOUBLE ELSE 0 END) * 100", 2)} AS cr FROM ss GROUP BY 1)
SELECT label AS duration_bucket, coalesce(n, 0) AS session_count, cr AS conversion_rate,
       {pct('coalesce(n, 0)', 'sum(coalesce(n, 0)) OVER ()', 1)} AS pct_of_sessions
FROM (VALUES {values(DURATION_LABELS)}) t(position, label) LEFT JOIN g ON bk = label""",
)
def _(spark, sf):
    return sessions.duration_distribution(_sessions(spark, sf))


def _rates(key: str, extra: str = "", where: str = "") -> str:
    return f"""SELECT {key}, count(*) AS sessions,
 {r("avg(CASE WHEN is_bounce THEN 1.0::DOUBLE ELSE 0 END) * 100", 1)} AS bounce_rate,
 {r("avg(CASE WHEN converted THEN 1.0::DOUBLE ELSE 0 END) * 100", 2)} AS conversion_rate {extra}
FROM ss {where} GROUP BY 1"""


@query("ses04_bounce_by_entry", f"WITH {sess(LONG)} " + _rates("entry_event", where="WHERE entry_event <> 'purchase'"))
def _(spark, sf):
    return sessions.bounce_rate_by_entry(_sessions(spark, sf), V)


@query(
    "ses05_bounce_by_platform",
    f"WITH {sess(LONG)} " + _rates("platform", f", {r('avg(duration_minutes)', 1)} AS avg_duration"),
)
def _(spark, sf):
    return sessions.bounce_rate_by_platform(_sessions(spark, sf))


@query(
    "ses06_sessions_by_hour",
    f"WITH {sess(LONG)} " + _rates("hour(session_start) AS hour", ", avg(duration_minutes) AS avg_duration"),
    "avg_duration",
)
def _(spark, sf):
    return sessions.sessions_by_hour(_sessions(spark, sf))


@query(
    "ses07_depth_analysis",
    f"""WITH {sess(LONG)},
g AS (SELECT {sql_bins('event_count', DEPTH_EDGES, DEPTH_LABELS)} AS bk, count(*) AS n, avg(duration_minutes) AS d,
             {r("avg(CASE WHEN converted THEN 1.0::DOUBLE ELSE 0 END) * 100", 2)} AS cr FROM ss GROUP BY 1)
SELECT label AS session_depth, coalesce(n, 0) AS sessions, cr AS conversion_rate, d AS avg_duration,
       {pct('coalesce(n, 0)', 'sum(coalesce(n, 0)) OVER ()', 1)} AS pct_of_sessions
FROM (VALUES {values(DEPTH_LABELS)}) t(position, label) LEFT JOIN g ON bk = label""",
    "avg_duration",
)
def _(spark, sf):
    return sessions.depth_analysis(_sessions(spark, sf))


# --- funnels ----------------------------------------------------------------------------------

_FUNNEL = f"""{EV}, {_LEAD_STEPS},
fc AS (SELECT step_number, step, count(DISTINCT user_id) AS users, count(user_id) AS events
       FROM st LEFT JOIN ev ON event_type = step GROUP BY 1, 2),
fp AS (SELECT *, lag(users) OVER (ORDER BY step_number) AS prev, first_value(users) OVER (ORDER BY step_number) AS f FROM fc),
fr AS (SELECT *, CASE WHEN prev IS NULL OR prev = 0 THEN 100.0::DOUBLE ELSE {pct('users', 'prev', 2)} END AS step_conversion FROM fp),
fn AS (SELECT step_number, step, users, events, {pct('users', 'f', 2)} AS pct_of_total, step_conversion,
              coalesce(prev - users, 0) AS drop_off,
              CASE WHEN prev IS NULL THEN 0.0::DOUBLE ELSE {r('100 - step_conversion', 2)} END AS drop_off_rate FROM fr)"""


@query("fun01_funnel", f"WITH {_FUNNEL} SELECT CAST(step_number AS BIGINT) AS step_number, * EXCLUDE (step_number) FROM fn")
def _(spark, sf):
    return funnels.funnel(b.events(spark, sf), STEPS)


@query(
    "fun02_by_segment",
    f"""WITH {EV}, {_LEAD_STEPS},
sg AS (SELECT DISTINCT platform AS segment FROM ev),
c AS (SELECT segment, step_number, step, count(DISTINCT user_id) AS users
      FROM sg CROSS JOIN st LEFT JOIN ev ON event_type = step AND platform = segment GROUP BY 1, 2, 3)
SELECT segment, CAST(step_number AS BIGINT) AS step_number, step, users,
       {pct('users', 'first_value(users) OVER (PARTITION BY segment ORDER BY step_number)', 2)} AS pct_of_total FROM c""",
)
def _(spark, sf):
    return funnels.funnel_by_segment(b.events(spark, sf), "platform", STEPS)


@query(
    "fun03_drop_off",
    f"""WITH {EV}, {_LEAD_STEPS},
pr AS (SELECT a.step_number AS i, a.step AS from_step, z.step AS to_step FROM st a JOIN st z ON z.step_number = a.step_number + 1),
did AS (SELECT DISTINCT user_id, event_type FROM ev),
ats AS (SELECT i, from_step, to_step, d.user_id, n.user_id IS NOT NULL AS nxt
       FROM pr JOIN did d ON d.event_type = from_step LEFT JOIN did n ON n.user_id = d.user_id AND n.event_type = to_step),
tot AS (SELECT i, count(*) AS users_at_step, count(*) FILTER (WHERE nxt) AS continued FROM ats GROUP BY 1),
alt AS (SELECT i, user_id, event_type, row_number() OVER (PARTITION BY i, user_id ORDER BY us, event_id) AS rn
        FROM ats JOIN ev USING (user_id) WHERE NOT nxt AND event_type <> from_step),
ac AS (SELECT i, event_type, count(*) AS n FROM alt WHERE rn = 1 GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY n DESC, event_type) AS k FROM ac)
SELECT from_step, to_step, coalesce(users_at_step, 0) AS users_at_step, coalesce(continued, 0) AS continued,
       coalesce(users_at_step - continued, 0) AS dropped,
       coalesce({pct('users_at_step - continued', 'users_at_step', 1)}, 0.0) AS drop_rate,
       r1.event_type AS top_alternative_1, coalesce(r1.n, 0) AS alt_1_count,
       r2.event_type AS top_alternative_2, coalesce(r2.n, 0) AS alt_2_count
FROM pr LEFT JOIN tot USING (i) LEFT JOIN rk r1 ON r1.i = pr.i AND r1.k = 1 LEFT JOIN rk r2 ON r2.i = pr.i AND r2.k = 2""",
)
def _(spark, sf):
    return funnels.drop_off_analysis(b.events(spark, sf), STEPS)


@query(
    "fun04_time_between_steps",
    f"""WITH {EV}, {_LEAD_STEPS},
pr AS (SELECT a.step AS from_step, z.step AS to_step FROM st a JOIN st z ON z.step_number = a.step_number + 1),
f AS (SELECT user_id, event_type, min(us) AS us FROM ev GROUP BY 1, 2),
d AS (SELECT from_step, to_step, (y.us - x.us) / 60000000.0::DOUBLE AS m
      FROM pr JOIN f x ON x.event_type = from_step JOIN f y ON y.user_id = x.user_id AND y.event_type = to_step)
SELECT from_step, to_step, count(*) AS users, {r('avg(m)', 2)} AS avg_minutes,
       {r('quantile_cont(m, 0.5)', 2)} AS median_minutes, {r('quantile_cont(m, 0.75)', 2)} AS p75_minutes
FROM d WHERE m > 0 AND m < 1440 GROUP BY 1, 2""",
)
def _(spark, sf):
    return funnels.time_between_steps(b.events(spark, sf), STEPS)


_ADVICE = (("view", "Better product discovery, personalization"), ("click", "Reduce friction in add-to-cart, show benefits"))


@query(
    "fun05_biggest_leaks",
    f"""WITH {_FUNNEL}
SELECT step AS after_step, drop_off AS users_lost, drop_off_rate AS drop_rate_pct, drop_off * drop_off_rate / 100 AS impact_score,
       CASE step WHEN 'view' THEN '{_ADVICE[0][1]}' WHEN 'click' THEN '{_ADVICE[1][1]}' END AS recommendation
FROM fn WHERE drop_off > 0""",
    "impact_score",
)
def _(spark, sf):
    return funnels.biggest_leaks(b.events(spark, sf), STEPS, _ADVICE)


# --- paths ------------------------------------------------------------------------------------

_PATHS = f"""{EV},
pe AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM ev),
up AS (SELECT user_id, list(event_type ORDER BY rn) AS path FROM pe WHERE rn <= 10 GROUP BY 1),
conv AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'purchase')"""


@query("pat01_user_paths", f"WITH {_PATHS} SELECT user_id, array_to_string(path, ' -> ') AS path FROM up")
def _(spark, sf):
    from pyspark.sql import functions as F

    return paths.user_paths(b.events(spark, sf)).select("user_id", F.array_join("path", " -> ").alias("path"))


@query(
    "pat02_common_paths",
    f"""WITH {_PATHS}
SELECT array_to_string(path[1:5], ' -> ') AS path, count(*) AS users, {pct('count(*)', '(SELECT count(*) FROM up)', 2)} AS pct
FROM up WHERE len(path) >= 2 GROUP BY 1 ORDER BY users DESC, path LIMIT 20""",
)
def _(spark, sf):
    return paths.common_paths(b.events(spark, sf))


@query(
    "pat03_paths_to_conversion",
    f"""WITH {_PATHS}
SELECT array_to_string(CASE WHEN list_contains(path, 'purchase') THEN path[1:list_position(path, 'purchase')] ELSE path END, ' -> ')
         AS conversion_path, count(*) AS users, {pct('count(*)', '(SELECT count(*) FROM conv)', 2)} AS pct_of_converters
FROM up SEMI JOIN conv USING (user_id) GROUP BY 1 ORDER BY users DESC, conversion_path LIMIT 20""",
)
def _(spark, sf):
    return paths.paths_to_conversion(b.events(spark, sf), V, max_length=10)


@query(
    "pat03_whole_histories",
    f"""WITH {_PATHS}, fo AS (SELECT user_id, min(us) AS t, min_by(event_id, (us, event_id)) AS i FROM ev WHERE event_type = 'purchase' GROUP BY 1),
wp AS (SELECT ev.user_id, string_agg(event_type, ' -> ' ORDER BY us, event_id) AS conversion_path FROM ev JOIN fo USING (user_id) WHERE (us, event_id) <= (t, i) GROUP BY 1)
SELECT conversion_path, count(*) AS users, {pct('count(*)', '(SELECT count(*) FROM conv)', 2)} AS pct_of_converters FROM wp GROUP BY 1 ORDER BY users DESC, conversion_path LIMIT 20""",
)
def _(spark, sf):
    """Paths up to the first order, wherever it lies."""
    return paths.paths_to_conversion(b.events(spark, sf), V)


# Nearly every user of these tables purchases, so the drop-off target here is 'signup' within the
# first ten events only for the vocabulary below.
_RARE = "purchase_refunded"


@query(
    "pat04_paths_to_drop_off",
    f"""WITH {_PATHS},
dr AS (SELECT user_id FROM ev GROUP BY 1 HAVING bool_or(event_type = 'click') AND NOT bool_or(event_type = '{_RARE}')),
ap AS (SELECT CASE WHEN NOT list_contains(path, 'click') THEN 'N/A' WHEN list_position(path, 'click') = len(path) THEN 'EXIT'
            ELSE array_to_string(path[list_position(path, 'click') + 1 : list_position(path, 'click') + 3], ' -> ') END AS after_path
       FROM up SEMI JOIN dr USING (user_id))
SELECT after_path, count(*) AS users, {pct('count(*)', '(SELECT count(*) FROM dr)', 2)} AS pct
FROM ap GROUP BY 1 ORDER BY users DESC, after_path LIMIT 15""",
)
def _(spark, sf):
    from dataclasses import replace

    return paths.paths_to_drop_off(b.events(spark, sf), "click", replace(V, order=_RARE), max_length=10)


@query(
    "pat04_whole_histories",
    f"""WITH {_PATHS.replace("WHERE rn <= 10 ", "")},
dr AS (SELECT user_id FROM ev GROUP BY 1 HAVING bool_or(event_type = 'click') AND NOT bool_or(event_type = '{_RARE}')),
ap AS (SELECT CASE WHEN list_position(path, 'click') = len(path) THEN 'EXIT'
            ELSE array_to_string(path[list_position(path, 'click') + 1 : list_position(path, 'click') + 3], ' -> ') END AS after_path
       FROM up SEMI JOIN dr USING (user_id))
SELECT after_path, count(*) AS users, {pct('count(*)', '(SELECT count(*) FROM dr)', 2)} AS pct
FROM ap GROUP BY 1 ORDER BY users DESC, after_path LIMIT 15""",
)
def _(spark, sf):
    from dataclasses import replace

    return paths.paths_to_drop_off(b.events(spark, sf), "click", replace(V, order=_RARE))


_EDGES = f"""{EV},
ed AS (SELECT user_id, first(event_type ORDER BY us, event_id) AS entry_event, last(event_type ORDER BY us, event_id) AS exit_event,
              bool_or(event_type = 'purchase') AS converted FROM ev GROUP BY 1)"""


@query(
    "pat05_entry_points",
    f"""WITH {_EDGES}
SELECT entry_event, count(*) AS users, {r("avg(CASE WHEN converted THEN 1.0::DOUBLE ELSE 0 END) * 100", 2)} AS conversion_rate,
       {pct('count(*)', '(SELECT count(*) FROM ed)', 1)} AS pct_of_users FROM ed GROUP BY 1""",
)
def _(spark, sf):
    return paths.entry_points(b.events(spark, sf), V)


@query(
    "pat06_exit_points",
    f"WITH {_EDGES} SELECT exit_event, count(*) AS users, {pct('count(*)', '(SELECT count(*) FROM ed)', 1)} AS pct_of_users FROM ed GROUP BY 1",
)
def _(spark, sf):
    return paths.exit_points(b.events(spark, sf), V)


_FLOW = f"""{EV},
nx AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS next_event FROM ev),
tc AS (SELECT event_type, next_event, count(*) AS count FROM nx WHERE next_event IS NOT NULL GROUP BY 1, 2),
tp AS (SELECT *, {pct('count', 'sum(count) OVER (PARTITION BY event_type)', 1)} AS probability FROM tc),
tr AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY probability DESC, count DESC, next_event) AS k FROM tp)"""


@query("pat07_event_flow", f"WITH {_FLOW} SELECT event_type, next_event, count, probability FROM tr WHERE k <= 3")
def _(spark, sf):
    return paths.event_flow(b.events(spark, sf))


@query(
    "dsh16_key_event_flow",
    f"WITH {_FLOW} SELECT event_type, next_event, count, probability FROM tr WHERE k <= 3 AND event_type IN ('signup', 'click')",
)
def _(spark, sf):
    return paths.event_flow(b.events(spark, sf), only=["signup", "click"])


# --- journeys ---------------------------------------------------------------------------------

_JOURNEYS = f"""{sess(LONG)},
jq AS (SELECT user_id || '_' || sno AS session_key, user_id, list(event_type ORDER BY rn) FILTER (WHERE rn <= 10) AS journey,
              min(event_time) AS start_time, max(event_time) AS end_time, first(platform ORDER BY rn) AS platform
       FROM sx GROUP BY user_id, sno),
j AS (SELECT *, len(journey) AS journey_length, array_to_string(journey, ' → ') AS journey_str,
             list_contains(journey, 'purchase') AS converted FROM jq)"""


def _journeys(spark, sf):
    return journeys.journey_sequences(b.events(spark, sf), V, 10, LONG)


@query(
    "jou01_sessionized_events",
    f"WITH {sess(LONG)} SELECT session_key, user_id, event_count FROM ss",
)
def _(spark, sf):
    return _sessions(spark, sf).select("session_key", "user_id", "event_count")


@query("jou02_sequences", f"WITH {_JOURNEYS} SELECT * EXCLUDE (journey) FROM j")
def _(spark, sf):
    return _journeys(spark, sf).drop("journey")


_TOP_JOURNEYS = """SELECT journey_str AS journey, count(*) AS occurrences, count(*) FILTER (WHERE converted) AS conversions,
 first(journey_length) AS length, count(*) FILTER (WHERE converted)::DOUBLE / count(*) AS conversion_rate
FROM j GROUP BY 1 HAVING count(*) >= 10 ORDER BY occurrences DESC, journey LIMIT 20"""


@query("jou03_top_journeys", f"WITH {_JOURNEYS} {_TOP_JOURNEYS}")
def _(spark, sf):
    return journeys.top_journeys(_journeys(spark, sf))


_FLOWS = f"""{sess(LONG)},
fx AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id, sno ORDER BY rn) AS next_event FROM sx),
fc AS (SELECT event_type, next_event, count(*) AS n FROM fx WHERE next_event IS NOT NULL GROUP BY 1, 2),
ff AS (SELECT * FROM fc WHERE n >= (SELECT quantile_cont(n, 0.1) FROM fc)),
nn AS (SELECT event_type AS node FROM ff UNION SELECT next_event FROM ff),
nd AS (SELECT node, row_number() OVER (ORDER BY coalesce(list_position(['signup', 'view', 'click', 'purchase'], node), 101), node) - 1 AS ix
       FROM nn)"""


@query(
    "jou04_flow_links",
    f"""WITH {_FLOWS} SELECT s.ix AS source, t.ix AS target, event_type, next_event, n AS value
FROM ff JOIN nd s ON s.node = event_type JOIN nd t ON t.node = next_event""",
)
def _(spark, sf):
    return journeys.flow_links(b.events(spark, sf), V, LONG)


_DROP = f"""{_JOURNEYS}, {_LEAD_STEPS},
rs AS (SELECT a.step_number AS stage_order, a.step AS stage, z.step AS nxt FROM st a LEFT JOIN st z ON z.step_number = a.step_number + 1),
dc AS (SELECT stage, stage_order, count(session_key) AS reached,
              count(*) FILTER (WHERE session_key IS NOT NULL AND (nxt IS NULL OR list_contains(journey, nxt))) AS cont,
              count(*) FILTER (WHERE converted) AS conv FROM rs LEFT JOIN j ON list_contains(journey, stage) GROUP BY 1, 2),
sd AS (SELECT stage, CAST(stage_order AS BIGINT) AS stage_order, reached AS users_reached, cont AS users_continued,
              coalesce(1 - cont::DOUBLE / NULLIF(reached, 0), 0) AS drop_off_rate,
              coalesce(conv::DOUBLE / NULLIF(reached, 0), 0) AS conversion_at_stage FROM dc)"""


@query("jou05_stage_drop_off", f"WITH {_DROP} SELECT * FROM sd", "drop_off_rate conversion_at_stage")
def _(spark, sf):
    return journeys.stage_drop_off(_journeys(spark, sf), V)


_SIDE = "CASE WHEN converted THEN 'converters' ELSE 'non_converters' END"


@query(
    "jou06_path_comparison",
    f"WITH {_JOURNEYS} SELECT {_SIDE} AS side, count(*) AS total_sessions, avg(journey_length) AS avg_journey_length FROM j GROUP BY 1",
    "avg_journey_length",
)
def _(spark, sf):
    return journeys.path_comparison(_journeys(spark, sf))


@query(
    "jou06_first_events",
    f"""WITH {_JOURNEYS}, g AS (SELECT {_SIDE} AS side, journey[1] AS event_type, count(*) AS sessions FROM j GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY sessions DESC, event_type) AS rank FROM g) WHERE rank <= 5""",
)
def _(spark, sf):
    return journeys.first_events_by_side(_journeys(spark, sf))


_LIFT = f"""{_JOURNEYS},
je AS (SELECT converted, unnest(journey) AS event_type FROM j),
lc AS (SELECT event_type, count(*) FILTER (WHERE converted) AS c, count(*) FILTER (WHERE NOT converted) AS o FROM je GROUP BY 1),
lr AS (SELECT event_type, coalesce(c::DOUBLE / NULLIF(sum(c) OVER (), 0), 0) AS rc, coalesce(o::DOUBLE / NULLIF(sum(o) OVER (), 0), 0) AS ro FROM lc),
lf AS (SELECT event_type, CASE WHEN ro > 0 THEN rc / ro WHEN rc > 0 THEN 'inf'::DOUBLE ELSE 1.0 END AS lift FROM lr)"""


@query("jou06_event_lift", f"WITH {_LIFT} SELECT event_type, CASE WHEN isinf(lift) THEN -1 ELSE lift END AS lift FROM lf", "lift")
def _(spark, sf):
    from pyspark.sql import functions as F

    e = journeys.event_lift(_journeys(spark, sf))
    return e.withColumn("lift", F.when(F.col("lift") == float("inf"), -1.0).otherwise(F.col("lift")))


_FRICTION = f"""WITH {_DROP},
gp AS (SELECT event_type, CASE WHEN rn > 1 THEN gap / 1000000.0::DOUBLE END AS s FROM sx),
ga AS (SELECT event_type, avg(s) AS avg_time, quantile_cont(s, 0.5) AS median_time, stddev_samp(s) AS std_time, count(s) AS occurrences
       FROM gp GROUP BY 1),
gf AS (SELECT *, avg_time / max(avg_time) OVER () * 0.5 + std_time / max(std_time) OVER () * 0.5 AS friction_score FROM ga)
SELECT event_type, avg_time, median_time, std_time, occurrences, friction_score, drop_off_rate,
       friction_score * 0.5 + coalesce(drop_off_rate, 0) * 0.5 AS overall_friction
FROM gf LEFT JOIN sd ON stage = event_type"""
_FRICTION_ROUNDED = "avg_time:4 median_time:7 std_time:4 friction_score drop_off_rate overall_friction"


@query("jou07_friction", _FRICTION, _FRICTION_ROUNDED)
def _(spark, sf):
    return journeys.friction_points(b.events(spark, sf), V, 10, LONG)


@query(
    "jou08_loops",
    f"""WITH {_JOURNEYS},
le AS (SELECT session_key, unnest(journey) AS event FROM j),
lc AS (SELECT session_key, event, count(*) AS n FROM le GROUP BY 1, 2)
SELECT event, count(*) FILTER (WHERE n > 1) AS sessions_with_loops, count(*) AS total_sessions,
       count(*) FILTER (WHERE n > 1)::DOUBLE / count(*) AS loop_rate, avg(n) FILTER (WHERE n > 1) AS avg_repeats
FROM lc GROUP BY 1 HAVING count(*) FILTER (WHERE n > 1) > 0""",
    "loop_rate avg_repeats",
)
def _(spark, sf):
    return journeys.loop_analysis(_journeys(spark, sf))


# Whole sessions: the same answers without a bound on the number of events.
_WHOLE = _JOURNEYS.replace(" FILTER (WHERE rn <= 10)", "")


def _session_counts(spark, sf):
    return journeys.session_counts(b.events(spark, sf), V, LONG)


@query("jou07_whole_friction", _FRICTION.replace(_JOURNEYS, _WHOLE), _FRICTION_ROUNDED)
def _(spark, sf):
    return journeys.friction_points(b.events(spark, sf), V, timeout_minutes=LONG)


@query("jou05_whole_sessions", f"WITH {_DROP.replace(_JOURNEYS, _WHOLE)} SELECT * FROM sd", "drop_off_rate conversion_at_stage")
def _(spark, sf):
    return journeys.stage_drop_off(_session_counts(spark, sf), V)


@query(
    "jou06_whole_sessions",
    f"WITH {_WHOLE} SELECT {_SIDE} AS side, count(*) AS total_sessions, avg(journey_length) AS avg_journey_length FROM j GROUP BY 1",
    "avg_journey_length",
)
def _(spark, sf):
    return journeys.path_comparison(_session_counts(spark, sf))


@query(
    "jou06_whole_lift",
    f"WITH {_LIFT.replace(_JOURNEYS, _WHOLE)} SELECT event_type, CASE WHEN isinf(lift) THEN -1 ELSE lift END AS lift FROM lf",
    "lift",
)
def _(spark, sf):
    from pyspark.sql import functions as F

    e = journeys.event_lift(_session_counts(spark, sf))
    return e.withColumn("lift", F.when(F.col("lift") == float("inf"), -1.0).otherwise(F.col("lift")))


@query(
    "jou08_whole_loops",
    f"""WITH {_WHOLE},
le AS (SELECT session_key, unnest(journey) AS event FROM j),
lc AS (SELECT session_key, event, count(*) AS n FROM le GROUP BY 1, 2)
SELECT event, count(*) FILTER (WHERE n > 1) AS sessions_with_loops, count(*) AS total_sessions,
       count(*) FILTER (WHERE n > 1)::DOUBLE / count(*) AS loop_rate, avg(n) FILTER (WHERE n > 1) AS avg_repeats
FROM lc GROUP BY 1 HAVING count(*) FILTER (WHERE n > 1) > 0""",
    "loop_rate avg_repeats",
)
def _(spark, sf):
    return journeys.loop_analysis(_session_counts(spark, sf))


@query(
    "jou09_time_between_stages",
    f"""WITH {sess(LONG)}, {_LEAD_STEPS},
pr AS (SELECT a.step AS from_stage, z.step AS to_stage FROM st a JOIN st z ON z.step_number = a.step_number + 1),
fa AS (SELECT from_stage, to_stage, user_id, sno, min(us) AS t FROM pr JOIN sx ON event_type = from_stage GROUP BY 1, 2, 3, 4),
fb AS (SELECT fa.from_stage, fa.to_stage, (min(sx.us) - min(fa.t)) / 1000000.0::DOUBLE AS s
       FROM fa JOIN sx ON sx.user_id = fa.user_id AND sx.sno = fa.sno AND sx.event_type = fa.to_stage AND sx.us > fa.t
       GROUP BY 1, 2, fa.user_id, fa.sno)
SELECT from_stage, to_stage, avg(s) AS avg_seconds, quantile_cont(s, 0.5) AS median_seconds, count(*) AS sessions FROM fb GROUP BY 1, 2""",
    "avg_seconds:3 median_seconds:7",
)
def _(spark, sf):
    return journeys.time_between_stages(b.events(spark, sf), V, LONG)

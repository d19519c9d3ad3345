"""Gap sessions and their summaries.

Sessions are built in steps.  A user's time is cut into chunks of a bounded number of events (days, and
hours, minutes or seconds where a user is busy).  Inside each (user, chunk) a window cuts the events into
partial sessions of one row each.  Partial sessions whose gap is within the timeout are linked inside blocks
of a month, then the blocks of a user.  A user with a large share of all events is thus spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.columns import (
    INF,
    US_PER_DAY,
    US_PER_MINUTE,
    bins,
    flag_mean,
    label_rows,
    minutes,
    percent,
    ratio,
    round_half_even,
)
from tidelens.functions.distributed import chunk_window, scalar_quantile, with_chunks
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary

#: Time of a user in which partial sessions are linked before the blocks are.
BLOCK_US = 30 * US_PER_DAY

# Bucket edges and labels of the session reports.
DURATION_EDGES = (0, 1, 2, 5, 10, 15, 30, 60, INF)
DURATION_LABELS = ("<1min", "1-2min", "2-5min", "5-10min", "10-15min", "15-30min", "30-60min", "60+min")
DEPTH_EDGES = (1, 2, 3, 5, 10, 20, INF)
DEPTH_LABELS = ("1 event", "2 events", "3-4 events", "5-9 events", "10-19 events", "20+ events")


def chunked_events(events: DataFrame, timeout_minutes: float = 30) -> DataFrame:
    """Events with ``local``, the number of their partial session inside (user, chunk), and ``gap_us``.

    ``gap_us`` is the time since the previous event of the same partial session, NULL on its first.
    """
    limit = F.lit(int(timeout_minutes * US_PER_MINUTE))
    w = chunk_window()
    gap = F.col("us") - F.lag("us").over(w)
    return (
        with_chunks(events)
        .withColumn("_gap", gap)
        .withColumn(
            "local",
            F.sum(F.when(F.col("_gap") > limit, 1).otherwise(0)).over(
                w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .withColumn("gap_us", F.when(F.col("_gap") <= limit, F.col("_gap")))
        .drop("_gap")
    )


def link_partials(partials: DataFrame, timeout_minutes: float = 30) -> DataFrame:
    """Numbers the sessions of each user over partial sessions with ``start_us`` and ``end_us``.

    Adds ``session_no`` and ``gap_before_us`` (gap to the previous partial of the same session).  Partials are linked inside (user, block)
    first; then one row for each block tells how many sessions began before it and whether its first one goes on from the block before.
    """
    limit = F.lit(int(timeout_minutes * US_PER_MINUTE))
    w = Window.partitionBy("user_id", "_block").orderBy("chunk", "local")
    gap = F.col("start_us") - F.lag("end_us").over(w)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (
        partials.withColumn("_block", F.floor(F.col("chunk") / F.lit(BLOCK_US)))
        .withColumn("_gap", gap)
        .withColumn("_breaks", F.sum(F.when(F.col("_gap") > limit, 1).otherwise(0)).over(upto))
    )
    by_block = Window.partitionBy("_user").orderBy("_at")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    border = F.col("_first") - F.lag("_last").over(by_block)
    blocks = (
        inside.groupBy(F.col("user_id").alias("_user"), F.col("_block").alias("_at"))
        .agg(F.min("start_us").alias("_first"), F.max("end_us").alias("_last"), F.max("_breaks").alias("_inner"))
        .withColumn("_border", border)
        .withColumn("_opens", F.when(F.col("_border").isNull() | (F.col("_border") > limit), 1).otherwise(0))
        .withColumn("_offset", F.sum("_opens").over(by_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.coalesce(F.sum("_inner").over(before), F.lit(0)))
    )
    linked = inside.join(blocks, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("_block") == F.col("_at")))
    whole_gap = F.coalesce("_gap", "_border")
    return (
        linked.withColumn("session_no", F.col("_offset") + F.col("_breaks"))
        .withColumn("gap_before_us", F.when(whole_gap <= limit, whole_gap))
        .drop("_gap", "_breaks", "_block", "_user", "_at", "_first", "_last", "_inner", "_border", "_opens", "_offset")
    )


def sessions(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, timeout_minutes: float = 30) -> DataFrame:
    """One row per session: key, start, end, counts, entry, exit, duration, converted, bounce."""
    at = F.struct("us", "event_id")
    named = F.when(F.col("platform").isNotNull(), at)
    partials = (
        chunked_events(events.select("user_id", "event_time", "event_type", "platform", "event_id"), timeout_minutes)
        .groupBy("user_id", "chunk", "local")
        .agg(
            F.min("us").alias("start_us"),
            F.max("us").alias("end_us"),
            F.count(F.lit(1)).alias("n"),
            F.min_by("event_type", at).alias("entry"),
            F.max_by("event_type", at).alias("exit"),
            F.min_by("platform", named).alias("platform"),
            F.max(F.col("event_type") == vocab.order).alias("conv"),
        )
    )
    merged = (
        link_partials(partials, timeout_minutes)
        .groupBy("user_id", "session_no")
        .agg(
            F.min("start_us").alias("start_us"),
            F.max("end_us").alias("end_us"),
            F.sum("n").alias("event_count"),
            F.min_by("entry", "start_us").alias("entry_event"),
            F.max_by("exit", "start_us").alias("exit_event"),
            F.min_by("platform", F.when(F.col("platform").isNotNull(), F.col("start_us"))).alias("platform"),
            F.max("conv").alias("converted"),
        )
    )
    return merged.select(
        F.concat_ws("_", F.col("user_id").cast("string"), F.col("session_no").cast("string")).alias("session_key"),
        "user_id",
        F.timestamp_micros("start_us").alias("session_start"),
        F.timestamp_micros("end_us").alias("session_end"),
        "event_count",
        "platform",
        minutes(F.col("end_us") - F.col("start_us")).alias("duration_minutes"),
        "entry_event",
        "exit_event",
        "converted",
        (F.col("event_count") == 1).alias("is_bounce"),
    )


def session_summary(s: DataFrame) -> DataFrame:
    base = s.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.countDistinct("user_id").alias("total_users"),
        F.avg("duration_minutes").alias("avg_session_duration"),
        F.avg("event_count").alias("avg_events_per_session"),
        (flag_mean(F.col("is_bounce")) * 100).alias("bounce_rate"),
        (flag_mean(F.col("converted")) * 100).alias("conversion_rate"),
    )
    return base.select(
        "total_sessions",
        "total_users",
        ratio(F.col("total_sessions"), F.col("total_users")).alias("avg_sessions_per_user"),
        "avg_session_duration",
        scalar_quantile(s, "duration_minutes", 0.5).alias("median_session_duration"),
        "avg_events_per_session",
        "bounce_rate",
        "conversion_rate",
    )


def _bucketed(s: DataFrame, bucket, labels, name: str, *aggs) -> DataFrame:
    """Aggregates per bucket label, with every label present."""
    got = s.withColumn(name, bucket).where(F.col(name).isNotNull()).groupBy(name).agg(
        F.count(F.lit(1)).alias("_n"), *aggs
    )
    full = label_rows(s.sparkSession, labels, name).join(got, name, "left")
    return full.withColumn("_n", F.coalesce("_n", F.lit(0))).withColumn(
        "pct_of_sessions", percent(F.col("_n"), F.sum("_n").over(Window.partitionBy()), 1)
    )


def duration_distribution(s: DataFrame) -> DataFrame:
    b = _bucketed(
        s,
        bins(F.col("duration_minutes"), DURATION_EDGES, DURATION_LABELS),
        DURATION_LABELS,
        "duration_bucket",
        round_half_even(flag_mean(F.col("converted")) * 100, 2).alias("conversion_rate"),
    )
    return b.select("duration_bucket", F.col("_n").alias("session_count"), "conversion_rate", "pct_of_sessions")


def depth_analysis(s: DataFrame) -> DataFrame:
    """Sessions by event count.  The lowest edge is open, so one-event sessions are in no bucket."""
    b = _bucketed(
        s,
        bins(F.col("event_count"), DEPTH_EDGES, DEPTH_LABELS),
        DEPTH_LABELS,
        "session_depth",
        round_half_even(flag_mean(F.col("converted")) * 100, 2).alias("conversion_rate"),
        F.avg("duration_minutes").alias("avg_duration"),
    )
    return b.select("session_depth", F.col("_n").alias("sessions"), "conversion_rate", "avg_duration", "pct_of_sessions")


def _rates(s: DataFrame, key: str, *more) -> DataFrame:
    return (
        s.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            round_half_even(flag_mean(F.col("is_bounce")) * 100, 1).alias("bounce_rate"),
            round_half_even(flag_mean(F.col("converted")) * 100, 2).alias("conversion_rate"),
            *more,
        )
    )


def bounce_rate_by_entry(s: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """By entry event, without sessions that enter on a post-conversion event."""
    return _rates(s.where(~F.col("entry_event").isin(list(vocab.post_conversion))), "entry_event").orderBy(
        F.desc("sessions"), "entry_event"
    )


def bounce_rate_by_platform(s: DataFrame) -> DataFrame:
    return _rates(s, "platform", round_half_even(F.avg("duration_minutes"), 1).alias("avg_duration"))


def sessions_by_hour(s: DataFrame) -> DataFrame:
    return _rates(s.withColumn("hour", F.hour("session_start")), "hour", F.avg("duration_minutes").alias("avg_duration"))

"""Session journeys: bounded event sequences, flows, friction, loops, and stage timing.

All operators start from partial sessions (see ``sessions``): per (user, hour chunk) windows, then
one small row per partial session that is linked across chunks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.columns import (
    INF,
    US_PER_SECOND,
    flag_mean,
    label_rows,
    literal_rows,
    ratio,
)
from tidelens.functions.distributed import quantiles, top_per_group
from tidelens.operators.sessions import chunked_events, link_partials
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary

ARROW = " → "
_EVENT_COLUMNS = ("user_id", "event_time", "event_type", "platform", "event_id")


def _key():
    return F.concat_ws("_", F.col("user_id").cast("string"), F.col("session_no").cast("string"))


def journey_sequences(
    events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, max_length: int = 10, timeout_minutes: float = 30
) -> DataFrame:
    """First ``max_length`` events per session.  ``converted`` looks at these events only.

    A partial session contributes at most ``max_length`` events, a session at most its first
    ``max_length`` partial sessions, so nothing unbounded is collected.
    """
    local = Window.partitionBy("user_id", "chunk", "local").orderBy("us", "event_id")
    at = F.struct("us", "event_id")
    numbered = chunked_events(events.select(*_EVENT_COLUMNS), timeout_minutes).withColumn("rn", F.row_number().over(local))
    head = F.when(F.col("rn") <= max_length, F.struct("rn", "event_type"))
    partials = numbered.groupBy("user_id", "chunk", "local").agg(
        F.min("us").alias("start_us"),
        F.max("us").alias("end_us"),
        F.array_sort(F.collect_list(head)).alias("head"),
        F.min_by("platform", F.when(F.col("platform").isNotNull(), at)).alias("platform"),
    )
    in_session = Window.partitionBy("user_id", "session_no").orderBy("chunk", "local")
    linked = link_partials(partials, timeout_minutes).withColumn("p", F.row_number().over(in_session))
    kept = F.when(F.col("p") <= max_length, F.struct("p", "head"))
    merged = linked.groupBy("user_id", "session_no").agg(
        F.array_sort(F.collect_list(kept)).alias("parts"),
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.min_by("platform", F.when(F.col("platform").isNotNull(), F.col("start_us"))).alias("platform"),
    )
    flat = F.flatten(F.transform("parts", lambda part: F.transform(part["head"], lambda e: e["event_type"])))
    return merged.withColumn("journey", F.slice(flat, 1, max_length)).select(
        _key().alias("session_key"),
        "user_id",
        "journey",
        F.timestamp_micros("start_us").alias("start_time"),
        F.timestamp_micros("end_us").alias("end_time"),
        "platform",
        F.size("journey").alias("journey_length"),
        F.array_join("journey", ARROW).alias("journey_str"),
        F.array_contains("journey", vocab.order).alias("converted"),
    )


def session_counts(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, timeout_minutes: float = 30) -> DataFrame:
    """Events of whole sessions by type: session_key, event_type, n, converted (of the session).

    Counts per partial session come before anything is joined, so no session is gathered and none is cut short.
    """
    rows = chunked_events(events.select(*_EVENT_COLUMNS), timeout_minutes)
    keys = ["user_id", "chunk", "local"]
    by_type = rows.groupBy(*keys, "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("a"), F.max("us").alias("b"))
    partials = by_type.groupBy(*keys).agg(
        F.min("a").alias("start_us"), F.max("b").alias("end_us"), F.collect_list(F.struct("event_type", "n")).alias("types")  # at most the vocabulary
    )
    linked = link_partials(partials, timeout_minutes).select(_key().alias("session_key"), F.explode("types").alias("t"))
    per = linked.groupBy("session_key", F.col("t.event_type").alias("event_type")).agg(F.sum("t.n").alias("n"))
    bought = F.coalesce(F.max(F.col("event_type") == vocab.order).over(Window.partitionBy("session_key")), F.lit(False))
    return per.withColumn("converted", bought)


def _counts(seq: DataFrame) -> DataFrame:
    """The same columns from bounded journeys; counts pass through."""
    if "journey" not in seq.columns:
        return seq
    each = seq.select("session_key", "converted", F.explode("journey").alias("event_type"))
    return each.groupBy("session_key", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("converted").alias("converted"))


def top_journeys(seq: DataFrame, n: int = 20, min_occurrences: int = 10) -> DataFrame:
    g = seq.groupBy(F.col("journey_str").alias("journey")).agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.sum(F.col("converted").cast("int")).alias("conversions"),
        F.first("journey_length").alias("length"),
    )
    return (
        g.where(F.col("occurrences") >= min_occurrences)
        .withColumn("conversion_rate", ratio(F.col("conversions"), F.col("occurrences")))
        .orderBy(F.desc("occurrences"), "journey")
        .limit(n)
    )


def _gaps(events: DataFrame, timeout_minutes: float) -> DataFrame:
    """(previous event, event, gap) of neighbouring events in one session.

    Gaps inside a chunk come from the chunk window, the few across chunks from the linked partials.
    """
    at = F.struct("us", "event_id")
    local = Window.partitionBy("user_id", "chunk", "local").orderBy("us", "event_id")
    rows = chunked_events(events.select(*_EVENT_COLUMNS), timeout_minutes).withColumn("prev", F.lag("event_type").over(local))
    inside = rows.where(F.col("gap_us").isNotNull()).select("prev", "event_type", "gap_us")
    partials = rows.groupBy("user_id", "chunk", "local").agg(
        F.min("us").alias("start_us"),
        F.max("us").alias("end_us"),
        F.min_by("event_type", at).alias("entry"),
        F.max_by("event_type", at).alias("exit"),
    )
    by_user = Window.partitionBy("user_id").orderBy("chunk", "local")
    across = (
        link_partials(partials, timeout_minutes)
        .withColumn("prev", F.lag("exit").over(by_user))
        .where(F.col("gap_before_us").isNotNull())
        .select("prev", F.col("entry").alias("event_type"), F.col("gap_before_us").alias("gap_us"))
    )
    return inside.unionByName(across)


def flow_transitions(events: DataFrame, timeout_minutes: float = 30) -> DataFrame:
    """Transitions inside sessions whose count reaches the 10th percentile of the counts."""
    t = (
        _gaps(events, timeout_minutes)
        .groupBy(F.col("prev").alias("event_type"), F.col("event_type").alias("next_event"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # one row per pair of event types: the built-in percentile over all of them is small
    return t.where(F.col("count") >= t.agg(F.percentile("count", F.lit(0.1)).alias("q")).scalar())


def flow_nodes(transitions: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Event names of the flow with a node index: funnel order first, other events after by name."""
    names = transitions.select(F.col("event_type").alias("node")).unionByName(
        transitions.select(F.col("next_event").alias("node"))
    ).distinct()
    order = label_rows(transitions.sparkSession, vocab.journey_stages, "node")
    ranked = names.join(order, "node", "left").withColumn("stage", F.coalesce(F.col("position"), F.lit(101)))
    w = Window.partitionBy().orderBy("stage", "node")  # one row per event type
    return ranked.select("node", (F.row_number().over(w) - 1).alias("node_index"))


def flow_links(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, timeout_minutes: float = 30) -> DataFrame:
    """Flow edges with node indices, ready for a flow diagram."""
    t = flow_transitions(events, timeout_minutes)
    n = flow_nodes(t, vocab)
    src = n.select(F.col("node").alias("event_type"), F.col("node_index").alias("source"))
    dst = n.select(F.col("node").alias("next_event"), F.col("node_index").alias("target"))
    return t.join(src, "event_type").join(dst, "next_event").select(
        "source", "target", "event_type", "next_event", F.col("count").alias("value")
    )


def stage_drop_off(seq: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Sessions that reach each stage, also reach the next, and convert; of bounded journeys or of :func:`session_counts`."""
    stages = list(vocab.journey_stages)
    flags = _counts(seq).groupBy("session_key").agg(
        F.max("converted").alias("converted"), *[F.coalesce(F.max(F.col("event_type") == s), F.lit(False)).alias(f"s{i}") for i, s in enumerate(stages)]
    )
    structs = []
    for i in range(len(stages)):
        nxt = F.col(f"s{i + 1}") if i + 1 < len(stages) else F.lit(True)
        structs.append(F.when(F.col(f"s{i}"), F.struct(F.lit(i + 1).alias("stage_order"), nxt.alias("next"), F.col("converted"))))
    reached = flags.select(F.explode(F.array(*structs)).alias("s")).where(F.col("s").isNotNull()).select("s.*")
    g = reached.groupBy("stage_order").agg(
        F.count(F.lit(1)).alias("users_reached"),
        F.sum(F.col("next").cast("int")).alias("users_continued"),
        flag_mean(F.col("converted")).alias("conversion_at_stage"),
    )
    zero = F.lit(0)
    return (
        label_rows(seq.sparkSession, stages, "stage")
        .withColumnRenamed("position", "stage_order")
        .join(g, "stage_order", "left")
        .select(
            "stage",
            "stage_order",
            F.coalesce("users_reached", zero).alias("users_reached"),
            F.coalesce("users_continued", zero).alias("users_continued"),
            F.coalesce(1 - ratio(F.col("users_continued"), F.col("users_reached")), F.lit(0.0)).alias("drop_off_rate"),
            F.coalesce("conversion_at_stage", F.lit(0.0)).alias("conversion_at_stage"),
        )
    )


def path_comparison(seq: DataFrame) -> DataFrame:
    """Converters against the rest: sessions and mean journey length; of bounded journeys or of :func:`session_counts`."""
    if "journey_length" not in seq.columns:
        seq = seq.groupBy("session_key").agg(F.sum("n").alias("journey_length"), F.max("converted").alias("converted"))
    return seq.groupBy(F.when(F.col("converted"), "converters").otherwise("non_converters").alias("side")).agg(
        F.count(F.lit(1)).alias("total_sessions"), F.avg("journey_length").alias("avg_journey_length")
    )


def first_events_by_side(seq: DataFrame, n: int = 5) -> DataFrame:
    g = seq.groupBy(
        F.when(F.col("converted"), "converters").otherwise("non_converters").alias("side"),
        F.element_at("journey", 1).alias("event_type"),
    ).agg(F.count(F.lit(1)).alias("sessions"))
    return top_per_group(g, ["side"], [F.desc("sessions"), F.asc("event_type")], n)


def event_lift(seq: DataFrame) -> DataFrame:
    """Share of an event among converters' events over its share among the others'.

    Infinite where the others never show it.  Of bounded journeys or of :func:`session_counts`.
    """
    g = _counts(seq).groupBy("event_type").agg(
        F.sum(F.when(F.col("converted"), F.col("n")).otherwise(0)).alias("c"), F.sum(F.when(F.col("converted"), 0).otherwise(F.col("n"))).alias("o")
    )
    every = Window.partitionBy()  # one row per event type
    rc = F.coalesce(ratio(F.col("c"), F.sum("c").over(every)), F.lit(0.0))
    ro = F.coalesce(ratio(F.col("o"), F.sum("o").over(every)), F.lit(0.0))
    return g.select("event_type", rc.alias("rc"), ro.alias("ro")).select(
        "event_type",
        F.when(F.col("ro") > 0, F.try_divide("rc", "ro")).when(F.col("rc") > 0, F.lit(INF)).otherwise(1.0).alias("lift"),
    )


def friction_points(
    events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, max_length: int | None = None, timeout_minutes: float = 30
) -> DataFrame:
    """Seconds spent before each event, scored by mean and spread, joined with stage drop-off (of whole sessions, or their first events)."""
    gaps = _gaps(events, timeout_minutes).select("event_type", (F.col("gap_us") / F.lit(float(US_PER_SECOND))).alias("s"))
    g = gaps.groupBy("event_type").agg(
        F.avg("s").alias("avg_time"), F.stddev_samp("s").alias("std_time"), F.count(F.lit(1)).alias("occurrences")
    )
    med = quantiles(gaps, "s", {"median_time": 0.5}, ["event_type"])
    types = events.select("event_type").where(F.col("event_type").isNotNull()).distinct()
    every = Window.partitionBy()  # one row per event type
    score = F.try_divide(F.col("avg_time"), F.max("avg_time").over(every)) * 0.5 + F.try_divide(
        F.col("std_time"), F.max("std_time").over(every)
    ) * 0.5
    whole = max_length is None
    drop = stage_drop_off(session_counts(events, vocab, timeout_minutes) if whole else journey_sequences(events, vocab, max_length, timeout_minutes), vocab).select(
        F.col("stage").alias("event_type"), "drop_off_rate"
    )
    return (
        types.join(g, "event_type", "left")
        .join(med, "event_type", "left")
        .withColumn("occurrences", F.coalesce("occurrences", F.lit(0)))
        .withColumn("friction_score", score)
        .join(drop, "event_type", "left")
        .withColumn("overall_friction", F.col("friction_score") * 0.5 + F.coalesce("drop_off_rate", F.lit(0.0)) * 0.5)
        .select(
            "event_type", "avg_time", "median_time", "std_time", "occurrences", "friction_score", "drop_off_rate", "overall_friction"
        )
    )


def loop_analysis(seq: DataFrame) -> DataFrame:
    """Events repeated inside a session; of bounded journeys or of :func:`session_counts`."""
    per = _counts(seq).withColumnRenamed("event_type", "event")
    g = per.groupBy("event").agg(
        F.sum((F.col("n") > 1).cast("long")).alias("sessions_with_loops"),
        F.count(F.lit(1)).alias("total_sessions"),
        F.avg(F.when(F.col("n") > 1, F.col("n"))).alias("avg_repeats"),
    )
    return g.where(F.col("sessions_with_loops") > 0).select(
        "event",
        "sessions_with_loops",
        "total_sessions",
        ratio(F.col("sessions_with_loops"), F.col("total_sessions")).alias("loop_rate"),
        "avg_repeats",
    )


def time_between_stages(
    events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, timeout_minutes: float = 30
) -> DataFrame:
    """Per session and adjacent stage pair: first A to the first B after it; mean, median, sessions.

    Per partial session only three times per pair are kept: first A, first B, first B after the
    local first A.  Linked partials then give the session's answer.
    """
    stages = list(vocab.journey_stages)
    local = Window.partitionBy("user_id", "chunk", "local").orderBy("us", "event_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    t, us = F.col("event_type"), F.col("us")
    rows = chunked_events(events.select(*_EVENT_COLUMNS), timeout_minutes)
    rows = rows.select("*", *[F.min(F.when(t == s, us)).over(local).alias(f"_a{i}") for i, s in enumerate(stages[:-1])])
    aggs = [F.min("us").alias("start_us"), F.max("us").alias("end_us")]
    aggs += [F.min(F.when(t == s, us)).alias(f"f{i}") for i, s in enumerate(stages)]
    aggs += [
        F.min(F.when((t == stages[i + 1]) & (us > F.col(f"_a{i}")), us)).alias(f"b{i}") for i in range(len(stages) - 1)
    ]
    linked = link_partials(rows.groupBy("user_id", "chunk", "local").agg(*aggs), timeout_minutes)
    before = Window.partitionBy("user_id", "session_no").orderBy("chunk", "local").rowsBetween(Window.unboundedPreceding, -1)
    linked = linked.select("*", *[F.min(f"f{i}").over(before).alias(f"e{i}") for i in range(len(stages) - 1)])
    ends = [
        F.min(F.when(F.col(f"e{i}").isNotNull(), F.col(f"f{i + 1}")).otherwise(F.col(f"b{i}"))).alias(f"to{i}")
        for i in range(len(stages) - 1)
    ]
    starts = [F.min(f"f{i}").alias(f"from{i}") for i in range(len(stages) - 1)]
    per = linked.groupBy("user_id", "session_no").agg(*starts, *ends)
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"), ((F.col(f"to{i}") - F.col(f"from{i}")) / F.lit(float(US_PER_SECOND))).alias("s")
            )
            for i in range(len(stages) - 1)
        ]
    )
    spans = per.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("s").isNotNull())
    g = spans.groupBy("i").agg(F.avg("s").alias("avg_seconds"), F.count(F.lit(1)).alias("sessions"))
    med = quantiles(spans, "s", {"median_seconds": 0.5}, ["i"])
    names = literal_rows(
        events.sparkSession, ["i", "from_stage", "to_stage"], [(i, a, b) for i, (a, b) in enumerate(zip(stages, stages[1:]))]
    )
    return names.join(g, "i").join(med, "i").select("from_stage", "to_stage", "avg_seconds", "median_seconds", "sessions")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)

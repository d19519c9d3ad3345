"""User paths: the first events of each user, entry and exit events, and event transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.columns import flag_mean, percent, round_half_even
from tidelens.functions.distributed import chunk_window, top_per_group, transition_counts, with_chunks
from tidelens.functions.sequences import FIELDS, not_after, power
from tidelens.functions.tables import Scratch, stored
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary

ARROW = " -> "
#: Events of a path that are compared first.
FIRST_EVENTS = 32


def user_paths(events: DataFrame, max_length: int = 10) -> DataFrame:
    """The first ``max_length`` events of each user as an array.

    Rows are cut to the first events before they are collected; Spark prunes them per task already
    ahead of the shuffle, so a user with many events sends only ``max_length`` rows per task.
    """
    firsts = top_per_group(
        events.select("user_id", "event_time", "event_id", "event_type"),
        ["user_id"],
        [F.asc("event_time"), F.asc("event_id")],
        max_length,
        "rn",
    )
    ordered = F.array_sort(F.collect_list(F.struct("rn", "event_type")))
    return firsts.groupBy("user_id").agg(F.transform(ordered, lambda x: x["event_type"]).alias("path"))


def _did(events: DataFrame, event_type: str) -> DataFrame:
    return events.where(F.col("event_type") == event_type).select("user_id").distinct()


def _counted(paths: DataFrame, column: str, n: int, total, share: str) -> DataFrame:
    top = paths.groupBy(column).agg(F.count(F.lit(1)).alias("users")).orderBy(F.desc("users"), column).limit(n)
    return top.select(column, "users", percent(F.col("users"), total, 2).alias(share))


def _size(df: DataFrame):
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def common_paths(events: DataFrame, n: int = 20, min_length: int = 2, max_length: int = 10) -> DataFrame:
    paths = user_paths(events, max_length)
    text = paths.where(F.size("path") >= min_length).select(F.array_join(F.slice("path", 1, 5), ARROW).alias("path"))
    return _counted(text, "path", n, events.agg(F.countDistinct("user_id").alias("n")).scalar(), "pct")


def paths_to_conversion(
    events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, n: int = 20, max_length: int | None = None
) -> DataFrame:
    """Commonest paths of converters up to their first order, wherever it lies in their history.

    Paths are counted by hash; texts are fetched for those that may be among the ``n``.  With ``max_length`` only each user's first events
    are looked at, and a path without its order is cut there.
    """
    converters = _did(events, vocab.order)
    if max_length is None:
        best = _whole_paths(events, vocab, n)
        return best.select("conversion_path", "users", percent(F.col("users"), _size(converters), 2).alias("pct_of_converters"))
    at = F.array_position("path", F.lit(vocab.order)).cast("int")
    cut = F.when(at > 0, F.slice(F.col("path"), F.lit(1), at)).otherwise(F.col("path"))
    paths = user_paths(events, max_length).join(converters, "user_id", "left_semi")
    text = paths.select(F.array_join(cut, ARROW).alias("conversion_path"))
    return _counted(text, "conversion_path", n, _size(converters), "pct_of_converters")


def _whole_paths(events: DataFrame, vocab: Vocabulary, n: int) -> DataFrame:
    """``conversion_path, users`` of the ``n`` commonest paths up to the first order; equal numbers by the text.

    The hash of a path is the sum of its events' codes times powers of their places.  Chunks of a user's time are hashed from their own
    beginnings and shifted by the number of events before them.
    """
    scratch = Scratch(events.sparkSession)
    place = F.struct("event_time", "event_id")
    first = events.where(F.col("event_type") == vocab.order).groupBy("user_id").agg(F.min(place).alias("_first"))
    rows = events.select("user_id", "event_time", "event_id", "event_type").where(F.col("event_type").isNotNull())
    upto = scratch.stored(rows.join(first, "user_id").where(place <= F.col("_first")).drop("_first"), "paths-events")
    rn = F.row_number().over(chunk_window())
    code = F.pmod(F.xxhash64("event_type"), F.lit(1 << 30)) + 1
    hashes = [(F.sum(code * power(base, p, F.col("_rn")) % F.lit(p)) % F.lit(p)).alias(f"h{k}") for k, (p, base) in enumerate(FIELDS)]
    chunks = with_chunks(upto).withColumn("_rn", rn).groupBy("user_id", "chunk").agg(
        F.count(F.lit(1)).alias("n"), *hashes, F.min_by("event_type", "_rn").alias("begin")
    )
    before = Window.partitionBy("user_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row a chunk
    placed = chunks.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    users = placed.groupBy("user_id").agg(
        F.sum("n").alias("n"),
        *[(F.sum(F.col(f"h{k}") * power(base, p, F.col("_before")) % F.lit(p)) % F.lit(p)).alias(f"h{k}") for k, (p, base) in enumerate(FIELDS)],
        F.min_by("begin", "chunk").alias("begin"),
    )
    counts = users.groupBy("n", "h0", "h1").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("user_id", "begin")).alias("one"))
    kept = scratch.stored(not_after(scratch.stored(counts.select("count", "one.*"), "paths"), n, "begin"), "paths-begun")

    def texts(chosen: DataFrame, most: int | None) -> DataFrame:
        met = chosen.select("user_id", "count").join(upto, "user_id")
        if most is not None:
            met = top_per_group(met, ["user_id"], [F.asc("event_time"), F.asc("event_id")], most, "_k")
        return met.groupBy("user_id", "count").agg(F.expr(f"listagg(event_type, '{ARROW}') WITHIN GROUP (ORDER BY event_time, event_id)").alias("path"))

    begun = scratch.stored(not_after(texts(kept, FIRST_EVENTS), n, "path"), "paths-first")
    best = texts(begun, None).select(F.col("path").alias("conversion_path"), F.col("count").alias("users")).orderBy(F.desc("users"), "conversion_path").limit(n)
    out = stored(best, "paths-best")
    scratch.close()
    return out


def paths_to_drop_off(
    events: DataFrame,
    drop_after: str,
    vocab: Vocabulary = DEFAULT_VOCABULARY,
    n: int = 15,
    max_length: int | None = None,
) -> DataFrame:
    """The three events after the first ``drop_after`` for users who did it and never ordered.

    Over whole histories; with ``max_length`` over each user's first events, where 'N/A' means that it comes later.
    """
    flags = events.groupBy("user_id").agg(
        F.max(F.col("event_type") == drop_after).alias("did"), F.max(F.col("event_type") == vocab.order).alias("ordered")
    )
    dropped = flags.where(F.col("did") & ~F.col("ordered")).select("user_id")
    if max_length is None:
        place = F.struct("event_time", "event_id")
        first = events.where(F.col("event_type") == drop_after).groupBy("user_id").agg(F.min(place).alias("first"))
        first = first.join(dropped, "user_id", "left_semi")
        later = events.join(first, "user_id").where(place > F.col("first")).select("user_id", "event_time", "event_id", "event_type")
        three = top_per_group(later, ["user_id"], [F.asc("event_time"), F.asc("event_id")], 3, "rn")
        ordered = F.array_sort(F.collect_list(F.struct("rn", "event_type")))
        text = three.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["event_type"]), ARROW).alias("text"))
        after = first.join(text, "user_id", "left").select(F.coalesce("text", F.lit("EXIT")).alias("after_path"))
        return _counted(after, "after_path", n, _size(dropped), "pct")
    paths = user_paths(events, max_length).join(dropped, "user_id", "left_semi")
    at = F.array_position("path", F.lit(drop_after)).cast("int")
    after = (
        F.when(at == 0, "N/A")
        .when(at == F.size("path"), "EXIT")
        .otherwise(F.array_join(F.slice(F.col("path"), at + 1, F.lit(3)), ARROW))
    )
    return _counted(paths.select(after.alias("after_path")), "after_path", n, _size(dropped), "pct")


def _edge_events(events: DataFrame, vocab: Vocabulary) -> DataFrame:
    at = F.struct("event_time", "event_id")
    return events.groupBy("user_id").agg(
        F.min_by("event_type", at).alias("entry_event"),
        F.max_by("event_type", at).alias("exit_event"),
        F.max(F.col("event_type") == vocab.order).alias("converted"),
    )


def entry_points(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    g = _edge_events(events, vocab).groupBy("entry_event").agg(
        F.count(F.lit(1)).alias("users"), round_half_even(flag_mean(F.col("converted")) * 100, 2).alias("conversion_rate")
    )
    return g.withColumn("pct_of_users", percent(F.col("users"), F.sum("users").over(Window.partitionBy()), 1)).orderBy(
        F.desc("users"), "entry_event"
    )


def exit_points(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    g = _edge_events(events, vocab).groupBy("exit_event").agg(F.count(F.lit(1)).alias("users"))
    return g.withColumn("pct_of_users", percent(F.col("users"), F.sum("users").over(Window.partitionBy()), 1)).orderBy(
        F.desc("users"), "exit_event"
    )


def event_flow(events: DataFrame, per_event: int = 3, only: list[str] | None = None) -> DataFrame:
    """Likeliest next events per event.  ``only`` limits the sources, as the path page does."""
    t = transition_counts(events)
    total = F.sum("count").over(Window.partitionBy("event_type"))
    p = t.withColumn("probability", percent(F.col("count"), total, 1))
    if only:
        p = p.where(F.col("event_type").isin(only))
    return top_per_group(
        p, ["event_type"], [F.desc("probability"), F.desc("count"), F.asc("next_event")], per_event
    ).drop("rank")

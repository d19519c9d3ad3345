"""Streaming operators.  Input is a streaming events frame with a TIMESTAMP ``event_time``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelens.functions.columns import US_PER_MINUTE
from tidelens.functions.distributed import top_per_group
from tidelens.operators.sessions import chunked_events
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary
from tidelens.session import checkpoint_dir


def session_metrics(
    events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, gap: str = "30 minutes", watermark: str = "1 hour"
) -> DataFrame:
    """Closed sessions in append mode: bounds, events, converted, bounce."""
    w = F.session_window("event_time", gap)
    g = events.withWatermark("event_time", watermark).groupBy("user_id", w.alias("w")).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("event_time").alias("session_start"),
        F.max("event_time").alias("session_end"),
        F.max(F.col("event_type") == vocab.order).alias("converted"),
    )
    return g.select(
        "user_id", "session_start", "session_end", "event_count", "converted", (F.col("event_count") == 1).alias("is_bounce")
    )


def volume_baseline(history: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Mean and population deviation of hourly volume and of the hourly buyer share, per hour of day: 24 rows."""
    buyer = F.when(F.col("event_type") == vocab.order, F.col("user_id"))
    hourly = history.groupBy(F.date_trunc("hour", "event_time").alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.countDistinct(buyer).cast("double"), F.countDistinct("user_id")).alias("share")
    )
    return hourly.groupBy(F.hour("t").alias("hour")).agg(
        F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"), F.avg("share").alias("share_mean"), F.stddev_pop("share").alias("share_deviation")
    )


def volume_flags(
    events: DataFrame,
    baseline: DataFrame,
    vocab: Vocabulary = DEFAULT_VOCABULARY,
    sensitivity: float = 2.0,
    watermark: str = "1 hour",
) -> DataFrame:
    """Hourly volume and buyer share against the static baseline of the hour of day.

    Users are counted exactly by two aggregations in a row: first per (hour, user), so that a user is one row, then per hour.
    """
    per_user = events.withWatermark("event_time", watermark).groupBy(F.window("event_time", "1 hour").alias("w"), "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("event_type") == vocab.order).cast("int")).alias("bought")
    )
    g = per_user.groupBy(F.window(F.window_time("w"), "1 hour").alias("w")).agg(
        F.sum("n").alias("events"), F.count("user_id").alias("users"), F.sum(F.when(F.col("user_id").isNotNull(), F.col("bought"))).alias("buyers")
    )
    rows = g.select(F.col("w.start").alias("datetime"), F.hour("w.start").alias("hour"), "events", "users", "buyers")

    def flag(z: str, high: str, low: str) -> Column:
        return F.when(F.col(z) > sensitivity, high).when(F.col(z) < -sensitivity, low).otherwise("normal")

    return (
        rows.join(F.broadcast(baseline), "hour")  # 24 rows
        .withColumn("conversion_rate", F.try_divide(F.col("buyers").cast("double"), F.col("users")))
        .withColumn("z_score", F.try_divide(F.col("events") - F.col("mean"), F.col("deviation")))
        .withColumn("conversion_z_score", F.try_divide(F.col("conversion_rate") - F.col("share_mean"), F.col("share_deviation")))
        .withColumn("anomaly_type", flag("z_score", "spike", "drop"))
        .withColumn("conversion_anomaly", flag("conversion_z_score", "high", "low"))
        .drop("mean", "deviation", "share_mean", "share_deviation")
    )


def trending_counts(
    orders: DataFrame, window: str = "24 hours", slide: str = "1 hour", watermark: str = "1 hour"
) -> DataFrame:
    """Orders per merchant in sliding windows."""
    g = orders.withWatermark("event_time", watermark).groupBy(F.window("event_time", window, slide).alias("w"), "merchant")
    return g.agg(F.count(F.lit(1)).alias("order_count")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "merchant", "order_count"
    )


def top_of_windows(counts: DataFrame, k: int = 10) -> DataFrame:
    """Top merchants per window over the table the stream appends to (append mode emits a window whole)."""
    return top_per_group(counts, ["window_start", "window_end"], [F.desc("order_count"), F.asc("merchant")], k)


def match_deliveries(orders: DataFrame, delivered: DataFrame, key: str, watermark: str = "1 hour", within: str = "3 hours") -> DataFrame:
    """Orders left-joined with deliveries of the same key inside the bound; unmatched ones follow the watermark.

    ``orders`` has ``event_time``, ``delivered`` has ``delivered_at``.
    """
    o = orders.withWatermark("event_time", watermark).alias("o")
    d = delivered.withWatermark("delivered_at", watermark).alias("d")
    cond = (
        (F.col(f"o.{key}") == F.col(f"d.{key}"))
        & (F.col("d.delivered_at") > F.col("o.event_time"))
        & (F.col("d.delivered_at") <= F.col("o.event_time") + F.expr(f"INTERVAL {within}"))
    )
    return o.join(d, cond, "leftOuter").select("o.*", F.col("d.delivered_at").alias("delivered_at"))


_STATE = "user_id long, start_us long, last_us long, n long, mask long"


@dataclass(frozen=True)
class LiveFeatures:
    """A stream with what :func:`run_available` makes of each of its micro-batches and of the open sessions before it.

    ``step(rows, state, mark, folder)`` gives the output and the open sessions after it (``_STATE``); ``mark`` is the watermark (None: none
    yet).  ``then`` holds further steps on the output.
    """

    events: DataFrame
    schema: StructType
    step: Callable[[DataFrame, DataFrame, int | None, str], tuple[DataFrame, DataFrame]]
    delay_us: int
    then: tuple[Callable[[DataFrame], DataFrame], ...] = ()

    @property
    def sparkSession(self) -> SparkSession:
        return self.events.sparkSession

    def followed_by(self, fn: Callable[[DataFrame], DataFrame]) -> LiveFeatures:
        return replace(self, schema=fn(self.sparkSession.createDataFrame([], self.schema)).schema, then=(*self.then, fn))


def live_columns(vocab: Vocabulary = DEFAULT_VOCABULARY) -> list[str]:
    """The session features of the conversion model, in the order of :func:`live_session_features`."""
    seen = (vocab.homepage, vocab.product_view, vocab.add, vocab.checkout_button, vocab.order)
    return ["events_in_session", "unique_events", "session_duration_mins", *(f"has_{t}" for t in seen), "funnel_depth"]


def live_session_features(
    events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, gap_minutes: float = 30, watermark: str = "1 hour"
) -> LiveFeatures:
    """Running features of the open session of each user, one row per event, named as the batch features of whole sessions.

    State per user is four numbers: session start, last event, events, and a bit set of the event types seen.  A state is dropped once the
    watermark has passed the session gap.  Each micro-batch is ordered by (event_time, event_id) whatever its size: windows per
    (user, chunk) give the running values of partial sessions, which one small row each links to the open session and to each other.
    """
    seen = (vocab.homepage, vocab.product_view, vocab.add, vocab.checkout_button, vocab.order)
    types = list(dict.fromkeys((*seen, *vocab.event_types)))
    gap_us = int(gap_minutes * US_PER_MINUTE)
    spark = events.sparkSession
    delay_us = spark.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {watermark}) - unix_micros(timestamp_micros(0))")).first()[0]
    flags = ", ".join(f"`has_{t}` int" for t in seen)
    schema = f"user_id long, session_start_us long, event_us long, events_in_session long, unique_events long, session_duration_mins double, {flags}, funnel_depth int"

    def step(rows: DataFrame, state: DataFrame, mark: int | None, folder: str) -> tuple[DataFrame, DataFrame]:
        bit = F.lit(1 << 62)
        for i, t in enumerate(types):
            bit = F.when(F.col("event_type") == t, F.lit(1 << i).cast("long")).otherwise(bit)
        if mark is not None:
            rows = rows.where(F.unix_micros("event_time") > mark)
        so_far = Window.partitionBy("user_id", "chunk", "local").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = chunked_events(rows.select("user_id", "event_time", "event_id", bit.alias("bit")), gap_minutes).select(
            "user_id", "chunk", "local", "us", F.count(F.lit(1)).over(so_far).alias("n_in"), F.bit_or("bit").over(so_far).alias("mask_in")
        )
        keys = ["user_id", "chunk", "local"]
        partials = inside.groupBy(*keys).agg(
            F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"), F.bit_or("mask_in").alias("mask")
        )
        opened = state.select("user_id", F.lit(None).cast("long").alias("chunk"), F.lit(-1).cast("long").alias("local"), "start_us", F.col("last_us").alias("end_us"), "n", "mask")
        user = Window.partitionBy("user_id").orderBy(F.asc_nulls_first("chunk"), "local")
        before = user.rowsBetween(Window.unboundedPreceding, -1)
        up_to = user.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        latest = F.max("end_us").over(before)
        linked = opened.unionByName(partials).withColumn("latest", latest)
        apart = F.col("latest").isNull() | (F.col("start_us") - F.col("latest") > gap_us)
        linked = linked.withColumn("no", F.sum(apart.cast("int")).over(up_to))
        session = Window.partitionBy("user_id", "no").orderBy(F.asc_nulls_first("chunk"), "local")
        earlier = session.rowsBetween(Window.unboundedPreceding, -1)
        linked = linked.select(
            *keys, "no", "end_us", "n", "mask", F.first("start_us").over(session.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("begins"),
            F.coalesce(F.max("end_us").over(earlier), F.col("start_us")).alias("latest"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
            F.coalesce(F.bit_or("mask").over(earlier), F.lit(0).cast("long")).alias("mask_before"),
        )
        linked.write.mode("overwrite").parquet(folder)
        linked = spark.read.schema(linked.schema).parquet(folder)
        # a user has many rows on either side, but a partial session is one of the linked
        p = linked.where("chunk is not null").select(F.col("user_id").alias("_u"), F.col("chunk").alias("_c"), F.col("local").alias("_l"), "begins", "latest", "n_before", "mask_before")
        both = inside.join(p, F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("chunk") == F.col("_c")) & (F.col("local") == F.col("_l")))
        mask = F.col("mask_in").bitwiseOR(F.col("mask_before"))
        both = both.withColumn("mask", mask).withColumn("until", F.greatest("latest", "us"))
        has = [F.shiftright("mask", i).bitwiseAND(1).cast("int") for i in range(5)]
        out = both.select(
            "user_id", F.col("begins").alias("session_start_us"), F.col("us").alias("event_us"), (F.col("n_before") + F.col("n_in")).alias("events_in_session"),
            F.bit_count("mask").cast("long").alias("unique_events"),
            F.least(F.greatest((F.col("until") - F.col("begins")) / F.lit(60_000_000.0), F.lit(0.0)), F.lit(120.0)).alias("session_duration_mins"),
            *(h.alias(f"has_{t}") for t, h in zip(seen, has)), (has[0] + has[1] + has[2] + has[3]).alias("funnel_depth"),
        )
        sums = linked.groupBy("user_id", "no").agg(F.min_by("begins", F.struct("n_before", "latest")).alias("start_us"), F.max("end_us").alias("last_us"), F.sum("n").alias("n"), F.bit_or("mask").alias("mask"))
        last = sums.groupBy("user_id").agg(F.max_by(F.struct("start_us", "last_us", "n", "mask"), "no").alias("s")).select("user_id", "s.*")
        if mark is not None:
            last = last.where(F.col("last_us") + gap_us > mark)
        return out, last

    source = events.select("user_id", "event_time", "event_id", "event_type")
    return LiveFeatures(source, spark.createDataFrame([], schema).schema, step, delay_us)


def score_live(features: LiveFeatures, model: PipelineModel, columns: list[str]) -> LiveFeatures:
    """Scores live session features with a trained conversion pipeline; works on the stream itself."""
    from pyspark.ml.functions import vector_to_array

    from tidelens.models.predictors import clean

    def scores(rows: DataFrame) -> DataFrame:
        scored = model.transform(clean(rows, columns))
        return scored.select("user_id", "session_start_us", "event_us", F.col("events_in_session").cast("long").alias("events_in_session"), vector_to_array("probability")[1].alias("conversion_probability"))

    return features.followed_by(scores)


def run_available(stream: DataFrame | LiveFeatures, folder: str | None = None) -> DataFrame:
    """Drains a stream over what is available now into a table and reads it.

    Output and progress live in ``folder``: with the same folder a restarted query goes on where it was.  Without one, each call
    starts anew in the shared checkpoint folder.
    """
    spark: SparkSession = stream.sparkSession
    base = folder or f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    if isinstance(stream, LiveFeatures):
        writer = stream.events.writeStream.foreachBatch(_batches(stream, base))
        spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{base}/out/none")
    else:
        writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
    q = writer.option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    reader = spark.read.schema(stream.schema)
    return reader.parquet(f"{base}/out/*" if isinstance(stream, LiveFeatures) else f"{base}/out")


def _batches(live: LiveFeatures, base: str) -> Callable[[DataFrame, int], None]:
    """Writes output, open sessions and the latest event time of a micro-batch under its number, so that a repeated one replaces itself."""

    def run(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        latest, state = None, spark.createDataFrame([], _STATE)
        if number:
            latest = spark.read.schema("latest long").parquet(f"{base}/latest/{number - 1}").first()[0]
            state = spark.read.schema(_STATE).parquet(f"{base}/open/{number - 1}")
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)  # read by several jobs of the batch
        try:
            out, opened = live.step(rows, state, None if latest is None else latest - live.delay_us, f"{base}/linked/{number}")
            for fn in live.then:
                out = fn(out)
            out.write.mode("overwrite").parquet(f"{base}/out/{number}")
            opened.write.mode("overwrite").parquet(f"{base}/open/{number}")
            now = rows.agg(F.greatest(F.max(F.unix_micros("event_time")), F.lit(latest).cast("long")).alias("latest"))
            now.write.mode("overwrite").parquet(f"{base}/latest/{number}")
        finally:
            rows.unpersist()

    return run

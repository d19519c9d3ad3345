"""How customers move between activity tiers over time: transitions, shares after k steps, and where they settle.

Time is cut into slices of equal length.  A customer has a tier in every slice from the first one with events to the last slice of the
table; slices without events are `inactive`.  Runs of inactive slices are counted from the gaps between active ones, so no row is made for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.columns import US_PER_DAY, micros, ratio
from tidelens.functions.tables import stored
from tidelens.operators.journeys import union_all
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary

INACTIVE = "inactive"
#: Points of an order among events, and the lowest points of each tier, rising.
ORDER_POINTS = 5
TIERS: tuple[tuple[str, int], ...] = (("low", 1), ("medium", 5), ("high", 15))


def _tier(points: Column, tiers: Sequence[tuple[str, int]]) -> Column:
    out = F.lit(INACTIVE)
    for name, least in tiers:
        out = F.when(points >= least, F.lit(name)).otherwise(out)
    return out


def slice_tiers(events: DataFrame, days: float = 7, vocab: Vocabulary = DEFAULT_VOCABULARY, tiers: Sequence[tuple[str, int]] = TIERS) -> DataFrame:
    """``user_id, slice, points, tier`` of the slices in which a user has events; slices are numbered from the epoch."""
    at = F.floor(micros(F.col("event_time")) / F.lit(int(days * US_PER_DAY)))
    points = F.sum(F.when(F.col("event_type") == vocab.order, ORDER_POINTS).otherwise(1))
    timed = events.where(F.col("event_time").isNotNull() & F.col("user_id").isNotNull())
    return timed.groupBy("user_id", at.alias("slice")).agg(points.alias("points")).withColumn("tier", _tier(F.col("points"), tiers))


def transitions(slices: DataFrame) -> DataFrame:
    """``from_tier, to_tier, moves, probability`` between neighbouring slices, of all users; pairs that never occur are left out."""
    slices = stored(slices, "slices")
    last = slices.agg(F.max("slice").alias("m")).scalar()
    w = Window.partitionBy("user_id").orderBy("slice")  # one row a slice
    nxt = slices.select("tier", "slice", F.lead("slice").over(w).alias("then"), F.lead("tier").over(w).alias("next_tier")).withColumn("_last", last)
    gap = F.coalesce("then", F.col("_last") + 1) - F.col("slice") - 1  # inactive slices that follow
    none = F.lit(INACTIVE)

    def move(a: Column, b: Column, n: Column) -> Column:
        return F.struct(a.alias("from_tier"), b.alias("to_tier"), n.cast("long").alias("n"))

    moves = F.array(
        move(F.col("tier"), F.when(gap > 0, none).otherwise(F.col("next_tier")), F.when((gap > 0) | F.col("next_tier").isNotNull(), 1).otherwise(0)),
        move(none, none, F.greatest(gap - 1, F.lit(0))),
        move(none, F.col("next_tier"), F.when((gap > 0) & F.col("next_tier").isNotNull(), 1).otherwise(0)),
    )
    counted = nxt.select(F.explode(moves).alias("m")).select("m.*").where("n > 0").groupBy("from_tier", "to_tier").agg(F.sum("n").alias("moves"))
    return counted.withColumn("probability", ratio(F.col("moves"), F.sum("moves").over(Window.partitionBy("from_tier"))))


def _product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Product of two matrices in long form (from_tier, to_tier, probability); as many rows as pairs of tiers."""
    b = right.select(F.col("from_tier").alias("to_tier"), F.col("to_tier").alias("_to"), F.col("probability").alias("_p"))
    return left.join(b, "to_tier").groupBy("from_tier", F.col("_to").alias("to_tier")).agg(F.sum(F.col("probability") * F.col("_p")).alias("probability"))


def after_steps(matrix: DataFrame, k: int) -> DataFrame:
    """``from_tier, to_tier, probability`` after ``k`` slices, by squaring."""
    power = stored(matrix.select("from_tier", "to_tier", "probability"), "tiers")
    out = None
    while True:
        if k & 1:
            out = power if out is None else stored(_product(out, power), "tiers")
        k >>= 1
        if not k:
            return out
        power = stored(_product(power, power), "tiers")


def tier_shares(slices: DataFrame) -> DataFrame:
    """``tier, users, share`` in the last slice; users without events in it are inactive."""
    last = slices.agg(F.max("slice").alias("m")).scalar()
    latest = slices.groupBy("user_id").agg(F.max(F.struct("slice", "tier")).alias("l")).withColumn("_last", last)
    tier = F.when(F.col("l.slice") == F.col("_last"), F.col("l.tier")).otherwise(F.lit(INACTIVE))
    counted = latest.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("users"))
    return counted.withColumn("share", ratio(F.col("users"), F.sum("users").over(Window.partitionBy())))  # one row a tier


def trajectories(slices: DataFrame, steps: Sequence[int] = (1, 2, 4), settled: int = 64) -> DataFrame:
    """``step, tier, share``: shares of the tiers now (step 0), after each number of ``steps``, and after ``settled`` slices as step -1.

    Shares follow the transition matrix; those after ``settled`` steps are stationary unless the matrix mixes very slowly.
    """
    slices = stored(slices, "slices")
    now = stored(tier_shares(slices), "tiers")
    matrix = stored(transitions(slices), "tiers")
    parts = [now.select(F.lit(0).alias("step"), "tier", "share")]
    for k in (*steps, settled):
        moved = now.join(after_steps(matrix, k), F.col("tier") == F.col("from_tier"))
        ends = moved.groupBy(F.col("to_tier").alias("tier")).agg(F.sum(F.col("share") * F.col("probability")).alias("share"))
        parts.append(ends.select(F.lit(k if k != settled else -1).alias("step"), "tier", "share"))
    return union_all(parts)


def score_changes(slices: DataFrame) -> DataFrame:
    """``user_id, first_tier, last_tier, active_slices, first_points, last_points, change`` of every user, over slices with events."""
    g = slices.groupBy("user_id").agg(
        F.min(F.struct("slice", "tier", "points")).alias("a"), F.max(F.struct("slice", "tier", "points")).alias("b"), F.count(F.lit(1)).alias("active_slices")
    )
    return g.select(
        "user_id",
        F.col("a.tier").alias("first_tier"),
        F.col("b.tier").alias("last_tier"),
        "active_slices",
        F.col("a.points").alias("first_points"),
        F.col("b.points").alias("last_points"),
        (F.col("b.points") - F.col("a.points")).alias("change"),
    )

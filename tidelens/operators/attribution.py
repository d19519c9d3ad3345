"""Multi-touch attribution without a join of conversions to touches.

For a look-back of L, time is cut into chunks of length L and chunks into up to ``UNITS`` equal units.  The look-back of a conversion at t
covers the head of t's unit (before t), the units of t's chunk before it, the tail of the unit of t-L (from t-L) and the units of that
chunk after it.  Rows are summed by unit; running sums over the units of a chunk give each unit what lies before and after it in its chunk,
and enter the unit as one more row, so running sums inside the unit end in the whole head or tail.  A user with a large share of all events
is thus sorted by unit, a chunk holds at most ``UNITS`` sums, and no (conversion, touch) pair is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.columns import (
    US_PER_HOUR,
    US_PER_MINUTE,
    label_rows,
    percent,
)
from tidelens.functions.distributed import scalar_quantile
from tidelens.functions.sequences import FIELDS, not_after, power
from tidelens.functions.tables import Scratch, stored
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary

ARROW = " -> "
MODELS = ("first_touch", "last_touch", "linear", "time_decay", "position_based")
#: Units of a look-back at most: minutes of a day.
UNITS = 1440
#: Touches of a path that are compared first.
FIRST_TOUCHES = 32


def _span(lookback_hours: float) -> tuple[int, int]:
    """The look-back and its unit in microseconds; the unit divides the look-back."""
    span = int(lookback_hours * US_PER_HOUR)
    return span, span // next(k for k in range(UNITS, 0, -1) if span % k == 0)


def _in_units(events: DataFrame, vocab: Vocabulary, lookback_hours: float) -> DataFrame:
    """Touches and two probes for each conversion, one at t for the head and one at t-L for the tail, with their ``unit`` and ``chunk``.

    ``point`` is the touch's place in the vocabulary, NULL for probes; ``kind`` puts probes before touches of the same time.
    """
    points = list(vocab.touchpoints)
    span, unit = _span(lookback_hours)
    us = F.unix_micros("event_time")
    index = F.create_map(*[F.lit(x) for i, p in enumerate(points) for x in (p, i)])
    base = events.where(F.col("event_type").isin([*points, vocab.order])).select("user_id", us.alias("us"), "event_id", "event_type")
    touch = F.struct(
        F.col("us").alias("at"),
        F.lit(1).alias("kind"),
        F.try_element_at(index, F.col("event_type")).alias("point"),
        F.lit(None).cast("long").alias("conv_us"),
        F.lit(None).cast("boolean").alias("tail"),
    )

    def probe(at: Column, tail: bool) -> Column:
        return F.struct(at.alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("point"), F.col("us").alias("conv_us"), F.lit(tail).alias("tail"))

    is_touch = F.col("event_type").isin(points)
    is_order = F.col("event_type") == vocab.order
    nothing = F.array().cast("array<struct<at:bigint,kind:int,point:int,conv_us:bigint,tail:boolean>>")
    found = F.concat(
        F.when(is_touch, F.array(touch)).otherwise(nothing),
        F.when(is_order, F.array(probe(F.col("us"), False), probe(F.col("us") - F.lit(span), True))).otherwise(nothing),
    )
    rows = base.select("user_id", "event_id", F.explode(found).alias("r")).select("user_id", "event_id", "r.*")
    return rows.withColumn("unit", F.floor(F.col("at") / F.lit(unit))).withColumn("chunk", F.floor(F.col("at") / F.lit(span)))


def _order(tail: bool) -> list[Column]:
    """Order inside a unit; the row that carries the rest of the chunk comes first."""
    if tail:
        return [F.col("at").desc_nulls_first(), F.desc("kind"), F.desc("event_id")]
    return [F.col("at").asc_nulls_first(), F.asc("kind"), F.asc("event_id")]


def _running(keys: list[str], order: list[Column], own: bool = True) -> Window:
    """The rows up to the current one; without ``own``, before it."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)


def conversion_touches(
    events: DataFrame,
    vocab: Vocabulary = DEFAULT_VOCABULARY,
    lookback_hours: float = 24,
    half_life_hours: float = 6.0,
) -> DataFrame:
    """One row per conversion with at least one touch in ``[t - lookback, t)``.

    Columns: ``n`` touches, per touchpoint i the count ``n{i}`` and decayed weight ``w{i}``, indexes
    ``first`` and ``last`` of the first and last touch, and ``duration_mins`` from the first touch.
    """
    each = range(len(vocab.touchpoints))
    span, _ = _span(lookback_hours)
    half = half_life_hours * US_PER_HOUR
    rows = _in_units(events, vocab, lookback_hours)
    point = F.col("point")
    # weights are relative to the start of the chunk, so sums of its units add up
    rise = F.pow(F.lit(2.0), (F.col("at") - F.col("chunk") * F.lit(span)) / F.lit(float(half)))
    mark = F.when(point.isNotNull(), F.struct("at", "event_id", "point"))

    units = rows.groupBy("user_id", "chunk", "unit").agg(
        *[F.count(F.when(point == i, 1)).alias(f"n{i}") for i in each],
        *[F.sum(F.when(point == i, rise).otherwise(0.0)).alias(f"w{i}") for i in each],
        F.min(mark).alias("early"),
        F.max(mark).alias("late"),
        F.max((F.col("kind") == 0).cast("int")).alias("probed"),
    )

    def rest(side: str, order: Column) -> list[Column]:
        w = _running(["user_id", "chunk"], [order], own=False)
        sums = [F.coalesce(F.sum(f"{c}{i}").over(w), F.lit(0)).alias(f"{side}_{c}{i}") for c in "nw" for i in each]
        return [*sums, F.min("early").over(w).alias(f"{side}_early"), F.max("late").over(w).alias(f"{side}_late")]

    carried = units.select("user_id", "chunk", "unit", "probed", *rest("before", F.asc("unit")), *rest("after", F.desc("unit"))).where("probed = 1")
    both = rows.unionByName(carried.drop("probed"), allowMissingColumns=True)

    def read(tail: bool) -> DataFrame:
        w, side = _running(["user_id", "unit"], _order(tail)), "after" if tail else "before"
        sums = []
        for i in each:
            sums.append(F.sum(F.when(point == i, 1).otherwise(F.coalesce(f"{side}_n{i}", F.lit(0)))).over(w).alias(f"n{i}"))
            sums.append(F.sum(F.when(point == i, rise).otherwise(F.coalesce(f"{side}_w{i}", F.lit(0.0)))).over(w).alias(f"w{i}"))
        ends = [F.min(F.coalesce(mark, f"{side}_early")).over(w).alias("early"), F.max(F.coalesce(mark, f"{side}_late")).over(w).alias("late")]
        return both.select("user_id", "event_id", "conv_us", "tail", "chunk", *sums, *ends).where(F.col("tail") == F.lit(tail))

    # brought from the chunk's start to the conversion
    scale = F.pow(F.lit(2.0), -(F.col("conv_us") - F.col("chunk") * F.lit(span)) / F.lit(float(half)))
    per = (
        read(False)
        .unionByName(read(True))
        .withColumn("scale", scale)
        .groupBy("user_id", "conv_us", "event_id")
        .agg(
            *[F.sum(f"n{i}").alias(f"n{i}") for i in each],
            *[F.sum(F.col(f"w{i}") * F.col("scale")).alias(f"w{i}") for i in each],
            F.min("early").alias("early"),
            F.max("late").alias("late"),
        )
    )
    n = sum((F.col(f"n{i}") for i in each[1:]), F.col("n0"))
    w = sum((F.col(f"w{i}") for i in each[1:]), F.col("w0"))
    return per.withColumn("n", n).where(F.col("n") > 0).select(
        "user_id",
        F.timestamp_micros("conv_us").alias("conversion_time"),
        "event_id",
        "n",
        w.alias("w"),
        *[f"n{i}" for i in each],
        *[f"w{i}" for i in each],
        F.col("early.point").alias("first"),
        F.col("late.point").alias("last"),
        ((F.col("conv_us") - F.col("early.at")) / F.lit(float(US_PER_MINUTE))).alias("duration_mins"),
    )


def _credit(model: str, i: int, first_weight: float, last_weight: float) -> Column:
    n, ni = F.col("n"), F.col(f"n{i}")
    first, last = (F.col("first") == i).cast("double"), (F.col("last") == i).cast("double")
    if model == "first_touch":
        return first
    if model == "last_touch":
        return last
    if model == "linear":
        return ni / n
    if model == "time_decay":
        return F.col(f"w{i}") / F.col("w")
    middle = 1.0 - first_weight - last_weight
    return (
        F.when(n == 1, first)
        .when(n == 2, first * (first_weight + middle / 2) + last * (last_weight + middle / 2))
        .otherwise(first * first_weight + last * last_weight + (ni - first - last) * F.try_divide(F.lit(middle), n - 2))
    )


def credits(
    touches: DataFrame,
    vocab: Vocabulary = DEFAULT_VOCABULARY,
    models: tuple[str, ...] = MODELS,
    first_weight: float = 0.4,
    last_weight: float = 0.4,
) -> DataFrame:
    """Credit per model and touchpoint, all models from one aggregate: ``model, touchpoint, conversions, attribution_pct``."""
    points = list(vocab.touchpoints)
    sums = touches.agg(
        *[
            F.sum(_credit(m, i, first_weight, last_weight)).alias(f"{m}__{i}")
            for m in models
            for i in range(len(points))
        ]
    )
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(p).alias("touchpoint"), F.col(f"{m}__{i}").alias("conversions"))
            for m in models
            for i, p in enumerate(points)
        ]
    )
    rows = sums.select(F.explode(cells).alias("c")).select("c.*").where(F.col("conversions") > 1e-9)
    total = F.sum("conversions").over(Window.partitionBy("model"))
    return rows.withColumn("attribution_pct", percent(F.col("conversions"), total))


def first_touch(touches: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    return credits(touches, vocab, ("first_touch",))


def last_touch(touches: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    return credits(touches, vocab, ("last_touch",))


def linear(touches: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    return credits(touches, vocab, ("linear",))


def time_decay(touches: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Half-life is fixed when the touches are built (``conversion_touches(half_life_hours=...)``)."""
    return credits(touches, vocab, ("time_decay",))


def position_based(
    touches: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, first_weight: float = 0.4, last_weight: float = 0.4
) -> DataFrame:
    return credits(touches, vocab, ("position_based",), first_weight, last_weight)


def compare_models(touches: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Every touchpoint with its share under each model, 0 where it gets no credit."""
    c = credits(touches, vocab)
    wide = c.groupBy("touchpoint").agg(
        *[F.max(F.when(F.col("model") == m, F.col("attribution_pct"))).alias(f"{m}_pct") for m in MODELS]
    )
    return (
        label_rows(touches.sparkSession, vocab.touchpoints, "touchpoint")
        .join(wide, "touchpoint", "left")
        .select("touchpoint", *[F.coalesce(f"{m}_pct", F.lit(0.0)).alias(f"{m}_pct") for m in MODELS])
    )


def journey_stats(touches: DataFrame) -> DataFrame:
    base = touches.agg(
        F.count(F.lit(1)).alias("total_conversions"),
        F.avg("n").alias("avg_journey_length"),
        F.avg("duration_mins").alias("avg_journey_duration_mins"),
    )
    return base.select(
        "total_conversions",
        "avg_journey_length",
        scalar_quantile(touches, "n", 0.5).alias("median_journey_length"),
        "avg_journey_duration_mins",
        scalar_quantile(touches, "duration_mins", 0.5).alias("median_journey_duration_mins"),
    )


def channel_influence(touches: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Appearances per touchpoint and where its first occurrence lies in the journey."""
    points = list(vocab.touchpoints)
    cells = []
    for i, p in enumerate(points):
        ni = F.col(f"n{i}")
        is_first = F.col("first") == i
        is_last = ~is_first & (F.col("last") == i) & (ni == 1)
        cells.append(
            F.struct(
                F.lit(p).alias("touchpoint"),
                ni.alias("appearances"),
                is_first.cast("int").alias("f"),
                is_last.cast("int").alias("l"),
                (~is_first & ~is_last).cast("int").alias("m"),
            )
        )
    rows = touches.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where(F.col("appearances") > 0)
    g = rows.groupBy("touchpoint").agg(
        F.sum("appearances").alias("total_appearances"),
        F.sum("f").alias("as_first_touch"),
        F.sum("l").alias("as_last_touch"),
        F.sum("m").alias("as_middle_touch"),
    )
    total = touches.agg(F.count(F.lit(1)).alias("n")).scalar()
    return g.withColumn("appearance_rate", percent(F.col("total_appearances"), total))


def path_hashes(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, lookback_hours: float = 24) -> DataFrame:
    """``user_id, conv_us, event_id, n, h0, h1, first`` of every conversion with touches: length and hashes of its touch path.

    A hash is a polynomial in the touches, so that of two joined stretches follows from theirs and their lengths: running sums
    over rows and units give the hashes of heads and tails, as they give counts.
    """
    rows = _in_units(events, vocab, lookback_hours)
    code = (F.col("point") + 1).cast("long")
    fields = [(p, base, pow(base, -1, p)) for p, base in FIELDS]

    def total(c: Column, w: Window | None = None) -> Column:
        return F.coalesce(F.sum(c).over(w) if w is not None else F.sum(c), F.lit(0))

    later = F.count("point").over(_running(["user_id", "unit"], _order(True)))
    inside = rows.withColumn("later", later)
    is_touch = F.col("point").isNotNull()
    units = inside.groupBy("user_id", "chunk", "unit").agg(
        F.count("point").alias("n"),
        *[(total(F.when(is_touch, code * power(b, p, F.col("later") - 1) % F.lit(p))) % F.lit(p)).alias(f"u{k}") for k, (p, b, _) in enumerate(fields)],
        F.max((F.col("kind") == 0).cast("int")).alias("probed"),
        F.min(F.when(is_touch, F.struct("at", "event_id", "point"))).alias("early"),
    )
    chunk = ["user_id", "chunk"]
    up, down = [F.asc("unit")], [F.desc("unit")]
    units = units.withColumn("upto", total(F.col("n"), _running(chunk, up))).withColumn("beyond", total(F.col("n"), _running(chunk, down)) - F.col("n"))
    rest = [(F.col("upto") - F.col("n")).alias("before_n"), F.col("beyond").alias("after_n")]
    for k, (p, b, inverse) in enumerate(fields):
        u = F.col(f"u{k}")
        left = total(u * power(inverse, p, F.col("upto")) % F.lit(p), _running(chunk, up, own=False)) % F.lit(p)
        rest.append((left * power(b, p, F.col("upto") - F.col("n")) % F.lit(p)).alias(f"before_h{k}"))
        rest.append((total(u * power(b, p, F.col("beyond")) % F.lit(p), _running(chunk, down, own=False)) % F.lit(p)).alias(f"after_h{k}"))
    ends = [F.min("early").over(_running(chunk, up, own=False)).alias("before_early"), F.min("early").over(_running(chunk, down, own=False)).alias("after_early")]
    carried = units.select("user_id", "chunk", "unit", "probed", *rest, *ends).where("probed = 1").drop("probed")
    both = rows.unionByName(carried, allowMissingColumns=True)
    mark = F.when(is_touch, F.struct("at", "event_id", "point"))

    def read(tail: bool) -> DataFrame:
        w, side = _running(["user_id", "unit"], _order(tail)), "after" if tail else "before"
        carries = F.col(f"{side}_n").isNotNull()
        at = both.withColumn("length", total(F.when(is_touch, 1).otherwise(F.coalesce(f"{side}_n", F.lit(0))), w))
        hashes = []
        for k, (p, b, inverse) in enumerate(fields):
            value = F.when(is_touch, code).otherwise(F.coalesce(f"{side}_h{k}", F.lit(0)))
            if tail:
                place = power(b, p, F.when(carries, 0).otherwise(F.greatest(F.col("length") - 1, F.lit(0))))
                hashes.append((total(value * place % F.lit(p), w) % F.lit(p)).alias(f"h{k}"))
            else:
                gathered = total(value * power(inverse, p, F.col("length")) % F.lit(p), w) % F.lit(p)
                hashes.append((gathered * power(b, p, F.col("length")) % F.lit(p)).alias(f"h{k}"))
        early = F.min(F.coalesce(mark, f"{side}_early")).over(w).alias("early")
        return at.select("user_id", "event_id", "conv_us", "tail", "length", *hashes, early).where(F.col("tail") == F.lit(tail))

    def of(tail: bool, c: str) -> Column:
        return F.max(F.when(F.col("tail") == F.lit(tail), F.col(c)))

    wide = read(False).unionByName(read(True)).groupBy("user_id", "conv_us", "event_id").agg(
        of(False, "length").alias("head"),
        of(True, "length").alias("back"),
        *[of(t, f"h{k}").alias(f"{x}{k}") for k in range(len(fields)) for t, x in ((False, "hh"), (True, "th"))],
        F.min("early").alias("early"),
    )
    joined = [((F.col(f"th{k}") * power(b, p, F.col("head")) + F.col(f"hh{k}")) % F.lit(p)).alias(f"h{k}") for k, (p, b, _) in enumerate(fields)]
    return wide.select("user_id", "conv_us", "event_id", (F.col("head") + F.col("back")).alias("n"), *joined, F.col("early.point").alias("first")).where("n > 0")


def top_paths(
    events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, lookback_hours: float = 24, n: int = 10
) -> DataFrame:
    """Commonest full touch paths before a conversion; equal counts by the path's text.

    Paths are counted by their hashes and lengths.  Texts are fetched for one conversion of each path that may be among the ``n``: those
    of higher count, and of the ties at the n-th count those whose first touch, then whose first ``FIRST_TOUCHES`` touches, sort early enough.
    """
    scratch = Scratch(events.sparkSession)
    points = list(vocab.touchpoints)
    name = F.create_map(*[F.lit(x) for i, p in enumerate(points) for x in (i, p)])
    hashes = path_hashes(events, vocab, lookback_hours)
    one = F.struct("user_id", "conv_us", "event_id", F.try_element_at(name, F.col("first")).alias("begin"))
    counts = hashes.groupBy("n", "h0", "h1").agg(F.count(F.lit(1)).alias("count"), F.min(one).alias("one"))
    counted = scratch.stored(counts.select("count", "one.*"), "paths")
    kept = scratch.stored(not_after(counted, n, "begin"), "paths-begun")
    span, _ = _span(lookback_hours)
    us = F.unix_micros("event_time")
    touches = events.where(F.col("event_type").isin(points)).select(F.col("user_id").alias("_user"), us.alias("us"), F.col("event_id").alias("_id"), "event_type")

    def texts(chosen: DataFrame, most: int | None) -> DataFrame:
        met = chosen.join(touches, (F.col("user_id") == F.col("_user")) & (F.col("us") >= F.col("conv_us") - F.lit(span)) & (F.col("us") < F.col("conv_us")))
        key = ["user_id", "conv_us", "event_id", "count"]
        if most is not None:
            w = Window.partitionBy(*key).orderBy("us", "_id")
            met = met.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
        return met.groupBy(*key).agg(F.expr(f"listagg(event_type, '{ARROW}') WITHIN GROUP (ORDER BY us, _id)").alias("path"))

    begun = scratch.stored(not_after(texts(kept, FIRST_TOUCHES), n, "path"), "paths-first")
    best = texts(begun.drop("path"), None).select("path", "count").orderBy(F.desc("count"), "path").limit(n)
    out = stored(best, "paths-best")
    scratch.close()
    return out


def platform_attribution(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    is_order = F.col("event_type") == vocab.order
    g = (
        events.where(F.col("platform").isNotNull())
        .groupBy("platform")
        .agg(F.sum(is_order.cast("long")).alias("conversions"), F.countDistinct("user_id").alias("total_users"))
        .where(F.col("conversions") > 0)
    )
    return g.select(
        "platform",
        "conversions",
        percent(F.col("conversions"), F.sum("conversions").over(Window.partitionBy())).alias("conversion_pct"),
        "total_users",
        percent(F.col("conversions"), F.col("total_users")).alias("cvr"),
    )


def device_attribution(
    events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, device: str = "device_family", n: int = 10
) -> DataFrame:
    o = events.where((F.col("event_type") == vocab.order) & F.col(device).isNotNull())
    g = o.groupBy(device).agg(F.count(F.lit(1)).alias("conversions"))
    total = o.agg(F.count(F.lit(1)).alias("n")).scalar()
    return g.orderBy(F.desc("conversions"), device).limit(n).select(
        device, "conversions", percent(F.col("conversions"), total).alias("conversion_pct")
    )


def customer_status_attribution(
    events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, key: str = "customer_status"
) -> DataFrame:
    """Homepage rows by status: distinct users, and rows (not users) of users who ever ordered."""
    status = F.coalesce(F.get_json_object("event_properties", f"$.{key}"), F.lit("unknown"))
    is_order = F.col("event_type") == vocab.order
    # one row per (user, status) first; whether the user ordered is joined on afterwards
    home = (
        events.where(F.col("event_type") == vocab.homepage)
        .groupBy("user_id", status.alias("customer_status"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    buyers = events.where(is_order).select("user_id").distinct().withColumn("converted", F.lit(True))
    g = home.join(buyers, "user_id", "left").groupBy("customer_status").agg(
        F.count(F.lit(1)).alias("users"), F.sum(F.when(F.col("converted"), F.col("n")).otherwise(0)).alias("conversions")
    )
    return g.withColumn("cvr", percent(F.col("conversions"), F.col("users")))

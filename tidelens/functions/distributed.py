"""Kernels for order-dependent work that must not pass through one task.

A window over one hot key, or over no key at all, sorts everything in a single task.  The kernels
here split such work: rows are cut into chunks (time chunks of one user, value ranges of one
column), each chunk is handled by itself, and only one small row per chunk is carried across.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelens.functions.columns import US_PER_DAY, US_PER_HOUR, US_PER_MINUTE, US_PER_SECOND, micros
from tidelens.functions.tables import Scratch, stored

RANGES_PER_OCTAVE = 1024
PAIR_BLOCK = 512
PAIR_SEED = 64
#: Pairs that one task forms in :func:`pair_sums`, and keys of an item beyond which its pairs are dealt to several tasks.
PAIR_TASK = 2_000_000
PAIR_HOT = 32_768
#: Times that a task forms each possible pair, and twice that often in all, for :func:`pair_sums` to send sums in place of lists.
PAIR_REPEATS = 16
#: Times :data:`PAIR_TASK` that a task forms where it owns a block of items, and pairs that it holds at once.
PAIR_OWNED = 24
PAIR_CHUNK = 2_000_000
#: Rows of items that one task packs in :func:`item_pairs` and :func:`pair_sums`.
PAIR_ROWS = 500_000
#: Events of one chunk of a user's time, and the widths of chunks: day, hour, minute, second.
CHUNK_ROWS = 4096
CHUNK_LEVELS = (US_PER_DAY, US_PER_HOUR, US_PER_MINUTE, US_PER_SECOND)


# --- value ranges ---------------------------------------------------------------------------


def _value_range(column: str, width: float | None = None) -> Column:
    """Order-preserving range number of a numeric value: a fixed number of ranges per power of two.

    The ranges do not depend on the data, so no pass is needed to find them; a group has at most
    2 * 2100 * RANGES_PER_OCTAVE of them whatever it holds.  ``width`` gives equal-width ranges
    instead, for values such as instants whose spread is known.
    """
    v = F.col(column).cast("double")
    if width is not None:
        return F.floor(v / F.lit(float(width))).cast("long")
    size = F.floor(F.log2(F.abs(v)) * RANGES_PER_OCTAVE) + 1100 * RANGES_PER_OCTAVE
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("long")


def value_positions(
    df: DataFrame,
    column: str,
    by: Sequence[str] = (),
    needed: Callable[[Column, Column, Column], Column] | None = None,
    width: float | None = None,
) -> DataFrame:
    """Distinct values per group with their counts and positions in sorted order.

    Returns ``by..., column, cnt, before, total``: rows equal to the value, rows of the group below
    it, rows of the group.  Rows are counted per value first, so a frequent value is one row; the
    running count is taken inside value ranges and shifted by the totals of the ranges below.
    ``needed(below, inside, total)`` limits the output to ranges of interest before values are sorted.
    """
    by = list(by)
    hist = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("cnt"))
    ranged = hist.withColumn("_range", _value_range(column, width))
    group = Window.partitionBy(*by)
    below = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Only range totals reach these two windows, a bounded number per group.
    offsets = (
        ranged.groupBy(*by, "_range")
        .agg(F.sum("cnt").alias("_in"))
        .withColumn("_below", F.sum("_in").over(below) - F.col("_in"))
        .withColumn("total", F.sum("_in").over(group))
    )
    if needed is not None:
        offsets = offsets.where(needed(F.col("_below"), F.col("_in"), F.col("total")))
    offsets = offsets.drop("_in")
    keys = [*by, "_range"]
    a, b = ranged.alias("a"), offsets.alias("b")
    cond = F.col("a._range") == F.col("b._range")
    for k in by:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = a.join(b, cond).select(
        *[F.col(f"a.{k}").alias(k) for k in [*keys, column, "cnt"]], F.col("b._below").alias("_below"), F.col("b.total").alias("total")
    )
    inside = Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(
        *by, column, "cnt", (F.col("_below") + F.sum("cnt").over(inside) - F.col("cnt")).alias("before"), "total"
    )


def quantiles(df: DataFrame, column: str, points: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per entry of ``points``."""

    def at(q: float, total: Column) -> Column:
        return (total - 1) * F.lit(float(q))

    def holds(position: Column, below: Column, inside: Column) -> Column:
        return (below <= position) & (position < below + inside)

    def needed(below: Column, inside: Column, total: Column) -> Column:
        out = None
        for q in points.values():
            for position in (F.floor(at(q, total)), F.ceil(at(q, total))):
                hit = holds(position, below, inside)
                out = hit if out is None else out | hit
        return out

    pos = value_positions(df, column, by, needed)
    v, before, cnt = F.col(column), F.col("before"), F.col("cnt")
    aggs = []
    for name, q in points.items():
        p = at(q, F.col("total"))
        lo, hi = F.floor(p), F.ceil(p)
        aggs += [
            F.max(F.when(holds(lo, before, cnt), v)).cast("double").alias(f"_lo_{name}"),
            F.max(F.when(holds(hi, before, cnt), v)).cast("double").alias(f"_hi_{name}"),
            F.max(p - lo).alias(f"_f_{name}"),
        ]
    out = pos.groupBy(*by).agg(*aggs)
    return out.select(
        *by,
        *[
            (F.col(f"_lo_{n}") + F.col(f"_f_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n)
            for n in points
        ],
    )


def scalar_quantile(df: DataFrame, column: str, q: float) -> Column:
    """A global quantile as a lazy scalar sub-query."""
    return quantiles(df, column, {"q": q}).scalar()


def percentile_ranks(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Adds, for each ``source -> target``, the average-tie rank divided by the non-null count.

    The frame is evaluated once and stored; all columns are ranked together, by name.  Doubles are compared to twelve significant digits,
    so values that differ by the order of addition only are ties.
    """
    out = stored(df, "ranked")
    kinds = {c: isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) for c in columns}
    mixed = any(kinds.values())

    def key(c: str) -> Column:
        if not kinds[c]:
            return F.col(c).cast("double" if mixed else "decimal(38,0)" if isinstance(df.schema[c].dataType, T.DecimalType) else "long")
        v = F.col(c).cast("double")
        scale = F.pow(F.lit(10.0), F.lit(11) - F.floor(F.log10(F.abs(v))))
        return F.when((v == 0) | F.isnan(v) | (F.abs(v) == float("inf")), v).otherwise(F.rint(v * scale) / scale)

    long = out.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_name"), key(c).alias("_ranked")) for c in columns])).alias("x")).select("x.*")
    ranks = value_positions(long, "_ranked", ["_name"]).select(
        "_name", F.col("_ranked").alias("_value"), ((F.col("before") + (F.col("cnt") + 1) / F.lit(2.0)) / F.col("total")).alias("_rank")
    )
    ranks = stored(ranks, "ranks")
    for source, target in columns.items():
        r = ranks.where(F.col("_name") == source).select("_value", F.col("_rank").alias(target))
        out = out.join(r, key(source) == F.col("_value"), "left").drop("_value")
    return out


def ordinal_cuts(df: DataFrame, value: str, tiebreak: str, n: int) -> DataFrame:
    """One row with the (value, tiebreak) pairs at the n-1 inner cuts of the ordinal rank.

    Cut i is rank ``floor(1 + (rows-1) * i/n)``.  Only rows that share a cut value are put in order
    by the tiebreak, so no global row number is taken.
    """
    cuts = range(1, n)

    def at(i: int, total: Column) -> Column:
        return F.floor(1 + (total - 1) * F.lit(i / n))

    def needed(below: Column, inside: Column, total: Column) -> Column:
        out = None
        for i in cuts:
            hit = (below < at(i, total)) & (at(i, total) <= below + inside)
            out = hit if out is None else out | hit
        return out

    pos = value_positions(df, value, needed=needed)
    before, upto, total = F.col("before"), F.col("before") + F.col("cnt"), F.col("total")
    cells = [
        F.when(
            (before < at(i, total)) & (at(i, total) <= upto),
            F.struct(F.lit(i).alias("_cut"), F.col(value).alias("_at"), (at(i, total) - before).alias("_k")),
        )
        for i in cuts
    ]
    at_cut = pos.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).select("c.*")  # n-1 rows
    rows = df.select(F.col(value).alias("_value"), F.col(tiebreak).alias("_tie"))
    members = rows.join(F.broadcast(at_cut), F.col("_value") == F.col("_at")).select("_cut", "_tie")
    ranked = value_positions(members, "_tie", ["_cut"]).join(F.broadcast(at_cut), "_cut")
    hit = ranked.where((F.col("before") < F.col("_k")) & (F.col("_k") <= F.col("before") + F.col("cnt")))
    return hit.agg(
        *[F.max(F.when(F.col("_cut") == i, F.col("_at"))).alias(f"v{i}") for i in cuts],
        *[F.max(F.when(F.col("_cut") == i, F.col("_tie"))).alias(f"t{i}") for i in cuts],
    )


def ordinal_bin(cuts: Column, value: str, tiebreak: str, n: int) -> Column:
    """Bin 1..n of a row given the cuts of :func:`ordinal_cuts` as a struct."""
    out = F.lit(1)
    for i in range(1, n):
        above = (F.col(value) > cuts[f"v{i}"]) | ((F.col(value) == cuts[f"v{i}"]) & (F.col(tiebreak) > cuts[f"t{i}"]))
        out = out + F.when(above, 1).otherwise(0)
    return out.cast("int")


def ordinal_ranks(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the 1-based place of each row in the order of the whole frame.

    Rows are dealt by ranges of the order and numbered inside their range; the rows of the ranges before are added.  The ranges are a
    written table, so both passes see the same ones; one array with a number for each range is all that is shared.
    """
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    dealt = stored(dealt, "ranks")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    table = sizes.agg(F.collect_list(F.struct("_range", "_n")).alias("t")).scalar()
    before = F.aggregate(F.filter("_table", lambda x: x["_range"] < F.col("_range")), F.lit(0).cast("long"), lambda a, x: a + x["_n"])
    here = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_here", here).withColumn("_table", table).withColumn(name, before + F.col("_here")).drop("_range", "_here", "_table")


def first_rows(df: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in that order; None: all rows, which then need no global sort."""
    return df if n is None else df.orderBy(*order).limit(n)


def scalar_row(df: DataFrame) -> Column:
    """The single row of a frame as a struct from a lazy scalar sub-query."""
    return df.select(F.struct(*df.columns).alias("row")).scalar()


def total_of(df: DataFrame, column: str) -> Column:
    """Sum of a column over the whole frame as a lazy scalar sub-query (no single-task window)."""
    return df.agg(F.sum(column).alias("s")).scalar()


# --- time chunks ----------------------------------------------------------------------------


def with_chunks(events: DataFrame, most: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``us`` (event time in microseconds) and ``chunk``, the start of the event's stretch of its user's time.

    A user's day is one chunk unless it holds more than ``most`` events; then it is split into hours, an hour with too many into minutes,
    a minute into seconds.  One pass counts days; finer counts read only what is still too large, and are tables with one row for each
    stretch that is split.  Chunks of one user are disjoint and in the order of their starts.
    """
    timed = events.withColumn("us", micros(F.col("event_time")))
    chunk = F.floor(F.col("us") / F.lit(CHUNK_LEVELS[0])) * F.lit(CHUNK_LEVELS[0])
    out, rest = timed.withColumn("chunk", chunk), timed.select("user_id", "us")
    for width, finer in zip(CHUNK_LEVELS, CHUNK_LEVELS[1:], strict=False):
        start = F.floor(F.col("us") / F.lit(width)) * F.lit(width)
        counts = rest.groupBy("user_id", start.alias("_start")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
        split = stored(counts.select(F.col("user_id").alias("_user"), "_start"), "chunk-splits")
        if split.isEmpty():
            break
        inside = F.col("user_id").eqNullSafe(F.col("_user")) & (start == F.col("_start"))
        fine = F.floor(F.col("us") / F.lit(finer)) * F.lit(finer)
        out = out.join(split, inside, "left").withColumn("chunk", F.when(F.col("_start").isNotNull(), fine).otherwise(F.col("chunk"))).drop("_user", "_start")
        rest = rest.join(split, inside, "left_semi")
    return out


def chunk_window() -> Window:
    return Window.partitionBy("user_id", "chunk").orderBy("us", "event_id")


def transition_counts(events: DataFrame) -> DataFrame:
    """Counts of (event, next event of the same user).

    Transitions inside a time chunk come from a window per (user, chunk); those that cross chunks
    come from the first and last event of each chunk.
    """
    e = with_chunks(events.select("user_id", "event_time", "event_type", "event_id"))
    at = F.struct("us", "event_id")
    inside = (
        e.withColumn("next_event", F.lead("event_type").over(chunk_window()))
        .where(F.col("next_event").isNotNull())
        .groupBy("event_type", "next_event")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ends = e.groupBy("user_id", "chunk").agg(
        F.min_by("event_type", at).alias("first_event"), F.max_by("event_type", at).alias("event_type")
    )
    across = (
        ends.withColumn("next_event", F.lead("first_event").over(Window.partitionBy("user_id").orderBy("chunk")))
        .where(F.col("next_event").isNotNull())
        .groupBy("event_type", "next_event")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return inside.unionByName(across).groupBy("event_type", "next_event").agg(F.sum("n").alias("count"))


# --- pairs ----------------------------------------------------------------------------------


def item_pairs(
    rows: DataFrame,
    keys: Sequence[str],
    item: str,
    carry: Sequence[str] = (),
    block: int = PAIR_BLOCK,
    task: int = PAIR_TASK,
    most: int = PAIR_ROWS,
) -> DataFrame:
    """Unordered item pairs that share a key: ``keys..., a, b [, carry_a, carry_b]`` with a < b.

    ``rows`` must be distinct on (keys, item).  The items of a key travel once, into one packed list that forms its pairs.  A key with
    more than ``block`` items is cut into item blocks; their lists meet block against block in separate tasks, each pair once.  The
    number of tasks follows the numbers of rows and pairs, so what one of them holds does not grow.
    """
    keys = list(keys)
    known = rows.where(_all_known([*keys, item]))
    sizes = stored(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "pair-sizes")
    n = F.col("_n").cast("double")
    facts = sizes.agg(F.sum(n).alias("rows"), F.sum(n * F.least(n, F.lit(float(block))) / 2).alias("pairs"), F.max("_n").alias("most")).first()
    tasks = max(1, math.ceil((facts["rows"] or 0) / most), math.ceil((facts["pairs"] or 0) / task))
    entry = F.struct(F.col(item).alias("_x"), *[F.col(c).alias(f"_x_{c}") for c in carry])
    large = (facts["most"] or 0) > block
    if large:
        blocks = sizes.where(F.col("_n") > block).select(*keys, F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_blocks"))
        known = known.join(blocks, keys, "left").withColumn("_own", F.coalesce(F.pmod(F.xxhash64(item), F.col("_blocks")), F.lit(0)).cast("int"))
    place = [*keys, "_own", "_blocks"] if large else keys
    packed = known.repartition(tasks, *place).groupBy(*place).agg(F.sort_array(F.collect_list(entry)).alias("_l"))

    def named(df: DataFrame, x: Column, y: Column) -> DataFrame:
        sides = [F.when(up, x[f"_x_{c}"]).otherwise(y[f"_x_{c}"]).alias(f"{c}_{side}") for side, up in (("a", x["_x"] < y["_x"]), ("b", x["_x"] > y["_x"])) for c in carry]
        return df.select(*keys, F.least(x["_x"], y["_x"]).alias("a"), F.greatest(x["_x"], y["_x"]).alias("b"), *sides)

    # positions are from 0, slices from 1
    at = packed.where(F.size("_l") > 1).select(*keys, F.posexplode("_l").alias("_at", "_p"), "_l")
    pairs = named(at.select(*keys, "_p", F.explode(F.slice("_l", F.col("_at") + 2, F.size("_l"))).alias("_q")), F.col("_p"), F.col("_q"))
    if not large:
        return pairs
    lists = stored(packed.where("_blocks is not null"), "pair-blocks")
    left = lists.select(*keys, F.col("_l").alias("_p"), F.col("_own").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_j"))
    right = lists.select(*keys, F.col("_l").alias("_q"), F.col("_own").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_i"))
    met = left.where("_i < _j").join(right.where("_i < _j"), [*keys, "_i", "_j"])
    crossed = met.select(*keys, F.explode("_p").alias("_p"), "_q").select(*keys, "_p", F.explode("_q").alias("_q"))
    return pairs.unionByName(named(crossed, F.col("_p"), F.col("_q")))


def distinct_rows(rows: DataFrame, columns: Sequence[str], most: int = PAIR_ROWS) -> DataFrame:
    """The distinct rows of ``columns`` as a table.  ``rows`` are evaluated once; each task takes about ``most`` of them."""
    scratch = Scratch(rows.sparkSession)
    src = scratch.stored(rows.select(*columns), "rows")
    found = stored(src.repartition(max(1, math.ceil(src.count() / most)), *columns).distinct(), "distinct-rows")
    scratch.close()
    return found


def _all_known(columns: Sequence[str]) -> Column:
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return known


def _pair_totals(items: int):
    """Function for mapInArrow: ``_a, _b, total`` of all pairs in a task's lists of item numbers (below ``items``, ascending) and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(items * items), np.zeros(items * items, bool)
        for b in batches:
            ids, w = b.column(0).flatten().to_numpy().astype(np.int64), b.column(1).flatten().to_numpy(zero_copy_only=False)
            length = pc.list_value_length(b.column(0)).to_numpy()
            left = np.repeat(np.cumsum(length), length) - np.arange(len(ids))  # items of the list from each place on
            at, ahead = np.arange(len(ids)), 1
            while len(at := at[left[at] > ahead]):
                pair = ids[at] * items + ids[at + ahead]
                np.add.at(total, pair, w[at] * w[at + ahead])
                met[pair] = True
                ahead += 1
        found = np.flatnonzero(met)
        for i in range(0, len(found), 1 << 17):
            part = found[i : i + (1 << 17)]
            columns = [pa.array((part // items).astype(np.int32)), pa.array((part % items).astype(np.int32)), pa.array(total[part])]
            yield pa.RecordBatch.from_arrays(columns, ["_a", "_b", "total"])

    return run


def _slicer():
    """Places of the slices that begin at ``at`` and are so long, one after the other; a nested function travels to tasks by itself."""

    def slices(at: np.ndarray, length: np.ndarray) -> np.ndarray:
        ends = np.cumsum(length)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + length, length)

    return slices


def _lists_by_block(starts: np.ndarray, first: np.ndarray, parts: np.ndarray, kind: type):
    """Function for mapInArrow: every list (hash of its key, item numbers, weights) once for each block that owns one of its items.

    Blocks begin at the item numbers ``starts`` and have the tasks from ``first`` on, ``parts`` of them, dealt by key.  What goes there is the
    list from its first item in the block on, as the owner of a pair is the smaller number.
    """
    slices = _slicer()

    def packed(values: np.ndarray, length: np.ndarray) -> pa.Array:
        cuts = np.concatenate([[0], np.cumsum(length) * values.itemsize]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(cuts), pa.py_buffer(values)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, w = b.column(1).flatten().to_numpy().astype(np.int32), b.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind)
            length = pc.list_value_length(b.column(1)).to_numpy()
            row = np.repeat(np.arange(len(length)), length)
            left = np.repeat(np.cumsum(length), length) - np.arange(len(ids))  # items of the list from each place on
            block = np.searchsorted(starts, ids, "right") - 1
            new = np.ones(len(ids), bool)
            new[1:] = (block[1:] != block[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new & (left > 1))
            task = first[block[at]] + b.column(0).to_numpy()[row[at]] % parts[block[at]]
            cuts = np.flatnonzero(np.diff(np.cumsum(left[at]) // PAIR_CHUNK, prepend=0))
            for i in np.split(np.arange(len(at)), cuts):
                if len(i):
                    values, n = slices(at[i], left[at[i]]), left[at[i]]
                    columns = [pa.array(task[i].astype(np.int32)), pa.array(block[at[i]].astype(np.int32)), packed(ids[values], n), packed(w[values], n)]
                    yield pa.RecordBatch.from_arrays(columns, ["_task", "_block", "_ids", "_ws"])

    return run


def _owned_totals(starts: np.ndarray, items: int, kind: type):
    """Function for mapInArrow: ``_a, _b, total`` of the pairs that a task's blocks own, from lists of :func:`_lists_by_block`.

    Owners are taken by number, so that the pairs of a few of them are held at once and added up.
    """
    slices, stops = _slicer(), np.append(starts[1:], items).astype(np.int32)

    def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
        length = np.diff(cuts) // np.dtype(kind).itemsize
        return np.frombuffer(column.buffers()[2], kind, int(length.sum()), int(cuts[0])), length

    def added(pair: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner, low = pair // items, pair.min() // items
        cells = int((owner.max() - low + 1) * items)
        if cells <= 8 * len(pair):
            place, met = pair - low * items, np.zeros(cells, bool)
            met[place] = True
            found = np.flatnonzero(met)
            return found + low * items, np.bincount(place, product, cells)[found]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        at = np.flatnonzero(np.diff(pair, prepend=-1))
        return pair[at], np.add.reduceat(product[order], at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [(*unpacked(b.column(2), np.int32), unpacked(b.column(3), kind)[0], stops[b.column(1).to_numpy()]) for b in batches if b.num_rows]
        if not read:
            return
        ids, length, w, stop = (np.concatenate(x) for x in zip(*read))
        del read
        ends = np.cumsum(length)
        owned = np.flatnonzero(ids < np.repeat(stop, length))
        left = ends[np.searchsorted(ends, owned, "right")] - owned - 1  # items of the list after each owner
        owned, left = owned[left > 0], left[left > 0]
        order = np.argsort(ids[owned], kind="stable")
        owned, left = owned[order], left[order]
        pair, total = np.zeros(0, np.int64), np.zeros(0)
        cuts = np.flatnonzero(np.diff(np.cumsum(left) // PAIR_CHUNK, prepend=0))
        for i in np.split(np.arange(len(owned)), cuts):
            if not len(i):
                continue
            at, n = owned[i], left[i]
            other = slices(at + 1, n)
            formed = np.repeat(ids[at].astype(np.int64) * items, n) + ids[other]
            product = np.repeat(w[at].astype(float), n) * w[other]
            pair, total = added(np.concatenate([pair, formed]), np.concatenate([total, product]))
            # the last owner may have more lists in the next round
            done = int(np.searchsorted(pair, int(ids[at[-1]]) * items)) if i[-1] + 1 < len(owned) else len(pair)
            for j in range(0, done, 1 << 17):
                part = pair[j : min(done, j + (1 << 17))]
                columns = [pa.array((part // items).astype(np.int32)), pa.array((part % items).astype(np.int32)), pa.array(total[j : j + len(part)])]
                yield pa.RecordBatch.from_arrays(columns, ["_a", "_b", "total"])
            pair, total = pair[done:], total[done:]

    return run


def _owned_sums(lists: DataFrame, items: int, pairs: float, most: int, narrow: bool) -> DataFrame:
    """``_a, _b, total`` of packed lists: items in blocks that own about ``most`` pairs each, a task (or several) for each block.

    Only sums of 4,096 stretches of items and the blocks' bounds reach the driver.
    """
    stretch = math.ceil((items + 1) / 4096)
    owns = lists.select(F.posexplode("_ids").alias("_at", "_a"), F.col("_n")).groupBy(F.floor(F.col("_a") / stretch).alias("_s"))
    found = owns.agg(F.sum(F.col("_n") - 1 - F.col("_at")).alias("_p")).where("_p > 0").collect()
    sums = np.zeros(4097)
    for x in found:
        sums[x["_s"]] = x["_p"]
    upto = np.cumsum(sums)
    target = max(1.0, upto[-1] / math.ceil(max(1.0, upto[-1]) / most))
    begins = np.flatnonzero(np.diff(((upto - sums) // target).astype(int), prepend=-1))
    parts = np.array([max(1, math.ceil(x.sum() / (2 * most))) for x in np.split(sums, begins[1:])])
    starts, first = begins * stretch, np.cumsum(parts) - parts
    starts[0] = 0
    kind = np.uint8 if narrow else np.float64
    dealt = lists.select(F.pmod(F.xxhash64("_k"), F.lit(1 << 20)).alias("_h"), "_ids", "_ws")
    sent = dealt.mapInArrow(_lists_by_block(starts, first, parts, kind), "_task int, _block int, _ids binary, _ws binary")
    summed = sent.repartitionById(int(parts.sum()), "_task").mapInArrow(_owned_totals(starts, items + 1, kind), "_a int, _b int, total double")
    return summed if parts.max() == 1 else summed.groupBy("_a", "_b").agg(F.sum("total").alias("total"))


def pair_sums(rows: DataFrame, key: str, item: str, weight: str, block: int = PAIR_BLOCK, task: int = PAIR_TASK, hot: int = PAIR_HOT) -> DataFrame:
    """``a, b, total``: for unordered item pairs (a < b) that share a key, the sum over keys of the product of both weights.

    ``rows`` must be distinct on (key, item).  What travels is not a row per key and pair: a key's items are one packed list, the rarer item of
    a pair owns it, and pairs are formed and summed where their owner is.  Items are put into blocks that own about as many pairs each, and a
    list travels once to each block among its items (:func:`_owned_sums`).  Where there are as many tasks as items, each item of a key is
    sent to the task of that item, together with the key's more frequent items; the keys of an item in more than ``hot`` keys are then dealt to several
    tasks, whose sums are added, and keys of more than ``block`` items are cut into blocks that meet block against block.  The number of tasks follows
    the number of pairs.  Where few items (at most ``task`` different pairs) meet in very many keys, the sums of a task's keys are what
    travels: they are fewer than the lists by far, and a task adds them up in one array.
    """
    scratch = Scratch(rows.sparkSession)
    known = rows.where(F.col(key).isNotNull() & F.col(item).isNotNull())
    freq = known.groupBy(item).agg(F.count(F.lit(1)).alias("_f"))
    ids = stored(ordinal_ranks(freq, [F.asc("_f"), F.asc(item)], "_id").select(F.col(item).alias("_item"), F.col("_id").cast("int").alias("_id"), "_f"), "pair-items")
    most = ids.agg(F.max("_f"), F.min(F.when(F.col("_f") > hot, F.col("_id"))), F.count(F.lit(1)), F.sum("_f")).first()
    coded = known.join(ids, known[item] == ids["_item"]).select(F.col(key).alias("_k"), "_id", F.col(weight).cast("double").alias("_w"))
    packed = coded.repartition(max(1, math.ceil((most[3] or 0) / PAIR_ROWS)), "_k").groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_id", "_w"))).alias("_l"))
    packed = packed.select("_k", F.size("_l").alias("_n"), F.col("_l._id").alias("_ids"), F.col("_l._w").alias("_ws")).where(F.col("_n") > 1)
    lists = scratch.stored(packed, "pair-lists")
    wide = F.max(F.exists("_ws", lambda w: (w != F.floor(w)) | (w < 0) | (w > 255)))
    facts = lists.agg(F.sum(F.col("_n").cast("double") * F.col("_n") / 2), F.max("_n"), wide).first()
    large = (facts[1] or 0) > block
    tasks = max(1, math.ceil((facts[0] or 0) / task))
    possible = max(1, most[2] * (most[2] - 1) // 2)
    repeated = possible <= task and (facts[0] or 0) >= 2 * PAIR_REPEATS * possible
    if repeated:
        tasks = math.ceil(facts[0] / (PAIR_REPEATS * possible))

    if repeated and not large:
        sums = lists.repartition(tasks).select("_ids", "_ws").mapInArrow(_pair_totals(most[2] + 1), "_a int, _b int, total double")
        summed = sums.groupBy("_a", "_b").agg(F.sum("total").alias("total"))
    elif not repeated and tasks < most[2]:
        summed = _owned_sums(lists, most[2], facts[0], PAIR_OWNED * task, facts[2] is False)
    else:
        after = (F.col("_at") + 2, F.size("_ids"))  # positions are from 0, slices from 1
        if large:
            each = lists.where(F.col("_n") > block).select("_k", "_n", F.explode(F.arrays_zip("_ids", "_ws")).alias("_x"))
            own = F.pmod(F.xxhash64("_x._ids"), F.ceil(F.col("_n") / F.lit(block))).cast("int").alias("_own")
            cut = each.groupBy("_k", own).agg(F.sort_array(F.collect_list("_x")).alias("_l"))
            cut = scratch.stored(cut.select("_k", "_own", F.col("_l._ids").alias("_ids"), F.col("_l._ws").alias("_ws")), "pair-blocks")
            lists = lists.where(F.col("_n") <= block).select("_k", "_ids", "_ws").unionByName(cut.drop("_own"))
        # lists are small until each of their items takes the rest along, so they are dealt to as many tasks first
        met = lists.repartition(tasks).select("_k", F.posexplode("_ids").alias("_at", "_a"), "_ids", "_ws").where(F.col("_at") + 1 < F.size("_ids"))
        met = met.select("_k", "_a", F.col("_ws")[F.col("_at")].alias("_w"), F.slice("_ids", *after).alias("_ids"), F.slice("_ws", *after).alias("_ws"))
        if large:
            other = cut.select("_k", F.col("_own").alias("_j"), F.arrays_zip("_ids", "_ws").alias("_l"))
            left = cut.select("_k", "_own", F.explode(F.arrays_zip("_ids", "_ws")).alias("_x"))
            crossed = left.join(other, "_k").where(F.col("_own") != F.col("_j"))
            crossed = crossed.select("_k", F.col("_x._ids").alias("_a"), F.col("_x._ws").alias("_w"), F.filter("_l", lambda y: y["_ids"] > F.col("_x._ids")).alias("_l"))
            met = met.unionByName(crossed.select("_k", "_a", "_w", F.col("_l._ids").alias("_ids"), F.col("_l._ws").alias("_ws")).where(F.size("_ids") > 0))
        place = ["_a"]
        if most[1] is not None and not repeated:
            dealt = F.pmod(F.xxhash64("_k"), F.lit(math.ceil(most[0] / hot)))
            met = met.withColumn("_salt", F.when(F.col("_a") >= most[1], dealt).otherwise(0))
            place = ["_a", "_salt"]
        # dealt by the owner, so the sums by owner and other item need no further shuffle
        formed = (met if repeated else met.repartition(tasks, *place)).select(*place, "_w", F.explode(F.arrays_zip("_ids", "_ws")).alias("_y"))
        formed = formed.select(*place, F.col("_y._ids").alias("_b"), (F.col("_w") * F.col("_y._ws")).alias("_p"))
        summed = formed.groupBy(*place, "_b").agg(F.sum("_p").alias("total"))
        if len(place) > 1:
            summed = summed.groupBy("_a", "_b").agg(F.sum("total").alias("total"))
    one, two = (ids.select(F.col("_id").alias(i), F.col("_item").alias(x)) for i, x in (("_a", "_x"), ("_b", "_y")))
    return summed.join(one, "_a").join(two, "_b").select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "total")


def pair_counts(
    rows: DataFrame, keys: Sequence[str], item: str, min_count: int | Column | None = None, by: Sequence[str] = (), distinct: bool = False
) -> DataFrame:
    """Number of keys in which two items occur together: ``by..., a, b, count`` (``by`` is part of ``keys``).

    With a minimum count, items below it are dropped before any pair is formed: a pair cannot be
    more frequent than its rarer item, so the result is unchanged.  ``distinct``: rows are so already.
    """
    d = rows.select(*keys, item).where(F.col(item).isNotNull())
    if not distinct:
        d = distinct_rows(d, d.columns)
    if min_count is not None:
        frequent = d.groupBy(*by, item).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= min_count)
        d = d.join(frequent.drop("_c"), [*by, item], "left_semi")
    # by is part of the key, so items that meet agree on it
    entry = F.struct(*by, F.col(item).alias("_value"))
    sums = pair_sums(d.where(_all_known(keys)).select(F.struct(*keys).alias("_key"), entry.alias("_entry"), F.lit(1).alias("_one")), "_key", "_entry", "_one")
    pairs = sums.select(*[F.col("a")[c].alias(c) for c in by], F.col("a._value").alias("a"), F.col("b._value").alias("b"), F.col("total").cast("long").alias("count"))
    return pairs if min_count is None else pairs.where(F.col("count") >= min_count)


def top_pairs(
    rows: DataFrame, keys: Sequence[str], item: str, n: int, by: Sequence[str] = (), first: int = PAIR_SEED
) -> DataFrame:
    """The ``n`` pairs (of each ``by`` group) that most keys share: ``by..., a, b, count``; equal counts by a, then b.

    Exact, without forming all pairs.  A pair is no more frequent than its rarer item.  Pairs of the ``first`` most frequent items come
    first; their n-th count is a bound below which no pair can enter, so the next round only takes items that reach it.  While fewer than
    n pairs are known, the bound on items falls eightfold.  A round is one pass; groups that are finished take no part in the next.
    Rounds are bounded by the logarithm of the highest count, and only a table of bounds (one row a group) passes between them.
    """
    by = list(by) or ["_all"]
    scratch = Scratch(rows.sparkSession)
    src = rows.withColumn("_all", F.lit(0)) if by == ["_all"] else rows
    keys = [k for k in keys if k not in by]
    distinct = distinct_rows(src.where(F.col(item).isNotNull()), [*by, *keys, item])
    counts = distinct.groupBy(*by, item).agg(F.count(F.lit(1)).alias("_c"))
    known = scratch.stored(counts, "pair-items")
    sized = scratch.stored(distinct.join(known, [*by, item]), "pair-rows")
    leading = top_per_group(known, by, [F.desc("_c"), F.asc(item)], first + 1)
    bounds = leading.groupBy(*by).agg(
        F.when(F.count(F.lit(1)) <= first, 1).otherwise(F.min(F.when(F.col("rank") <= first, F.col("_c")))).cast("long").alias("_t")
    )
    found = None
    while True:
        bounds = scratch.stored(bounds, "pair-bounds")
        taken = sized.join(bounds, by).where(F.col("_c") >= F.col("_t")).drop("_t", "_c")
        pairs = item_pairs(taken, [*by, *keys], item).groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("count"))
        best = stored(top_per_group(pairs, by, [F.desc("count"), F.asc("a"), F.asc("b")], n), "pair-best")
        reached = best.groupBy(*by).agg(F.max("rank").alias("_n"), F.min("count").alias("_nth"))
        nth = F.when(F.col("_n") == n, F.col("_nth")).otherwise(0)
        state = bounds.join(reached, by, "left").withColumn("_nth", F.coalesce(nth, F.lit(0)))
        more = state.where(F.col("_t") > F.greatest("_nth", F.lit(1)))
        again = more.select(*by, F.when(F.col("_nth") > 0, F.col("_nth")).otherwise(F.greatest(F.floor(F.col("_t") / 8), F.lit(1))).cast("long").alias("_t"))
        if again.isEmpty():
            found = best if found is None else found.unionByName(best)
            break
        done = best.join(more.select(*by), by, "left_anti")
        done = stored(done, "pair-done")  # does not read the bounds of this round any more
        found = done if found is None else found.unionByName(done)
        bounds = again
    scratch.close()
    return found.select(*[c for c in by if c != "_all"], "a", "b", "count")


# --- ranking --------------------------------------------------------------------------------


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark prunes to k per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)

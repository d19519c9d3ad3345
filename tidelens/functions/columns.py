"""Pure column expressions: JSON access, rounding, bins, safe ratios, time arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

US_PER_SECOND = 1_000_000
US_PER_MINUTE = 60 * US_PER_SECOND
US_PER_HOUR = 60 * US_PER_MINUTE
US_PER_DAY = 24 * US_PER_HOUR
INF = float("inf")


def first_text(*found: Column) -> Column:
    """First text that is not empty."""
    given = [F.nullif(c, F.lit("")) for c in found]
    return given[0] if len(given) == 1 else F.coalesce(*given)


def first_number(*found: Column) -> Column:
    """First text that is a number other than zero."""
    given = [F.nullif(c.try_cast("double"), F.lit(0.0)) for c in found]
    return given[0] if len(given) == 1 else F.coalesce(*given)


def json_text(props: Column, *keys: str) -> Column:
    """First non-empty property among ``keys``; NULL when all are absent, empty or the JSON is bad."""
    return first_text(*[F.get_json_object(props, f"$.{k}") for k in keys])


def json_number(props: Column, *keys: str) -> Column:
    """First non-zero numeric property among ``keys``; NULL when there is none."""
    return first_number(*[F.get_json_object(props, f"$.{k}") for k in keys])


def with_json(df: DataFrame, props: str, keys: Sequence[str], prefix: str = "_js_") -> DataFrame:
    """Adds the texts of JSON properties as columns ``_js_<key>``, as ``get_json_object`` gives them, from one pass over the JSON.

    They come out of a generator, so no filter on them is moved below it, where each mention would make and read the JSON again.
    Of a key that occurs twice the first value counts, so such an object is written anew with the first ones.
    """
    names = F.json_object_keys(props)
    first = F.to_json(F.struct(*[F.get_json_object(props, f"$.{k}").alias(k) for k in keys]))
    single = df.withColumn("_single", F.when(F.size(names) > F.size(F.array_distinct(names)), first).otherwise(F.col(props)))
    return single.select(*df.columns, F.json_tuple("_single", *keys).alias(*[f"{prefix}{k}" for k in keys]))


def round_half_even(c: Column, digits: int) -> Column:
    """Round to nearest, ties to even, on the scaled double."""
    scale = 10.0**digits
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, NULL when the denominator is 0 or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent(num: Column, den: Column, digits: int | None = None) -> Column:
    p = ratio(num, den) * 100
    return p if digits is None else round_half_even(p, digits)


def flag_mean(c: Column) -> Column:
    """Share of TRUE values."""
    return F.avg(c.cast("double"))


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def bins(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(a, b]``; values on or below the lowest edge get NULL."""
    out: Column | None = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        cond = c > F.lit(lo)
        if hi != INF:
            cond = cond & (c <= F.lit(hi))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(None).cast("string"))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(c, F.lit(float(hi))), F.lit(float(lo)))


def micros(c: Column) -> Column:
    return F.unix_micros(c)


def whole_days(us: Column) -> Column:
    """Floor of a microsecond difference in days, also for negative spans."""
    return F.floor(us / F.lit(float(US_PER_DAY)))


def days(us: Column) -> Column:
    return us / F.lit(float(US_PER_DAY))


def minutes(us: Column) -> Column:
    return us / F.lit(float(US_PER_MINUTE))


def time_slot(hour: Column, slots: Sequence[tuple[str, int, int]], default: str) -> Column:
    """Label of the first half-open hour range holding ``hour``; ranges may wrap over midnight."""
    out: Column | None = None
    for name, start, end in slots:
        inside = (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(default)


def literal_rows(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """A constant table as an inline VALUES relation (a local relation, so the planner knows its size)."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, int):
            return str(v)
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    values = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def label_rows(spark: SparkSession, labels: Sequence[str], name: str = "label") -> DataFrame:
    return literal_rows(spark, ["position", name], [(i + 1, x) for i, x in enumerate(labels)])

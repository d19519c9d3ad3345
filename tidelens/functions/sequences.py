"""Hashes of sequences as sums, so that sequences are counted without being gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two fields and the bases of the polynomial hashes in them.
FIELDS = ((2147483647, 1103515245), (2147483629, 1610612741))


def power(base: int, field: int, exponent: Column) -> Column:
    """``base ** exponent`` modulo ``field`` for exponents below 2**30, by tables for each six bits."""
    out: Column | None = None
    for shift in range(0, 30, 6):
        table = ", ".join(f"{pow(base, k << shift, field)}L" for k in range(64))
        factor = F.get(F.expr(f"array({table})"), F.shiftright(exponent.cast("long"), shift).bitwiseAND(F.lit(63)).cast("int"))
        out = factor if out is None else out * factor % F.lit(field)
    return out


def not_after(df: DataFrame, n: int, text: str) -> DataFrame:
    """Rows not after the n-th by falling count, then text; all rows that equal the n-th are kept."""
    order = [F.desc("count"), F.asc(text)]
    last = df.select("count", text).orderBy(*order).limit(n).orderBy(F.asc("count"), F.desc(text)).limit(1)
    edge = last.select(F.struct(F.col("count").alias("c"), F.col(text).alias("t")).alias("edge")).scalar()
    return df.withColumn("_edge", edge).where((F.col("count") > F.col("_edge.c")) | ((F.col("count") == F.col("_edge.c")) & (F.col(text) <= F.col("_edge.t")))).drop("_edge")

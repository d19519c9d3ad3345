"""Tables and folders that every executor sees, and Arrow batches in pieces of bounded size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.session import checkpoint_dir

#: Bytes of text that a numpy kernel handles at once; a longer text is one piece of its own.
PIECE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names."""
    return f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage ends there, and no lost executor takes rows with it."""
    spark = df.sparkSession
    path = path or folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``saved`` that is not needed any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pieces(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = PIECE) -> Iterator[tuple[list[bytes], pa.RecordBatch]]:
    """Slices of the batches with the texts (null: empty) of column number ``text`` as UTF-8 bytes; about ``limit`` bytes each."""
    for b in batches:
        column = b.column(text).cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = done = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield [t or b"" for t in column.slice(start, stop - start).to_pylist()], b.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


#: Bits of a membership table: 8 MB, whatever the input.
TABLE_BITS = 26


def membership(values: DataFrame, bits: int = TABLE_BITS, hashed: bool = False) -> np.ndarray:
    """A table of 2**bits bits in which the bits of all values of the only column (long; ``hashed``: hashes already) are set.

    Its size is fixed.  It lets no member be missed; non-members pass it by chance, more of them the fuller it is, so an exact join has
    to follow.
    """
    value = F.col(values.columns[0])
    at = F.shiftrightunsigned(value if hashed else F.xxhash64(value), 64 - bits)
    words = values.select(F.shiftright(at, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def bits_set(table: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which of the hashes (unsigned) have their bit set?"""
    place = hashed >> np.uint64(64 - int(np.log2(len(table))) - 6)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)).astype(np.int64)) & 1 == 1


def in_table(table: Broadcast, at: Column) -> Column:
    """Condition on the column of xxhash64 values ``at``: is its bit set in the broadcast table?"""

    @F.pandas_udf("boolean")
    def set_(h: pd.Series) -> pd.Series:
        return pd.Series(bits_set(table.value, h.to_numpy(np.int64).view(np.uint64)))

    return set_(at)


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` (with an id) whose id is none of ``ids``, one row for each id (of repeated rows, any one).

    Rows that the membership table rules out stay where they are; only the others are shuffled for the exact join.
    """
    ids = ids.select(F.col(ids.columns[0]).cast("long").alias("gone")).where("gone is not null").distinct()
    repeated = docs.groupBy(docs[id_col].cast("long").alias("gone")).agg(F.count("*").alias("n")).where("n > 1").select("gone")
    table = docs.sparkSession.sparkContext.broadcast(membership(ids.union(repeated)))
    docs = docs.where(docs[id_col].isNotNull())
    maybe = in_table(table, F.xxhash64(docs[id_col].cast("long")))
    rest = docs.where(maybe).join(ids, F.col(id_col) == F.col("gone"), "left_anti").dropDuplicates([id_col])
    return docs.where(~maybe).unionByName(rest)

"""Tables that cut a plan: written to the folder all executors share, so no lost executor takes rows with it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidelens.session import checkpoint_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as a table and read again: evaluated once, however often it is read."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables of one operator; ``close`` deletes all of them but those that the result reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        return stored(df, name, self.paths[-1])

    def close(self) -> None:
        for p in self.paths:
            drop_path(self.spark, p)
        self.paths = []

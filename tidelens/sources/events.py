"""Readers, schema check, preprocessing and small event-table queries."""

from __future__ import annotations

import os
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelens.schema import EVENTS_STRUCT, EventSchema, Vocabulary

DEFAULT_SCHEMA = EventSchema()


class SchemaError(ValueError):
    """The table lacks columns the operators need."""


def missing_columns(df: DataFrame, schema: EventSchema = DEFAULT_SCHEMA) -> tuple[list[str], list[str]]:
    """Required and optional columns that are absent (metadata only, no job)."""
    have = set(df.columns)
    return [c for c in schema.required if c not in have], [c for c in schema.optional if c not in have]


def validate_schema(df: DataFrame, schema: EventSchema = DEFAULT_SCHEMA) -> list[str]:
    """Raises on missing required columns; returns the missing optional ones."""
    required, optional = missing_columns(df, schema)
    if required:
        raise SchemaError(f"missing required columns: {', '.join(required)}")
    return optional


def preprocess(df: DataFrame, schema: EventSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Typed event time, lower-case platform.  No sort: every ordered operator orders for itself."""
    out = df
    if not isinstance(df.schema[schema.time].dataType, T.TimestampType):
        out = out.withColumn(schema.time, F.to_timestamp(F.col(schema.time)))
    if schema.platform in df.columns:
        out = out.withColumn(schema.platform, F.lower(F.col(schema.platform)))
    return out


def _reader(spark: SparkSession, path: str):
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".parquet":
        return lambda *p: spark.read.parquet(*p)
    if suffix == ".csv":
        # Columns are matched by name: read as text, then cast to the declared types (no inference pass).
        return lambda *p: _typed(spark.read.option("header", True).option("escape", '"').csv(list(p)))
    raise ValueError(f"unsupported file type: {suffix or path}")


def _typed(df: DataFrame) -> DataFrame:
    known = {f.name: f.dataType for f in EVENTS_STRUCT.fields}
    return df.select(*[F.col(c).try_cast(known[c]).alias(c) if c in known else F.col(c) for c in df.columns])


def load(spark: SparkSession, path: str, validate: bool = True, schema: EventSchema = DEFAULT_SCHEMA) -> DataFrame:
    """One Parquet or CSV file or directory."""
    df = _reader(spark, path)(path)
    if validate:
        validate_schema(df, schema)
    return preprocess(df, schema)


def check_files(
    spark: SparkSession, paths: Sequence[str], validate: bool = True, schema: EventSchema = DEFAULT_SCHEMA
) -> dict[str, str | None]:
    """Why each file cannot be used, None if it can.  Looks at schemas only, which is no job over the rows."""
    found: dict[str, str | None] = {}
    for p in paths:
        try:
            df = _reader(spark, p)(p)
            if validate:
                validate_schema(df, schema)
            found[p] = None
        except (ValueError, AnalysisException, SparkRuntimeException, Py4JJavaError) as e:  # foreign, missing or corrupt
            found[p] = str(e).strip().splitlines()[0]
    return found


def load_multiple(
    spark: SparkSession,
    paths: Sequence[str],
    validate: bool = True,
    schema: EventSchema = DEFAULT_SCHEMA,
    skipped: dict[str, str] | None = None,
) -> DataFrame:
    """Several files as one frame with ``_source_file``, read by one scan for each file type.

    A file that cannot be used raises, and so do files that only break while they are read.  With a dict as ``skipped`` such files are left
    out and named there with the reason; if none is left, that raises too.
    """
    problems = {p: why for p, why in check_files(spark, paths, validate, schema).items() if why}
    if problems and skipped is None:
        raise ValueError("unusable files: " + "; ".join(f"{p}: {why}" for p, why in problems.items()))
    if skipped is not None:
        skipped.update(problems)
    usable = [p for p in paths if p not in problems]
    if not usable:
        raise ValueError("no file could be read")
    parts = []
    for suffix in (".parquet", ".csv"):
        mine = [p for p in usable if p.rstrip("/").lower().endswith(suffix)]
        if suffix == ".csv":  # columns are taken by name, so files with other headers are read apart
            by_header: dict[tuple[str, ...], list[str]] = {}
            for p in mine:
                by_header.setdefault(tuple(_reader(spark, p)(p).columns), []).append(p)
            frames = [(_reader(spark, same[0])(*same), same) for same in by_header.values()]
        else:
            frames = [(spark.read.option("mergeSchema", True).parquet(*mine), mine)] if mine else []
        for df, same in frames:
            # a part of a directory goes by the directory's name
            steps = F.split(F.col("_metadata.file_path"), "/")
            name, folder = F.url_decode(F.element_at(steps, -1)), F.url_decode(F.element_at(steps, -2))
            given = F.when(folder.isin([os.path.basename(p.rstrip("/")) for p in same]), folder).otherwise(name)
            parts.append(preprocess(df.select("*", given.alias("_source_file")), schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def load_folder(
    spark: SparkSession, folder: str, pattern: str = "*.parquet", schema: EventSchema = DEFAULT_SCHEMA
) -> DataFrame:
    return load_date_range(spark, folder, pattern=pattern, schema=schema)


#: Partition column of event tables written by ``sinks.write_events``.
DATE_PARTITION = "event_date"


def load_date_range(
    spark: SparkSession,
    folder: str,
    start_date: str | None = None,
    end_date: str | None = None,
    pattern: str = "*.parquet",
    schema: EventSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """All files of a folder that match the pattern, limited to a date range (both days included).

    A folder partitioned by ``DATE_PARTITION`` is pruned to the days of the range, and one day more on either side, as it may have been
    written in another time zone; the event times decide.
    """
    reader = spark.read.option("pathGlobFilter", pattern)
    if pattern.lower().endswith(".csv"):
        df = _typed(reader.option("header", True).option("escape", '"').csv(folder))
    else:
        df = reader.parquet(folder)
    validate_schema(df, schema)
    source = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    if DATE_PARTITION in df.columns and isinstance(df.schema[DATE_PARTITION].dataType, T.DateType):
        df = df.select("*", source.alias("_source_file"))
        day = F.col(DATE_PARTITION)
        # rows without a time lie in no day; without a range they stay
        if start_date:
            df = df.where(day >= F.date_sub(F.to_date(F.lit(start_date)), 1))
        if end_date:
            df = df.where(day <= F.date_add(F.to_date(F.lit(end_date)), 1))
        out = preprocess(df.drop(DATE_PARTITION), schema)
    else:
        out = preprocess(df, schema).withColumn("_source_file", source)
    t = F.col(schema.time)
    if start_date:
        out = out.where(t >= F.to_timestamp(F.lit(start_date)))
    if end_date:
        out = out.where(t < F.to_timestamp(F.date_add(F.to_date(F.lit(end_date)), 1)))
    return out


def load_data(spark: SparkSession, path: str, schema: EventSchema = DEFAULT_SCHEMA) -> DataFrame:
    return load(spark, path, schema=schema)


def parse_event_properties(df: DataFrame, column: str = "event_properties", target: str = "props") -> DataFrame:
    """Adds the properties as VARIANT; NULL and bad JSON become an empty object."""
    if target in df.columns:
        return df
    return df.withColumn(target, F.coalesce(F.try_parse_json(F.col(column)), F.parse_json(F.lit("{}"))))


def extract_property(df: DataFrame, name: str, default=None, column: str = "event_properties") -> DataFrame:
    """Adds one top-level property as a text column, with a default."""
    value = F.get_json_object(F.col(column), f"$.{name}")
    return df.withColumn(name, value if default is None else F.coalesce(value, F.lit(str(default))))


def filter_events(df: DataFrame, event_types: Sequence[str]) -> DataFrame:
    return df.where(F.col("event_type").isin(list(event_types)))


def funnel_events(df: DataFrame, vocab: Vocabulary) -> DataFrame:
    return filter_events(df, vocab.full_funnel)


def order_events(df: DataFrame, vocab: Vocabulary) -> DataFrame:
    return filter_events(df, vocab.order_events)


def summary(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.countDistinct("user_id").alias("unique_users"),
        F.min("event_time").alias("first_event"),
        F.max("event_time").alias("last_event"),
    )


def counts_by(events: DataFrame, column: str) -> DataFrame:
    """Events per event type or per platform."""
    return events.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("events"))


def canonical(df: DataFrame, schema: EventSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Renames to the canonical events frame.

    ``event_id`` breaks ties between events of one user at one time.  Without an id column it is a
    hash of the row, so the order does not depend on partitioning.
    """
    src = preprocess(df, schema)
    taken = {schema.user, schema.time, schema.event_type, schema.platform, schema.properties, schema.event_id}
    if schema.event_id:
        eid = F.col(schema.event_id)
    else:
        eid = F.xxhash64(*[F.col(c).cast("string") for c in df.columns if not c.startswith("_")])
    cols = [
        F.col(schema.user).alias("user_id"),
        F.col(schema.time).alias("event_time"),
        F.col(schema.event_type).alias("event_type"),
        eid.alias("event_id"),
        (F.col(schema.platform) if schema.platform in df.columns else F.lit(None).cast("string")).alias("platform"),
        (F.col(schema.properties) if schema.properties in df.columns else F.lit(None).cast("string")).alias(
            "event_properties"
        ),
    ]
    return src.select(*cols, *[F.col(c) for c in df.columns if c not in taken])


def files_per_user(events: DataFrame, user: str = "user_id") -> DataFrame:
    """Users by the number of source files they appear in."""
    per = events.select(user, "_source_file").distinct().groupBy(user).agg(F.count(F.lit(1)).alias("files"))
    return per.groupBy("files").agg(F.count(F.lit(1)).alias("users"))

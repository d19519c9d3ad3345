"""Query registration and the shape both sides of a comparison share."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelens.functions.columns import round_half_even

Query = Callable[[SparkSession, str], DataFrame]

# Sums of doubles differ in the last digits with the order of addition.  Before rounding, both sides move a
# value by this factor, far more than that noise and far less than a rounding step, so exact halves agree.
NUDGE = 1.0000000000001137

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_ROUNDED: dict[str, dict[str, int]] = {}
_MODULES = ("behaviour", "attribution", "users", "commerce", "baskets", "recommendations", "modelling", "dashboards", "streams", "scans", "patterns")


def shaped(df: DataFrame, rounded: Mapping[str, int]) -> DataFrame:
    """Whole numbers as long, instants without zone, dates as text, named doubles rounded."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif f.name in rounded:
            c = round_half_even(c.cast("double") * NUDGE, rounded[f.name])
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, rounded: str = "", digits: int = 6):
    """Registers ``fn(spark, sf_dir)``.

    ``rounded`` names doubles whose last digits depend on summation order, as ``name`` or ``name:digits``.
    """
    names = {n.partition(":")[0]: int(n.partition(":")[2] or digits) for n in rounded.split()}

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if spark.conf.get("spark.sql.session.timeZone") != "UTC":
                spark.conf.set("spark.sql.session.timeZone", "UTC")
            return shaped(fn(spark, sf_dir), names)

        run.__doc__ = fn.__doc__
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = run
        _ROUNDED[name] = names
        if sql is not None:
            text = sql.strip()
            if names:
                rep = ", ".join(f"round_even({c} * {NUDGE}::DOUBLE * 1e{d}, 0) / 1e{d} AS {c}" for c, d in names.items())
                text = f"SELECT * REPLACE ({rep}) FROM ({text})"
            _SQL[name] = text
        return fn

    return wrap


def twin(name: str, of: str):
    """Registers another way to the rows of the query ``of``: same SQL, same rounding."""

    def wrap(fn: Query) -> Query:
        query(name, None, " ".join(f"{c}:{d}" for c, d in _ROUNDED[of].items()))(fn)
        _SQL[name] = _SQL[of]
        return fn

    return wrap


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"tidelens.catalog.{m}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

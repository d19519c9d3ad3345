"""Writers.  Every sink writes one directory per frame, in parallel, and can be re-run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_frames(frames: Mapping[str, DataFrame], output: str, fmt: str = "parquet") -> dict[str, str]:
    """Writes each frame to ``output/<name>``; returns the paths."""
    paths = {}
    for name, df in frames.items():
        path = f"{output.rstrip('/')}/{name}"
        w = df.write.mode("overwrite")
        (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))
        paths[name] = path
    return paths


def export_segment(segment: DataFrame, name: str, output: str, stamp: str) -> str:
    """CSV export under ``segment=<name>/ts=<stamp>``."""
    path = f"{output.rstrip('/')}/segment={name}/ts={stamp}"
    segment.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_events(events: DataFrame, path: str, time: str = "event_time") -> str:
    """Event table partitioned by date, so date ranges prune whole directories."""
    from pyspark.sql import functions as F

    events.withColumn("event_date", F.to_date(time)).write.mode("overwrite").partitionBy("event_date").parquet(path)
    return path

"""Session factory.  What the caller or the cluster's configuration sets stays; the rest are the engine's needs."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Runtime settings the results or plans rely on, where nothing else is configured.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def _one_machine(master: str) -> bool:
    """Driver and executors are one process, so they share all folders."""
    return master == "local" or master.startswith("local[")


def build_session(app: str = "tidelens", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if _one_machine(master):
            b = b.config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    configured = spark.sparkContext.getConf()
    for k, v in DEFAULTS.items():
        if not configured.contains(k):
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where none is set, a run on one machine gets a temporary folder; a cluster is refused, as its executors would not share it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not _one_machine(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tidelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path

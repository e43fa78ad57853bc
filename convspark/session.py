"""Session settings the operators rely on. All are runtime SQL settings, so a caller's session is enough."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even where that adds a shuffle downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # top-n-per-group filters prune map-side whatever n is
    "spark.sql.optimizer.windowGroupLimitThreshold": str(2**31 - 1),
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or the context's; a scratch folder of this machine only
    where neither is set and the master is local. Elsewhere executors could not see it, so that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    ctx = spark.sparkContext
    current = ctx.getCheckpointDir()
    if current:
        return current
    if not ctx.master.startswith("local") or ctx.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    scratch = tempfile.mkdtemp(prefix="convspark-")
    ctx.setCheckpointDir(scratch)
    return scratch


def cut_lineage(df):
    """Reliable checkpoint, so a lost executor does not replay an iterative job from the start."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def local(app: str = "convspark", cores: str = "8", shuffle: int = 8) -> SparkSession:
    """Local session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call-site capture per Column call
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)

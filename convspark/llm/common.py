"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.session import checkpoint_dir, configure

#: Characters that separate words, for the operators that split on blanks.
BLANKS = " \t\n\x0b\x0c\r"

#: Rows in an Arrow batch: a batch of long texts must fit beside the others in an executor.
BATCH_ROWS = 1000


def prepared(spark: SparkSession) -> SparkSession:
    """Runtime SQL settings only; nothing that needs a new session."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns at the end; input columns of the same name go."""
    new = {c.lower() for c in columns}
    kept = [df[f"`{c}`"] for c in df.columns if c.lower() not in new]
    return df.select(*kept, *[c.alias(name) for name, c in columns.items()])


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that the driver and all executors see."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

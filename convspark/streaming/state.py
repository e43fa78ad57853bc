"""Tables written batch by batch, so that a repeated micro-batch replaces its own output only, and keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class BatchTable:
    """Parquet folder partitioned by ``batch``; what a batch reads never includes its own earlier attempt."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType):
        self.spark, self.path = spark, path
        self.schema = spark.createDataFrame([], schema).schema

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, before: int | None = None) -> DataFrame:
        full = StructType(list(self.schema.fields)).add("batch", "long")
        if (table := self._stored(full)) is None:
            return self._empty(full).drop("batch")
        return (table if before is None else table.filter(F.col("batch") < before)).drop("batch")

    def read_batch(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={batch_id}")

    def _empty(self, schema: StructType) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _stored(self, schema: StructType, folder: str = "") -> DataFrame | None:
        """What was written below the folder; None before the first write."""
        try:
            return self.spark.read.schema(schema).option("basePath", self.path).parquet(f"{self.path}{folder}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise


class KeyTable(BatchTable):
    """Rows by key, cut into ``buckets`` folders a batch by a hash of the key. A batch reads the buckets of its own keys
    only: what it reads follows its own keys, not the batches before it, as long as these do not touch all buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], buckets: int = 1024):
        super().__init__(spark, path, schema)
        self.keys, self.buckets = keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows = rows.select(*self.schema.names, self._bucket()).repartition("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch_id}")

    def read_for(self, rows: DataFrame, before: int) -> DataFrame:
        """What earlier batches stored in the buckets of the keys of ``rows``; at most ``buckets`` numbers are collected."""
        full = StructType(list(self.schema.fields)).add("batch", "long").add("bucket", "integer")
        touched = [r[0] for r in rows.select(self._bucket()).distinct().collect()]
        table = self._stored(full)
        if table is None or not touched:
            return self._empty(self.schema)
        return table.filter((F.col("batch") < before) & F.col("bucket").isin(touched)).select(*self.schema.names)


#: Keyed state lies in RocksDB on the executors; a batch uploads its changes, not the whole state.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def run_available(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there, then stop; a later call goes on from the checkpoint."""
    for key, value in STATE_SETTINGS.items():
        stream.sparkSession.conf.set(key, value)
    writer = stream.writeStream.foreachBatch(handler).outputMode(mode).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def first_arrivals(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keyed state: of each key the first row, by micro-batch, inside one by ``order``. For update mode: a micro-batch
    returns one row for each of its keys, the stored first row with ``created`` (it came in this micro-batch) and
    ``arrivals`` (rows of the key so far).

    The state is a minimum, so rows of a key are combined before the shuffle, and a key that most rows have is no hot
    task. Columns other than the keys must be orderable (maps as entries).
    """
    rest = [c for c in stream.columns if c not in keys and c not in order]
    # the time of a micro-batch is in its log, so a repeated attempt has the same
    seen = stream.withColumn("_arrived", F.current_timestamp())
    first = F.min(F.struct("_arrived", *order, *rest)).alias("_first")
    kept = seen.groupBy(*keys).agg(first, F.max("_arrived").alias("_now"), F.count("*").alias("arrivals"))
    columns = [F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in stream.columns]
    return kept.select(*columns, (F.col("_first._arrived") == F.col("_now")).alias("created"), "arrivals")

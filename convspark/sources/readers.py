"""JSON readers for histories, query pairs, scenarios, tenant policies and loose events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.functions import text as X

# details and metadata keep their JSON values in the order of the file: both matter when they are rendered
HISTORY_SCHEMA = (
    "customer_id string, tenant_id string, source string, source_ids array<string>, "
    "channel_messages array<struct<channel:string,sender:string,content:string,timestamp:timestamp,"
    "metadata:map<string,variant>>>, "
    "prior_actions array<struct<action_type:string,timestamp:timestamp,details:map<string,variant>>>"
)
PAIR_SCHEMA = (
    "pair_id string, customer_id string, tenant_id string, query string, ground_truth string, "
    "history_message_count int, history_bucket string, source string, intent string, tags array<string>"
)
SCENARIO_SCHEMA = (
    "scenario_id string, tenant_id string, event struct<event_id:string,event_type:string,customer_id:string,"
    "channel_code:string,received_at:string>, expected_action_type string, expected_decision string, intent string, "
    "difficulty string, tags array<string>, rationale string, brief_text string"
)


def _jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines yield no row."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load_histories(spark: SparkSession, path: str) -> DataFrame:
    return _jsonl(spark, path, HISTORY_SCHEMA)


def history_messages(histories: DataFrame) -> DataFrame:
    m = histories.select("tenant_id", "customer_id", F.posexplode("channel_messages").alias("seq", "m"))
    return m.select(
        "tenant_id",
        "customer_id",
        F.col("seq").cast("long").alias("seq"),
        "m.channel",
        "m.sender",
        "m.content",
        F.col("m.timestamp").alias("ts"),
        F.try_element_at("m.metadata", F.lit("subject")).cast("string").alias("subject"),
        F.try_variant_get(F.try_element_at("m.metadata", F.lit("attachments")), "$", "array<string>").alias("attachments"),
        X.metadata_extras(F.col("m.metadata")).alias("extras"),
    )


def history_actions(histories: DataFrame) -> DataFrame:
    a = histories.select("tenant_id", "customer_id", F.posexplode("prior_actions").alias("seq", "a"))
    details = F.transform(F.map_entries("a.details"), lambda e: X.detail(e["key"], e["value"]))
    return a.select(
        "tenant_id",
        "customer_id",
        F.col("seq").cast("long").alias("seq"),
        "a.action_type",
        F.coalesce(details, F.array().cast("array<struct<k:string,v:string,s:string>>")).alias("details"),
        F.col("a.timestamp").alias("ts"),
    )


def load_pairs(spark: SparkSession, path: str, histories: DataFrame) -> DataFrame:
    """Query pairs joined to their history, by pair_id; a pair without history fails the job."""
    pairs = _jsonl(spark, path, PAIR_SCHEMA).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return guard_orphans(pairs, histories).orderBy("pair_id")


def guard_orphans(pairs: DataFrame, histories: DataFrame) -> DataFrame:
    known = histories.select(F.col("customer_id").alias("_known")).distinct()
    message = F.concat(F.lit("pair refers to a customer without history: "), F.col("customer_id"))
    joined = pairs.join(known, pairs["customer_id"] == known["_known"], "left")
    checked = F.when(F.col("_known").isNull(), F.raise_error(message)).otherwise(F.col("customer_id"))
    return joined.withColumn("customer_id", checked.cast("string")).drop("_known")


def in_bucket(pairs: DataFrame, bucket: str | None = None, column: str = "history_bucket") -> DataFrame:
    return pairs if bucket is None else pairs.filter(F.col(column) == bucket)


def load_scenarios(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(_jsonl(spark, path, SCENARIO_SCHEMA))


def with_defaults(scenarios: DataFrame) -> DataFrame:
    return scenarios.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).withColumn(
        "brief_text", F.coalesce("brief_text", F.lit(""))
    )


def select_scenarios(
    scenarios: DataFrame, tenant_id: str | None = None, event_type: str | None = None, difficulty: str | None = None
) -> DataFrame:
    for column, wanted in (("tenant_id", tenant_id), ("event.event_type", event_type), ("difficulty", difficulty)):
        if wanted is not None:
            scenarios = scenarios.filter(F.col(column) == wanted)
    return scenarios


def load_tenant_policies(spark: SparkSession, path: str) -> DataFrame:
    """{tenant: {key: decision}} as one row per rule."""
    return policy_rows(spark.read.option("wholetext", True).text(path))


def policy_rows(documents: DataFrame, column: str = "value") -> DataFrame:
    nested = F.from_json(F.col(column), "map<string,map<string,string>>")
    tenants = documents.select(F.explode(nested).alias("tenant_id", "table"))
    return tenants.select("tenant_id", F.explode("table").alias("key", "decision"))


def normalize_events(loose: DataFrame, fallback_id: Column) -> DataFrame:
    """A blank event id is generated, a missing customer is null, a missing channel is 'api'."""
    return loose.withColumn("event_id", F.coalesce(X.blank_to_null(F.col("event_id")), fallback_id)).withColumn(
        "channel_code", F.coalesce("channel_code", F.lit("api"))
    )

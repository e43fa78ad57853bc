"""Policy tables and decision engines: (tenant, action type, event) -> auto / approval_required / reject."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from convspark import values as V
from convspark.functions import text as X
from convspark.sources.tables import lookup


def set_policies(loads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules in force, rejected rules) from a load history (tenant_id, load_id, key, decision).

    A load replaces the whole table of its tenant; a load with any bad rule is refused as a whole. A row with a null
    key stands for an empty load, which leaves the tenant without rules.
    """
    bad_rule = F.col("key").isNotNull() & (
        F.col("decision").isNull() | ~F.col("decision").isin(V.DECISIONS) | (F.coalesce("tenant_id", F.lit("")) == "")
    )
    marked = loads.withColumn("bad", F.coalesce(bad_rule, F.lit(False)))
    status = marked.groupBy("tenant_id", "load_id").agg(F.bool_or("bad").alias("refused"))
    latest = status.filter("NOT refused").groupBy("tenant_id").agg(F.max("load_id").alias("load_id"))
    rules = marked.join(latest, ["tenant_id", "load_id"]).filter(F.col("key").isNotNull())
    errors = marked.filter("bad").select("tenant_id", "load_id", "key", "decision")
    return rules.select("tenant_id", "key", "decision"), errors


def tenants(rules: DataFrame) -> DataFrame:
    return rules.select("tenant_id").distinct().orderBy("tenant_id")


def tables(rules: DataFrame) -> DataFrame:
    """One MAP per tenant. A tenant has at most one rule per action type plus the two special keys."""
    entry = F.struct("key", "decision")
    return rules.groupBy("tenant_id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("rules"))


def resolve(rules: Column, action_type: Column) -> Column:
    """Exact action, then 'default', then '*', then the safe decision."""
    at = lambda key: F.try_element_at(rules, key)
    return F.coalesce(at(action_type), at(F.lit("default")), at(F.lit("*")), F.lit(V.SAFE_DECISION))


def declarative(actions: DataFrame, rules: DataFrame, out: str = "decision") -> DataFrame:
    """One table per tenant joined to the actions. It is broadcast: a policy has a few rules a tenant, and a shuffle by tenant,
    which a stream would plan, puts all actions into as many tasks as there are tenants."""
    return actions.join(F.broadcast(tables(rules)), "tenant_id", "left").withColumn(out, resolve(F.col("rules"), F.col("action_type"))).drop("rules")


def table_rules(tenant, rules, actions, events):
    """The declarative order as a callable for ``python_rules``."""
    return actions.map(rules).fillna(rules.get("default") or rules.get("*") or V.SAFE_DECISION)


def python_rules(
    actions: DataFrame, rules: DataFrame, event: Column, handler: Callable = table_rules, out: str = "decision"
) -> DataFrame:
    """``handler(tenant, rules, action types, events) -> decisions`` on the rows of one tenant in an Arrow batch, where rules is
    the tenant's table as a dict and the others are a Series and a DataFrame. Tenants without rules are safe."""

    def run(tenant, table, action, events):
        import json

        import pandas as pd

        out = pd.Series(V.SAFE_DECISION, index=action.index)
        for (name, text), rows in pd.DataFrame({"t": tenant, "r": table}).dropna().groupby(["t", "r"]):
            at = rows.index
            out[at] = handler(name, json.loads(text), action[at], events.loc[at])
        return out

    import pandas as pd

    run.__annotations__ = {
        "tenant": pd.Series, "table": pd.Series, "action": pd.Series, "events": pd.DataFrame, "return": pd.Series
    }
    udf = F.pandas_udf(run, StringType())
    joined = actions.join(tables(rules).select("tenant_id", F.to_json("rules").alias("_rules")), "tenant_id", "left")
    return joined.withColumn(out, udf("tenant_id", "_rules", "action_type", event)).drop("_rules")


def policy_json(rules: Column) -> Column:
    """The tenant table as JSON with sorted keys and ', ' / ': ' separators."""
    items = F.transform(
        F.array_sort(F.map_entries(rules)),
        lambda e: F.concat(F.lit('"'), e["key"], F.lit('": "'), e["value"], F.lit('"')),
    )
    return F.concat(F.lit("{"), F.coalesce(F.array_join(items, ", "), F.lit("")), F.lit("}"))


def judge(actions: DataFrame, rules: DataFrame) -> DataFrame:
    """Declarative result plus the token counters a judge call would cost."""
    joined = actions.join(tables(rules), "tenant_id", "left")
    prompt = X.judge_prompt(policy_json(F.col("rules")), F.col("action_type"))
    size = F.length(prompt) + len(V.JUDGE_SYSTEM_PROMPT)
    return joined.select(
        *actions.columns,
        resolve(F.col("rules"), F.col("action_type")).alias("decision"),
        F.floor(size / 4).cast("int").alias("input_tokens"),
        F.lit(V.JUDGE_OUTPUT_TOKENS).alias("output_tokens"),
    )


def parse_judge(raw: Column) -> Column:
    """Decision named by a strict JSON response; anything else is the safe decision."""
    field = lambda obj: F.try_variant_get(obj, "$.decision", "variant")
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))
    named = X.let(X.strict_object(X.unfence(F.coalesce(raw, F.lit("")))), lambda obj: X.let(field(obj), text))
    return X.let(named, lambda d: F.when(d.isin(V.DECISIONS), d).otherwise(F.lit(V.SAFE_DECISION)))


def narratives(rules: DataFrame) -> DataFrame:
    """English text per tenant; a tenant has at most one rule per action type plus two special keys."""
    listed = rules.groupBy("tenant_id").agg(F.sort_array(F.collect_list(F.struct("key", "decision"))).alias("rules"))
    return listed.select("tenant_id", X.tenant_narrative(F.col("tenant_id"), F.col("rules")).alias("narrative"))


def naive(actions: DataFrame, rules: DataFrame) -> DataFrame:
    """Event type alone decides; the prompt that would be sent sets the token counters."""
    joined = actions.join(narratives(rules), "tenant_id", "left")
    prompt = X.naive_prompt(F.col("narrative"), F.col("action_type"), F.col("event_type"))
    # the echoing client answers with its prefix and the first 128 characters of the prompt
    reply = len(V.ECHO_PREFIX) + F.least(F.length(prompt), F.lit(128))
    return joined.select(
        *actions.columns,
        lookup(V.NAIVE_DECISIONS, F.col("event_type"), F.lit(V.SAFE_DECISION)).alias("decision"),
        F.floor((F.length(prompt) + len(V.NAIVE_SYSTEM_PROMPT)) / 4).cast("int").alias("input_tokens"),
        F.floor(reply / 4).cast("int").alias("output_tokens"),
    )


def parse_naive(response: Column) -> Column:
    low = F.lower(response)
    has = lambda word: F.contains(low, F.lit(word))
    return (
        F.when(has("reject"), "reject")
        .when(has("approval"), "approval_required")
        .when(has("auto"), "auto")
        .otherwise(F.lit(V.SAFE_DECISION))
    )


def all_engines(actions: DataFrame, rules: DataFrame) -> DataFrame:
    """Every engine on every action, tagged with ``strategy``."""
    none = [F.lit(0).alias("input_tokens"), F.lit(0).alias("output_tokens")]
    cols = [*actions.columns, "decision"]
    table = declarative(actions, rules).select(F.lit("declarative").alias("strategy"), *cols, *none)
    called = python_rules(actions, rules, F.struct("event_type")).select(F.lit("python_rules").alias("strategy"), *cols, *none)
    judged = judge(actions, rules).select(F.lit("llm_judge").alias("strategy"), *cols, "input_tokens", "output_tokens")
    guessed = naive(actions, rules).select(F.lit("naive_llm").alias("strategy"), *cols, "input_tokens", "output_tokens")
    return table.unionByName(called).unionByName(judged).unionByName(guessed)

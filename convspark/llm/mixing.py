"""Operator 6: sources mixed to target weights by Poisson replication.

The target weight of a source and its number of documents give a mean repetition rate. Each document draws its number of
copies from the Poisson distribution of that mean, by inverting the distribution at a number in [0, 1) that is a hash of
seed and doc_id. Copies then go to partitions, and are ordered in them, by a hash of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.llm.common import replaced, shared_folder, table

SEED = 20
#: Target weights of the query: this source three shares, each other source one.
WEIGHTS = {"src0": 3.0}
#: Bins of [0, 1) in which numbers meet the intervals of the distributions.
_BINS = 256
#: Numbers that are made from one row at once.
_BLOCK = 4096
_DIGITS = 13  # hexadecimal digits that a double holds exactly
_NO_SOURCE = ""


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(_NO_SOURCE))


def rates(docs: DataFrame, weights: dict[str, float], default: float = 1.0, total: float | None = None) -> DataFrame:
    """(source, n_docs, rate): documents and mean copies of a document for each source.

    ``total`` is the expected size of the mixture, by default the number of documents. A null source counts as ''.
    """
    sizes = docs.groupBy(_source().alias("source")).agg(F.count("*").alias("n_docs"))
    weight = F.lit(float(default))
    for source, w in weights.items():
        weight = F.when(F.col("source") == source, F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    whole = sizes.agg(F.sum("weight").alias("weight"), F.sum("n_docs").alias("n_docs")).first()
    if not whole["weight"]:  # no documents, or no weight for any of them
        return sizes.select("source", "n_docs", F.lit(0.0).alias("rate"))
    mean = F.col("weight") / F.lit(whole["weight"]) * F.lit(whole["n_docs"] if total is None else float(total))
    return sizes.select("source", "n_docs", (mean / F.col("n_docs")).alias("rate"))


def distributions(rated: DataFrame) -> DataFrame:
    """(source, copies, low, high): a document draws ``copies`` if its number in [0, 1) lies in [low, high).

    Terms are taken from rate - 12 sqrt(rate) - 40 to rate + 12 sqrt(rate) + 40; what lies outside is far below what doubles
    tell apart. Neighbouring terms have the ratio rate / j, so logarithms are a running sum over the rows of a source, and
    large rates do not underflow; the terms are divided by their sum.
    """
    reach = 12 * F.sqrt("rate") + 40
    first, last = F.greatest(F.floor(F.col("rate") - reach), F.lit(0)), F.ceil(F.col("rate") + reach)
    terms = rated.filter("rate > 0").select("source", "rate", first.alias("first"), last.alias("last"))
    # block by block, so that no array is longer than a block
    block = F.explode(F.sequence(F.floor(F.col("first") / _BLOCK), F.floor(F.col("last") / _BLOCK))).alias("block")
    terms = terms.select("*", block)
    start = F.greatest("first", F.col("block") * _BLOCK)
    terms = terms.select("*", F.explode(F.sequence(start, F.least("last", F.col("block") * _BLOCK + _BLOCK - 1))).alias("j"))
    by_source = Window.partitionBy("source")
    upto = by_source.orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("j") == F.col("first"), F.lit(0.0)).otherwise(F.ln("rate") - F.ln("j"))
    terms = terms.select("source", "j", "last", F.sum(step).over(upto).alias("s"))
    terms = terms.withColumn("p", F.exp(F.col("s") - F.max("s").over(by_source)))
    terms = terms.withColumn("p", F.col("p") / F.sum("p").over(by_source))
    high = F.sum("p").over(upto)
    terms = terms.withColumn("high", F.when(F.col("j") == F.col("last"), F.lit(2.0)).otherwise(high))
    low = F.coalesce(F.lag("high").over(by_source.orderBy("j")), F.lit(0.0))
    return terms.select("source", F.col("j").alias("copies"), low.alias("low"), "high")


def _hash(seed: int, *parts) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def mix(docs: DataFrame, weights: dict[str, float], default: float = 1.0, total: float | None = None, seed: int = SEED) -> DataFrame:
    """The mixture: the columns of ``docs``, ``copy_no`` from 1 and ``order_key``, of which the order is random (input
    columns of these names go). Documents that draw no copy are absent.

    The same documents, weights and seed give the same mixture on any cluster. A null doc_id counts as '', a null source
    as the source ''; rows that repeat a doc_id share its draw. A weight of 0 leaves a source out. Texts are not read.
    """
    spark = docs.sparkSession
    # the range join as an equi-join: numbers and intervals meet in bins; as a table its size is known to Spark, which
    # broadcasts it if it is small, else joins by source and bin and splits hot ones
    cut = distributions(rates(docs, weights, default, total)).filter("copies > 0 AND low < high AND low < 1")
    bins = F.sequence(F.floor(F.col("low") * _BINS), F.least(F.floor(F.col("high") * _BINS), F.lit(_BINS - 1).cast("long")))
    folder = shared_folder(spark, "mix")
    cut.select("source", F.explode(bins).alias("bin"), "copies", "low", "high").write.parquet(folder)
    cut = spark.read.parquet(folder)
    cut = cut.select(*[F.col(c).alias(f"_llm_{c}") for c in cut.columns])
    clean = replaced(docs).drop("copy_no", "order_key")
    u = F.conv(F.substring(_hash(seed, F.col("doc_id")), 1, _DIGITS), 16, 10).cast("long") / F.lit(float(16**_DIGITS))
    drawn = clean.withColumns({"_llm_u": u, "_llm_key": _source()}).withColumn("_llm_in", F.floor(F.col("_llm_u") * _BINS))
    drawn = drawn.join(cut, (F.col("_llm_key") == F.col("_llm_source")) & (F.col("_llm_in") == F.col("_llm_bin")))
    drawn = drawn.filter((F.col("_llm_low") <= F.col("_llm_u")) & (F.col("_llm_u") < F.col("_llm_high")))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_llm_copies") - 1) / _BLOCK))).alias("_llm_block")
    drawn = drawn.select(*clean.columns, "_llm_copies", blocks)
    start = F.col("_llm_block") * _BLOCK + 1
    copies = F.sequence(start.cast("int"), F.least(F.col("_llm_copies"), start + _BLOCK - 1).cast("int"))
    out = drawn.select(*clean.columns, F.explode(copies).alias("copy_no"))
    out = out.withColumn("order_key", _hash(seed, F.lit("place"), F.col("doc_id"), F.col("copy_no")))
    return out.repartition("order_key").sortWithinPartitions("order_key")


def query(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), WEIGHTS)


def _weight_sql() -> str:
    return "CASE " + " ".join(f"WHEN source = '{s}' THEN {w!r}" for s, w in WEIGHTS.items()) + " ELSE 1.0 END"


def mixture_sql(docs: str, columns: str) -> str:
    """DuckDB text of the mixture of the relation ``docs``."""
    return f"""
WITH sizes AS (
  SELECT coalesce(source, '{_NO_SOURCE}') AS source, count(*) AS n_docs FROM {docs} GROUP BY 1
), weighted AS (
  SELECT source, n_docs, CAST({_weight_sql()} AS DOUBLE) AS weight FROM sizes
), rated AS (
  SELECT source, weight / (SELECT sum(weight) FROM weighted) * (SELECT sum(n_docs) FROM weighted) / n_docs AS rate
  FROM weighted
), terms AS (
  SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS j FROM rated
), probabilities AS (
  SELECT source, j, exp(j * ln(rate) - rate - lgamma(CAST(j + 1 AS DOUBLE))) AS p FROM terms
), cdf AS (
  SELECT source, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM probabilities
), drawn AS (
  SELECT d.*, coalesce(d.source, '{_NO_SOURCE}') AS src,
    CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, {_DIGITS}) AS BIGINT) / {float(16**_DIGITS)!r} AS u
  FROM {docs} d
), counted AS (
  SELECT w.doc_id, w.u, w.src, count(*) AS n FROM (SELECT DISTINCT doc_id, u, src FROM drawn) w
  JOIN cdf ON cdf.source = w.src AND cdf.c <= w.u GROUP BY 1, 2, 3
), copies AS (
  SELECT w.*, unnest(range(1, c.n + 1)) AS copy_no
  FROM drawn w JOIN counted c ON c.doc_id IS NOT DISTINCT FROM w.doc_id AND c.src = w.src
)
SELECT {columns}, copy_no,
  md5('{SEED}|place|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || copy_no) AS order_key
FROM copies"""


QUERIES = {"op6_mix_sources": query}
ORACLE = {"op6_mix_sources": mixture_sql("documents", "doc_id, text, lang, source, n_chars")}

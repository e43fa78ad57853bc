"""Building blocks that keep hot keys from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.session import cut_lineage


def sliced_rank(df: DataFrame, keys: list[str], order: list[Column], slices: Column, name: str = "rank") -> DataFrame:
    """1-based position within ``keys``, computed slice by slice.

    ``slices`` must grow with ``order`` (e.g. the hour of an ascending time order), so a key holding a third of
    all rows is ranked by many tasks: rows are numbered inside their slice, and the sizes of the earlier slices,
    counted with a map-side aggregate, are added on.
    """
    df = df.withColumn("_slice", slices)
    # a row for each slice; without the cut its two readers would each count the rows anew
    sizes = cut_lineage(df.groupBy(*keys, "_slice").agg(F.count("*").alias("_n")))
    offsets = sums_before(sizes, keys, "_slice", "_n", "_before")
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    ranked = df.withColumn("_in_slice", F.row_number().over(inside))
    on = [ranked[k].eqNullSafe(offsets[k]) for k in [*keys, "_slice"]]
    joined = ranked.join(offsets, on, "inner").select(
        *[ranked[c] for c in ranked.columns], offsets["_before"]
    )
    return joined.withColumn(name, F.col("_before") + F.col("_in_slice")).drop("_slice", "_before", "_in_slice")


def top_rank(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str, slots: int = 64) -> DataFrame:
    """Position within ``keys`` of the first ``n`` rows of each key, null for all others, which pass through.

    Rows are ranked in ``slots`` parts of a key; those in front there are ranked against each other, at most slots x n
    of them. One pass over ``df``, no join back, and a key that holds most rows is spread over its slots.
    """
    # any dealing will do: the slot of a row has no part in the result
    parted = df.withColumn("_slot", F.pmod(F.monotonically_increasing_id(), F.lit(slots)).cast("int"))
    parted = parted.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(*order)))
    ahead = F.col("_in") <= n
    parted = parted.withColumn("_slot", F.when(ahead, F.lit(-1)).otherwise(F.col("_slot")))
    place = F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(*order))
    parted = parted.withColumn("_at", place)
    return parted.withColumn(name, F.when((F.col("_slot") == -1) & (F.col("_at") <= n), F.col("_at"))).drop("_slot", "_in", "_at")


_BLOCK = 4096


def sums_before(sizes: DataFrame, keys: list[str], order: str, n: str, name: str) -> DataFrame:
    """(keys, order, name): the sum of ``n`` over the rows of the key with a smaller ``order`` (whole numbers, unique).

    Sums are taken inside blocks of 4,096 numbers, then over the blocks, so even without keys a window gets one row
    for each block only.
    """
    sizes = sizes.select(*keys, order, F.col(n).alias("_size"), F.floor(F.col(order) / _BLOCK).alias("_block"))
    blocks = sizes.groupBy(*keys, "_block").agg(F.sum("_size").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    on = [sizes[k].eqNullSafe(blocks[k]) for k in [*keys, "_block"]]
    joined = sizes.join(blocks, on)
    return joined.select(*[sizes[k] for k in keys], sizes[order], (F.col("_base") + F.col("_in")).alias(name))


#: Cuts of a key's values, and the accuracy of the sketch they come from.
_CUTS, _ACCURACY = 63, 2000


def order_statistics(df: DataFrame, keys: list[str], value: str, points: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact order statistics per key, without gathering a key's values in one task.

    ``points`` maps an output name to (rule, p):
      ``linear``  interpolate at (n-1)*p          ``upper_mid``  x[n // 2]
      ``floor``   x[max(0, int(n*p) - 1)]

    Values are first counted (map-side), then the distinct values of each key are cut at approximate quantiles into
    parts of about equal size, whatever their distribution. Parts are counted exactly; only those that hold a wanted
    position are looked at value by value.
    """
    if not keys:
        raise ValueError("order_statistics needs at least one key column")
    df = df.filter(F.col(value).isNotNull())
    counted = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    cuts = F.percentile_approx("_v", [i / (_CUTS + 1) for i in range(1, _CUTS + 1)], _ACCURACY)
    bounds = counted.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("n"), cuts.alias("_cuts")
    )
    bounds = bounds.select("*", *[p for name, rule in points.items() for p in _positions(name, *rule)])
    cut = counted.join(bounds, keys)
    cut = cut.withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")

    sizes = cut.groupBy(*keys, "_part").agg(F.sum("_n").alias("_m"))
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumn("_end", F.sum("_m").over(upto)).withColumn("_start", F.col("_end") - F.col("_m"))

    wanted_cols = [c for c in bounds.columns if c.startswith("_pos_")]
    wanted = bounds.select(*keys, F.explode(F.array_distinct(F.array(*wanted_cols))).alias("_pos"))
    hit = sizes.join(wanted, keys)
    hit = hit.filter((F.col("_pos") >= F.col("_start")) & (F.col("_pos") < F.col("_end")))
    hit = hit.select(*keys, "_part", "_start", "_pos")

    spots = cut.select(*keys, "_part", "_v", "_n").join(
        hit.select(*keys, "_part", "_start").distinct(), [*keys, "_part"]
    )
    run = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spots = spots.withColumn("_to", F.col("_start") + F.sum("_n").over(run)).withColumn("_from", F.col("_to") - F.col("_n"))
    picked = spots.join(hit.select(*keys, "_part", "_pos"), [*keys, "_part"]).filter(
        (F.col("_pos") >= F.col("_from")) & (F.col("_pos") < F.col("_to"))
    )
    found = picked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_v"))).alias("_at"))
    out = bounds.join(found, keys)
    return out.select(*keys, "n", F.col("_lo").alias("min"), F.col("_hi").alias("max"),
                      *[_value(name, *rule).alias(name) for name, rule in points.items()])


def _positions(name: str, rule: str, p: float) -> list[Column]:
    n = F.col("n")
    if rule == "linear":
        at = (n - 1) * F.lit(p)
        low = F.floor(at)
        return [low.alias(f"_pos_{name}_lo"), F.least(low + 1, n - 1).alias(f"_pos_{name}_hi"),
                (at - low).alias(f"_frac_{name}")]
    if rule == "upper_mid":
        return [F.floor(n / 2).alias(f"_pos_{name}")]
    if rule == "floor":
        return [F.greatest(F.lit(0).cast("long"), F.floor(n * F.lit(p)) - 1).alias(f"_pos_{name}")]
    raise ValueError(f"unknown percentile rule {rule!r}")


def _value(name: str, rule: str, p: float) -> Column:
    at = lambda c: F.try_element_at(F.col("_at"), F.col(c))
    if rule == "linear":
        low, high = at(f"_pos_{name}_lo"), at(f"_pos_{name}_hi")
        return low + (high - low) * F.col(f"_frac_{name}")
    return at(f"_pos_{name}")

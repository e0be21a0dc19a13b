"""Statistics of benchmark and load-test runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.numeric import round2


#: Ranges for each unit of a value's natural logarithm.
RANGES = 32


def bench_stats(runs: DataFrame, key: str, seconds: str, target: float) -> DataFrame:
    """Best and mean of the runs of each key, and whether the best meets the target."""
    grouped = runs.groupBy(key).agg(F.count("*").alias("runs"), F.min(seconds).alias("lo"), F.avg(seconds).alias("avg"))
    return grouped.select(key, "runs", round2(F.col("lo")).alias("best"), round2(F.col("avg")).alias("mean"), (F.col("lo") <= target).alias("passed"))


def value_range(value: Column) -> Column:
    """Number of the range in which a value lies: it rises with the value and follows from it alone.

    Ranges are 1 / RANGES wide on the natural logarithm of the size; 0 is a range of its own, NaN the last.
    """
    v = value.cast("double")
    size = F.floor(F.log(F.least(F.abs(v), F.lit(1e308))) * RANGES) + 1000 * RANGES  # positive for the smallest double
    return F.when(F.isnan(v), 2000 * RANGES).when(v > 0, size).when(v < 0, -size).otherwise(0).cast("int")


def latency(requests: DataFrame, key: str, seconds: str) -> DataFrame:
    """Successful requests of each key with p50, p95 (nearest rank) and the longest.

    Ranks come from counts of distinct values, so no key's values meet in one array. The values are
    counted first (combined on the map side) and dealt to ranges; the counts of the ranges tell which
    of them hold the ranks, and a running count within those finds the values. Ranges follow from the
    values alone: what is computed twice comes out the same on any layout.
    """
    from pyspark.sql import Window

    counted = requests.where(F.col(seconds).isNotNull()).groupBy(key, seconds).agg(F.count("*").alias("c"))
    dealt = counted.withColumn("part", value_range(F.col(seconds)))
    whole = Window.partitionBy("key_")
    sizes = dealt.groupBy(F.col(key).alias("key_"), F.col("part").alias("part_")).agg(F.sum("c").alias("n"), F.max(seconds).alias("top")).select(
        "key_", "part_", "n", (F.sum("n").over(whole.orderBy("part_")) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("ok"), F.max("top").over(whole).alias("most"))

    def rank(percent: float) -> Column:
        return F.bround(F.lit(percent / 100.0) * (F.col("ok") - 1), 0) + 1

    def holds(percent: float) -> Column:
        return (F.col("before") < rank(percent)) & (rank(percent) <= F.col("before") + F.col("n"))

    def at(percent: float) -> Column:
        return F.min(F.when(F.col("upto") >= rank(percent), F.col(seconds)))

    hit = dealt.join(sizes.where(holds(50) | holds(95)), F.col(key).eqNullSafe(F.col("key_")) & (F.col("part") == F.col("part_")))
    upto = F.sum("c").over(Window.partitionBy(key, "part").orderBy(seconds)) + F.col("before")
    return hit.withColumn("upto", upto).groupBy(key, "ok", "most").agg(at(50).alias("p50"), at(95).alias("p95")).select(key, "ok", "p50", "p95", "most")

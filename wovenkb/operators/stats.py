"""Outlier thresholds over a column of degrees: each gives a frame of one row, so that plans stay lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import checkpoint


def percentile_threshold(values: DataFrame, col: str, pct: float = 95.0) -> DataFrame:
    """Exact percentile with linear interpolation."""
    return values.agg(F.expr(f"percentile({col}, {pct / 100})").alias("threshold"))


def mad_threshold(values: DataFrame, col: str, k: float = 3.0) -> DataFrame:
    """median + k MAD / 0.6745; twice the median where MAD is zero."""
    mid = values.agg(F.expr(f"percentile({col}, 0.5)").alias("_mid"))
    spread = values.crossJoin(F.broadcast(mid)).agg(F.max("_mid").alias("_mid"), F.expr(f"percentile(abs({col} - _mid), 0.5)").alias("_mad"))
    return spread.select(F.when(F.col("_mad") <= 0, F.col("_mid") * 2).otherwise(F.col("_mid") + F.lit(k) * F.col("_mad") / F.lit(0.6745)).alias("threshold"))


def tukey_threshold(values: DataFrame, col: str, k: float = 3.0) -> DataFrame:
    """Third quartile + k times the quartile range; twice the third quartile where the range is zero."""
    q = values.agg(F.expr(f"percentile({col}, array(0.25, 0.75))").alias("_q"))
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    return q.select(F.when(q3 - q1 <= 0, q3 * 2).otherwise(q3 + F.lit(k) * (q3 - q1)).alias("threshold"))


def otsu_threshold(values: DataFrame, col: str, most_bins: int = 20) -> DataFrame:
    """Centre of the bin after which a cut gives the greatest variance between classes; the greatest value where there is nothing to cut.

    The rows are first reduced to at most ``most_bins`` bins by a partial aggregate, so the windows see few rows.
    """
    x = F.col(col).cast("double")
    span = values.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum(x).alias("total"))
    span = span.withColumn("bins", F.least(F.lit(most_bins), F.col("n")).cast("int")).withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    binned = values.select(x.alias("x")).crossJoin(F.broadcast(span)).filter("hi > lo").select(F.least(F.floor((F.col("x") - F.col("lo")) / F.col("width")), F.col("bins") - 1).cast("int").alias("bin"))
    hist = binned.groupBy("bin").agg(F.count("*").alias("c"))
    every = span.filter("hi > lo").withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    order = Window.orderBy("bin")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    h = every.join(F.broadcast(hist), "bin", "left").withColumn("c", F.coalesce("c", F.lit(0))).withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * F.col("width"))
    h = h.withColumn("wb", F.sum("c").over(run)).withColumn("sb", F.sum(F.col("c") * F.col("centre")).over(run)).withColumn("wf", F.col("n") - F.col("wb"))
    var = F.col("wb") * F.col("wf") * F.pow(F.col("sb") / F.col("wb") - (F.col("total") - F.col("sb")) / F.col("wf"), F.lit(2.0))
    best = h.filter("wb > 0 and wf > 0").select("bin", "centre", var.alias("v")).filter("v > 0").agg(F.max_by("centre", F.struct("v", -F.col("bin"))).alias("cut"))
    return span.crossJoin(F.broadcast(best)).select(F.coalesce("cut", "hi").alias("threshold"))


def degree_threshold(values: DataFrame, col: str, method: str, pct: float = 95.0, k: float = 3.0) -> DataFrame:
    """Threshold by name: mad, tukey, otsu, none (infinite), anything else a percentile."""
    if method == "mad":
        return mad_threshold(values, col, k)
    if method == "tukey":
        return tukey_threshold(values, col, k)
    if method == "otsu":
        return otsu_threshold(values, col)
    if method == "none":
        return values.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"))
    return percentile_threshold(values, col, pct)


def winsor_bounds(values: DataFrame, col: str) -> DataFrame:
    """(lo, hi): least and greatest of fewer than four values, else the order statistics at a tenth and nine tenths.

    Equal values are counted first and the distinct ones sorted into ranges; running sums over one row for each range tell in
    which range a place lies, and only there the values are numbered. So no task holds the column.
    """
    counts = values.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count("*").alias("_c"))
    x = checkpoint(counts.repartitionByRange("_v").withColumn("_range", F.spark_partition_id()))
    ranges = x.groupBy("_range").agg(F.sum("_c").alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", "_sum", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("_n"))
    n = F.col("_n")
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.when(n < 4, few).otherwise(F.floor(n * F.lit(p)) + 1).alias("at")) for k, few, p in (("lo", F.lit(1), 0.1), ("hi", n, 0.9)))))
    places = ranges.select("_range", "_before", "_sum", asked.alias("a")).filter((F.col("a.at") > F.col("_before")) & (F.col("a.at") <= F.col("_before") + F.col("_sum")))
    inside = x.withColumn("_upto", F.sum("_c").over(Window.partitionBy("_range").orderBy("_v")))
    hit = inside.join(F.broadcast(places), "_range").filter((F.col("_before") + F.col("_upto") >= F.col("a.at")) & (F.col("_before") + F.col("_upto") - F.col("_c") < F.col("a.at")))
    return hit.agg(F.max(F.when(F.col("a.k") == "lo", F.col("_v"))).alias("lo"), F.max(F.when(F.col("a.k") == "hi", F.col("_v"))).alias("hi")).filter("lo is not null")


def winsor_scale(value: Column, lo: Column, hi: Column) -> Column:
    """Value between the bounds as 0 to 1; 1 where the bounds are equal."""
    return F.when(hi - lo < 1e-8, 1.0).otherwise(F.least(F.greatest((value - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))

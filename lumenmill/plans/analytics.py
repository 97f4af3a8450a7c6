"""Questions asked of ledgers: lineage, summaries, displacement, timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lineage(ledger: DataFrame, source: DataFrame, id_column: str) -> DataFrame:
    """Each output with its parent's row."""
    return ledger.join(source, ledger["parent_id"] == source[id_column].cast("string"))


def summary(ledger: DataFrame, by: str = "selection") -> DataFrame:
    return ledger.groupBy(by).agg(F.count("*").alias("outputs"), F.countDistinct("id").alias("ids"), F.countDistinct("parent_id").alias("parents"))


def failure_rate(rows: DataFrame, failed: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(failed).alias("failed"), (F.count_if(failed) / F.count("*")).alias("rate"))


def displacement(a: Column, b: Column, peak: float = 1.0) -> dict[str, Column]:
    """Largest and Euclidean change, mean squared error and PSNR between two arrays."""
    d = F.zip_with(a, b, lambda x, y: y.cast("double") - x.cast("double"))
    squares = F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)
    mse = squares / F.size(a)
    return {"delta_max": F.array_max(F.transform(d, lambda x: F.abs(x))), "delta_2": F.sqrt(squares), "mse": mse, "psnr": F.when(mse > 0, 10 * F.log10(F.lit(peak * peak) / mse))}


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, median, index-based interquartile range, least and largest of each group."""
    # equal values are counted before they meet; what a group's task sorts can spill
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    own = Window.partitionBy(*by)
    upto = F.sum("_c").over(own.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(*by, "_v", (upto - F.col("_c")).alias("_from"), upto.alias("_to"), F.sum("_c").over(own).alias("n"))
    at = lambda i: F.max(F.when((F.col("_from") <= i) & (i < F.col("_to")), F.col("_v")))
    n = F.col("n")
    return ranked.groupBy(*by, "n").agg(((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"), (at(F.floor(3 * n / 4)) - at(F.floor(n / 4))).alias("iqr"), F.min("_v").alias("least"), F.max("_v").alias("most"))

"""Row numbers without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_index(df: DataFrame, file: str, row: str, name: str, width: int = 65_536) -> DataFrame:
    """Adds the rank of each row by (file, row), from 0: counts of blocks, then ranks within a block."""
    df = df.withColumn("_block", F.floor(F.col(row) / width))
    counts = df.groupBy(file, "_block").count()
    before = counts.select(file, "_block", (F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy(file, "_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(file, "_block").orderBy(row)) - 1
    return df.join(before, [file, "_block"]).withColumn(name, F.col("_before") + own).drop("_block", "_before")

"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; the row at place r of n
gets the fractional rank (r + 1/2) / n. Sorting all rows by that rank
interleaves the sources in proportion to their sizes, so any cut of the sorted
sequence holds the whole corpus' mixture. The sequence is cut into shards whose
row counts differ by one at most (law ``rows``).

Neither sort happens in one task: a row's place is the number of rows in
earlier hash buckets (a small aggregated table) plus its place in its own
bucket. Buckets come from a hash of id and text, so a source or an id (or null)
with a third of all rows is spread over all of them.

Groups of equal texts are not kept together under this law: their rows are spread
like any others, as whole groups could not keep counts at most one apart.

Cases: an empty table gives no rows; null ids, texts and sources are ordinary
values (a null source is a stratum of its own, a null text has size 1 and a
null crc); repeated rows are separate rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prefix_totals, seeded_hash

BUCKETS = 4096
HASH_BITS = 60


def shard(docs: DataFrame, shards: int = 8, seed: str = "shard-0", buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: its size, text crc, shard and slot in the shard."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("_src"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col(text_col).cast("binary")).alias("text_crc32"),
    ).withColumn("_h", seeded_hash(seed, F.col("doc_id"), F.col("text_crc32"), F.col("size")))
    rows = rows.withColumn("_b", F.floor(F.col("_h") / F.lit(float(2**HASH_BITS)) * buckets).cast("int"))
    before = prefix_totals(rows, ["_src"], "_b", F.lit(1))
    tie = ["_h", "doc_id", "text_crc32", "size"]
    ranked = rows.join(before, ["_src", "_b"]).withColumn("_r", F.row_number().over(Window.partitionBy("_src", "_b").orderBy(*tie)) - 1 + F.col("_before"))
    spread = ranked.select(*tie, "_src", ((F.col("_r") + 0.5) / F.col("_total")).alias("_f"))
    spread = spread.withColumn("_c", F.floor(F.col("_f") * buckets).cast("int"))
    ahead = prefix_totals(spread, [], "_c", F.lit(1))
    place = F.row_number().over(Window.partitionBy("_c").orderBy("_f", "_src", *tie)) - 1 + F.col("_before")
    placed = spread.join(ahead, "_c").withColumn("_p", place)
    least = F.floor(F.col("_total") / shards)
    larger = F.col("_total") % shards
    edge = larger * (least + 1)
    cut = F.when(F.col("_p") < edge, F.floor(F.col("_p") / (least + 1))).otherwise(larger + F.floor((F.col("_p") - edge) / F.greatest(least, F.lit(1))))
    start = F.when(F.col("_p") < edge, F.col("shard") * (least + 1)).otherwise(edge + (F.col("shard") - larger) * least)
    return placed.withColumn("shard", cut.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_p") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_f").alias("fractional_rank")
    )

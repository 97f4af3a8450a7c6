"""Mixing sources to target weights by a time-varying curriculum.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and
share 150 % of all words; a target stops at twice its source's words and the
excess goes to the others by weight (water filling, solved in closed form over
the table of sources).

Curriculum: over training time t in [0, 1] a source's weight is its target
times 1 + a(2t - 1), with slope a by source. Its integral is the cumulative
token demand D(t) = T (t + a (t^2 - t)); the word at place u of a source's
stream is due at the t where D(t) = u. A source's stream repeats its documents
in seeded random order until the target is met, so a document is taken whole
0, 1 or 2 times and a source misses its target by less than one document. The
result is range-sorted by training position.

Places within a source come from totals of buckets by a hash of id and text, so
neither a source nor an id (or null) with a third of all rows meets in one task.

Cases: an empty table gives no rows; null or wordless texts have size 0 and are
never taken; null sources form one source; null ids and repeated rows are
ordinary rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Scratch, prefix_totals, seeded_hash

WEIGHTS = (3.0, 1.0, 2.0)
SLOPES = (0.5, 0.0, -0.5)
BUDGET = 1.5
MOST = 2.0
BUCKETS = 1024
HASH_BITS = 60


def targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """sizes: (_src, source_size), a row per source. Adds target and slope."""
    pick = lambda values, n: F.element_at(F.array(*[F.lit(float(v)) for v in values]), n)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("_src").asc_nulls_last()))
    table = sizes.withColumn("_n", ((rank - 1) % len(weights) + 1).cast("int"))
    table = table.withColumn("_w", pick(weights, F.col("_n"))).withColumn("_cap", F.lit(most) * F.col("source_size"))
    every = Window.partitionBy(F.lit(0))
    filling = every.orderBy(F.col("_cap") / F.col("_w"), "_n", "_src").rowsBetween(Window.unboundedPreceding, 0)
    left = F.lit(budget) * F.sum("source_size").over(every) - (F.sum("_cap").over(filling) - F.col("_cap"))
    weight = F.sum("_w").over(every) - (F.sum("_w").over(filling) - F.col("_w"))
    table = table.withColumn("_level", left / weight).withColumn("_full", F.col("_level") * F.col("_w") > F.col("_cap"))
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(every)
    return table.select("_src", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(level * F.col("_w"), F.col("_cap"))).alias("target"), pick(slopes, F.col("_n")).alias("_a"))


def mix(docs: DataFrame, seed: str = "mix-0", buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, slopes=SLOPES, keep: tuple[str, ...] = (), ordered: bool = True) -> DataFrame:
    """One row per document with the words taken and its training positions.

    ``keep`` names further columns to carry (the pipeline's documents). The
    result is range-sorted by position; callers that repeat rows and sort them
    themselves leave that out (``ordered``).
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    carried = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("_s"), size.alias("size"), F.md5(F.col(text_col).cast("binary")).alias("_u"), carried.alias("_kept"))
    rows = rows.withColumn("_src", F.coalesce(F.concat(F.lit("s"), F.col("_s")), F.lit("t"))).withColumn("_h", seeded_hash(seed, F.col("doc_id"), F.col("size"), F.col("_u"))).drop("_u")
    rows = rows.withColumn("_b", F.floor(F.col("_h") / F.lit(float(2**HASH_BITS)) * buckets).cast("int"))
    if not keep:  # texts are read once: what follows needs their sizes alone
        rows = Scratch(docs.sparkSession, "mix").keep(rows.drop("_kept", "_s"), "sizes")
    before = prefix_totals(rows, ["_src"], "_b", F.col("size")).withColumnRenamed("_total", "source_size")
    plan = targets(before.groupBy("_src").agg(F.max("source_size").alias("source_size")), weights, slopes)
    ranges = before.join(plan.drop("source_size"), "_src")
    inner = Window.partitionBy("_src", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(ranges, ["_src", "_b"]).withColumn("_mid", F.sum("size").over(inner) - F.col("size") / 2 + F.col("_before"))
    due = lambda lap: (F.col("size") > 0) & (F.lit(lap) * F.col("source_size") + F.col("_mid") < F.col("target"))

    def position(lap: int):
        u, a = (F.lit(lap) * F.col("source_size") + F.col("_mid")) / F.col("target"), F.col("_a")
        ramp = (F.sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * a)
        return F.when(due(lap), F.when(a == 0, u).otherwise(ramp))

    copies = due(0).cast("int") + due(1).cast("int")
    out = placed.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), position(0).alias("position"), position(1).alias("second_position"), *(["_kept"] if keep else []))
    return out if not ordered else out.orderBy(F.col("position").asc_nulls_last(), seeded_hash(seed, F.col("doc_id")))

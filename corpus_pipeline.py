"""A corpus pipeline: five stages over ``documents``, each calling one operator.

quality classifier -> n-gram Jaccard join -> suffix-array dedup -> source mix ->
BPE. A stage works on all that the stage before kept; all but the last return
the columns of ``documents``. ``run`` writes each stage's result to the folder
that ``spark.checkpoint.dir`` names and reads it again for the next.

Decisions: documents predicted as bad quality go; of each component of near
duplicates the smallest id stays (rows that repeat its id and text go too; where
an id has several texts, each is judged by itself, all but one after all ids);
byte ranges that repeat elsewhere are cut out; a document is there as often as
the mix takes it (0, 1 or 2 times), in training order; the last stage returns
token counts and digests.

Rows with a null id are never merged with others: they pass the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.llm import bpe, mixing, ngram_join, quality, suffix_dedup
from lumenmill.llm.common import Scratch
from lumenmill.llm.queries import vocabulary
from lumenmill.session import ship


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels, keep=tuple(docs.columns)).filter("predicted = 1").select("kept.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id."""
    ship(spark)
    text = F.xxhash64("text")
    many = Scratch(spark, "texts").keep(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("_first"), F.max(text).alias("_last")).filter("_first <> _last").select("doc_id", "_first"), "many")
    keyed = docs.withColumn("_key", F.col("doc_id").cast("long"))
    if many.first() is not None:
        # further texts of an id are documents of their own, after all ids
        further = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
        keyed = docs.join(many, "doc_id", "left").withColumn("_key", F.when(F.col("_first") != text, further).otherwise(F.col("doc_id").cast("long"))).select(*docs.columns, "_key")
        keyed = Scratch(spark, "keyed").keep(keyed, "documents")
    found = ngram_join.jaccard_components(keyed, id_col="_key").filter("doc_id = component_id").select(F.col("doc_id").alias("_stays")).distinct()
    named = keyed.join(found, F.col("_key") == F.col("_stays")).groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("_kept")).select("_kept.*")
    return named.unionByName(docs.filter("doc_id is null"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat; their length in characters is brought up to date."""
    ship(spark)
    out = suffix_dedup.rewrite(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    ship(spark)
    taken = mixing.mix(docs, keep=tuple(docs.columns), ordered=False).filter("taken > 0")
    due = F.explode(F.array_compact(F.array("position", "second_position"))).alias("_due")
    return taken.select("_kept", due).orderBy("_due", "_kept.doc_id").select("_kept.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded text."""
    ship(spark)
    return bpe.tokenize(docs, vocabulary())


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("repeated_passages", without_repeats),
    ("mix", mixed),
    ("tokens", tokens),
]

#: SQL cannot express the stages; tests/llm hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Jobs over a stream of files: the same kernel, one ledger append a micro-batch.

Outputs depend on their own row alone, so the query is stateless. An explicit id
column is needed: a row's place in the table is not known in a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.recipes import Recipe, identified
from ..plans.config import parse
from ..plans.job import LEDGER, deliver, staged
from ..plans.writers import writer_of
from ..sources import parquet


def stream_ledger(stream: DataFrame, recipes: list[Recipe], id_column: str, selection: str) -> DataFrame:
    """Ledger rows (without payload) of a streaming or static source."""
    rows = identified(stream, recipes, F.col(id_column))
    own = {"selection": F.lit(selection), "dataloader": F.lit(selection), "artifact": F.lit(None).cast("string")}
    return rows.select(*[own[c].alias(c) if c in own else c for c in LEDGER.names])


def start(spark: SparkSession, given: dict, schema: StructType, checkpoint: str, available_now: bool = True, selection: str | None = None) -> StreamingQuery:
    """Run one of a job's loaders (the first, or the named) over files as they arrive.

    Every micro-batch passes the failure gate on its own and appends ledger files;
    a batch that fails it stops the stream with nothing of it written.
    """
    job = parse(given)
    loader = next((x for x in job.loaders if selection in (None, x["name"])), None)
    if loader is None:
        raise ValueError(f"no loader is named {selection!r}")
    if loader["type"] != "parquet":
        raise ValueError("a stream reads parquet files")
    if not loader["id_column"]:
        raise ValueError("a stream needs id_column")
    path = job.outputs["path"].format(selection=loader["name"])

    def batch(df: DataFrame, number: int) -> None:
        loaded = df.withColumn("_file", F.lit(f"batch-{number}")).withColumn("_row", F.lit(0).cast("long"))
        made, kept = staged(spark, job, loader, source=parquet.prepared(loaded, loader))
        own = f"{path}/batch={number}"
        deliver(spark, job, loader["name"], made, kept, f"{path}.batch-{number}", writer_of("parquet", "ledger", {"path": own}), ordered=False)

    writer = spark.readStream.schema(schema).parquet(loader["path"]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_all(spark: SparkSession, given: dict, schemas: dict[str, StructType], checkpoint: str, available_now: bool = True) -> dict[str, StreamingQuery]:
    """One stream for each of a job's loaders, with a checkpoint of its own."""
    names = [x["name"] for x in parse(given).loaders]
    if lacks := [n for n in names if n not in schemas]:
        raise ValueError(f"streams need the schema of {', '.join(lacks)}")
    return {n: start(spark, given, schemas[n], f"{checkpoint}/{n}", available_now, n) for n in names}

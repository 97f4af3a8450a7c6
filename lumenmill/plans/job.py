"""Jobs: scan -> filter -> cast -> one kernel pass over all recipes -> ledger.

A row's sample is decoded once and every recipe is applied to it inside one
``mapInArrow``, so pixels never leave the task that read them but as payload
files. A task with several cores (``spark.task.cpus``) applies recipes to a large
sample on up to ``compute.threads`` threads. Only an ordered ledger is shuffled, without pixels. The kernel's
rows go to a staging table first: the failure gate reads its counters there, and
the ledger appears only after the gate has passed.
"""

from __future__ import annotations

import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.codec import UnsupportedFormat, decode_image, encode_png
from ..functions.matching import include_exclude
from ..functions.recipes import artifact_name
from ..operators.transformations import Transformation
from ..sources import loaders, parquet
from .config import FAST, Job, parse
from .writers import OutputWriter, writer_of

LEDGER = StructType(
    [StructField(c, StringType(), False) for c in ("selection", "dataloader", "parent_id", "id", "algorithm", "family", "arity")]
    + [StructField("reversible", BooleanType(), False), StructField("params", StringType(), False), StructField("seed", LongType())]
    + [StructField(c, StringType()) for c in ("tool_model", "target_model", "artifact")]
)
RANGE = (0.0, 255.0)
#: Samples of so many bytes are worth a task's threads.
LARGE = 1 << 20


def decode(value, height, width, shape, prefix: str) -> np.ndarray:
    """Raw RGBA bytes, or an image file by absolute path or below a prefix."""
    if value is None:
        raise ValueError("the sample is null")
    if isinstance(value, bytes):
        if shape is not None:
            height, width = shape
        if height is None or width is None:
            raise ValueError("raw bytes need image_shape, or height and width columns")
        return np.frombuffer(value, np.uint8).reshape(int(height), int(width), 4)
    if not value.startswith("/") and "://" not in value:
        if not prefix:
            raise ValueError(f"the path {value!r} is relative and there is no prefix")
        value = os.path.join(prefix, value)
    return decode_image(read_file(value))


def read_file(path: str) -> bytes:
    """A whole file, local or by URI."""
    if "://" in path:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(path)
        with store.open_input_stream(path) as f:
            return f.read()
    with open(path, "rb") as f:
        return f.read()


def kernel(selection: str, loader: dict, transformations: list[Transformation], writer: OutputWriter, errors: dict, payloads: bool, threads: int = 1, ahead: int = 64):
    """(_id, _sample, _height, _width, _file, _row, *kept) to status and ledger rows."""
    prefix, shape, images = loader["sample_path"][0].get("prefix") or "", loader["image_shape"], errors["images"]
    on_decode = images["on_decode_failure"] or errors["default"]
    on_format, on_transform = images["on_unsupported_format"] or FAST, images["on_transform_error"] or FAST

    def made(t: Transformation, x: np.ndarray, parent: str) -> tuple[str, str, bytes | None]:
        out, own = t.apply(x, parent, RANGE), t.recipe.identity(parent)
        return own, artifact_name(selection, own, out), encode_png(out) if writer.payload or payloads else None

    def results(x: np.ndarray, parent: str, pool: ThreadPoolExecutor | None):
        """Each transformation's result as something to call, in order; models stay on the task's own thread."""
        width = threads if pool and x.nbytes >= LARGE else 1
        for start in range(0, len(transformations), width):
            part = transformations[start : start + width]
            yield from [pool.submit(made, t, x, parent).result if width > 1 and t.algorithm.role is None else partial(made, t, x, parent) for t in part]

    def run(batches):
        if threads == 1:
            yield from each(batches, None)
            return
        with ThreadPoolExecutor(threads) as pool:
            yield from each(batches, pool)

    def each(batches, pool):
        for batch in batches:
            kept = batch.schema.names[6:]
            for start in range(0, batch.num_rows, ahead):
                part = batch.slice(start, ahead)
                columns = [part.column(k).to_pylist() for k in range(6)]
                source, rows = [], []
                for i, (parent, value, h, w, _, _) in enumerate(zip(*columns, strict=True)):
                    try:
                        x = decode(value, h, w, shape, prefix)
                    except Exception as e:
                        if FAST == (on_format if isinstance(e, UnsupportedFormat) else on_decode):
                            raise
                        source.append(i)
                        rows.append((-1, f"{type(e).__name__}: {e}", *[None] * 14))
                        continue
                    source.append(i)
                    rows.append((-1, None, *[None] * 14))
                    for t, result in enumerate(results(x, parent, pool)):
                        r = transformations[t].recipe
                        try:
                            own, name, png = result()
                        except Exception as e:
                            if on_transform == FAST:
                                raise
                            source.append(i)
                            rows.append((-2, f"{type(e).__name__}: {e}", *[None] * 14))
                            continue
                        if writer.payload:
                            writer.add_payload(selection, name, png)
                        source.append(i)
                        rows.append((t, None, selection, loader["name"], parent, own, r.algorithm, r.family, r.arity, r.reversible, r.params_json, r.seed, r.tool_model, r.target_model, name, png if payloads else None))
                writer.flush()
                types = [pa.int32(), pa.string(), *[pa.string()] * 7, pa.bool_(), pa.string(), pa.int64(), *[pa.string()] * 3, pa.binary()]
                made = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                back = part.take(pa.array(source))
                yield pa.RecordBatch.from_arrays([*made, back.column(4), back.column(5), *(back.column(c) for c in kept)], ["_t", "_error", *LEDGER.names, "_png", "_file", "_row", *kept])

    return run


def staged(spark: SparkSession, job: Job, loader: dict, payloads: bool = False, source: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """The kernel's rows of one loader, and the pass-through columns."""
    df = loaders.scan(spark, loader) if source is None else source
    sample = loader["sample_path"][0]["column"]
    if sample not in df.columns:
        raise ValueError(f"the source has no column {sample!r}")
    available = [c for c in parquet.columns_of(df) if c != sample]
    out = job.outputs
    named = out["include"] is not None or out["exclude"] is not None
    kept = [c for c in include_exclude(out["include"], out["exclude"], available) if c in available and c not in LEDGER.names] if named else []
    size = lambda c: (F.col(c) if c in df.columns else F.lit(None)).cast("int").alias(f"_{c}")
    # only what the kernel needs crosses to Python
    rows = df.select("_id", F.col(sample).alias("_sample"), size("height"), size("width"), "_file", "_row", *kept)
    writer = OutputWriter("none") if payloads else writer_of("images", "images", {k: out[k] for k in ("samples_dir", "write_samples", "flush_batch_size")})
    schema = StructType([StructField("_t", IntegerType()), StructField("_error", StringType()), *[StructField(f.name, f.dataType) for f in LEDGER], StructField("_png", BinaryType()), StructField("_file", StringType()), StructField("_row", LongType()), *[df.schema[c] for c in kept]])
    threads = min(job.compute["threads"], int(spark.conf.get("spark.task.cpus", "1")))
    run = kernel(loader["name"], loader, job.transformations, writer, job.errors, payloads, threads)
    return rows.mapInArrow(run, schema), kept


def ledger_of(rows: DataFrame, kept: list[str]) -> DataFrame:
    return rows.filter("_t >= 0").select(*LEDGER.names, *kept)


def deliver(spark: SparkSession, job: Job, selection: str, rows: DataFrame, kept: list[str], path: str, ledger: OutputWriter, ordered: bool = True, single_file: bool = False) -> int:
    """Stage the kernel's rows, hold them against the failure gate, write the ledger; its number of rows."""
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    rows.drop("_png").write.parquet(staging)
    try:
        made = spark.read.parquet(staging)
        total, failed, n = made.agg(F.count_if(F.col("_t") == -1), F.count_if((F.col("_t") == -1) & F.col("_error").isNotNull()), F.count_if(F.col("_t") >= 0)).first()
        if total and failed / total > job.errors["max_failure_rate"]:
            raise RuntimeError(f"{selection}: {failed} of {total} samples could not be decoded; the limit is {job.errors['max_failure_rate']:.0%}")
        if n:
            out = made.filter("_t >= 0")
            if ordered:
                order = ["_file", "_row", "_t"]
                out = out.repartition(1).sortWithinPartitions(*order) if single_file else out.orderBy(*order)
            ledger.add_rows(selection, out.select(*LEDGER.names, *kept))
        return n
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def run_job(spark: SparkSession, given: dict, instances: dict | None = None, ordered: bool = True, single_file: bool = False) -> dict[str, int]:
    """Run a job; the number of ledger rows by selection.

    ``ordered`` writes the ledger range-sorted in sample-major order (in one file
    if asked); without it it is written with no shuffle.
    """
    job, summary = parse(given, instances), {}
    ledger = writer_of("parquet", "ledger", {k: job.outputs[k] for k in ("path", "flush_batch_size")})
    for loader in job.loaders:
        selection = loader["name"]
        if not job.transformations:
            summary[selection] = 0
            continue
        rows, kept = staged(spark, job, loader)
        summary[selection] = deliver(spark, job, selection, rows, kept, job.outputs["path"].format(selection=selection), ledger, ordered, single_file)
    return summary


def payload_table(spark: SparkSession, given: dict, instances: dict | None = None) -> DataFrame:
    """(selection, artifact, png) of all loaders: the payload as a table, for stores without local files."""
    job = parse(given, instances)
    parts = [staged(spark, job, x, payloads=True)[0].filter("_t >= 0").select("selection", "artifact", F.col("_png").alias("png")) for x in job.loaders]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

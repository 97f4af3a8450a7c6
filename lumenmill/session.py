"""Session helpers: settings the engine wants, and shipping the package to workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent

#: Frames are large rows: small reader batches and Arrow batches bound a task's memory.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}


def session(app: str = "lumenmill", **conf: str) -> SparkSession:
    """A session with the engine's settings; keywords add to or replace them."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, unless they run on this machine and its path has it."""
    context = spark.sparkContext
    here = context.master.startswith("local")
    if here and str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    if getattr(context, "_lumenmill_shipped", False):
        return
    archive = f"{tempfile.mkdtemp()}/lumenmill.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    context.addPyFile(archive)
    context._lumenmill_shipped = True

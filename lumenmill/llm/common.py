"""Helpers shared by the operators: scratch tables, distributed ranks, hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than space and U+0009..U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: For scratch tables: no mark of success, and in folders that Hadoop sees as local no checksum files (pages have their own).
#: Hadoop starts a process to set the mode of each such file, and until that has begun it shares all of the executor's memory.
PLAIN_FILES = {
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
}
CHECKED_PAGES = {"parquet.page.verify-checksum.enabled": "true"}


class Scratch:
    """Tables written to the folder that ``spark.checkpoint.dir`` names.

    Every executor and the driver can read them, so a lost executor costs
    nothing but a retry. Where the setting is absent a local temporary folder
    is used in local mode; on a cluster that is refused. Tables go when they are
    dropped, and all that are left when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.gettempdir() + "/lumenmill-checkpoints"
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._clear)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: lineage is cut, work is done once."""
        path = f"{self.root}/{name}"
        df.write.options(**PLAIN_FILES).mode("overwrite").parquet(path)
        trim_driver(self.spark)
        return self.spark.read.schema(df.schema).options(**CHECKED_PAGES).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _clear(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            self._delete(self.root)


def sliced(batches, rows: int = 512, size: int = 4 << 20):
    """Parts of so many rows and bytes at most (one row at least): what is derived from long texts is held for a part at a time."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            open_parts = [b.slice(start, rows)]
            while open_parts:
                part = open_parts.pop()
                half = part.num_rows // 2
                if half and part.nbytes > size:
                    open_parts += [part.slice(half), part.slice(0, half)]
                else:
                    yield part


def trim() -> None:
    """Give memory that is no longer used back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trim_driver(spark: SparkSession) -> None:
    """Let the driver's JVM give native memory that it has freed back to the system.

    Over many plans it frees more than 100 MB that glibc would hold. JVMs without that command keep theirs.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    # by reflection on the interface: py4j can't see the methods of the server's own class
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    given = array(jvm.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    given[2], given[3] = array(jvm.Object, 0), array(jvm.String, 0)
    with contextlib.suppress(Py4JJavaError):
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


#: How to forget what tasks of a kind keep in their worker for the next of that kind.
KEPT: dict[str, Callable[[], None]] = {}
#: The timer that forgets when a worker stays idle, for so many seconds.
IDLE: list[threading.Timer] = []
IDLE_S = 2


def forget(but: str | None = None) -> None:
    """Forget what tasks of kinds other than ``but`` have kept in this worker."""
    others = [kind for kind in KEPT if kind != but]
    for kind in others:
        KEPT.pop(kind, lambda: None)()
    if others:
        trim()


def awake(kind: str | None) -> None:
    """A task begins. A function of the module: what is sent with a task has copies of the tables above."""
    while IDLE:
        IDLE.pop().cancel()
    forget(kind)


def idle() -> None:
    """A task has ended: what is kept goes if no other begins soon."""
    if KEPT:
        IDLE.append(threading.Timer(IDLE_S, forget))
        IDLE[-1].daemon = True
        IDLE[-1].start()


def frugal(run, kind: str | None = None):
    """``run`` for mapInArrow; what its task has freed is given back at its end, not when the worker ends.

    What tasks of other kinds than this one's have kept in the worker goes at its start, what this kind keeps
    once the worker has been idle for IDLE_S: an executor can have more workers than tasks.
    """

    def whole(batches):
        awake(kind)
        try:
            yield from run(batches)
        finally:
            trim()
            idle()

    return whole


def seeded_hash(seed: str, *cols: Column) -> Column:
    """60 bits of md5 over the seed and the columns; nulls count as empty."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """True where crc32 of the id's decimal text leaves ``rest``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def prefix_totals(df: DataFrame, group: list[str], bucket: str, amount: Column) -> DataFrame:
    """Per (group, bucket): the amount in earlier buckets and the group's total.

    The input of the window is one row per group and bucket, never the rows.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(amount).alias("_sum"))
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    return sums.select(
        *group,
        bucket,
        (F.sum("_sum").over(own.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"),
        F.sum("_sum").over(own).alias("_total"),
    )

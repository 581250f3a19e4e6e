"""What the operators of this package share: documents as Arrow batches, and tables that all executors can read."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import shared_folder

#: Bytes of a batch handed to Python, about, and of the slices that are worked on at a time: numpy's intermediate arrays are 8 bytes and more for each byte of text.
BATCH_BYTES = 8 << 20
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def workspace(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    return shared_folder(spark)


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


_COLLECTED = [0.0]


def collected(spark: SparkSession, seconds: float = 5.0) -> None:
    """Ask the driver to collect its garbage, once in so many seconds: only then are shuffle files deleted that no plan needs any more."""
    if time.monotonic() - _COLLECTED[0] > seconds:
        spark._jvm.System.gc()
        returned(spark)
        _COLLECTED[0] = time.monotonic()


def returned(spark: SparkSession) -> None:
    """Have the driver's JVM give native memory that it has freed back to the system: planning and compiling leave much of it behind."""
    java, new_array = spark._jvm.java.lang, spark.sparkContext._gateway.new_array
    kinds, values = new_array(java.Class, 4), new_array(java.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = java.Class.forName(name)
    values[0] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    values[1] = "systemTrimNativeHeap"
    # by the interface's method: the server's class itself is not open to callers
    invoke = java.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
    with contextlib.suppress(Py4JJavaError):  # a JVM or C library without that command
        invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), values)


def executors_collected(spark: SparkSession) -> None:
    """Ask each executor to collect its garbage, by a task for each: its JVM keeps what a heap has grown to, and its workers need room beside it.

    Nothing to do where driver and executor are one.  An executor that is busy just then may be passed over, which only leaves its memory as it is.
    """
    n = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1
    if n > 0:
        spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


_FOLDERS = "_quirework_folder"


def stored(df: DataFrame, name: str = "table", mode: str = "zstd") -> DataFrame:
    """``df`` written as Parquet into a workspace and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    folder = workspace(spark)
    path = f"{folder}/{name}"
    df.write.option("compression", mode).parquet(path)
    collected(spark)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _FOLDERS, folder)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(getattr(table, _FOLDERS))
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        step = max(1, min(n, int(n * SLICE_BYTES / max(batch.nbytes, 1))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


_RESIDENT: dict[str, object] = {}


def resident(key: str, make: Callable[[], object]):
    """What a Python worker keeps from task to task: one thing, until it works for another operator."""
    if key not in _RESIDENT:
        keep_only(key)
        _RESIDENT[key] = make()
    return _RESIDENT[key]


BITS = 1 << 28


def bitmap_of(ids: DataFrame, column: str = "id"):
    """Bits (a power of two, BITS at most) and a broadcast bitmap of the low bits of a column of ``ids``.

    The driver gets a row for each 64 bits that are not all 0, so never more than BITS / 64; with
    few ids the bitmap is folded until it has about 16 bits for each.
    """
    low = F.col(column).bitwiseAND(BITS - 1)
    words = ids.select(F.shiftright(low, 6).alias("w"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    size = min(BITS, max(1 << 16, 1 << int(16 * len(words)).bit_length()))
    table = np.zeros(size // 64, np.int64)
    np.bitwise_or.at(table, words["w"].to_numpy() & (size // 64 - 1), words["v"].to_numpy())
    return size, ids.sparkSession.sparkContext.broadcast(table.view(np.uint64))


def keep_only(key: str) -> None:
    """Give up what another operator has left in this worker; it may hold cycles, which only the collector ends."""
    if _RESIDENT and key not in _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        released()


def released() -> None:
    """Give memory that is not in use back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keeps: str = "") -> DataFrame:
    """``df.mapInArrow`` by tasks that leave nothing in their worker but the resident named ``keeps``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(keeps)
        try:
            yield from run(batches)
        finally:
            released()

    return df.mapInArrow(task, schema)


def per_document(df: DataFrame, columns: list[str], row: Callable[[], Callable[..., tuple]], schema: str, keeps: str = "") -> DataFrame:
    """Apply a function of ``columns`` to every row; ``row()`` is called once a task and returns it."""
    names = [f.split()[0] for f in schema.split(",")]
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, types = row(), None
        for part in slices(batches):
            out = [one(*x) for x in zip(*(c.to_pylist() for c in part.columns))]
            types = types or arrow_types(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return mapped(df.select(*columns), run, schema, keeps)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}


def arrow_types(schema: str) -> list[pa.DataType]:
    return [_ARROW[f.split()[1]] for f in schema.split(",")]


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the decimal doc_id leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))

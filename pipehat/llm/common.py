"""Shared pieces of the training-data operators: scratch tables and byte views of Arrow text."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The chosen columns of the ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where that is unset (tests, local mode), a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("pipehat.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pipehat-")
        spark.conf.set("pipehat.scratch", base)
        atexit.register(_remove_tree, base.removeprefix("file://"))
    return base.rstrip("/")


def _remove_tree(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


_RUN = uuid.uuid4().hex
_run_dirs: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this process's own folder of the shared one; the folder is deleted when the process ends."""
    run = f"{shared_dir(spark)}/pipehat/{_RUN}"
    if run not in _run_dirs:
        _run_dirs.add(run)
        atexit.register(_delete_run, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), run)
    return f"{run}/{name}-{uuid.uuid4().hex}"


def _delete_run(jvm, conf, run: str) -> None:
    try:
        where = jvm.org.apache.hadoop.fs.Path(run)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # the gateway may have ended before: the folder stays, as after a crash
        pass


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writers: dict[str, list] = {}


def _begin(spark: SparkSession) -> None:
    with _lock:
        own = _writers.setdefault(str(spark._jsparkSession.sessionUUID()), [0, None])
        if not own[0]:
            own[1] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        own[0] += 1


def _end(spark: SparkSession) -> None:
    with _lock:
        own = _writers[str(spark._jsparkSession.sessionUUID())]
        own[0] -= 1
        if not own[0]:
            spark.conf.unset(CLEANUP) if own[1] is None else spark.conf.set(CLEANUP, own[1])


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: its lineage is cut.

    The shuffle files of the write are deleted once it is done, as nothing reads them again. Threads of one session may
    write at once: the setting is put back when the last of them is done.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _begin(spark)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        _end(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._pipehat_path = path
    return out


def bucketed(df: DataFrame, name: str, n: int, column: str, *order: str) -> DataFrame:
    """``df`` written like ``written``, in ``n`` buckets by ``column`` and sorted by it and ``order``: groups by ``column`` need no shuffle of it.

    Spark knows buckets only of tables in the catalog, so there is an entry there until ``forget``; the files lie in the shared folder.
    """
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"pipehat_{name}_{uuid.uuid4().hex}"
    _begin(spark)
    try:
        df.write.option("compression", "zstd").option("path", path).bucketBy(n, column).sortBy(column, *order).saveAsTable(table)
    finally:
        _end(spark)
    out = spark.table(table)
    out._pipehat_path, out._pipehat_table = path, table
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` or ``bucketed`` that nothing will read again."""
    for df in tables:
        table, path = getattr(df, "_pipehat_table", None), getattr(df, "_pipehat_path", None)
        if table:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        if path:
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, end to end, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def byte_slices(batch: pa.RecordBatch, column: str, limit: int):
    """``batch`` in slices of at most ``limit`` bytes of ``column``, or of one row that is longer."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(column: pa.Array) -> list[bytes]:
    """The rows of a string column as UTF-8 bytes; null counts as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()

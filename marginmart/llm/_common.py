"""Shared folder, staged tables and other small helpers of the subpackage."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Rows of an Arrow batch to a Python worker.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may do without the setting; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="llm-shared-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS, **options) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and fixes the rows."""
    spark = df.sparkSession
    small_batches(spark, batch_rows)
    path = scratch(spark, name)
    df.write.options(**options).option("compression", "zstd").parquet(path)
    small_batches(spark)
    return spark.read.schema(df.schema).parquet(path)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, across its tasks."""
    name = "_llm_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or plain local path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the string column of each holds about ``limit`` bytes (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    pool = pa.default_memory_pool()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
        # Idle workers of later stages keep nothing of this one.
        pool.release_unused()


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices joined until their string column holds about ``limit`` bytes."""
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in slices(batches, column, limit):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index(column)))).as_py() or 0
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def binary(values: pa.Array):
    """All bytes of a binary array (null: empty), writable, and the offsets of its rows."""
    import numpy as np
    import pyarrow.compute as pc

    values = pc.fill_null(values.cast(pa.large_binary()), b"")
    lengths = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return np.frombuffer(bytearray(b"".join(values.to_pylist())), np.uint8), offsets


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Rows of long texts go to Python few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keep_columns(df: DataFrame, taken: tuple[str, ...]) -> dict[str, str]:
    """Names of df's own columns that clash with ``taken``, each with a free name for it."""
    names = {c.lower() for c in df.columns} | set(taken)
    out = {}
    for c in df.columns:
        if c.lower() in taken:
            new = f"{c}_in"
            while new.lower() in names:
                new += "_"
            names.add(new.lower())
            out[c] = new
    return out

"""Cached load (S5): an enriched fact is built once per state of its input files and reused.

The cache lies in the shared checkpoint folder: one entry per set of input paths, in it one
version folder per content fingerprint (path, size and modification time of every input file, and
the library's own loading rules).  A load of unchanged files reads the version that is there and
runs no join; a changed file gives another fingerprint, so a new version is built, and versions
beyond ``keep`` are deleted.  A version is written under another name and renamed when it is
complete, so readers never see half of one and a lost driver leaves nothing that is read.  Each
version holds a manifest of its inputs, their fingerprint and the column order.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import enrich as E
from ..session import ensure_checkpoint_dir, settings
from . import csv, dims, mart
from .mart import STAR_COLUMNS
from .sinks import COMPRESSION

MANIFEST = "_manifest.json"
# The columns that the mart's lookups add.
LOOKED_UP = ("Sport", "State", "MarketplaceTier")
# Folders of a partitioned write that a task keeps open: with these Spark never adds a sort of its own by the
# folder's column, which would hold the derived rows and undo the order within it.
# The derived columns make one generated method beyond 8000 bytes of code, which the JVM would interpret for every row:
# with the limit Spark splits it.
WRITER_CONF = {"spark.sql.maxConcurrentOutputFileWriters": "8", "spark.sql.codegen.hugeMethodLimit": "8000"}
# Seconds after which the folder of an unfinished build is taken for abandoned.
ABANDONED = 24 * 3600


def _files(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path): the store of any path, seen from the driver."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _rules() -> str:
    """Digest of the modules that decide what a load gives."""
    return hashlib.sha256("".join(inspect.getsource(m) for m in (E, csv, dims, mart)).encode()).hexdigest()


def fingerprint(spark: SparkSession, inputs: Sequence[str], rules: str = "") -> str:
    """Digest of the paths, sizes and modification times of all input files, listed and summed by Spark."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(inputs))
             .select("path", "length", "modificationTime"))
    marks = [F.sum(F.xxhash64(F.lit(seed), "path", "length", "modificationTime").cast("decimal(38,0)")) for seed in (1, 2)]
    state = found.agg(F.count(F.lit(1)), F.sum("length"), *marks).first()
    return hashlib.sha256(f"{tuple(state)}|{rules}".encode()).hexdigest()[:32]


def _entry(spark: SparkSession, name: str, inputs: Sequence[str]) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/marginmart-cache/{name}-{hashlib.sha256(json.dumps(sorted(inputs)).encode()).hexdigest()[:16]}"


def cached(spark: SparkSession, name: str, inputs: Sequence[str], build: Callable[[], DataFrame], keep: int = 1,
           partition_by: str | None = "YearLabel", cluster_by: tuple[str, ...] = ("CompanyName",),
           derive: Callable[[DataFrame], DataFrame] | None = None, part_of: str | None = None) -> DataFrame:
    """The frame that ``build`` gives for the present state of ``inputs``, read from the cache when it is there.

    ``derive`` makes the frame's rows of those that ``build`` gives, row by row (projections only), after the
    sort of a write task, so the sort holds the rows without its columns.  ``part_of`` names an entry over the same
    inputs that has the frame's columns among others: its present version, when there, is read instead."""
    state = fingerprint(spark, inputs, _rules())
    if part_of:
        whole = f"{_entry(spark, part_of, inputs)}/v-{state}"
        fs, found = _files(spark, f"{whole}/{MANIFEST}")
        if fs.exists(found):
            return spark.read.parquet(whole).select(*build().columns)
    entry = _entry(spark, name, inputs)
    fs, home = _files(spark, entry)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    version, manifest = Path(home, f"v-{state}"), Path(home, f"v-{state}/{MANIFEST}")
    if not fs.exists(manifest):
        df = build()
        clusters = [c for c in cluster_by if c in df.columns]
        # Without a column to cluster by there is nothing to sort for: the writer keeps the folders apart by itself.
        df = df.sortWithinPartitions(*([partition_by] if partition_by else []), *clusters) if clusters else df
        df = derive(df) if derive else df
        order, draft, writer = df.columns, f"building-{uuid.uuid4().hex}", df.write
        with settings(spark, WRITER_CONF):
            (writer.partitionBy(partition_by) if partition_by else writer).option("compression", COMPRESSION).parquet(f"{entry}/{draft}")
        out = fs.create(Path(home, f"{draft}/{MANIFEST}"))
        out.write(json.dumps({"inputs": sorted(inputs), "fingerprint": state, "columns": order, "built": time.time()}).encode())
        out.close()
        # Another session may have built the same version meanwhile; the two are equal.
        if fs.exists(version) or not fs.rename(Path(home, draft), version):
            fs.delete(Path(home, draft), True)
    stream = fs.open(manifest)
    columns = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["columns"]
    stream.close()
    _drop_stale(fs, home, version, keep)
    return spark.read.parquet(f"{entry}/v-{state}").select(*columns)


def _drop_stale(fs, home, version, keep: int) -> None:
    """Delete all but the ``keep`` newest versions (the current one always stays) and abandoned builds."""
    versions = []
    for s in fs.listStatus(home):
        name, age = s.getPath().getName(), time.time() - s.getModificationTime() / 1000
        if name.startswith("v-") and name != version.getName():
            versions.append((age, s.getPath()))
        elif name.startswith("building-") and age > ABANDONED:
            fs.delete(s.getPath(), True)
    for _, path in sorted(versions, key=lambda x: x[0])[max(0, keep - 1):]:
        fs.delete(path, True)


def cached_load(spark: SparkSession, this_path: str, last_path: str, keep: int = 1, multi_line: bool = False) -> DataFrame:
    """:func:`marginmart.sources.csv.load_combined` of the two exports, memoised on the files."""
    return cached(spark, f"exports{'-multiline' if multi_line else ''}", [this_path, last_path],
                  lambda: csv.load_combined(spark, this_path, last_path, multi_line=multi_line), keep)


def _narrow_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cached mart's sort holds: the joined tables' own columns, narrower than the mart's decimals and texts,
    the sort's columns, and the looked-up ones with the marketplace (a lookup is a join, and Spark keeps no sort below one)."""
    early = ("YearLabel", "RequestedPerformerTypeId", "PrimaryPerformerName")
    rows = mart.star_rows(spark, sf_dir).withColumns({c: F.expr(mart.MART_EXPRS[c]) for c in early})
    # Derived again after the sort, of columns that it holds anyway.
    return csv.lookup_dims(rows).drop("RequestedPerformerTypeId", "PrimaryPerformerName")


def cached_mart(spark: SparkSession, sf_dir: str, keep: int = 1, columns: Sequence[str] | None = None) -> DataFrame:
    """S5 over the star tables: the enriched mart of ``sf_dir``, memoised on its files.

    ``columns`` (the year label comes with them) makes an entry of these alone, of every row: only they cross the
    network and are written.  Where the whole mart of the same files is cached, they are read from it."""
    inputs = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in STAR_COLUMNS]
    if columns is not None:
        own = list(dict.fromkeys(["YearLabel", *sorted(columns)]))
        mark = hashlib.sha256(json.dumps(own).encode()).hexdigest()[:8]
        return cached(spark, f"mart-{mark}", inputs, lambda: E.enrich(csv.lookup_dims(mart.sales_mart(spark, sf_dir), droppable=True)).select(*own),
                      keep, part_of="mart")
    return cached(spark, "mart", inputs, lambda: _narrow_mart(spark, sf_dir), keep,
                  derive=lambda rows: E.enrich(mart.mart_columns(rows, *LOOKED_UP)))

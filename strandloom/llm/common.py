"""Shared plumbing: durable intermediate tables, shared files, skew-safe lookups, memory of workers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python; texts may be 100 kB each.
ARROW_ROWS = 256
#: Largest lookup table (in bytes, estimated from its row count) that is broadcast.
BROADCAST_BYTES = 64 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    ``spark.checkpoint.dir`` of the session wins.  Only a local session that
    names none gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared root; nothing is created yet."""
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage: a lost executor costs a reread of these files only.
    """
    spark = df.sparkSession
    path = new_folder(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows of an Arrow batch, so that a batch of long texts fits in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: What tasks leave in this worker process for those that follow, by operator and key: one value.
_kept: dict[tuple[str, str], object] = {}


def keep(owner: str, key: str, make: Callable[[], object]):
    """What ``make`` returns, kept in this process for later tasks of the operator ``owner``; the last value only."""
    if (owner, key) not in _kept:
        _kept.clear()
        _kept[owner, key] = make()
    return _kept[owner, key]


def forget_others(owner: str) -> None:
    """Let go of what another operator keeps in this process."""
    if any(name != owner for name, _ in _kept):
        _kept.clear()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on beside the stages that follow."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def lean(owner: str, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``: no task of ``owner`` has another operator's data beside its own, nor leaves freed memory."""
    def task(batches: Iterator) -> Iterator:
        forget_others(owner)
        yield from run(batches)
        give_back()
    return task


def with_lookup(df: DataFrame, table: DataFrame, key: str, rows: int, row_bytes: int,
                limit: int = BROADCAST_BYTES) -> DataFrame:
    """Left-join ``table`` (unique ``key``): broadcast if its counted size is in the bound, else shuffled.

    In the shuffled form adaptive execution splits partitions that a hot key of ``df`` makes large.
    """
    if rows * row_bytes <= limit:
        table = F.broadcast(table)
    return df.join(table, key, "left")


def heavy_lookup(df: DataFrame, groups: DataFrame, key: str, size: str, total: int,
                 share: int = 1000) -> DataFrame:
    """Inner-join ``groups`` (unique ``key``, member count ``size``) to their members without a hot task.

    A group with at least a ``1/share`` part of all ``total`` rows is heavy.  There can be at most
    ``share`` of them, which proves the bound of the broadcast; every other key is too small to
    burden one task, so that the rest is an ordinary shuffle join.
    """
    floor = max(1, total // share)
    heavy = groups.where((F.col(size) >= floor) & (F.col(size) > 64))
    light = groups.where(~((F.col(size) >= floor) & (F.col(size) > 64)))
    near = df.join(F.broadcast(heavy), key)
    far = df.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return near.unionByName(far)


def open_fs(uri: str):
    """(filesystem, path) of a URI or a plain path, on the driver or an executor."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def without_ids(docs: DataFrame, lost: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose id is in ``lost`` (column ``doc_id``); all columns stay, rows with a null id too."""
    table = materialize(lost.select(F.col("doc_id").alias("key"), F.lit(True).alias("lost")).where("key is not null").distinct(), "lost")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("key"))
    return with_lookup(packed, table, "key", table.count(), 24).where("lost is null").select("row.*")

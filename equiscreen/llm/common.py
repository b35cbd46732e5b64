"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of a few numbers a row that may be broadcast (up to about 100 bytes a row once it is hashed, so
#: 40 MB); larger ones take a shuffled join.
BROADCAST_ROWS = 400_000

#: Rows and bytes of a batch that a Python worker gets.
BATCH, BATCH_BYTES = 500, 4 << 20

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    A temporary one is made only where that is unset and all of Spark is one process; elsewhere it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own_dir[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(ids: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``ids`` with a broadcast hint if it has at most ``bound`` rows, else as it is (a shuffled join)."""
    return F.broadcast(ids) if ids.limit(bound + 1).count() <= bound else ids


def chosen_rows(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """(doc_id, text) of ``docs`` with one of ``ids`` (bounded: it is broadcast): equal rows once, and ``most`` rows at
    most, by a hash of id and text, however many rows have an id."""
    key = F.xxhash64("doc_id", "text")
    found = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi").withColumn("key", key)
    keys = found.select("key").distinct().orderBy("key").limit(most)
    return found.join(F.broadcast(keys), "key").groupBy("key").agg(F.first(F.struct("doc_id", "text")).alias("row")).select("row.*")


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel to Python workers in batches of ``BATCH`` rows and about ``BATCH_BYTES`` bytes where the session
    has Spark's own settings: a batch is held several times over, by the JVM and by the worker."""
    for name, most, usual in (("maxRecordsPerBatch", BATCH, 10_000), ("maxBytesPerBatch", BATCH_BYTES, 64 << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        if int(spark.conf.get(name).rstrip("b")) == usual:
            spark.conf.set(name, str(most))


def give_back() -> None:
    """Gives unused memory of a Python worker back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map over batches that gives its memory back to the system at its end: Python workers are used again, and what
    each task has held at most would stay with them."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


#: Arrow's types of the columns that maps give.
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}


def batch_of(rows: list[tuple], ddl: str, /, **kinds: pa.DataType) -> pa.RecordBatch:
    """``rows`` as a batch of the columns that ``ddl`` names; ``kinds``: the types of columns that ``ARROW`` does not have."""
    fields = [f.split(" ", 1) for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n) or ARROW[k]) for c, (n, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

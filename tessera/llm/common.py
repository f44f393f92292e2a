"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What parts words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset (tests, one machine) a folder of our own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    own = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return shared_dir(spark)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders of the tables that written() made inside temporary(), the innermost one's.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, and is computed once."""
    path = shared_path(df.sparkSession, name)
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that written() makes inside are deleted at the end, and shuffle files that nothing refers to go with them.

    Yields a written() for what is to stay: nothing else that reads tables made inside may be read afterwards.
    """
    outer, own = _MADE.get(), []
    token = _MADE.set(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _MADE.set(outer)
        try:
            return written(df, name)
        finally:
            _MADE.reset(inner)

    try:
        yield keep
    finally:
        _MADE.reset(token)
        for path in own:
            _delete(spark, path)
        freed(spark)


def freed(spark: SparkSession) -> None:
    """Shuffle files of what has run go once the driver's JVM collects its garbage, which it seldom does by itself."""
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that written() made, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def tidy() -> None:
    """Gives memory that a finished task has freed back to the machine: Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with tidy() at the end of each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return task


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices of that many rows, so that only few of a batch's texts are Python objects at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Words of a text, native: runs of characters other than the six blanks; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RE))


def text_key(text: Column | str, a: str = "t1", b: str = "t2") -> list[Column]:
    """Two 64-bit hashes of a text with different seeds, which stand for it in keys: 128 bits in all."""
    return [F.xxhash64(text).alias(a), F.xxhash64(F.lit(42), F.col(text) if isinstance(text, str) else text).alias(b)]


#: Bits of the filter that parted() broadcasts: half a megabyte, whatever the input. A bound on memory, never on the result.
FILTER_BITS = 1 << 22
#: Bits of one row of it: what bitmap_construct_agg makes.
BITMAP_BITS = 1 << 15


def parted(df: DataFrame, key: Column, keys: DataFrame, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """df in two: rows whose key is surely not in keys, and the rest, most of which have theirs there; for exact joins that shuffle the rest's texts alone.

    key: 64-bit hashes, as keys' only column holds them. A bitmap of hashes modulo bits is broadcast; the more keys, the
    more rows without one are in the rest, up to all of them. Rows with a null key are sure.
    """

    def place(c: Column) -> tuple[Column, Column]:
        bit = F.pmod(c, F.lit(bits).cast("long"))
        return F.floor(bit / BITMAP_BITS).cast("long"), F.pmod(bit, F.lit(BITMAP_BITS).cast("long"))

    m, b = (fresh(n, df.columns) for n in ("_map", "_bucket"))
    bucket, bit = place(F.col(keys.columns[0]))
    maps = keys.where(bit.isNotNull()).select(bucket.alias(b), bit.alias("bit")).groupBy(b).agg(F.bitmap_construct_agg("bit").alias(m))
    bucket, bit = place(key)
    byte = F.conv(F.hex(F.substring(m, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))
    tried = df.join(F.broadcast(maps), bucket == maps[b], "left")
    return tried.where(~there).select(*[df[c] for c in df.columns]), tried.where(there).select(*[df[c] for c in df.columns])


def fresh(name: str, taken: Sequence[str]) -> str:
    """name, or name with underscores before it, so that no column of the caller's is hidden."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)

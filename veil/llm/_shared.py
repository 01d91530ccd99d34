"""The folder that driver and executors share, and how tables pass through it."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the table by which ``likely_in`` tells rows apart: 2 MB as words, at any size of the input.
FILTER_BITS = 1 << 23


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset, below the local temporary folder if one machine does all, as in tests; on a cluster, an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/veil-shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def through_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a written table: later readers see one result, and lost executors cost no recomputation."""
    return Scratch(spark, name).table(df, name)


class Scratch:
    """A folder of written tables that an operator drops one by one when it's done with them."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.count = spark, shared_dir(spark, name), 0
        self.paths: dict[int, tuple[str, DataFrame]] = {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path, self.count = f"{self.root}/{self.count}-{name}", self.count + 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sparkContext().hadoopConfiguration()
        for df in tables:
            place = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df))[0])
            place.getFileSystem(conf).delete(place, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI or plain path, and the path on it."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def bounded_batches(spark: SparkSession, rows: int = 10_000, size: int = 4 << 20) -> None:
    """Arrow batches of at most so many rows and bytes (or one row), so that long texts keep Python workers small.

    The settings stay in the session, as the plans that need them run after the operator has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def tidy() -> None:
    """Gives what a task's arrays have freed back to the system, so that a worker that stays is small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_kept: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What a worker keeps between tasks of one operator; another operator's first task drops it.

    Every function that runs in workers asks for it first, so a worker holds the tables of one operator at most.
    """
    if operator not in _kept:
        _kept.clear()
        tidy()
        _kept[operator] = {}
    return _kept[operator]


def row_name(key: Column, text: Column) -> Column:
    """128 bits that tell rows of differing key or text apart; null and empty texts are equal, null keys are a key of their own."""
    named = F.when(key.isNull(), F.lit("-")).otherwise(F.concat(F.length(key.cast("string")).cast("string"), F.lit("+"), key.cast("string")))
    return F.unhex(F.md5(F.concat(named, F.coalesce(text, F.lit(""))).cast("binary")))


def by_likely(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among the wanted keys, and those whose key surely isn't, by a broadcast bit table of fixed size.

    A join after it moves few rows in vain while the wanted keys are fewer than the bits; beyond that all rows may be wanted, and it costs no more.
    """
    spot = F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS))
    bits = wanted.select(spot.alias("spot")).groupBy(F.floor(F.col("spot") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits"))
    found = rows.withColumn("spot", spot).withColumn("word", F.floor(F.col("spot") / 64)).join(F.broadcast(bits), "word", "left")
    found = found.withColumn("may", F.expr("coalesce(shiftright(bits, cast(spot % 64 as int)) % 2 <> 0, false)"))
    return found.where("may").select(*rows.columns), found.where("not may").select(*rows.columns)


def partitions_of(df: DataFrame) -> int:
    """How many partitions the scan of df has: a measure of its size that grows with it."""
    return max(1, df.rdd.getNumPartitions())


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps whose results are written."""
    gc.collect()
    spark._jvm.System.gc()

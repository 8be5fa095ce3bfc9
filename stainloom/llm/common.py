"""What the operators share: tables, words, checkpoints and joins with hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a character class of regular expressions.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named and all run in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    at = at or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def swept(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of tables that nothing names any more.

    It does so when the driver's garbage is collected, which a driver with little to do puts off
    while the disks of the executors fill.
    """
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder; for small tables that are read again."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    swept(df.sparkSession)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """As cut(), but as compressed Parquet, for larger tables; the files stay until the folder goes."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    swept(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def lean(run):
    """A function of batches that gives free memory back to the system at its end.

    Python workers stay for later stages, and what they hold counts beside those.
    """

    def lean_run(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)

    return lean_run


def text_of(col: str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """All words of a text, in order."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+", -1))


def join_counted(left: DataFrame, groups: DataFrame, key: str, size: str, hot: int) -> DataFrame:
    """Inner join of many rows with one row of each group, whatever share of the rows a group has.

    ``groups`` has one row of each key and the number of its rows in ``size``. Groups of at least
    ``hot`` rows are joined by broadcast: with hot = rows / 1000 there are 1,000 at most, whatever
    the input is. No other group is larger than ``hot``, so the shuffle of the rest is even.
    """
    large = groups.filter(F.col(size) >= hot)
    small = groups.filter(F.col(size) < hot)
    keys = F.broadcast(large.select(key))
    return left.join(F.broadcast(large), key).unionByName(left.join(keys, key, "left_anti").join(small, key))


PROBES = 5


def _bloom_mask(key: Column) -> Column:
    h, bits = F.xxhash64(F.lit("bits"), key), F.lit(0).cast("long")
    for k in range(PROBES):
        at = F.pmod(F.shiftrightunsigned(h, 12 * k), F.lit(64)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return bits


def maybe_in(rows: DataFrame, key: Column, listed: DataFrame, listed_key: Column, n: int, name: str, max_bits: int = 20) -> DataFrame:
    """rows with a column ``name``: false only where the key is surely not among the n listed ones.

    A blocked Bloom filter, a 64-bit word a block: a table of 2**max_bits rows at most (16 MB),
    whatever is listed, and so sent to every executor. With more than some ten million keys it
    passes more rows, and none less.
    """
    blocks = 1 << min(max_bits, max(6, int(n).bit_length() - 2))
    block = lambda c: F.pmod(F.xxhash64(F.lit("block"), c), F.lit(blocks))
    bloom = listed.groupBy(block(listed_key).alias("_block")).agg(F.bit_or(_bloom_mask(listed_key)).alias("_mask"))
    asked = rows.withColumn("_block", block(key)).join(F.broadcast(bloom), "_block", "left")
    hit = key.isNotNull() & (F.col("_mask").bitwiseAND(_bloom_mask(key)) == _bloom_mask(key))
    return asked.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_block", "_mask")


def without(rows: DataFrame, key: Column, gone: DataFrame, n: int) -> DataFrame:
    """rows but those whose key is among the n of ``gone``, a column ``key`` of different values.

    Only rows that a Bloom filter can't clear are shuffled; a null key stays.
    """
    names = rows.columns
    asked = maybe_in(rows.withColumn("_key", key), F.col("_key"), gone, F.col("key"), n, "_may")
    some = asked.filter("_may")
    return asked.filter("not _may").select(names).unionByName(some.join(gone, F.col("_key") == F.col("key"), "left_anti").select(names))

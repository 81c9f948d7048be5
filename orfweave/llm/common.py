"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a regular expression class.
BLANK = r"\x20\x09-\x0D"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row (a lambda variable is bound to the computed value)."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; a null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+")
    return F.filter(parts, lambda w: w != "")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share.

    Where the setting is absent on a single machine (a local master, as in tests), a temporary folder is set as checkpoint
    folder of the session first; on a cluster that is an error, as executors share no folder of one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="orfweave_")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}_{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what `stored` wrote, once nothing reads it any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than one row in SHARE is hot: there are fewer than SHARE such keys, whatever the data.
SHARE, SALTS = 1000, 64


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> list[int]:
    """The hot keys (64-bit numbers) of counts (key, n): fewer than SHARE values reach the driver."""
    total = counts.agg(F.sum(n)).collect()[0][0] or 0
    least = max(total // SHARE, 1000)
    return [r[0] for r in counts.where(F.col(n) > least).select(key).collect()]


def salted_join(left: DataFrame, right: DataFrame, on: list[str], hot: list[int], spread: Column, how: str = "inner") -> DataFrame:
    """left joined with right (one row per key, or few) on `on`, whose first column is a 64-bit number.

    Rows of left whose first key is hot are dealt over SALTS parts by the hash of spread; the few rows of right that they
    meet are repeated for each part. No key's rows meet in one task.
    """
    if not hot:
        return left.join(right, on, how)
    some = F.col(on[0]).isin(hot)
    left = left.withColumn("__salt", F.when(some, F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    right = right.withColumn("__salt", F.explode(F.when(some, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return to the system what Arrow's pool and malloc hold without using it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def tidy(made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """made, after which memory is given back. Spark keeps a task's Python worker, idle or not, and two for each core where a
    task runs two functions; what they hold adds up beside the executor's heap."""

    @functools.wraps(made)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from made(batches)
        finally:
            give_back()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_codes(seed: int) -> np.ndarray:
    """256 fixed 64-bit numbers, one for each byte value."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

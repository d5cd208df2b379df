"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

_U = np.uint64
MIX1, MIX2, BASE = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own if driver
    and executors are one process; on a cluster there is no folder to fall back on."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = getattr(shared_dir, "own", None)
        if d is None:
            d = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="framewright-")
    return d.rstrip("/")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut of lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table written by stash() once nothing reads it any more."""
    path = getattr(df, "_stash_path", None)
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many strokes behind it as make it differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts_for(spark: SparkSession, items: int, each: int) -> int:
    """Parts of a shuffle so that none holds much more than `each` of `items`, and no fewer than the session's own."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items // each))


def as_bytes(col) -> list:
    """An Arrow string column as Python bytes (None for null)."""
    return col.cast(pa.large_binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * MIX1
    x ^= x >> _U(27)
    x *= MIX2
    x ^= x >> _U(31)
    return x


class WordIds(dict):
    """word bytes -> 64-bit hash, remembered for a bounded number of words."""

    LIMIT = 200_000

    def __missing__(self, word):
        if len(self) >= self.LIMIT:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One table for all operators of a Python worker.
WORDS = WordIds()


def tidy(keep: str) -> None:
    """Gives back what the operators of a worker remember, but for the tables named by keep."""
    WORDS.clear()
    for module, name in (("bpe_count", "counter_for"), ("packing", "encoder_for")):
        if keep != "bpe" and (m := sys.modules.get(f"{__package__}.{module}")) and getattr(m, name).cache_info().currsize:
            getattr(m, name).cache_clear()
            gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(generator, keep: str = ""):
    """The generator, after which the worker gives back memory. Workers serve many stages, so tables that one operator
    remembers would add up to those of the next."""

    def run(batches):
        try:
            yield from generator(batches)
        finally:
            tidy(keep)  # by name, so that it meets the worker's own tables

    return run


class PrefixHash:
    """Polynomial hashes of any range of a uint64 sequence, modulo 2**64, with a final mix over hash and length."""

    _pow: np.ndarray = np.ones(1, np.uint64)
    _inv: np.ndarray = np.ones(1, np.uint64)
    B = 0x9E3779B97F4A7C15 | 5
    BI = pow(0x9E3779B97F4A7C15 | 5, -1, 1 << 64)

    @classmethod
    def powers(cls, n: int) -> None:
        if len(cls._pow) < n:
            m = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                for name, b in (("_pow", cls.B), ("_inv", cls.BI)):
                    a = np.full(m, _U(b))
                    a[0] = 1
                    setattr(cls, name, np.multiply.accumulate(a))

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.powers(n + 1)
        self.p = np.zeros(n + 1, np.uint64)
        np.cumsum(ids * self._pow[:n], out=self.p[1:])

    def range(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        h = (self.p[hi] - self.p[lo]) * self._inv[lo]
        return mix(h ^ (mix((hi - lo).astype(np.uint64) + BASE)))


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most about `limit` rows, chosen by a hash of `key` (the same rows on every run)."""
    from pyspark.sql import functions as F

    n = df.count()
    if n <= limit:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * limit / n))

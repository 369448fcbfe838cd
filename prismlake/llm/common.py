"""What the operators share: the shared folder, written tables, small helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

_BATCH_SETTING, _BATCH_DEFAULT, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"
_SETTING = "spark.checkpoint.dir"
_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset,
    as in tests on one machine, is a temporary folder made. On several machines
    that would be no shared one, so the setting is needed there.
    """
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="prismlake-"))
    return "file://" + _own_folder[0]


#: What operators keep in a Python worker between tasks.
worker_caches: list[dict] = []
_in_worker: list[str] = []


def enter(operator: str) -> None:
    """Called by a worker's function: a worker is used again by other operators, and what those have kept there goes."""
    if _in_worker != [operator]:
        if _in_worker:
            for cache in worker_caches:
                cache.clear()
            gc.collect()
        _in_worker[:] = [operator]


def release() -> None:
    """Give freed memory back to the system: an idle worker stays for a minute beside whatever runs next."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def in_worker(operator: str):
    """Marks a generator that runs in a Python worker for an operator."""

    def wrap(f):
        @wraps(f)
        def run(*args, **kw):
            enter(operator)
            try:
                yield from f(*args, **kw)
            finally:
                release()

        return run

    return wrap


class Scratch:
    """Tables that one operator call writes to the shared folder.

    A written table cuts lineage and outlives executors. The folder goes when
    the Python process ends, because lazily evaluated results read from it;
    tables that are no longer read can be dropped before.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the JVM may have ended before this process
            pass

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """Write df as Parquet, compressed as the session says if nothing is named, and return the written table."""
        df.write.mode("overwrite").parquet(self.path(name), compression=compression)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._remove(self.path(name))


def prepare(spark: SparkSession) -> SparkSession:
    """The package on workers, and batches of whole texts that a small worker can hold; a setting of the user's own stays."""
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, _BATCH_BYTES)
    return ship_package(spark)


def text_of(column: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def exact_id(column: str) -> Column:
    """The id as a string of decimals, for Python: beside a null, pandas would make all ids of a batch floats."""
    return F.col(column).cast("long").cast("string")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, size: int, *by: str) -> DataFrame:
    """At most size rows, those with the least hashes of some columns.

    A share of the hashes that holds about half more rows than needed is taken
    first, so the task that orders them doesn't get size rows of every partition.
    """
    total, span = df.count(), 1 << 40
    rank = F.pmod(F.xxhash64(*by), F.lit(span))
    if total > 2 * size:
        df = df.where(rank < int(span * (1.5 * size + 100) / total))
    return df.orderBy(rank, *by).limit(size)


def most_frequent(counts: DataFrame, limit: int) -> list[tuple[str, int]]:
    """The words with the largest n, ties by word, from a written table (word, n).

    A histogram of n by steps of a logarithm, of a few hundred rows, shows from
    which step on there are enough words; only those are sorted, so no task and
    no driver gets the most frequent words of every partition.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, 0
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total, least = total + row["count"], row["step"]
        if total >= limit:
            break
    else:
        least = None
    chosen = counts if least is None else counts.where(step >= least)
    return [(r["word"], r["n"]) for r in chosen.orderBy(F.desc("n"), "word").limit(limit).collect()]

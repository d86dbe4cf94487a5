"""Session helpers: a sensible local session, and cutting lineage safely."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablemend")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The reliable folder the cluster names; a scratch one only where none is set (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="tablemend-")
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession) -> str:
    """A fresh path under the shared folder, grouped by application so that it can be cleared with it."""
    return f"{shared_dir(spark).rstrip('/')}/tablemend/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that :func:`cut_lineage` wrote within.  For jobs that write their result
    within, so that nothing reads those tables afterwards; after an error they stay, for a look at them."""
    _scopes.append([])
    try:
        yield
    except BaseException:
        _scopes.pop()
        raise
    for path in _scopes.pop():
        drop_table(spark, path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table that was written under the shared folder, in whatever store that is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table's write to ``path`` was committed; a folder alone may be what a lost attempt left."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


class Versions:
    """Tables of a loop's state, each version written in full before the one it replaces is dropped, so that neither
    lineage nor disk grows with the number of rounds."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[str, str] = {}

    def commit(self, **tables: DataFrame) -> dict[str, DataFrame]:
        """The new versions, read back.  Other names keep theirs."""
        new = {name: scratch_path(self.spark) for name in tables}
        for name, df in tables.items():
            df.write.parquet(new[name])
        old = [self._paths[name] for name in tables if name in self._paths]
        self._paths |= new
        for path in old:
            drop_table(self.spark, path)
        return {name: self.spark.read.schema(df.schema).parquet(new[name]) for name, df in tables.items()}

    def drop(self, name: str) -> None:
        """Drops a table that nothing reads any more."""
        drop_table(self.spark, self._paths.pop(name))


RELEASE_EVERY = 10.0  # seconds
_released = time.monotonic()


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files and broadcasts of finished steps.  Spark keeps them until the driver happens to collect
    the plans that made them, so that a job of many steps would hold those of all of them at once."""
    global _released
    if time.monotonic() - _released >= RELEASE_EVERY:
        gc.collect()
        spark._jvm.System.gc()
        _released = time.monotonic()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages neither
    recompute it nor depend on executors that may be gone."""
    spark = df.sparkSession
    path = scratch_path(spark)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 32 << 20) -> bool:
    """Whether ``df`` is measured to have at most that many rows and bytes of values; it is never read past ``max_rows``."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    found = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(size, F.lit(0)).alias("bytes")).first()
    return found["rows"] <= max_rows and found["bytes"] <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only after measuring, and never reading past ``max_rows``.
    Above it, or above ``max_bytes`` of values, the frame is returned as it is and joins by shuffle.

    Call it on frames already written (``cut_lineage``) or cheap to read.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def merge_if_large(df: DataFrame, max_rows: int = 250_000, max_bytes: int = 32 << 20) -> DataFrame:
    """``df`` as it is where it is measured to be small, else told to be joined by merge.

    Spark takes the compressed bytes of a table's files for the bytes of its rows.  A written table of few and short
    values holds millions of rows in a few MB, and would be broadcast through the driver's memory.  Call it as
    :func:`broadcast_if_small`.
    """
    return df if is_small(df, max_rows, max_bytes) else df.hint("merge")

"""Reading the input tables and keeping intermediate ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data set in ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (tests on a local master) a temporary folder is made and set as
    the checkpoint folder; on a cluster its absence is an error, since a machine's own folder
    is not visible to the other machines.
    """
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if set_dir:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(set_dir)
        return set_dir.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="cairn-checkpoints-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path for ``name`` in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Whether Spark removes a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends here.

    What was shuffled for it isn't needed again and is removed at once, not when the driver happens to
    collect its garbage.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if (held := _SCRATCH.get()) is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables that :func:`stored` has written within the open :func:`scratch`, of this thread.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes stored tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a :func:`stored` for results; all other tables stored meanwhile go when the block is left.

    For work whose results are stored before it ends: a query that is still to be run needs its tables. Results of a block within
    another one are tables of the outer one.
    """
    outer, held = _SCRATCH.get(), []
    token = _SCRATCH.set(held)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        path = held.pop()
        if outer is not None:
            outer.append(path)
        return out

    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        remove(spark, held)

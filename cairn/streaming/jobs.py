"""Streaming jobs over the event table, each run to the end of its input."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.sources.tables import shared_path


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files at ``path``, a folder or a single file, with their schema."""
    either = f"{path[:-1]}[{path[-1]}]"  # a pattern may stand for a file too
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 16).parquet(either)


def run(df: DataFrame, name: str, mode: str = "append", batch: Callable[[DataFrame, int], None] | None = None) -> str:
    """Runs ``df`` until its input is used up; rows go to a Parquet folder, whose path is returned.

    Without ``batch`` the file sink keeps each row exactly once. With it the function gets each batch
    and its number, so that it can write to a folder of that number and overwrite what a first try left.
    """
    spark = df.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    writer = writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", out)
    writer.start().awaitTermination()
    return out


def upserted(df: DataFrame, name: str, mode: str, key: list[str], version: str) -> DataFrame:
    """The last row per key over all batches of ``df``."""
    spark = df.sparkSession
    out = shared_path(spark, name)
    run(df, name, mode, lambda b, n: b.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/_n={n}"))
    rows = spark.read.parquet(out).drop("_n")
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct("_batch", version)).alias("x"))
    return last.select(*key, "x.*").drop("_batch")


def moving_average(events: DataFrame) -> DataFrame:
    """``peer, ema, n`` per batch: an integer moving average per peer, kept as state; its order is time within a batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema, n = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        for v in rows["latency"]:
            v = int(v)
            ema = v if n == 0 else (9 * ema + v) // 10
            n += 1
        state.update((ema, n))
        yield pd.DataFrame({"peer": [key[0]], "ema": [ema], "n": [n]})

    return events.groupBy("peer").applyInPandasWithState(step, "peer long, ema long, n long", "ema long, n long", "update", GroupStateTimeout.NoTimeout)


def limited(events: DataFrame, span_us: int, most: int) -> DataFrame:
    """``event_id, peer, allowed``: a sliding-window limiter whose state is the times within the window.

    A peer that stays idle for a window, by the watermark of ``ts``, is forgotten. Events come in order of time from batch to batch;
    one that is more than an hour late has no answer.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        out = []
        for event, us in zip(rows["event_id"], rows["us"], strict=True):
            held.append(int(us))
            while held[0] + span_us <= us:
                held.popleft()
            out.append((int(event), key[0], len(held) <= most))
        state.update((list(held),))
        state.setTimeoutTimestamp(max((held[-1] + span_us) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "peer", "allowed"])

    timed = events.withWatermark("ts", "1 hour")
    return timed.groupBy("peer").applyInPandasWithState(step, "event_id long, peer long, allowed boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def replayed(df: DataFrame, order: str, files: int, name: str) -> DataFrame:
    """``df`` as a stream of ``files`` batches in the order of the integer column ``order``."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    bounds = df.agg(F.min(order), F.max(order)).first()
    low, high = bounds if bounds[0] is not None else (0, 0)
    for n in range(files):
        part = F.least(F.floor((F.col(order) - low) * files / (high - low + 1)), F.lit(files - 1)) == n
        df.where(part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def kept_up(ops: DataFrame, name: str, first: DataFrame, advance: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[str, int]:
    """A table that each batch of a stream turns into the next one: ``advance(table, batch)``; the path of all versions and the last one's number.

    A batch that is tried again reads the version before its own and overwrites what its first try left.
    """
    spark = ops.sparkSession
    out = shared_path(spark, name)
    first.write.parquet(f"{out}/_n=-1")
    last = [-1]

    def batch(rows: DataFrame, n: int) -> None:
        before = spark.read.schema(first.schema).parquet(f"{out}/_n={n - 1}")
        advance(before, rows).write.mode("overwrite").parquet(f"{out}/_n={n}")
        last[0] = n

    run(ops, name, "append", batch)
    return out, last[0]

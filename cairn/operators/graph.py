"""Chains and trees of blocks given as ``(id, parent)`` rows with integer ids.

Nodes are walked within cells of neighbouring ids first, each cell in one task, so that only the tops, the
nodes whose parent lies in another cell, are left to be joined: for a chain a row or two per cell.
Joins of nodes are merge joins by hint: stored ids are a byte a row or less, so that Spark would broadcast millions of them.
Pointer doubling takes the tops to their roots in a logarithmic number of rounds, and more rounds than
any forest can need mean that the parents form a cycle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.sources.tables import stored

#: Bits of an id within a cell.
CELL = 16
_CYCLE = "the parents form a cycle"


def _within(ids: np.ndarray, parents: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For nodes sorted by id: the place of each one's parent (or its own), and its top, depth and sum below the top."""
    at = np.minimum(np.searchsorted(ids, parents), len(ids) - 1)
    inside = ids[at] == parents
    first = np.where(inside, at, np.arange(len(ids)))
    up, depth, total = first, inside.astype(np.int64), np.where(inside, sums, 0)
    for _ in range(len(ids).bit_length() + 1):
        if (first[up] == up).all():
            return first, up, depth, total
        depth, total, up = depth + depth[up], total + total[up], up[up]
    raise ValueError(_CYCLE)


def _sorted(t: pa.Table, names: list[str]) -> list[np.ndarray]:
    order = np.argsort(t.column("id").to_numpy(), kind="stable")
    return [t.column(n).fill_null(np.iinfo(np.int64).min).to_numpy()[order] for n in names]


def _tops(nodes: DataFrame) -> DataFrame:
    """``id, top, exit, depth, sum, own`` of nodes (id, parent, own): the top of its cell, that one's parent, and the way there."""

    def walk(t: pa.Table) -> pa.Table:
        ids, parents, own = _sorted(t, ["id", "parent", "own"])
        _, up, depth, total = _within(ids, parents, own)
        return pa.table({"id": ids, "top": ids[up], "exit": parents[up], "depth": depth, "sum": total, "own": own})

    celled = nodes.select(F.expr(f"shiftright(id, {CELL})").alias("cell"), "id", "parent", "own")
    return celled.groupBy("cell").applyInArrow(walk, "id long, top long, exit long, depth long, sum long, own long")


def _linked(local: DataFrame) -> DataFrame:
    """``id, up, exit, depth, sum`` of the tops: the top above (null: none), the node entered there, and the way up to it."""
    tops = local.where("id = top").select("id", "exit", "own")
    entered = local.select(F.col("id").alias("exit"), F.col("top").alias("up"), F.col("depth").alias("d"), F.col("sum").alias("s"))
    joined = tops.join(entered.hint("merge"), "exit", "left")
    return joined.select("id", "up", F.when(F.col("up").isNotNull(), F.col("exit")).alias("exit"), F.coalesce(F.col("d") + 1, F.lit(0)).alias("depth"), F.when(F.col("up").isNotNull(), F.col("own") + F.col("s")).otherwise(0).alias("sum"))


def _rounds(tops: DataFrame) -> int:
    """As many doublings as it takes to pass all of them, and one to see that nothing is left."""
    return tops.count().bit_length() + 1


def celled(nodes: DataFrame, value: Column | None = None) -> DataFrame:
    """Nodes (id, parent) walked within their cells, stored: what :func:`ancestors` and :func:`on_path` can share."""
    weight = F.lit(1) if value is None else value
    return stored(_tops(nodes.select("id", "parent", weight.cast("long").alias("own"))), "tops")


def ancestors(nodes: DataFrame, value: Column | None = None, name: str = "total", local: DataFrame | None = None) -> DataFrame:
    """``id, root, depth`` (and the sum of ``value`` down from the root) for every node of a forest; ``local`` if it was walked before."""
    local = celled(nodes, value) if local is None else local
    linked = _linked(local).select("id", F.coalesce("up", "id").alias("root"), "depth", "sum", F.col("up").isNull().alias("done"))
    open_ = stored(linked, "pointers")
    finished = open_.where("done")
    for _ in range(_rounds(open_)):
        if not open_.where("not done").limit(1).count():
            break
        to = open_.select(F.col("id").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("d2"), F.col("sum").alias("s2"), F.col("done").alias("done2"))
        ready = finished.select(F.col("id").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("d2"), F.col("sum").alias("s2"), F.lit(True).alias("done2"))
        to = to.where("not done2").unionByName(ready)
        moved = open_.where("not done").join(to.hint("merge"), "root").select("id", F.col("root2").alias("root"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("sum") + F.col("s2")).alias("sum"), F.col("done2").alias("done"))
        open_ = stored(moved, "pointers")
        finished = finished.unionByName(open_.where("done"))
    else:
        raise ValueError(_CYCLE)
    own = local.where("id = top").select(F.col("id").alias("root"), F.col("own").alias("root_own"))
    tops = finished.select(F.col("id").alias("top"), "root", F.col("depth").alias("d"), F.col("sum").alias("s")).join(own.hint("merge"), "root")
    return local.join(tops.hint("merge"), "top").select("id", "root", (F.col("depth") + F.col("d")).alias("depth"), (F.col("sum") + F.col("s") + F.col("root_own")).alias(name))


def _reached(linked: DataFrame, first: DataFrame) -> DataFrame:
    """``id`` of the tops from those in ``first`` on upwards, by jumps of 1, 2, 4 ... tops, the longest first."""
    jumps = [stored(linked.where("up is not null").select("id", "up"), "jumps")]
    for _ in range(_rounds(linked)):
        last = jumps[-1]
        nxt = stored(last.join(last.select(F.col("id").alias("up"), F.col("up").alias("up2")).hint("merge"), "up").select("id", F.col("up2").alias("up")), "jumps")
        if nxt.limit(1).count() == 0:
            break
        jumps.append(nxt)
    else:
        raise ValueError(_CYCLE)
    reached = first
    for jump in reversed(jumps):
        further = jump.join(reached.hint("merge"), "id", "left_semi").select(F.col("up").alias("id"))
        reached = stored(reached.unionAll(further).distinct(), "reached")
    return reached


def on_path(nodes: DataFrame, tips: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """``id`` of the nodes from ``tips`` (id) to their roots; ``local`` if the nodes were walked before."""
    local = celled(nodes) if local is None else local
    linked = stored(_linked(local), "linked")
    starts = local.join(tips.select("id").hint("merge"), "id", "left_semi")
    tops = _reached(linked, starts.select(F.col("top").alias("id")).distinct())
    # a cell is walked from the nodes at which a path comes into it
    entries = linked.join(tops.hint("merge"), "id", "left_semi").where("exit is not null").select(F.col("exit").alias("id")).unionAll(tips.select("id")).distinct()

    def walk(t: pa.Table) -> pa.Table:
        ids, parents, entered = _sorted(t, ["id", "parent", "entered"])
        first, _, _, _ = _within(ids, parents, np.zeros(len(ids), np.int64))
        on, step = entered == 1, first
        for _ in range(len(ids).bit_length() + 1):
            on = on.copy()
            on[step[on]] = True
            step = step[step]
        return pa.table({"id": ids[on]})

    marked = nodes.select("id", "parent").join(entries.withColumn("entered", F.lit(1).cast("long")).hint("merge"), "id", "left").select(F.expr(f"shiftright(id, {CELL})").alias("cell"), "id", "parent", F.coalesce("entered", F.lit(0).cast("long")).alias("entered"))
    return marked.groupBy("cell").applyInArrow(walk, "id long")


def walked(starts: DataFrame, follows: DataFrame, goes_on: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``starts`` (with ``id``) and all that follows each by ``follows`` (id, next), with the number of the ``step``.

    ``goes_on`` keeps the rows that have a next one. Rows reached so far are sent on by 1, 2, 4 ... steps at once. A row that
    shouldn't go on may still be reached from, so the walk is cut at the first such row at its end.
    """
    reached = stored(starts.withColumn("step", F.lit(0).cast("long")), "walk")
    jump, length = stored(follows.select("id", "next"), "jump"), 1
    others = [c for c in starts.columns if c != "id"]
    for _ in range(64):
        further = goes_on(reached).join(jump.hint("merge"), "id").select(*others, F.col("next").alias("id"), (F.col("step") + length).alias("step"))
        new = stored(further, "walk")
        if not new.limit(1).count():
            return reached
        reached = reached.unionByName(new)
        jump = stored(jump.join(jump.select(F.col("id").alias("next"), F.col("next").alias("n2")).hint("merge"), "next").select("id", F.col("n2").alias("next")), "jump")
        length *= 2
    raise ValueError(_CYCLE)

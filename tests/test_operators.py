"""Operators against models over sets of points, brute force and known cases."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import scalars
from cairn.operators import graph, intervals, merkle, ordered


def frame(spark, rows):
    return spark.createDataFrame([(k, s, e) for k, s, e in rows], "set_id string, start long, end long")


def points(rows):
    out = {}
    for k, s, e in rows:
        out.setdefault(k, set()).update(range(s + 1, e + 1))
    return out


def of(df):
    return [(r["set_id"], r["start"], r["end"]) for r in df.collect()]


def canonical(rows):
    by = {}
    for k, s, e in rows:
        by.setdefault(k, []).append((s, e))
    return all(a[1] < b[0] for v in by.values() for a, b in zip(sorted(v), sorted(v)[1:], strict=False))


@pytest.mark.parametrize("seed,cell", [(0, 20), (1, 2), (2, 4)])
def test_set_algebra(spark, monkeypatch, seed, cell):
    """In one cell, and over many cells and groups of them."""
    monkeypatch.setattr(intervals, "CELL", cell)
    monkeypatch.setattr(ordered, "GROUP", 1)
    rng = random.Random(seed)
    a, b = ([(rng.choice("xy"), s := rng.randrange(60), s + rng.randrange(1, 9)) for _ in range(14)] for _ in range(2))
    da, db, pa, pb = frame(spark, a), frame(spark, b), points(a), points(b)
    for got, want in (
        (of(intervals.merge(da)), pa),
        (of(intervals.union(da, db)), {k: pa.get(k, set()) | pb.get(k, set()) for k in "xy"}),
        (of(intervals.intersect(da, db)), {k: pa.get(k, set()) & pb.get(k, set()) for k in "xy"}),
        (of(intervals.subtract(da, db)), {k: pa.get(k, set()) - pb.get(k, set()) for k in "xy"}),
        (of(intervals.gaps_within(da, 5, 50)), {k: set(range(6, 51)) - pa[k] for k in pa}),
        (of(intervals.delete(intervals.merge(da), 11, 30)), {k: pa[k] - set(range(12, 31)) for k in pa}),
    ):
        assert canonical(got)
        assert points(got) == {k: v for k, v in want.items() if v}


def test_known_cases(spark):
    assert of(intervals.merge(frame(spark, [("a", 1, 2), ("a", 2, 3)]))) == [("a", 1, 3)]
    assert sorted(of(intervals.delete(frame(spark, [("a", 1, 2), ("a", 3, 6)]), 4, 5))) == [("a", 1, 2), ("a", 3, 4), ("a", 5, 6)]
    assert sorted(of(intervals.subtract(frame(spark, [("a", 0, 3)]), frame(spark, [("a", 1, 2)])))) == [("a", 0, 1), ("a", 2, 3)]
    big = 10**10
    shares = {r["bucket"]: r["share"] for r in intervals.shares(frame(spark, [("a", 0, 5), ("a", big, 2 * big)]), big).collect()}
    assert shares == {0: 5 / big, 1: 1.0}
    assert intervals.merge(frame(spark, [])).count() == 0


def test_joins_on_buckets(spark):
    rng = random.Random(4)
    a = [("a", s := rng.randrange(400), s + rng.randrange(1, 90)) for _ in range(30)]
    b = [("b", s := rng.randrange(400), s + rng.randrange(1, 90)) for _ in range(30)]
    got = sorted((r["start"], r["end"], r["b_start"], r["b_end"]) for r in intervals.overlap_join(frame(spark, a), frame(spark, b)).collect())
    assert got == sorted((s, e, t, f) for _, s, e in a for _, t, f in b if s < f and t < e)
    asked = spark.createDataFrame([(p,) for p in range(1, 500)], "p long")
    held = sorted((r["p"], r["b_start"], r["b_end"]) for r in intervals.containing(asked, "p", frame(spark, b)).collect())
    assert held == sorted((p, t, f) for p in range(1, 500) for _, t, f in b if t < p <= f)
    far = 10**15
    wide = frame(spark, [("w", 5, far), ("w", far - 1, far + 3), ("w", 7, 8)])
    assert sorted((r["start"], r["b_start"]) for r in intervals.overlap_join(wide, wide).collect()) == sorted([(5, 5), (5, 7), (5, far - 1), (7, 5), (7, 7), (far - 1, 5), (far - 1, far - 1)])
    near = spark.createDataFrame([(far,), (8,), (far + 4,)], "p long")
    assert sorted((r["p"], r["b_start"]) for r in intervals.containing(near, "p", wide).collect()) == [(8, 5), (8, 7), (far, 5), (far, far - 1)]


def test_orders(spark, monkeypatch):
    monkeypatch.setattr(ordered, "GROUP", 2)
    rng = random.Random(5)
    rows = [(i, rng.randrange(50)) for i in range(500)]
    df = spark.createDataFrame(rows, "h long, v long")
    run = {r["h"]: r["s"] for r in ordered.running(df, ["h"], {"s": ("sum", F.col("v"))}, cell=5).collect()}
    assert run == {i: sum(v for _, v in rows[: i + 1]) for i in range(500)}
    last = {r["h"]: r["s"] for r in ordered.trailing(df, "h", 70, {"s": F.sum("v")}, 32).collect()}
    assert last == {i: sum(v for _, v in rows[max(0, i - 69) : i + 1]) for i in range(500)}
    keys = sorted(rng.sample(range(2000), 40))
    table = spark.createDataFrame([(k, k * 2) for k in keys], "k long, w long")
    asked = spark.createDataFrame([(p,) for p in range(0, 2100, 7)], "p long")
    ahead = {r["p"]: (r["k"], r["w"]) for r in ordered.as_of(asked, "p", table, "k", ["w"], True, 6).collect()}
    back = {r["p"]: r["k"] for r in ordered.as_of(asked, "p", table, "k", [], False, 6).collect()}
    for p in range(0, 2100, 7):
        nxt, prev = [k for k in keys if k >= p], [k for k in keys if k <= p]
        assert ahead[p] == ((nxt[0], nxt[0] * 2) if nxt else (None, None))
        assert back[p] == (prev[-1] if prev else None)


@pytest.mark.parametrize("cell", [2, 4, 12])
def test_chains(spark, monkeypatch, cell):
    monkeypatch.setattr(graph, "CELL", cell)
    rng = random.Random(6)
    parent = {0: -1} | {i: rng.randrange(max(0, i - 4), i) for i in range(1, 60)}
    nodes = spark.createDataFrame([(i, p) for i, p in parent.items()], "id long, parent long")
    depth = {r["id"]: (r["root"], r["depth"]) for r in graph.ancestors(nodes).collect()}

    def path(i):
        return [i] + (path(parent[i]) if parent[i] >= 0 else [])

    assert depth == {i: (0, len(path(i)) - 1) for i in parent}
    got = {r["id"] for r in graph.on_path(nodes, spark.createDataFrame([(59,)], "id long")).collect()}
    assert got == set(path(59))
    two = {r["id"] for r in graph.on_path(nodes, spark.createDataFrame([(59,), (31,)], "id long")).collect()}
    assert two == set(path(59)) | set(path(31))
    weighed = {r["id"]: r["total"] for r in graph.ancestors(nodes, F.col("id") + 1).collect()}
    assert weighed == {i: sum(j + 1 for j in path(i)) for i in parent}
    for far in (1, 40):
        cycle = spark.createDataFrame([(1, far + 1), (far + 1, 1)], "id long, parent long")
        with pytest.raises(Exception, match="cycle"):
            graph.ancestors(cycle).count()


def test_merkle(spark):
    def node(*parts):
        return hashlib.sha256(b"".join(hashlib.sha256(p).digest() for p in parts)).digest()

    note = lambda n: n.to_bytes(32, "big")
    rows = [(k, i, f"{k}-{i}" * 3) for k, n in (("a", 1), ("b", 5), ("c", 8)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, d string").withColumn("n", F.length("d").cast("long"))
    got = {r["k"]: r["root"] for r in merkle.roots(df, "k", "i", "d", "n").collect()}
    for k in "abc":
        end, layer = 0, []
        for _, _, d in [r for r in rows if r[0] == k]:
            end += len(d)
            layer.append((node(d.encode(), note(end)), end))
        while len(layer) > 1:
            layer = [(node(x[0][0], x[1][0], note(x[0][1])), x[1][1]) if len(x) == 2 else x[0] for x in (layer[i : i + 2] for i in range(0, len(layer), 2))]
        assert got[k] == layer[0][0].hex()
    every = merkle.layers(df, "k", "i", "d", "n")
    leaves = {(r["k"], r["place"]): (bytes(r["h"])) for r in every.where("level = 0").collect()}
    steps = {}
    for r in sorted(merkle.paths(every, "k").collect(), key=lambda r: r["level"]):
        steps.setdefault((r["k"], r["leaf"]), []).append((bytes(r["sibling"]), r["left"], r["end"]))
    for (k, i), h in leaves.items():
        for other, left, end in steps.get((k, i), []):
            h = node(other, h, note(end)) if left else node(h, other, note(end))
        assert h.hex() == got[k]


def test_scalars(spark):
    r = spark.range(1).select(
        scalars.padded(F.lit(0)).alias("a"), scalars.padded(F.lit(1)).alias("b"), scalars.padded(F.lit(262144)).alias("c"), scalars.ceil_to(F.lit(262144), 262144).alias("d"),
        scalars.redenominated(F.lit(7), F.lit(1), 3).alias("e"), scalars.redenominated(F.lit(7), F.lit(0), 3).alias("f"), scalars.packing_kind(F.lit("composite_xy.3")).alias("g"),
    ).first()
    assert [r[k] for k in "abcd"] == [0, 262144, 262144, 524288]
    assert (int(r["e"]), int(r["f"]), r["g"]) == (7_000_000, 7, "composite")

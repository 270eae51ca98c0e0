"""Scalar functions, folds and stored tables against plain Python."""

from __future__ import annotations

import glob
import hashlib
import os
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cairn.functions import money, scalars
from cairn.operators import folds, intervals
from cairn.sources.tables import scratch, shared_dir, stored
from cairn.streaming import jobs


def test_deep_hash(spark):
    def plain(x):
        h = lambda b: hashlib.sha384(b).digest()
        if isinstance(x, bytes):
            return h(h(b"blob" + str(len(x)).encode()) + h(x))
        out = h(b"list" + str(len(x)).encode())
        for y in x:
            out = h(out + plain(y))
        return out

    row = spark.range(1).select(scalars.deep_hash([F.lit("a"), [F.lit("bc"), [F.lit("é")]], []]).alias("h"), scalars.deep_hash([[F.lit("a")]]).alias("g")).first()
    assert bytes(row["h"]) == plain([b"a", [b"bc", ["é".encode()]], []]) and bytes(row["g"]) == plain([[b"a"]]) != plain([b"a"])


def test_addresses(spark):
    raw = bytes(range(32))
    df = spark.createDataFrame([(bytearray(raw),)], "b binary")
    code = df.select(scalars.with_checksum(F.col("b")).alias("c"), scalars.base64url(F.col("b")).alias("p")).first()
    texts = [code["c"], code["p"], code["c"][:-1] + ("A" if code["c"][-1] != "A" else "B"), code["p"] + ":AAAAAA", "c2hvcnQ:AAAAAA"]
    got = [r["d"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.decoded_address(F.col("t")).alias("d")).collect()]
    assert [g and bytes(g) for g in got] == [raw, raw, None, None, None]


def test_fractions(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(1, 60), rng.randrange(1, 30), rng.randrange(1, 60), rng.randrange(1, 30)) for _ in range(40)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    x, y = (F.col("a"), F.col("b")), (F.col("c"), F.col("d"))
    pair = lambda p, n: [p[0].alias(f"{n}0"), p[1].alias(f"{n}1")]
    made = df.select("*", *pair(money.plus(x, y), "s"), *pair(money.times(x, y), "p"), *pair(money.exponential(x, 5), "e"), *pair(money.halved(x, 10), "h"), money.less(x, y).alias("less"), money.power(F.col("a"), 7).alias("seventh"), money.quotient(F.col("a"), F.col("b")).alias("q"))

    def halved(n, d):
        while n > 10 or d > 10:
            n, d = n // 2, d // 2
            if d == 0:
                return 10, 1
            if n == 0:
                return 1, 10
        return n, d

    for r in made.collect():
        a, b = Fraction(r["a"], r["b"]), Fraction(r["c"], r["d"])
        assert Fraction(int(r["s0"]), int(r["s1"])) == a + b and Fraction(int(r["p0"]), int(r["p1"])) == a * b and r["less"] == (a < b)
        assert Fraction(int(r["e0"]), int(r["e1"])) == sum(a**k / Fraction(_factorial(k)) for k in range(6))
        assert (int(r["seventh"]), int(r["q"])) == (r["a"] ** 7, r["a"] // r["b"])
        assert (int(r["h0"]), int(r["h1"])) == halved(r["a"], r["b"]) or (r["a"], r["b"]) > (10, 10)


def _factorial(n):
    return 1 if n < 2 else n * _factorial(n - 1)


def test_difficulty(spark):
    most = 1 << 30
    df = spark.createDataFrame([(most - k,) for k in (1, 2, 999, 10**6, most - 1)], "d long")
    c = F.col("d")
    for r in df.select("d", money.hash_rate(c, most).alias("h"), money.scaled_difficulty(c, 100, 1, 7, most).alias("up"), money.scaled_difficulty(c, 3, 10, 7, most).alias("down"), money.shared_difficulty(c, 32, most).alias("s")).collect():
        left = most - r["d"]
        bound = lambda v: max(7, min(v, most - 1))
        assert int(r["h"]) == most // left and int(r["up"]) == bound(most - left // 100) and int(r["down"]) == bound(most - left * 10 // 3)
        assert int(r["s"]) == (most * 2048 * most * most - (64 * left * most + 31 * left * left) * most) // (2048 * most * most)


def test_folds(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(7)
    got = folds.folded(df, ["k"], ["i"], "k string, i long, s long", lambda: 0, lambda s, r: (s * 2 % 1009 + r[1], [(r[0], s * 2 % 1009 + r[1])]))
    want = set()
    for k in ("a", "b", None):
        s = 0
        for _, i, v in [r for r in rows if r[0] == k]:
            s = s * 2 % 1009 + v
            want.add((k, i, s))
    assert {tuple(r) for r in got.collect()} == want
    assert folds.folded(df.limit(0), ["k"], ["i"], "k string, n long", lambda: 0, lambda s, _: (s + 1, []), lambda s: [(s,)]).count() == 0


def test_interval_log(spark):
    rng = random.Random(3)
    ops = [(rng.choice([1, 2]), n, s := rng.randrange(60), s + rng.randrange(1, 15), rng.random() < 0.6) for n in range(60)]
    want = {}
    for k, _, s, e, adds in ops:
        held = want.setdefault(k, set())
        held.update(range(s + 1, e + 1)) if adds else held.difference_update(range(s + 1, e + 1))
    df = spark.createDataFrame(ops, "key long, seq long, start long, end long, adds boolean")
    got = {}
    for r in intervals.replayed(df, ["key"], "seq", "adds").collect():
        got.setdefault(r["key"], set()).update(range(r["start"] + 1, r["end"] + 1))
    assert got == {k: v for k, v in want.items() if v}


def test_streams_in_several_batches(spark):
    """Averages and limits go on from batch to batch, and batches come in order."""
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), 1_700_000_000_000_000 + 1_000_000 * i * 700, rng.randrange(100)) for i in range(90)]
    df = spark.createDataFrame(rows, "event_id long, peer long, us long, latency long").withColumn("ts", F.timestamp_micros("us"))
    found = jobs.limited(jobs.replayed(df, "event_id", 4, "limits"), 3_600_000_000, 3)
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(jobs.run(found, "limited")).collect()}
    want = {i: sum(p == q and us - 3_600_000_000 < t <= us for _, q, t, _ in rows) <= 3 for i, p, us, _ in rows}
    assert got == want
    averages = jobs.upserted(jobs.moving_average(jobs.replayed(df, "event_id", 3, "averages")), "averaged", "update", ["peer"], "n")
    ema = {}
    for _, p, _, v in rows:
        ema[p] = (9 * ema[p] + v) // 10 if p in ema else v
    assert {r["peer"]: r["ema"] for r in averages.collect()} == ema


def test_scratch(spark):
    with scratch(spark) as keep:
        inner = stored(spark.range(5).toDF("x"), "inner")
        with scratch(spark) as deeper:
            mid = deeper(inner.withColumn("y", F.col("x") + 1), "mid")
            stored(mid, "lost")
        out = keep(mid.where("y > 2"), "out")
    assert out.count() == 3
    left = {os.path.basename(p).rsplit("-", 1)[0] for p in glob.glob(f"{shared_dir(spark).removeprefix('file:')}/*")}
    assert "out" in left and not left & {"inner", "mid", "lost"}


@pytest.mark.parametrize("name", ["kept"])
def test_kept_up_table_is_the_last_version(spark, name):
    ops = spark.createDataFrame([(i, i * 10) for i in range(9)], "seq long, v long")
    first = spark.createDataFrame([], "n long, s long")

    def advance(before, rows):
        return before.unionByName(rows.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))

    out, last = jobs.kept_up(jobs.replayed(ops, "seq", 3, f"{name}-ops"), name, first, advance)
    assert last == 2 and tuple(spark.read.schema("n long, s long").parquet(f"{out}/_n={last}").first()) == (9, 360)

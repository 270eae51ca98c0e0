"""Queries on difficulty, emission, prices, rewards and mining rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import money
from cairn.operators import folds, ordered
from cairn.plans import views
from cairn.plans.registry import query
from cairn.plans.views import sql
from cairn.sources.tables import table

Spark = SparkSession
MOST = 1 << 30

_SEGMENTS = "seg AS (SELECT height // 20 AS k, max(ts) - min(ts) AS took, CAST(sum(size) AS BIGINT) AS size FROM blocks GROUP BY 1), sk AS (SELECT *, row_number() OVER (ORDER BY k) AS i FROM seg)"


def _segments(spark: Spark, sf_dir: str) -> DataFrame:
    """Stretches of twenty blocks: the only rows that a fold along the whole chain sees."""
    return views.blocks(spark, sf_dir).groupBy(F.expr("height div 20").alias("k")).agg((F.max("ts") - F.min("ts")).alias("took"), F.sum("size").alias("size"))


@query(f"""{sql('blocks')}, {_SEGMENTS}, r AS (SELECT k, i, CAST({MOST} - 1000000 AS BIGINT) AS diff FROM sk WHERE i = 1 UNION ALL SELECT s.k, s.i, greatest(1000, least({MOST} - 1, {MOST} - ({MOST} - r.diff) * greatest(50, least(200, s.took // 1000000)) // 100)) FROM r JOIN sk s ON s.i = r.i + 1) SELECT k, diff FROM r""")
def retarget_path(spark: Spark, sf_dir: str) -> DataFrame:
    """The difficulty along the chain: every twenty blocks what it leaves is scaled by the time taken, by a half to two."""

    def step(diff: int | None, row: tuple) -> tuple[int, list]:
        k, took, _ = row
        diff = MOST - 1_000_000 if diff is None else max(1000, min(MOST - 1, MOST - (MOST - diff) * max(50, min(200, took // 1_000_000)) // 100))
        return diff, [(k, diff)]

    return folds.folded(_segments(spark, sf_dir), [], ["k"], "k long, diff long", lambda: None, step)


@query(f"""{sql('blocks')}, {_SEGMENTS}, p AS (SELECT k, i, CAST(100 AS BIGINT) AS price FROM sk WHERE i = 1 UNION ALL SELECT s.k, s.i, greatest(p.price // 2, least(p.price * 2, (9 * p.price + s.size) // 10)) FROM p JOIN sk s ON s.i = p.i + 1) SELECT k, price FROM p""")
def price_ema_path(spark: Spark, sf_dir: str) -> DataFrame:
    """An integer average moved every twenty blocks, held to half and twice the one before, along the whole chain."""

    def step(price: int | None, row: tuple) -> tuple[int, list]:
        k, _, size = row
        price = 100 if price is None else max(price // 2, min(price * 2, (9 * price + size) // 10))
        return price, [(k, price)]

    return folds.folded(_segments(spark, sf_dir), [], ["k"], "k long, price long", lambda: None, step)


@query(f"""{sql('blocks')}, o AS (SELECT *, reward % 1000 - size * 6 AS d, row_number() OVER (ORDER BY height) AS i FROM blocks), c AS (SELECT height, i, greatest(0, 1000 + d) AS pool, greatest(0, -1000 - d) AS debt FROM o WHERE i = 1 UNION ALL
SELECT o.height, o.i, greatest(0, c.pool + o.d), c.debt + greatest(0, -(c.pool + o.d)) FROM c JOIN o ON o.i = c.i + 1) SELECT height, pool, debt FROM c""")
def reward_cascade(spark: Spark, sf_dir: str) -> DataFrame:
    """A pool that fees fill and rewards empty; what it can't pay becomes debt, along the whole chain.

    The pool is the running sum less its running minimum where that is below zero, and the debt is that minimum.
    """
    b = views.blocks(spark, sf_dir).select("height", (F.col("reward") % 1000 - F.col("size") * 6).alias("d"))
    summed = ordered.running(b, ["height"], {"s": ("sum", F.col("d"))}).withColumn("s", F.col("s") + 1000)
    least = ordered.running(summed, ["height"], {"m": ("min", F.col("s"))}).withColumn("debt", F.greatest(F.lit(0).cast("long"), -F.col("m")))
    return least.select("height", (F.col("s") + F.col("debt")).alias("pool"), "debt")


_D = f"d AS (SELECT o_orderkey AS height, CAST({MOST} - (1 + o_custkey % 977) * 1000 AS HUGEINT) AS diff FROM orders)"


@query(f"""WITH {_D} SELECT height, CAST({MOST} // ({MOST} - diff) AS BIGINT) AS rate, CAST(greatest(1000, least({MOST} - ({MOST} - diff) * 1 // 100, {MOST} - 1)) AS BIGINT) AS harder, CAST(greatest(1000, least({MOST} - ({MOST} - diff) * 10 // 3, {MOST} - 1)) AS BIGINT) AS easier,
CAST((CAST({MOST} AS HUGEINT) * 2048 * {MOST} * {MOST} - (64 * ({MOST} - diff) * {MOST} + 31 * ({MOST} - diff) * ({MOST} - diff)) * {MOST}) // (CAST(2048 AS HUGEINT) * {MOST} * {MOST}) AS BIGINT) AS shared, round(30 - log2(CAST({MOST} - diff AS DOUBLE)), 6) AS logged FROM d""")
def difficulty_math(spark: Spark, sf_dir: str) -> DataFrame:
    """Hash rate, harder and easier difficulties, one shared by 32 tries, and the logarithmic one."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("height"), (F.lit(MOST) - (1 + F.col("o_custkey") % 977) * 1000).alias("diff"))
    c = F.col("diff")
    long = lambda x: x.cast("long")
    return d.select("height", long(money.hash_rate(c, MOST)).alias("rate"), long(money.scaled_difficulty(c, 100, 1, 1000, MOST)).alias("harder"), long(money.scaled_difficulty(c, 3, 10, 1000, MOST)).alias("easier"),
                    long(money.shared_difficulty(c, 32, MOST)).alias("shared"), F.round(money.log_difficulty(c, 30), 6).alias("logged"))


@query("SELECT o_orderkey AS height, CAST(round(0.2 * 55000000 * 1000000000000 * pow(2.0, -(CAST(o_orderkey AS DOUBLE)) / 262800) * ln(2.0) / 262800 / 1000000) AS BIGINT) AS millions FROM orders")
def inflation_curve(spark: Spark, sf_dir: str) -> DataFrame:
    """Emission by height, in millions of the smallest unit."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("height"), F.round(money.emission(F.col("o_orderkey")) / 1_000_000).cast("long").alias("millions"))


@query("""WITH f AS (SELECT c_custkey AS id, CAST(c_custkey % 97 + 1 AS HUGEINT) AS n, CAST(c_custkey % 13 + 2 AS HUGEINT) AS d FROM customer)
SELECT id, CAST(n * n * n * n * n AS BIGINT) AS fifth, CAST(n * 7 + 3 * d AS BIGINT) AS sum_n, CAST(d * 7 AS BIGINT) AS sum_d, CAST(n * 3 AS BIGINT) AS prod_n, CAST(d * 7 AS BIGINT) AS prod_d, n * 7 < 30 * d AS below, CAST(n // d AS BIGINT) AS whole,
CAST(d*d*d*d*24 + n*d*d*d*24 + n*n*d*d*12 + n*n*n*d*4 + n*n*n*n AS BIGINT) AS exp_n, CAST(d*d*d*d*24 AS BIGINT) AS exp_d FROM f""")
def rational_math(spark: Spark, sf_dir: str) -> DataFrame:
    """Exact fractions: powers, sums, products, comparison, and e to a fraction by its series."""
    n, d = F.col("c_custkey") % 97 + 1, F.col("c_custkey") % 13 + 2
    x = (n, d)
    s, p, e = money.plus(x, (F.lit(3), F.lit(7))), money.times(x, (F.lit(3), F.lit(7))), money.exponential(x, 4)
    long = lambda c: c.cast("long")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), long(money.power(n, 5)).alias("fifth"), long(s[0]).alias("sum_n"), long(s[1]).alias("sum_d"), long(p[0]).alias("prod_n"), long(p[1]).alias("prod_d"),
        money.less(x, (F.lit(30), F.lit(7))).alias("below"), long(money.quotient(n, d)).alias("whole"), long(e[0]).alias("exp_n"), long(e[1]).alias("exp_d"))


@query("SELECT p_partkey AS id, CAST(p_size * 1048576 AS BIGINT) AS bytes, CAST(CAST(p_size AS HUGEINT) * 1048576 * 3925 * 200 // 1073741824 * CAST(round(p_retailprice * 100) AS BIGINT) // 1000 AS BIGINT) AS cost FROM part")
def storage_cost(spark: Spark, sf_dir: str) -> DataFrame:
    """The cost of keeping data for good: bytes by a declining yearly price over two hundred years, by the exchange rate."""
    size = F.col("p_size").cast("long") * 1_048_576
    per = money.quotient(money.whole(size) * money.whole(3925 * 200), money.whole(1_073_741_824))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), size.alias("bytes"), money.quotient(per * money.whole(F.round(F.col("p_retailprice") * 100).cast("long")), money.whole(1000)).cast("long").alias("cost"))


@query(f"""{sql('blocks')}, s AS (SELECT height // 100 AS era, CAST(sum(reward) AS BIGINT) AS paid, CAST(sum(size) AS BIGINT) * 100000 AS pool FROM blocks GROUP BY 1), t AS (SELECT *, CAST(sum(paid) OVER (ORDER BY era) AS BIGINT) AS supply FROM s) SELECT era, supply, supply + 5000 - pool < 2000000000 AS redenominate, CASE WHEN supply + 5000 - pool < 2000000000 THEN era + 1 END AS at_era FROM t""")
def redenominate_when(spark: Spark, sf_dir: str) -> DataFrame:
    """Whether the coins in circulation have become so few that the next era counts in smaller units."""
    s = views.blocks(spark, sf_dir).groupBy(F.expr("height div 100").alias("era")).agg(F.sum("reward").alias("paid"), (F.sum("size") * 100_000).alias("pool"))
    t = ordered.running(s, ["era"], {"supply": ("sum", F.col("paid"))})
    few = F.col("supply") + 5000 - F.col("pool") < 2_000_000_000
    return t.select("era", "supply", few.alias("redenominate"), F.when(few, F.col("era") + 1).alias("at_era"))


_COUNTERS = "c AS (SELECT subnet AS part, event_type AS kind, min(us) AS began, count(*) AS samples, CAST(sum(latency) AS BIGINT) AS total FROM pe GROUP BY 1, 2), now_ AS (SELECT max(us) AS now FROM pe)"


@query(f"{sql('pe')}, {_COUNTERS} SELECT part, kind, samples, total, round(CASE WHEN now = began THEN 0.0 ELSE total / ((now - began) / 1000000.0) END, 6) AS by_time, round(total / samples, 6) AS by_sample FROM c, now_")
def mining_rates(spark: Spark, sf_dir: str) -> DataFrame:
    """Counters by key with their start, samples and count, and the rates by time and by sample; 0 where there is none."""
    e = views.peer_events(spark, sf_dir)
    c = e.groupBy(F.col("subnet").alias("part"), F.col("event_type").alias("kind")).agg(F.min("us").alias("began"), F.count(F.lit(1)).alias("samples"), F.sum("latency").alias("total"))
    both = c.crossJoin(F.broadcast(e.agg(F.max("us").alias("now"))))  # one row
    seconds = (F.col("now") - F.col("began")) / 1_000_000.0
    return both.select("part", "kind", "samples", "total", F.round(F.when(seconds == 0, 0.0).otherwise(F.col("total") / seconds), 6).alias("by_time"), F.round(F.col("total") / F.col("samples"), 6).alias("by_sample"))


@query(f"{sql('pe')} SELECT subnet AS part, count(*) AS reads, CAST(sum(latency) AS BIGINT) AS bytes, count(*) FILTER (WHERE event_type = 'purchase') AS h1, count(*) FILTER (WHERE event_type = 'click') AS h2, count(DISTINCT peer) AS peers FROM pe GROUP BY ROLLUP (subnet)")
def performance_report(spark: Spark, sf_dir: str) -> DataFrame:
    """A row per partition and one for all."""
    e = views.peer_events(spark, sf_dir).rollup(F.col("subnet").alias("part"))
    return e.agg(F.count(F.lit(1)).alias("reads"), F.sum("latency").alias("bytes"), F.count_if(F.col("event_type") == "purchase").alias("h1"), F.count_if(F.col("event_type") == "click").alias("h2"), F.countDistinct("peer").alias("peers"))


@query("""WITH p AS (SELECT l_suppkey % 8 AS part, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size FROM lineitem GROUP BY 1), t AS (SELECT sum(size) AS total FROM p)
SELECT part, round(200 / 1.25 * least(1.0, size / 20000.0) * (1 + least(1.0, total / 500000.0)), 6) AS read_rate, round(400 / 1.25 * least(1.0, size / 20000.0) / 100 + 400 / 1.25 * least(1.0, size / 20000.0) * least(1.0, total / 500000.0), 6) AS hash_rate FROM p, t""")
def optimal_rates(spark: Spark, sf_dir: str) -> DataFrame:
    """The best read and hash rates that a partition's share of its size, and all data's of the archive's, allow."""
    p = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 8).alias("part")).agg(F.sum(F.col("l_quantity").cast("long")).alias("size"))
    both = p.crossJoin(F.broadcast(p.agg(F.sum("size").alias("total"))))  # one row
    own, all_ = F.least(F.lit(1.0), F.col("size") / 20_000.0), F.least(F.lit(1.0), F.col("total") / 500_000.0)
    base = F.lit(400 / 1.25) * own
    return both.select("part", F.round(F.lit(200 / 1.25) * own * (1 + all_), 6).alias("read_rate"), F.round(base / 100 + base * all_, 6).alias("hash_rate"))


@query("SELECT l_returnflag AS packing, CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_suppkey % 8 <> 7) AS BIGINT) AS minable, CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_suppkey % 8 = 7) AS BIGINT) AS tip FROM lineitem GROUP BY 1")
def minable_size(spark: Spark, sf_dir: str) -> DataFrame:
    """All data of a packing but that of the tip's partition."""
    tip, n = F.col("l_suppkey") % 8 == 7, F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("packing")).agg(F.sum(F.when(~tip, n)).alias("minable"), F.sum(F.when(tip, n)).alias("tip"))


@query("""WITH now_ AS (SELECT l_partkey % 40 AS label, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size FROM lineitem WHERE l_shipdate >= DATE '1998-06-01' GROUP BY 1), was AS (SELECT DISTINCT l_partkey % 40 AS label FROM lineitem WHERE l_shipdate < DATE '1998-06-01')
SELECT coalesce(now_.label, was.label) AS label, size, size IS NULL AS removed FROM now_ FULL JOIN was USING (label)""")
def stale_labels(spark: Spark, sf_dir: str) -> DataFrame:
    """Sizes by label as they are now; labels that were there before and aren't any more are removed."""
    li = table(spark, sf_dir, "lineitem").withColumn("label", F.col("l_partkey") % 40)
    now = li.where("l_shipdate >= date'1998-06-01'").groupBy("label").agg(F.sum(F.col("l_quantity").cast("long")).alias("size"))
    gone = li.where("l_shipdate < date'1998-06-01'").select("label").distinct().join(now, "label", "left_anti")
    return now.withColumn("removed", F.lit(False)).unionByName(gone.select("label", F.lit(None).cast("long").alias("size"), F.lit(True).alias("removed")))


@query(f"{sql('pe')} SELECT event_type AS process, CAST(sum(latency) AS BIGINT) AS memory, max(latency) AS queue, count(DISTINCT peer) AS members, string_agg(DISTINCT CAST(subnet AS VARCHAR), ',' ORDER BY CAST(subnet AS VARCHAR)) AS subnets FROM pe GROUP BY 1 ORDER BY queue DESC, process LIMIT 4")
def process_top(spark: Spark, sf_dir: str) -> DataFrame:
    """Processes grouped by name with what they hold, the longest queues first."""
    e = views.peer_events(spark, sf_dir).groupBy(F.col("event_type").alias("process"))
    g = e.agg(F.sum("latency").alias("memory"), F.max("latency").alias("queue"), F.countDistinct("peer").alias("members"), F.array_join(F.array_sort(F.collect_set(F.col("subnet").cast("string"))), ",").alias("subnets"))
    return g.orderBy(F.desc("queue"), "process").limit(4)


_MEMPOOL = "mp AS (SELECT o_orderkey AS id, o_orderkey % 40 AS pool, CAST(round(o_totalprice) AS BIGINT) AS priority, 3210 + CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 997 * 10 ELSE 0 END AS head, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 997 * 10 END AS data FROM orders)"


@query(f"""WITH RECURSIVE {_MEMPOOL}, o AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY priority, id) AS r, sum(head) OVER (PARTITION BY pool) AS h0, sum(data) OVER (PARTITION BY pool) AS d0 FROM mp),
e AS (SELECT pool, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS id, CAST(max(h0) AS BIGINT) AS h, CAST(max(d0) AS BIGINT) AS d, false AS gone FROM o GROUP BY pool UNION ALL
SELECT o.pool, o.r, o.id, e.h - CASE WHEN e.h > 60000 OR (e.d > 40000 AND o.data > 0) THEN o.head ELSE 0 END, e.d - CASE WHEN e.h > 60000 OR (e.d > 40000 AND o.data > 0) THEN o.data ELSE 0 END, e.h > 60000 OR (e.d > 40000 AND o.data > 0) FROM e JOIN o ON o.pool = e.pool AND o.r = e.r + 1) SELECT pool, id FROM e WHERE gone""")
def evict_two_budgets(spark: Spark, sf_dir: str) -> DataFrame:
    """From the lowest priority up, what goes while a pool's headers exceed their budget, or, of those with data, its data theirs."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 40).alias("pool"), F.round("o_totalprice").cast("long").alias("priority"), (F.col("o_orderkey") % 997 * 10).alias("n"), (F.col("o_orderkey") % 3 == 0).alias("old"))
    m = o.select("id", "pool", "priority", (3210 + F.when(F.col("old"), F.col("n")).otherwise(0)).cast("long").alias("head"), F.when(F.col("old"), 0).otherwise(F.col("n")).cast("long").alias("data"))
    totals = m.groupBy("pool").agg(F.sum("head").alias("h0"), F.sum("data").alias("d0"))

    def step(state: tuple[int, int] | None, row: tuple) -> tuple[tuple[int, int], list]:
        tx, _, head, data, h0, d0 = row
        h, d = state or (h0, d0)
        if h > 60_000 or (d > 40_000 and data > 0):
            return (h - head, d - data), [(tx,)]
        return (h, d), []

    return folds.folded(m.join(totals, "pool"), ["pool"], ["priority", "id"], "pool long, id long", lambda: None, step)


@query(f"""{sql('pe')}, o AS (SELECT peer, event_id, us, row_number() OVER (PARTITION BY peer ORDER BY us, event_id) AS r FROM pe), a AS (SELECT peer, event_id, r, us AS last, true AS accepted FROM o WHERE r = 1 UNION ALL
SELECT o.peer, o.event_id, o.r, CASE WHEN o.us - a.last > 3600000000 THEN o.us ELSE a.last END, o.us - a.last > 3600000000 FROM a JOIN o ON o.peer = a.peer AND o.r = a.r + 1) SELECT peer, event_id, accepted FROM a""")
def throttle_accepted(spark: Spark, sf_dir: str) -> DataFrame:
    """Requests are accepted if the last accepted one of their peer is over an hour ago; refused ones don't count."""
    e = views.peer_events(spark, sf_dir).select("peer", "us", "event_id")

    def step(last: int | None, row: tuple) -> tuple[int, list]:
        us, event = row
        ok = last is None or us - last > 3_600_000_000
        return us if ok else last, [(event, ok)]

    return folds.folded(e, ["peer"], ["us", "event_id"], "peer long, event_id long, accepted boolean", lambda: None, step)


@query("SELECT o_orderkey AS id FROM (SELECT *, sum(o_orderkey % 997 + 100) OVER (PARTITION BY o_custkey % 32 ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS used FROM orders) WHERE used <= 12000")
def bounded_queue(spark: Spark, sf_dir: str) -> DataFrame:
    """What stays in each queue when the lowest priorities are dropped until it fits."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 32).alias("queue"), (-F.round(F.col("o_totalprice") * 100).cast("long")).alias("k"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 997 + 100).alias("size"))
    return ordered.running(o, ["k", "id"], {"used": ("sum", F.col("size"))}, ["queue"], 20).where("used <= 12000").select("id")


@query(f"{sql('pe')}, w AS (SELECT peer, event_type AS path, count(*) AS n FROM pe WHERE us > (SELECT max(us) FROM pe) - 5 * 86400000000 GROUP BY 1, 2) SELECT event_id, pe.peer AS peer, event_type AS path FROM pe JOIN w ON w.peer = pe.peer AND w.path = pe.event_type AND n > 1")
def throttled_peers(spark: Spark, sf_dir: str) -> DataFrame:
    """Requests of peers that have asked for a path more often than allowed of late."""
    e = views.peer_events(spark, sf_dir).withColumnRenamed("event_type", "path")
    last = e.agg(F.max("us").alias("last"))
    over = e.crossJoin(F.broadcast(last)).where("us > last - 5 * 86400000000").groupBy("peer", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # one row
    return e.join(over, ["peer", "path"], "left_semi").select("event_id", "peer", "path")

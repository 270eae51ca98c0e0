"""Queries on histories, prices, accounts, pending transactions and peers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import scalars
from cairn.operators import folds, ordered
from cairn.plans import views
from cairn.plans.registry import query
from cairn.plans.views import sql
from cairn.sources.tables import table

Spark = SparkSession


@query(f"{sql('accounts')} SELECT CAST(sum(CASE denomination WHEN 1 THEN balance * 1000 ELSE balance END) AS BIGINT) AS supply FROM accounts")
def total_supply(spark: Spark, sf_dir: str) -> DataFrame:
    a = views.accounts(spark, sf_dir)
    return a.agg(F.sum(scalars.redenominated(F.col("balance"), F.col("denomination"), 2)).cast("long").alias("supply"))


@query(f"{sql('blocks')} SELECT miner, CAST(sum(reward) AS BIGINT) AS reserved FROM blocks WHERE height > (SELECT max(height) FROM blocks) - 500 GROUP BY miner")
def reserved_rewards(spark: Spark, sf_dir: str) -> DataFrame:
    """Rewards of each address in the locked window."""
    b = views.blocks(spark, sf_dir)
    tip = b.agg(F.max("height").alias("tip"))
    return b.crossJoin(F.broadcast(tip)).where("height > tip - 500").groupBy("miner").agg(F.sum("reward").alias("reserved"))  # one row


@query(f"{sql('blocks')} SELECT height, CAST(sum(size) OVER w AS BIGINT) AS sizes, CAST(sum(reward) OVER w AS BIGINT) AS rewards, count(*) OVER w AS n FROM blocks WINDOW w AS (ORDER BY height ROWS 49 PRECEDING)")
def reward_totals(spark: Spark, sf_dir: str) -> DataFrame:
    b = views.blocks(spark, sf_dir).select("height", "size", "reward")
    return ordered.trailing(b, "height", 50, {"sizes": F.sum("size"), "rewards": F.sum("reward"), "n": F.count(F.lit(1))}).select("height", "sizes", "rewards", "n")


_STEPS = "steps AS (SELECT height, greatest(1, ts - lag(ts) OVER (ORDER BY height)) AS step, CASE WHEN size > 100 THEN 2 ELSE 1 END AS chunks, size, reward FROM blocks)"


def _steps(spark: Spark, sf_dir: str) -> DataFrame:
    b = views.blocks(spark, sf_dir).withColumn("chunks", F.when(F.col("size") > 100, 2).otherwise(1))
    with_last = ordered.trailing(b, "height", 2, {"_prev": F.min(F.struct("height", "ts")), "_n": F.count(F.lit(1))})
    step = F.when(F.col("_n") > 1, F.greatest(F.lit(1), F.col("ts") - F.col("_prev.ts"))).otherwise(1)
    return with_last.select("height", step.alias("step"), "chunks", "size", "reward")


@query(f"{sql('blocks')}, {_STEPS} SELECT height, CAST(sum(step) OVER w AS BIGINT) AS steps, count(*) FILTER (WHERE chunks = 1) OVER w AS one, count(*) FILTER (WHERE chunks <> 1) OVER w AS two FROM steps WINDOW w AS (ORDER BY height ROWS 29 PRECEDING)")
def block_time_history(spark: Spark, sf_dir: str) -> DataFrame:
    aggs = {"steps": F.sum("step"), "one": F.count_if(F.col("chunks") == 1), "two": F.count_if(F.col("chunks") != 1)}
    return ordered.trailing(_steps(spark, sf_dir), "height", 30, aggs).select("height", "steps", "one", "two")


@query(f"{sql('blocks')} SELECT height, CASE WHEN count(*) OVER w >= 20 THEN CAST(sum(size) OVER w AS BIGINT) // count(*) OVER w ELSE 120 END AS mean FROM blocks WINDOW w AS (ORDER BY height ROWS BETWEEN 29 PRECEDING AND 10 PRECEDING)")
def vdf_retarget(spark: Spark, sf_dir: str) -> DataFrame:
    """A truncated mean over a frame that skips the newest rows."""
    b = views.blocks(spark, sf_dir).select("height", "size")
    old = ordered.trailing(b, "height", 20, {"s": F.sum("size"), "n": F.count(F.lit(1))}).select((F.col("height") + 10).alias("height"), "s", "n")
    found = b.select("height").join(old, "height", "left")
    return found.select("height", F.when(F.col("n") >= 20, F.expr("s div n")).otherwise(120).alias("mean"))


_TOTALS = "tot AS (SELECT height, CAST(sum(reward) OVER w AS BIGINT) AS r, CAST(sum(step) OVER w AS BIGINT) AS st, CAST(sum(size) OVER w AS BIGINT) AS sz FROM steps WINDOW w AS (ORDER BY height ROWS 49 PRECEDING))"


def _price(spark: Spark, sf_dir: str) -> DataFrame:
    totals = ordered.trailing(_steps(spark, sf_dir), "height", 50, {"r": F.sum("reward"), "st": F.sum("step"), "sz": F.sum("size")})
    return totals.select("height", F.expr("coalesce(r * 60 div nullif(st * greatest(sz, 1) div 1000, 0), 0)").alias("price"))


@query(f"{sql('blocks')}, {_STEPS}, {_TOTALS} SELECT height, coalesce(r * 60 // nullif(st * greatest(sz, 1) // 1000, 0), 0) AS price FROM tot")
def price_v2(spark: Spark, sf_dir: str) -> DataFrame:
    """Price from window totals: everything is multiplied first and divided once, truncating."""
    return _price(spark, sf_dir)


@query(f"{sql('blocks')}, {_STEPS}, {_TOTALS}, p AS (SELECT height, coalesce(r * 60 // nullif(st * greatest(sz, 1) // 1000, 0), 0) AS price FROM tot) SELECT height, CASE WHEN height <= 400 THEN 1000 WHEN height >= 900 THEN price ELSE 1000 + (price - 1000) * (height - 400) // 500 END AS price FROM p")
def price_transition(spark: Spark, sf_dir: str) -> DataFrame:
    """A price that goes from a fixed one to the computed one by height."""
    between = F.expr("1000 + (price - 1000) * (height - 400) div 500")
    return _price(spark, sf_dir).withColumn("price", F.when(F.col("height") <= 400, 1000).when(F.col("height") >= 900, F.col("price")).otherwise(between))


@query(f"{sql('txs')} SELECT height, line, target, size, reward, format, n, (size + 3210) * 11 * 105 // 100 + CASE WHEN target % 5 = 0 THEN 5000 ELSE 0 END AS fee, greatest(size * 11, size * 13) AS pessimistic, least(size * 11, size * 13) AS optimistic FROM txs")
def tx_fee(spark: Spark, sf_dir: str) -> DataFrame:
    fee = F.expr("(size + 3210) * 11 * 105 div 100") + F.when(F.col("target") % 5 == 0, 5000).otherwise(0)
    two = [F.col("size") * 11, F.col("size") * 13]
    return views.txs(spark, sf_dir).withColumns({"fee": fee, "pessimistic": F.greatest(*two), "optimistic": F.least(*two)})


@query(f"{sql('blocks', 'idx', 'txs')} SELECT height, CAST(sum(t.reward * 5 // 6 * n) AS BIGINT) AS endowment, CAST(sum((t.reward - t.reward * 5 // 6) * n) AS BIGINT) AS miner_share FROM txs t GROUP BY height")
def fee_split(spark: Spark, sf_dir: str) -> DataFrame:
    part = F.expr("reward * 5 div 6")
    return views.txs(spark, sf_dir).groupBy("height").agg(F.sum(part * F.col("n")).alias("endowment"), F.sum((F.col("reward") - part) * F.col("n")).alias("miner_share"))


@query(f"{sql('blocks')} SELECT max(size) AS largest, CAST(sum(reward) AS BIGINT) AS total, count(DISTINCT miner) AS miners FROM blocks")
def max_block_size(spark: Spark, sf_dir: str) -> DataFrame:
    return views.blocks(spark, sf_dir).agg(F.max("size").alias("largest"), F.sum("reward").alias("total"), F.countDistinct("miner").alias("miners"))


@query(f"""{sql('pe')}, o AS (SELECT peer, latency, row_number() OVER (PARTITION BY peer ORDER BY us, event_id) AS r FROM pe), ema AS (SELECT peer, r, latency AS v FROM o WHERE r = 1 UNION ALL SELECT o.peer, o.r, (9 * v + latency) // 10 FROM ema JOIN o ON o.peer = ema.peer AND o.r = ema.r + 1) SELECT peer, arg_max(v, r) AS ema, max(r) AS n FROM ema GROUP BY peer""")
def peer_ema(spark: Spark, sf_dir: str) -> DataFrame:
    """An integer moving average per peer, folded in order of time."""
    e = views.peer_events(spark, sf_dir).select("peer", "us", "event_id", "latency")

    def step(state: tuple[int, int], row: tuple) -> tuple[tuple[int, int], list]:
        ema, n = state
        return ((9 * ema + row[2]) // 10 if n else row[2], n + 1), []

    return folds.folded(e, ["peer"], ["us", "event_id"], "peer long, ema long, n long", lambda: (0, 0), step, lambda state: [state])


_SCORES = "scores AS (SELECT peer, subnet, CAST(sum(success * 100 - latency % 50) AS BIGINT) AS score FROM pe GROUP BY peer, subnet)"


def _scores(spark: Spark, sf_dir: str) -> DataFrame:
    return views.peer_events(spark, sf_dir).groupBy("peer", "subnet").agg(F.sum(F.col("success") * 100 - F.col("latency") % 50).alias("score"))


@query(f"{sql('pe')}, {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY subnet ORDER BY score DESC, peer) AS rank FROM scores) SELECT peer, subnet, score, rank FROM r ORDER BY rank, score DESC, peer LIMIT 40")
def peer_rank(spark: Spark, sf_dir: str) -> DataFrame:
    """The best peers, taken from all subnets in turn."""
    n = F.row_number().over(W.partitionBy("subnet").orderBy(F.desc("score"), "peer"))
    return _scores(spark, sf_dir).withColumn("rank", n).where("rank <= 40").orderBy("rank", F.desc("score"), "peer").limit(40)


@query(f"{sql('pe')} SELECT DISTINCT peer FROM pe WHERE us >= (SELECT max(us) FROM pe) - 86400000000")
def peer_filter_recent(spark: Spark, sf_dir: str) -> DataFrame:
    e = views.peer_events(spark, sf_dir)
    last = e.agg(F.max("us").alias("last"))
    return e.crossJoin(F.broadcast(last)).where("us >= last - 86400000000").select("peer").distinct()  # one row


@query(f"{sql('pe')}, {_SCORES} SELECT CAST(sum(score) AS BIGINT) AS total, max(score) AS best, count(*) AS peers FROM scores")
def rating_total(spark: Spark, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).agg(F.sum("score").alias("total"), F.max("score").alias("best"), F.count(F.lit(1)).alias("peers"))


@query(f"{sql('txs')} SELECT CAST(sum(n * (3210 + CASE WHEN format = 1 THEN size ELSE 0 END)) AS BIGINT) AS header_bytes, CAST(sum(n * CASE WHEN format = 2 THEN size ELSE 0 END) AS BIGINT) AS data_bytes FROM txs")
def mempool_size(spark: Spark, sf_dir: str) -> DataFrame:
    """Data of old-format transactions counts as header, that of new ones apart."""
    head = 3210 + F.when(F.col("format") == 1, F.col("size")).otherwise(0)
    return views.txs(spark, sf_dir).agg(F.sum(F.col("n") * head).alias("header_bytes"), F.sum(F.col("n") * F.when(F.col("format") == 2, F.col("size")).otherwise(0)).alias("data_bytes"))


@query("SELECT o_custkey AS owner, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT)) AS BIGINT) AS spent FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def spend_by_owner(spark: Spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.round(F.col("l_extendedprice") * 100).cast("long") + F.col("l_quantity").cast("long")).alias("spent"))
    return li.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("owner")), "o_orderkey").groupBy("owner").agg(F.sum("spent").alias("spent"))


_PEND = "pend AS (SELECT o_orderkey AS id, o_custkey AS owner, o_orderkey % 50 AS anchor, CAST(round(o_totalprice * 100) AS BIGINT) AS reward, o_orderkey % 997 AS size FROM orders)"


def _pending(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), (F.col("o_orderkey") % 50).alias("anchor"), F.round(F.col("o_totalprice") * 100).cast("long").alias("reward"), (F.col("o_orderkey") % 997).alias("size"))


@query(f"WITH {_PEND} SELECT id, owner, anchor FROM (SELECT *, row_number() OVER (PARTITION BY owner, anchor ORDER BY reward DESC, id DESC) AS r FROM pend) WHERE r > 1")
def clashing_txs(spark: Spark, sf_dir: str) -> DataFrame:
    """All but the best of the transactions that share an anchor."""
    n = F.row_number().over(W.partitionBy("owner", "anchor").orderBy(F.desc("reward"), F.desc("id")))
    return _pending(spark, sf_dir).withColumn("r", n).where("r > 1").select("id", "owner", "anchor")


@query(f"""WITH {_PEND}, s AS (SELECT id, owner, CAST(sum(reward) OVER (PARTITION BY owner ORDER BY reward DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM pend) SELECT id, owner, spent FROM s JOIN customer ON c_custkey = owner WHERE spent > CAST(round(c_acctbal * 100) AS BIGINT) * 50""")
def overspent_txs(spark: Spark, sf_dir: str) -> DataFrame:
    """Transactions of an owner beyond what the balance pays for, best first."""
    spent = F.sum("reward").over(W.partitionBy("owner").orderBy(F.desc("reward"), "id").rowsBetween(W.unboundedPreceding, 0))
    funds = views.accounts(spark, sf_dir).select(F.col("address").alias("owner"), (F.col("balance") * 50).alias("funds"))
    return _pending(spark, sf_dir).withColumn("spent", spent).join(funds, "owner").where("spent > funds").select("id", "owner", "spent")


@query(f"WITH {_PEND}, s AS (SELECT *, sum(size) OVER (PARTITION BY anchor ORDER BY reward DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM pend) SELECT id, anchor FROM s WHERE used > 5000")
def evict_low_priority(spark: Spark, sf_dir: str) -> DataFrame:
    """What goes from each pool so that the best stay within a byte budget."""
    p = _pending(spark, sf_dir).withColumn("k", -F.col("reward"))
    return ordered.running(p, ["k", "id"], {"used": ("sum", F.col("size"))}, ["anchor"], 20).where("used > 5000").select("id", "anchor")


@query(f"""WITH RECURSIVE {_PEND}, o AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY reward DESC, id) AS r FROM pend),
w AS (SELECT anchor, r, id, CASE WHEN size <= 3000 THEN size ELSE 0 END AS used, size <= 3000 AS taken FROM o WHERE r = 1 UNION ALL
SELECT o.anchor, o.r, o.id, CASE WHEN w.used + o.size <= 3000 THEN w.used + o.size ELSE w.used END, w.used + o.size <= 3000 FROM w JOIN o ON o.anchor = w.anchor AND o.r = w.r + 1) SELECT anchor, id FROM w WHERE taken""")
def pick_txs(spark: Spark, sf_dir: str) -> DataFrame:
    """Greedy picking per pool: best first, what doesn't fit is skipped and the next is tried."""
    x = _pending(spark, sf_dir).where("size <= 3000").select("anchor", (-F.col("reward")).alias("k"), "id", "size")

    def step(used: int, row: tuple) -> tuple[int, list]:
        _, tx, size = row
        return (used + size, [(tx,)]) if used + size <= 3000 else (used, [])

    return folds.folded(x, ["anchor"], ["k", "id"], "anchor long, id long", lambda: 0, step)


@query(f"WITH {_PEND} SELECT id, reward FROM pend ORDER BY CASE WHEN anchor < 5 THEN 0 ELSE 1 END, reward DESC, id LIMIT 100")
def tx_order(spark: Spark, sf_dir: str) -> DataFrame:
    return _pending(spark, sf_dir).orderBy(F.when(F.col("anchor") < 5, 0).otherwise(1), F.desc("reward"), "id").limit(100).select("id", "reward")


@query("SELECT c_custkey AS address, c_custkey = (SELECT max(c_custkey) FROM (SELECT c_custkey FROM customer WHERE c_custkey >= 20 ORDER BY c_custkey LIMIT 25)) AS last FROM customer WHERE c_custkey >= 20 ORDER BY c_custkey LIMIT 25")
def pagination(spark: Spark, sf_dir: str) -> DataFrame:
    """A page from a cursor on, its last row marked as the next cursor."""
    page = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("address")).where("address >= 20").orderBy("address").limit(25)
    return page.crossJoin(F.broadcast(page.agg(F.max("address").alias("m")))).select("address", (F.col("address") == F.col("m")).alias("last"))  # one row


@query("SELECT address, CAST(sum(d) AS BIGINT) AS net FROM (SELECT o_custkey AS address, -CAST(round(o_totalprice * 100) AS BIGINT) AS d FROM orders UNION ALL SELECT l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem) GROUP BY address")
def net_balance(spark: Spark, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("address"), (-F.round(F.col("o_totalprice") * 100).cast("long")).alias("d"))
    into = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey"), F.round(F.col("l_extendedprice") * 100).cast("long"))
    return out.unionAll(into).groupBy("address").agg(F.sum("d").alias("net"))


@query("SELECT l_returnflag || l_linestatus AS packing, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM lineitem GROUP BY 1")
def packing_stats(spark: Spark, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("packing")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 6))  # one row per packing


@query("SELECT l_suppkey % 8 AS part, l_returnflag AS kind, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_suppkey % 8, l_returnflag)")
def mining_report(spark: Spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).alias("part"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").cast("long").alias("q"))
    return li.rollup("part", "kind").agg(F.sum("q").alias("bytes"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_suppkey % 8 AS sector, count(*) FILTER (WHERE l_returnflag = 'A') AS \"A\", count(*) FILTER (WHERE l_returnflag = 'N') AS \"N\", count(*) FILTER (WHERE l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1")
def packing_matrix(spark: Spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("sector", F.col("l_suppkey") % 8)
    return li.groupBy("sector").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)


@query("SELECT o_orderkey AS id FROM orders ORDER BY md5('s' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 50")
def verify_sample(spark: Spark, sf_dir: str) -> DataFrame:
    """A sample without replacement that is the same in every run."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return o.orderBy(F.md5(F.concat(F.lit("s"), F.col("id").cast("string")).cast("binary")), "id").limit(50)


@query(f"{sql('pe')} SELECT event_type, sum(success) AS good, count(*) AS n, min(latency) AS least, max(latency) AS most, CAST(sum(latency) AS BIGINT) // count(*) AS mean FROM pe GROUP BY 1")
def timer_stats(spark: Spark, sf_dir: str) -> DataFrame:
    e = views.peer_events(spark, sf_dir).groupBy("event_type").agg(F.sum("success").alias("good"), F.count(F.lit(1)).alias("n"), F.min("latency").alias("least"), F.max("latency").alias("most"), F.sum("latency").alias("s"))
    return e.withColumn("mean", F.expr("s div n")).drop("s")


@query(f"{sql('pe')} SELECT event_id, peer, count(*) OVER (PARTITION BY peer ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) <= 3 AS allowed FROM pe")
def rate_limit_sliding(spark: Spark, sf_dir: str) -> DataFrame:
    """Whether at most three requests of a peer fell into the hour up to each."""
    n = F.count(F.lit(1)).over(W.partitionBy("peer").orderBy("us").rangeBetween(-3599999999, 0))
    return views.peer_events(spark, sf_dir).select("event_id", "peer", (n <= 3).alias("allowed"))


@query(f"""{sql('pe')}, o AS (SELECT peer, event_id, us // 1000000 AS t, row_number() OVER (PARTITION BY peer ORDER BY us, event_id) AS r FROM pe), l AS (SELECT peer, event_id, r, t, CAST(1 AS BIGINT) AS level FROM o WHERE r = 1 UNION ALL
SELECT o.peer, o.event_id, o.r, o.t, greatest(0, l.level - (o.t - l.t) // 3600) + 1 FROM l JOIN o ON o.peer = l.peer AND o.r = l.r + 1) SELECT peer, event_id, level FROM l""")
def rate_limit_leaky(spark: Spark, sf_dir: str) -> DataFrame:
    """The level of each peer's bucket after each request; an hour lets one request leak.

    A level is the greatest sum of (1 - leaked) over the requests up to now, from any one on: a running sum less its running minimum.
    """
    e = views.peer_events(spark, sf_dir).select("peer", "event_id", "us", F.expr("us div 1000000").alias("t"))
    order = W.partitionBy("peer").orderBy("us", "event_id")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.lag("t").over(order).isNull(), 0).otherwise(1 - F.expr("floor((t - lag(t) over (partition by peer order by us, event_id)) / 3600)"))
    summed = e.withColumn("step", step.cast("long")).withColumn("s", F.sum("step").over(upto))
    return summed.withColumn("least", F.min("s").over(upto)).select("peer", "event_id", (F.col("s") - F.col("least") + 1).alias("level"))


@query(f"{sql('pe')} SELECT event_id, peer, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM pe WHERE event_type IN ('purchase', 'signup') AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 10")
def webhook_filter(spark: Spark, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return views.peer_events(spark, sf_dir).where(F.col("event_type").isin("purchase", "signup")).select("event_id", "peer", k.alias("k")).where("k >= 10")


@query(f"{sql('pe')} SELECT event_id, peer FROM (SELECT *, lag(us) OVER (PARTITION BY peer, event_type ORDER BY us) AS p FROM pe) WHERE p IS NULL OR us - p > 1800000000")
def dedup_ttl(spark: Spark, sf_dir: str) -> DataFrame:
    """Events that don't repeat one of the last half hour."""
    p = F.lag("us").over(W.partitionBy("peer", "event_type").orderBy("us"))
    return views.peer_events(spark, sf_dir).withColumn("p", p).where("p is null or us - p > 1800000000").select("event_id", "peer")


@query(f"{sql('pe')}, s AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY peer ORDER BY us) <= 3600000000 THEN 0 ELSE 1 END AS f FROM pe), g AS (SELECT *, sum(f) OVER (PARTITION BY peer ORDER BY us ROWS UNBOUNDED PRECEDING) AS sess FROM s) SELECT peer, min(us) AS first, max(us) AS last, count(*) AS n FROM g GROUP BY peer, sess")
def event_sessions(spark: Spark, sf_dir: str) -> DataFrame:
    e = views.peer_events(spark, sf_dir)
    order = W.partitionBy("peer").orderBy("us")
    new = F.when(F.col("us") - F.lag("us").over(order) <= 3600000000, 0).otherwise(1)
    g = e.withColumn("f", new).withColumn("sess", F.sum("f").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return g.groupBy("peer", "sess").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count(F.lit(1)).alias("n")).drop("sess")


@query(f"{sql('pe')} SELECT us // 3600000000 AS hour, event_type, count(*) AS n, CAST(sum(latency) AS BIGINT) AS bytes FROM pe GROUP BY 1, 2")
def rate_series(spark: Spark, sf_dir: str) -> DataFrame:
    return views.peer_events(spark, sf_dir).groupBy(F.expr("us div 3600000000").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("latency").alias("bytes"))


@query(f"{sql('pe')}, s AS (SELECT peer, avg(success) AS rate, count(*) AS n FROM pe GROUP BY peer) SELECT peer, n FROM s WHERE rate < 0.8")
def drop_failing_peers(spark: Spark, sf_dir: str) -> DataFrame:
    s = views.peer_events(spark, sf_dir).groupBy("peer").agg(F.avg("success").alias("rate"), F.count(F.lit(1)).alias("n"))
    return s.where("rate < 0.8").select("peer", "n")


@query(f"{sql('blocks', 'txs')} SELECT b.height, b.miner, count(t.height) AS txs, count(t.height) = 0 AS empty FROM blocks b LEFT JOIN txs t USING (height) GROUP BY ALL")
def header_projection(spark: Spark, sf_dir: str) -> DataFrame:
    t = views.txs(spark, sf_dir).groupBy("height").agg(F.count(F.lit(1)).alias("txs"))
    b = views.blocks(spark, sf_dir).select("height", "miner").join(t, "height", "left").withColumn("txs", F.coalesce("txs", F.lit(0).cast("long")))
    return b.withColumn("empty", F.col("txs") == 0)


@query("SELECT c_mktsegment AS tag, CAST(sum(CAST(c_custkey AS BIGINT)) AS BIGINT) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS solvent FROM customer GROUP BY 1")
def counter_prefix_sums(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("tag")).agg(F.sum("c_custkey").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("solvent"))


@query("SELECT l_suppkey AS store, string_agg(DISTINCT CAST(l_orderkey % 10 AS VARCHAR), ',' ORDER BY CAST(l_orderkey % 10 AS VARCHAR)) AS partitions FROM lineitem GROUP BY 1")
def distinct_partitions(spark: Spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("store")).agg(F.array_join(F.array_sort(F.collect_set((F.col("l_orderkey") % 10).cast("string"))), ",").alias("partitions"))
    return li


@query("SELECT l_orderkey % 100 AS x FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_orderkey % 100 FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O'")
def list_subtract(spark: Spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    one = lambda cond: li.where(cond).select((F.col("l_orderkey") % 100).alias("x"))
    return one("l_returnflag = 'A'").exceptAll(one("l_returnflag = 'N' and l_linestatus = 'O'"))


@query("SELECT coalesce(c_custkey, s_suppkey) AS key, coalesce(s_name, c_name) AS value FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def store_merge(spark: Spark, sf_dir: str) -> DataFrame:
    """A keyed merge of two stores; the second wins."""
    a, b = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return a.join(b, F.col("c_custkey") == F.col("s_suppkey"), "full").select(F.coalesce("c_custkey", "s_suppkey").alias("key"), F.coalesce("s_name", "c_name").alias("value"))


@query("SELECT o_custkey AS owner FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def wallet_lookup(spark: Spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner")).distinct()
    return o.join(table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("owner")), "owner", "left_semi")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_txs(spark: Spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(li, "id", "left_anti")


@query("SELECT DISTINCT address FROM (SELECT o_custkey AS address FROM orders UNION ALL SELECT l_suppkey FROM lineitem)")
def distinct_addresses(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("address")).unionAll(table(spark, sf_dir, "lineitem").select("l_suppkey")).distinct()


@query("SELECT o_orderkey AS height FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE (r - 1) % 4 = 0")
def every_nth(spark: Spark, sf_dir: str) -> DataFrame:
    r = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("height"), r.alias("r")).where("(r - 1) % 4 = 0").select("height")


@query("SELECT DISTINCT o_custkey AS owner, nth_value(o_orderkey, 2) OVER w AS second, last_value(o_orderkey) OVER w AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def nth_and_last(spark: Spark, sf_dir: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.nth_value("o_orderkey", 2).over(w).alias("second"), F.last("o_orderkey").over(w).alias("last")).distinct()


@query("SELECT o_orderkey AS height, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS depth, CASE WHEN row_number() OVER (ORDER BY o_orderkey DESC) <= 3 THEN 'pending' ELSE 'received' END AS state FROM orders ORDER BY height DESC LIMIT 20")
def recent_blocks(spark: Spark, sf_dir: str) -> DataFrame:
    newest = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("height")).orderBy(F.desc("height")).limit(20)
    r = F.row_number().over(W.orderBy(F.desc("height")))  # of twenty rows
    return newest.select("height", (r - 1).alias("depth"), F.when(r <= 3, "pending").otherwise("received").alias("state"))

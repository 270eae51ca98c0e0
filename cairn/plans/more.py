"""Further queries: folds along histories, trees, samples, caches, states and ciphers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators import intervals, ordered
from cairn.plans import views
from cairn.plans.ledger import _PEND, _pending
from cairn.plans.registry import query
from cairn.plans.views import sql
from cairn.sources.tables import table

Spark = SparkSession


@query(f"{sql('rec', 'merged')} SELECT set_id, bool_or(\"start\" <= 1000 AND \"end\" >= 1010) AS has FROM merged GROUP BY set_id")
def coverage_has_range(spark: Spark, sf_dir: str) -> DataFrame:
    m = intervals.merge(views.sync_record(spark, sf_dir))
    return m.groupBy("set_id").agg(F.bool_or((F.col("start") <= 1000) & (F.col("end") >= 1010)).alias("has"))


@query("WITH RECURSIVE rec AS (SELECT l_suppkey % 5 AS set_id, l_orderkey * 10 AS \"start\", l_orderkey * 10 + CAST(l_quantity AS BIGINT) AS \"end\" FROM lineitem), " + views.SQL["merged"] + " SELECT * FROM merged")
def sync_record_merge(spark: Spark, sf_dir: str) -> DataFrame:
    """Records of several stores put together."""
    return intervals.merge(views.sync_record(spark, sf_dir).withColumn("set_id", F.col("set_id") % 5))


@query(f"""{sql('rec', 'merged')}, t AS (SELECT DISTINCT l_suppkey AS set_id, l_orderkey * 10 AS s, l_orderkey * 10 + 20 AS e FROM lineitem) SELECT t.set_id, t.s, t.e, bool_or(m."start" <= t.s AND m."end" >= t.e) AS synced FROM t JOIN merged m ON m.set_id = t.set_id GROUP BY 1, 2, 3""")
def tx_data_synced(spark: Spark, sf_dir: str) -> DataFrame:
    """Whether a transaction's whole range is stored: within the last interval that begins at or before it."""
    m = intervals.merge(views.sync_record(spark, sf_dir))
    t = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("set_id"), (F.col("l_orderkey") * 10).alias("s")).distinct()
    both = m.select("set_id", F.col("start").alias("at"), "end", F.lit(0).alias("kind")).unionByName(t.select("set_id", F.col("s").alias("at"), F.lit(None).cast("long").alias("end"), F.lit(1).alias("kind")))
    reach = F.max("end").over(W.partitionBy("set_id").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("reach", reach).where("kind = 1").select("set_id", F.col("at").alias("s"), (F.col("at") + 20).alias("e"), F.coalesce(F.col("reach") >= F.col("at") + 20, F.lit(False)).alias("synced"))


@query(f"WITH {_PEND} SELECT anchor, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY reward DESC, id) FILTER (WHERE r <= 3) AS best FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY reward DESC, id) AS r FROM pend) GROUP BY anchor")
def mempool_rebuild(spark: Spark, sf_dir: str) -> DataFrame:
    """Sizes and the head of each priority set, derived from the rows."""
    r = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("reward"), "id"))
    p = _pending(spark, sf_dir).withColumn("r", r)
    head = F.sort_array(F.collect_list(F.when(F.col("r") <= 3, F.struct("r", "id"))))
    return p.groupBy("anchor").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(head, lambda x: x["id"].cast("string")), ",").alias("best"))


@query("SELECT o_custkey AS miner, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey DESC) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 4 GROUP BY 1")
def history_suffix(spark: Spark, sf_dir: str) -> DataFrame:
    r = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")))
    o = table(spark, sf_dir, "orders").withColumn("r", r).where("r <= 4").groupBy(F.col("o_custkey").alias("miner"))
    return o.agg(F.sort_array(F.collect_list(F.struct("r", "o_orderkey"))).alias("x")).select("miner", F.array_join(F.transform("x", lambda x: x["o_orderkey"].cast("string")), ",").alias("recent"))


@query("SELECT l_suppkey AS store, CAST(bit_or(CAST(1 AS BIGINT) << CAST(l_orderkey % 60 AS INTEGER)) AS BIGINT) AS bits, count(*) FILTER (WHERE l_returnflag = 'A') AS occurrences FROM lineitem GROUP BY 1")
def bit_positions(spark: Spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("bit", F.expr("shiftleft(1L, cast(l_orderkey % 60 as int))"))
    return li.groupBy(F.col("l_suppkey").alias("store")).agg(F.bit_or("bit").alias("bits"), F.count_if(F.col("l_returnflag") == "A").alias("occurrences"))


_U = "CAST('0x' || substr(md5('u' || CAST(user_id AS VARCHAR)), 1, 6) AS BIGINT)"


@query(f"WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id AS peer, {_U} * n AS weight FROM s ORDER BY weight DESC, peer LIMIT 10")
def weighted_rank(spark: Spark, sf_dir: str) -> DataFrame:
    """A random order weighted by rating; the random part comes from a hash."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit("u"), F.col("user_id").cast("string")).cast("binary")), 1, 6), 16, 10).cast("long")
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.col("user_id").alias("peer"), (u * F.col("n")).alias("weight")).orderBy(F.desc("weight"), "peer").limit(10)


@query(f"WITH s AS (SELECT user_id, ntile(5) OVER (ORDER BY user_id) AS fifth FROM (SELECT DISTINCT user_id FROM events)), r AS (SELECT *, row_number() OVER (PARTITION BY fifth = 1 ORDER BY {_U}, user_id) AS r FROM s) SELECT user_id AS peer FROM r WHERE r <= CASE WHEN fifth = 1 THEN 8 ELSE 2 END")
def sample_80_20(spark: Spark, sf_dir: str) -> DataFrame:
    """Most of a sample from the first fifth of the peers, the rest from the others."""
    u = F.md5(F.concat(F.lit("u"), F.col("user_id").cast("string")).cast("binary"))
    ranked = ordered.running(table(spark, sf_dir, "events").select("user_id").distinct(), ["user_id"], {"rank": ("sum", F.lit(1))})
    n = ranked.agg(F.max("rank").alias("n"))
    s = ranked.crossJoin(F.broadcast(n)).select("user_id", F.expr("rank <= (n + 4) div 5").alias("first"))  # one row
    r = F.row_number().over(W.partitionBy("first").orderBy(F.substring(u, 1, 6), "user_id"))
    return s.withColumn("r", r).where("r <= if(first, 8, 2)").select(F.col("user_id").alias("peer"))


@query("SELECT o_orderkey AS id FROM (SELECT *, sum(o_orderkey % 997) OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS used FROM orders) WHERE used > 20000")
def evict_oldest(spark: Spark, sf_dir: str) -> DataFrame:
    """What leaves each cache so that the newest stay within its budget."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 16).alias("cache"), (-F.unix_date(F.col("o_orderdate").cast("date"))).cast("long").alias("age"), (-F.col("o_orderkey")).alias("nth"), (F.col("o_orderkey") % 997).alias("size"))
    return ordered.running(o, ["age", "nth"], {"used": ("sum", F.col("size"))}, ["cache"], 4).where("used > 20000").select((-F.col("nth")).alias("id"))


@query("SELECT s_suppkey AS id, CAST(s_nationkey AS VARCHAR) AS a, s_name AS b, CASE WHEN s_suppkey % 2 = 0 THEN 'two' END AS c FROM supplier")
def config_merge(spark: Spark, sf_dir: str) -> DataFrame:
    """Maps laid over each other; the later one wins where it has a value."""
    s = table(spark, sf_dir, "supplier")
    base = F.create_map(F.lit("a"), F.lit("0"), F.lit("b"), F.col("s_name"))
    over = F.create_map(F.lit("a"), F.col("s_nationkey").cast("string"), F.lit("c"), F.when(F.col("s_suppkey") % 2 == 0, "two"))
    both = F.map_zip_with(base, over, lambda k, x, y: F.coalesce(y, x))
    return s.select(F.col("s_suppkey").alias("id"), both["a"].alias("a"), both["b"].alias("b"), both["c"].alias("c"))


@query(f"{sql('forks')} SELECT miner, count(*) AS blocks, max(height) AS last, max(height) - min(height) AS span FROM forks GROUP BY miner")
def by_miner(spark: Spark, sf_dir: str) -> DataFrame:
    return views.forks(spark, sf_dir).groupBy("miner").agg(F.count(F.lit(1)).alias("blocks"), F.max("height").alias("last"), (F.max("height") - F.min("height")).alias("span"))


@query(f"{sql('forks')} SELECT height FROM forks ORDER BY height DESC LIMIT 1 OFFSET 49")
def checkpoint(spark: Spark, sf_dir: str) -> DataFrame:
    """The fiftieth block from the tip."""
    newest = views.forks(spark, sf_dir).select("height").orderBy(F.desc("height")).limit(50)
    return newest.agg(F.min("height").alias("height"))


@query("SELECT c_custkey AS address, sha256(c_name) AS hash, CAST(c_custkey * 12 * 200 // 1000 AS BIGINT) AS yearly, lower(hex(CAST(c_custkey AS BIGINT))) AS hexed FROM customer")
def address_hash(spark: Spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("address"), F.sha2(F.col("c_name").cast("binary"), 256).alias("hash"), F.expr("c_custkey * 12 * 200 div 1000").alias("yearly"), F.lower(F.hex("c_custkey")).alias("hexed"))


@query("SELECT p_partkey AS id, p_name AS back, length(p_name) AS n, true AS clean FROM part")
def pad_unpad(spark: Spark, sf_dir: str) -> DataFrame:
    """Padded with zero bytes to 64, and back; what is cut off has to be zeros."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").cast("binary").alias("b"))
    padded = p.withColumn("n", F.octet_length("b")).withColumn("x", F.expr("rpad(b, 64, X'00')"))
    cut = padded.select("id", F.expr("substring(x, 1, n)").cast("string").alias("back"), F.col("n").cast("long").alias("n"), (F.regexp_replace(F.hex(F.expr("substring(x, n + 1)")), "0", "") == "").alias("clean"))
    return cut


@query("SELECT user_id AS peer, event_id, CAST(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) - epoch_us(ts) > 7200000000 AS BOOLEAN) AS expired FROM events")
def state_ttl(spark: Spark, sf_dir: str) -> DataFrame:
    """Whether a peer's state ran out before its next event."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    nxt = F.lead(us).over(W.partitionBy("user_id").orderBy("ts"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("peer"), "event_id", (nxt - us > 7200000000).alias("expired"))


@query(f"{sql('pe')} SELECT a.event_id AS waiting, min(b.event_id) AS found FROM pe a JOIN pe b ON a.peer = b.peer AND a.event_type = 'signup' AND b.event_type = 'purchase' AND b.us > a.us AND b.us - a.us <= 7200000000 GROUP BY 1")
def pending_join(spark: Spark, sf_dir: str) -> DataFrame:
    """Events that wait for another of their peer within two hours; joined on peer and time bucket."""
    e = views.peer_events(spark, sf_dir).withColumn("b", F.expr("us div 7200000000"))
    a = e.where("event_type = 'signup'").select("peer", F.col("event_id").alias("waiting"), F.col("us").alias("t"), F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"))
    p = e.where("event_type = 'purchase'").select("peer", "b", "event_id", "us")
    return a.join(p, ["peer", "b"]).where("us > t and us - t <= 7200000000").groupBy("waiting").agg(F.min("event_id").alias("found"))


@query(f"{sql('rec', 'merged')}, t AS (SELECT set_id, CAST(sum(\"end\" - \"start\") AS BIGINT) AS total FROM merged GROUP BY 1), o AS (SELECT set_id, k, 1 + CAST('0x' || substr(md5(CAST(set_id AS VARCHAR) || '-' || CAST(k AS VARCHAR)), 1, 12) AS BIGINT) % total AS at FROM t, (SELECT unnest(range(0, 5)) AS k)), c AS (SELECT *, sum(\"end\" - \"start\") OVER (PARTITION BY set_id ORDER BY \"start\" ROWS UNBOUNDED PRECEDING) AS cum FROM merged) SELECT DISTINCT o.set_id, c.\"start\", c.\"end\" FROM o JOIN c ON c.set_id = o.set_id AND o.at <= c.cum AND o.at > c.cum - (c.\"end\" - c.\"start\")")
def interval_sample(spark: Spark, sf_dir: str) -> DataFrame:
    """Intervals hit by five offsets each, drawn by hash over the covered length: long ones are likelier."""
    m = intervals.merge(views.sync_record(spark, sf_dir))
    cum = F.sum(F.col("end") - F.col("start")).over(W.partitionBy("set_id").orderBy("start").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum(F.col("end") - F.col("start")).over(W.partitionBy("set_id"))
    rows = m.withColumns({"cum": cum, "total": total})
    draw = lambda k: 1 + F.conv(F.substring(F.md5(F.concat_ws("-", "set_id", k.cast("string")).cast("binary")), 1, 12), 16, 10).cast("long") % F.col("total")
    hit = F.exists(F.sequence(F.lit(0), F.lit(4)), lambda k: (draw(k) <= F.col("cum")) & (draw(k) > F.col("cum") - (F.col("end") - F.col("start"))))
    return rows.where(hit).select("set_id", "start", "end")


@query("SELECT o_custkey % 20 AS device, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1 ORDER BY total DESC, device LIMIT 7")
def device_order(spark: Spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("device")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total"))
    return o.orderBy(F.desc("total"), "device").limit(7)


@query("SELECT c_custkey AS address, arg_min(o_orderkey, o_orderkey % 50) AS anchor FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderkey % 50 < 0) = 0 AND min(o_orderkey % 50) < 10 AND count(*) = count(DISTINCT o_orderkey % 50)")
def anchor_order(spark: Spark, sf_dir: str) -> DataFrame:
    """For accounts without repeated anchors, the order whose anchor comes first."""
    a = F.col("o_orderkey") % 50
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.min_by("o_orderkey", a).alias("anchor"), F.min(a).alias("m"), F.count(F.lit(1)).alias("n"), F.countDistinct(a).alias("d"))
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("c")).where("m < 10 and n = d").select(F.col("c_custkey").alias("address"), "anchor")

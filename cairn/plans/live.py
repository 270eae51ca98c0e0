"""Queries on states that events keep up: intervals, delays, bans, caches, subscriptions, sinks and state machines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import scalars
from cairn.operators import folds, intervals, ordered
from cairn.plans import sync, views
from cairn.plans.registry import ORACLES, query
from cairn.plans.views import sql
from cairn.sources.tables import table
from cairn.streaming import jobs

Spark = SparkSession


def _advance(before: DataFrame, ops: DataFrame) -> DataFrame:
    """Intervals after a batch of operations: those before count as additions that are older than all of them."""
    old = before.select("key", F.lit(-1).cast("long").alias("seq"), "start", "end", F.lit(True).alias("adds"))
    return intervals.replayed(old.unionByName(ops), ["key"], "seq", "adds")


def _interval_versions(spark: Spark, sf_dir: str) -> tuple[str, int]:
    ops = sync.interval_ops(spark, sf_dir)
    first = spark.createDataFrame([], "key long, start long, end long")
    return jobs.kept_up(jobs.replayed(ops, "seq", 3, "operations"), "intervals", first, _advance)


@query(ORACLES["interval_log"])
def stream_interval_state(spark: Spark, sf_dir: str) -> DataFrame:
    """A stored interval set that every batch of additions and removals is applied to."""
    out, last = _interval_versions(spark, sf_dir)
    return spark.read.schema("key long, start long, end long").parquet(f"{out}/_n={last}")


_FINAL = ORACLES["interval_log"]


@query(f"""WITH fin AS ({_FINAL}), b AS (SELECT key, "start", "end", unnest(generate_series("start" // 500, ("end" - 1) // 500)) AS bucket FROM fin) SELECT key, bucket, least(1.0, sum(least("end", (bucket + 1) * 500) - greatest("start", bucket * 500)) / 500.0) AS share FROM b GROUP BY 1, 2""")
def bucket_snapshots(spark: Spark, sf_dir: str) -> DataFrame:
    """The last of the snapshots that are taken of a kept-up interval set, as shares of buckets."""
    out, last = _interval_versions(spark, sf_dir)
    return intervals.shares(spark.read.schema("key long, start long, end long").parquet(f"{out}/_n={last}"), 500, ["key"])


@query("""WITH ops AS (SELECT l_suppkey % 7 AS key, l_orderkey AS seq, l_orderkey * 13 % 5000 AS "start", l_orderkey * 13 % 5000 + CAST(l_quantity AS BIGINT) AS "end" FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'R'),
pts AS (SELECT key, p, min(seq) AS seq FROM (SELECT key, seq, unnest(generate_series("start" + 1, "end")) AS p FROM ops) GROUP BY 1, 2), tx AS (SELECT DISTINCT l_suppkey % 7 AS key, l_orderkey % 4990 AS "start", l_orderkey % 4990 + 12 AS "end" FROM lineitem)
SELECT tx.key, tx."start", tx."end", CASE WHEN count(pts.p) = 12 THEN max(pts.seq) END AS synced_at FROM tx LEFT JOIN pts ON pts.key = tx.key AND pts.p > tx."start" AND pts.p <= tx."end" GROUP BY 1, 2, 3""")
def tx_synced_at(spark: Spark, sf_dir: str) -> DataFrame:
    """When a transaction's whole range had come in: the latest of its pieces' first arrivals, null if one is missing."""
    ops = sync.interval_ops(spark, sf_dir).where("adds")
    borders = ops.select("key", F.explode(F.array("start", "end")).alias("at")).distinct()
    pieces = ordered.running(borders, ["at"], {"end": ("min_after", F.col("at"))}, ["key"], intervals.CELL).where("end is not null").select("key", F.col("at").alias("start"), "end")
    first = intervals.overlap_join(pieces, ops.select("key", "start", "end", "seq"), ["key"]).groupBy("key", "start", "end").agg(F.min("b_seq").alias("seq"))
    at = F.col("l_orderkey") % 4990
    tx = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("key"), at.alias("start"), (at + 12).alias("end")).distinct()
    met = intervals.overlap_join(tx, first, ["key"]).groupBy("key", "start", "end").agg(F.sum(F.least("end", "b_end") - F.greatest("start", "b_start")).alias("covered"), F.max("b_seq").alias("seq"))
    return tx.join(met, ["key", "start", "end"], "left").select("key", "start", "end", F.when(F.col("covered") == F.col("end") - F.col("start"), F.col("seq")).alias("synced_at"))


@query(f"{sql('pe')} SELECT event_id, CASE WHEN us + 86400000000 <= (SELECT max(us) FROM pe) THEN 'ready' ELSE 'pending' END AS state FROM pe")
def tx_ready_delay(spark: Spark, sf_dir: str) -> DataFrame:
    """Transactions may be used once a delay has passed, by the time of the newest event."""
    e = views.peer_events(spark, sf_dir)
    now = e.agg(F.max("us").alias("now"))
    return e.crossJoin(F.broadcast(now)).select("event_id", F.when(F.col("us") + 86_400_000_000 <= F.col("now"), "ready").otherwise("pending").alias("state"))  # one row


@query(f"{sql('pe')} SELECT peer, max(us) AS last, max(us) + 172800000000 < (SELECT max(us) FROM pe) AS forgotten FROM pe GROUP BY peer")
def leaky_cleanup(spark: Spark, sf_dir: str) -> DataFrame:
    """Which peers' limiter states are dropped for having been idle."""
    e = views.peer_events(spark, sf_dir)
    last = e.groupBy("peer").agg(F.max("us").alias("last"))
    return last.crossJoin(F.broadcast(last.agg(F.max("last").alias("now")))).select("peer", "last", (F.col("last") + 172_800_000_000 < F.col("now")).alias("forgotten"))  # one row


@query(f"{sql('pe')}, b AS (SELECT peer, max(us) + 3 * 86400000000 AS until FROM pe WHERE success = 0 GROUP BY peer) SELECT peer, until, until > (SELECT max(us) FROM pe) AS banned FROM b")
def banned_peers(spark: Spark, sf_dir: str) -> DataFrame:
    """Bans last three days from the last offence."""
    e = views.peer_events(spark, sf_dir)
    bans = e.where("success = 0").groupBy("peer").agg((F.max("us") + 3 * 86_400_000_000).alias("until"))
    return bans.crossJoin(F.broadcast(e.agg(F.max("us").alias("now")))).select("peer", "until", (F.col("until") > F.col("now")).alias("banned"))  # one row


@query(f"{sql('pe')}, l AS (SELECT peer, event_type, arg_max(event_id, struct_pack(a := us, b := event_id)) AS event_id, max(us) AS us FROM pe GROUP BY 1, 2) SELECT peer, event_type, event_id FROM l WHERE us + 2 * 86400000000 >= (SELECT max(us) FROM pe)")
def peer_cache(spark: Spark, sf_dir: str) -> DataFrame:
    """The newest entry of each peer and kind; one older than two scans has expired."""
    e = views.peer_events(spark, sf_dir)
    last = e.groupBy("peer", "event_type").agg(F.max(F.struct("us", "event_id")).alias("x"))
    now = e.agg(F.max("us").alias("now"))
    return last.crossJoin(F.broadcast(now)).where("x.us + 2 * 86400000000 >= now").select("peer", "event_type", "x.event_id")  # one row


@query(f"{sql('pe')}, subs AS (SELECT DISTINCT subnet, event_type FROM pe WHERE success = 1 AND subnet < 6) SELECT s.subnet AS subscriber, pe.event_type AS topic, count(*) AS received, min(event_id) AS first FROM pe JOIN subs s ON s.event_type = pe.event_type AND s.subnet <> pe.subnet GROUP BY 1, 2")
def event_fanout(spark: Spark, sf_dir: str) -> DataFrame:
    """What each subscriber of a topic receives: all that others send.

    All of a topic less what the subscriber sent itself, so that no event is copied for each subscriber.
    """
    e = views.peer_events(spark, sf_dir)
    subs = e.where("success = 1 and subnet < 6").select(F.col("subnet").alias("subscriber"), F.col("event_type").alias("topic")).distinct()
    sent = e.groupBy(F.col("event_type").alias("topic"), "subnet").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    met = subs.join(sent, "topic").where("subscriber <> subnet")  # senders are subnets, few of them
    return met.groupBy("subscriber", "topic").agg(F.sum("n").alias("received"), F.min("first").alias("first"))


@query(f"{sql('pe')} SELECT event_type AS topic, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM pe GROUP BY 1")
def stream_fanout(spark: Spark, sf_dir: str) -> DataFrame:
    """Events handed on to a folder per topic, batch by batch, each once."""
    e = views.peer_events(spark, sf_dir).select("event_id", "event_type", "us")
    out: list[str] = []

    def batch(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").partitionBy("event_type").parquet(f"{out[0]}/_n={n}")

    out.append(jobs.shared_path(spark, "topics"))
    jobs.run(jobs.replayed(e, "event_id", 3, "published"), "fanout", "append", batch)
    return spark.read.parquet(out[0]).groupBy(F.col("event_type").alias("topic")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))


@query("SELECT o_orderkey AS id, o_custkey AS owner FROM orders WHERE o_orderdate > DATE '1996-01-01' EXCEPT SELECT l_orderkey, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 45")
def poll_diff(spark: Spark, sf_dir: str) -> DataFrame:
    """What a poll finds that the last one hadn't."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), "o_orderdate")
    known = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id")).distinct()
    return o.where("o_orderdate > date'1996-01-01'").join(known, "id", "left_anti").select("id", "owner")


_NEXT = {("needs_chunk", True): "has_chunk", ("needs_chunk", False): "error", ("has_chunk", True): "needs_entropy", ("has_chunk", False): "done", ("needs_entropy", True): "has_entropy", ("needs_entropy", False): "needs_entropy", ("has_entropy", True): "needs_write", ("has_entropy", False): "error", ("needs_write", True): "done", ("needs_write", False): "needs_write"}
_FLAG = {"needs_chunk": "o_orderkey % 13 <> 0", "has_chunk": "o_orderkey % 5 <> 0", "needs_entropy": "o_custkey % 7 <> 0", "has_entropy": "o_custkey % 11 <> 0", "needs_write": "o_orderkey % 3 <> 0"}
_STEP = "CASE " + " ".join(f"WHEN state = '{s}' AND {'' if ok else 'NOT '}({_FLAG[s]}) THEN '{n}'" for (s, ok), n in _NEXT.items()) + " ELSE state END"


@query(f"""WITH RECURSIVE r AS (SELECT o_orderkey, o_custkey, 'needs_chunk' AS state, 0 AS steps, true AS moved FROM orders UNION ALL SELECT o_orderkey, o_custkey, {_STEP}, steps + 1, ({_STEP}) <> state FROM r WHERE moved) SELECT o_orderkey AS id, arg_max(state, steps) AS state, CAST(max(steps) - 1 AS INTEGER) AS steps FROM r GROUP BY 1""")
def fixpoint_state(spark: Spark, sf_dir: str) -> DataFrame:
    """The state machine of a chunk that is packed anew, run until it rests."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit("needs_chunk").alias("state"), F.lit(0).alias("steps"))
    for _ in _FLAG:  # no path is longer than there are states
        o = o.withColumn("next", F.expr(_STEP)).select("o_orderkey", "o_custkey", F.col("next").alias("state"), (F.col("steps") + (F.col("next") != F.col("state")).cast("int")).alias("steps"))
    return o.select(F.col("o_orderkey").alias("id"), "state", "steps")


@query("""SELECT c_custkey AS id, ['name', 'phone', 'balance', 'secret'][1 + c_custkey % 4] AS field, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment WHEN 2 THEN CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) ELSE 'invalid_field' END AS value FROM customer""")
def field_projection(spark: Spark, sf_dir: str) -> DataFrame:
    """One field of a row by its name, if it is one of those that may be asked for."""
    k = F.col("c_custkey") % 4
    field = F.element_at(F.array(*map(F.lit, ("name", "phone", "balance", "secret"))), (k + 1).cast("int"))
    known = F.create_map(F.lit("name"), F.col("c_name"), F.lit("phone"), F.col("c_mktsegment"), F.lit("balance"), F.round(F.col("c_acctbal") * 100).cast("long").cast("string"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), field.alias("field"), known.alias("known"))
    return c.select("id", "field", F.coalesce(F.try_element_at("known", F.col("field")), F.lit("invalid_field")).alias("value"))


@query(f"{sql('blocks')} SELECT height, CAST(reward AS VARCHAR) || '000000000000' AS reward, rtrim(replace(replace(to_base64(encode('block-' || height)), '+', '-'), '/', '_'), '=') AS id, size, (SELECT count(*) FROM lineitem WHERE l_orderkey = height) AS txs, true AS same FROM blocks")
def block_json(spark: Spark, sf_dir: str) -> DataFrame:
    """Blocks with their transactions as JSON, big numbers as text and binaries in base 64 for URLs, and read back field by field."""
    txs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("height")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_suppkey").cast("string").alias("target")))).alias("txs"))
    b = views.blocks(spark, sf_dir).join(txs, "height", "left")
    raw = F.concat(F.lit("block-"), F.col("height").cast("string")).cast("binary")
    fields = F.struct("height", F.concat(F.col("reward").cast("string"), F.lit("000000000000")).alias("reward"), scalars.base64url(raw).alias("id"), "size", F.coalesce("txs", F.array().cast("array<struct<line:int,target:string>>")).alias("txs"))
    text = b.select(fields.alias("was"), F.to_json(fields).alias("json"))
    back = F.from_json("json", "height long, reward string, id string, size long, txs array<struct<line:int,target:string>>")
    r = text.withColumn("x", back)
    same = (scalars.from_base64url(F.col("x.id")) == F.concat(F.lit("block-"), F.col("was.height").cast("string")).cast("binary")) & (F.to_json("x") == F.col("json"))
    return r.select("x.height", "x.reward", "x.id", "x.size", F.size("x.txs").cast("long").alias("txs"), same.alias("same"))


@query(f"{sql('pe')} SELECT event_id, least(3, 1 + event_id % 5) AS tries, event_id % 5 < 3 AS delivered FROM pe WHERE event_type = 'purchase'")
def stream_webhook_retry(spark: Spark, sf_dir: str) -> DataFrame:
    """Events delivered to a sink that fails at times: each is tried three times at most, and what came of it is kept."""
    e = views.peer_events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "peer")

    def deliver(event: int, attempt: int) -> bool:
        return attempt > event % 5  # stands for a call to a server

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tries, delivered = [], []
            for event in b.column("event_id").to_pylist():
                n = next((k for k in (1, 2, 3) if deliver(event, k)), None)
                tries.append(n or 3)
                delivered.append(n is not None)
            yield pa.RecordBatch.from_arrays([b.column("event_id"), pa.array(tries, pa.int64()), pa.array(delivered, pa.bool_())], ["event_id", "tries", "delivered"])

    kind = "event_id long, tries long, delivered boolean"
    out = jobs.shared_path(spark, "delivered")
    jobs.run(jobs.replayed(e, "event_id", 2, "purchases"), "webhook", "append", lambda rows, n: rows.mapInArrow(sent, kind).write.mode("overwrite").parquet(f"{out}/_n={n}"))
    return spark.read.schema(kind).parquet(out).select("event_id", "tries", "delivered")


@query(f"""{sql('rec', 'merged')}, probes AS (SELECT DISTINCT o_orderkey * 10 + 5 AS p, o_custkey % 9 <> 0 AS sound FROM orders), hit AS (SELECT p, sound FROM probes WHERE EXISTS (SELECT 1 FROM merged WHERE "start" < p AND p <= "end") ORDER BY md5('s' || CAST(p AS VARCHAR)), p LIMIT 200) SELECT count(*) AS sampled, count(*) FILTER (WHERE sound) AS good, round(100.0 * count(*) FILTER (WHERE sound) / count(*), 6) AS percent FROM hit""")
def sample_report(spark: Spark, sf_dir: str) -> DataFrame:
    """A sample without replacement of offsets at which a chunk is recorded, and how many chunks are sound."""
    probes = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 10 + 5).alias("p"), (F.col("o_custkey") % 9 != 0).alias("sound")).distinct()
    held = intervals.containing(probes, "p", views.merged_record(spark, sf_dir)).select("p", "sound").distinct()
    picked = held.orderBy(F.md5(F.concat(F.lit("s"), F.col("p").cast("string")).cast("binary")), "p").limit(200)
    good = F.count_if("sound")
    return picked.agg(F.count(F.lit(1)).alias("sampled"), good.alias("good"), F.round(100.0 * good / F.count(F.lit(1)), 6).alias("percent"))


@query("SELECT l_suppkey AS store, count(*) AS n, count(DISTINCT l_partkey) AS distinct_n, count(*) <> count(DISTINCT l_partkey) AS duplicates FROM lineitem GROUP BY 1")
def list_duplicates(spark: Spark, sf_dir: str) -> DataFrame:
    """Whether a list repeats an element."""
    pairs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("store"), "l_partkey").agg(F.count(F.lit(1)).alias("k"))
    return pairs.groupBy("store").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("distinct_n"), (F.max("k") > 1).alias("duplicates"))


@query("""WITH RECURSIVE o AS (SELECT o_custkey AS address, o_orderkey % 1000 AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders), c AS (SELECT address, r, (7 * 3 + d) % 100003 AS v FROM o WHERE r = 1 UNION ALL SELECT o.address, o.r, (c.v * 3 + o.d) % 100003 FROM c JOIN o ON o.address = c.address AND o.r = c.r + 1) SELECT address, arg_max(v, r) AS value, max(r) AS diffs FROM c GROUP BY address""")
def diff_apply(spark: Spark, sf_dir: str) -> DataFrame:
    """A state rebuilt from its diffs in order by a function of the user's."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("address"), F.col("o_orderkey").alias("version"), (F.col("o_orderkey") % 1000).alias("d"))

    def step(state: tuple[int, int], row: tuple) -> tuple[tuple[int, int], list]:
        return ((state[0] * 3 + row[1]) % 100_003, state[1] + 1), []

    return folds.folded(o, ["address"], ["version"], "address long, value long, diffs long", lambda: (7, 0), step, lambda s: [s])


@query("WITH t AS (SELECT c_custkey AS key, CAST(round(c_acctbal * 100) AS BIGINT) AS value FROM customer WHERE c_custkey % 10 <> 3 UNION ALL SELECT s_suppkey + 1000000, s_nationkey FROM supplier), w AS (SELECT key FROM t WHERE key >= (SELECT min(c_custkey) + 20 FROM customer)) SELECT key, value FROM t WHERE key IN (SELECT key FROM w ORDER BY key LIMIT 30) ORDER BY key DESC")
def trie_range(spark: Spark, sf_dir: str) -> DataFrame:
    """An ordered map after insertions and deletions: so many entries from a key on, the last first."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.round(F.col("c_acctbal") * 100).cast("long").alias("value"))
    gone = c.where("key % 10 = 3").select("key")
    added = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("key"), F.col("s_nationkey").cast("long").alias("value"))
    start = c.agg((F.min("key") + 20).alias("from"))
    t = c.join(gone, "key", "left_anti").unionByName(added)
    return t.crossJoin(F.broadcast(start)).where("key >= from").orderBy("key").limit(30).orderBy(F.desc("key")).select("key", "value")  # one row


@query("SELECT c_custkey AS address, c_custkey % 3 AS base, CAST(c_custkey AS HUGEINT) * CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000000 ELSE 1000 END AS amount FROM customer")
def denominations(spark: Spark, sf_dir: str) -> DataFrame:
    """Amounts in the third denomination, over as many steps as lie between; base 0 stands for amounts that are never changed."""
    base = F.col("c_custkey") % 3
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("address"), base.alias("base"), scalars.redenominated(F.col("c_custkey"), base, 3).cast("decimal(38,0)").alias("amount"))


@query(f"{sql('pe')} SELECT us // 86400000000 AS day, peer, count(*) AS n, count(*) FILTER (WHERE success = 0) AS failed FROM pe GROUP BY 1, 2")
def access_log(spark: Spark, sf_dir: str) -> DataFrame:
    """A row per request appended to a log by day, and what the log says of each peer."""
    e = views.peer_events(spark, sf_dir).select("peer", "success", F.expr("us div 86400000000").alias("day"))
    path = jobs.shared_path(spark, "access")
    e.repartition("day").write.partitionBy("day").parquet(path)
    log = spark.read.schema("peer long, success int, day long").parquet(path)
    return log.groupBy("day", "peer").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("success") == 0).alias("failed"))


@query("SELECT l_suppkey AS store, CASE WHEN l_suppkey % 4 = 0 THEN 'sync' WHEN l_suppkey % 4 = 1 THEN 'prepare' WHEN l_suppkey % 4 = 2 THEN 'repack' ELSE 'complete' END AS state, l_suppkey % 3 AS device, row_number() OVER (PARTITION BY l_suppkey % 3 ORDER BY l_suppkey % 4, l_suppkey) AS turn FROM (SELECT DISTINCT l_suppkey FROM lineitem)")
def lock_order(spark: Spark, sf_dir: str) -> DataFrame:
    """The order in which the stores of a device get its lock: by their state, then by number."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("store")).distinct()
    k = F.col("store") % 4
    turn = F.row_number().over(W.partitionBy(F.col("store") % 3).orderBy(k, "store"))
    return s.select("store", F.when(k == 0, "sync").when(k == 1, "prepare").when(k == 2, "repack").otherwise("complete").alias("state"), (F.col("store") % 3).alias("device"), turn.alias("turn"))


@query("WITH c AS (SELECT l_suppkey % 5 AS worker, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY 1), t AS (SELECT l_suppkey % 5 AS worker, count(*) * 25 AS expected FROM lineitem GROUP BY 1) SELECT worker, bytes, bytes - expected AS drift FROM c JOIN t USING (worker)")
def worker_load(spark: Spark, sf_dir: str) -> DataFrame:
    """What each worker has to do, and how far its counter has drifted from it."""
    li = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("worker")).agg(F.sum(F.col("l_quantity").cast("long")).alias("bytes"), (F.count(F.lit(1)) * 25).alias("expected"))
    return li.select("worker", "bytes", (F.col("bytes") - F.col("expected")).alias("drift"))


@query("SELECT height, addr, reward, 'old' AS part FROM (SELECT o_orderkey AS height, o_custkey AS addr, CAST(round(o_totalprice * 100) AS BIGINT) AS reward FROM orders) WHERE height <= (SELECT max(o_orderkey) FROM orders) - 100 UNION ALL SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT), 'new' FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders) - 100")
def history_append(spark: Spark, sf_dir: str) -> DataFrame:
    """The newest blocks' elements appended to a stored history and read with it."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("height"), F.col("o_custkey").alias("addr"), F.round(F.col("o_totalprice") * 100).cast("long").alias("reward"))
    tip = F.broadcast(o.agg(F.max("height").alias("tip")))  # one row
    parts = o.crossJoin(tip).withColumn("part", F.when(F.col("height") <= F.col("tip") - 100, "old").otherwise("new")).drop("tip")
    path = jobs.shared_path(spark, "history")
    parts.where("part = 'old'").write.parquet(path)
    parts.where("part = 'new'").write.mode("append").parquet(path)
    return spark.read.schema(parts.schema).parquet(path)

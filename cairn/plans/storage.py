"""Queries on stored ranges, keys and the block index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators import intervals, ordered
from cairn.plans import views
from cairn.plans.registry import query
from cairn.plans.views import sql
from cairn.sources.tables import table

Spark = SparkSession


@query(f"{sql('blocks', 'idx')} SELECT height, size, start_offset, end_offset FROM idx")
def block_index(spark: Spark, sf_dir: str) -> DataFrame:
    return views.block_index(spark, sf_dir).select("height", "size", "start_offset", "end_offset")


@query(f"""{sql('blocks', 'idx')}, probes AS (SELECT p_partkey * 7 AS byte FROM part), tip AS (SELECT max(height) AS tip FROM blocks)
SELECT byte, height, start_offset, end_offset, tip - height + 1 AS confirmations FROM probes JOIN idx ON start_offset <= byte AND byte < end_offset, tip""")
def block_at_offset(spark: Spark, sf_dir: str) -> DataFrame:
    """The block that holds each byte (bounds are [start, end) here) and its confirmations."""
    idx = views.block_index(spark, sf_dir)
    spans = idx.where("size > 0").select("height", F.col("start_offset").alias("start"), F.col("end_offset").alias("end"))
    probes = table(spark, sf_dir, "part").select((F.col("p_partkey") * 7).alias("byte"), (F.col("p_partkey") * 7 + 1).alias("point"))
    tip = idx.agg(F.max("height").alias("tip"))
    found = intervals.containing(probes, "point", spans).crossJoin(F.broadcast(tip))  # one row
    return found.select("byte", F.col("b_height").alias("height"), F.col("b_start").alias("start_offset"), F.col("b_end").alias("end_offset"), (F.col("tip") - F.col("b_height") + 1).alias("confirmations"))


@query(f"""{sql('blocks', 'idx', 'txs')} SELECT line, target, txs.size, txs.reward, format, n, height, (SELECT max(height) FROM blocks) - height + 1 AS confirmations FROM txs JOIN idx USING (height)""")
def tx_status(spark: Spark, sf_dir: str) -> DataFrame:
    idx = views.block_index(spark, sf_dir)
    tip = idx.agg(F.max("height").alias("tip"))
    found = views.txs(spark, sf_dir).join(idx.select("height"), "height").crossJoin(F.broadcast(tip))  # one row
    return found.select("line", "target", "size", "reward", "format", "n", "height", (F.col("tip") - F.col("height") + 1).alias("confirmations"))


@query(f"{sql('blocks')} SELECT height, size, miner FROM blocks WHERE height BETWEEN 100 AND 1099 ORDER BY height DESC LIMIT 500")
def block_range_desc(spark: Spark, sf_dir: str) -> DataFrame:
    return views.blocks(spark, sf_dir).where("height between 100 and 1099").orderBy(F.desc("height")).limit(500).select("height", "size", "miner")


@query("SELECT user_id AS key, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY user_id")
def kv_latest(spark: Spark, sf_dir: str) -> DataFrame:
    """Upsert: the last write per key wins."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "value", "ts")
    return ordered.latest(e, ["key"], [F.desc("ts"), F.desc("event_id")]).select("key", "event_id", "value")


@query("SELECT k, (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey >= k) AS found FROM (SELECT p_partkey * 3 AS k FROM part)")
def kv_seek_next(spark: Spark, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("found"))
    return ordered.as_of(table(spark, sf_dir, "part").select((F.col("p_partkey") * 3).alias("k")), "k", keys, "found", [], True)


@query("SELECT k, (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey <= k) AS found FROM (SELECT p_partkey * 3 AS k FROM part)")
def kv_seek_prev(spark: Spark, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("found"))
    return ordered.as_of(table(spark, sf_dir, "part").select((F.col("p_partkey") * 3).alias("k")), "k", keys, "found", [], False)


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey // 64 IN (5, 6) AND o_orderkey >= 333 ORDER BY key LIMIT 1")
def kv_prefix_seek(spark: Spark, sf_dir: str) -> DataFrame:
    """The next key under its prefix or the one after, never further."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return o.where("key div 64 in (5, 6) and key >= 333").orderBy("key").limit(1)


@query("SELECT o_orderkey AS key, o_custkey AS value FROM orders WHERE NOT (o_orderkey >= 200 AND o_orderkey < 900)")
def range_delete(spark: Spark, sf_dir: str) -> DataFrame:
    """Range deletion leaves the end in, unlike range reads."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value"))
    return o.where("not (key >= 200 and key < 900)")


@query("SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_custkey IN (7, 70, 77)")
def kv_point_get(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.col("c_custkey").isin(7, 70, 77)).select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))


@query("SELECT p_partkey AS key FROM part WHERE p_partkey >= 50")
def kv_scan_from(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey >= 50").select(F.col("p_partkey").alias("key"))


@query("SELECT count(*) AS n FROM customer")
def kv_count(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def kv_delete(spark: Spark, sf_dir: str) -> DataFrame:
    """Deletion by a table of tombstones."""
    gone = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).join(gone, "key", "left_anti")


@query(f"""{sql('blocks')} SELECT height, size, 'old' AS part FROM blocks WHERE height < 1000 UNION ALL SELECT height, size + 1, 'new' FROM blocks WHERE height >= 1000""")
def block_index_replace_suffix(spark: Spark, sf_dir: str) -> DataFrame:
    """The index with its end replaced from the last common block on; an error if the new part leaves a gap."""
    b = views.blocks(spark, sf_dir)
    suffix = b.where("height >= 1000").select("height", (F.col("size") + 1).alias("size"), F.lit("new").alias("part"))
    kept = b.where("height < 1000").select("height", "size", F.lit("old").alias("part"))
    gap = kept.agg(F.max("height").alias("h")).crossJoin(F.broadcast(suffix.agg(F.min("height").alias("s")))).select((F.col("s") > F.col("h") + 1).alias("gap"))  # one row
    checked = kept.unionAll(suffix).crossJoin(F.broadcast(gap))
    return checked.select(F.when(F.col("gap"), F.raise_error(F.lit("the new part leaves a gap"))).otherwise(F.col("height")).cast("long").alias("height"), "size", "part")


@query("""SELECT o_orderkey AS height, o_custkey AS addr FROM orders WHERE o_orderkey BETWEEN 10 AND 200 AND (SELECT count(*) FROM orders o LEFT JOIN customer ON c_custkey = o_custkey WHERE o.o_orderkey BETWEEN 10 AND 200 AND c_custkey IS NULL) = 0""")
def history_lookup_all_or_nothing(spark: Spark, sf_dir: str) -> DataFrame:
    """A slice of history, or no row at all if any of it is missing."""
    asked = table(spark, sf_dir, "orders").where("o_orderkey between 10 and 200").select(F.col("o_orderkey").alias("height"), F.col("o_custkey").alias("addr"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("addr"), F.lit(1).alias("known"))
    found = asked.join(known, "addr", "left")
    missing = found.agg(F.count_if(F.col("known").isNull()).alias("missing"))
    return found.crossJoin(F.broadcast(missing)).where("missing = 0").select("height", "addr")  # one row


@query("""SELECT p_partkey AS key, coalesce(c_name, s_name, 'none') AS value FROM part LEFT JOIN customer ON c_custkey = p_partkey * 2 LEFT JOIN supplier ON s_suppkey = p_partkey""")
def tiered_lookup(spark: Spark, sf_dir: str) -> DataFrame:
    """The first of several stores that has a key."""
    first = table(spark, sf_dir, "customer").select(F.expr("c_custkey").alias("a"), "c_name")
    second = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b"), "s_name")
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    found = keys.join(first, F.col("a") == F.col("key") * 2, "left").join(second, F.col("b") == F.col("key"), "left")
    return found.select("key", F.coalesce("c_name", "s_name", F.lit("none")).alias("value"))


@query(f'{sql("rec", "merged")} SELECT * FROM merged')
def interval_merge(spark: Spark, sf_dir: str) -> DataFrame:
    return intervals.merge(views.sync_record(spark, sf_dir))


@query(f'{sql("rec", "merged")} SELECT set_id, CAST(sum("end" - "start") AS BIGINT) AS covered, count(*) AS n FROM merged GROUP BY 1')
def interval_measure(spark: Spark, sf_dir: str) -> DataFrame:
    return intervals.measure(intervals.merge(views.sync_record(spark, sf_dir)))


@query(f"""{sql("rec", "black", "merged")} SELECT set_id, m."start" AS "start", m."end" AS "end", b."start" AS b_start, b."end" AS b_end FROM merged m JOIN black b ON m."start" < b."end" AND b."start" < m."end" """)
def interval_overlap_join(spark: Spark, sf_dir: str) -> DataFrame:
    return intervals.overlap_join(views.merged_record(spark, sf_dir), views.blacklist(spark, sf_dir))


def _halves(spark: Spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = views.sync_record(spark, sf_dir)
    return tuple(r.where(f"set_id % 2 = {k}").withColumn("set_id", F.expr("set_id div 2 * 2")) for k in (0, 1))


_POINTS = """points AS (SELECT set_id // 2 * 2 AS set_id, set_id % 2 AS side, unnest(generate_series("start" + 1, "end")) AS p FROM rec), pts AS (SELECT set_id, p, bool_or(side = 0) AS a, bool_or(side = 1) AS b FROM points GROUP BY 1, 2),
want AS (SELECT set_id, p, p - row_number() OVER (PARTITION BY set_id ORDER BY p) AS g FROM pts WHERE {0}) SELECT set_id, min(p) - 1 AS "start", max(p) AS "end" FROM want GROUP BY set_id, g"""


@query(f"{sql('rec')}, {_POINTS.format('a AND b')}")
def interval_intersect(spark: Spark, sf_dir: str) -> DataFrame:
    return intervals.intersect(*_halves(spark, sf_dir))


@query(f"{sql('rec')}, {_POINTS.format('a AND NOT b')}")
def interval_subtract(spark: Spark, sf_dir: str) -> DataFrame:
    return intervals.subtract(*_halves(spark, sf_dir))


@query(f"{sql('rec')}, {_POINTS.format('a OR b')}")
def interval_union(spark: Spark, sf_dir: str) -> DataFrame:
    return intervals.union(*_halves(spark, sf_dir))


_GAPS = 'g AS (SELECT set_id, "end" AS "start", lead("start") OVER (PARTITION BY set_id ORDER BY "start") AS "end" FROM merged UNION ALL SELECT set_id, 0, min("start") FROM merged GROUP BY set_id HAVING min("start") > 0)'


@query(f"{sql('rec', 'merged')}, {_GAPS} SELECT * FROM g")
def interval_gaps(spark: Spark, sf_dir: str) -> DataFrame:
    return intervals.gaps(views.sync_record(spark, sf_dir))


@query(f"""{sql('rec', 'merged')}, {_GAPS}, c AS (SELECT set_id, greatest("start", 1000) AS "start", least(coalesce("end", 9000), 9000) AS "end" FROM g) SELECT * FROM c WHERE "end" > "start" """)
def interval_gaps_within(spark: Spark, sf_dir: str) -> DataFrame:
    return intervals.gaps_within(views.sync_record(spark, sf_dir), 1000, 9000)


@query(f"""{sql('rec', 'merged')} SELECT set_id, "start", least("end", 5003) AS "end" FROM merged WHERE "start" < 5003""")
def interval_cut(spark: Spark, sf_dir: str) -> DataFrame:
    return intervals.cut_above(intervals.merge(views.sync_record(spark, sf_dir)), 5003)


@query(f"""{sql('rec', 'merged')} SELECT set_id, greatest("start", 2005) AS "start", least("end", 7001) AS "end" FROM merged WHERE "start" < 7001 AND "end" > 2005""")
def interval_clip(spark: Spark, sf_dir: str) -> DataFrame:
    return intervals.clip(intervals.merge(views.sync_record(spark, sf_dir)), 2005, 7001)


@query(f"""{sql('rec', 'merged')} SELECT set_id, "start", least("end", 2005) AS "end" FROM merged WHERE least("end", 2005) > "start" UNION ALL SELECT set_id, greatest("start", 7001), "end" FROM merged WHERE "end" > greatest("start", 7001)""")
def interval_delete(spark: Spark, sf_dir: str) -> DataFrame:
    return intervals.delete(intervals.merge(views.sync_record(spark, sf_dir)), 2005, 7001)


@query(f"""{sql('rec', 'merged')} SELECT set_id, arg_min("start", "end") AS "start", least(min("end"), 9000) AS "end" FROM merged WHERE "end" > 4000 AND "start" < 9000 GROUP BY set_id""")
def interval_next(spark: Spark, sf_dir: str) -> DataFrame:
    """The lowest interval that ends above an offset; its end is clipped to the bound, its start isn't."""
    m = intervals.merge(views.sync_record(spark, sf_dir)).where('end > 4000 and start < 9000')
    return m.groupBy("set_id").agg(F.min_by("start", "end").alias("start"), F.least(F.min("end"), F.lit(9000).cast("long")).alias("end"))


@query(f"""{sql('rec', 'merged')} SELECT set_id, min("start") AS "start", max("end") AS "end", arg_min("end", "start") AS first_end, arg_max("start", "end") AS last_start FROM merged GROUP BY set_id""")
def interval_hull(spark: Spark, sf_dir: str) -> DataFrame:
    m = intervals.merge(views.sync_record(spark, sf_dir))
    return m.groupBy("set_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("end", "start").alias("first_end"), F.max_by("start", "end").alias("last_start"))


@query(f"""{sql('rec', 'merged')} SELECT set_id, "start", least("end", 20000) AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY "end") AS r FROM merged WHERE "end" >= 500 AND "start" < 20000) WHERE r <= 5""")
def interval_page(spark: Spark, sf_dir: str) -> DataFrame:
    m = intervals.merge(views.sync_record(spark, sf_dir)).where("end >= 500 and start < 20000")
    n = F.row_number().over(W.partitionBy("set_id").orderBy("end"))
    return m.withColumn("r", n).where("r <= 5").select("set_id", "start", F.least("end", F.lit(20000).cast("long")).alias("end"))


@query(f"""{sql('rec')} SELECT set_id, bool_and(ok) AS canonical FROM (SELECT set_id, "end" > "start" AND "start" >= 0 AND coalesce(lag("end") OVER (PARTITION BY set_id ORDER BY "start", "end") < "start", true) AS ok FROM rec) GROUP BY set_id""")
def interval_valid(spark: Spark, sf_dir: str) -> DataFrame:
    return intervals.is_canonical(views.sync_record(spark, sf_dir))


@query(f"""{sql('rec', 'merged')} SELECT set_id, CAST(sum(greatest(0, least("end", 7001) - greatest("start", 2005))) AS BIGINT) AS overlap FROM merged GROUP BY set_id""")
def interval_overlap_size(spark: Spark, sf_dir: str) -> DataFrame:
    return intervals.merge(views.sync_record(spark, sf_dir)).groupBy("set_id").agg(F.sum(intervals.overlap_with(2005, 7001)).alias("overlap"))


@query(f"""{sql('rec', 'merged')}, probes AS (SELECT o_orderkey, o_orderkey * 10 + 5 AS p FROM orders) SELECT o_orderkey, count(*) AS stores FROM probes JOIN merged ON "start" < p AND p <= "end" GROUP BY 1""")
def point_in_interval(spark: Spark, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 10 + 5).alias("p"))
    return intervals.containing(probes, "p", views.merged_record(spark, sf_dir)).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("stores"))


@query(f"""WITH RECURSIVE {views.SQL["black"].replace("p_size", "p_size * 4")}, m AS (SELECT *, CASE WHEN "start" > max("end") OVER (ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM black), i AS (SELECT *, sum(f) OVER (ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM m),
b AS (SELECT min("start") AS "start", max("end") AS "end" FROM i GROUP BY g) SELECT p, coalesce((SELECT "end" + 1 FROM b WHERE "start" < p AND p <= "end"), p) AS allowed FROM (SELECT o_orderkey * 9 AS p FROM orders)""")
def next_allowed_byte(spark: Spark, sf_dir: str) -> DataFrame:
    """The first byte from each on that isn't on the black list, whose entries overlap and adjoin."""
    probes = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 9).alias("p"))
    p = table(spark, sf_dir, "part").select(F.lit(0).alias("set_id"), (F.col("p_partkey") * 100).alias("start"), (F.col("p_partkey") * 100 + F.col("p_size") * 4).cast("long").alias("end"))
    hit = intervals.containing(probes, "p", intervals.merge(p)).select(F.col("p").alias("q"), F.col("b_end").alias("e"))
    return probes.join(hit, F.col("p") == F.col("q"), "left").select("p", F.coalesce(F.col("e") + 1, F.col("p")).alias("allowed"))


@query(f"""{sql('rec', 'merged')}, b AS (SELECT set_id, "start", "end", unnest(generate_series("start" // 1000, ("end" - 1) // 1000)) AS bucket FROM merged)
SELECT set_id, bucket, least(1.0, sum(least("end", (bucket + 1) * 1000) - greatest("start", bucket * 1000)) / 1000.0) AS share FROM b GROUP BY 1, 2""")
def sync_buckets(spark: Spark, sf_dir: str) -> DataFrame:
    return intervals.shares(intervals.merge(views.sync_record(spark, sf_dir)), 1000)


@query(f"""{sql('rec', 'merged')}, b AS (SELECT set_id, "start", "end", unnest(generate_series("start" // 1000, ("end" - 1) // 1000)) AS bucket FROM merged),
s AS (SELECT set_id, bucket, least(1.0, sum(least("end", (bucket + 1) * 1000) - greatest("start", bucket * 1000)) / 1000.0) AS share FROM b GROUP BY 1, 2) SELECT set_id, bucket // 2 AS bucket, round(avg(share), 9) AS share FROM s GROUP BY 1, 2""")
def bucket_coarsen(spark: Spark, sf_dir: str) -> DataFrame:
    fine = intervals.shares(intervals.merge(views.sync_record(spark, sf_dir)), 1000)
    return intervals.coarsened(fine).withColumn("share", F.round("share", 9))


@query("""SELECT o_orderkey AS chunk, o_orderkey // 4096 AS part, (o_orderkey % 4096) % 64 AS footprint, (o_orderkey % 4096) // 64 AS place, (o_orderkey // 4096) * 4096 + ((o_orderkey % 4096) // 64) * 64 + (o_orderkey % 4096) % 64 AS back FROM orders""")
def footprint_map(spark: Spark, sf_dir: str) -> DataFrame:
    """Chunks dealt out over strided footprints of a partition, and the way back."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk"))
    m = o.select("chunk", F.expr("chunk div 4096").alias("part"), F.expr("chunk % 4096 % 64").alias("footprint"), F.expr("chunk % 4096 div 64").alias("place"))
    return m.withColumn("back", F.expr("part * 4096 + place * 64 + footprint"))


@query(f"""{sql('rec', 'merged')}, sh AS (SELECT set_id, "start" // 1000 AS bucket, CAST(sum("end" - "start") AS BIGINT) AS bytes FROM merged GROUP BY 1, 2) SELECT bucket, string_agg(CAST(set_id AS VARCHAR), ',' ORDER BY bytes DESC, set_id DESC) AS stores FROM sh GROUP BY bucket""")
def bucket_peers(spark: Spark, sf_dir: str) -> DataFrame:
    """Stores per bucket, those with most first."""
    sh = intervals.merge(views.sync_record(spark, sf_dir)).groupBy("set_id", F.expr("start div 1000").alias("bucket")).agg(F.sum(F.col("end") - F.col("start")).alias("bytes"))
    listed = F.sort_array(F.collect_list(F.struct("bytes", "set_id")), False)
    return sh.groupBy("bucket").agg(F.array_join(F.transform(listed, lambda x: x["set_id"].cast("string")), ",").alias("stores"))

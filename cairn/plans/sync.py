"""Queries on chunk stores, data roots, storage modules and what to fetch from whom."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators import folds, graph, intervals
from cairn.plans import views
from cairn.plans.registry import query
from cairn.plans.views import sql
from cairn.sources.tables import shared_path, table

Spark = SparkSession

#: Stores hold chunks on a grid of 64 bytes; the view for DuckDB beside the one below.
_CHUNKS = 'chunks AS (SELECT l_suppkey AS store, l_orderkey * 64 AS "start", l_orderkey * 64 + max(CAST(l_quantity AS BIGINT)) AS "end", l_orderkey * 64 + 64 AS padded FROM lineitem GROUP BY l_suppkey, l_orderkey)'


def _chunks(spark: Spark, sf_dir: str) -> DataFrame:
    """``store, start, end, padded``: a store's chunks, each in a bucket of 64 bytes that it needn't fill."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("store"), F.col("l_orderkey").alias("o")).agg(F.max(F.col("l_quantity").cast("long")).alias("size"))
    return li.select("store", (F.col("o") * 64).alias("start"), (F.col("o") * 64 + F.col("size")).alias("end"), (F.col("o") * 64 + 64).alias("padded"))


@query(f'WITH {_CHUNKS} SELECT store, "start", "end", padded, padded // 4096 AS bucket FROM chunks')
def chunk_put(spark: Spark, sf_dir: str) -> DataFrame:
    """Chunks written to files by bucket of their padded end, and read back."""
    path = shared_path(spark, "chunks")
    bucketed = _chunks(spark, sf_dir).withColumn("file", F.expr("padded div 4096 % 16")).repartition("file")
    bucketed.write.partitionBy("file").parquet(path)
    return spark.read.parquet(path).select("store", "start", "end", "padded", F.expr("padded div 4096").alias("bucket"))


@query(f'WITH {_CHUNKS} SELECT store, padded, "end" - "start" AS size FROM chunks WHERE padded > 5000 AND "start" < 14000')
def chunk_range(spark: Spark, sf_dir: str) -> DataFrame:
    """The chunks that a range touches, whole ones at its borders too, by padded end."""
    return _chunks(spark, sf_dir).where("padded > 5000 and start < 5000 + 9000").select("store", "padded", (F.col("end") - F.col("start")).alias("size"))


@query(f"WITH {_CHUNKS} SELECT store, padded FROM chunks WHERE padded <= 30000 AND NOT (store % 2 = 0 AND padded % 640 = 0)")
def chunk_cut(spark: Spark, sf_dir: str) -> DataFrame:
    """What is left when all above an offset, and chunks of a list, are deleted."""
    c = _chunks(spark, sf_dir).select("store", "padded")
    gone = c.where("store % 2 = 0 and padded % 640 = 0")
    return c.where("padded <= 30000").join(gone, ["store", "padded"], "left_anti")


@query(f'WITH {_CHUNKS} SELECT store, "end", padded, "end" - "start" AS size, "end" - "start" >= 40 AS large FROM chunks WHERE "end" BETWEEN 2000 AND 26000')
def chunk_metadata(spark: Spark, sf_dir: str) -> DataFrame:
    """Metadata of the chunks whose end lies in a range with both borders."""
    size = F.col("end") - F.col("start")
    return _chunks(spark, sf_dir).where("end between 2000 and 26000").select("store", "end", "padded", size.alias("size"), (size >= 40).alias("large"))


@query(f"""WITH {_CHUNKS}, black AS (SELECT p_partkey * 100 AS "start", p_partkey * 100 + p_size AS "end" FROM part), probes AS (SELECT o_orderkey * 61 AS byte FROM orders),
found AS (SELECT byte, store, "start", "end", row_number() OVER (PARTITION BY byte ORDER BY store % 3, store) AS r FROM probes JOIN chunks ON "start" < byte AND byte <= "end" WHERE NOT EXISTS (SELECT 1 FROM black b WHERE b."start" < byte AND byte <= b."end"))
SELECT byte, store, "start", "end" FROM probes LEFT JOIN (SELECT * FROM found WHERE r = 1) USING (byte)""")
def chunk_lookup(spark: Spark, sf_dir: str) -> DataFrame:
    """The chunk that holds each byte: not if it is on the black list, else from the store with the preferred packing."""
    probes = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 61).alias("byte"))
    barred = intervals.containing(probes, "byte", views.blacklist(spark, sf_dir)).select("byte")
    found = intervals.containing(probes.join(barred, "byte", "left_anti"), "byte", _chunks(spark, sf_dir))
    best = found.groupBy("byte").agg(F.min_by(F.struct("b_store", "b_start", "b_end"), F.struct(F.col("b_store") % 3, "b_store")).alias("x"))
    return probes.join(best, "byte", "left").select("byte", F.col("x.b_store").alias("store"), F.col("x.b_start").alias("start"), F.col("x.b_end").alias("end"))


#: Transactions on the archive's line of bytes, in order within their block.
_SPANS = 'spans AS (SELECT height, line, start_offset + CAST(sum(n) OVER w AS BIGINT) - CAST(n AS BIGINT) AS "start", start_offset + CAST(sum(n) OVER w AS BIGINT) AS "end" FROM (SELECT l_orderkey AS height, l_linenumber AS line, sum(CAST(l_quantity AS BIGINT)) AS n FROM lineitem GROUP BY 1, 2) JOIN idx USING (height) WINDOW w AS (PARTITION BY height ORDER BY line ROWS UNBOUNDED PRECEDING))'


def _spans(spark: Spark, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("height"), F.col("l_linenumber").alias("line")).agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))
    inside = F.sum("n").over(W.partitionBy("height").orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    placed = sizes.withColumn("upto", inside).join(views.block_index(spark, sf_dir).select("height", "start_offset"), "height")
    end = F.col("start_offset") + F.col("upto")
    return placed.select("height", "line", (end - F.col("n")).alias("start"), end.alias("end"))


@query(f'{sql("blocks", "idx")}, {_SPANS} SELECT height, line, "end" AS end_offset, CAST("end" - "start" AS BIGINT) AS size FROM spans WHERE line = 1 AND height IN (SELECT p_partkey * 7 FROM part)')
def tx_offset(spark: Spark, sf_dir: str) -> DataFrame:
    """End offset and size of transactions asked for by their block's first place."""
    asked = table(spark, sf_dir, "part").select((F.col("p_partkey") * 7).alias("height"))
    return _spans(spark, sf_dir).where("line = 1").join(asked, "height", "left_semi").select("height", "line", F.col("end").alias("end_offset"), (F.col("end") - F.col("start")).alias("size"))


@query(f"""{sql("blocks", "idx")}, {_SPANS}, asked AS (SELECT p_partkey AS id, p_partkey * 130 AS lo, p_partkey * 130 + 60 AS hi FROM part)
SELECT id, height, line, "start" AS tx_start, "end" AS tx_end FROM asked JOIN spans ON "start" < hi AND "end" > lo AND "end" > "start" """)
def txs_in_range(spark: Spark, sf_dir: str) -> DataFrame:
    """Transactions that a range of bytes touches, with their own borders; one that begins before the range counts too."""
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 130).alias("start"), (F.col("p_partkey") * 130 + 60).alias("end"))
    met = intervals.overlap_join(asked, _spans(spark, sf_dir))
    return met.select("id", F.col("b_height").alias("height"), F.col("b_line").alias("line"), F.col("b_start").alias("tx_start"), F.col("b_end").alias("tx_end"))


_ROOTS = "roots AS (SELECT l_partkey AS root, l_suppkey AS store, l_orderkey AS height, CAST(min(l_linenumber) AS BIGINT) AS tx_start FROM lineitem GROUP BY 1, 2, 3)"


def _roots(spark: Spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("root"), F.col("l_suppkey").alias("store"), F.col("l_orderkey").alias("height")).agg(F.min("l_linenumber").cast("long").alias("tx_start"))


@query(f"""{sql("blocks", "idx")}, {_ROOTS}, asked AS (SELECT p_partkey * 53 AS byte FROM part)
SELECT byte, idx.height, idx.size, string_agg(root || ':' || store || ':' || tx_start, ',' ORDER BY tx_start, root, store) AS entries FROM asked JOIN idx ON start_offset <= byte AND byte < end_offset JOIN roots ON roots.height = idx.height GROUP BY ALL""")
def block_data_roots(spark: Spark, sf_dir: str) -> DataFrame:
    """The data roots of the block that holds a byte, in order of their transactions."""
    spans = views.block_index(spark, sf_dir).where("size > 0").select("height", "size", F.col("start_offset").alias("start"), F.col("end_offset").alias("end"))
    asked = table(spark, sf_dir, "part").select((F.col("p_partkey") * 53).alias("byte"), (F.col("p_partkey") * 53 + 1).alias("point"))
    block = intervals.containing(asked, "point", spans).select("byte", F.col("b_height").alias("height"), F.col("b_size").alias("size"))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("tx_start", "root", "store"))), lambda x: F.concat_ws(":", x["root"], x["store"], x["tx_start"]))
    return block.join(_roots(spark, sf_dir), "height").groupBy("byte", "height", "size").agg(F.array_join(entries, ",").alias("entries"))


@query(f"""WITH {_ROOTS} SELECT root, count(*) FILTER (WHERE height >= 300 AND height < 900) AS removed, count(*) FILTER (WHERE height < 300 OR height >= 900) AS kept FROM roots GROUP BY root HAVING count(*) FILTER (WHERE height >= 300 AND height < 900) > 0""")
def data_root_remove(spark: Spark, sf_dir: str) -> DataFrame:
    """Entries within a range are removed, its end excluded; which roots lost some, and what they keep."""
    r = _roots(spark, sf_dir)
    gone = r.where("height >= 300 and height < 900")
    kept = r.join(gone, ["root", "store", "height"], "left_anti").groupBy("root").agg(F.count(F.lit(1)).alias("kept"))
    return gone.groupBy("root").agg(F.count(F.lit(1)).alias("removed")).join(kept, "root", "left").select("root", "removed", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"))


@query(f"""{sql("rec", "merged")}, probes AS (SELECT o_orderkey * 10 + 3 AS p FROM orders) SELECT p, set_id AS store, set_id % 3 AS packing FROM (SELECT p, set_id, row_number() OVER (PARTITION BY p ORDER BY set_id <> 1, set_id) AS r FROM probes JOIN merged ON "start" < p AND p <= "end") WHERE r = 1""")
def recorded_where(spark: Spark, sf_dir: str) -> DataFrame:
    """The store that has a byte: the default one if it does, else the first of those that do; and its packing."""
    probes = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 10 + 3).alias("p"))
    found = intervals.containing(probes, "p", views.merged_record(spark, sf_dir))
    best = found.groupBy("p").agg(F.min_by("b_set_id", F.struct(F.col("b_set_id") != 1, "b_set_id")).alias("store"))
    return best.select("p", "store", (F.col("store") % 3).alias("packing"))


@query(f"""{sql("rec", "merged")}, probes AS (SELECT o_orderkey * 10 + 3 AS p, o_custkey % 3 AS want FROM orders) SELECT p, want, EXISTS (SELECT 1 FROM merged WHERE set_id % 3 = want AND "start" < p AND p <= "end") AS recorded, EXISTS (SELECT 1 FROM merged WHERE set_id IN (2, 5, 8) AND "start" < p AND p <= "end") AS in_modules FROM probes""")
def recorded_as(spark: Spark, sf_dir: str) -> DataFrame:
    """Whether a byte is stored with the packing wanted, and whether any of some modules has it."""
    probes = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 10 + 3).alias("p"), (F.col("o_custkey") % 3).alias("want"))
    found = intervals.containing(probes, "p", views.merged_record(spark, sf_dir))
    seen = found.groupBy("p").agg(F.bool_or(F.col("b_set_id") % 3 == F.col("want")).alias("a"), F.bool_or(F.col("b_set_id").isin(2, 5, 8)).alias("b"))
    return probes.join(seen, "p", "left").select("p", "want", F.coalesce("a", F.lit(False)).alias("recorded"), F.coalesce("b", F.lit(False)).alias("in_modules"))


#: Storage modules of differing lengths, some of which leave gaps or overlap others.
_MODULES = 'modules AS (SELECT s_suppkey AS id, s_suppkey * 100 - (s_nationkey % 4) * 40 AS "start", s_suppkey * 100 + 60 + (s_nationkey % 3) * 45 AS "end" FROM supplier)'


def _modules(spark: Spark, sf_dir: str) -> DataFrame:
    at = F.col("s_suppkey") * 100
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (at - F.col("s_nationkey") % 4 * 40).alias("start"), (at + 60 + F.col("s_nationkey") % 3 * 45).alias("end"))


@query(f"""WITH RECURSIVE {_MODULES}, asked AS (SELECT s_suppkey AS req, s_suppkey * 90 AS lo, s_suppkey * 90 + 250 AS hi FROM supplier),
walk AS (SELECT req, lo AS "at", lo, hi, CAST(NULL AS BIGINT) AS id, lo AS upto FROM asked UNION ALL
SELECT w.req, w.upto, w.lo, w.hi, n.id, least(n."end", w.hi) FROM walk w JOIN LATERAL (SELECT id, "end" FROM modules m WHERE m."start" <= w.upto AND w.upto < m."end" ORDER BY m."start", m.id LIMIT 1) n ON true WHERE w.upto < w.hi),
whole AS (SELECT req FROM walk GROUP BY req, hi HAVING max(upto) = hi) SELECT req, "at" AS "start", upto AS "end", id FROM walk WHERE id IS NOT NULL AND req IN (SELECT req FROM whole)""")
def cover_range(spark: Spark, sf_dir: str) -> DataFrame:
    """Pieces of storage modules that cover each asked range from end to end; nothing for a range that they don't.

    At a piece's end the module with the least start that reaches further goes on. Which one follows which doesn't depend on
    the range, so ranges are filled by jumps of 1, 2, 4 ... modules.
    """
    modules = _modules(spark, sf_dir)
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("req"), (F.col("s_suppkey") * 90).alias("lo"), (F.col("s_suppkey") * 90 + 250).alias("hi"))

    def first_at(points: DataFrame, at: str) -> DataFrame:
        met = intervals.containing(points.withColumn("_p", F.col(at) + 1), "_p", modules)
        return met.groupBy(*points.columns).agg(F.min_by(F.struct("b_id", "b_end"), F.struct("b_start", "b_id")).alias("x"))

    follows = first_at(modules.select("id", "end"), "end").select("id", F.col("x.b_id").alias("next"))
    entered = first_at(asked, "lo").select("req", "lo", "hi", F.col("x.b_id").alias("id"))
    steps = graph.walked(entered, follows, lambda w: w.join(modules.select("id", F.col("end").alias("_e")), "id").where("_e < hi").drop("_e"))
    placed = steps.join(modules.select("id", F.col("end").alias("_e")), "id")
    order = W.partitionBy("req").orderBy("step")
    pieces = placed.select("req", "hi", F.coalesce(F.lag("_e").over(order), F.col("lo")).alias("start"), F.least("_e", "hi").alias("end"), "id")
    whole = pieces.groupBy("req").agg(F.max("end").alias("upto"), F.max("hi").alias("hi")).where("upto = hi").select("req")
    return pieces.where("start < hi").drop("hi").join(whole, "req", "left_semi")


_WANT = 'want AS (SELECT "end" AS "start", nxt AS "end" FROM (SELECT "end", lead("start") OVER (ORDER BY "start") AS nxt FROM merged WHERE set_id = 1) WHERE nxt IS NOT NULL)'


def _unsynced(spark: Spark, sf_dir: str) -> DataFrame:
    """What the first store lacks between its first and last byte."""
    return intervals.gaps(views.sync_record(spark, sf_dir).where("set_id = 1")).where("end is not null and start > 0").select("start", "end")


@query(f"""{sql("rec", "merged")}, {_WANT} SELECT set_id AS peer, greatest(m."start", w."start") AS "start", least(m."end", w."end") AS "end", min(m2.right_bound) AS right_bound FROM merged m JOIN want w ON m."start" < w."end" AND w."start" < m."end" AND m.set_id > 1,
(SELECT min(r) AS right_bound FROM (SELECT max("end") AS r FROM merged WHERE set_id > 1 GROUP BY set_id)) m2 GROUP BY 1, 2, 3""")
def peer_fetch_plan(spark: Spark, sf_dir: str) -> DataFrame:
    """What each peer has of what is missing, and the least of the peers' last bytes, up to which the plan is complete."""
    peers = intervals.merge(views.sync_record(spark, sf_dir).where("set_id > 1"))
    met = intervals.overlap_join(peers, _unsynced(spark, sf_dir))
    right = peers.groupBy("set_id").agg(F.max("end").alias("r")).agg(F.min("r").alias("right_bound"))
    return met.select(F.col("set_id").alias("peer"), F.greatest("start", "b_start").alias("start"), F.least("end", "b_end").alias("end")).crossJoin(F.broadcast(right))  # one row


@query(f"""{sql("rec", "merged")}, fp AS (SELECT set_id, unnest(generate_series("start" // 64, ("end" - 1) // 64)) AS chunk FROM merged), d AS (SELECT DISTINCT set_id, chunk, chunk // 256 AS part, chunk % 16 AS footprint, chunk % 256 // 16 AS place FROM fp)
SELECT p.set_id AS peer, part, footprint, count(*) AS chunks, min(chunk) * 64 AS first_byte FROM d p WHERE p.set_id > 1 AND chunk NOT IN (SELECT chunk FROM d WHERE set_id = 1) GROUP BY 1, 2, 3""")
def peer_footprint_plan(spark: Spark, sf_dir: str) -> DataFrame:
    """The same for footprints, chunks that lie a stride apart: missing ones by peer and footprint, mapped back to bytes.

    A footprint's chunks are bits of its places, so that a chunk that two intervals touch needn't be made distinct before.
    """
    merged = intervals.merge(views.sync_record(spark, sf_dir))
    d = merged.select("set_id", F.explode(F.sequence(F.expr("start div 64"), F.expr("(end - 1) div 64"))).alias("chunk"))
    fetch = d.where("set_id > 1").join(d.where("set_id = 1").select("chunk"), "chunk", "left_anti")
    return fetch.groupBy(F.col("set_id").alias("peer"), F.expr("chunk div 256").alias("part"), (F.col("chunk") % 16).alias("footprint")).agg(F.bit_count(F.bit_or(F.expr("shiftleft(1, cast(chunk % 256 div 16 as int))"))).cast("long").alias("chunks"), (F.min("chunk") * 64).alias("first_byte"))


_TASKS = """tasks AS (SELECT DISTINCT set_id AS peer, unnest(generate_series("start" // 64, ("end" - 1) // 64)) AS chunk FROM merged WHERE set_id > 1), free AS (SELECT * FROM tasks WHERE chunk NOT IN (SELECT unnest(generate_series("start" // 64, ("end" - 1) // 64)) FROM merged WHERE set_id = 1)),
won AS (SELECT min(peer) AS peer, chunk FROM free GROUP BY chunk)"""


def _tasks(spark: Spark, sf_dir: str) -> DataFrame:
    merged = intervals.merge(views.sync_record(spark, sf_dir))
    d = merged.select(F.col("set_id").alias("peer"), F.explode(F.sequence(F.expr("start div 64"), F.expr("(end - 1) div 64"))).alias("chunk"))
    free = d.where("peer > 1").join(d.where("peer = 1").select("chunk"), "chunk", "left_anti")
    return free.groupBy("chunk").agg(F.min("peer").alias("peer"))


@query(f"{sql('rec', 'merged')}, {_TASKS} SELECT peer, chunk FROM (SELECT *, row_number() OVER (PARTITION BY peer ORDER BY chunk) AS r FROM won) WHERE r <= 6")
def task_dedup(spark: Spark, sf_dir: str) -> DataFrame:
    """Chunk tasks that aren't in flight; the first peer that has a chunk gets it, and each peer at most six."""
    r = F.row_number().over(W.partitionBy("peer").orderBy("chunk"))
    return _tasks(spark, sf_dir).withColumn("r", r).where("r <= 6").select("peer", "chunk")


@query(f"{sql('rec', 'merged')}, {_TASKS} SELECT chunk % 16 AS footprint, chunk, peer FROM won ORDER BY chunk % 16, chunk, peer LIMIT 25")
def task_take(spark: Spark, sf_dir: str) -> DataFrame:
    """The smallest tasks of a queue ordered by footprint, offset and peer."""
    return _tasks(spark, sf_dir).select((F.col("chunk") % 16).alias("footprint"), "chunk", "peer").orderBy("footprint", "chunk", "peer").limit(25)


@query(f"""{sql("rec")}, pts AS (SELECT set_id // 2 AS pair, set_id % 2 AS side, unnest(generate_series("start" + 1, "end")) AS p FROM rec), c AS (SELECT pair, p FROM pts GROUP BY 1, 2 HAVING bool_or(side = 0) AND NOT bool_or(side = 1)), g AS (SELECT pair, p, p - row_number() OVER (PARTITION BY pair ORDER BY p) AS k FROM c)
SELECT pair, min(p) - 1 AS "start", max(p) AS "end", count(*) AS bytes FROM g GROUP BY pair, k""")
def copy_plan(spark: Spark, sf_dir: str) -> DataFrame:
    """What one store of a pair has and the other lacks: the ranges to copy."""
    r = views.sync_record(spark, sf_dir).withColumn("pair", F.expr("set_id div 2"))
    missing = intervals.subtract(r.where("set_id % 2 = 0"), r.where("set_id % 2 = 1"), ["pair"])
    return missing.withColumn("bytes", F.col("end") - F.col("start"))


@query(f"""{sql("rec", "merged")}, n AS (SELECT set_id, "start", "end", lead("start") OVER w AS s2, lead("end") OVER w AS e2 FROM merged WINDOW w AS (PARTITION BY set_id ORDER BY "start")) SELECT set_id, greatest("start", 4000) AS a_start, least("end", coalesce(e2, "end")) AS a_end, CASE WHEN s2 IS NOT NULL THEN greatest(s2, 4000) END AS b_start, CASE WHEN s2 IS NOT NULL THEN greatest(e2, "end") END AS b_end FROM n WHERE "end" > 4000""")
def interval_align(spark: Spark, sf_dir: str) -> DataFrame:
    """Each interval and the next one clamped to a cursor and to each other; a missing one stays missing."""
    w = W.partitionBy("set_id").orderBy("start")
    m = intervals.merge(views.sync_record(spark, sf_dir)).withColumns({"s2": F.lead("start").over(w), "e2": F.lead("end").over(w)}).where("end > 4000")
    at = F.lit(4000).cast("long")
    return m.select("set_id", F.greatest("start", at).alias("a_start"), F.least("end", F.coalesce("e2", "end")).alias("a_end"), F.when(F.col("s2").isNotNull(), F.greatest("s2", at)).alias("b_start"), F.when(F.col("s2").isNotNull(), F.greatest("e2", "end")).alias("b_end"))


_SHARES = """b AS (SELECT set_id, "start", "end", unnest(generate_series("start" // 1000, ("end" - 1) // 1000)) AS bucket FROM merged), s AS (SELECT set_id, bucket, least(1.0, sum(least("end", (bucket + 1) * 1000) - greatest("start", bucket * 1000)) / 1000.0) AS share FROM b GROUP BY 1, 2)"""


@query(f"{sql('rec', 'merged')}, {_SHARES} SELECT set_id, bucket // 4 AS wide, round(sum(share), 9) AS total, count(*) AS touched FROM s WHERE bucket < 40 GROUP BY 1, 2")
def bucket_cut_get(spark: Spark, sf_dir: str) -> DataFrame:
    """Buckets cut above an offset; of wider ones, the unscaled sum of the shares recorded in them."""
    s = intervals.shares(intervals.merge(views.sync_record(spark, sf_dir)), 1000).where("bucket < 40")
    return s.groupBy("set_id", F.expr("bucket div 4").alias("wide")).agg(F.round(F.sum("share"), 9).alias("total"), F.count(F.lit(1)).alias("touched"))


@query(f"{sql('rec', 'merged')}, {_SHARES} SELECT set_id, bucket * 2 + h AS half, share FROM s, (SELECT unnest([0, 1]) AS h)")
def bucket_foreach(spark: Spark, sf_dir: str) -> DataFrame:
    """Buckets of half the size, each with the share of the one that it is part of."""
    s = intervals.shares(intervals.merge(views.sync_record(spark, sf_dir)), 1000)
    return s.select("set_id", F.explode(F.array(F.col("bucket") * 2, F.col("bucket") * 2 + 1)).alias("half"), "share")


@query(f"""{sql("black")}, ops AS (SELECT l_suppkey % 7 AS key, l_orderkey AS seq, l_orderkey * 13 % 5000 AS "start", l_orderkey * 13 % 5000 + CAST(l_quantity AS BIGINT) AS "end", l_returnflag <> 'R' AS adds FROM lineitem WHERE l_linenumber = 1),
pts AS (SELECT key, p, arg_max(adds, struct_pack(a := seq, b := adds)) AS on_ FROM (SELECT key, seq, adds, unnest(generate_series("start" + 1, "end")) AS p FROM ops) GROUP BY 1, 2), g AS (SELECT key, p, p - row_number() OVER (PARTITION BY key ORDER BY p) AS k FROM pts WHERE on_) SELECT key, min(p) - 1 AS "start", max(p) AS "end" FROM g GROUP BY key, k""")
def interval_log(spark: Spark, sf_dir: str) -> DataFrame:
    """The intervals that a log of additions and removals leaves: of the operations on a byte the last one counts."""
    return intervals.replayed(interval_ops(spark, sf_dir), ["key"], "seq", "adds")


def interval_ops(spark: Spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    at = F.col("l_orderkey") * 13 % 5000
    return li.select((F.col("l_suppkey") % 7).alias("key"), F.col("l_orderkey").alias("seq"), at.alias("start"), (at + F.col("l_quantity").cast("long")).alias("end"), (F.col("l_returnflag") != "R").alias("adds"))


@query(f"""{sql("rec", "merged")} SELECT set_id, sum(("end" - "start") * ("end" - "start")) AS squares, string_agg(CAST("end" - "start" AS VARCHAR), ',' ORDER BY "start") FILTER (WHERE "start" < 3000) AS lengths FROM merged GROUP BY set_id""")
def interval_fold(spark: Spark, sf_dir: str) -> DataFrame:
    """Folds of a set's intervals in order with a function of the user's, state and all."""
    m = intervals.merge(views.sync_record(spark, sf_dir)).select("set_id", "start", "end")

    def step(state: tuple[int, list], row: tuple) -> tuple[tuple[int, list], list]:
        squares, lengths = state
        n = row[1] - row[0]
        return (squares + n * n, [*lengths, str(n)] if row[0] < 3000 else lengths), []

    return folds.folded(m, ["set_id"], ["start"], "set_id long, squares long, lengths string", lambda: (0, []), step, lambda s: [(s[0], ",".join(s[1]) or None)])


@query(f"""WITH {_CHUNKS}, want AS (SELECT DISTINCT l_partkey * 64 AS "start" FROM lineitem WHERE l_returnflag = 'A') SELECT w."start", min(c.store) AS store, count(c.store) AS copies, count(c.store) = 0 AS pending FROM want w LEFT JOIN chunks c ON c."start" = w."start" GROUP BY 1""")
def disk_pool(spark: Spark, sf_dir: str) -> DataFrame:
    """Chunks that wait for a place: those whose offset a store has are placed at each, the others stay pending."""
    want = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select((F.col("l_partkey") * 64).alias("start")).distinct()
    found = want.join(_chunks(spark, sf_dir).select("start", "store"), "start", "left").groupBy("start")
    return found.agg(F.min("store").alias("store"), F.count("store").alias("copies"), (F.count("store") == 0).alias("pending"))


"""URL filters by temporal list join.

Dated entries of block lists (an entry is put on a list or taken off it) become validity intervals
per key, where a key is a host, a parent domain or a host with a path. Every capture is joined with
the entries in force when it was fetched. Intervals are cut at calendar periods and captures carry
theirs, so the as-of join is an equi-join on key and period that a long list history spreads over many
join keys; a key and period with a notable share of all captures is dealt out further. Intervals of
one key do not overlap, so a key gives one match at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days in a period of the join.
PERIOD = 32
#: A key and period that more than one in so many asked keys have is dealt out in so many parts; there are fewer than this of them.
HOT, PARTS = 1_000, 64
ADDRESS = r"^(\[.*|([0-9]+\.){3}[0-9]+)$"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and closing dot; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)), r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path of a URL, ``/`` if it has none; query and fragment are left out."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def keys_of(url: Column, deepest: Column | int) -> Column:
    """Keys under which a list can hold a URL: its host, each parent domain, and the host with up to ``deepest`` path parts.

    A host that is an IP address has no parent domains.
    """
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    domains = F.when(host_of(url).rlike(ADDRESS), F.array(host_of(url))).otherwise(suffixes)
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    depth = F.least(F.size(parts), deepest if isinstance(deepest, Column) else F.lit(deepest))
    prefixes = F.transform(F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(host_of(url).isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, prefixes)))


def validity(entries: DataFrame) -> DataFrame:
    """``(list, key, category, valid_from, valid_to)`` from ``(list, key, category, dated, listed)``.

    An entry holds from its date until the next entry of its list and key (open: null); one with
    ``listed`` false ends the one before. Of entries of one date the listing with the largest
    category wins over a delisting. Entries with a null list, key or date are void.
    """
    sound = entries.where("list is not null and key is not null and dated is not null")
    day = sound.groupBy("list", "key", "dated").agg(F.max(F.struct(F.coalesce("listed", F.lit(True)).alias("listed"), F.col("category"))).alias("x"))
    until = F.lead("dated").over(W.partitionBy("list", "key").orderBy("dated"))
    spans = day.select("list", "key", "x.category", "x.listed", F.col("dated").alias("valid_from"), until.alias("valid_to"))
    return spans.where("listed").drop("listed")


def as_of_matches(captures: DataFrame, entries: DataFrame, period: int = PERIOD) -> DataFrame:
    """``(page_id, url, fetched, list, key, category, valid_from)`` of every entry in force at a fetch.

    Captures are asked for with as many path parts as the list's longest key has.
    """
    epoch = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date"))
    of = lambda d: F.floor(epoch(d) / period).cast("int")
    last = captures.agg(F.max("fetched").alias("last"))
    spans = validity(entries).crossJoin(F.broadcast(last)).where("valid_from <= last")  # one row
    end = F.least(F.coalesce(F.date_sub("valid_to", 1), F.col("last")), F.col("last"))
    spans = spans.select("list", "key", "category", "valid_from", "valid_to", F.explode(F.sequence(of(F.col("valid_from")), of(end))).alias("period"))
    deepest = entries.agg(F.coalesce(F.max(F.size(F.split("key", "/")) - 1), F.lit(0)).alias("deepest"))
    asked = captures.where("fetched is not null").crossJoin(F.broadcast(deepest))  # one row
    asked = asked.select("page_id", "url", "fetched", of(F.col("fetched")).alias("period"), F.explode(keys_of(F.col("url"), F.col("deepest"))).alias("key"))
    counts = asked.groupBy("key", "period").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # each of these has over total / HOT of the rows, so that they are fewer than HOT
    hot = F.broadcast(counts.crossJoin(F.broadcast(total)).where(F.col("n") * HOT > F.col("total")).where(F.col("n") > HOT).select("key", "period", F.lit(PARTS).alias("parts")))
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("page_id", "url"), "parts")).otherwise(0)
    asked = asked.join(hot, ["key", "period"], "left").withColumn("part", part).drop("parts")
    dealt = spans.join(hot, ["key", "period"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1))).drop("parts")
    found = asked.join(dealt, ["key", "period", "part"])
    return found.where("fetched >= valid_from and (valid_to is null or fetched < valid_to)").select("page_id", "url", "fetched", "list", "key", "category", "valid_from")


def filter_urls(captures: DataFrame, entries: DataFrame, period: int = PERIOD) -> DataFrame:
    """Per capture ``page_id, url, fetched, blocked, n_entries, key, list, category, valid_from``.

    The entry named is the one with the longest key, then the first list and category by order. A
    capture with a null or malformed URL, or a null fetch date, matches nothing. Equal rows are
    counted as one, whatever their length; other columns of either input are left out. An empty list blocks nothing.
    """
    base = captures.select("page_id", "url", "fetched").distinct()
    found = as_of_matches(base, entries, period)
    best = F.min(F.struct((-F.length("key")).alias("_n"), "key", "list", "category", "valid_from")).alias("best")
    per = found.groupBy(F.col("page_id").alias("_p"), F.col("url").alias("_u"), F.col("fetched").alias("_f")).agg(F.count(F.lit(1)).alias("n_entries"), best)
    on = F.col("page_id").eqNullSafe(F.col("_p")) & F.col("url").eqNullSafe(F.col("_u")) & F.col("fetched").eqNullSafe(F.col("_f"))
    return base.join(per, on, "left").select("page_id", "url", "fetched", F.col("best").isNotNull().alias("blocked"), F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"), "best.key", "best.list", "best.category", "best.valid_from")

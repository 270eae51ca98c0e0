"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, bands, and verified overlap.

A text is the bag of its five-word shingles. Each shingle x stands for a Poisson process in time, of
rate 1, on every unit of weight [l, l+1). The units are grouped by a hierarchy of dyadic blocks
[0,1), [1,2), [2,4), [4,8) ..., each with one process at the block's rate whose points are then given
to a unit: a heavy shingle costs as many processes as its weight has binary digits. A text of
weight w has the points of units below w; every point also names one of the signature's
components, which keeps its earliest point. Two texts share that point with a probability that is
their bags' weighted Jaccard similarity. Points come in order of time, and a text stops when its
components are filled.

Bands of the signature make buckets. Copies of a text are one member. Within a bucket all are compared
with one leader, the text that meets most others over all its bands, and the links give classes. Then
each bucket is finished: all pairs of its members are compared but those that are in one class already or
that can't link, by the triangle inequality over the leader or by their sizes. Pairs within the leader's class are
never made; a large bucket is dealt out in blocks of members outside that class against blocks of all.
Overlap is counted on whole bags, and classes are found by passing labels along the links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.hashing import in_slices, mix, shingles, words_in
from cairn.llm.spreading import with_figures
from cairn.sources.tables import stored

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Members compared with one copy of a leader's bag; members in a block of a large bucket.
PER_PART, BLOCK = 200, 512
#: A bucket that has at most this many pairs left is paired out, one with more is dealt out in blocks.
PAIRED = 4096
#: Bytes of texts that are worked through at once.
SLICE = 1 << 21
#: Slack of the bounds that leave pairs out, against rounding.
SLACK = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit words."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / float(1 << 53)


def signatures(bags: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """A signature of ``size`` 64-bit components per non-empty bag of shingle hashes."""
    out = np.zeros((len(bags), size), np.uint64)
    todo = [i for i, b in enumerate(bags) if len(b)]
    reach = np.log(size) + 3.0
    while todo:
        x, owner, low, rate, weight = [], [], [], [], []
        for i in todo:
            values, counts = np.unique(bags[i], return_counts=True)
            lo, width = 0, 1
            while len(values):
                x.append(mix(values, 100 + lo))
                owner.append(np.full(len(values), i))
                low.append(np.full(len(values), lo))
                rate.append(np.full(len(values), width))
                weight.append(counts)
                lo, width = lo + width, max(1, lo + width)
                more = counts > lo
                values, counts = values[more], counts[more]
        x, owner, low, rate, weight = map(np.concatenate, (x, owner, low, rate, weight))
        stop = np.zeros(len(bags))
        stop[todo] = [reach * size / len(bags[i]) for i in todo]
        best = np.full((len(bags), size), np.inf)
        value = np.zeros((len(bags), size), np.uint64)
        time = np.zeros(len(x))
        n = 0
        points = []
        while len(x):
            n += 1
            draw = mix(x, 1000 + n)
            time = time - np.log(_unit(draw)) / rate
            live = time <= stop[owner]
            x, owner, low, rate, weight, time = (a[live] for a in (x, owner, low, rate, weight, time))
            more = mix(draw[live], 7)
            level = low + ((more >> np.uint64(40)).astype(np.float64) / float(1 << 24) * rate).astype(np.int64)
            own = level < weight
            points.append((owner[own], (more[own] % np.uint64(size)).astype(np.int64), time[own], mix(more[own], 9)))
        rows, cols, times, names = map(np.concatenate, zip(*points, strict=True))
        np.minimum.at(best, (rows, cols), times)
        first = times == best[rows, cols]
        value[rows[first], cols[first]] = names[first]
        full = np.isfinite(best).all(axis=1)
        done = [i for i in todo if full[i]]
        out[done] = value[done]
        todo = [i for i in todo if not full[i]]
        reach *= 2
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key per band, of the band's number and components."""
    keys = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(signature), 1), np.uint64)
    for r in range(rows):
        keys = mix(keys ^ signature[:, r::rows][:, :bands], r)
    return keys


def expanded(bag: np.ndarray) -> np.ndarray:
    """A bag as a sorted set: the n-th repetition of a shingle is an element of its own."""
    s = np.sort(bag)
    start = np.maximum.accumulate(np.where(np.concatenate(([True], s[1:] != s[:-1])), np.arange(len(s)), 0)) if len(s) else np.zeros(0, int)
    return np.sort(mix(s ^ mix((np.arange(len(s)) - start).astype(np.uint64), 5), 6))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags given as sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 1.0 if not len(b) else 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def _shingled(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The bag of each text."""
    _, _, _, _, words, first = words_in(texts)
    return [shingles(words[a:b], shingle) for a, b in itertools.pairwise(first)]


def _banded(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """``(doc_id, sha, keys)`` for texts that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, SLICE):
            bags = _shingled(b.column("text"), shingle)
            keys = band_keys(signatures(bags, bands * rows), bands, rows).view(np.int64)
            some = [i for i, x in enumerate(bags) if len(x)]
            own = [b.column(c).take(pa.array(some, pa.int64())) for c in ("doc_id", "sha")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(keys[some].tolist(), pa.list_(pa.int64()))], ["doc_id", "sha", "keys"])

    return docs.select("doc_id", "sha", "text").mapInArrow(run, "doc_id long, sha string, keys array<long>")


def _bags(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, SLICE):
            found = [expanded(x).tobytes() for x in _shingled(b.column("text"), shingle)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.binary())], ["member", "bag"])

    return docs.select("doc_id", "text").mapInArrow(run, "member long, bag binary")


def _compared(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """``(member, leader, similarity)`` for pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            two = zip(b.column("bag").to_pylist(), b.column("lead_bag").to_pylist(), strict=True)
            found = [overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in two]
            yield pa.RecordBatch.from_arrays([b.column("member"), b.column("leader"), pa.array(found, pa.float64())], ["member", "leader", "similarity"])

    # a leader of many is dealt out: its bag is repeated once for every so many members
    parts = pairs.groupBy("leader").agg((F.expr(f"count(1) div {PER_PART}") + 1).alias("parts"))
    lead = bags.withColumnsRenamed({"member": "leader", "bag": "lead_bag"}).join(parts, "leader")
    lead = lead.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    dealt = pairs.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts"))).drop("parts")
    both = dealt.join(bags, "member").join(lead, ["leader", "part"])
    return both.select("member", "leader", "bag", "lead_bag").mapInArrow(run, "member long, leader long, similarity double")


def shared_elements(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many elements each of ``xs`` shares with each of ``ys``, sorted sets, by products of 0/1 matrices."""
    common = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    out = np.zeros((len(xs), len(ys)), np.int64)
    if not len(common):
        return out

    def placed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        of, flat = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        hit = common[at] == flat
        of, at = of[hit], at[hit]
        order = np.argsort(at, kind="stable")
        return of[order], at[order]

    both = [placed(xs), placed(ys)]
    for low in range(0, len(common), width):
        parts = []
        for (of, at), n in zip(both, (len(xs), len(ys)), strict=True):
            span = slice(*np.searchsorted(at, (low, low + width)))
            m = np.zeros((n, min(width, len(common) - low)), np.float32)
            m[of[span], at[span] - low] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def _crossed(rows: DataFrame, similarity: float) -> DataFrame:
    """Links ``(member, leader, similarity)`` between the ``lead`` rows and the others of each ``(key, o, p)``."""

    def run(t: pa.Table) -> pa.Table:
        member, size, to_lead, cls, other, lead = (t.column(c).to_numpy() for c in ("member", "size", "similarity", "class", "other", "lead"))
        a, b = np.flatnonzero(lead), np.flatnonzero(~lead)
        ask = (cls[a][:, None] != cls[b]) & (~other[b] | (member[a][:, None] < member[b]))
        ask &= np.abs(to_lead[a][:, None] - to_lead[b]) <= 1 - similarity + SLACK
        ask &= np.minimum(size[a][:, None], size[b]) >= (similarity - SLACK) * np.maximum(size[a][:, None], size[b])
        some_a, some_b = ask.any(axis=1), ask.any(axis=0)
        a, b, ask = a[some_a], b[some_b], ask[some_a][:, some_b]
        found = np.zeros(ask.shape)
        if len(a):
            bags = t.column("bag")
            sets = lambda at: [np.frombuffer(bags[int(i)].as_py(), np.uint64) for i in at]
            both = shared_elements(sets(a), sets(b))
            found = both / (size[a][:, None] + size[b] - both)
        i, j = np.nonzero(ask & (found >= similarity))
        return pa.table({"member": pa.array(member[b[j]], pa.int64()), "leader": pa.array(member[a[i]], pa.int64()), "similarity": pa.array(found[i, j], pa.float64())})

    return rows.groupBy("key", "o", "p").applyInArrow(run, "member long, leader long, similarity double")


def _finished(told: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Links ``(member, leader, similarity)`` between members of one bucket that the leaders left open.

    ``told`` has per bucket ``key`` and ``member`` but the leader its ``similarity`` to the leader, ``size``,
    ``class`` and whether that is an ``other`` than the leader's. Of two members of the leader's class nothing is open.
    """
    # 1 - similarity is a metric: texts whose similarities to the leader differ by more than this can't match
    reach = 1 - similarity + SLACK
    o = lambda f, c: f(F.when(F.col("other"), F.col(c)))
    spans = told.groupBy("key").agg(o(F.min, "similarity").alias("low"), o(F.max, "similarity").alias("high"), o(F.min, "size").alias("short"), o(F.max, "size").alias("long"), F.count(F.lit(1)).alias("n"))
    spans = spans.where("n > 1 and low is not null").drop("n")
    fits = (F.col("similarity") >= F.col("low") - reach) & (F.col("similarity") <= F.col("high") + reach)
    fits &= (F.col("size") >= (similarity - SLACK) * F.col("short")) & ((similarity - SLACK) * F.col("size") <= F.col("long"))
    near = stored(told.join(spans, "key").where(F.col("other") | fits).select(*told.columns), "open")
    counts = near.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("other").alias("n_other")).where("n > 1")
    near = with_figures(near, counts, ["key"])
    few = near.where(F.col("n") * F.col("n_other") <= PAIRED).drop("n", "n_other")
    a = few.where("other").select("key", *[F.col(c).alias(f"a_{c}") for c in ("member", "similarity", "size", "class")])
    met = a.join(few, "key").where((F.col("a_class") != F.col("class")) & (~F.col("other") | (F.col("a_member") < F.col("member"))))
    met = met.where((F.abs(F.col("a_similarity") - F.col("similarity")) <= reach) & (F.least("a_size", "size") >= (similarity - SLACK) * F.greatest("a_size", "size")))
    pairs = met.select(F.greatest("a_member", "member").alias("member"), F.least("a_member", "member").alias("leader")).distinct()
    paired = _compared(stored(pairs, "pairs"), bags).where(F.col("similarity") >= similarity)
    many = near.where(F.col("n") * F.col("n_other") > PAIRED)
    own = lambda c: F.pmod(F.xxhash64("member"), F.expr(f"{c} div {BLOCK} + 1"))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"{c} div {BLOCK}")))
    leads = many.where("other").withColumn("lead", F.lit(True)).withColumn("o", own("n_other")).withColumn("p", each("n"))
    others = many.withColumn("lead", F.lit(False)).withColumn("o", each("n_other")).withColumn("p", own("n"))
    dealt = leads.unionAll(others).drop("n", "n_other").join(bags, "member")
    return paired.unionAll(_crossed(dealt, similarity))


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` from links ``(a, b)``: the least node that links lead to.

    Alternates large-star and small-star steps, each a grouping by node that first takes a least
    neighbour per task, and stops when a round changes no link.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = stored(small.where("u <> v").distinct(), "links")
        changed = after.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(after, ["u", "v"], "left_anti").limit(1).count()
        edges = after
        if not changed:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_links(docs: DataFrame, only: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Verified links ``(member, leader, similarity)`` between the texts of ``docs`` (doc_id, sha, text)
    whose ``(doc_id, sha)`` is in ``only``. Texts are read where they are; those of members of shared
    buckets are moved once, to make their bags."""
    keyed = stored(_banded(docs, shingle, bands, rows).join(only, ["doc_id", "sha"], "left_semi"), "bands")
    each = keyed.select(F.col("doc_id").alias("member"), F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = with_figures(each, shared, ["key"])
    score = met.groupBy("member").agg(F.sum("n").alias("score"))
    open_ = stored(met.select("key", "member").join(score, "member"), "members")
    candidates = open_.select(F.col("member").alias("doc_id")).distinct().join(only, "doc_id")
    # the candidates grow with the corpus, so they are never broadcast
    bags = stored(_bags(docs.join(candidates.hint("merge"), ["doc_id", "sha"], "left_semi"), shingle), "bags")
    leaders = open_.groupBy("key").agg(F.max_by("member", F.struct("score", -F.col("member"))).alias("leader"))
    led = stored(open_.join(leaders, "key").where("member <> leader").select("key", "member", "leader"), "led")
    found = stored(_compared(led.select("member", "leader").distinct(), bags), "compared")
    links = found.where(F.col("similarity") >= similarity)
    classes = components(links.select(F.col("member").alias("a"), F.col("leader").alias("b")))
    of = lambda c: classes.select(F.col("node").alias(c), F.col("component").alias(f"{c}_class"))
    sizes = bags.select("member", F.expr("octet_length(bag) div 8").alias("size"))
    told = led.join(found, ["member", "leader"]).join(sizes, "member").join(of("member"), "member", "left").join(of("leader"), "leader", "left")
    own = F.coalesce("member_class", "member")
    told = told.select("key", "member", "similarity", "size", own.alias("class"), (own != F.coalesce("leader_class", "leader")).alias("other"))
    return links.unionAll(stored(_finished(stored(told, "told"), bags, similarity), "finished"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, class_id, class_size`` per row: documents that links of at least ``similarity`` join.

    ``class_id`` is the least doc_id of a class. Copies of a text share its class without being
    compared; texts without words, null ones among them, are classes of their own. A row with a
    null doc_id has a null class of size 1. Several rows of one doc_id form one class. Texts are compared whole,
    very long ones too. Other columns are left out; no rows give none.
    """
    keyed = docs.select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).where("doc_id is not null")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    firsts = stored(keyed.where(worded).groupBy("sha").agg(F.min("doc_id").alias("first")), "firsts")
    # one text stands for its copies: the copy with the least id, of several rows the first by hash
    only = stored(firsts.groupBy(F.col("first").alias("doc_id")).agg(F.min("sha").alias("sha")), "only")
    links = near_links(keyed, only, shingle, similarity, bands, rows).select(F.col("member").alias("a"), F.col("leader").alias("b"))
    ids = keyed.select("doc_id", "sha").join(firsts, "sha", "left").select("doc_id", F.coalesce("first", "doc_id").alias("first"))
    # rows of one id with several texts tie those texts together
    tied = ids.where("first <> doc_id").join(firsts.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    found = components(links.unionAll(tied))
    classed = stored(ids.join(found, F.col("first") == F.col("node"), "left").select("doc_id", F.coalesce("component", "first").alias("class_id")), "classes")
    # members of a hot class don't meet in one task
    sized = with_figures(classed, classed.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")), ["class_id"], "class_size")
    none = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return sized.select("doc_id", "class_id", "class_size").unionAll(none)

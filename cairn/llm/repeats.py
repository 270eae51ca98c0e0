"""Passages that several documents share, found by sampled seeds and settled window by window.

A document is a sequence of symbols (words or bytes). A window of ``length`` symbols is repeated if the
same symbols start in a document with a smaller id. Comparing all windows would shuffle a row per
symbol, so each window picks a seed of ``seed`` symbols inside it by its content alone: equal windows
pick equal seeds. Consecutive windows that pick one seed are a bundle, and bundles are what moves:

1. seeds that occur in one document alone are dropped, with all their windows;
2. bundles of the rest are named by the whole text they span; of equal ones the least document counts,
   and every window of the others is repeated;
3. where a seed has bundles of different text, the least document of each shows its windows, named by
   the pair of names that their first and last ``seed`` symbols have: the step from names of one length
   to names of a greater one, as in prefix doubling. A few bundles of a seed meet as they are; the
   windows of many are grouped by name.

Documents with equal texts are settled first. Groupings take minima per task before they shuffle. Joins back are between written tables, so that
Spark sees both sides' sizes and can split a seed that a third of all documents share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.hashing import _INVERSES, _POWERS, PIECE, in_slices, mix
from cairn.llm.spreading import with_figures
from cairn.sources.tables import scratch, stored

#: Gives the symbols of a column of texts, one text after the other, and where each text's start; the last entry is the end.
Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Shape:
    """Window length, seed length (half of it at least), and length of the pieces whose least hash places the seed.

    The least of the window's pieces of ``piece`` symbols, the first of equals, is at x; the seed starts
    at its distance from the window's start modulo the number of places that a seed has.
    """

    length: int
    seed: int
    piece: int

    @property
    def places(self) -> int:
        return self.length - self.seed + 1


@dataclass(frozen=True)
class Bundles:
    """Of each bundle: its text, first window, number of windows, seed hash and hash of the text it spans."""

    doc: np.ndarray
    first: np.ndarray
    count: np.ndarray
    seed: np.ndarray
    text: np.ndarray


#: Windows in a bundle, at most: they are told apart by the bits of a long.
BITS = 63
#: Different bundles of one seed that a task may compare; beyond, Spark groups them by window.
TOGETHER = 256
_FOLD = np.uint64(0xC2B2AE3D27D4EB4F)
_AT = np.arange(PIECE, dtype=np.uint32)
#: A place in a piece of symbols takes the low bits of 32.
_PLACE = np.uint32(PIECE - 1)


class _Hashed:
    """Symbols that are 64-bit hashes, named from prefix sums of a polynomial."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * _POWERS[: len(symbols)], out=self.sums[1:])

    def names(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the ``length`` symbols from each of ``at``."""
        return mix((self.sums[at + length] - self.sums[at]) * _INVERSES[at], 22)

    def pieces(self, length: int) -> np.ndarray:
        """32-bit hashes of all pieces."""
        return ((self.sums[length:] - self.sums[:-length]) * _INVERSES[: len(self.sums) - length] >> np.uint64(32)).astype(np.uint32)


class _Bytes:
    """Symbols that are bytes, named from the words of eight bytes that they make."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols = np.ascontiguousarray(symbols)

    def _words(self, kind: type) -> np.ndarray:
        """The number that the bytes from each place on make."""
        size = np.dtype(kind).itemsize
        return np.ndarray((max(0, len(self.symbols) - size + 1),), kind, self.symbols, 0, (1,))

    def names(self, at: np.ndarray, length: int) -> np.ndarray:
        words, out = self._words(np.uint64), np.zeros(len(at), np.uint64)
        for k in (*range(0, length - 8, 8), length - 8):
            out = mix(out ^ words[at + k], 22)
        return out

    def pieces(self, length: int) -> np.ndarray:
        n = len(self.symbols) - length + 1
        out = self._words(np.uint32)[:n].copy()
        for k in range(4, length):
            out *= np.uint32(0x85EBCA6B)
            out += self.symbols[k : n + k]
        return out * np.uint32(0x9E3779B1)


def _seed_starts(pieces: np.ndarray, shape: Shape) -> np.ndarray:
    """The start of each window's seed, by window."""
    span = shape.length - shape.piece + 1
    n = len(pieces) - span + 1
    least = (pieces & ~_PLACE) | _AT[: len(pieces)]
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    ahead = (least & _PLACE) - _AT[:n]
    return _AT[:n] + (ahead - ahead // np.uint32(shape.places) * np.uint32(shape.places))


def _window_names(read: _Hashed | _Bytes, at: np.ndarray, shape: Shape) -> np.ndarray:
    """Names of the windows from each of ``at``, of the pair of names of their first and last symbols."""
    return mix(read.names(at, shape.seed), 23) ^ read.names(at + shape.length - shape.seed, shape.seed)


def _bundled(symbols: np.ndarray, starts: np.ndarray, first_doc: int, shape: Shape) -> tuple[_Hashed | _Bytes, Bundles]:
    """The bundles of texts that follow one another; ``starts`` has their starts, and the end."""
    read = _Bytes(symbols) if symbols.dtype == np.uint8 else _Hashed(symbols)
    at = _seed_starts(read.pieces(shape.piece), shape)
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    if shape.places > BITS:
        part = (at - _AT[: len(at)]) // np.uint32(BITS)
        new[1:] |= part[1:] != part[:-1]
    # a text's windows begin with it, and those that would reach into the next one are a bundle to be dropped
    new[starts[:-1][starts[:-1] < len(at)]] = True
    over = starts[1:] - shape.length + 1
    new[over[(over > 0) & (over < len(at))]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    doc = np.searchsorted(starts, first, "right") - 1
    sound = first + shape.length <= starts[doc + 1]
    first, count, doc = first[sound], count[sound], doc[sound]
    # the text of a bundle, from its first and last window and the number of windows
    last = _window_names(read, first + count - 1, shape)
    text = _window_names(read, first, shape) ^ (last * np.uint64(0x9FB21C651E98DF25)) ^ (count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return read, Bundles(doc + first_doc, first, count, read.names(at[first], shape.seed), text)


def _in_pieces(symbols: np.ndarray, starts: np.ndarray, shape: Shape) -> Iterator[tuple[int, _Hashed | _Bytes, Bundles]]:
    """Texts in pieces, many short ones or a part of a long one each: where a piece begins, its symbols and bundles.

    The parts of a long text share no window. Where one ends a bundle may be cut, which changes nothing but
    that its windows are compared one by one.
    """
    if shape.seed < 8 and symbols.dtype == np.uint8:
        raise ValueError("strings of bytes must be so long that their seeds have 8 bytes")
    doc, step = 0, PIECE - shape.length
    while doc < len(starts) - 1:
        begin = int(starts[doc])
        after = int(np.searchsorted(starts, begin + PIECE, "right")) - 1
        if after > doc:
            if starts[after] - begin >= shape.length:
                yield begin, *_bundled(symbols[begin : starts[after]], starts[doc : after + 1] - begin, doc, shape)
            doc = after
            continue
        end = int(starts[doc + 1])
        for at in range(begin, end - shape.length + 1, step):
            part = symbols[at : min(end, at + step + shape.length - 1)]
            yield at, *_bundled(part, np.array([0, len(part)]), doc, shape)
        doc += 1


def bundles(symbols: np.ndarray, shape: Shape) -> Bundles:
    """All bundles of a text."""
    found = [Bundles(b.doc, begin + b.first, b.count, b.seed, b.text) for begin, _, b in _in_pieces(symbols, np.array([0, len(symbols)]), shape)]
    none = Bundles(*[np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)])
    return Bundles(*(np.concatenate([getattr(b, f) for b in [none, *found]]) for f in ("doc", "first", "count", "seed", "text")))


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)


def _bundle_rows(docs: DataFrame, symbols: Symbols, shape: Shape) -> DataFrame:
    """``(seed, body, doc)`` of every bundle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            ids = _ids(b)
            for _, _, found in _in_pieces(*symbols(b.column("text")), shape):
                yield pa.RecordBatch.from_arrays([_signed(found.seed), _signed(found.text), pa.array(ids[found.doc])], ["seed", "body", "doc"])

    return docs.select("doc_id", "text").mapInArrow(run, "seed long, body long, doc long")


def sharing(docs: DataFrame, symbols: Symbols, shape: Shape) -> DataFrame:
    """``doc_id`` of the documents with a seed that another one has too."""
    rows = _bundle_rows(docs, symbols, shape).select("seed", "doc")
    spread = stored(rows.groupBy("seed").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("seed"), "seeds")
    return rows.join(spread, "seed", "left_semi").select(F.col("doc").alias("doc_id")).distinct()


def _marks(texts: DataFrame, symbols: Symbols, shape: Shape) -> DataFrame:
    """``doc_id, marks``: of each text's bundles those with windows that a smaller id has too, and which, as bits."""
    rows = _bundle_rows(texts, symbols, shape)
    # one narrow row a seed, or a seed and body: hashed rather than sorted along with all bundles
    spread = stored(rows.groupBy("seed").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("seed"), "seeds")
    shared = stored(rows.join(spread.hint("shuffle_hash"), "seed"), "shared")
    variants = stored(shared.groupBy("seed", "body").agg(F.min("doc").alias("first"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n")), "variants")
    # equal bundles: all but the least document's are repeated throughout
    twice = variants.where("first < hi").select("seed", "body", "first", "n")
    whole = with_figures(shared, twice, ["seed", "body"], how="shuffle_hash").where("doc > first").select("doc", "seed", "body", F.lit(-1).cast("long").alias("bits"))
    # different bundles of one seed: their windows, each bundle shown by its least document
    several = variants.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed", (F.col("n") > TOGETHER).alias("many"))
    mixed = variants.join(several, "seed").select(F.col("first").alias("doc_id"), "seed", "body", "many")
    asked = mixed.groupBy("doc_id").agg(F.collect_list(F.struct("seed", "body", "many")).alias("asked"))
    shown = texts.join(asked, "doc_id").mapInArrow(_shown(symbols, shape), "seed long, body long, doc long, many boolean, names array<long>")
    shown = stored(shown, "shown")
    few = shown.where("not many").select("seed", "body", "doc", "names").repartition("seed").sortWithinPartitions("seed")
    few = few.mapInArrow(_judged_together, "doc long, seed long, body long, bits long")
    # a seed with many bundles goes by window, and minima are taken before the shuffle
    windows = shown.where("many").select("seed", "body", "doc", F.posexplode("names").alias("at", "name"))
    first = windows.groupBy("seed", "name").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("seed", "name", "first")
    part = windows.join(stored(first, "firsts"), ["seed", "name"]).where("doc > first")
    part = part.groupBy("doc", "seed", "body").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))
    return whole.unionAll(few).unionAll(part).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("seed", "body", "bits")).alias("marks"))


def marked_windows(docs: DataFrame, symbols: Symbols, shape: Shape) -> DataFrame:
    """``docs`` (no null ids) with ``marks``, bundles with repeated windows and which, as bits, and ``whole``,
    whether a smaller id has the whole text, so that all windows are repeated.

    Marks name their bundles by content, so they hold wherever a document of this id has it.
    """
    digest = F.sha2(F.col("text").cast("binary"), 256)
    texts = docs.where("text is not null").select("doc_id", "text", digest.alias("digest"))
    # copies of a text say nothing that the least document doesn't: it alone is looked into
    owners = stored(texts.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("hi")), "owners")
    copies = texts.select("doc_id", "digest").join(owners.where("owner < hi"), "digest").where("doc_id > owner")
    copies = copies.groupBy("doc_id").agg(F.collect_set("digest").alias("copied"))
    texts = texts.join(owners.select("digest", F.col("owner").alias("doc_id")), ["doc_id", "digest"], "left_semi").select("doc_id", "text")

    # once the marks are written, nothing that led to them is needed
    with scratch(docs.sparkSession) as keep:
        marks = keep(_marks(texts, symbols, shape), "marks")
    whole_copy = F.when(F.col("copied").isNotNull(), F.array_contains("copied", digest))
    return docs.join(marks, "doc_id", "left").join(copies, "doc_id", "left").withColumn("whole", whole_copy).drop("copied")


def _shown(symbols: Symbols, shape: Shape) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            ids, wanted = _ids(b), _Wanted(b.column("asked"))
            many = wanted.rows.field("many")
            for _, read, found in _in_pieces(*symbols(b.column("text")), shape):
                keep, place = wanted.matching(found)
                if not len(keep):
                    continue
                at, count = _windows_of(found, keep)
                names = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), _signed(_window_names(read, at, shape)))
                doc = pa.array(ids[found.doc[keep]])
                yield pa.RecordBatch.from_arrays([_signed(found.seed[keep]), _signed(found.text[keep]), doc, many.take(pa.array(place)), names], ["seed", "body", "doc", "many", "names"])

    return go


def _windows_of(found: Bundles, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of some bundles, one bundle after the other, and how many each has."""
    count = found.count[keep]
    return np.repeat(found.first[keep] - np.cumsum(count) + count, count) + np.arange(count.sum()), count


def _judged_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which windows of each bundle a smaller document shows too; rows come sorted by seed, at most ``TOGETHER`` a seed."""
    held = None

    def judged(b: pa.RecordBatch) -> pa.RecordBatch:
        names = b.column("names")
        count = np.diff(names.offsets.to_numpy())
        row = np.repeat(np.arange(b.num_rows), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        doc = b.column("doc").to_numpy()
        seed = b.column("seed").to_numpy().view(np.uint64)
        key = names.flatten().to_numpy().view(np.uint64) ^ mix(seed, 24)[row]
        order = np.lexsort((doc[row], key))
        key, row, at = key[order], row[order], at[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = doc[row[new]][np.cumsum(new) - 1]
        later = doc[row] > first
        bits = np.zeros(b.num_rows, np.int64)
        np.bitwise_or.at(bits, row[later], np.int64(1) << at[later])
        hit = np.flatnonzero(bits)
        return pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(hit)) for c in ("doc", "seed", "body")], pa.array(bits[hit])], ["doc", "seed", "body", "bits"])

    for b in batches:
        if held is not None:
            b = pa.concat_batches([held, b])
        if not b.num_rows:
            continue
        # the last seed may go on in the next batch
        cut = int(np.argmax(b.column("seed").to_numpy() == b.column("seed")[-1].as_py()))
        held = b.slice(cut)
        if cut:
            yield judged(b.slice(0, cut))
    if held is not None:
        yield judged(held)


class _Wanted:
    """Bundles (seed, body) that are looked for, by row of a column of lists."""

    def __init__(self, lists: pa.ListArray) -> None:
        self.rows = lists.flatten()
        counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        self.doc = np.repeat(np.arange(len(lists)), counts)
        self.seed, self.body = (self.rows.field(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in ("seed", "body"))
        keys = self._keys(self.doc, self.seed, self.body)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    @staticmethod
    def _keys(doc: np.ndarray, seed: np.ndarray, body: np.ndarray) -> np.ndarray:
        return seed ^ (body * _FOLD) ^ mix(doc.astype(np.uint64), 25)

    def matching(self, found: Bundles) -> tuple[np.ndarray, np.ndarray]:
        """Which bundles are among the wanted of their row, and which of the wanted each one is."""
        if not len(self.keys) or not len(found.first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ours = self._keys(found.doc, found.seed, found.text)
        place = self.order[np.minimum(np.searchsorted(self.keys, ours), len(self.keys) - 1)]
        keep = np.flatnonzero((self.seed[place] == found.seed) & (self.body[place] == found.text) & (self.doc[place] == found.doc))
        return keep, place[keep]


def covered(b: pa.RecordBatch, symbols: np.ndarray, starts: np.ndarray, shape: Shape) -> np.ndarray:
    """Whether each symbol of a batch's texts lies in a repeated window; the batch has ``marks`` and ``whole``."""
    depth = np.zeros(len(symbols) + 1, np.int32)
    marks, whole = b.column("marks"), b.column("whole").fill_null(False).to_numpy(zero_copy_only=False)
    long = np.diff(starts) >= shape.length
    depth[starts[:-1][whole & long]] += 1
    depth[starts[1:][whole & long]] -= 1
    if len(marks.flatten()):
        wanted = _Wanted(marks)
        bits_of = wanted.rows.field("bits").to_numpy(zero_copy_only=False)
        for begin, _, found in _in_pieces(symbols, starts, shape):
            keep, place = wanted.matching(found)
            at, count = _windows_of(found, keep)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            start = begin + at[(np.repeat(bits_of[place], count) >> nth) & 1 == 1]
            # windows start at different symbols
            depth[start] += 1
            depth[start + shape.length] -= 1
    return np.cumsum(depth[:-1], dtype=np.int32) > 0


def runs(gone: np.ndarray, starts: np.ndarray) -> tuple[pa.ListArray, np.ndarray]:
    """The runs of a batch's covered symbols as lists of (start, length) by text, and their total lengths."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[1:-1] = gone[1:] != gone[:-1]
    edge[starts] = True  # a run ends with its text
    at = np.flatnonzero(edge[:-1])
    first = at[gone[at]]
    length = np.append(at[1:], len(gone))[gone[at]] - first
    doc = np.searchsorted(starts, first, "right") - 1
    lists = np.append(0, np.cumsum(np.bincount(doc, minlength=len(starts) - 1))).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(first - starts[doc]), pa.array(length)], ["start", "length"])
    return pa.ListArray.from_arrays(pa.array(lists), spans), np.bincount(doc, length, len(starts) - 1).astype(np.int64)

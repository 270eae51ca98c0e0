"""Suffix dedup: removes bytes of strings that start in an earlier document as well.

Distributed prefix doubling over names. Positions chosen by content get the name of the 28 bytes from
there; positions whose name no other document has drop out, as unique suffixes do. Of the rest, the pair of
the names at a position and at 22 bytes further names 50 bytes, past the threshold, where doubling
ends. Names are 64-bit hashes of the bytes and not ranks of a global sort: ranking every position
would shuffle over 16 bytes for each byte of text and round (see the README). Passages that copies
share are judged once, by :mod:`cairn.llm.repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import repeats
from cairn.llm.hashing import bytes_of, in_slices
from cairn.sources.tables import stored

#: Bytes in a string.
LENGTH = 50


def shape(length: int = LENGTH) -> repeats.Shape:
    return repeats.Shape(length, length * 28 // 50, 5)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` per row of ``docs``.

    A byte of the UTF-8 text goes if it lies in ``length`` bytes (15 at least) that also start in a document with a
    smaller doc_id, judged on the input; matches never cross documents. ``spans`` are the maximal removed
    runs and ``kept`` the other bytes, which may cut a character. A null text has no bytes. A row with a
    null doc_id is neither judged nor a source; rows of one doc_id count as one document. A very long text is worked through
    in pieces. No rows give no result. Columns but ``doc_id`` and ``text`` are left out.
    """
    docs = docs.select("doc_id", "text")
    marked = repeats.marked_windows(docs.where("doc_id is not null"), bytes_of, shape(length))
    marked = marked.unionByName(docs.where("doc_id is null"), allowMissingColumns=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            raw, starts = bytes_of(b.column("text"))
            gone = repeats.covered(b, raw, starts, shape(length))
            spans, removed = repeats.runs(gone, starts)
            left = np.append(0, np.cumsum(np.diff(starts) - removed)).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(left), pa.py_buffer(np.ascontiguousarray(raw[~gone]))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(starts)), pa.array(removed), spans, kept], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return marked.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, kept binary")


def doubled_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, start`` of every string of ``length`` bytes (8 at least) that also starts in a document with a smaller id.

    Prefix doubling over all positions, as it is dealt: a row per byte of text with the rank of the 8 bytes from there; in each
    round positions are paired with the ranks at an offset that doubles, the pairs are ranked anew, and positions whose pair is
    unique are dropped, as all longer strings from there are unique too. The last offset ends at the threshold. It gives what
    :func:`remove_repeats` is built on, at a cost that a corpus can't bear (figures in the README), and serves to test it. Null ids
    and texts have no strings.
    """

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 1 << 19):
            raw, starts = bytes_of(b.column("text"))
            if len(raw) < 8:
                continue
            words = np.ndarray((len(raw) - 7,), np.int64, np.ascontiguousarray(raw), 0, (1,))
            doc = np.searchsorted(starts, np.arange(len(words)), "right") - 1
            sound = np.arange(len(words)) + 8 <= starts[doc + 1]
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)[doc[sound]].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.flatnonzero(sound) - starts[doc[sound]]), pa.array(np.ascontiguousarray(words[sound]))], ["doc_id", "pos", "rank"])

    known = docs.where("doc_id is not null and text is not null").select("doc_id", "text").distinct()
    at = known.mapInArrow(positions, "doc_id long, pos long, rank long")
    span = 8

    def shared(rows: DataFrame) -> DataFrame:
        """Rows of ranks that two documents have."""
        ranks = rows.groupBy("rank").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("rank")
        return stored(rows.join(ranks, "rank", "left_semi"), "ranks")

    at = shared(at)
    while span < length:
        offset = min(span, length - span)
        further = at.select("doc_id", (F.col("pos") - offset).alias("pos"), F.col("rank").alias("after"))
        paired = at.join(further, ["doc_id", "pos"])
        # equal pairs get one rank; the sort by pairs deals them out in order
        ordered = paired.repartitionByRange("rank", "after").sortWithinPartitions("rank", "after")
        at = shared(ordered.select("doc_id", "pos", F.xxhash64("rank", "after").alias("rank")))
        span += offset
    first = at.groupBy("rank").agg(F.min("doc_id").alias("least"))
    return at.join(first, "rank").where("doc_id > least").select("doc_id", F.col("pos").alias("start")).distinct()

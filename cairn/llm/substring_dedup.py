"""Substring dedup: removes words of passages that start in an earlier document as well.

Level-wise doubling. Windows of half the threshold's length come first: those that no other document has
are dropped, the rest are extended to twice the length, the threshold, and judged there
(:mod:`cairn.llm.repeats`). A passage that repeats at a greater length repeats at the threshold
too, so removal needs no further level; :func:`longest_repeats` goes on doubling, with the documents
that had a repeat at one length alone, until no candidate survives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.llm import repeats
from cairn.llm.hashing import in_slices, words_in
from cairn.llm.words import count_words, set_aside
from cairn.sources.tables import stored

#: Words in a window.
WINDOW = 50


def shape(window: int = WINDOW) -> repeats.Shape:
    return repeats.Shape(window, (window + 1) // 2, (window + 1) // 2)


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, _, _, _, words, first = words_in(texts)
    return words, first


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without ``text`` but with ``n_words, n_removed, spans, kept_text``.

    A word goes if it lies in a window of ``window`` words that also starts in a document with a smaller
    doc_id, judged on the input. ``spans`` are the removed runs (start, length in words) and
    ``kept_text`` the kept words joined by blanks. A null text has no words. A row with a null doc_id
    is neither judged nor a source; rows of one doc_id count as one document and each loses the
    same windows. A very long text is worked through in pieces. No rows give no result. Other columns pass through; those
    with the new names are replaced.
    """
    docs, restored = set_aside(docs.drop("n_words", "n_removed", "spans", "kept_text"), ["marks", "copied", "whole"])
    others = [f for f in docs.schema if f.name != "text"]
    names = [f.name for f in others]
    marked = repeats.marked_windows(docs.where("doc_id is not null"), _symbols, shape(window))
    marked = marked.unionByName(docs.where("doc_id is null"), allowMissingColumns=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            raw, starts, begins, ends, words, first = words_in(b.column("text"))
            gone = repeats.covered(b, words, first, shape(window))
            spans, removed = repeats.runs(gone, first)
            begins, ends = begins[~gone], ends[~gone]
            # a blank before each kept word but the first of its text, in place of the byte before it
            following = np.flatnonzero(np.diff(np.searchsorted(starts, begins, "right"), prepend=0) == 0)
            edge = np.zeros(len(raw) + 1, np.int8)
            edge[begins] += 1
            edge[ends] -= 1
            keep = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
            raw, blank = raw.copy(), begins[following] - 1
            raw[blank], keep[blank] = 32, True
            left = np.append(0, np.cumsum(keep))[starts].astype(np.int32)
            kept = pa.Array.from_buffers(pa.string(), b.num_rows, [None, pa.py_buffer(left), pa.py_buffer(raw[keep])])
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(np.diff(first)), pa.array(removed), spans, kept], [*names, "n_words", "n_removed", "spans", "kept_text"])

    schema = StructType([*others, *StructType.fromDDL("n_words long, n_removed long, spans array<struct<start:long,length:long>>, kept_text string").fields])
    return restored(marked.mapInArrow(cut, schema))


def longest_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, longest``: the greatest of ``window``, its double and so on at which a window of the
    document also starts in one with a smaller id. Documents without any are left out."""
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    found, left, length = None, texts, window
    while True:
        shared = stored(repeats.sharing(left, _symbols, shape(length)), "sharing")
        left = texts.join(shared, "doc_id", "left_semi")
        marked = repeats.marked_windows(left, _symbols, shape(length))
        copy = F.col("whole") & (count_words(F.col("text")) >= length)
        hit = stored(marked.where(F.col("marks").isNotNull() | F.coalesce(copy, F.lit(False))).select("doc_id", F.lit(length).alias("longest")), "longest")
        if hit.limit(1).count() == 0:
            break
        found = hit if found is None else found.unionAll(hit)
        length *= 2
    if found is None:
        return docs.select("doc_id", F.lit(0).alias("longest")).limit(0)
    return found.groupBy("doc_id").agg(F.max("longest").alias("longest"))

"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on toxic and on ordinary text: each holds the words and word
beginnings that documents of its class have in significant excess over the other class, in
front of the words common to both. A text is cut into short windows at blanks, its
bytes marked by their place in their word; each window is compressed with both dictionaries, and the bytes that the toxic one saves are its distance. A
logistic calibration over a document's distances, fitted on labelled rows that had no part in the
dictionaries, gives the score.

Dictionaries and calibration come from a bounded sample of labelled rows; scoring covers whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from cairn.llm.sampling import least_hashed

#: Labelled rows learned from, at most, per class; bytes in a window.
SAMPLE, WINDOW = 3_000, 64
#: A unit is in excess if its log odds exceed this by three standard errors, in so many documents.
LEAST_ODDS, LEAST_DOCS = 0.5, 5
#: Words of both classes that each dictionary ends in, the most frequent ones. Held-out AUC on sf0.1: 0.943 with none, 0.946
#: with 500, 0.668 with all of the sample's, which push a class's own words out of the compressor's reach.
COMMON_WORDS = 500
#: A score from here on is predicted as toxic.
THRESHOLD = 0.3
#: Added to a byte's code for each byte before it in its word.
SHIFT = 37
STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~"


def units(text: str) -> set[str]:
    """The words of a text in lower case and, marked by a bar, their beginnings of 4 to 8 characters."""
    words = {w.strip(STRIP) for w in text.lower().split()} - {""}
    return words | {f"|{w[:n]}" for w in words for n in range(4, min(9, len(w)))}


def marked(text: str) -> tuple[bytes, bytes]:
    """The lower-case text, blanks made one, and the same with each byte shifted by its place in its word.

    So marked, two words share only what they share from their start: the inside of one word is
    no match for another's, and a dictionary's units count as words and beginnings of words.
    """
    raw = (" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace")
    b = np.frombuffer(raw, np.uint8)
    at = np.arange(len(b))
    blank = b == 32
    place = at - np.maximum.accumulate(np.where(blank, at, 0))
    return raw, np.where(blank, b, b + (place * SHIFT).astype(np.uint8)).astype(np.uint8).tobytes()


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The marked text, cut at the first blank after every ``size`` bytes."""
    raw, coded = marked(text)
    out, at = [], 0
    while at < len(raw) - 1:
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end + 1
        out.append(coded[at:end])
        at = end - 1 if end < len(raw) else end
    return out


@dataclass(frozen=True)
class Distance:
    """The two dictionaries and the calibration; ``weights`` is None before calibration."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...] | None = None
    base_rate: float = 0.0

    @cached_property
    def _compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        how = zstandard.ZstdCompressionParameters.from_level(
            5, window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)

        def of(content: bytes) -> zstandard.ZstdCompressor:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(compression_params=how, dict_data=d)

        return of(self.toxic), of(self.ordinary)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}

    def distances(self, text: str) -> np.ndarray:
        """Bytes that the toxic dictionary saves, by window. A passage that both dictionaries have
        stands before each window, so that short ones aren't stored uncompressed."""
        toxic, ordinary = self._compressors
        lead = self.ordinary[-80:-8]
        return np.array([len(ordinary.compress(lead + w)) - len(toxic.compress(lead + w)) for w in windows(text)], np.float64)

    def features(self, text: str | None) -> list[float]:
        d = self.distances(text) if text else np.zeros(0)
        if not len(d):
            return [0.0] * 6
        top = np.sort(d)[-3:]
        return [float(d.max() > 2), float(min(d.max(), 8)), float(top.mean()), float(np.log1p((d >= 3).sum())), float((d >= 3).mean()), float(d.mean())]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.base_rate
        z = float(np.dot(self.weights, [*self.features(text), 1.0]))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Rows ``(text, toxic, part)``: of each class the ``sample`` keys that hash least, in two parts.

    Keys are picked from the labels alone, so that only the picked rows' texts are moved.
    """
    sound = labels.where("key is not null and toxic in (0, 1)").select("key", F.col("toxic").cast("int").alias("toxic"))
    picked = least_hashed(sound, "toxic", F.xxhash64("key"), sample).select("key", "toxic", (F.col("nth") % 3 == 0).cast("int").alias("part"))
    return docs.where("text is not null").join(F.broadcast(picked), "key").select("text", "toxic", "part")


def _dictionaries(sample: DataFrame) -> tuple[bytes, bytes]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                found[toxic].update(units(text))
                found[toxic][""] += 1
        names = [*(found[0] | found[1])]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([f[k] for k in names], pa.int64()) for f in found)], ["unit", "ordinary", "toxic"])

    counts = sample.where("part = 0").select("text", "toxic").mapInArrow(count, "unit string, ordinary long, toxic long")
    counts = counts.groupBy("unit").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")).where(F.col("ordinary") + F.col("toxic") >= LEAST_DOCS)
    got = {r["unit"]: (r["ordinary"], r["toxic"]) for r in counts.collect()}  # bounded by the sample's words
    n_ordinary, n_toxic = got.pop("", (0, 0))

    def excess(a: int, n: int, b: int, m: int) -> float:
        return float(np.log((a + 0.5) / (n + 1)) - np.log((b + 0.5) / (m + 1)) - 3 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))

    def own(toxic: bool) -> list[str]:
        found = []
        for unit, (o, t) in got.items():
            a, n, b, m = (t, n_toxic, o, n_ordinary) if toxic else (o, n_ordinary, t, n_toxic)
            if a >= LEAST_DOCS and (e := excess(a, n, b, m)) > LEAST_ODDS:
                found.append((-e * a, unit))
        return [unit for _, unit in sorted(found)]

    toxic, ordinary = own(True), own(False)
    taken = {x.strip("|") for x in [*toxic, *ordinary]}
    common = sorted((w for w in got if w[0] != "|" and w not in taken and not any(w.startswith(x) for x in taken)), key=lambda w: (-sum(got[w]), w))[:COMMON_WORDS]
    # the most telling units stand last, next to the common words, where offsets are small
    part = lambda names: b"".join(marked(x.strip("|"))[1][: -1 if x[0] == "|" else None] for x in reversed(names))
    both = marked(" ".join(reversed(common)))[1].rjust(256, b"-")
    size = max(len(part(toxic)), len(part(ordinary)))
    return part(toxic).rjust(size, b"\0") + both, part(ordinary).rjust(size, b"\0") + both


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weights, the last for the constant, of a logistic regression by Newton's method."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    keep = np.diag([ridge] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + keep, z.T @ (p - y) / len(y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / spread
    return (*map(float, slopes), float(w[-1] - slopes @ mean))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Distance:
    """Learns from ``(key, text)`` and ``(key, toxic)``, of each class the ``sample`` keys that hash least.

    Null texts and keys and labels other than 0 and 1 are left out, repeated labels count once; a key with both labels is in
    both classes. All units in excess are kept: the sample bounds them. Without rows of both classes every
    score is the share of toxic rows, 0 if there are none.
    """
    rows = _sampled(docs, labels, sample)
    model = Distance(*_dictionaries(rows))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["toxic", "x"])

    got = sorted((r["toxic"], r["x"]) for r in rows.where("part = 1").select("toxic", "text").mapInArrow(measure, "toxic int, x array<double>").collect())
    y = np.array([t for t, _ in got], float)
    # the sample holds classes evenly; the calibration weighs them as all labelled rows do
    shares = {r["toxic"]: r["n"] for r in labels.where("key is not null and toxic in (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    rate = shares.get(1, 0) / total if total else 0.0
    if len(set(y)) < 2:
        return Distance(model.toxic, model.ordinary, None, rate)
    weights = _logistic(np.array([x for _, x in got]), y)
    shift = np.log(rate / (1 - rate)) - np.log(y.mean() / (1 - y.mean()))
    return Distance(model.toxic, model.ordinary, (*weights[:-1], weights[-1] + float(shift)), rate)


def score(docs: DataFrame, model: Distance, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (null: all) with ``score`` and ``predicted``.

    Null and empty texts have no windows and get the calibration's value for that. Whole texts are scored, window by window.
    Repeated rows get equal results, no rows give none; columns with the new names are replaced.
    """
    docs = docs.drop("score", "predicted")
    kept = docs.columns if keep is None else keep

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            scores = [model.score(t) for t in texts]
            found = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*map(b.column, kept), *found], [*kept, "score", "predicted"])

    schema = StructType([docs.schema[k] for k in kept]).add("score", DoubleType()).add("predicted", IntegerType())
    return docs.mapInArrow(predict, schema)

"""Language identification by nearest centroid.

A text is a vector of hashed character n-grams weighed by TF-IDF and of length 1. Spark picks a
bounded sample of labelled texts per language and turns it into vectors on the executors, where each
language's are clustered into a few centroids by spherical k-means. Any text then gets the
language of the centroid with the largest cosine, and is rejected if even that one is far away.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from cairn.llm.sampling import least_hashed
from cairn.sources.tables import stored

#: Length of a vector (a power of two).
SIZE = 1 << 13
#: Texts per language that are learned from, at most; centroids per language; k-means rounds.
SAMPLE, CENTROIDS, ROUNDS = 300, 4, 12
#: A text is rejected if its cosine to the nearest centroid is below this share of the sample's least.
REJECT = 0.5
UNKNOWN = "und"
#: Of the ASCII characters, letters stay and all else becomes a blank.
PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes hashed at once.
BLOCK = 1 << 20


def has_letter(text: str) -> bool:
    """Whether a text has a letter of any script; digits, fractions and numerals aren't letters."""
    return any(map(str.isalpha, text))


def features(text: str, size: int = SIZE) -> np.ndarray:
    """Counts of hashed n-grams of one to three bytes over the lower-case text; what isn't a letter is blank."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(PLAIN).split()) + b" ", np.uint8)
    counts = np.zeros(size, np.float32)
    shift = 32 - (size.bit_length() - 1)
    for at in range(0, len(raw), BLOCK):
        b = raw[at : at + BLOCK + 2].astype(np.uint32)
        for n in (1, 2, 3):
            last = min(BLOCK, len(b) - n + 1)
            if last <= 0:
                continue
            g = np.full(last, n, np.uint32)
            for k in range(n):
                g = g * np.uint32(257) + b[k : k + last]
            g = (g * np.uint32(2654435761)) >> np.uint32(shift)
            counts += np.bincount(g, minlength=size).astype(np.float32)
    return counts


@dataclass(frozen=True)
class Centroids:
    """What is learned: a language per centroid, the centroids, the n-grams' IDF and the least cosine."""

    languages: list[str]
    vectors: np.ndarray
    idf: np.ndarray
    least: float

    def vector(self, text: str) -> np.ndarray:
        v = np.log1p(features(text, len(self.idf))) * self.idf
        length = float(np.sqrt(v @ v))
        return v / length if length else v

    def nearest(self, text: str) -> tuple[str, float]:
        """Language and cosine of the nearest centroid; ties go to the first language."""
        cosines = self.vectors @ self.vector(text)
        best = int(np.argmax(cosines))
        return self.languages[best], float(min(1.0, max(0.0, cosines[best])))


def _clusters(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; starts from the first row and then the farthest ones."""
    seeds = [0]
    near = x @ x[0]
    while len(seeds) < min(k, len(x)):
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-6:
            break
        seeds.append(far)
        near = np.maximum(near, x @ x[far])
    centroids = x[seeds]
    for _ in range(rounds):
        own = np.argmax(x @ centroids.T, axis=1)
        sums = np.stack([x[own == i].sum(axis=0) if (own == i).any() else centroids[i] for i in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, size: int = SIZE) -> Centroids:
    """Learns from rows ``(key, text, lang)``: of each language the ``sample`` keys that hash least.

    Null keys, texts or languages and texts without a letter are left out, as are other columns. A language's vectors meet
    in one task, ``sample`` times ``size`` floats; the driver gets a language's ``centroids`` and document frequencies.
    """
    sound = labelled.where("text is not null and lang is not null and key is not null").select("key", "lang", "text")
    picked = least_hashed(sound.select("key", "lang"), "lang", F.xxhash64("key"), sample).drop("nth")
    rows = sound.join(F.broadcast(picked), ["key", "lang"])  # as many rows as the sample

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = [(k, t) for k, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True) if has_letter(t)]
            out = [features(t, size).astype(np.float32).tobytes() for _, t in some]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.string()), pa.array(out, pa.binary())], ["lang", "v"])

    known = stored(rows.select("lang", "text").mapInArrow(vectors, "lang string, v binary"), "vectors")

    def matrix(t: pa.Table) -> np.ndarray:
        return np.stack([np.frombuffer(v, np.float32) for v in sorted(t.column("v").to_pylist())])

    def document_frequency(t: pa.Table) -> pa.Table:
        x = matrix(t)
        return pa.table({"n": pa.array([len(x)], pa.int64()), "df": pa.array([(x > 0).sum(axis=0).astype(np.int64).tobytes()], pa.binary())})

    found = known.groupBy("lang").applyInArrow(document_frequency, "n long, df binary").collect()  # a row per language
    if not found:
        return Centroids([], np.zeros((0, size), np.float32), np.ones(size, np.float32), 0.0)
    n, df = sum(r["n"] for r in found), np.sum([np.frombuffer(r["df"], np.int64) for r in found], axis=0)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(1)

    def cluster(t: pa.Table) -> pa.Table:
        x = np.log1p(matrix(t)) * idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = _clusters(x, centroids, ROUNDS).astype(np.float32)
        least = float(np.quantile((x @ c.T).max(axis=1), 0.01))
        return pa.table({"lang": t.column("lang")[:1].cast(pa.string()), "least": pa.array([least]), "centroids": pa.array([c.tobytes()], pa.binary())})

    got = sorted(known.groupBy("lang").applyInArrow(cluster, "lang string, least double, centroids binary").collect(), key=lambda r: r["lang"])  # a row per language
    sets = [np.frombuffer(r["centroids"], np.float32).reshape(-1, size) for r in got]
    names = [r["lang"] for r, c in zip(got, sets, strict=True) for _ in c]
    return Centroids(names, np.concatenate(sets), idf, min(1.0, *(r["least"] for r in got)))


def identify(docs: DataFrame, model: Centroids, reject: float = REJECT, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``docs`` (null: all) with ``lang_pred``, ``score`` (cosine) and ``rejected``.

    A null text, one without a letter, or any if nothing was learned, is ``und`` with score 0 and
    rejected; a text far from all centroids keeps the nearest language and is marked as rejected. Whole texts count,
    worked through in blocks. Repeated rows get equal results, no rows give none; columns with the new names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    kept = docs.columns if keep is None else keep

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores, out = [], [], []
            for text in b.column("text").to_pylist():
                name, score = UNKNOWN, 0.0
                if text and len(model.languages) and has_letter(text):
                    name, score = model.nearest(text)
                names.append(name)
                scores.append(score)
                out.append(name == UNKNOWN or score < reject * model.least)
            found = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*map(b.column, kept), *found], [*kept, "lang_pred", "score", "rejected"])

    schema = StructType([docs.schema[k] for k in kept]).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())
    return docs.mapInArrow(predict, schema)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a document's crc32 of its id as text falls into ``part`` of ``parts``; null: no."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))

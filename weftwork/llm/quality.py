"""Quality classifier: supervised subword embeddings.

Words, pairs of words and character n-grams are hashed into BUCKETS rows of an embedding table; a document is
the mean of its rows, and a softmax layer reads it. Embeddings and layer are learned
together by stochastic gradient descent in numpy on the driver, from at most SAMPLE labelled documents of each
class (those with the smallest hash of doc_id). Class weights restore the labels'
own shares, which are counted over all of them. A document's score only needs each row's
product with the layer, so scoring looks up one number for each word and n-gram.

Nulls: a null text is empty; an empty text has no features and scores the learned bias; labels
without quality are left out; of repeated labels of a doc_id the largest counts. Repeated rows score
alike. Whole texts are scored, whatever their length. Without labels every score is 0.5.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.textvec import GAPS

BUCKETS = 1 << 15
SIZES = (3, 4, 5)
SAMPLE = 1500
THRESHOLD = 0.3
PART = 1 << 19
_random = np.random.Generator(np.random.PCG64(11))
_TABLE = _random.integers(0, 2**63, (max(SIZES), 256), dtype=np.uint64) | np.uint64(1)
_WORD = [_random.integers(0, 2**63, dtype=np.uint64) | np.uint64(1) for _ in range(2)]
_SHIFT = np.uint64(64 - (BUCKETS - 1).bit_length())


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) % 2**64)
    return (h >> _SHIFT).astype(np.int32)


def features(texts: list[bytes], ends: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, bucket) of every word and n-gram; a place is a byte of the texts joined with one space before each.

    ends: where each text ends among the places.

    A character n-gram may begin or end at a gap, as a mark of a word's edge, but holds none inside.
    Words count singly and in pairs; all pairs of a word with itself are one feature.
    """
    from weftwork.llm.textvec import words

    data = b" " + b" ".join(texts) + b" "
    raw = np.frombuffer(data, np.uint8)
    gap = GAPS[raw]
    flat = np.where(gap, np.uint8(32), raw)
    before = np.concatenate(([0], np.cumsum(gap, dtype=np.int32)))
    h = None
    for n in range(1, max(SIZES) + 1):
        m = len(flat) - n + 1
        if m <= 0:
            break
        own = _TABLE[n - 1][flat[n - 1 :]]
        h = own if h is None else h[:m] + own
        if n in SIZES:
            at = np.flatnonzero(before[n - 1 : n - 1 + m] == before[1 : 1 + m])
            yield at, _bucket(h[at], n)
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    own = words(texts)[0]
    yield edge[::2], _bucket(own, 0)
    pairs = own[1:] * np.uint64(31) + own[:-1]
    pairs[own[1:] == own[:-1]] = np.uint64(1)
    at = edge[2::2]
    if ends is not None:  # a pair across two texts is none
        kept = np.searchsorted(ends, at, "right") == np.searchsorted(ends, edge[:-2:2], "right")
        at, pairs = at[kept], pairs[kept]
    yield at, _bucket(pairs, 1)


def bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their counts for each text."""
    out = []
    for text in texts:
        all_of = np.concatenate([b for _, b in features([text])] or [np.empty(0, np.int32)])
        out.append(np.unique(all_of, return_counts=True))
    return out


def scores(texts: list[bytes], rows: np.ndarray, bias: float) -> np.ndarray:
    """Probabilities of label 1 from each bucket's product with the layer."""
    out = np.empty(len(texts))
    start = 0
    while start < len(texts):
        stop, held = start, 0
        while stop < len(texts) and (stop == start or held + len(texts[stop]) <= PART):
            held, stop = held + len(texts[stop]) + 1, stop + 1
        part = texts[start:stop]
        ends = np.cumsum([len(t) + 1 for t in part])
        total, count = np.zeros(len(part)), np.zeros(len(part))
        for at, bucket in features(part, ends):
            sums = np.concatenate(([0.0], np.cumsum(rows[bucket], dtype=np.float64)))
            cut = np.concatenate(([0], np.searchsorted(at, ends)))
            total += sums[cut[1:]] - sums[cut[:-1]]
            count += np.diff(cut)
        out[start:stop] = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -50, 50)))
        start = stop
    return out


@dataclass(frozen=True)
class Model:
    rows: np.ndarray
    bias: float

    def score(self, text: Column) -> Column:
        rows, bias = self.rows, self.bias

        @F.pandas_udf("double")
        def of(column: pd.Series) -> pd.Series:
            return pd.Series(scores([b"" if x is None else x.encode() for x in column], rows, bias))

        return of(text)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], weights: tuple[float, float], *, dim: int = 12, epochs: int = 6, rate: float = 2.0, seed: int = 5) -> Model:
    """Stochastic gradient descent over (buckets, counts, label); weights by label."""
    if not examples:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.Generator(np.random.PCG64(seed))
    table = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    shares = [(c / max(1, c.sum())).astype(np.float32) for _, c, _ in examples]
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            buckets, _, label = examples[i]
            mean = shares[i] @ table[buckets]
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            step = np.float32(rate * (1 - done / steps) * weights[label])
            back = layer.T @ p
            layer -= step * p[:, None] * mean[None, :]
            bias -= np.float32(0.1) * step * p
            table[buckets] -= np.float32(4) * step * np.sqrt(shares[i])[:, None] * back[None, :]  # roots: else rare rows hardly move
            done += 1
    return Model(table @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """True for the rows that are never learned from: crc32 of doc_id as text, modulo 5, is 0. A null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, **training: float) -> Model:
    """Learns from labelled rows of docs that are not held out. `sample` bounds the rows of each class, and so the driver's memory."""
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = None
    for label in (0, 1):
        some = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held_out(F.col("doc_id")))

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = bags([x.encode() if x else b"" for x in batch.column("text").to_pylist()])
            columns = [batch.column("quality"), batch.column("doc_id"), pa.array([b.astype("<i4").tobytes() for b, _ in found], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["quality", "doc_id", "buckets", "counts"])

    bounded = F.broadcast(chosen)  # at most 2 * sample rows of two numbers
    rows = texts.join(bounded, "doc_id").mapInArrow(bag, "quality int, doc_id long, buckets binary, counts binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["buckets"])))
    examples = [(np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["counts"], "<i4"), r["quality"]) for r in rows]
    counts = [max(1, sum(e[2] == k for e in examples)) for k in (0, 1)]
    raw = [total.get(k, 0) / counts[k] for k in (0, 1)]
    mean = sum(raw[k] * counts[k] for k in (0, 1)) / max(1, len(examples)) or 1.0
    return train(examples, (raw[0] / mean, raw[1] / mean), **training)


def rate(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = lean.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

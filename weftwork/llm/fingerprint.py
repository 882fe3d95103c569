"""Document fingerprints by a randomised edit embedding.

All texts share one random walk: at step j a pointer into the text emits its character and
moves on by one if the coin of (j, character) says so, else it stays. After an edit two
pointers drift apart and meet again by chance, so texts at a small edit distance agree at most
steps, a small Hamming distance. The fingerprint samples LENGTH steps, by rules that depend on
the walk's length alone and change little with it, and keeps one byte of the characters at the pointer
there. Likeness is the share of equal bytes. Near texts come from bit-sampled banding: BAND sampled bytes make
a band, texts that share a band are verified by their likeness (at 0.8 a pair shares none of the 24 bands with probability 3e-6), and
links make groups. Inside a band, what is not linked with its first text is compared on its fingerprint before a pair is made.

The walk is the same for equal beginnings, so an edited text goes on from where the kept part ended.

Nulls: a null text is empty; all empty texts have the same fingerprint, which agrees with no other, and are one group. Rows are ordered by falling doc_id, null last, ties by
text; the next row of the last one is the first. A single row is its own next. Repeated rows have equal fingerprints. Texts of any length are walked
whole. Columns other than doc_id and text take no part, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import kept_from, measured, scratch, settle, stored
from weftwork.llm.groups import few, linked, shared_members

LENGTH, BAND, BANDS, LIKE = 128, 4, 24, 0.8
PERIOD, CLASSES = 4096, 256
#: Documents of one ordered range, and characters that are walked together.
BUCKET_DOCUMENTS, PART = 2000, 1 << 21
#: Ranges, each a number that the driver holds. More than 400 million documents make longer ranges; a task streams its range, so its memory stays.
MOST_RANGES = 200_000
#: Below so many texts at once, walking each by itself is faster.
FEW = 24


@lru_cache(1)
def _coins() -> tuple[np.ndarray, bytes]:
    """How many steps a character keeps the pointer, by the step modulo PERIOD and the character's class."""
    rng = np.random.Generator(np.random.PCG64(2016))
    moves = rng.integers(0, 2, (PERIOD, CLASSES), dtype=np.uint8).astype(bool)
    stay = np.zeros((PERIOD, CLASSES), np.uint8)
    wait = np.full(CLASSES, 255, np.int64)
    for j in [*range(PERIOD - 1, -1, -1)] * 2:  # the period is a circle
        wait = np.where(moves[j], 1, np.minimum(wait + 1, 255))
        stay[j] = wait
    return stay.ravel(), stay.tobytes()


@lru_cache(1)
def _samples() -> np.ndarray:
    """Rising steps for each sampled byte: for a walk of n steps the last one below n, uniform over them, is sampled."""
    rng = np.random.Generator(np.random.PCG64(1729))
    rows = []
    for _ in range(LENGTH):
        row = [0]
        while row[-1] < 2**40 and len(row) < 96:
            row.append(int((row[-1] + 1) / max(rng.random(), 1e-9)) + 1)
        rows.append(row + [2**62] * (96 - len(row)))
    return np.array(rows, np.int64)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return (points * np.uint32(2654435761) >> np.uint32(24)).astype(np.uint8)


def walks(texts: list[np.ndarray], begin: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text the step at which the pointer comes to each character, and the step after the last. begin: the steps before."""
    stay, flat_stay = _coins()
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    offsets = np.concatenate(([0], np.cumsum(lengths[order])))[:-1]
    flat = np.concatenate([texts[i] for i in order] or [np.empty(0, np.uint8)])
    came, now = np.empty(len(flat), np.int64), begin[order].astype(np.int64)
    rising = -lengths[order]
    i, longest = 0, int(lengths.max()) if len(lengths) else 0
    while i < longest:
        active = int(np.searchsorted(rising, -i, "left"))  # texts longer than i
        if active < FEW:
            break
        until = int(lengths[order[active - 1]])
        at, own = offsets[:active] + i, now[:active]
        for _ in range(i, until):
            came[at] = own
            own += stay[((own & (PERIOD - 1)) << 8) | flat[at]]
            at += 1
        i = until
    for r in range(int(np.searchsorted(rising, -i, "left"))):
        step, steps = int(now[r]), []
        for c in flat[offsets[r] + i : offsets[r] + lengths[order[r]]].tobytes():
            steps.append(step)
            step += flat_stay[(step & 4095) << 8 | c]
        came[offsets[r] + i : offsets[r] + lengths[order[r]]] = steps
        now[r] = step
    out, last = [np.empty(0, np.int64)] * len(texts), np.empty(len(texts), np.int64)
    for r, o in enumerate(order):
        out[o], last[o] = came[offsets[r] : offsets[r] + lengths[o]], now[r]
    return out, last


def sampled(codes: np.ndarray, came: np.ndarray, steps: int) -> np.ndarray:
    """The fingerprint's bytes: three characters at the pointer, hashed to 1..255; all 0 for an empty text."""
    if not len(codes):
        return np.zeros(LENGTH, np.uint8)
    samples = _samples()
    at = samples[np.arange(LENGTH), (samples < steps).sum(1) - 1]
    pointer = np.searchsorted(came, at, "right") - 1
    last = len(codes) - 1
    h = codes[pointer].astype(np.uint64) << np.uint64(16) | codes[np.minimum(pointer + 1, last)].astype(np.uint64) << np.uint64(8) | codes[np.minimum(pointer + 2, last)].astype(np.uint64)
    h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(40)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def fingerprints(texts: list[str]) -> list[bytes]:
    codes = [classes(t) for t in texts]
    came, steps = walks(codes, np.zeros(len(codes), np.int64))
    return [sampled(c, w, int(s)).tobytes() for c, w, s in zip(codes, came, steps, strict=True)]


def likeness(a: bytes, b: bytes) -> float:
    return float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())


def _ordered(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows dealt by ranges of doc_id, each with the first row of the next range as a guest, and the number of ranges.

    Only the ids are sorted to find the ranges; a text is shuffled once. The driver gets one number a range.
    """
    ids = docs.select("doc_id")
    order = F.col("doc_id").desc_nulls_last()
    ranges = min(MOST_RANGES, max(1, -(-ids.count() // BUCKET_DOCUMENTS)))
    edges = ids.repartitionByRange(ranges, order).groupBy(F.spark_partition_id().alias("p")).agg(F.max("doc_id").alias("top"))
    tops = sorted((r["top"] for r in edges.collect() if r["top"] is not None), reverse=True)
    last = max(0, len(tops) - 1)
    table = F.from_json(F.lit(str(tops or [0])), "array<bigint>")
    middle = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
    halved = lambda s, _: F.when(s["low"] >= s["high"], s).when(
        F.get(table, middle(s)) >= F.col("doc_id"), F.struct((middle(s) + 1).alias("low"), s["high"].alias("high"))
    ).otherwise(F.struct(s["low"].alias("low"), middle(s).alias("high")))
    steps = F.sequence(F.lit(0), F.lit(len(tops).bit_length()))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(tops)).alias("high")), halved)["low"] - 1
    own = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(found)
    first = F.col("doc_id") == F.get(table, F.col("_own")) if tops else F.lit(True)
    before = F.when(F.col("_own") > 0, F.col("_own") - 1).otherwise(F.lit(last))
    places = F.when(first, F.array(F.col("_own"), before)).otherwise(F.array(F.col("_own")))
    return docs.withColumn("_own", own).select("doc_id", "text", F.posexplode(places).alias("guest", "range")), last + 1


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id of every row.

    The edited text: the last half of the code points gives way to the first as many (or all) of the next row's text.
    group_id: the smallest doc_id among documents linked by a likeness of LIKE or more.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt, ranges = _ordered(docs)
    ordered = dealt.repartition(ranges, "range").sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "sha", "print", "edited", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        held: list[tuple[int, int, int, str]] = []  # the last of them has no next row yet
        size = 0

        def rows_of(items: list[tuple[int, int, int, str]]) -> list[tuple]:
            """Rows of all items but the last and guests; items follow one another."""
            codes = [classes(t) for *_, t in items]
            came, steps = walks(codes, np.zeros(len(items), np.int64))
            prints = [sampled(c, w, int(s)).tobytes() for c, w, s in zip(codes, came, steps, strict=True)]
            own = [i for i in range(len(items) - 1) if not items[i][1] and items[i][0] == items[i + 1][0]]
            halves = [len(codes[i]) // 2 for i in own]
            tails = [codes[i + 1][:h] for i, h in zip(own, halves, strict=True)]
            begin = np.array([came[i][len(codes[i]) - h] if h else steps[i] for i, h in zip(own, halves, strict=True)], np.int64)
            tail_came, tail_steps = walks(tails, begin)
            rows = []
            for i, h, tail, w, s in zip(own, halves, tails, tail_came, tail_steps, strict=True):
                n = len(codes[i])
                edited = sampled(np.concatenate((codes[i][: n - h], tail)), np.concatenate((came[i][: n - h], w)), int(s)).tobytes()
                text = items[i][3][: n - h] + items[i + 1][3][:h]
                rows.append((items[i][2], n, hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), prints[i], edited, likeness(prints[i], edited), likeness(prints[i], prints[i + 1])))
            return rows

        for batch in batches:
            for item in zip(*(batch.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text")), strict=True):
                held.append(item)
                size += len(item[3])
                if size > PART and len(held) > 1:
                    yield out(rows_of(held))
                    del held[:-1]
                    size = len(held[0][3])
        if held:
            yield out(rows_of(held))

    schema = "doc_id long, n_chars long, sha binary, print binary, edited binary, near_edited double, near_next double"
    with scratch(docs.sparkSession) as paths:
        table = kept_from(paths, stored(ordered.mapInArrow(each, schema).withColumn("node", F.xxhash64("print"))))
        settle(docs)
        named, m = _grouped(table.select("doc_id", "node", "print"))
        kept_from(paths, named)
    text = lambda c: F.lower(F.hex(c))
    both = table.join(few(named, m["n"]), "node", "left").withColumn("group_id", F.coalesce("group_id", "doc_id"))
    return both.select("doc_id", "n_chars", text("sha").alias("edited_sha256"), text("print").alias("fingerprint"), text("edited").alias("edited_fingerprint"), "near_edited", "near_next", "group_id")


def _longs(raw: str):
    """The fingerprint as signed 64-bit numbers."""
    return F.array(*[F.conv(F.hex(F.substring(raw, 8 * i + 1, 8)), 16, -10).cast("long") for i in range(LENGTH // 8)])


def _equal_bytes(a, b):
    """How many bytes of two fingerprints are equal: each byte of the difference is folded into its lowest bit."""
    fold = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    for by in (4, 2, 1):
        fold = F.transform(fold, lambda x: x.bitwiseOR(F.shiftrightunsigned(x, by)))  # noqa: B023  called at once
    lowest = F.lit(0x0101010101010101)
    return F.lit(LENGTH) - F.aggregate(fold, F.lit(0), lambda s, x: s + F.bit_count(x.bitwiseAND(lowest)))


def _grouped(table: DataFrame, least: float = LIKE) -> tuple[DataFrame, dict]:
    """(node, group_id) from (doc_id, node, print): fingerprints alike, by bit-sampled bands and verification; group_id is the smallest doc_id.

    Only nodes of two documents or more; stored, with the number of rows.
    """
    nodes = stored(table.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("print").alias("print")))
    bands = nodes.where(F.col("print") != F.lit(bytes(LENGTH))).select("node", "print", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("b"))
    members = shared_members(bands.select(F.xxhash64("b", F.substring("print", F.col("b") * BAND + 1, F.lit(BAND))).alias("bucket"), "node"))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, LENGTH) for c in ("a", "b"))
            yield batch.select(["u", "v"]).filter(pa.array((u == v).mean(1) >= least))

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (nodes.select(F.col("node").alias(x), F.col("print").alias(y)) for x, y in (("u", "a"), ("v", "b")))
        return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(alike, "u long, v long")

    features = lambda wanted: nodes.join(wanted, "node").select("node", F.struct(_longs("print").alias("p")).alias("f"))
    _, roots = linked(members, verify, features, lambda: _equal_bytes("fu.p", "fv.p") >= F.lit(least * LENGTH))
    in_groups = stored(nodes.select("node", "doc_id").join(roots, "node"))
    smallest, m = measured(in_groups.groupBy("root").agg(F.min("doc_id").alias("group_id")))
    named = in_groups.join(few(smallest, m["n"]), "root").select("node", "group_id")
    copied = table.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node", F.lit(True).alias("copied"))
    own = nodes.select("node", "doc_id").join(named, "node", "left").join(copied, "node", "left")
    return measured(own.where("group_id is not null or copied").select("node", F.coalesce("group_id", "doc_id").alias("group_id")))


def near(docs: DataFrame, least: float = LIKE) -> DataFrame:
    """(doc_id, group_id): documents whose fingerprints are alike, by bit-sampled bands and verification; group_id is the smallest doc_id."""
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text").to_pylist()), pa.binary())], ["doc_id", "print"])

    with scratch(docs.sparkSession) as paths:
        table = kept_from(paths, stored(lean.mapInArrow(prints, "doc_id long, print binary").withColumn("node", F.xxhash64("print"))))
        named, m = _grouped(table, least)
        kept_from(paths, named)
    return table.join(few(named, m["n"]), "node", "left").select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"))

"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Which bin a piece goes to depends on its length alone, so the driver packs counts of lengths
(at most `room` numbers, whatever the corpus): for each length from the longest on, the segment tree over
remaining capacities finds the tightest open bins in logarithmic time. Bins of the same content
are one interval. Pieces then find their bin from their rank among the pieces of their length;
ranks come from counts for each task and length, so no task sees all pieces.

Nulls: a null text is empty and still a document of one token. Repeated rows are packed as often as
they stand. Ties: pieces of the same length are interchangeable; they go in table order. An empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm.common import stored

ROOM, END = 1024, 2


class Capacities:
    """Counts of open bins by remaining capacity; finds the least capacity that fits."""

    def __init__(self, room: int):
        self.size = 1 << room.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that an open bin has."""
        i = least + self.size
        if self.tree[i]:
            return least
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, first bin, pieces a bin, offset): best-fit decreasing for counts of each length."""
    tree, opened, out, bins = Capacities(room), [[] for _ in range(room + 1)], [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            opened[capacity].append((first, n))
            tree.add(capacity, n)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                n = -(-left // (room // length))
                put(room, bins, n)
                bins += n
                continue
            first, n = opened[capacity].pop()
            tree.add(capacity, -n)
            each = capacity // length
            if full := min(n, left // each):
                out.append((length, rank, first, each, room - capacity))
                put(capacity - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if left and n:  # fewer than fill one bin
                out.append((length, rank, first, each, room - capacity))
                put(capacity - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            put(capacity, first, n)
    return out


def pieces(docs: DataFrame, tokenizer: str, *, room: int = ROOM, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, with the task and the rank in it among its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from weftwork.llm.tokens import encoder

        encode = encoder(tokenizer).encode
        last = int(end).to_bytes(4, "little")
        task, seen = TaskContext.get().partitionId(), np.zeros(room + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + last
                n = len(ids) // 4
                start, stop, piece = 0, (n - 1) % room + 1, 0  # only the first piece may be shorter
                while start < n:
                    own, length = ids[4 * start : 4 * stop], stop - start
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), task, int(seen[length]), own if with_ids else None))
                    seen[length] += 1
                    start, stop, piece = stop, stop + room, piece + 1
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_seen", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return lean.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _seen long, ids binary")


def pack(docs: DataFrame, tokenizer: str, *, room: int = ROOM, end: int = END, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset; with_ids adds the ids as little-endian 32-bit integers."""
    table = stored(pieces(docs, tokenizer, room=room, end=end, with_ids=with_ids))
    counted = stored(table.groupBy("_task", "length").agg(F.count(F.lit(1)).alias("_n")))
    totals = counted.groupBy("length").agg(F.sum("_n").alias("n"))
    rows = np.array(plan({r["length"]: r["n"] for r in totals.collect()}, room) or [(0, 0, 0, 1, 0)], np.int64)  # at most `room` counts
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    offsets = counted.select("_task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranks = table.join(offsets, ["_task", "length"]).withColumn("_rank", F.col("_before") + F.col("_seen"))
    keys = rows[:, 0] << 44 | rows[:, 1]
    sorting = np.argsort(keys)
    keys, rows = keys[sorting], rows[sorting]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            own = rows[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            nth = rank - own[:, 1]
            sequence, offset = own[:, 2] + nth // own[:, 3], own[:, 4] + nth % own[:, 3] * length
            kept = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long"
    lean = ranks.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "_rank")
    out = lean.mapInArrow(place, schema)
    return out if with_ids else out.drop("ids")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of each whole sequence from pack(with_ids=True); a sequence has at most `room` tokens."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    joined = F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))

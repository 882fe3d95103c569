"""Exact top-k search by inner product: norm-bucketed retrieval.

Vectors are cut into buckets of similar length, each one row of ids and a matrix, and queries into
blocks. The bucket of the longest vectors gives each query a first threshold. A bucket whose
longest vector cannot reach a block's thresholds is not joined; inside a bucket, a query's
threshold over its own and the bucket's length is a threshold for the cosine, by which
either a coordinate range (COORD) or a prefix by length (LENGTH) is scanned, whichever leaves fewer. Products
of what is left are exact integers.

All vectors are candidates of all queries. Which buckets a block needs is found on narrow tables first: buckets are ranked by
their longest vector, so a block needs the first n of them, n found by halving; then an equi-join on the rank sends the block to these
buckets and to no other, and the result has k rows of each query and bucket.

Nulls: vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows without an id. Vectors of
other dimensions than the query's are no candidates. Rows that repeat the query's id count as its own row; of
queries of one id the smallest vector asks; repeated candidates are candidates each. Ties go to
the smaller id. Components beyond 2**31 or products beyond 2**53 are computed exactly and clamp at 64 bits; thresholds are rounded down. Columns
other than the id and the vector take no part, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm.common import measured, stored

BUCKET, BLOCK = 8192, 1024
#: Bytes that may be broadcast: the first bucket of each dimension, or the buckets' lengths; more is joined by a shuffle with SALTS copies.
MOST_BROADCAST, SALTS = 64 << 20, 32
_BLOCKS = "block long, dim int, longest double, ids binary, vectors binary, wide boolean"


def whole_vectors(df: DataFrame, id_column: str, vector: str, scale: float = 256.0) -> DataFrame:
    """id, v (floor(scale * x) of each component as 64-bit integers), dim, norm2; rows that take part only."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(id_column).isNotNull() & F.col(vector).isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    rows = df.where(fine).select(F.col(id_column).cast("long").alias("id"), whole.alias("v"))
    return rows.withColumn("dim", F.size("v")).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def _buckets(rows: DataFrame, size: int) -> DataFrame:
    """Rows in the order of dimension and falling length, `size` to a bucket; equal lengths are spread by id."""
    n = rows.count()
    parts = max(1, -(-n // (4 * size)))
    sorted_rows = rows.repartitionByRange(parts, "dim", F.desc("norm2"), "id").sortWithinPartitions("dim", F.desc("norm2"), "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple[int, list, int, float]] = []

        def bucket() -> pa.RecordBatch:
            nonlocal made
            ids = np.array([h[0] for h in held], "<i8")
            try:
                vectors, wide = np.array([h[1] for h in held], "<i4"), False
            except OverflowError:
                vectors, wide = np.array([h[1] for h in held], "<i8"), True
            out = pa.RecordBatch.from_pylist([{"block": part << 32 | made, "dim": held[0][2], "longest": held[0][3] ** 0.5, "ids": ids.tobytes(), "vectors": vectors.tobytes(), "wide": wide}], pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("wide", pa.bool_())]))
            made += 1
            held.clear()
            return out

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "v", "dim", "norm2")), strict=True):
                if held and (len(held) == size or held[0][2] != row[2]):
                    yield bucket()
                held.append(row)
        if held:
            yield bucket()

    return stored(sorted_rows.mapInArrow(cut, _BLOCKS))


def _matrix(raw: bytes, wide: bool, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8" if wide else "<i4").reshape(-1, dim)


def _below(product) -> float:
    """The largest double that is not above an exact product."""
    f = float(product)
    return f if int(f) <= int(product) else float(np.nextafter(f, -np.inf))


class Bucket:
    """One bucket's vectors, longest first, with what the scans need."""

    def __init__(self, ids: bytes, vectors: bytes, wide: bool, dim: int):
        self.ids, self.whole = np.frombuffer(ids, "<i8"), _matrix(vectors, wide, dim)
        self.lengths = np.sqrt((self.whole.astype(float) ** 2).sum(1))
        self.longest = float(self.lengths[0])
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.typed: dict[type, np.ndarray] = {}

    def as_type(self, kind: type) -> np.ndarray:
        if kind not in self.typed:
            self.typed[kind] = self.whole.astype(kind)
        return self.typed[kind]

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The unit vectors' values of coordinate f in order, and whose they are."""
        if f not in self.sorted:
            values = self.whole[:, f] / np.maximum(self.lengths, 1e-300)
            order = np.argsort(values, kind="stable")
            self.sorted[f] = values[order], order
        return self.sorted[f]

    def best(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, ids, products): the k best of each query among those of at least its threshold."""
        lengths = np.sqrt((queries.astype(float) ** 2).sum(1))
        top = self.longest * (lengths.max() if len(lengths) else 0.0)
        kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else object
        mine, own, scan = self.as_type(kind), queries.astype(kind), []
        slack = 1e-9
        for i in range(len(queries)):
            if least[i] == -np.inf or lengths[i] == 0:
                scan.append((i, len(self.ids)))
                continue
            need = least[i] / lengths[i]
            if need > self.longest * (1 + slack):
                continue  # no vector here is long enough
            n = len(self.ids) if need <= 0 else int(np.searchsorted(-self.lengths, -need * (1 - slack), "right"))
            cosine = min(1.0, need / max(self.longest, 1e-300) * (1 - slack))
            if cosine > 0.5:  # below that no coordinate excludes much
                unit = queries[i] / lengths[i]
                f = int(np.argmax(np.abs(unit)))
                wide = np.sqrt(max(0.0, (1 - unit[f] ** 2) * (1 - cosine**2))) + slack
                values, order = self.coordinate(f)
                # Holds for a vector with a cosine of at least `cosine`, whatever its length in the bucket.
                a, b = np.searchsorted(values, unit[f] * cosine - wide), np.searchsorted(values, 2.0 if unit[f] > cosine else unit[f] * cosine + wide, "right")
                a = 0 if unit[f] < -cosine else a
                if 8 * (b - a) < n:
                    yield self._top(i, query_ids[i], order[a:b], mine[order[a:b]] @ own[i], least[i], k)
                    continue
            scan.append((i, n))
        if scan:
            most = max(n for _, n in scan)
            places = [i for i, _ in scan]
            products = mine[:most] @ own[places].T
            for j, (i, n) in enumerate(scan):
                yield self._top(i, query_ids[i], np.arange(n), products[:n, j], least[i], k)

    def _top(self, i: int, query_id: int, at: np.ndarray, products: np.ndarray, least: float, k: int) -> tuple[int, np.ndarray, np.ndarray]:
        fine = (products >= least) & (self.ids[at] != query_id)
        at, products = at[fine], products[fine]
        if len(at) > k:
            edge = np.partition(products, len(products) - k)[len(products) - k]
            fine = products >= edge
            at, products = at[fine], products[fine]
        order = sorted(range(len(at)), key=lambda j: (-products[j], self.ids[at[j]]))[:k] if len(at) < 64 else np.lexsort((self.ids[at], -products.astype(float)))[:k]
        return i, self.ids[at][order], products[order]


def search(vectors: DataFrame, queries: DataFrame, k: int, *, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. Both tables as whole_vectors() makes them; all of `vectors` are candidates of all `queries`."""
    queries = queries.groupBy("id").agg(F.min(F.struct("v", "dim", "norm2")).alias("q")).select("id", "q.*")
    buckets, blocks = _buckets(vectors, bucket), _buckets(queries, block)
    first = buckets.groupBy("dim").agg(F.max_by(F.struct("ids", "vectors", "wide"), F.struct("longest", -F.col("block"))).alias("b"))
    first, m = measured(first, bytes=F.sum(F.length("b.ids") + F.length("b.vectors")))
    asked = blocks.select("block", "dim", "ids", "vectors", "wide")
    if (m["bytes"] or 0) <= MOST_BROADCAST:
        begun = asked.join(F.broadcast(first), "dim")
    else:  # blocks of one dimension are dealt over SALTS copies of its first bucket
        salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        begun = asked.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")).join(salted, ["dim", "salt"])

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b, ids, own = Bucket(**row["b"], dim=row["dim"]), np.frombuffer(row["ids"], "<i8"), _matrix(row["vectors"], row["wide"], row["dim"])
                least = np.full(len(ids), -np.inf)
                for i, _, products in b.best(ids, own, least, k):
                    if len(products) == k:
                        least[i] = _below(products[-1])
                lengths = np.sqrt((own.astype(float) ** 2).sum(1))
                need = float(np.min(np.where(lengths > 0, least / np.maximum(lengths, 1e-300), -np.inf)))
                yield pa.RecordBatch.from_pylist([{"asked": row["block"], "dim": row["dim"], "q_ids": row["ids"], "q_vectors": row["vectors"], "q_wide": row["wide"], "least": least.astype("<f8").tobytes(), "need": need}], pa.schema([("asked", pa.int64()), ("dim", pa.int32()), ("q_ids", pa.binary()), ("q_vectors", pa.binary()), ("q_wide", pa.bool_()), ("least", pa.binary()), ("need", pa.float64())]))

    begun = begun.select("block", "dim", "ids", "vectors", "wide", "b")
    seeded = stored(begun.mapInArrow(seed, "asked long, dim int, q_ids binary, q_vectors binary, q_wide boolean, least binary, need double"))
    by_length = Window.partitionBy("dim").orderBy(F.desc("longest"), "block")  # a narrow row for each bucket
    ranked, m = measured(buckets.select("dim", "longest", "block").withColumn("rank", F.row_number().over(by_length) - 1))
    lengths = ranked.groupBy("dim").agg(F.array_sort(F.collect_list(-F.col("longest"))).alias("falling"))  # 8 bytes a bucket
    lengths = F.broadcast(lengths) if m["n"] * 8 <= MOST_BROADCAST else lengths
    least = -F.col("need") / (1 + 1e-9)
    narrow = seeded.select("asked", "dim", "need").join(lengths, "dim")
    half = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
    halved = lambda s, _: F.when(s["low"] >= s["high"], s).when(
        F.get("falling", half(s)) <= least, F.struct((half(s) + 1).alias("low"), s["high"].alias("high"))
    ).otherwise(F.struct(s["low"].alias("low"), half(s).alias("high")))
    begin = F.struct(F.lit(0).alias("low"), F.size("falling").alias("high"))
    reached = F.aggregate(F.sequence(F.lit(0), F.lit(max(1, m["n"]).bit_length())), begin, halved)["low"]
    needed = narrow.withColumn("_n", reached).where("_n > 0").select("asked", "dim", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("rank"))
    numbered = needed.join(ranked.select("dim", "rank", "block"), ["dim", "rank"]).select("asked", "block")
    pairs = seeded.drop("dim", "need").join(numbered, "asked").join(buckets, "block")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[int, Bucket] | None = None
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                if kept is None or kept[0] != row["block"]:
                    kept = row["block"], Bucket(row["ids"], row["vectors"], row["wide"], row["dim"])
                ids, own, least = np.frombuffer(row["q_ids"], "<i8"), _matrix(row["q_vectors"], row["q_wide"], row["dim"]), np.frombuffer(row["least"], "<f8")
                out = [(int(ids[i]), int(v), max(-(2**63), min(2**63 - 1, int(p)))) for i, found, products in kept[1].best(ids, own, least, k) for v, p in zip(found, products, strict=True)]
                columns = list(zip(*out, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    lean = pairs.select("dim", "q_ids", "q_vectors", "q_wide", "least", "block", "ids", "vectors", "wide")
    found = lean.mapInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # Spark keeps k of each task before it shuffles
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def divisible(column: str, by: int) -> Column:
    return F.pmod(F.col(column), F.lit(by)) == 0

"""MinHash near-dedup: many universal hash minima, banding, signature verification, exact confirmation, components.

A document's set holds its distinct shingles of WORDS words, lower-cased A-Z; documents of the
same set are one node, so copies never meet each other. A signature has HASHES minima of
multiply-add hashes; ROWS of them make a band, and nodes that share a band are candidates
(a pair of similarity 0.8 shares none of the 64 bands with probability 8e-6; at 0.55 it shares one in two cases, so long
bands keep groups of half-alike documents apart). A byte of each of the first SIGNED minima is kept;
candidates that agree in fewer than LEAST_ALIKE of them are dropped (at 0.8 that loses one in 10**6); the others are
confirmed on their full sets, which are made again from the texts of nodes that share a band.

Groups of half-alike documents would make all pairs of a group. An exact bound keeps them apart inside the join of a
bucket: the parity sketch of a set has a bit for each residue of a hash, set if an odd number of shingles fall on it. The
sketches of two sets differ in at most as many bits as the sets differ in shingles, and sets of similarity t differ
in at most (1 - t) / (1 + t) of their sizes' sum. Sketches have four bits a shingle or more, so few bits are lost to collisions.

Nulls: a null or wordless text has an empty set, is linked with nothing and is its own component. A
null doc_id takes part; its group's id is the smallest that is not null. Repeated rows are copies, and rows of one
doc_id with different texts are documents each. Texts of any length are taken whole; their sets are made in numpy, 8 bytes a shingle. Other
columns of docs take no part, whatever their names. Ties do not arise: the smallest doc_id of a component names it. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import kept_from, measured, scratch, slices, stored, texts_of
from weftwork.llm.groups import few, linked, shared_members
from weftwork.llm.textvec import LOWERED, mixed, runs, words

WORDS, HASHES, ROWS = 4, 512, 8
SIGNED, LEAST_ALIKE = 256, 0.68
SIMILAR = 80
PART = 1 << 19
#: Words of 64 bits of the sketch of a set of at most SKETCHED shingles; both double together for larger sets.
SKETCH, SKETCHED = 8, 128
_random = np.random.Generator(np.random.PCG64(77))
_A = _random.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _random.integers(0, 2**32, HASHES, dtype=np.uint32)
_MIX = _random.integers(0, 2**63, (HASHES // ROWS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of fewer than k words, all of them make one."""
    h, counts = words([t.translate(LOWERED) for t in texts])
    full = runs(h, k)
    out, at = [], 0
    for c in counts:
        if c >= k:
            out.append(np.unique(full[at : at + c - k + 1]))
        elif c:
            out.append(runs(h[at : at + c], int(c)))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of HASHES universal hashes a * x + b modulo 2**32, of 32 mixed bits of each shingle's hash."""
    least = np.full(HASHES, np.uint32(2**32 - 1))
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 512):
        block = _A[:, None] * x[None, i : i + 512]
        block += _B[:, None]
        np.minimum(least, block.min(1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band's minima; bands differ by their factors."""
    return mixed((least.reshape(-1, ROWS).astype(np.uint64) * _MIX).sum(1, dtype=np.uint64))


def sketch_class(n: int) -> int:
    """How often SKETCH doubles for a set of n shingles."""
    return max(0, -(-n // SKETCHED) - 1).bit_length()


def sketch(shingles: np.ndarray, doublings: int) -> np.ndarray:
    """The parity sketch as signed 64-bit words."""
    bits = 64 * SKETCH << doublings
    odd = (np.bincount((mixed(shingles.copy()) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def node_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th, n_shingles, hash (of the set; null if empty), bands and signature of each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                sets = shingle_sets(texts_of(part.column("text")), k)
                nodes = [node_of(s) if len(s) else None for s in sets]
                least = [signature(s) if len(s) else None for s in sets]
                signs = (lambda x: bands(x).astype("<u8").tobytes(), lambda x: x[:SIGNED].astype(np.uint8).tobytes())
                made = [pa.array([None if x is None else of(x) for x in least], pa.binary()) for of in signs]
                names = ["doc_id", "th", "n_shingles", "hash", "bands", "signature"]
                own = [part.column("doc_id"), part.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *made], names)

    return docs.mapInArrow(each, "doc_id long, th long, n_shingles long, hash binary, bands binary, signature binary")


def _numbered(nodes: DataFrame) -> DataFrame:
    """nodes (hash, ...) with node: eight bytes of the hash as a number where these tell all nodes apart, else the hash itself."""
    for at in (1, 9):
        half = F.conv(F.hex(F.substring("hash", at, 8)), 16, -10).cast("long")
        if nodes.groupBy(half.alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return nodes.withColumn("node", half)
    return nodes.withColumn("node", F.col("hash"))


def _sets(docs: DataFrame, wanted: DataFrame, n: int, k: int) -> DataFrame:
    """node, shingles (sorted 64-bit hashes) of the n wanted nodes (node, hash, rep), from the text of one of their documents."""
    ids = few(wanted.select(F.col("rep.th").alias("_th"), F.col("rep.doc_id").alias("_rep"), F.col("hash").alias("_hash"), "node"), n)
    own = docs.join(ids, (docs["th"] == F.col("_th")) & docs["doc_id"].eqNullSafe(F.col("_rep"))).select("node", "_hash", "text")
    kind = wanted.schema["node"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                sets = shingle_sets(texts_of(part.column("text")), k)
                fine = [len(s) > 0 and node_of(s) == h for s, h in zip(sets, part.column("_hash").to_pylist(), strict=True)]
                out = part.select(["node"]).filter(pa.array(fine, pa.bool_()))
                yield pa.RecordBatch.from_arrays([out.column(0), pa.array([s.tobytes() for s, f in zip(sets, fine, strict=True) if f], pa.binary())], ["node", "shingles"])

    return own.mapInArrow(each, f"node {kind}, shingles binary").dropDuplicates(["node"])


def _verifier(wanted: DataFrame, sets: DataFrame, similar: int):
    """verify(pairs): the pairs (u, v) whose signatures are alike and whose sets are similar."""
    kind = wanted.schema["node"].dataType.simpleString()

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIGNED) for c in ("su", "sv"))
            yield batch.select(["u", "v"]).filter(pa.array((a == b).mean(1) >= LEAST_ALIKE))

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                fine.append(100 * both >= similar * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(fine, pa.bool_()))

    def verify(pairs: DataFrame) -> DataFrame:
        u = wanted.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("signature").alias("su"))
        v = wanted.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("signature").alias("sv"))
        close = pairs.join(u, "u").join(v, "v").where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * similar)
        left = stored(close.select("u", "v", "su", "sv").mapInArrow(alike, f"u {kind}, v {kind}"))
        a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(y)) for x, y in (("u", "a"), ("v", "b")))
        return left.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(confirmed, f"u {kind}, v {kind}")

    return verify


def _sketches(sets: DataFrame):
    """features(nodes): node, f (n, c, own: the sketch of its class, next: that of the class after it) of the nodes."""
    kind = sets.schema["node"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = [np.frombuffer(s, "<u8") for s in batch.column("shingles").to_pylist()]
            c = [sketch_class(len(s)) for s in shingles]
            own, after = ([sketch(s, x + more) for s, x in zip(shingles, c, strict=True)] for more in (0, 1))
            longs = [pa.array(x, pa.list_(pa.int64())) for x in (own, after)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(s) for s in shingles], pa.int64()), pa.array(c, pa.int32()), *longs], ["node", "n", "c", "own", "next"])

    def features(nodes: DataFrame) -> DataFrame:
        made = sets.join(nodes, "node").select("node", "shingles").mapInArrow(each, f"node {kind}, n long, c int, own array<long>, next array<long>")
        return made.select("node", F.struct("n", "c", "own", "next").alias("f"))

    return features


def _possible(similar: int):
    """The condition on fu and fv that all similar sets fulfil. Similar sets differ by one class at most."""
    sizes = F.least("fu.n", "fv.n") * 100 >= F.greatest("fu.n", "fv.n") * similar
    u, v = (F.when(F.col(f"{x}.c") < F.col(f"{y}.c"), F.col(f"{x}.next")).otherwise(F.col(f"{x}.own")) for x, y in (("fu", "fv"), ("fv", "fu")))
    differ = F.aggregate(F.zip_with(u, v, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)
    return sizes & (differ * (100 + similar) <= (F.col("fu.n") + F.col("fv.n")) * (100 - similar))


def groups(docs: DataFrame, *, k: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_links (confirmed links of the document's set) of every row."""
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lean = lean.withColumn("th", F.xxhash64("text"))
    with scratch(docs.sparkSession) as paths:
        table = stored(_signed(lean, k))
        first = [F.first(c).alias(c) for c in ("bands", "signature")]
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
        nodes = stored(table.where("hash is not null").groupBy("hash").agg(F.min(order).alias("rep"), F.first("n_shingles").alias("n"), *first))
        nodes = _numbered(nodes)
        each = nodes.select("node", "bands", F.explode(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1))).alias("band"))
        bucket = F.xxhash64("band", F.substring("bands", F.col("band") * 8 + 1, F.lit(8)))
        members = shared_members(each.select(bucket.alias("bucket"), "node"))
        wanted, m = measured(nodes.drop("bands").join(members.select("node").distinct(), "node"))
        sets = stored(_sets(lean, wanted, m["n"], k))
        edges, roots = linked(members, _verifier(wanted, sets, similar), _sketches(sets), lambda: _possible(similar))
        links = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
        grouped = stored(wanted.select("node", F.col("rep.doc_id").alias("doc_id")).join(roots, "node"))
        smallest, m = measured(grouped.groupBy("root").agg(F.min("doc_id").alias("component_id")))
        named = grouped.join(few(smallest, m["n"]), "root").join(links, "node", "left").select("node", "component_id", "n_links")
        own = nodes.select("hash", "node", F.col("rep.doc_id").alias("doc_id")).join(named, "node", "left")
        by_hash = stored(own.select("hash", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
        for left in (table, by_hash):
            kept_from(paths, left)
    out = table.select("doc_id", "n_shingles", "hash").join(by_hash, "hash", "left")
    component = F.when(F.col("hash").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(component == F.col("doc_id"), component.isNull())
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group: that of its smallest doc_id."""
    kept = groups(docs, **options).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_kept"]), "left_semi")

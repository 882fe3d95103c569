"""Substring dedup: relative Lempel-Ziv parsing against indexed reference blocks, on words.

Index: every window of WINDOW words has an anchor, its run of SEED words with the smallest hash (leftmost of equal ones).
Equal windows have equal anchors at equal offsets, so a window whose anchor stands nowhere else
is unique. The first place (by doc_id, then position) of each recurring anchor is that anchor's reference block: the words
round it that its windows can reach.

Parse: at each other place of an anchor, the match with the reference block is extended to both sides as far as whole windows
agree. A document is then factored from left to right: at each word the longest match that begins there or spans it is
followed on from block to block while these lie on in the same reference document, and the factor ends where
no block carries on; words outside all matches are literals. A match has WINDOW words at least, a factor that begins where another ended may have fewer.

Boundaries: a window over the end of a factor may lie in a match that the greedy choice passed over; it is a duplicate too. Windows
that hold a recurring anchor but differ from the block may equal each other; these are
checked against each other by (anchor, window) hashes. No other pair of windows can be equal, so the result is that of comparing all windows.

Anchors are about 7 % of the words; only hashes are shuffled to find those that recur, and
masks of blocks are combined before they are shuffled, so a passage of a third of all documents is one row a
task. Places are compared with one reference block each, never with one another. Sides of joins that are made of sums are stored
before, so that Spark can split the rows of a hot anchor or window.

Nulls: a null text has no words. Texts of fewer than WINDOW words lose nothing. A null doc_id is a document as any other. Rows that repeat a doc_id and a
text are copies of each other. Texts of any length are taken whole. Other columns take no part, whatever their names. Ties do not
arise. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import dropped, measured, settle, slices, stored, texts_of
from weftwork.llm.groups import few
from weftwork.llm.textvec import inside, runs, words

WINDOW, SEED = 35, 8
PART = 1 << 19
U = np.uint64


def owners(g: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest value (leftmost of equal ones) in each `width` consecutive values."""
    value, place, size = g, np.arange(len(g)), 1
    while size < width:
        step = min(size, width - size)
        left = value[:-step] <= value[step:]
        value, place = np.where(left, value[:-step], value[step:]), np.where(left, place[:-step], place[step:])
        size += step
    return place


def anchors(texts: list[bytes], window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(windows' places, their anchors' places, hashes of runs of `seed` words, word hashes, first word of each text)."""
    h, counts = words(texts)
    begin = np.concatenate(([0], np.cumsum(counts)))
    empty = np.empty(0, np.int64)
    if len(h) < window:
        return empty, empty, np.empty(0, U), h, begin
    g = runs(h, seed)
    own = owners(g, window - seed + 1)
    places = np.flatnonzero(inside(counts, window, len(own)))
    return places, own[places], g, h, begin


def spans_of(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The union of windows as spans of words; starts in order."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > window)
    first = np.concatenate(([0], breaks + 1))
    last = np.concatenate((breaks, [len(starts) - 1]))
    return [(int(starts[a]), int(starts[b]) + window) for a, b in zip(first, last, strict=True)]


def parse(matches: list[tuple[int, int, int | None, int]]) -> list[tuple[int, int, int | None, int]]:
    """Greedy factors from left to right. matches and factors: (start, end, reference's doc_id, start there), ends exclusive.

    Matches on one diagonal of one reference that touch or overlap are one match: the block after continues the block before.
    """
    runs_of: list[list] = []
    for start, end, ref, at in sorted(matches, key=lambda m: (m[2] is None, m[2] or 0, m[3] - m[0], m[0])):
        last = runs_of[-1] if runs_of else None
        if last and last[2] == ref and last[3] - last[0] == at - start and start <= last[1]:
            last[1] = max(last[1], end)
        else:
            runs_of.append([start, end, ref, at])
    factors: list[tuple[int, int, int | None, int]] = []
    runs_of.sort(key=lambda m: m[0])
    now, i, best = 0, 0, None
    while i < len(runs_of) or best:
        while i < len(runs_of) and runs_of[i][0] <= now:  # of the matches that hold word `now` the one that goes farthest
            best = runs_of[i] if best is None or runs_of[i][1] > best[1] else best
            i += 1
        if best is None or best[1] <= now:
            best = None
            if i < len(runs_of):
                now = runs_of[i][0]
            continue
        factors.append((now, best[1], best[2], best[3] + now - best[0]))
        now, best = best[1], None
        while i < len(runs_of) and runs_of[i][1] <= now:
            i += 1
    return factors


def duplicate_windows(docs: DataFrame, *, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, dk (hash of doc_id and text), marks: array of (pos, mask, r_doc_id, r_pos): windows that start at pos - o for each bit o of mask.

    r_pos, where not null: they equal those at the same offsets before r_pos in the reference document.
    """
    width = window - seed + 1
    if not 0 < seed <= 8 or not 0 < width <= 63:
        raise ValueError("a seed has at most 8 words, and a window at most 62 more")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                _, own, g, _, begin = anchors(texts_of(part.column("text")), window, seed)
                at = np.unique(own)
                doc = np.searchsorted(begin, at, "right") - 1
                keys = part.column("dk").to_numpy()[doc]
                yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), pa.array(keys), pa.array((at - begin[doc]).astype(np.int32))], ["key", "dk", "pos"])

    places = stored(docs.select("dk", "text").mapInArrow(index, "key long, dk long, pos int"))
    # Stored, so that the join has shuffles of its own, which Spark splits where one anchor has most places.
    recurring = stored(places.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key"))
    lists = stored(places.join(recurring, "key").groupBy("dk").agg(F.collect_set("pos").alias("positions")))  # places in one text
    dropped(places)
    settle(docs)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                at, own, g, h, begin = anchors(texts_of(part.column("text")), window, seed)
                wanted = [np.array(p, np.int64) + b for p, b in zip(part.column("positions").to_pylist(), begin, strict=False)]
                chosen = np.unique(np.concatenate(wanted or [np.empty(0, np.int64)]))
                row = np.searchsorted(chosen, own)
                fine = (row < len(chosen)) & (chosen[np.minimum(row, max(0, len(chosen) - 1))] == own) if len(chosen) else np.zeros(len(own), bool)
                at, own, row = at[fine], own[fine], row[fine]
                wins = np.zeros((len(chosen), width), U)
                if len(at):
                    wins[row, own - at] = runs(h, window)[at] | U(1)
                doc = np.searchsorted(begin, chosen, "right") - 1
                take = pa.array(doc)
                key = pa.array(g[chosen].view(np.int64)) if len(chosen) else pa.array([], pa.int64())
                binary = pa.array([w.tobytes() for w in wins], pa.binary())
                yield pa.RecordBatch.from_arrays([key, part.column("doc_id").take(take), part.column("dk").take(take), pa.array((chosen - begin[doc]).astype(np.int32)), binary], ["key", "doc_id", "dk", "pos", "wins"])

    own_text = docs.join(lists, "dk").select("doc_id", "dk", "text", "positions")
    rows = stored(own_text.mapInArrow(blocks, "key long, doc_id long, dk long, pos int, wins binary"))
    dropped(lists)
    settle(docs)
    reference = stored(rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "dk", "pos", "wins")).alias("r")))
    settle(docs)
    met = rows.join(reference, "key").select("key", "doc_id", "dk", "pos", "wins", *(F.col("r")[c].alias(f"r_{c}") for c in ("doc_id", "dk", "pos", "wins")))
    others = met.where(~(F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("dk") == F.col("r_dk")) & (F.col("pos") == F.col("r_pos"))))
    bits = U(1) << np.arange(width, dtype=U)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), U).reshape(-1, width) for c in ("wins", "r_wins"))
            same = (a == b) & (a != 0)
            mask = (same * bits).sum(1, dtype=U).view(np.int64)
            rest = np.where(same, U(0), a)
            over = [r.tobytes() if r.any() else None for r in rest]
            kept = ["key", "doc_id", "dk", "pos", "r_doc_id", "r_dk", "r_pos"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(mask), pa.array(over, pa.binary())], [*kept, "mask", "rest"])

    factors = stored(others.mapInArrow(factor, "key long, doc_id long, dk long, pos int, r_doc_id long, r_dk long, r_pos int, mask long, rest binary"))
    dropped(rows, reference)
    settle(docs)
    nowhere = F.lit(None).cast("long").alias("r_doc_id"), F.lit(None).cast("int").alias("r_pos")
    in_documents = factors.where("mask != 0").select("doc_id", "dk", "pos", "mask", "r_doc_id", "r_pos")
    in_blocks = factors.where("mask != 0").groupBy(F.col("r_doc_id").alias("doc_id"), F.col("r_dk").alias("dk"), F.col("r_pos").alias("pos")).agg(F.bit_or("mask").alias("mask"))
    in_blocks = in_blocks.select("doc_id", "dk", "pos", "mask", *nowhere)

    def past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = np.frombuffer(b"".join(batch.column("rest").to_pylist()), U).reshape(-1, width)
            r, o = np.nonzero(rest)
            take = pa.array(r)
            start = batch.column("pos").to_numpy()[r] - o
            columns = [batch.column("key").take(take), pa.array(rest[r, o].view(np.int64)), batch.column("doc_id").take(take), batch.column("dk").take(take), pa.array(start.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "win", "doc_id", "dk", "pos"])

    open_windows = stored(factors.where("rest is not null").select("key", "doc_id", "dk", "pos", "rest").mapInArrow(past, "key long, win long, doc_id long, dk long, pos int"))
    twice, m = measured(open_windows.groupBy("key", "win").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key", "win"))
    checked = open_windows.join(few(twice, m["n"]), ["key", "win"]).select("doc_id", "dk", "pos", F.lit(1).cast("long").alias("mask"), *nowhere)
    marks = in_documents.unionByName(in_blocks).unionByName(checked)
    out = stored(marks.groupBy("doc_id", "dk").agg(F.collect_list(F.struct("pos", "mask", "r_doc_id", "r_pos")).alias("marks")))  # windows of one text
    dropped(factors, open_windows, twice)
    settle(docs)
    return out


def dedup(docs: DataFrame, *, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, text (what is left, words joined by one space), spans (start and end of removed words), factors
    (start, end, ref_doc_id, ref_start: the parse against the reference blocks; null for a text that repeats a whole row)."""
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = lean.withColumn("dk", F.xxhash64("doc_id", "text"))
    found = duplicate_windows(keyed, window=window, seed=seed)
    found = found.select(F.col("doc_id").alias("_d"), F.col("dk").alias("_k"), "marks")
    both = keyed.join(found, (keyed["dk"] == found["_k"]) & keyed["doc_id"].eqNullSafe(found["_d"]), "left").select("doc_id", "dk", "text", "marks")
    ids = lean.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_d"))
    if ids.isEmpty():
        both = both.withColumn("whole", F.lit(False))
    else:  # rows that repeat a doc_id and a text are copies, window by window
        some = keyed.join(ids, keyed["doc_id"].eqNullSafe(ids["_d"]), "left_semi")
        twins = some.groupBy("doc_id", "dk").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_d"), F.col("dk").alias("_k"), F.lit(True).alias("whole"))
        both = both.join(twins, (both["dk"] == twins["_k"]) & both["doc_id"].eqNullSafe(twins["_d"]), "left").select("doc_id", "text", "marks", F.coalesce("whole", F.lit(False)).alias("whole"))

    span = "array<struct<start:long,end:long>>"
    factor = "array<struct<start:long,end:long,ref_doc_id:long,ref_start:long>>"
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    quads = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "ref_doc_id", "ref_start")]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, left, spans, parsed = [], [], [], [], []
            for text, marks, whole in zip(texts_of(batch.column("text")), batch.column("marks").to_pylist(), batch.column("whole").to_pylist(), strict=True):
                own, factors = text.split(), []
                if whole:
                    starts, factors = np.arange(max(0, len(own) - window + 1)), None
                elif marks:
                    pos, mask = np.array([m["pos"] for m in marks], np.int64), np.array([m["mask"] for m in marks], np.int64)
                    r, o = np.nonzero(mask[:, None] >> np.arange(window - seed + 1) & 1)
                    at = [(m["pos"] - m["mask"].bit_length() + 1, m) for m in marks if m["r_pos"] is not None]
                    low = [(m["mask"] & -m["mask"]).bit_length() - 1 for _, m in at]
                    factors = parse([(a, m["pos"] - b + window, m["r_doc_id"], a + m["r_pos"] - m["pos"]) for (a, m), b in zip(at, low, strict=True)])
                    # Windows of factors, and those over their boundaries that another match, a block or an equal window holds.
                    starts = np.unique(np.concatenate([pos[r] - o, *(np.arange(a, b - window + 1) for a, b, _, _ in factors)]))
                else:
                    starts = np.empty(0, np.int64)
                cuts = spans_of(starts, window)
                kept, at = [], 0
                for a, b in cuts:
                    kept += own[at:a]
                    at = b
                kept += own[at:]
                n.append(len(own))
                removed.append(len(own) - len(kept))
                left.append(b" ".join(kept).decode())
                spans.append([{"start": a, "end": b} for a, b in cuts])
                parsed.append(None if factors is None else [dict(zip(("start", "end", "ref_doc_id", "ref_start"), f, strict=True)) for f in factors])
            columns = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.string()), pa.array(spans, pairs), pa.array(parsed, quads)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "text", "spans", "factors"])

    return both.select("doc_id", "text", "marks", "whole").mapInArrow(cut, f"doc_id long, n_words long, n_removed long, text string, spans {span}, factors {factor}")


def digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of dedup()'s rows."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: list[str], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept_sha256) of each text by comparing all windows; for tests."""
    from collections import Counter

    split = [t.encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((len(w), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out

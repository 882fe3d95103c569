"""Chat formatting over reply trees.

A message names its parent; a path runs from a root to a leaf. Iterative self-joins list all
paths by pointer doubling: after round k every leaf has met its ancestors up to distance
2**k, so a tree of depth d takes log2(d) rounds of equi-joins on (tree, message). Branches are ranked by
the mean score of their messages, and the best of each tree are formatted, one conversation each.

A turn reads `<|im_start|>role`, a line end, the text, `<|im_end|>` and a line end. Inside roles and texts,
a `<` that only backslashes part from a `|` gets one backslash more, so that no control string is left and
taking one away again restores the text. The loss mask has the code points of assistant texts.

Nulls: a null text or role is empty; null scores count 0; a null tree id is a tree of its own. A parent that does
not exist makes a root. Messages on a cycle of parents have no root and are left out. Repeated messages
of a table of turns are turns of their own. Ties between branches go to the longer path, then to the
smaller leaf. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm.common import stored

START, STOP = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as text, and the spans of it (code points) that are learned."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role(role)}\n", escaped(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{STOP}\n")
        at += len(out[-1])
    return "".join(out), spans


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(_unrole(m[1]), unescaped(m[2])) for m in _TURN.finditer(text)]


def reply_tree(turns: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as messages: each turn answers the one before it."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_last(), "role", "text")  # one conversation, as its output row
    at = F.row_number().over(order).cast("long")
    return rows.withColumn("message", at).withColumn("parent", F.when(F.col("message") > 1, F.col("message") - 1)).withColumn("score", F.lit(0.0)).drop("turn")


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, message, up) for every message on the path of every leaf; up is its distance from the leaf.

    messages: tree, message (unique in its tree), parent.
    """
    links = stored(messages.select("tree", "message", "parent"))
    names = links.select(F.col("tree").alias("_t"), F.col("message").alias("_m"))
    here = links.join(names, links["tree"].eqNullSafe(names["_t"]) & (links["parent"] == names["_m"]), "left")
    here = stored(here.select("tree", "message", F.col("_m").alias("up_to")))
    jump = stored(here.where("up_to is not null"))  # messages whose ancestor at the present distance exists; fewer each round
    parents = jump.select(F.col("tree").alias("_t"), F.col("up_to").alias("_m")).distinct()
    leaves = here.join(parents, here["tree"].eqNullSafe(parents["_t"]) & (here["message"] == parents["_m"]), "left_anti")
    reach = leaves.select("tree", F.col("message").alias("leaf"), "message", F.lit(0).cast("long").alias("up"))
    roots = here.where("up_to is null").select(F.col("tree").alias("_t"), F.col("message").alias("_m"))
    most, step = links.count(), 1
    while step <= most and not jump.isEmpty():
        j = jump.select(F.col("tree").alias("_t"), F.col("message").alias("_m"), F.col("up_to").alias("_next"))
        further = reach.join(j, reach["tree"].eqNullSafe(j["_t"]) & (reach["message"] == j["_m"])).select("tree", "leaf", F.col("_next").alias("message"), (F.col("up") + step).alias("up"))
        reach = stored(reach.unionByName(further))
        twice = jump.join(j, jump["tree"].eqNullSafe(j["_t"]) & (jump["up_to"] == j["_m"]))
        jump = stored(twice.select("tree", "message", F.col("_next").alias("up_to")))
        step *= 2
    # Only paths that end at a root count; those on a cycle never do.
    ended = reach.join(roots, reach["tree"].eqNullSafe(roots["_t"]) & (reach["message"] == roots["_m"])).select(F.col("tree").alias("_t"), F.col("leaf").alias("_l")).distinct()
    return reach.join(ended, reach["tree"].eqNullSafe(ended["_t"]) & (reach["leaf"] == ended["_l"]), "left_semi")


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, turns (an array of role and text in order) of the best branches of each tree.

    messages: tree, message, parent, role, text, score.
    """
    messages = stored(messages)
    m = messages.select(F.col("tree").alias("_t"), F.col("message").alias("_m"), "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    way = stored(paths(messages))
    light = m.select("_t", "_m", "score")
    ranked = way.join(light, way["tree"].eqNullSafe(light["_t"]) & (way["message"] == light["_m"])).groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("tree").orderBy(F.desc("mean"), F.desc("n"), "leaf")
    chosen = ranked.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= branches).select(F.col("tree").alias("_t2"), F.col("leaf").alias("_l2"))
    kept = way.join(chosen, way["tree"].eqNullSafe(chosen["_t2"]) & (way["leaf"] == chosen["_l2"])).drop("_t2", "_l2")
    full = kept.join(m, kept["tree"].eqNullSafe(m["_t"]) & (kept["message"] == m["_m"]))
    turns = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return full.groupBy("tree", "leaf").agg(turns.alias("turns"))


def render(chosen: DataFrame) -> DataFrame:
    """tree, leaf, text, loss: an array of the spans (start, end) that are learned."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            made = [formatted([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in made]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("leaf"), pa.array([t for t, _ in made], pa.string()), pa.array(spans, spans_type)], ["tree", "leaf", "text", "loss"])

    return chosen.mapInArrow(each, "tree long, leaf long, text string, loss array<struct<start:long,end:long>>")


def format_turns(turns: DataFrame) -> DataFrame:
    """Every conversation of a table of turns, formatted: tree (its conv_id), leaf, text, loss."""
    return render(conversations(reply_tree(turns)))


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its mask say."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, text, loss in zip(*(batch.column(c).to_pylist() for c in ("tree", "text", "loss")), strict=True):
                turns = parsed(text)
                learned = "".join(unescaped(text[s["start"] : s["end"]]) for s in loss)
                all_of = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((tree, len(turns), hashlib.sha256(all_of.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return rendered.select("tree", "text", "loss").mapInArrow(each, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

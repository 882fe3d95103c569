"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

A source's documents, in a random order that depends only on the seed, make up its stream of
words, cut into blocks of a few hundred documents (MOST_BLOCKS a source at most). Whole passes repeat every document; the
last pass takes blocks from the start of the stream until the target is met, and stops on
a word. The blocks of all passes are shared out: the root of a binary tree holds each
source's block quota, and each node splits its quotas between its two children as drawing
without replacement would (one hypergeometric draw after another); a leaf is an output shard.
Shard s takes the next blocks of each source's stream, so shards never share a block, and
orders its rows at random.

DataFrame functions only. Quotas have a row for each node and an entry for each source;
blocks are bounded, and no task gathers a source: sums go source, then block, then document.

Nulls: a null text has size 0; a null source is a source of its own, last in the order; a null
doc_id is drawn as any other. Repeated rows count as often as they stand. Ties of the random key
go by doc_id and text hash. Long texts count by their words; only a cut copy is split into them. Further columns, whatever
their names, stay out of the joins and come back with their rows. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.llm.common import WORD_GAP, n_words, narrow, stored

#: Documents of a block on average; the only rows that are ranked together are those of one block.
BLOCK_DOCUMENTS = 512
#: Blocks of a source; larger sources have larger blocks, so that neither its blocks nor the draws over them grow without end.
MOST_BLOCKS = 1 << 16
#: Standard deviations round the mean in which a draw is sought.
REACH = 12
#: The random key has 52 bits, which doubles hold exactly.
KEY_BITS = 52


def target_rates(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Adds weight and target to (source, size): shares by weight, stopped at `most` times the size, the excess shared anew.

    `sources` has a row for each source. Each round is one aggregate of one row; a round that
    caps no further source is the last.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one narrow row for each source
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = stored(sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))))
    cap = F.col("size") * F.lit(most)
    total = rows.agg(F.sum("size")).first()[0] or 0
    rate, capped = 0.0, -1
    while True:
        over = cap <= F.lit(rate) * F.col("weight") if capped >= 0 else F.lit(False)
        held = rows.agg(
            F.sum(F.when(over, cap).otherwise(F.lit(0.0))), F.sum(F.when(over, F.lit(0.0)).otherwise(F.col("weight"))), F.sum(F.when(over, F.lit(1)).otherwise(F.lit(0)))
        ).first()
        if held[2] is None or held[2] == capped or not held[1]:
            break
        capped, rate = held[2], max(0.0, (total - held[0]) / held[1])
    return rows.withColumn("target", F.least(cap, F.lit(rate) * F.col("weight")))


def _key(seed: int) -> Column:
    """A document's place in its source's random order."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("_text_hash")), 64 - KEY_BITS)


def plan(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks). documents: doc_id, source, size, source_size, target, block, copies, extra, taken, one row each row of docs.

    copies: whole repeats; extra: words of one further, partial repeat (0 for all but one document of a source).
    blocks: source, block, quota row: passes of the block that the mix takes.
    """
    lean = stored(
        narrow(docs, doc_id="long", source="string", text="string").select("doc_id", "source", n_words().alias("size"), F.xxhash64("text").alias("_text_hash")).withColumn("_key", _key(seed))
    )
    sizes = lean.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("_docs"))
    rates = target_rates(sizes, weights, most).select(
        F.col("source").alias("_s"), F.col("size").alias("source_size"), "target", F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("_docs") / BLOCK_DOCUMENTS))).alias("_blocks")
    )
    # Sources may be many: a join, which Spark splits where one source has most rows.
    # In doubles: from 2,049 blocks on the product passes 63 bits. Rounding keeps the keys' order, and the largest key stays in the last block.
    block = F.floor(F.col("_key").cast("double") * F.col("_blocks") / F.lit(float(2**KEY_BITS))).cast("long")
    placed = lean.join(rates, lean["source"].eqNullSafe(rates["_s"])).drop("_s").withColumn("block", block)
    per_block = placed.groupBy("source", "block").agg(
        F.sum("size").alias("_words"), F.first("source_size").alias("source_size"), F.first("target").alias("target")
    )
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # rows are blocks, not documents
    rounded = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(rounded / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    blocks = (
        per_block.withColumn("_passes", passes)
        .withColumn("_rest", rounded - F.col("_passes") * F.col("source_size"))
        .withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
        .withColumn("_left", F.greatest(F.lit(0), F.least(F.col("_words"), F.col("_rest") - F.col("_before"))))
        .select("source", "block", "_words", "_passes", "_left", (F.col("_passes") + F.when(F.col("_left") > 0, 1).otherwise(0)).alias("quota"))
    )
    blocks = stored(blocks)
    b = blocks.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "_words", "_passes", "_left")
    joined = placed.join(b, placed["source"].eqNullSafe(b["_s"]) & (placed["block"] == b["_b"])).drop("_s", "_b")
    whole = joined.where((F.col("_left") == 0) | (F.col("_left") == F.col("_words"))).withColumn("_last", F.when(F.col("_left") > 0, F.col("size")).otherwise(F.lit(0)))
    cut = joined.where((F.col("_left") > 0) & (F.col("_left") < F.col("_words")))  # one block of each source
    inside = Window.partitionBy("source", "block").orderBy("_key", "doc_id", "_text_hash").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_last", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))
    full = (F.col("_last") == F.col("size")) & (F.col("_left") > 0) & (F.col("size") > 0)
    documents = whole.unionByName(cut).select(
        "doc_id", "source", "size", "source_size", "target", "block", "_text_hash", "_key",
        (F.col("_passes") + F.when(full, 1).otherwise(0)).cast("int").alias("copies"),
        F.when(full, F.lit(0)).otherwise(F.col("_last")).cast("long").alias("extra"),
        (F.col("_passes") * F.col("size") + F.col("_last")).cast("long").alias("taken"),
    )
    return documents, blocks


def _hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of `good` among `total` are in a draw of `drawn`: inverts the distribution at u (0 to 1).

    The weights follow from one another by their ratio, in logarithms, over the values within REACH standard deviations of
    the mean; what lies beyond weighs less than doubles can tell. So the cost grows with the root of the numbers.
    Two passes over these values keep three numbers each: one for the sum of the weights, one for the place of u in it.
    """
    low = F.greatest(F.lit(0), drawn - (total - good))
    high = F.least(drawn, good)
    mean = drawn.cast("double") * good / F.greatest(total, F.lit(1))
    reach = F.lit(REACH) * F.sqrt(F.greatest(F.lit(0.0), mean * (1 - good / F.greatest(total, F.lit(1))) * (total - drawn) / F.greatest(total - 1, F.lit(1)))) + REACH
    first = F.greatest(low, F.floor(mean - reach)).cast("long")
    last = F.least(high, F.ceil(mean + reach)).cast("long")
    ratio = lambda k: F.log((good - k).cast("double") * (drawn - k)) - F.log((k + 1.0) * (total - good - drawn + k + 1))
    steps = F.when(last > first, F.sequence(first, last - 1)).otherwise(F.array().cast("array<long>"))

    def weigh(s: Column, k: Column) -> Column:
        at = s["at"] + ratio(k)
        top = F.greatest(s["top"], at)
        return F.struct(at.alias("at"), top.alias("top"), (s["sum"] * F.exp(s["top"] - top) + F.exp(at - top)).alias("sum"))

    whole = F.aggregate(steps, F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("top"), F.lit(1.0).alias("sum")), weigh)

    def place(s: Column, k: Column) -> Column:
        at = s["at"] + ratio(k)
        passed = s["sum"] < s["want"]  # the weights up to k do not reach u
        return F.struct(at.alias("at"), s["top"].alias("top"), s["want"].alias("want"), (s["sum"] + F.exp(at - s["top"])).alias("sum"), (s["n"] + passed.cast("long")).alias("n"))

    begin = lambda w: F.struct(F.lit(0.0).alias("at"), w["top"].alias("top"), (u * w["sum"]).alias("want"), F.exp(-w["top"]).alias("sum"), F.lit(0).cast("long").alias("n"))
    # An array of one carries the first pass into the second, so that it is made once.
    found = F.transform(F.array(whole), lambda w: F.aggregate(steps, begin(w), place))[0]
    return F.least(last, first + found["n"])


def shard_quotas(quotas: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """(source, shard, first, n): shard takes n block passes of the source's stream from first on.

    quotas: (source, quota). Every node's quotas are one array over the sources in order; a level
    of the tree is one projection that splits each row into two. Draws hold exactly: the
    children's quotas add up to the node's, and shards differ by at most one block.
    Arrays have an entry for each source, so this suits thousands of sources; block quotas, not
    documents, are what is split.
    """
    depth = max(0, (shards - 1).bit_length())
    node = quotas.where("quota > 0").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("source", F.lit("")).alias("o"), "source", "quota"))).alias("k")).select(
        F.lit(0).alias("shard"), F.lit(shards).alias("width"), F.transform("k", lambda x: F.struct(x["source"].alias("source"), x["quota"].alias("n"), F.lit(0).cast("long").alias("first"))).alias("k")
    )
    for level in range(depth):
        total = F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        left_width = F.ceil(F.col("width") / 2).cast("int")
        node = node.withColumn("_left_width", left_width).withColumn("_total", total).withColumn("_draw", F.round(F.col("_total") * F.col("_left_width") / F.col("width")).cast("long"))
        begin = F.struct(F.col("_total").alias("total"), F.col("_draw").alias("draw"), F.array().cast("array<long>").alias("xs"))

        def draw(a: Column, x: Column) -> Column:
            u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), F.col("shard"), x["source"]), 11) / F.lit(float(2**53))
            take = _hypergeometric(a["total"], x["n"], a["draw"], u)
            return F.struct((a["total"] - x["n"]).alias("total"), (a["draw"] - take).alias("draw"), F.concat(a["xs"], F.array(take)).alias("xs"))

        node = stored(node.withColumn("_xs", F.aggregate("k", begin, draw)["xs"]))
        left = F.zip_with("k", "_xs", lambda x, n: F.struct(x["source"].alias("source"), n.alias("n"), x["first"].alias("first")))
        right = F.zip_with("k", "_xs", lambda x, n: F.struct(x["source"].alias("source"), (x["n"] - n).alias("n"), (x["first"] + n).alias("first")))
        halves = F.array(F.struct(F.col("shard"), F.col("_left_width").alias("width"), left.alias("k")), F.struct((F.col("shard") + F.col("_left_width")).alias("shard"), (F.col("width") - F.col("_left_width")).alias("width"), right.alias("k")))
        node = node.select(F.inline(halves)).where("width > 0")
    return node.select("shard", F.inline("k")).select("source", "shard", "first", "n").where("n > 0")


def _dealt(each: DataFrame, blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """each (doc_id, _text_hash, source, block, copies, extra, ...) with a row for each copy taken: shard, place and words (of a partial copy only)."""
    # The stream of a source: all blocks of the first pass, then of the second, and so on.
    steps = blocks.where("quota > 0").select("source", "block", F.explode(F.sequence(F.lit(1).cast("long"), "quota")).alias("_pass"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("_pass", "block")) - 1  # rows are blocks
    steps = steps.withColumn("_at", rank.cast("long"))
    shares = shard_quotas(blocks.groupBy("source").agg(F.sum("quota").alias("quota")), shards, seed)
    s = shares.select(F.col("source").alias("_s"), "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("_at"))
    dealt = steps.join(s, steps["source"].eqNullSafe(s["_s"]) & (steps["_at"] == s["_at"])).select(F.col("source").alias("_s"), F.col("block").alias("_b"), "_pass", "shard")
    each = each.withColumn("_n", F.col("copies") + F.when(F.col("extra") > 0, 1).otherwise(0)).where("_n > 0")
    taken = each.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_n")))
    rows = taken.join(dealt, taken["source"].eqNullSafe(dealt["_s"]) & (taken["block"] == dealt["_b"]) & (taken["_copy"] == dealt["_pass"])).drop("_s", "_b")
    place = F.xxhash64(F.lit(seed + 1), "doc_id", "_text_hash", "_copy")
    return rows.withColumn("place", place).withColumn("words", F.when(F.col("_copy") > F.col("copies"), F.col("extra")))


def shares(docs: DataFrame, *, shards: int = 16, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, extra and takes (shard, place and words of each copy) of each row of docs, added up from the copies dealt to the shards."""
    documents, blocks = plan(docs, weights=weights, most=most, seed=seed)
    documents = stored(documents)
    key = ["doc_id", "_text_hash", "source", "block", "copies", "extra"]  # rows that repeat a doc_id and a text may differ in the last two
    rows = _dealt(documents.select(*key, "size").distinct(), blocks, shards, seed)
    sums = rows.groupBy(*key).agg(
        F.sum(F.coalesce("words", "size")).alias("taken"), F.count(F.when(F.col("words").isNull(), 1)).cast("int").alias("_copies"), F.coalesce(F.sum("words"), F.lit(0)).alias("_extra"),
        F.array_sort(F.collect_list(F.struct("shard", "place", "words"))).alias("takes"),  # at most `most` + 1 copies
    )
    t = sums.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), "taken", F.col("_copies").alias("copies"), F.col("_extra").alias("extra"), "takes")
    d = documents.select("doc_id", "_text_hash", "source", "block", F.col("copies").alias("_c"), F.col("extra").alias("_e"), "size", "source_size", "target")
    same = [d[c].eqNullSafe(t[f"_k{i}"]) for i, c in enumerate(["doc_id", "_text_hash", "source", "block", "_c", "_e"])]
    zero = lambda c: F.coalesce(c, F.lit(0).cast(t.schema[c].dataType)).alias(c)
    takes = F.coalesce("takes", F.array().cast(t.schema["takes"].dataType)).alias("takes")
    return d.join(t, same, "left").select("doc_id", "size", "source_size", "target", zero("taken"), zero("copies"), zero("extra"), takes)


def mix(docs: DataFrame, *, shards: int = 16, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7, places: bool = True, ordered: bool = False) -> DataFrame:
    """The mix itself: docs' columns, a row for each copy taken, and with `places` its shard and its place in the shard's order.

    ordered: partitions are ranges of shard and place, and their rows stand in this order.

    A partial copy keeps the document's first words, joined by one space, up to the cut. Rows that repeat a doc_id and
    a text share their copies evenly, as all of them carry the same number.
    """
    documents, blocks = plan(docs, weights=weights, most=most, seed=seed)
    # Of rows that repeat a doc_id and a text one entry stands for all, with the number of copies of each.
    each = documents.groupBy("doc_id", "_text_hash", "source", "block").agg(F.max("copies").alias("copies"), F.max("extra").alias("extra"))
    rows = _dealt(each, blocks, shards, seed)
    takes = rows.groupBy("doc_id", "_text_hash", F.col("source")).agg(F.collect_list(F.struct("shard", "place", "words")).alias("takes"))  # at most `most` + 1 copies
    d = takes.select(F.col("doc_id").alias("_d"), F.col("_text_hash").alias("_h"), F.col("source").alias("_s"), "takes")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_th"), F.col("source").cast("string").alias("_src"))
    both = whole.join(d, whole["_id"].eqNullSafe(d["_d"]) & (whole["_th"] == d["_h"]) & whole["_src"].eqNullSafe(d["_s"])).select("row", F.explode("takes").alias("take"))
    if ordered:
        both = both.repartitionByRange("take.shard", "take.place").sortWithinPartitions("take.shard", "take.place")
    part = F.array_join(F.slice(F.filter(F.split(F.col("row.text"), WORD_GAP), lambda w: w != ""), F.lit(1), F.col("take.words").cast("int")), " ")
    text = F.when(F.col("take.words").isNotNull(), part).otherwise(F.col("row.text"))
    columns = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return both.select(*columns, *([F.col("take.shard").alias("shard"), F.col("take.place").alias("place")] if places else []))

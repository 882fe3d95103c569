"""Iterative graph operators over edge tables (src, dst).

A graph is dealt into blocks of about EDGES_A_BLOCK edges by a hash of src. In a round each block's task follows its own
edges as far as they lead inside the block, and sends what leaves it to other blocks; so a round costs one job, and
there are as many rounds as a path changes blocks, not hops. A graph of one block takes one round by the same way.
What a round leaves is written to the shared checkpoint folder, so lineage does not grow and a lost executor costs one task.
Messages to one node are combined before they are shuffled. Nothing but counts comes to the driver.

The edges that leave one node are held by one task, 100 bytes each; what arrives at a node may be any number.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.operators import closure
from weftwork.operators.storage import dropped, kept_from, measured, scratch, settle, stored

#: Edges whose two ids may be broadcast in each round of a closure; more are joined by a shuffle.
MOST_BROADCAST = 500_000
EDGES_A_BLOCK = 250_000
#: Edges of a weakly connected part that one task of a closure holds, and tasks that it is dealt to.
EDGES_HELD, MOST_TASKS = 10_000_000, 10_000


def module_edges(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst): importer to imported module and to each first-party proper prefix of its name; only prefixes leave out the importer itself.

    imports: importer, name (dotted); modules: name.
    """
    from weftwork.functions.names import dotted_prefixes

    direct = imports.select(F.col("importer").alias("src"), F.col("name").alias("dst"))
    parents = imports.select(F.col("importer").alias("src"), F.explode(dotted_prefixes(F.col("name"))).alias("dst")).where("src != dst")
    known = modules.select(F.col("name").alias("dst")).distinct()
    return direct.unionByName(parents).distinct().join(known, "dst", "left_semi").select("src", "dst")


def _edges(edges: DataFrame) -> DataFrame:
    own, m = measured(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    return F.broadcast(own) if m["n"] <= MOST_BROADCAST else own


def _dealt(edges: DataFrame) -> tuple[DataFrame, int]:
    """(block, src, dst, there) of distinct edges, there being the block of dst, and the number of blocks."""
    own, m = measured(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    n = max(1, -(-m["n"] // EDGES_A_BLOCK))
    return own.select(_block("src", n).alias("block"), "src", "dst", _block("dst", n).alias("there")), n


def _block(node: str, n: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(n)).cast("int")


def _out_edges(edges: pa.Table) -> dict:
    to: dict = {}
    home = edges.column("block")[0].as_py() if edges.num_rows else None
    for a, b, there in zip(*(edges.column(c).to_pylist() for c in ("src", "dst", "there")), strict=True):
        to.setdefault(a, []).append((b, there == home))
    return to


def _least(dealt: DataFrame, n: int, begin: DataFrame, step: int) -> DataFrame:
    """(node, value) of all nodes that begin (node, value) leads to: the least value that arrives, which each edge raises by step."""
    node, value = (begin.schema[c].dataType.simpleString() for c in ("node", "value"))

    def walk(edges: pa.Table, labels: pa.Table) -> pa.Table:
        to = _out_edges(edges)
        names, values, fresh = (labels.column(c).to_pylist() for c in ("node", "value", "fresh"))
        own = dict(zip(names, values, strict=True))
        heap = [(v, x) for x, v, f in zip(names, values, fresh, strict=True) if f]
        heapify(heap)
        sent: dict = {}
        while heap:
            v, x = heappop(heap)
            if v > own[x]:
                continue
            v = v + step if step else v
            for y, here in to.get(x, ()):
                best = own if here else sent
                if y not in best or v < best[y]:
                    best[y] = v
                    if here:
                        heappush(heap, (v, y))
        rows = [*own, *sent], [*own.values(), *sent.values()], [False] * len(own) + [True] * len(sent)
        kinds = labels.schema.field("node").type, labels.schema.field("value").type, pa.bool_()
        return pa.table([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["node", "value", "foreign"])

    rows, last = begin.groupBy("node").agg(F.min("value").alias("value")).withColumn("fresh", F.lit(True)), None
    while True:
        labels = rows.withColumn("block", _block("node", n))
        met = dealt.groupBy("block").cogroup(labels.groupBy("block")).applyInArrow(walk, f"node {node}, value {value}, foreign boolean")
        out, m = measured(met, sent=F.count_if("foreign"))
        if last is not None:
            dropped(last)
        if not m["sent"]:
            return out.select("node", "value")
        old = F.min(F.when(~F.col("foreign"), F.col("value")))
        rows = out.groupBy("node").agg(F.min("value").alias("value"), old.alias("_old")).select("node", "value", (F.col("_old").isNull() | (F.col("value") < F.col("_old"))).alias("fresh"))
        last = out


def reach(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(node, hops) of every node that a path from start (node) leads to, start included; hops is the shortest path's length, `most` at most."""
    dealt, n = _dealt(edges)
    found = _least(dealt, n, start.where("node is not null").select("node", F.lit(0).alias("value")), 1).withColumnRenamed("value", "hops")
    return found if most is None else found.where(F.col("hops") <= most)


def reach_pairs(edges: DataFrame) -> DataFrame:
    """(src, dst): the transitive closure, without paths of length 0. Its size is the closure's. Edges with a null stand as they are.

    Weakly connected parts go to tasks whole, as bits (see closure.py); no pair is shuffled or stored, the result's tasks make them.
    A part of more than EDGES_HELD edges, which one task does not hold, is closed by rounds of joins.
    """
    known = "src is not null and dst is not null"
    own, m = measured(edges.select("src", "dst").distinct(), known=F.count_if(F.expr(known)))
    settle(own)
    rest, graph = own.where(f"not ({known})"), own.where(known)
    if m["known"] <= EDGES_HELD:
        pairs = _bits(graph.withColumn("part", F.lit(0)))
    else:
        pairs = _pairs_of_parts(graph, m["known"])
    if m["n"] > m["known"]:
        return pairs.unionByName(rest)
    dropped(own)
    return pairs


def _pairs_of_parts(graph: DataFrame, n_edges: int) -> DataFrame:
    """The closure of n_edges distinct edges without nulls, by weakly connected parts."""
    n = max(1, -(-n_edges // EDGES_A_BLOCK))
    with scratch(graph.sparkSession) as paths:
        nodes = graph.select(F.col("src").alias("node")).unionByName(graph.select(F.col("dst").alias("node"))).distinct()
        parts = _least(*_dealt(graph.unionByName(_turned(graph))), nodes.withColumn("value", F.col("node")), 0)
        named = kept_from(paths, stored(graph.join(parts.select(F.col("node").alias("src"), F.col("value").alias("_part")), "src").select("src", "dst", "_part")))
    settle(named)
    sizes = stored(named.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min(EDGES_A_BLOCK, EDGES_HELD)))
    large, most = measured(sizes.where(F.col("_n") > EDGES_HELD).select("_part"))
    small = named.join(large, "_part", "left_anti") if most["n"] else named
    # A part of over a block's edges is dealt by itself, so that no task gets two.
    alone = small.join(sizes.select("_part", F.lit(True).alias("_alone")), "_part", "left")
    part = F.struct(_block("_part", n).alias("block"), F.when(F.col("_alone"), F.col("_part")).alias("own"))
    pairs = _bits(alone.select("src", "dst", part.alias("part")))
    if most["n"]:
        pairs = pairs.unionByName(_joined_pairs(named.join(large, "_part", "left_semi").select("src", "dst")))
    dropped(named, sizes, large)
    return pairs


def _bits(parts: DataFrame) -> DataFrame:
    """The closure of distinct edges (src, dst, part), no way leading from part to part."""
    kind = parts.schema["src"].dataType.simpleString()
    measures = {"shared": F.count_if(F.col("shares") > 1), "most": F.max("shares")}
    units, m = measured(parts.groupBy("part").applyInArrow(closure.units, closure.unit_schema(kind)), **measures)
    settle(units)
    # A number of partitions by itself: units hold about as many pairs each, but are few rows.
    shares = units.where("shares = 1").withColumn("share", F.lit(0)).repartition(max(1, min(MOST_TASKS, m["n"] - m["shared"])))
    if m["shared"]:
        # Units of several shares stand in files of their own, and each share reads them there: a shuffle would write a unit once a share.
        large = stored(units.where("shares > 1").repartition(min(MOST_TASKS, m["shared"])))
        settle(large)
        for share in range(m["most"]):
            own = large.where(F.col("shares") > share).withColumn("share", F.lit(share))
            shares = shares.unionByName(own) if share or m["n"] > m["shared"] else own
        if m["n"] == m["shared"]:
            dropped(units)
    return shares.mapInArrow(closure.expand, f"src {kind}, dst array<{kind}>").select("src", F.explode("dst").alias("dst"))


def _joined_pairs(edges: DataFrame) -> DataFrame:
    """The closure by joins: each round joins only the pairs that the last one found with the edges."""
    step = _edges(edges)
    fresh, m = measured(edges.select("src", "dst").distinct())
    closed = fresh
    while m["n"]:
        longer = fresh.select("src", F.col("dst").alias("_m")).join(step.select(F.col("src").alias("_m"), "dst"), "_m").select("src", "dst").distinct()
        fresh, m = measured(longer.join(closed, ["src", "dst"], "left_anti"))
        closed = closed.unionByName(fresh)  # each round's pairs are stored once
    return closed


def layers(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(layered, residue): Kahn's layers of a dependency relation src -> dst, sources first.

    layered: node, layer, the length of the longest path that ends there; residue: edges among nodes on a cycle or after one. A residue
    means that there is no topological order. Each edge is followed once, when its source is done.
    """
    dealt, n = _dealt(edges)
    kind = edges.schema["src"].dataType.simpleString()
    asked = dealt.select(F.col("dst").alias("node"), F.lit(1).cast("long").alias("missing")).unionByName(dealt.select(F.col("src").alias("node"), F.lit(0).cast("long").alias("missing")))
    if nodes is not None:
        asked = asked.unionByName(nodes.select("node", F.lit(0).cast("long").alias("missing")))

    def walk(edges: pa.Table, state: pa.Table) -> pa.Table:
        to = _out_edges(edges)
        own = {x: [m, layer, done] for x, m, layer, done in zip(*(state.column(c).to_pylist() for c in ("node", "missing", "layer", "done")), strict=True)}
        ready, sent = [x for x, (m, _, done) in own.items() if not m and not done], {}
        for x in ready:
            own[x][2] = True
            layer = own[x][1] + 1
            for y, here in to.get(x, ()):
                row = own[y] if here else sent.setdefault(y, [0, 0, False])
                row[0] -= 1
                row[1] = max(row[1], layer)
                if here and not row[0]:
                    ready.append(y)
        columns = list(zip(*((x, *row, foreign) for part, foreign in ((own, False), (sent, True)) for x, row in part.items()), strict=True)) or [[]] * 5
        kinds = state.schema.field("node").type, pa.int64(), pa.int32(), pa.bool_(), pa.bool_()
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["node", "missing", "layer", "done", "foreign"])

    state, last = asked.groupBy("node").agg(F.sum("missing").alias("missing")).withColumn("layer", F.lit(0)).withColumn("done", F.lit(False)), None
    while True:
        dealt_state = state.withColumn("block", _block("node", n))
        met = dealt.groupBy("block").cogroup(dealt_state.groupBy("block")).applyInArrow(walk, f"node {kind}, missing long, layer int, done boolean, foreign boolean")
        out, m = measured(met, sent=F.count_if("foreign"))
        if last is not None:
            dropped(last)
        if not m["sent"]:
            break
        state = out.groupBy("node").agg(F.sum("missing").alias("missing"), F.max("layer").alias("layer"), F.max("done").alias("done"))
        last = out
    done = out.where("done").select("node", "layer")
    return done, dealt.select("src", "dst").join(done.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")


def has_cycle(edges: DataFrame) -> bool:
    """Whether any path leads back to where it began; a self-loop does."""
    return not layers(edges)[1].isEmpty()


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def scc(edges: DataFrame) -> DataFrame:
    """(node, scc): strongly connected components of more than one node; scc is the smallest node of it.

    What lies before or after all cycles is taken off by layers from both ends. Each other node takes the smallest node that reaches it, and
    the smallest that it reaches: where both are one node, it is in that node's component. Nodes of a component agree in both, so
    edges between others are cut, and what is not found yet goes another round: all components that the cuts have parted find their smallest node at once.
    """
    left, found = edges.select("src", "dst").where("src != dst"), []
    while True:
        left = _turned(layers(_turned(layers(left)[1]))[1])
        left, m = measured(left)
        if not m["n"]:
            break
        nodes = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct().withColumn("value", F.col("node"))
        into, out = (_least(*_dealt(e), nodes, 0) for e in (left, _turned(left)))
        named = stored(into.withColumnRenamed("value", "into").join(out.withColumnRenamed("value", "out"), "node"))
        found.append(named.where("into = out").select("node", F.col("into").alias("scc")))
        rest = named.where("into != out")
        a, b = (rest.select(F.col("node").alias(x), F.col("into").alias(f"_i{x}"), F.col("out").alias(f"_o{x}")) for x in ("src", "dst"))
        left = left.join(a, "src").join(b, "dst").where("_isrc = _idst and _osrc = _odst").select("src", "dst")
    if not found:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("scc")).limit(0)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    big = stored(rows.groupBy("scc").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("scc"))
    return rows.join(big, "scc").select("node", "scc")


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges between components (or single nodes), without loops."""
    a, b = components.select(F.col("node").alias("src"), F.col("scc").alias("_a")), components.select(F.col("node").alias("dst"), F.col("scc").alias("_b"))
    named = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("_a", "src").alias("src"), F.coalesce("_b", "dst").alias("dst"))
    return named.where("src != dst").distinct()


def load_order(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """(node, layer, group, rank): a valid order, cycles included: layers of the condensation, then group, then rank inside it.

    edges: src depends on dst; ranks: node, rank. Dependencies come first.
    """
    own = stored(scc(edges))
    depends = condensed(edges, own).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    named = stored(ranks.join(own, "node", "left").select("node", "rank", F.coalesce("scc", "node").alias("group")))
    layered, _ = layers(depends, named.select(F.col("group").alias("node")).distinct())
    return named.join(layered.select(F.col("node").alias("group"), "layer"), "group").select("node", "layer", "group", "rank")


def dependencies(edges: DataFrame, node: str = "src") -> DataFrame:
    """(node, n) direct neighbours of each node."""
    return edges.distinct().groupBy(F.col(node).alias("node")).agg(F.count(F.lit(1)).alias("n"))

"""Graph queries: parts that follow one another in an order are an edge; corpus queries over the sample corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators import cycles, graph, resolve
from weftwork.operators.storage import stored
from weftwork.plans.bundle import Corpus
from weftwork.plans.relational import table
from weftwork.sources.sample import more_files, sample_files


def chain(spark, sf_dir):
    """(src, dst): parts on consecutive line numbers of one order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a = rows.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    return a.join(rows.withColumnRenamed("l_partkey", "dst"), ["l_orderkey", "l_linenumber"]).select("src", "dst").distinct()


def routes(spark, sf_dir):
    """(src, dst): parts on consecutive line numbers of one order of the same line status and discount; components of many sizes."""
    rows = table(spark, sf_dir, "lineitem")
    same = [F.col(c) for c in ("l_orderkey", "l_linestatus", "l_discount")]
    a = rows.select(*same, (F.col("l_linenumber") + 1).alias("at"), F.col("l_partkey").alias("src"))
    b = rows.select(*same, F.col("l_linenumber").alias("at"), F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linestatus", "l_discount", "at"]).select("src", "dst").distinct()


_CHAIN = "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"
_ROUTES = _CHAIN + " AND a.l_linestatus = b.l_linestatus AND a.l_discount = b.l_discount"
_CLOSED = f"e AS ({_ROUTES}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src), s AS (SELECT a.src AS node, min(a.dst) AS scc FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src != a.dst GROUP BY a.src), c AS (SELECT node, least(node, scc) AS scc FROM s)"


def reach_parts(spark, sf_dir):
    """Parts that the smallest part leads to, with the shortest way's length."""
    edges = chain(spark, sf_dir)
    return graph.reach(edges, edges.agg(F.min("src").alias("node")))


SQL_reach_parts = f"""WITH RECURSIVE e AS ({_CHAIN}), l AS (SELECT min(src) AS node, 0 AS hops FROM e UNION SELECT e.dst, hops + 1 FROM l JOIN e ON l.node = e.src WHERE hops < 40)
 SELECT node, min(hops) AS hops FROM l GROUP BY node"""


def topo_layers(spark, sf_dir):
    """Layers of the chain with edges from the smaller to the larger part."""
    return graph.layers(chain(spark, sf_dir).where("src < dst"))[0]


SQL_topo_layers = f"""WITH RECURSIVE e AS ({_CHAIN} AND a.l_partkey < b.l_partkey), l AS (SELECT src AS node, 0 AS layer FROM e UNION SELECT e.dst, layer + 1 FROM l JOIN e ON l.node = e.src)
 SELECT node, max(layer) AS layer FROM l GROUP BY node"""


def strong_components(spark, sf_dir):
    return graph.scc(routes(spark, sf_dir))


SQL_strong_components = f"WITH RECURSIVE {_CLOSED} SELECT node, scc FROM c"


def circular_groups(spark, sf_dir):
    return cycles.members_of(graph.scc(routes(spark, sf_dir))).groupBy("cycle_id").agg(F.count(F.lit(1)).alias("n"), F.max("node").alias("last"))


SQL_circular_groups = f"WITH RECURSIVE {_CLOSED} SELECT scc AS cycle_id, count(*) AS n, max(node) AS last FROM c GROUP BY scc"


def closure(spark, sf_dir):
    """Pairs that a way along forward edges joins."""
    return graph.reach_pairs(chain(spark, sf_dir).where("src < dst"))


SQL_closure = f"WITH RECURSIVE e AS ({_CHAIN} AND a.l_partkey < b.l_partkey), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r"


def has_cycle(spark, sf_dir):
    edges = stored(routes(spark, sf_dir))
    found = [("routes", graph.has_cycle(edges)), ("forward", graph.has_cycle(edges.where("src < dst")))]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{n}', {str(c).lower()})" for n, c in found) + " AS t(edges, cyclic)")


SQL_has_cycle = f"WITH RECURSIVE {_CLOSED} SELECT 'routes' AS edges, count(*) FILTER (src = dst) > 0 AS cyclic FROM r UNION ALL SELECT 'forward', false"


def dependencies(spark, sf_dir):
    return graph.dependencies(chain(spark, sf_dir), "dst")


SQL_dependencies = f"SELECT dst AS node, count(*) AS n FROM ({_CHAIN}) GROUP BY dst"


def condensed_edges(spark, sf_dir):
    edges = stored(routes(spark, sf_dir))
    return graph.condensed(edges, graph.scc(edges))


SQL_condensed_edges = f"""WITH RECURSIVE {_CLOSED} SELECT DISTINCT coalesce(a.scc, src) AS src, coalesce(b.scc, dst) AS dst FROM e LEFT JOIN c a ON a.node = src LEFT JOIN c b ON b.node = dst WHERE coalesce(a.scc, src) != coalesce(b.scc, dst)"""


def module_edges(spark, sf_dir):
    """Url hosts as modules that import by name: edges to a host, and to the hosts that are dotted prefixes of it."""
    host = F.array_join(F.reverse(F.split(F.regexp_extract("url", "://([^/?#]*)", 1), r"\.")), ".")
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), (F.col("page_id") % 20).cast("string")).alias("importer"), host.alias("name"))
    return graph.module_edges(rows, rows.select("name"))


_HOST = "array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')), '.')"
SQL_module_edges = f"""WITH r AS (SELECT 'page' || CAST(page_id % 20 AS VARCHAR) AS src, {_HOST} AS name FROM pages)
 SELECT DISTINCT src, n.name AS dst FROM r JOIN (SELECT DISTINCT name FROM r) n ON r.name = n.name OR starts_with(r.name, n.name || '.')"""


def load_order(spark, sf_dir):
    """A dependency order of all parts in the chain, cycles included."""
    edges = stored(chain(spark, sf_dir))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return graph.load_order(edges, nodes.withColumn("rank", F.col("node")))


def resolve_modules(spark, sf_dir):
    """Which file each import name of the sample corpus stands for, with two search directories."""
    files = sample_files(spark).select(F.concat(F.lit("lib/"), "path").alias("path")).union(spark.sql("SELECT 'app/shop/stock.py'"))
    dirs = spark.sql("SELECT * FROM VALUES ('app', 0), ('lib', 1) AS t(dir, priority)")
    asked = spark.sql("SELECT * FROM VALUES ('shop'), ('shop.stock'), ('shop.pay'), ('ring.a'), ('nowhere') AS t(name)")
    return resolve.resolve_modules(asked, dirs, files)


# The sample corpus is fixed text, so what its queries give is written out, from reading the files.
SQL_resolve_modules = """SELECT * FROM (VALUES ('ring.a', 'lib/ring/a.py', 'RegularModule', 'lib'), ('shop', 'app/shop/', 'NamespacePackageDir', 'app'),
 ('shop.pay', 'lib/shop/pay.py', 'RegularModule', 'lib'), ('shop.stock', 'app/shop/stock.py', 'RegularModule', 'app')) AS t(name, path, kind, dir)"""


def corpus_modules(spark, sf_dir):
    return Corpus(sample_files(spark), "main").module_kinds()


SQL_corpus_modules = """SELECT * FROM (VALUES ('main', 'entry'), ('ring', 'inline'), ('ring.a', 'wrapper'), ('ring.b', 'wrapper'), ('ring.c', 'wrapper'), ('ring.d', 'wrapper'),
 ('ring.e', 'wrapper'), ('ring.f', 'wrapper'), ('shop', 'wrapper'), ('shop.basket', 'wrapper'), ('shop.formats', 'wrapper'), ('shop.pay', 'wrapper'), ('shop.prices', 'inline'),
 ('shop.report', 'wrapper'), ('shop.stock', 'wrapper')) AS t(module, decision)"""


def corpus_imports(spark, sf_dir):
    return Corpus(sample_files(spark), "main").classified()


SQL_corpus_imports = """SELECT split_part(name, '.', 1) AS root, name, module, ord AS import_ord, level, CASE WHEN name IN ('__future__', 'importlib', 'json', 'os', 'typing') THEN 'StandardLibrary'
 WHEN name IN ('numpy', 'requests') THEN 'ThirdParty' ELSE 'FirstParty' END AS category FROM (VALUES ('main', 0, 'os', 0), ('main', 1, 'shop', 0), ('main', 2, 'shop.prices', 0),
 ('main', 3, 'shop.stock', 0), ('main', 4, 'requests', 0), ('main', 5, 'shop.report', 0), ('shop', 0, 'shop.basket', 1), ('shop', 1, 'shop.pay', 1), ('shop', 2, 'shop.prices', 1),
 ('shop.basket', 0, '__future__', 0), ('shop.basket', 1, 'shop.stock', 1), ('shop.pay', 0, 'json', 0), ('shop.pay', 1, 'shop', 0), ('shop.stock', 0, 'numpy', 0),
 ('shop.report', 0, 'importlib', 0), ('shop.report', 1, 'typing', 0), ('shop.report', 2, 'shop.basket', 0), ('shop.report', 3, 'shop.formats', 0), ('ring.a', 0, 'ring.b', 0),
 ('ring.b', 0, 'ring.a', 0), ('ring.c', 0, 'ring', 0), ('ring.d', 0, 'ring', 0), ('ring.e', 0, 'ring.f', 0), ('ring.f', 0, 'ring.e', 0)) AS t(module, ord, name, level)"""


def corpus_cycles(spark, sf_dir):
    return Corpus(sample_files(spark), "main").cycle_types()


SQL_corpus_cycles = f"""SELECT cycle_id, CAST(n AS BIGINT) AS n, cycle_type, cycle_type != 'ModuleConstants' AS resolvable, CASE WHEN cycle_type = 'ModuleConstants' THEN '{cycles.UNRESOLVABLE}' END AS reason
 FROM (VALUES ('ring.a', 2, 'ModuleConstants'), ('ring.c', 2, 'FunctionLevel'), ('ring.e', 2, 'ClassLevel'), ('shop', 3, 'FunctionLevel')) AS t(cycle_id, n, cycle_type)"""


def corpus_trims(spark, sf_dir):
    """What liveness leaves of imports and lists: names that go, statements that go whole, listed names that stay."""
    c = Corpus(sample_files(spark), "main")
    none = F.lit(None).cast("int")
    rows = c.trimmed().select(F.lit("trimmed").alias("step"), "module", "item_ord", F.col("local").alias("name"))
    rows = rows.unionByName(c.removable().select(F.lit("removable").alias("step"), "module", "item_ord", F.lit(None).cast("string").alias("name")))
    return rows.unionByName(c.exports().select(F.lit("export").alias("step"), "module", none.alias("item_ord"), "name"))


SQL_corpus_trims = """SELECT * FROM (VALUES ('trimmed', 'main', 4, 'requests'), ('trimmed', 'shop.report', 3, 'Basket'), ('trimmed', 'shop.stock', 0, 'numpy'), ('removable', 'main', 4, NULL),
 ('removable', 'shop.report', 3, NULL), ('removable', 'shop.stock', 0, NULL), ('export', 'shop', NULL, 'Basket'), ('export', 'shop', NULL, 'checkout'), ('export', 'shop.prices', NULL, 'TABLE'),
 ('export', 'shop.prices', NULL, 'price')) AS t(step, module, item_ord, name)"""


def corpus_cycle_report(spark, sf_dir):
    return Corpus(sample_files(spark), "main").cycle_report().withColumn("members", F.array_join("members", ","))


SQL_corpus_cycle_report = f"""SELECT cycle_id, members, CAST(n AS BIGINT) AS n, CASE WHEN bad THEN 'unresolvable cycle: ' || replace(members, ',', ' -> ') || '; {cycles.UNRESOLVABLE}' END AS message
 FROM (VALUES ('ring.a', 'ring.a,ring.b', 2, true), ('ring.c', 'ring.c,ring.d', 2, false), ('ring.e', 'ring.e,ring.f', 2, false), ('shop', 'shop,shop.basket,shop.pay', 3, false)) AS t(cycle_id, members, n, bad)"""


def corpus_importers(spark, sf_dir):
    """Modules that each module imports itself, modules bound whole by whom, and what the entry defines."""
    c = Corpus(sample_files(spark), "main")
    rows = c.imported_modules().select(F.lit("imports").alias("fact"), "module", "name")
    rows = rows.unionByName(c.namespace_importers().select(F.lit("bound by").alias("fact"), "module", F.col("importer").alias("name")))
    return rows.unionByName(c.entry_globals().select(F.lit("defines").alias("fact"), F.lit("main").alias("module"), "name"))


SQL_corpus_importers = """SELECT * FROM (VALUES ('imports', 'main', 'shop'), ('imports', 'main', 'shop.prices'), ('imports', 'main', 'shop.report'), ('imports', 'main', 'shop.stock'),
 ('imports', 'ring.a', 'ring.b'), ('imports', 'ring.b', 'ring.a'), ('imports', 'ring.c', 'ring'), ('imports', 'ring.c', 'ring.d'), ('imports', 'ring.d', 'ring'), ('imports', 'ring.d', 'ring.c'),
 ('imports', 'ring.e', 'ring.f'), ('imports', 'ring.f', 'ring.e'), ('imports', 'shop', 'shop.basket'), ('imports', 'shop', 'shop.pay'), ('imports', 'shop', 'shop.prices'),
 ('imports', 'shop.basket', 'shop.stock'), ('imports', 'shop.pay', 'shop'), ('imports', 'shop.pay', 'shop.basket'), ('imports', 'shop.report', 'shop.basket'), ('imports', 'shop.report', 'shop.formats'),
 ('bound by', 'ring.c', 'ring.d'), ('bound by', 'ring.d', 'ring.c'), ('bound by', 'shop.basket', 'shop.pay'), ('bound by', 'shop.stock', 'main'), ('defines', 'main', 'RATE'), ('defines', 'main', 'run')) AS t(fact, module, name)"""


def corpus_notes(spark, sf_dir):
    """Of the second corpus: missing modules, unused names, imports that may move, lists read from outside."""
    c = Corpus(more_files(spark), "main")
    rows = c.missing().select(F.lit("missing").alias("note"), "module", "name")
    rows = rows.unionByName(c.unused().select(F.lit("unused").alias("note"), "module", F.col("local").alias("name")))
    rows = rows.unionByName(c.movable().select(F.lit("movable").alias("note"), "module", F.col("source").alias("name")))
    return rows.unionByName(c.list_accesses().select(F.lit("reads list").alias("note"), "module", F.col("accessed").alias("name")))


SQL_corpus_notes = """SELECT * FROM (VALUES ('missing', 'main', 'tools.lost'), ('unused', 'main', 'json'), ('unused', 'main', 'pi'), ('unused', 'tools', 'hexdigits'), ('movable', 'left.a', 'left.b'),
 ('movable', 'left.b', 'left.a'), ('reads list', 'main', 'tools')) AS t(note, module, name)"""


def corpus_live_symbols(spark, sf_dir):
    return Corpus(sample_files(spark), "main").live()


def corpus_bundle(spark, sf_dir):
    return Corpus(sample_files(spark), "main").bundle()


_ONLY_ROWS = (load_order, corpus_live_symbols, corpus_bundle)
QUERIES = {k: f for k, f in list(globals().items()) if f"SQL_{k}" in globals()}
SQL = {k: globals()[f"SQL_{k}"] for k in QUERIES}
QUERIES |= {f.__name__: f for f in _ONLY_ROWS}


def flagship(spark, sf_dir):
    """What the smallest part leads to along forward edges, in dependency order: reach, then layers of what is reached."""
    edges = stored(chain(spark, sf_dir).where("src < dst"))
    met = graph.reach(edges, edges.agg(F.min("src").alias("node")))
    own = edges.join(met.select(F.col("node").alias("src")), "src", "left_semi")
    return met.join(graph.layers(own, met.select("node"))[0], "node").select("node", "hops", "layer")

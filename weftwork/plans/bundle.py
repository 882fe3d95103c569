"""From a corpus of files to its facts, cycles, live symbols, conflicts, and a bundle of the modules that can be inlined."""

from __future__ import annotations

import ast
import sys
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions import names
from weftwork.operators import aggregates, cycles, graph, liveness, resolve, symbols
from weftwork.operators.storage import stored
from weftwork.sources import parse


class Corpus:
    """The tables of a corpus. files: path, source; installed: the names of importable packages that are no part of it. Each is built once and stored where it is used often."""

    def __init__(self, files: DataFrame, entry: str, installed: DataFrame | None = None):
        spark = files.sparkSession
        self.entry = entry
        self.installed = spark.createDataFrame([], "name string") if installed is None else installed
        named = files.select("path", names.line_ends(F.col("source")).alias("source"))
        stem = F.coalesce(names.module_name(F.col("path")), F.lit("__main__"))
        self.files = stored(named.select(stem.alias("module"), "path", "source", names.module_kind(F.col("path")).alias("kind")))
        self.parsed = stored(parse.parse(self.files))
        self.modules = stored(self.files.join(self.parsed.where("record = 'error'").select("path"), "path", "left_anti").select("module", "path", "kind"))
        self.stdlib = spark.createDataFrame([(x,) for x in sorted(sys.stdlib_module_names)], "name string")
        self.errors = self.parsed.where("record = 'error'").select("module", "path", F.col("kind").alias("error"), F.col("name").alias("message"))
        self.imports = stored(self._imports())
        self.edges = stored(self._edges())

    def _absolute(self, rows: DataFrame, name: str) -> DataFrame:
        """rows (module, level, name) with source, the absolute module name; a package is known by its kind."""
        own = self.files.select("module", (F.col("kind") == "PackageInit").alias("_package"))
        parts = names.parts_of(F.coalesce(F.col(name), F.lit("")))
        out = rows.join(own, "module")
        return out.withColumn("source", F.coalesce(names.absolute_name(F.col("module"), F.col("_package"), F.col("level"), parts), F.lit(""))).drop("_package")

    def _imports(self) -> DataFrame:
        return self._absolute(parse.imports(self.parsed), "name")

    def _edges(self) -> DataFrame:
        """Importer to imported modules, to submodules that a from-import names, and to the packages above them."""
        each = self.imports.select(F.col("module").alias("importer"), F.col("source").alias("name"))
        known = self.modules.select(F.col("module").alias("name"))
        deeper = self.imports.where("import_type in ('From', 'Relative')").select(F.col("module").alias("importer"), "source", F.explode("names").alias("n"))
        deeper = deeper.select("importer", F.concat_ws(".", F.nullif("source", F.lit("")), F.col("n.name")).alias("name")).join(known, "name", "left_semi").select("importer", "name")
        return graph.module_edges(each.unionByName(deeper), known)

    def classified(self) -> DataFrame:
        own = self.modules.select(F.col("module").alias("name"), (F.col("kind") == "PackageInit").alias("is_package"))
        return resolve.classify_imports(self.imports.select("module", "import_ord", F.col("source").alias("name"), "level"), stdlib=self.stdlib, first_party=own, installed=self.installed)

    def missing(self) -> DataFrame:
        """(module, name, message): first-party imports without a module, each of which is fatal."""
        scopes = self.imports.select("module", "import_ord", resolve.tolerated(F.coalesce("scope_path", F.array().cast("array<string>"))).alias("tolerated"))
        return symbols.missing_first_party(self.classified().join(scopes, ["module", "import_ord"]), self.modules.select(F.col("module").alias("name")))

    @cached_property
    def _met(self) -> DataFrame:
        start = self.modules.where(F.col("module") == self.entry).select(F.col("module").alias("node"))
        return stored(graph.reach(self.edges, start))

    @cached_property
    def _components(self) -> DataFrame:
        return graph.scc(self.edges)

    def reachable(self) -> DataFrame:
        return self._met

    def ranks(self) -> DataFrame:
        """(node, rank): the order in which modules are first met from the entry, by hops, then name."""
        return resolve.first_match(self._met, ["node"], ["hops"]).select("node", F.struct("hops", "node").alias("rank"))

    def cycle_members(self) -> DataFrame:
        return cycles.members_of(self._components)

    def cycle_types(self) -> DataFrame:
        bound = parse.bindings(self.parsed).where("kind = 'symbol'")
        bound = self._absolute(bound, "target").select("module", "local", "source")
        # `from package import module` binds the module itself.
        known = self.modules.select(F.col("module").alias("_m"))
        whole = bound.withColumn("_m", F.concat_ws(".", "source", "local")).join(known, "_m", "left_semi").select("module", "local", F.col("_m").alias("source"))
        reads = parse.item_names(self.parsed).where("role = 'read'").select("module", "item_ord", "name")
        return cycles.classify(stored(self.cycle_members()), parse.items(self.parsed), reads, bound.unionByName(whole).distinct())

    def cycle_report(self) -> DataFrame:
        """(cycle_id, members, n, message): members in order; a message where the cycle cannot be resolved."""
        ordered = cycles.ordered_members(self.cycle_members())
        return ordered.join(cycles.report(self.cycle_types(), ordered), "cycle_id", "left")

    def movable(self) -> DataFrame:
        """(cycle_id, module, import_ord, source): imports of a function-level cycle, at module level or in one function, that may stand in functions."""
        plain = F.size(F.coalesce("scope_path", F.array().cast("array<string>"))) == 0
        inside = (F.size("scope_path") == 1) & F.col("scope_path")[0].startswith("Function:")
        return cycles.movable_imports(self.cycle_types(), self.cycle_members(), self.imports.where(F.col("is_movable") & (plain | inside)).select("module", "import_ord", "source"))

    @cached_property
    def _facts(self) -> liveness.Facts:
        return self.facts()

    @cached_property
    def _live(self) -> DataFrame:
        return stored(self.live())

    def unused(self) -> DataFrame:
        """(module, item_ord, local): imported names that their own module never uses."""
        return liveness.unused_imports(self._facts, self.modules.where("kind = 'PackageInit'"))

    @cached_property
    def _trimmed(self) -> DataFrame:
        return stored(self._trim())

    def trimmed(self) -> DataFrame:
        return self._trimmed

    def _trim(self) -> DataFrame:
        """(module, item_ord, local): imported names that nothing live uses.

        Members of cycles keep theirs, modules with side effects those of the standard library, and all the imports of modules that have side effects.
        """
        members = self.cycle_members().select(F.col("node").alias("module"))
        busy = self._facts.items.where("has_side_effects").select("module").distinct()
        active = parse.table(self.parsed, "module", effects="flag").where("effects").select(F.col("module").alias("source"))
        rows = parse.items(self.parsed).where("item_type in ('Import', 'FromImport') and level = 0")
        std = rows.select("module", "item_ord", F.split(F.coalesce("from_module", "name"), r"\.")[0].alias("name")).join(self.stdlib, "name", "left_semi")
        std = std.join(busy, "module", "left_semi").select("module", "item_ord")
        whole = self._facts.aliases.select("module", F.col("ord").alias("item_ord"), "source")
        below = self._facts.named.select("module", "item_ord", F.concat_ws(".", F.nullif("source", F.lit("")), "original").alias("source"))
        needed = whole.unionByName(below).join(active, "source", "left_semi").select("module", "item_ord")
        return liveness.trimmed_imports(self._facts, self._live, members, std.unionByName(needed))

    def removable(self) -> DataFrame:
        """(module, item_ord): import statements none of whose names is kept."""
        return liveness.removable_statements(self._facts, self.trimmed())

    def exports(self) -> DataFrame:
        """(module, name): listed names that are live."""
        return liveness.live_exports(self._facts, self._live)

    def list_accesses(self) -> DataFrame:
        return symbols.list_accesses(self._facts.attrs, self._facts.aliases, self.modules)

    def imported_modules(self) -> DataFrame:
        """(module, name): the modules that each module imports itself: those it names, and from-imported names that are modules."""
        known = self.modules.select(F.col("module").alias("name"))
        named = self.imports.select("module", F.col("source").alias("name"))
        each = self.imports.where("import_type in ('From', 'Relative')").select("module", "source", F.explode("names").alias("n"))
        below = each.select("module", F.concat_ws(".", F.nullif("source", F.lit("")), F.col("n.name")).alias("name"))
        return named.unionByName(below).join(known, "name", "left_semi").select("module", "name").distinct()

    def namespace_importers(self) -> DataFrame:
        """(module, importer): a module bound whole, by `import` or by a from-import that names it, and who binds it. Pairs, so that no set grows."""
        known = self.modules.select("module")
        whole = self._facts.aliases.select(F.col("source").alias("module"), F.col("module").alias("importer"))
        below = self._facts.submodules().select(F.col("source").alias("module"), F.col("module").alias("importer"))
        return whole.unionByName(below).join(known, "module", "left_semi").distinct()

    def entry_globals(self) -> DataFrame:
        """(name) of what the entry defines at its top level, imports aside."""
        own = parse.table(self.parsed, "symbol", kind="kind", name="name", scope="target")
        return own.where((F.col("module") == self.entry) & (F.col("scope") == "module") & (F.col("kind") != "Import")).select("name").distinct()

    def facts(self) -> liveness.Facts:
        p = self.parsed
        bound = parse.bindings(p)
        named = self._absolute(bound.where("kind = 'symbol'"), "target").select("module", "local", "source", "original", F.col("item_ord").alias("ord"), "item_ord")
        stars = self._absolute(bound.where("kind = 'star'"), "target").select("module", "source", "item_ord", F.col("item_ord").alias("ord"))
        aliases = bound.where("kind = 'module'").select("module", "local", F.col("target").alias("source"), F.col("item_ord").alias("ord"))
        listed = p.where("record = 'export' and scope is not null").select("module", F.explode("scope").alias("name"))
        deps = parse.table(p, "dep", item_ord="ord", symbol="name", dep="target")
        attrs = parse.table(p, "attr", item_ord="ord", base="name", attr="target")
        ranked = self.modules.select("module", F.col("module").alias("rank"))
        return liveness.Facts(ranked, parse.items(p), parse.item_names(p), deps, attrs, named, stars, aliases, listed, parse.used(p).select("module", "name"))

    def live(self) -> DataFrame:
        return liveness.live(self.facts(), self.entry)

    def conflicts(self) -> DataFrame:
        """Renames of top-level symbols that more than one reachable module defines."""
        own = parse.table(self.parsed, "symbol", kind="kind", name="name", scope="target").where("scope = 'module' and kind != 'Import' and not name like '\\_\\_%\\_\\_'").select("module", "name").distinct()
        met = self.reachable().select(F.col("node").alias("module"))
        return aggregates.ordinal_renames(own.join(met, "module", "left_semi"), "name", "module", ["module"])

    def module_kinds(self) -> DataFrame:
        """(module, decision): entry, wrapper or inline."""
        effects = parse.table(self.parsed, "module", effects="flag")
        members = self.cycle_members().select(F.col("node").alias("module"), F.lit(True).alias("_c"))
        rows = self.modules.join(effects, "module", "left").join(members, "module", "left")
        ok = names.identifier(F.element_at(F.split("module", r"\."), -1)) == F.element_at(F.split("module", r"\."), -1)
        no = F.lit(False)
        return rows.select("module", resolve.bundle_kind(F.coalesce("effects", no), ok, F.coalesce("_c", no), F.col("module") == self.entry).alias("decision"))

    def requirements(self) -> DataFrame:
        third = self.classified().where("category = 'ThirdParty' and level = 0").select("name")
        met = aggregates.distinct_roots(third).join(self.modules.select(F.col("module").alias("root")), "root", "left_anti")
        return aggregates.requirements(met, met.select("root", F.lit(None).cast("string").alias("package")))

    def load_order(self) -> DataFrame:
        return graph.load_order(self.edges.join(self.reachable().select(F.col("node").alias("src")), "src", "left_semi"), self.ranks())

    def bundle(self) -> DataFrame:
        """(entry, text, n_parts): reachable modules in load order as one file that runs by itself.

        Every module but the entry becomes a block of source text that a small loader executes on first import, so inlining needs no renaming; decisions stay in the other tables.
        """
        order = self.load_order()
        rows = order.join(self.files.select(F.col("module").alias("node"), "source", "kind"), "node")
        parts = rows.select(F.lit(self.entry).alias("entry"), (F.col("node") == self.entry).cast("int").alias("last"), "layer", "group", F.col("rank").alias("rank"), F.to_json(F.struct("node", "source", "kind")).alias("block"))
        parts = parts.mapInArrow(_blocks, "entry string, last int, layer int, group string, hops int, block string")
        joined = aggregates.assembled(parts, "entry", ["last", "layer", "group", "hops"], "block")
        future = self.parsed.where((F.col("record") == "future") & (F.col("module") == self.entry)).agg(F.array_sort(F.collect_set("name")).alias("future"))  # a handful of names
        head = F.when(F.size("future") > 0, F.concat(F.lit("from __future__ import "), F.array_join("future", ", "), F.lit("\n"))).otherwise(F.lit(""))
        return joined.join(F.broadcast(future)).withColumn("text", F.concat(head, F.lit(LOADER), F.lit("\n"), "text", F.lit("\n"))).drop("future")


LOADER = '''import sys as _sys, importlib.abc as _abc, importlib.util as _util

_modules = {}


class _Finder(_abc.MetaPathFinder, _abc.Loader):
    def find_spec(self, name, path=None, target=None):
        if name in _modules:
            return _util.spec_from_loader(name, self, is_package=_modules[name][1])

    def exec_module(self, module):
        exec(compile(_modules[module.__name__][0], module.__name__, "exec"), module.__dict__)


_sys.meta_path.insert(0, _Finder())'''


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import json

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            own = json.loads(row["block"])
            if row["last"]:
                tree = ast.parse(own["source"])  # its __future__ imports stand at the head of the bundle
                tree.body = [s for s in tree.body if not (isinstance(s, ast.ImportFrom) and s.module == "__future__" and not s.level)]
                text = ast.unparse(tree)
            else:
                text = f"_modules[{own['node']!r}] = ({own['source']!r}, {own['kind'] == 'PackageInit'!r})"
            out.append({"entry": row["entry"], "last": row["last"], "layer": row["layer"], "group": row["group"], "hops": row["rank"]["hops"], "block": text})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("entry", pa.string()), ("last", pa.int32()), ("layer", pa.int32()), ("group", pa.string()), ("hops", pa.int32()), ("block", pa.string())]))

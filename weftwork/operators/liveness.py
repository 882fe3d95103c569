"""Which symbols are live from an entry module on: a successor relation between (module, symbol) pairs, and its reach.

The relation is built by joins, once; the fix point is the frontier loop of reach(). Marks that a module gives only
once (its side effects, its whole surface, its listed names) are pseudo symbols of their own, so that they too are
nodes of the relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions import names
from weftwork.operators.graph import reach
from weftwork.operators.storage import stored

EFFECTS, SURFACE, LISTED = "<side-effects>", "<surface>", "<listed>"


def node(module: str = "module", symbol: str = "name"):
    return F.concat(F.col(module), F.lit("::"), F.col(symbol))


class Facts:
    """The narrow tables that the relation is made of.

    modules: module, rank; items: module, item_ord, item_type, name, has_side_effects, containing_scope; roles: module, item_ord, role, name; deps: module, item_ord, symbol, dep;
    attrs: module, item_ord, base, attr; named: module, local, source, original, ord, item_ord (source absolute); stars: module, source, item_ord, ord;
    aliases: module, local, source (whole modules), ord; listed: module, name (explicit exports); used: module, name (names that functions use when they run).
    """

    def __init__(self, modules, items, roles, deps, attrs, named, stars, aliases, listed, used):
        self.modules, self.items, self.roles, self.deps, self.attrs = modules, items, roles, deps, attrs
        self.named, self.stars, self.aliases, self.listed, self.used = named, stars, aliases, listed, used
        self.defined = roles.where("role = 'defined'").select("module", "name").distinct()

    def definer(self) -> DataFrame:
        """(name, source): the first module by rank that defines a bare name."""
        return self.defined.join(self.modules, "module").groupBy("name").agg(F.min_by("module", F.struct("rank", "module")).alias("source"))

    def submodules(self) -> DataFrame:
        """(module, name, source): from-imports that name a module."""
        known = self.modules.select(F.col("module").alias("source"))
        rows = self.named.select("module", F.col("local").alias("name"), F.concat_ws(".", F.nullif("source", F.lit("")), "original").alias("source"), "ord")
        return _first(rows.join(known, "source", "left_semi"))

    def alias_modules(self) -> DataFrame:
        known = self.modules.select(F.col("module").alias("source"))
        return _first(self.aliases.select("module", F.col("local").alias("name"), "source", "ord").join(known, "source", "left_semi"))

    def alias_symbols(self) -> DataFrame:
        """(module, name, source, original): a named binding first, then a star import whose target lists the name."""
        known = self.modules.select(F.col("module").alias("source"))
        direct = self.named.join(known, "source", "left_semi").select("module", F.col("local").alias("name"), "source", "original", F.col("ord"))
        starred = self.stars.join(self.listed.select(F.col("module").alias("source"), "name"), "source").select("module", "name", "source", F.col("name").alias("original"), (F.col("ord") + 1_000_000).alias("ord"))
        rows = direct.unionByName(starred)
        return rows.groupBy("module", "name").agg(F.min_by(F.struct("source", "original"), F.struct("ord", "source")).alias("s")).select("module", "name", "s.source", "s.original")


def _first(rows: DataFrame) -> DataFrame:
    return rows.groupBy("module", "name").agg(F.min_by("source", F.struct("ord", "source")).alias("source"))


def targets(facts: Facts, wanted: DataFrame, *, local_first: bool, entry_order: bool = False) -> DataFrame:
    """(…, to) for each (module, name) that is read: the node it stands for, by the first rule that has one.

    In order: a submodule's surface; an aliased module's surface; the symbol that an alias names; the defining module (the own one first if local_first).
    The entry module asks for the alias symbol before the aliased module.
    """
    keys = ["module", "name"]
    rows = wanted.join(facts.submodules().withColumnRenamed("source", "_sub"), keys, "left").join(facts.alias_modules().withColumnRenamed("source", "_mod"), keys, "left")
    rows = rows.join(facts.alias_symbols().select("module", "name", F.col("source").alias("_src"), "original"), keys, "left")
    rows = rows.join(facts.definer().withColumnRenamed("source", "_def"), "name", "left").join(facts.defined.withColumn("_own", F.lit(True)), keys, "left")
    surface = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.col(c), F.lit(f"::{SURFACE}")))
    symbol = F.when(F.col("_src").isNotNull(), F.concat("_src", F.lit("::"), "original"))
    own = F.when(F.coalesce("_own", F.lit(False)), node()) if local_first else F.lit(None).cast("string")
    anyone = F.when(F.col("_def").isNotNull(), F.concat("_def", F.lit("::"), "name"))
    order = [surface("_sub"), symbol, surface("_mod")] if entry_order else [surface("_sub"), surface("_mod"), symbol]
    return rows.withColumn("to", F.coalesce(*order, own, anyone)).drop("_sub", "_mod", "_src", "original", "_def", "_own").where("to is not null")


def attribute_targets(facts: Facts, attrs: DataFrame) -> DataFrame:
    """(…, to) of attribute accesses base.attr: an aliased module or submodule, a module by its full name, the first module under that name that defines the attribute, or the symbol of the base."""
    base = attrs.withColumn("name", F.col("base"))
    keys = ["module", "name"]
    whole = facts.modules.select(F.col("module").alias("name"), F.col("module").alias("_full"))
    rows = base.join(facts.submodules().withColumnRenamed("source", "_sub"), keys, "left").join(facts.alias_modules().withColumnRenamed("source", "_mod"), keys, "left").join(whole, "name", "left")
    ranked = facts.defined.join(facts.modules, "module")
    under = ranked.select(F.explode(names.dotted_prefixes(F.col("module"))).alias("_b"), F.col("name").alias("attr"), F.col("module").alias("_m"), "rank").groupBy("_b", "attr").agg(F.min_by("_m", "rank").alias("_under"))
    rows = rows.withColumn("_b", F.coalesce("_mod", "_sub", "_full")).join(under, ["_b", "attr"], "left")
    own = facts.defined.select(F.col("module").alias("_b"), F.col("name").alias("attr"), F.lit(True).alias("_has"))
    rows = rows.join(own, ["_b", "attr"], "left")
    place = F.when(F.col("_has") | F.col("_under").isNull(), F.col("_b")).otherwise(F.col("_under"))
    return rows.withColumn("to", F.concat(place, F.lit("::"), "attr")).where("to is not null").drop("name", "_sub", "_mod", "_full", "_b", "_under", "_has")


def successors(facts: Facts) -> DataFrame:
    """(src, dst) between nodes module::symbol."""
    keys = ["module", "item_ord"]
    by_symbol = facts.roles.where("role = 'defined'").select("module", "item_ord", F.col("name").alias("symbol"))
    at_once = facts.roles.where("role = 'read'").select("module", "item_ord", "name")
    later = facts.roles.where("role in ('eventual_read', 'write', 'eventual_write')").select("module", "item_ord", "name")
    to_now, to_later = targets(facts, at_once, local_first=True), targets(facts, later, local_first=True)
    to_attr = attribute_targets(facts, facts.attrs)
    item_to = to_now.select(*keys, "to").unionByName(to_later.select(*keys, "to")).unionByName(to_attr.select(*keys, "to"))
    edges = by_symbol.join(item_to, keys).select(node("module", "symbol").alias("src"), F.col("to").alias("dst"))
    # Dependencies of one symbol of an item.
    dep = targets(facts, facts.deps.withColumnRenamed("dep", "name"), local_first=True)
    edges = edges.unionByName(dep.select(node("module", "symbol").alias("src"), F.col("to").alias("dst")))
    # A symbol that is only imported leads to where it comes from.
    hop = facts.alias_symbols().join(facts.defined, ["module", "name"], "left_anti")
    edges = edges.unionByName(hop.select(node().alias("src"), F.concat("source", F.lit("::"), "original").alias("dst")))
    # Imports inside a definition are live with it.
    scoped = facts.items.where("containing_scope is not null and item_type in ('Import', 'FromImport')").select("module", "item_ord", F.col("containing_scope").alias("symbol"))
    inside = facts.roles.where("role = 'imported'").join(scoped, keys).select("module", "symbol", "name")
    edges = edges.unionByName(targets(facts, inside, local_first=False).select(node("module", "symbol").alias("src"), F.col("to").alias("dst")))
    # A module's surface: its listed names, else its public ones, and its side effects.
    has_list = facts.listed.select("module").distinct()
    public = facts.defined.join(has_list, "module", "left_anti").where(names.is_public(F.col("name")))
    shown = facts.listed.select("module", "name").unionByName(public.select("module", "name"))
    edges = edges.unionByName(shown.select(F.concat("module", F.lit(f"::{SURFACE}")).alias("src"), node().alias("dst")))
    edges = edges.unionByName(facts.modules.select(F.concat("module", F.lit(f"::{SURFACE}")).alias("src"), F.concat("module", F.lit(f"::{EFFECTS}")).alias("dst")))
    # Whatever is live in a module, its side effects are.
    edges = edges.unionByName(facts.defined.select(node().alias("src"), F.concat("module", F.lit(f"::{EFFECTS}")).alias("dst")))
    active = facts.items.where("has_side_effects").select(*keys)
    effects = item_to.join(active, keys).select(F.concat("module", F.lit(f"::{EFFECTS}")).alias("src"), F.col("to").alias("dst"))
    bound = by_symbol.join(active, keys).select(F.concat("module", F.lit(f"::{EFFECTS}")).alias("src"), node("module", "symbol").alias("dst"))
    edges = edges.unionByName(effects).unionByName(bound)
    # Modules that build their exports at run time keep all listed names.
    every = facts.roles.where("role in ('read', 'eventual_read')")
    has = lambda *n: F.bool_or(F.col("name").isin(*n))
    dynamic = every.groupBy("module").agg((has("setattr") & has("locals", "globals") & has("__all__")).alias("_d")).where("_d").select("module")
    kept = facts.listed.join(dynamic, "module")
    edges = edges.unionByName(kept.select(F.concat("module", F.lit(f"::{EFFECTS}")).alias("src"), F.concat("module", F.lit(f"::{LISTED}")).alias("dst")))
    edges = edges.unionByName(kept.select(F.concat("module", F.lit(f"::{LISTED}")).alias("src"), node().alias("dst")))
    return edges.where("src != dst").distinct()


def seeds(facts: Facts, entry: str) -> DataFrame:
    """(node): what the entry module itself makes live: its definitions, reads, attribute accesses, side effects and imports."""
    own = F.col("module") == entry
    reads = facts.roles.where(own & F.col("role").isin("read", "eventual_read")).select("module", "item_ord", "name")
    found = targets(facts, reads, local_first=False, entry_order=True).select(F.col("to").alias("node"))
    found = found.unionByName(attribute_targets(facts, facts.attrs.where(own)).select(F.col("to").alias("node")))
    defs = facts.items.where(own & F.col("item_type").isin("FunctionDef", "ClassDef")).select(node().alias("node"))
    active = facts.items.where(own & F.col("has_side_effects")).select("module", "item_ord")
    bound = facts.roles.where("role = 'defined'").join(active, ["module", "item_ord"]).select(node().alias("node"))
    imported = facts.roles.where(own & (F.col("role") == "imported")).select("module", "item_ord", "name")
    brought = targets(facts, imported, local_first=False, entry_order=True).where(~F.col("to").endswith(SURFACE)).select(F.col("to").alias("node"))
    touched = facts.aliases.where(own).join(facts.modules.select(F.col("module").alias("source")), "source", "left_semi").select(F.concat("source", F.lit(f"::{EFFECTS}")).alias("node"))
    stars = facts.stars.where(own).select(F.concat("source", F.lit(f"::{SURFACE}")).alias("node"))
    effects = facts.modules.where(own).select(F.concat("module", F.lit(f"::{EFFECTS}")).alias("node"))
    return found.unionByName(defs).unionByName(bound).unionByName(brought).unionByName(touched).unionByName(stars).unionByName(effects).distinct()


def live(facts: Facts, entry: str) -> DataFrame:
    """(module, name) of every live symbol; pseudo symbols are left out."""
    met = reach(stored(successors(facts)), seeds(facts, entry))
    parts = F.split("node", "::")
    return met.select(parts[0].alias("module"), parts[1].alias("name")).where(~F.col("name").startswith("<")).distinct()


def trimmed_imports(facts: Facts, alive: DataFrame, protected: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(module, item_ord, local) of imported names that nothing live needs.

    Only imports at module level are trimmed: those of a function go with it. Kept are names that a live definition, an item with side effects or a live assignment reads, that are listed exports or re-exported, those of
    protected modules (module) and of kept statements (module, item_ord). Star imports are always kept.
    """
    keys = ["module", "item_ord"]
    at_top = facts.items.where("containing_scope is null").select(*keys)
    imported = facts.roles.where("role = 'imported'").select(*keys, F.col("name").alias("local")).join(at_top, keys, "left_semi")
    active = facts.items.where("has_side_effects and item_type not in ('Import', 'FromImport')").select(*keys)
    live_items = facts.roles.where("role = 'defined'").join(alive, ["module", "name"], "left_semi").select(*keys)
    reads = facts.roles.where("role in ('read', 'eventual_read')").join(active.unionByName(live_items).distinct(), keys, "left_semi")
    roots = facts.attrs.join(active.unionByName(live_items).distinct(), keys, "left_semi").select("module", F.split("base", r"\.")[0].alias("local"))
    used = reads.select("module", F.col("name").alias("local")).unionByName(roots)
    used = used.unionByName(facts.listed.select("module", F.col("name").alias("local"))).unionByName(facts.roles.where("role = 'reexported'").select("module", F.col("name").alias("local")))
    used = used.unionByName(alive.select("module", F.col("name").alias("local"))).distinct()
    out = imported.join(used, ["module", "local"], "left_anti").join(protected.select("module").distinct(), "module", "left_anti")
    if kept is not None:
        out = out.join(kept.select(*keys).distinct(), keys, "left_anti")
    return out.select("module", "item_ord", "local")


def removable_statements(facts: Facts, trimmed: DataFrame) -> DataFrame:
    """(module, item_ord) of import statements all of whose names are trimmed."""
    imported = facts.roles.where("role = 'imported'").select("module", "item_ord", F.col("name").alias("local"))
    rows = imported.join(trimmed.withColumn("_gone", F.lit(True)), ["module", "item_ord", "local"], "left")
    return rows.groupBy("module", "item_ord").agg(F.bool_and(F.coalesce("_gone", F.lit(False))).alias("_all")).where("_all").select("module", "item_ord")


def unused_imports(facts: Facts, is_init: DataFrame) -> DataFrame:
    """(module, item_ord, local): never read in its module, without a side effect, not re-exported or listed, no star and not in a package init.

    What a function imports for itself is a local name there, so its uses are those of functions when they run.
    """
    imported = facts.roles.where("role = 'imported'").select("module", "item_ord", F.col("name").alias("local"))
    pure = facts.items.where("not has_side_effects").select("module", "item_ord")
    read = facts.roles.where("role in ('read', 'eventual_read')").select("module", F.col("name").alias("local"))
    scoped = facts.items.where("containing_scope is not null").select("module", "item_ord")
    locally = imported.join(scoped, ["module", "item_ord"], "left_semi").join(facts.used.select("module", F.col("name").alias("local")).distinct(), ["module", "local"], "left_semi")
    roots = facts.attrs.select("module", F.split("base", r"\.")[0].alias("local"))
    kept = read.unionByName(roots).unionByName(facts.roles.where("role = 'reexported'").select("module", F.col("name").alias("local"))).unionByName(facts.listed.select("module", F.col("name").alias("local"))).distinct()
    return imported.join(pure, ["module", "item_ord"], "left_semi").join(is_init.select("module"), "module", "left_anti").join(kept, ["module", "local"], "left_anti").join(locally, ["module", "item_ord", "local"], "left_anti")


def live_exports(facts: Facts, alive: DataFrame) -> DataFrame:
    """Listed names that are live."""
    return facts.listed.join(alive, ["module", "name"], "left_semi")

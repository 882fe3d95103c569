"""What kind of cycle a group of modules forms, and whether it can be broken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions import names

UNRESOLVABLE = "module-level constants need each other before either exists; move them to a module of their own"


def members_of(components: DataFrame) -> DataFrame:
    """(cycle_id, node) from scc(); cycle ids are the components' names."""
    return components.select(F.col("scc").alias("cycle_id"), "node")


def ordered_members(members: DataFrame) -> DataFrame:
    """(cycle_id, members, n): members by package depth, then name."""
    order = F.struct(F.size(F.split(F.col("node").cast("string"), r"\.")).alias("depth"), F.col("node").alias("node"))
    return members.groupBy("cycle_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["node"]).alias("members"), F.count(F.lit(1)).alias("n"))


def parent_child(members: DataFrame) -> DataFrame:
    """(cycle_id) of cycles in which a member is a proper dotted prefix of another."""
    under = members.select("cycle_id", F.explode(names.dotted_prefixes(F.col("node"))).alias("node"))
    return under.join(members, ["cycle_id", "node"], "left_semi").select("cycle_id").distinct()


def cycle_imports(members: DataFrame, bindings: DataFrame) -> DataFrame:
    """Names that a member imports from a member of its cycle. bindings: module, local, source (the absolute module)."""
    a = members.select("cycle_id", F.col("node").alias("module"))
    b = members.select("cycle_id", F.col("node").alias("source"))
    return bindings.join(a, "module").join(b, ["cycle_id", "source"], "left_semi").select("cycle_id", "module", "local")


def classify(members: DataFrame, items: DataFrame, reads: DataFrame, bindings: DataFrame) -> DataFrame:
    """(cycle_id, n, cycle_type, resolvable, reason).

    items: module, item_ord, item_type, containing_scope; reads: module, item_ord, name (read at once); bindings: module, local, source, absolute.
    In order: a package and its child, or imports only: FunctionLevel. Two members that read each other's names at module level:
    ModuleConstants. Classes: FunctionLevel if imports are used in definitions only, else ClassLevel. Without classes: FunctionLevel likewise, ImportTime
    where module-level imports or a package init take part, else FunctionLevel. Absolute names decide who is a member, also for relative imports.
    """
    own = members.select("cycle_id", F.col("node").alias("module"))
    in_cycle = cycle_imports(members, bindings)
    kinds = items.join(own, "module")
    imports = F.col("item_type").isin("Import", "FromImport")
    defs = F.col("item_type").isin("FunctionDef", "ClassDef")
    by_items = kinds.groupBy("cycle_id").agg(
        F.bool_and(imports).alias("imports_only"), F.bool_or(F.col("item_type") == "ClassDef").alias("classes"), F.bool_or(imports & F.col("containing_scope").isNull()).alias("module_imports")
    )
    at_once = items.where(~imports & ~defs & F.col("containing_scope").isNull()).select("module", "item_ord")
    used = reads.join(at_once, ["module", "item_ord"]).join(in_cycle.withColumnRenamed("local", "name"), ["module", "name"])
    assigned = used.join(items.where("item_type = 'Assignment'").select("module", "item_ord"), ["module", "item_ord"], "left_semi")
    both_ways = assigned.groupBy("cycle_id").agg(F.countDistinct("module").alias("_n")).where("_n >= 2").select("cycle_id", F.lit(True).alias("both_ways"))
    class_reads = reads.join(items.where("item_type = 'ClassDef'").select("module", "item_ord"), ["module", "item_ord"]).join(in_cycle.withColumnRenamed("local", "name"), ["module", "name"])
    outside = used.select("cycle_id").unionByName(class_reads.select("cycle_id")).distinct().withColumn("outside", F.lit(True))
    nested = parent_child(members).withColumn("nested", F.lit(True))
    shape = members.groupBy("cycle_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(names.is_init_name(F.col("node"))).alias("init"))
    rows = shape.join(by_items, "cycle_id", "left").join(both_ways, "cycle_id", "left").join(outside, "cycle_id", "left").join(nested, "cycle_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = (
        F.when(yes("nested") | F.coalesce("imports_only", F.lit(True)), "FunctionLevel").when(yes("both_ways"), "ModuleConstants")
        .when(yes("classes"), F.when(yes("outside"), "ClassLevel").otherwise("FunctionLevel"))
        .when(~yes("outside"), "FunctionLevel").when(yes("module_imports") | F.col("init"), "ImportTime").otherwise("FunctionLevel")
    )
    out = rows.select("cycle_id", "n", kind.alias("cycle_type"))
    fixed = F.col("cycle_type") != "ModuleConstants"
    return out.withColumn("resolvable", fixed).withColumn("reason", F.when(~fixed, F.lit(UNRESOLVABLE)))


def report(cycles: DataFrame, ordered: DataFrame) -> DataFrame:
    """One line for each cycle that cannot be resolved: what a fatal error lists."""
    rows = cycles.where(~F.col("resolvable")).join(ordered.select("cycle_id", "members"), "cycle_id")
    return rows.select("cycle_id", F.concat(F.lit("unresolvable cycle: "), F.array_join("members", " -> "), F.lit("; "), F.col("reason")).alias("message"))


def movable_imports(cycles: DataFrame, members: DataFrame, imports: DataFrame) -> DataFrame:
    """Imports that may move into functions: movable ones, in modules of function-level cycles, of a member or what lies under one.

    imports: module, import_ord, source (absolute), is_movable, level_of (ModuleLevel first in execution_contexts).
    """
    own = members.join(cycles.where("cycle_type = 'FunctionLevel'").select("cycle_id"), "cycle_id")
    rows = imports.join(own.select("cycle_id", F.col("node").alias("module")), "module")
    reach = rows.select("module", "import_ord", "cycle_id", "source", F.explode(F.concat(names.dotted_prefixes(F.col("source")), F.array("source"))).alias("node"))
    return reach.join(own, ["cycle_id", "node"], "left_semi").select("cycle_id", "module", "import_ord", "source").distinct()

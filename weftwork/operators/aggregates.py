"""Grouping, ranking and expansion over names: conflicts, renames, states, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions import names


def conflicts(rows: DataFrame, symbol: str, module: str) -> DataFrame:
    """(symbol, n_modules) of symbols that more than one module has."""
    return rows.select(symbol, module).distinct().groupBy(symbol).agg(F.count(F.lit(1)).alias("n_modules")).where("n_modules > 1")


def ordinal_renames(rows: DataFrame, symbol: str, module: str, order: Sequence[Column | str]) -> DataFrame:
    """(symbol, module, ordinal, new_name): conflicting symbols become symbol_1, symbol_2, ... in order, the first included."""
    each = rows.dropDuplicates([symbol, module])
    busy = each.join(conflicts(rows, symbol, module).select(symbol), symbol, "left_semi")
    ordinal = F.row_number().over(Window.partitionBy(symbol).orderBy(*order))
    return busy.select(symbol, module, ordinal.cast("long").alias("ordinal")).withColumn("new_name", F.concat_ws("_", F.col(symbol).cast("string"), F.col("ordinal").cast("string")))


def rename_map(symbols: DataFrame, renames: DataFrame, symbol: str, module: str) -> DataFrame:
    """Every symbol's name after renaming: its own where there is no conflict."""
    return symbols.select(symbol, module).distinct().join(renames.select(symbol, module, "new_name"), [symbol, module], "left").withColumn("new_name", F.coalesce("new_name", F.col(symbol).cast("string")))


def resolved_name(symbol: Column, renamed: Column, module: Column, clashes: Column) -> Column:
    """The rename if there is one; else with the module's name if it clashes with a global; else itself."""
    return F.coalesce(renamed, F.when(clashes, names.suffixed_name(symbol, module)).otherwise(symbol))


def variable_state(items: DataFrame, key: Sequence[str]) -> DataFrame:
    """Readers and writers of each variable in order, only those after its first declaration. items: key, ord, role in decl, read, write."""
    declared = items.where("role = 'decl'").groupBy(*key).agg(F.min("ord").alias("declared"))
    after = items.where("role in ('read', 'write')").join(declared, list(key)).where(F.col("ord") >= F.col("declared"))
    count = lambda role: F.count(F.when(F.col("role") == role, 1))
    used = after.groupBy(*key).agg(count("read").alias("n_readers"), count("write").alias("n_writers"), F.max("ord").alias("last_ord"))
    return declared.join(used, list(key), "left").fillna(0, ["n_readers", "n_writers"])


def any_flag(rows: DataFrame, key: Sequence[str], flag: Column, name: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.bool_or(flag).alias(name))


def export_lists(symbols: DataFrame, explicit: DataFrame, module: str = "module_id") -> DataFrame:
    """(module, exports): the explicit list where there is one, else the public names in order. explicit: module, names."""
    public = symbols.groupBy(module).agg(F.array_sort(F.collect_set(F.when(names.is_public(F.col("name"), "dunder"), F.col("name")))).alias("public"))
    return public.join(explicit.select(module, "names"), module, "full").select(module, F.coalesce("names", "public").alias("exports"))


def distinct_roots(imports: DataFrame, name: str = "name") -> DataFrame:
    """The distinct roots of dotted names: what a requirements list holds before packages are named."""
    return imports.select(F.split(name, r"\.")[0].alias("root")).distinct()


def requirements(roots: DataFrame, packages: DataFrame) -> DataFrame:
    """(package) of each root: its distribution's name where one is known, else its own; canonical, distinct. packages: root, package."""
    named = roots.join(packages, "root", "left")
    return named.select(names.package_name(F.coalesce("package", "root")).alias("package")).distinct()


def joined_lines(rows: DataFrame, value: str, name: str = "text") -> DataFrame:
    """One row: the distinct values in order, a line each. For lists that are small by nature, such as requirements."""
    return rows.agg(F.array_join(F.array_sort(F.collect_set(value)), "\n").alias(name))


def importers(imports: DataFrame, imported: str, importer: str) -> DataFrame:
    """(imported, n_importers, first_importer): who imports a module. Counts, so that no set of importers is gathered."""
    return imports.select(imported, importer).distinct().groupBy(imported).agg(F.count(F.lit(1)).alias("n_importers"), F.min(importer).alias("first_importer"))


def line_audit(texts: DataFrame, key: str, text: str, noise: Column | None = None) -> DataFrame:
    """(key, line, n, first_line, line_numbers): lines that a text has more than once. noise: a condition on `line` that is left out."""
    lines = texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("_at", "line")).withColumn("line", F.trim("line"))
    lines = lines.where(F.col("line") != "")
    if noise is not None:
        lines = lines.where(~noise)
    numbers = F.array_join(F.transform(F.array_sort(F.collect_list("_at")), lambda i: (i + 1).cast("string")), ",")  # the lines of one text
    return lines.groupBy(key, "line").agg(F.count(F.lit(1)).alias("n"), (F.min("_at") + 1).cast("long").alias("first_line"), numbers.alias("line_numbers")).where("n > 1")


def expand_wildcards(stars: DataFrame, exports: DataFrame, explicit: DataFrame) -> DataFrame:
    """(module, name): names that a star import brings, one hop, for modules without an explicit list. stars: module, target; exports: module, name; explicit: module."""
    open_stars = stars.join(explicit.select("module").distinct(), "module", "left_anti")
    own = exports.join(explicit.select("module").distinct(), "module", "left_anti").select("module", "name")
    brought = open_stars.join(exports.select(F.col("module").alias("target"), "name"), "target").select("module", "name")
    return own.unionByName(brought).distinct().unionByName(exports.join(explicit.select("module").distinct(), "module", "left_semi").select("module", "name"))


def child_aliases(modules: DataFrame, package: Column, defined: DataFrame) -> DataFrame:
    """(package, child): direct public children of a package that it does not define. modules: name; defined: package, child."""
    under = modules.where(F.col("name").startswith(F.concat(package, F.lit("."))))
    child = F.split(F.substr(F.col("name"), F.length(package) + 2), r"\.")[0]
    rows = under.select(package.alias("package"), child.alias("child")).where(names.is_public(F.col("child"))).distinct()
    return rows.join(defined, ["package", "child"], "left_anti")


def lifted_globals(variables: DataFrame, liftable: DataFrame, declared: DataFrame, prefix: str = "__global_") -> DataFrame:
    """(module, var, lifted): liftable variables (all variables of a module that has none) that functions declare global."""
    has = liftable.select("module").distinct()
    pool = liftable.select("module", "var").unionByName(variables.join(has, "module", "left_anti").select("module", "var"))
    both = pool.intersect(declared.select("module", "var"))
    return both.withColumn("lifted", F.concat(F.lit(prefix), names.identifier(F.col("module")), F.lit("_"), F.col("var")))


def precedence_merge(layers: DataFrame, *, collections: Sequence[str] = ()) -> DataFrame:
    """(key, value, layer) after layers are folded: the highest priority that sets a key wins; for collections an empty value does not override.

    layers: layer, priority, key, value (null: not set). A layer that leaves a key out never overrides it with a default.
    """
    counts = F.col("value").isNotNull() & ~(F.col("key").isin(*collections) & (F.col("value") == "")) if collections else F.col("value").isNotNull()
    top = layers.where(counts).groupBy("key").agg(F.max_by(F.struct("value", "layer"), "priority").alias("t"))
    return top.select("key", F.col("t.value").alias("value"), F.col("t.layer").alias("layer"))


def either(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def appended(a: Column, b: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(a, empty), F.coalesce(b, empty))


def assembled(parts: DataFrame, key: str, order: Sequence[str], text: str, between: str = "\n") -> DataFrame:
    """(key, text, n_parts): the parts of one output in order, joined."""
    own = F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda s: s[text])
    return parts.groupBy(key).agg(F.array_join(own, between).alias("text"), F.count(F.lit(1)).alias("n_parts"))


def statistics(rows: DataFrame, kind: str) -> DataFrame:
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))

"""Where a name comes from and who asks for it, across modules: equi-joins over the narrow tables, without a loop over modules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions import names
from weftwork.operators.resolve import flagged


def imported_elsewhere(symbols: DataFrame, imports: DataFrame, listed: DataFrame) -> DataFrame:
    """symbols (module, name) with imported: whether a module other than its own imports it, by name or by star.

    A star brings the listed names of a module that has a list, else the names without a leading underscore. imports: importer, source, original;
    listed: module, name.
    """
    others = imports.where(F.col("importer") != F.col("source"))
    asked = others.select(F.col("source").alias("module"), F.col("original").alias("name"))
    rows = flagged(symbols, ["module", "name"], {"_asked": asked, "_listed": listed})
    rows = flagged(rows, ["module"], {"_starred": asked.where("name = '*'"), "_has_list": listed})
    by_star = F.when(F.col("_has_list"), F.col("_listed")).otherwise(~F.col("name").startswith("_"))
    return rows.withColumn("imported", F.col("_asked") | (F.col("_starred") & by_star)).drop("_asked", "_listed", "_starred", "_has_list")


def wrapper_sources(asked: DataFrame, imports: DataFrame, wrappers: DataFrame) -> DataFrame:
    """asked (module, name) with source and original: the first from-import, by order, that binds the name to a wrapper module's symbol.

    imports: module, local, source, original, ord. Imports from other modules and stars are passed over; null where none is left.
    """
    rows = imports.where("original != '*'").join(wrappers.select(F.col("module").alias("source")).distinct(), "source", "left_semi")
    first = rows.groupBy("module", F.col("local").alias("name")).agg(F.min_by(F.struct("source", "original"), F.struct("ord", "source", "original")).alias("_s"))
    return asked.join(first, ["module", "name"], "left").withColumn("source", F.col("_s.source")).withColumn("original", F.col("_s.original")).drop("_s")


def list_accesses(attributes: DataFrame, aliases: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, accessed): modules that read another module's `__all__`, through the module's own alias for it or by its name.

    attributes: module, base, attr; aliases: module, local, source, ord; modules: module.
    """
    rows = attributes.where("attr = '__all__'").select("module", "base").distinct()
    by_alias = aliases.groupBy("module", F.col("local").alias("base")).agg(F.min_by("source", F.struct("ord", "source")).alias("_source"))
    met = rows.join(by_alias, ["module", "base"], "left").select("module", F.coalesce("_source", "base").alias("accessed"))
    return met.join(modules.select(F.col("module").alias("accessed")).distinct(), "accessed", "left_semi").select("module", "accessed").distinct()


def uses_import(asked: DataFrame, roles: DataFrame, deps: DataFrame) -> DataFrame:
    """asked (module, symbol, local) with uses: an item that defines the symbol reads the name, now or later, or lists it as what the symbol needs.

    roles: module, item_ord, role, name; deps: module, item_ord, symbol, dep.
    """
    items = roles.where("role = 'defined'").select("module", "item_ord", F.col("name").alias("symbol"))
    read = roles.where("role in ('read', 'eventual_read')").select("module", "item_ord", F.col("name").alias("local"))
    pairs = items.join(read, ["module", "item_ord"]).select("module", "symbol", "local")
    needed = deps.join(items, ["module", "item_ord", "symbol"], "left_semi").select("module", "symbol", F.col("dep").alias("local"))
    hit = pairs.unionByName(needed).distinct().withColumn("_hit", F.lit(True))
    return asked.join(hit, ["module", "symbol", "local"], "left").withColumn("uses", F.coalesce("_hit", F.lit(False))).drop("_hit")


def star_names(stars: DataFrame, listed: DataFrame, exports: DataFrame, renames: DataFrame, alive: DataFrame, wrapped: DataFrame) -> DataFrame:
    """(module, target, name, value, deferred): what `from target import *` binds where target is inlined.

    A target with an explicit list gives its listed names that are live in it, or live in a module below it that lists them too; all of them if the importer
    reads `__all__` or is a package. Without a list it gives the exported names that are live and whose value is not private. value: the name
    after renaming. deferred: the value comes from a wrapper module and is bound once that has run.
    stars: module, target, whole (the importer takes all listed names); listed and exports: module, name; renames: module, name, new_name;
    alive and wrapped: module, name.
    """
    named = ["target", "name"]
    of_target = lambda t, *more: t.select(F.col("module").alias("target"), "name", *more).distinct()
    own = of_target(listed)
    open_targets = listed.select(F.col("module").alias("target")).distinct()
    below = listed.join(alive, ["module", "name"], "left_semi").select(F.explode(names.dotted_prefixes(F.col("module"))).alias("target"), "name")
    kept = of_target(alive).unionByName(below).distinct().withColumn("_kept", F.lit(True))
    explicit = stars.join(own, "target").join(kept, named, "left").where(F.col("whole") | F.col("_kept")).drop("_kept")
    implicit = of_target(exports).join(open_targets, "target", "left_anti").join(of_target(alive), named, "left_semi")
    rows = explicit.withColumn("_open", F.lit(False)).unionByName(stars.join(implicit, "target").withColumn("_open", F.lit(True)))
    rows = rows.join(of_target(renames, "new_name"), named, "left").withColumn("value", F.coalesce("new_name", "name"))
    rows = rows.where(~F.col("_open") | ~F.col("value").startswith("_"))
    late = of_target(wrapped).withColumn("_late", F.lit(True))
    return rows.join(late, named, "left").select("module", "target", "name", "value", F.coalesce("_late", F.lit(False)).alias("deferred"))


def rename_rows(renames: DataFrame, listed: DataFrame, inlined: DataFrame, bundled: DataFrame) -> DataFrame:
    """(module, name, new_name): renamed symbols, and listed names of inlined modules under their own name; listed submodules are no symbols.

    renames: module, name, new_name; listed: module, name; inlined and bundled: module.
    """
    own = listed.join(inlined.select("module").distinct(), "module", "left_semi").select("module", "name").distinct()
    whole = own.withColumn("_path", F.concat_ws(".", "module", "name")).join(bundled.select(F.col("module").alias("_path")).distinct(), "_path", "left_anti")
    same = whole.join(renames, ["module", "name"], "left_anti").select("module", "name", F.col("name").alias("new_name"))
    return renames.select("module", "name", "new_name").unionByName(same)


def missing_first_party(imports: DataFrame, known: DataFrame) -> DataFrame:
    """(module, name, message) of first-party imports that no module answers and no try or with tolerates: each is fatal.

    imports: module, name (absolute), category, tolerated; known: name.
    """
    gone = imports.where("category = 'FirstParty' and not tolerated").join(known.select("name").distinct(), "name", "left_anti")
    return gone.select("module", "name").distinct().withColumn("message", F.concat(F.lit("no module named "), F.col("name")))


def search_directories(dirs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, dir, priority): directories in canonical form, each at its first place. dirs: keys, dir, priority."""
    return dirs.withColumn("dir", names.canonical_path(F.col("dir"))).groupBy(*keys, "dir").agg(F.min("priority").alias("priority"))


def module_parts(files: DataFrame, dirs: DataFrame, extension: str = ".py") -> DataFrame:
    """files (path) with dir and parts: the name of a file as seen from the first search directory, by priority, that it lies under.

    dirs: dir, priority, canonical. Null where no directory holds the file; `__init__` and `__main__` add no part. Directories above a file are exploded and
    meet the search directories by an equi-join.
    """
    own = files.select("path").distinct().withColumn("_path", names.canonical_path(F.col("path")))
    parts = F.split("_path", "/")
    # From the root (or the working directory) down to the file's own folder.
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = F.transform(above, lambda d: F.when(d != "", d).when(F.col("_path").startswith("/"), "/").when(~F.col("_path").startswith(".."), "."))
    met = own.select("path", "_path", F.explode(F.array_distinct(above)).alias("dir")).join(dirs.select("dir", "priority"), "dir")
    first = met.groupBy("path", "_path").agg(F.min_by("dir", F.struct("priority", "dir")).alias("dir"))
    lead = F.when(F.col("dir") == ".", 0).when(F.col("dir") == "/", 1).otherwise(F.length("dir") + 1)
    name = names.module_name(F.substr(F.col("_path"), lead + 1), extension)
    return files.join(first.select("path", "dir", F.coalesce(F.split(name, r"\."), F.array().cast("array<string>")).alias("parts")), "path", "left")

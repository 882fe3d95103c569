"""Lookups and ordered cascades: the first candidate by priority wins, never an arbitrary one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions import names


def first_match(candidates: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row of each key: the first in the order. A row_number limit, which Spark applies before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return candidates.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def first_of(rows: DataFrame, keys: Sequence[str], value: Column, order: Column, name: str = "value") -> DataFrame:
    """As first_match for one value, by an aggregate that combines before the shuffle: for large groups."""
    return rows.groupBy(*keys).agg(F.min_by(value, order).alias(name))


def last_wins(rows: DataFrame, keys: Sequence[str], value: Column, order: Column, name: str = "value") -> DataFrame:
    """The value with the greatest order of each key: a later assignment overrides an earlier one."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(name))


def lookup(rows: DataFrame, table: DataFrame, on: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """rows with columns of table (unique in `on`), null where there is no entry."""
    side = table.select(*on, *(F.col(c).alias(a) for c, a in columns.items()))
    return rows.join(side, list(on), "left")


def coalesced(rows: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str], str]], name: str) -> DataFrame:
    """The first table with an entry decides: (table, keys, value column), in order. Each is a left equi-join."""
    out, found = rows, []
    for i, (table, on, value) in enumerate(tables):
        out = lookup(out, table, on, {value: f"_v{i}"})
        found.append(F.col(f"_v{i}"))
    return out.withColumn(name, F.coalesce(*found)).drop(*(f"_v{i}" for i in range(len(tables))))


def cascade(cases: Sequence[tuple[Column, str]], default: str) -> Column:
    """The label of the first condition that holds. A null condition does not hold."""
    out = F
    for condition, label in cases:
        out = out.when(condition, F.lit(label))
    return out.otherwise(F.lit(default))


def resolve_modules(requests: DataFrame, search_dirs: DataFrame, files: DataFrame, *, file_first: bool = False) -> DataFrame:
    """(name, path, kind, dir) of each requested dotted name: the first search directory that has it.

    In one directory a package comes before a module file and that before a namespace directory; file_first, for
    literal dynamic imports, puts the module file first. requests: name; search_dirs: dir, priority; files: path. Packages on the
    way must exist as directories of some file. Candidates meet files by an equi-join on the path.
    """
    stem = F.replace(F.col("name"), F.lit("."), F.lit("/"))
    kinds = [("PackageInit", "/__init__.py"), ("RegularModule", ".py"), ("NamespacePackageDir", "/")]
    order = {k: i for i, (k, _) in enumerate([kinds[1], kinds[0], kinds[2]] if file_first else kinds)}
    named = requests.select("name").distinct().withColumn("_one", F.lit(1))
    dirs = search_dirs.select("dir", "priority").withColumn("_one", F.lit(1))  # a handful of rows
    spread = named.join(F.broadcast(dirs), "_one").drop("_one")
    options = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(order[k]).alias("by_kind"), F.concat("dir", F.lit("/"), stem, F.lit(tail)).alias("path")) for k, tail in kinds]))
    wanted = spread.select("name", "dir", "priority", options.alias("o")).select("name", "dir", "priority", "o.*")
    path = F.col("path")
    folder = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(folder) - 1), lambda i: F.concat(F.array_join(F.slice(folder, F.lit(1), i), "/"), F.lit("/")))
    places = files.select("path").unionByName(files.select(F.explode(above).alias("path"))).distinct()
    return first_match(wanted.join(places, "path"), ["name"], ["priority", "by_kind"]).select("name", "path", "kind", "dir")


def dedup_identity(rows: DataFrame, identity: Sequence[str], order: Column, key: str) -> DataFrame:
    """rows with primary (the key of the first row of the same identity) and is_primary: one thing, however many names."""
    first = rows.groupBy(*identity).agg(F.min_by(key, order).alias("primary"))
    return rows.join(first, list(identity)).withColumn("is_primary", F.col(key) == F.col("primary"))


def prefix_members(rows: DataFrame, name: str, members: DataFrame, member: str) -> DataFrame:
    """Semi-join: rows whose name equals a member or lies under one (a.b lies under a). By exploded prefixes, not LIKE."""
    reach = F.explode(F.concat(names.dotted_prefixes(F.col(name)), F.array(name)))
    side = members.select(F.col(member).alias("_m")).distinct()
    hit = rows.select(name, reach.alias("_m")).join(side, "_m").select(name).distinct()
    return rows.join(hit, name, "left_semi")


def prefix_first(requests: DataFrame, base: str, attribute: str, definitions: DataFrame) -> DataFrame:
    """The first module by rank under `base` that defines the attribute. definitions: module, name, rank."""
    under = definitions.select(F.explode(names.dotted_prefixes(F.col("module"))).alias(base), F.col("name").alias(attribute), "module", "rank")
    first = under.groupBy(base, attribute).agg(F.min_by("module", "rank").alias("module"))
    return requests.join(first, [base, attribute], "left")


def equal_sets(rows: DataFrame, key: str, member: str) -> DataFrame:
    """(key, first_key, n_keys): keys whose member sets are equal, in whatever order; first_key is the smallest of them."""
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("members"))
    classes = sets.groupBy("members").agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("n_keys"))
    return sets.join(classes, "members").select(key, "first_key", "n_keys")


def unused(declared: DataFrame, used: DataFrame, on: Sequence[str]) -> DataFrame:
    return declared.join(used.select(*on).distinct(), list(on), "left_anti")


def flagged(rows: DataFrame, on: Sequence[str], sides: dict[str, DataFrame]) -> DataFrame:
    """A boolean column for each side: whether it has the row's key. Sides are made distinct, so rows do not multiply."""
    out = rows
    for name, side in sides.items():
        out = out.join(side.select(*on).distinct().withColumn(name, F.lit(True)), list(on), "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


# --- decisions about imports, modules and symbols -----------------------------------------------


def classify_imports(imports: DataFrame, *, known_first: Sequence[str] = (), known_third: Sequence[str] = (), stdlib: DataFrame, first_party: DataFrame, installed: DataFrame) -> DataFrame:
    """imports (name, level) with root and category: FirstParty, ThirdParty or StandardLibrary.

    In order: relative; named first-party; named third-party; standard library (the name or its root); resolvable; a dotted name
    whose root resolves to a module file (first-party: the error comes later) or to a package without the child (third-party);
    installed packages; else third-party. stdlib: name; first_party: name, is_package; installed: name.
    """
    rows = imports.withColumn("root", F.split("name", r"\.")[0])
    s = stdlib.select("name").distinct()
    own = first_party.groupBy("name").agg(F.max("is_package").alias("is_package"))
    rows = flagged(rows, ["name"], {"_std": s, "_own": own})
    rows = rows.join(s.select(F.col("name").alias("root"), F.lit(True).alias("_std_root")), "root", "left")
    rows = rows.join(own.select(F.col("name").alias("root"), F.col("is_package").alias("_package")), "root", "left")
    rows = rows.join(installed.select(F.col("name").alias("root"), F.lit(True).alias("_installed")).distinct(), "root", "left")
    dotted = F.col("name").contains(".")
    under = lambda known: F.coalesce(F.col("root").isin(*known) | F.col("name").isin(*known), F.lit(False)) if known else F.lit(False)
    category = cascade(
        [
            (F.col("level") > 0, "FirstParty"), (under(known_first), "FirstParty"), (under(known_third), "ThirdParty"), (F.col("_std") | F.col("_std_root"), "StandardLibrary"),
            (F.col("_own"), "FirstParty"), (dotted & ~F.col("_package"), "FirstParty"), (dotted & F.col("_package"), "ThirdParty"), (F.col("_installed"), "ThirdParty"),
        ],
        "ThirdParty",
    )
    return rows.withColumn("category", category).drop("_std", "_own", "_std_root", "_package", "_installed")


def import_side_effects(name: Column, level: Column, is_star: Column, root_is_std: Column) -> Column:
    """Standard-library imports are pure, other named modules are not; `from . import x` only is if not a star."""
    return F.when((level > 0) & (F.coalesce(name, F.lit("")) == ""), is_star).when(root_is_std, F.lit(False)).otherwise(F.lit(True))


def tolerated(scope_path: Column) -> Column:
    """An import that may be missing: inside a try or a with, at any depth (also under an if)."""
    return F.exists(scope_path, lambda s: s.isin("Try", "With"))


def bundle_kind(side_effects: Column, is_identifier: Column, in_cycle: Column, is_entry: Column) -> Column:
    return cascade([(is_entry, "entry"), (side_effects | ~is_identifier | in_cycle, "wrapper")], "inline")


def should_inline(flags: dict[str, Column]) -> Column:
    """Ordered: imported by a wrapper; imported for type checking; explicit list without it; live; listed; liveness off and listed; else no."""
    f = flags
    return (
        F.when(f["imported_by_wrapper"] | f["type_checking"], True).when(f["has_list"] & ~f["listed"], False).when(f["live"] | f["listed"], True).otherwise(False)
    )


def should_export(name: Column, flags: dict[str, Column]) -> Column:
    """Ordered: __all__ never; listed outside wrappers if live; not live is not; live is; else private names need an importer and public ones none."""
    f = flags
    return (
        F.when(name == "__all__", False).when(f["listed"] & ~f["wrapper"], f["live"]).when(~f["live"], False).when(f["liveness_on"], True)
        .when(~names.is_public(name), f["imported_elsewhere"]).otherwise(True)
    )


def dynamic_exports(reads: DataFrame) -> DataFrame:
    """(module_id, dynamic): modules that read setattr, locals or globals, and __all__. reads: module_id, name."""
    has = lambda *n: F.bool_or(F.col("name").isin(*n))
    return reads.groupBy("module_id").agg((has("setattr") & has("locals", "globals") & has("__all__")).alias("dynamic"))

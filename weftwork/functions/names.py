"""Scalar expressions over module names, paths and identifiers. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

import keyword

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPECIAL = ("__init__", "__main__")
INIT = "__init__"
#: Target versions by name.
VERSIONS = {f"py3{minor}": minor for minor in range(8, 14)}


def line_ends(source: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(source, "\r\n?", "\n")


def module_name(path: Column, extension: str = ".py", special: tuple[str, ...] = SPECIAL) -> Column:
    """a/b/c.py is a.b.c and a/b/__init__.py is a.b; null if nothing is left."""
    bare = F.regexp_replace(path, extension.replace(".", r"\.") + "$", "")
    bare = F.regexp_replace(bare, f"(^|/)({'|'.join(special)})$", "")
    return F.nullif(F.replace(bare, F.lit("/"), F.lit(".")), F.lit(""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_init(path: Column, extension: str = ".py") -> Column:
    return file_name(path) == INIT + extension


def is_main(path: Column, extension: str = ".py") -> Column:
    return file_name(path) == "__main__" + extension


def is_special(path: Column, extension: str = ".py") -> Column:
    return is_init(path, extension) | is_main(path, extension)


def module_kind(path: Column, extension: str = ".py") -> Column:
    """One of four kinds, by file name; a path without the extension is a directory without an init file."""
    return F.when(is_init(path, extension), "PackageInit").when(is_main(path, extension), "Main").when(path.endswith(extension), "RegularModule").otherwise("NamespacePackageDir")


def is_init_name(name: Column) -> Column:
    return name.rlike(r"(^|\.)__init__$")


def level_of(descriptor: Column) -> Column:
    """Leading dots of an import descriptor such as ..a.b."""
    return (F.length(descriptor) - F.length(F.ltrim(descriptor, F.lit(".")))).cast("int")


def parts_of(descriptor: Column) -> Column:
    """The parts after the leading dots; empty parts are dropped."""
    return F.filter(F.split(descriptor, r"\."), lambda p: p != "")


def absolute_name(own: Column, is_package: Column, level: Column, rest: Column) -> Column:
    """A relative import seen from module `own` (dotted) as an absolute name; null above the root.

    A package stands for its own first level. rest: array of parts after the dots. Level 0 is absolute already.
    """
    parts = F.filter(F.split(own, r"\."), lambda p: p != "")
    up = level - F.when(is_package, 1).otherwise(0)
    kept = F.size(parts) - up
    base = F.when(kept > 0, F.slice(parts, F.lit(1), F.greatest(kept, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    full = F.nullif(F.array_join(F.concat(base, rest), "."), F.lit(""))
    return F.when(level == 0, F.nullif(F.array_join(rest, "."), F.lit(""))).when(kept >= 0, full)


def registry_name(own: Column, is_package: Column, level: Column, rest: Column) -> Column:
    """As absolute_name where only names are known: a null is_package (a name the registry lacks) is a package if it has one part. Levels past the root stop there."""
    parts = F.split(own, r"\.")
    package = F.coalesce(is_package, F.size(parts) == 1)
    up = F.when(package | (F.size(parts) == 1), 0).otherwise(1) + F.greatest(level - 1, F.lit(0))
    return F.array_join(F.concat(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))), rest), ".")


def stripped_name(own: Column, level: Column, rest: Column) -> Column:
    """The name that a relative import has if packages are not told from modules: `level` parts go, whatever the module is."""
    parts = F.split(own, r"\.")
    return F.array_join(F.concat(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level, F.lit(0))), rest), ".")


def canonical_path(path: Column) -> Column:
    """a//b/./c/../d/ is a/b/d; what is left of nothing is `.`, or `/` if the path is absolute. Links are not followed."""
    empty = F.array().cast("array<string>")
    up = lambda done: F.when(F.element_at(F.concat(F.array(F.lit("..")), done), -1) != "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
    above = lambda done: F.when(path.startswith("/"), done).otherwise(F.concat(done, F.array(F.lit(".."))))
    step = lambda done, p: F.when(p.isin("", "."), done).when(p == "..", F.coalesce(up(done), above(done))).otherwise(F.concat(done, F.array(p)))
    bare = F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), bare)).otherwise(F.coalesce(F.nullif(bare, F.lit("")), F.when(path.isNotNull(), ".")))


def dotted_prefixes(name: Column) -> Column:
    """a.b.c has the proper prefixes a and a.b."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).otherwise(F.array().cast("array<string>"))


def identifier(name: Column) -> Column:
    """A valid identifier: others than letters and digits become _, a leading digit gets one before it, a keyword one after it."""
    plain = F.regexp_replace(name, r"[^\p{IsAlphabetic}\p{N}]", "_")
    plain = F.when(plain.rlike("^[0-9]"), F.concat(F.lit("_"), plain)).otherwise(plain)
    return F.when(plain.isin(*keyword.kwlist), F.concat(plain, F.lit("_"))).otherwise(plain)


def content_hash(source: Column) -> Column:
    return F.sha2(source, 256)


def synthetic_name(name: Column, source: Column, prefix: str = "__module_") -> Column:
    """A name that tells apart modules of the same name by six digits of their content's hash."""
    return F.concat(F.lit(prefix), F.substring(content_hash(source), 1, 6), F.lit("_"), identifier(name))


def suffixed_name(name: Column, module: Column) -> Column:
    return F.concat(name, F.lit("_"), identifier(module))


def is_constant(name: Column) -> Column:
    """Upper-case letters, digits and _, with at least one letter."""
    return name.rlike("^[A-Z0-9_]*[A-Z][A-Z0-9_]*$")


def is_public(name: Column, variant: str = "strict") -> Column:
    """strict: no leading _; double: names with two of them count as public; dunder: __x__ counts as public."""
    strict = ~name.startswith("_")
    if variant == "strict":
        return strict
    if variant == "double":
        return strict | name.startswith("__")
    if variant == "dunder":
        return strict | (name.startswith("__") & name.endswith("__") & (F.length(name) > 4))
    raise ValueError(variant)


def package_name(name: Column) -> Column:
    """The canonical form of a distribution's name."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def minor_version(target: Column, strict: bool = True) -> Column:
    """py38 to py313 as 8 to 13; anything else is an error, or null if not strict."""
    known = F.create_map(*[F.lit(x) for pair in VERSIONS.items() for x in pair])
    found = F.element_at(known, target)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown target version: "), target)).cast("int")) if strict else found


def lenient_boolean(value: Column) -> Column:
    """true, 1, yes, on and false, 0, no, off in any case; else null."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "1", "yes", "on"), True).when(v.isin("false", "0", "no", "off"), False)


FALLBACK = "__renamed_"


def unique_names(wanted: DataFrame, taken: DataFrame, most: int = 999) -> DataFrame:
    """(base, name): base itself where it is free in taken (name), else the first free of base_1 ... base_most, else the base after FALLBACK.

    One equi-join: a taken name meets its base with its number, and the smallest number that is missing is free.
    """
    bases = wanted.select("base").distinct()
    number = F.regexp_extract("name", r"_([1-9][0-9]*)$", 1)
    used = taken.select("name").distinct()
    numbered = used.where(number != "").select(F.regexp_replace("name", r"_[1-9][0-9]*$", "").alias("base"), number.cast("int").alias("n"))
    plain = used.select(F.col("name").alias("base"), F.lit(0).alias("n"))
    held = bases.join(numbered.unionByName(plain), "base", "left").groupBy("base").agg(F.array_sort(F.collect_set("n")).alias("ns"))
    free = F.array_min(F.array_except(F.sequence(F.lit(0), F.least(F.size("ns"), F.lit(most))), F.col("ns")))
    return held.select("base", F.when(free == 0, F.col("base")).when(free.isNotNull(), F.concat("base", F.lit("_"), free.cast("string"))).otherwise(F.concat(F.lit(FALLBACK), "base")).alias("name"))

"""Where source files, packages and settings come from, and where bundles go."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import names
from weftwork.operators.aggregates import joined_lines
from weftwork.operators.resolve import first_match

#: How a virtual environment is called by custom, in the order in which names are tried.
ENVIRONMENTS = (".venv", "venv", "env", ".virtualenv", "virtualenv")
#: Settings of a bundle: key and default.
DEFAULTS = {"src": "", "known_first_party": "", "known_third_party": "", "preserve_comments": "true", "preserve_type_hints": "true", "target_version": "py310"}
COLLECTIONS = ("src", "known_first_party", "known_third_party")


#: Files whose names Spark's readers hide (they begin with _); the driver reads so many at most. Larger corpora come as tables of (path, source).
MOST_HIDDEN = 20_000


def _hidden_files(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(full path, source) of the .py files under root that begin with _: Spark's readers leave them out, and __init__.py is one of them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(conf)
    found, files = [], system.listFiles(place, True)
    while files.hasNext():
        path = files.next().getPath()
        if path.getName().startswith("_") and path.getName().endswith(".py"):
            if len(found) >= MOST_HIDDEN:
                raise ValueError(f"more than {MOST_HIDDEN} package files: read the corpus from a table")
            stream = system.open(path)
            try:
                found.append((path.toString(), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return found


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, source, content_hash) of every .py file under root; path is relative to it, line ends are LF. One row a file; any file system."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root)
    where = files.select(F.col("value").alias("source"), F.col("_metadata.file_path").alias("_full"))
    where = where.unionByName(spark.createDataFrame(_hidden_files(spark, root), "_full string, source string"))
    base = root.rstrip("/").split("://", 1)[-1].lstrip("/")
    path = F.regexp_replace("_full", "^.*?" + "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in base) + "/", "")
    source = names.line_ends(F.col("source"))
    return where.select(path.alias("path"), source.alias("source")).withColumn("content_hash", names.content_hash(F.col("source")))


def distinct_sources(files: DataFrame) -> DataFrame:
    """One row of each path, so that a file is parsed once however often it was found."""
    return first_match(files, ["path"], ["source"])


def entry_file(files: DataFrame, directory: str = "") -> DataFrame:
    """The file that an entry directory stands for: its __init__.py, else its __main__.py; no row if it has neither."""
    base = f"{directory.rstrip('/')}/" if directory else ""
    order = {f"{base}__init__.py": 0, f"{base}__main__.py": 1}
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in order.items() for x in pair]), F.col("path"))
    rows = files.where(F.col("path").isin(*order)).withColumn("_one", F.lit(1)).withColumn("_order", rank)
    return first_match(rows, ["_one"], ["_order"]).drop("_one", "_order")


def installed_packages(paths: DataFrame) -> DataFrame:
    """(name) of the importable entries among paths of a site-packages folder: directories and .py files, but none that starts with _ or ends with -info. paths: path, relative."""
    top = F.split("path", "/")[0]
    name = F.regexp_replace(top, r"\.py$", "")
    rows = paths.select(top.alias("top"), name.alias("name"), (F.size(F.split("path", "/")) > 1).alias("folder"))
    return rows.where((F.col("folder") | F.col("top").endswith(".py")) & ~F.col("name").startswith("_") & ~F.col("top").endswith("-info")).select("name").distinct()


def environment_roots(environ: Mapping[str, str] | None = None, start: str = ".") -> list[str]:
    """The active virtual environment, or else those of the customary names that look like one."""
    environ = os.environ if environ is None else environ
    if environ.get("VIRTUAL_ENV"):
        return [environ["VIRTUAL_ENV"]]
    found = [Path(start) / n for n in ENVIRONMENTS]
    return [str(p) for p in found if any((p / sub).is_dir() for sub in ("bin", "Scripts", "lib"))]


def distribution_names(records: DataFrame, metadata: DataFrame) -> DataFrame:
    """(root, package): which distribution an import root belongs to. records: dist, line (of RECORD); metadata: dist, line (of METADATA)."""
    path = F.split("line", ",")[0]
    root = F.regexp_replace(F.split(path, "/")[0], r"\.py$", "")
    roots = records.where(path.endswith(".py")).select("dist", root.alias("root")).where(~F.col("root").endswith("-info")).distinct()
    named = metadata.where(F.col("line").startswith("Name:")).groupBy("dist").agg(F.min(F.trim(F.substring("line", 6, 1000))).alias("package"))
    return roots.join(named, "dist").groupBy("root").agg(F.min("package").alias("package"))


# --- settings ----------------------------------------------------------------------------------


def _flat(value: object) -> str:
    return ",".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value).lower() if isinstance(value, bool) else str(value)


def toml_layer(path: str, layer: str, priority: int) -> list[tuple[str, int, str, str]]:
    """(layer, priority, key, value) of a file; only keys that it sets. An unknown key or version is an error."""
    with open(path, "rb") as f:
        found = tomllib.load(f)
    found = {k.replace("-", "_"): v for k, v in found.items()}
    if unknown := set(found) - set(DEFAULTS):
        raise ValueError(f"unknown settings in {path}: {sorted(unknown)}")
    if "target_version" in found and found["target_version"] not in names.VERSIONS:
        raise ValueError(f"unknown target version: {found['target_version']}")
    return [(layer, priority, k, _flat(v)) for k, v in found.items()]


def environment_layer(environ: Mapping[str, str], prefix: str, priority: int) -> list[tuple[str, int, str, str]]:
    """Settings from prefixed variables; lists are comma-separated, booleans lenient. A boolean that is none is left out."""
    yes, no = {"true", "1", "yes", "on"}, {"false", "0", "no", "off"}
    out = []
    for key, default in DEFAULTS.items():
        value = environ.get(prefix + key.upper())
        if value is None:
            continue
        if default in ("true", "false"):
            v = value.strip().lower()
            value = "true" if v in yes else "false" if v in no else None
        elif key in COLLECTIONS:
            value = ",".join(x.strip() for x in value.split(",") if x.strip())
        if value is not None:
            out.append(("environment", priority, key, value))
    return out


def config_paths(system: str, home: str, platform: str = "linux", name: str = "weftwork") -> dict[str, list[str]]:
    """Where a system's and a user's settings are looked for."""
    if platform.startswith("win"):
        return {"system": [f"{system}\\{name}\\{name}.toml"], "user": [f"{home}\\AppData\\Roaming\\{name}\\{name}.toml"]}
    dirs = [d for d in (system or "/etc/xdg").split(":") if d]
    return {"system": [f"{d}/{name}/{name}.toml" for d in dirs] + [f"/etc/{name}/{name}.toml"], "user": [f"{home}/.config/{name}/{name}.toml"]}


def config_layers(spark: SparkSession, layers: Sequence[tuple[str, int, str, str]]) -> DataFrame:
    """The layers as a table, with the defaults below them."""
    rows = [("default", 0, k, v) for k, v in DEFAULTS.items()] + list(layers)
    return spark.createDataFrame(rows, "layer string, priority int, key string, value string")


def output_choice(output: str | None, stdout: bool) -> str:
    """Either a file or the standard output, and one of them."""
    if bool(output) == stdout:
        raise ValueError("name either an output file or the standard output")
    return output or "-"


# --- sinks -------------------------------------------------------------------------------------


def write_bundle(bundle: DataFrame, path: str) -> None:
    """One text file of a bundle: one row by nature."""
    bundle.select("text").coalesce(1).write.mode("overwrite").text(path)


def bundle_text(bundle: DataFrame) -> str:
    return bundle.select("text").first()[0]


def write_requirements(packages: DataFrame, path: str) -> bool:
    """The list of packages as text; nothing is written if it is empty."""
    text = joined_lines(packages, "package").first()[0]
    if not text:
        return False
    packages.sparkSession.createDataFrame([(text,)], "text string").coalesce(1).write.mode("overwrite").text(path)
    return True

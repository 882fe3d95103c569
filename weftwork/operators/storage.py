"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Paths written inside each open scratch(), the innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of its own on a local master, and an error on any other."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='weftwork-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, written once as a table in the shared folder and read back: lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/weftwork/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _open:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """stored(df), and its number of rows n and further aggregates, taken while it is written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n"), *(m.alias(k) for k, m in measures.items())))
    return out, seen.get


def settle(df: DataFrame) -> None:
    """Lets the driver drop what it no longer refers to, so that Spark removes the shuffle files of finished steps.

    The driver holds on to the last job it ran, so a small one takes its place first.
    """
    df.sparkSession.range(1).repartition(1).count()
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of stored() that no later step reads."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/weftwork/" in path:
                _delete(table.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end every table stored inside but those whose paths were taken off the list that it gives."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield paths
    finally:
        _open.pop()
        for path in paths:
            _delete(spark, path)


def kept_from(paths: list[str], df: DataFrame) -> DataFrame:
    """df, a stored table, written inside a scratch() that is to leave it."""
    own = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}
    paths[:] = [p for p in paths if p.rsplit("/", 1)[-1] not in own]
    return df

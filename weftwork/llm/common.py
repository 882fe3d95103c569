"""What several operators share: tables that cut lineage, exact global ranks, batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.operators.storage import dropped, kept_from, measured, scratch, settle, shared_dir, stored

__all__ = ["dropped", "kept_from", "measured", "scratch", "settle", "shared_dir", "stored"]

WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def n_words(text: str = "text"):
    """Words between spaces and control gaps; null counts 0. Runs JVM-side."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the exact 0-based rank of each row in a total order without one task seeing all rows.

    Rows are range-partitioned and numbered inside their range; the ranges' sizes
    (one row a partition) give the offsets. The table is stored between, so that
    both uses see the same ranges.
    """
    part = "_range"
    cut = stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = cut.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = sizes.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return cut.withColumn("_local", local).join(offsets, part).withColumn(name, (F.col("_local") + F.col("_before")).cast("long")).drop(part, "_local", "_before")


def clear_of(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast to what the operator takes. Extra columns, whatever their names, stay out of its joins."""
    return df.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()))


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most `most` bytes of the column each; a longer row goes alone."""
    at = batch.schema.get_field_index(column)
    lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


DOCUMENT_COLUMNS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

"""Helpers shared by the corpus operators: readers, column guards, scratch tables."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import read_columns, read_table

__all__ = ["SPACE", "WORD", "column", "crc_mod", "free_names", "read_columns", "read_table", "release", "save", "text_batches"]

#: Word and white space of the text contracts (ASCII white space only).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def column(df: DataFrame, name: str) -> Column:
    """A top-level column by its exact name, dots and back-ticks included."""
    return df["`" + name.replace("`", "``") + "`"]


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the session's shared checkpoint folder and read it
    back: lineage ends here and survives lost executors."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def release(*saved: DataFrame) -> None:
    """Delete tables that ``save`` wrote. Only for those that nothing reads any more:
    whatever was computed from them must be written itself."""
    for df in saved:
        spark, path = df.sparkSession, df._saved_at
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that do not occur in ``df`` (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _trim() -> None:
    """Give freed memory back to the system, where the C library can: workers live on
    between tasks and stages, and share their executor's limit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_batches(batches: Iterator[pa.RecordBatch], text: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one piece holds about ``chars`` bytes of the
    column ``text`` (a single longer text is a piece of its own)."""
    _trim()  # what the task before has left
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > chars:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)
    _trim()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""What the operators of this subpackage share: tables, staging in the shared folder, Arrow passes over texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word rule ``[^\x20\x09-\x0D]+``; as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters of text that a Python worker turns into numpy arrays at once.
SLAB_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, one of our own on one machine
    (tests), and an error on a cluster, whose executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm_dir.get() if jvm_dir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="runtrail-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text is divisible by ``folds``; false for a null id (never learned from either)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def may_learn(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds != 0, F.lit(False))


def arrow_columns(df: DataFrame, fn: Callable[[list[str | None]], dict[str, pa.Array]], text_col: str, outputs: list[tuple[str, T.DataType]], keep: list[str] | None = None) -> DataFrame:
    """Add ``outputs`` computed from ``text_col`` batch by batch; ``keep`` (default: all) names the columns passed through.

    An output replaces an input column of the same name.
    """
    names = [n for n, _ in outputs]
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t, True) for n, t in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list[pa.Array]] = {n: [] for n in names}
            column = batch.column(batch.schema.get_field_index(text_col))
            for lo, hi in spans_of(column):
                got = fn(column.slice(lo, hi - lo).to_pylist())
                for n in names:
                    made[n].append(got[n])
            if batch.num_rows:
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.concat_arrays(made[n]) for n in names]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return df.select(*{c: None for c in [*keep, text_col]}).mapInArrow(run, schema)


def spans_of(column: pa.Array, chars: int = SLAB_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``chars`` bytes of text each (one row at least), so that a worker's memory stays bounded."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + chars, side="right")))
        yield lo, hi
        lo = hi

"""Session helpers: the folder that driver and executors share, tables staged there."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a folder of our own on one machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not own.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="runtrail-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get()
    return found.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_INGESTED: dict[tuple[str, ...], str] = {}


def source_state(spark: SparkSession, path: str) -> str:
    """What tells one state of the files at a path from another: their names, sizes and times. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    found = files.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0)).alias("h")).first()
    return f"{found['n']}-{found['h'] & (2**64 - 1):016x}"


def ingested(spark: SparkSession, label: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table made once per application and state of its source, kept as Parquet in the shared folder."""
    key = (spark.sparkContext.applicationId, label, source, source_state(spark, source))
    if key not in _INGESTED:
        path = f"{shared_dir(spark)}/{label}-{hashlib.sha256(repr(key).encode()).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}"
        make().write.parquet(path)
        _INGESTED[key] = path
    return spark.read.parquet(_INGESTED[key])

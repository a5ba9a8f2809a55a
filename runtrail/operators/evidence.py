"""Evidence: which recorded run belongs to which sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bound(pairs: DataFrame, recorded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with ``binding``, rejects with ``reason``) of asked pairs (.., run_id, sha256) and the digests that runs record.

    ``recorded``: (run_id, sha256), several to a run. A run that records the sample's digest is bound, one that records none is
    unbound, one that records others only is an evidence mismatch and rejected.
    """
    known = recorded.select("run_id", F.lower("sha256").alias("__digest")).where("__digest is not null").distinct()
    own = pairs.withColumn("__digest", F.lower("sha256"))
    met = own.join(known.withColumn("__met", F.lit(True)), ["run_id", "__digest"], "left")
    judged = met.join(known.select("run_id").distinct().withColumn("__any", F.lit(True)), "run_id", "left")
    judged = judged.withColumn("binding", F.when(F.col("__met"), "bound").when(F.col("__any").isNull(), "unbound").otherwise("mismatch"))
    kept = [*pairs.columns, "binding"]
    return judged.where("binding <> 'mismatch'").select(*kept), judged.where("binding = 'mismatch'").select(*pairs.columns, F.lit("evidence mismatch").alias("reason"))

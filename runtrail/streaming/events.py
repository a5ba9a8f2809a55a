"""Structured Streaming over the event table's kinds: windows with late data, sessions, live ledgers, features per batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import with_technique

EVENT_STREAM = "run_id string, at timestamp, type string, target string, cmdline string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENT_STREAM, files_per_batch: int = 100) -> DataFrame:
    """Typed events as JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def distinct_reports(stream: DataFrame, key: str = "sha256", at: str = "at", late: str = "1 day") -> DataFrame:
    """Each report once within the time that late copies may take."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def technique_windows(stream: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Events and runs per technique and window; rows later than ``late`` no longer count."""
    rows = with_technique(stream.withWatermark("at", late)).where("technique is not null")
    window = F.window("at", width, slide) if slide else F.window("at", width)
    return rows.groupBy(window, "technique").agg(F.count("*").alias("n"), F.approx_count_distinct("run_id").alias("runs"))


def run_sessions(stream: DataFrame, gap: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions of each run: bursts of events with pauses under ``gap`` between them."""
    rows = with_technique(stream.withWatermark("at", late))
    return rows.groupBy(F.session_window("at", gap), "run_id").agg(F.count("*").alias("events"), F.count_if(F.col("technique").isNotNull()).alias("with_technique"))


STATE = "n long, suspicious long, last timestamp"
ALERT = "run_id string, n long, suspicious long, share double"


def running_suspicion(stream: DataFrame, threshold: float = 0.5, least: int = 5, idle_ms: int = 600_000) -> DataFrame:
    """An alert each time a batch leaves a run with a share of suspicious events over the threshold; idle runs are forgotten."""
    tactics = ("persistence", "impact", "defense-evasion", "execution")
    rows = with_technique(stream).select("run_id", "at", F.coalesce(F.col("tactic").isin(*tactics), F.lit(False)).cast("int").alias("bad"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, bad, last = state.get if state.exists else (0, 0, pd.Timestamp(0))
        for batch in batches:
            n, bad, last = n + len(batch), bad + int(batch["bad"].sum()), max(last, batch["at"].max())
        state.update((n, bad, last))
        state.setTimeoutDuration(idle_ms)
        if n >= least and bad / n >= threshold:
            yield pd.DataFrame({"run_id": [key[0]], "n": [n], "suspicious": [bad], "share": [bad / n]})

    return rows.groupBy("run_id").applyInPandasWithState(update, ALERT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def write_stream(df: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Start a Parquet sink that takes what there is and stops; the checkpoint makes it resumable."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

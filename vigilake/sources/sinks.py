"""Writing the segment index and reports."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.functions import columns as C
from vigilake.schemas import SEGMENTS
from vigilake.sources import folders

#: Beside the days of an index: a name for each cutoff and when it was set.
CUTOFFS = "_cutoffs"


def append_segments(segments: DataFrame, path: str, batch: str | None = None) -> None:
    """Writes index rows by day and batch, sorted by camera and time so that files prune.

    Rows of a batch replace what an earlier try of the same batch wrote, so that a rerun or a
    retried micro-batch adds nothing twice; without a name every call is a batch of its own.
    Rows are dealt out by ranges, so that a day with many rows is split.
    """
    order = ["date", "camera_id", "timestamp"]
    rows = segments.select(*[f.name for f in SEGMENTS]).withColumns({"date": C.day_key("timestamp"), "batch": F.lit(batch or uuid.uuid4().hex)})
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path)


def expire_segments(spark: SparkSession, path: str, days: int, now: datetime, grace: timedelta = timedelta(hours=24)) -> list[str]:
    """Retention by whole days: hides days older than ``days`` before ``now``, and removes those hidden ``grace`` ago.

    Every call adds a line to the list of cutoffs beside the data.  Readers take the last
    cutoff when they open the index; one that opened it before keeps its files for
    ``grace``.  Returns the days removed.
    """
    cutoff = (now - timedelta(days=days)).strftime("%Y%m%d")
    marks = [m.split("-") for m in folders.names(spark, f"{path}/{CUTOFFS}")]
    folders.make(spark, f"{path}/{CUTOFFS}/{cutoff}-{now:%Y%m%dT%H%M%S}")
    settled = max((c for c, at in marks if datetime.strptime(at, "%Y%m%dT%H%M%S") <= now - grace), default="")
    gone = [n.removeprefix("date=") for n in folders.names(spark, path) if n.startswith("date=") and n.removeprefix("date=") < settled]
    for day in gone:
        folders.remove(spark, f"{path}/date={day}")
    for c, at in marks:
        # A cutoff below the settled one tells no reader anything more.
        if c < settled:
            folders.remove(spark, f"{path}/{CUTOFFS}/{c}-{at}")
    return gone


def save_csv(rows: DataFrame, path: str) -> bool:
    """A report as one CSV file with a header; nothing is written without rows."""
    if rows.isEmpty():
        return False
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return True

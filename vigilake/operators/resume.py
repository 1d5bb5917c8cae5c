"""Background models over clips of any length, in steps that survive.

Each step takes every scene's next frames, starts its models from the last states, and
writes activity and new states as one table below a folder.  A step that was lost is done
again from the states before it, never from a clip's first frame; frames that come later,
such as another day's, go on where the folder ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.operators import background
from vigilake.operators.background import FRAME, REJECT, STATE, Options
from vigilake.schemas import FRAME_ACTIVITY
from vigilake.sources import folders

_SCENE = ["category", "scene"]
_STORED = T.StructType([*(f for f in background.ROWS if f.name != "kind"), T.StructField("step", T.LongType())])


def finished_steps(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the steps that were written whole."""
    names = [n for n in folders.names(spark, folder) if n.startswith("step=")]
    return sorted(int(n.removeprefix("step=")) for n in names if folders.exists(spark, f"{folder}/{n}/_SUCCESS"))


def _rows(spark: SparkSession, folder: str, kind: str) -> DataFrame | None:
    steps = [s for s in finished_steps(spark, folder) if folders.exists(spark, f"{folder}/step={s}/kind={kind}")]
    if not steps:
        return None
    paths = [f"{folder}/step={s}/kind={kind}" for s in steps]
    return spark.read.schema(_STORED).option("basePath", folder).parquet(*paths)


def advance(frames: DataFrame, folder: str, every: int, options: Options) -> bool:
    """One step: at most ``every`` frames of each scene beyond its last state.  False if there were none.

    A scene that failed in an earlier step gets no more steps.  States that later ones
    replace are removed once the new ones are written.
    """
    spark = frames.sparkSession
    states, bad = _rows(spark, folder, STATE), _rows(spark, folder, REJECT)
    todo = frames.filter("px IS NOT NULL")
    if bad is not None:
        todo = todo.join(bad.select(*_SCENE).distinct(), _SCENE, "left_anti")
    latest = None
    if states is not None:
        newest = states.groupBy(*_SCENE).agg(F.max("step").alias("step"), F.max("frame_idx").alias("last"))
        latest = states.join(newest.select(*_SCENE, "step"), [*_SCENE, "step"], "left_semi")
        todo = todo.join(newest.select(*_SCENE, "last"), _SCENE, "left").filter(F.col("frame_idx") > F.coalesce("last", F.lit(-1))).drop("last")
    # From the first frame left on, so that a gap in the numbers never holds a scene up.
    ends = todo.groupBy(*_SCENE).agg((F.min("frame_idx") + every - 1).alias("_end"))
    part = todo.join(ends, _SCENE).filter(F.col("frame_idx") <= F.col("_end")).drop("_end")
    if part.isEmpty():
        return False
    if latest is not None:
        latest = latest.join(part.select(*_SCENE).distinct(), _SCENE, "left_semi")
    step = max(finished_steps(spark, folder), default=-1) + 1
    background.fold_frames(part, options, latest, keep_states=True).write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/step={step}")
    if states is not None:
        _forget(spark, folder)
    return True


def _forget(spark: SparkSession, folder: str) -> None:
    """Removes states of steps all of whose scenes have later ones."""
    states = _rows(spark, folder, STATE).select(*_SCENE, "step").distinct()
    newest = states.groupBy(*_SCENE).agg(F.max("step").alias("step"))
    needed = {r["step"] for r in newest.select("step").distinct().collect()}
    for step in {r["step"] for r in states.select("step").distinct().collect()} - needed:
        folders.remove(spark, f"{folder}/step={step}/kind={STATE}")


def run(frames: DataFrame, folder: str, every: int = 1000, **options) -> DataFrame:
    """Steps until no frame is left; the activity so far.  A scene that fails is a reject, not the end of the job."""
    given = Options(**({"strict": False} | options))
    while advance(frames, folder, every, given):
        pass
    return stored_activity(frames.sparkSession, folder, given)


def stored_activity(spark: SparkSession, folder: str, options: Options) -> DataFrame:
    found = _rows(spark, folder, FRAME)
    return spark.createDataFrame([], FRAME_ACTIVITY) if found is None else background.frame_activity(found.withColumn("kind", F.lit(FRAME)), options)


def stored_rejects(spark: SparkSession, folder: str) -> DataFrame:
    found = _rows(spark, folder, REJECT)
    return spark.createDataFrame([], "category string, scene string, frame_idx long, reason string") if found is None else background.rejects(found.withColumn("kind", F.lit(REJECT)))

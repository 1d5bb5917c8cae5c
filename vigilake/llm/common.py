"""Helpers shared by the text operators."""

from __future__ import annotations

import functools
import inspect
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
WHITESPACE = " \t\n\x0b\f\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder that executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which all executors see: the session's ``spark.checkpoint.dir``.

    Only a local session, whose executors are this machine, may go without: it gets a folder
    of its own.  On a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes not to be a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def carries_columns(*parameters: str):
    """Decorator of operators on rows: all columns but those that ``parameters`` name pass through under names of their own.

    So a column may have any name, with dots or like one the operator works with; only one
    named like a result gives way to it.
    """

    def decorate(operator):
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def run(df: DataFrame, *args, **options) -> DataFrame:
            given = signature.bind(df, *args, **options)
            given.apply_defaults()
            used = {given.arguments[p] for p in parameters}
            names = {f"_c{i}_": c for i, c in enumerate(df.columns) if c not in used}
            hidden = iter(names)
            out = operator(df.toDF(*[c if c in used else next(hidden) for c in df.columns]), *args, **options)
            results = {c.lower() for c in out.columns if c not in names}
            kept = [c for c in out.columns if c not in names or names[c].lower() not in results]
            return out.select(*kept).toDF(*[names.get(c, c) for c in kept])

        return run

    return decorate


def stage_folder(spark: SparkSession) -> str:
    """A new path under the shared folder for tables of one run."""
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


def with_held_column(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """Like withColumn, through a generator of one row.

    A filter on the column then stays above it.  Otherwise it would move below the whole
    chain of columns with every reference spelt out, growing by a factor at each step.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(expression)).alias(name))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus`` (null counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def text_slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 4 << 20
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches so that each slice holds about ``max_bytes`` of text.

    Yields the slice and its texts as UTF-8 bytes, null as empty.  A longer text is a
    slice of its own, whole.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.binary_length(column).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + (size or 0) > max_bytes:
                yield _slice(batch, column, start, i)
                start, held = i, 0
            held += size or 0
        if start < len(sizes):
            yield _slice(batch, column, start, len(sizes))


def _slice(batch, column, start, end):
    part = column.slice(start, end - start).cast(pa.binary())
    return batch.slice(start, end - start), [x or b"" for x in part.to_pylist()]

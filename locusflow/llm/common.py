"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import sums_before
from ..sources.scratch import app_folder, delete, sweep  # noqa: F401  sweep and delete are for callers
from ..sources.scratch import shared_folder as shared_dir  # noqa: F401

#: Bytes that separate words: space, tab, newline, vertical tab, form feed, carriage return.
#: ``bytes.split()`` splits at exactly these, so Python and SQL forms agree.
WORD = r"[^\x20\x09-\x0D]+"


_made: ContextVar[list[str] | None] = ContextVar("scratch tables of the running scope", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, grouped by application so it can be swept."""
    path = f"{app_folder(spark)}/{label}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession):
    """Deletes the scratch tables made inside when it ends: for results that are written inside it."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            delete(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialized frame that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        delete(df.sparkSession, path)


#: Rows that one window partition orders, about.
ORDERED_TOGETHER = 100_000


def dealt_in_order(rows: DataFrame, order: list[Column], total: int, label: str) -> DataFrame:
    """Adds ``_part``: rows of a part come before those of the next in ``order``.

    A running number or sum over all rows is then one within parts plus one over the parts'
    totals, so no task orders the whole table.  Parts are cut by range and written out, because
    a second run might cut them elsewhere.
    """
    parts = -(-total // ORDERED_TOGETHER)
    if parts <= 1:
        return rows.withColumn("_part", F.lit(0))
    return materialize(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), label)


def running_sums(dealt: DataFrame, order: list[Column], sums: dict[str, Column], group: tuple[str, ...] = ()) -> DataFrame:
    """Adds to rows of :func:`dealt_in_order` the sums over all rows of the group before each."""
    return sums_before(dealt, list(group), F.col("_part"), order, sums).drop("_part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (as ``doc_id``) and the text as UTF-8 bytes (null: empty); other columns are dropped."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )


def rows_of(batch):
    """(ids, texts) of an Arrow batch from :func:`text_bytes`, as Python lists."""
    return batch.column(0).to_pylist(), batch.column(1).to_pylist()

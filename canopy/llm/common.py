"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: A table is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset (a
    local session, as in tests) is a temporary folder made and set.
    """
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not place:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="canopy-checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(place)
    return place


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path that ``scratch`` gave, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark a counted table for broadcast if its size is within the bound; else leave the plan to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def words(text: Column) -> Column:
    """The words of a text, in order: maximal runs without white space.  A null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def plain(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ... in order, so that an operator's own columns can't clash with them; ``toDF(*names)`` names them back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def plain_name(df: DataFrame, name: str) -> str:
    """The name in ``plain(df)`` of the column ``name``."""
    names = [c.lower() for c in df.columns]
    return f"c{names.index(name.lower())}"

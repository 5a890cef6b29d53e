"""Small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: The six characters that separate words, as a Java class body
#: and as the characters themselves (space, tab, LF, VT, FF, CR).
SPACES = r" \x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's table ``name``, read by Spark from ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset and the
    session is local, driver and tasks share this machine's temporary folder;
    on a cluster there is no such folder, so it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _local_dir()


@lru_cache(1)
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="shared-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the readers nothing that was
    finished here, and expensive parents are not computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one long each that may be broadcast: some 30 MB.
FEW_ROWS = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if it has at most FEW_ROWS; beyond that Spark shuffles both sides."""
    return F.broadcast(ids) if ids.count() <= FEW_ROWS else ids


def whole_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames sorted by ``key``, cut anew so that no group is in two."""
    rest = None
    for frame in frames:
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        last = frame[key].searchsorted(frame[key].iloc[-1]) if len(frame) else 0
        rest = frame.iloc[last:]
        if last:
            yield frame.iloc[:last]
    if rest is not None and len(rest):
        yield rest


def words(text: Column) -> Column:
    """Array of the maximal runs of non-separator characters (null: empty)."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACES}]+"))


def word_count(text: Column) -> Column:
    """Number of words of ``text`` as a long (null: 0)."""
    return F.size(words(text)).cast("long")


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under neutral column names, so that no name of its own can clash, and old name -> new name."""
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def is_unique(df: DataFrame, key: str) -> bool:
    """Whether ``key`` is a whole number in every row, and no two rows have the same."""
    if dict(df.dtypes)[key] not in ("bigint", "int", "smallint", "tinyint"):
        return False
    facts = df.agg(F.count("*").alias("n"), F.count(key).alias("k")).first()
    return facts["n"] == facts["k"] == df.select(key).distinct().count()


def numbered(df: DataFrame, key: str) -> DataFrame:
    """``df`` with _row, a unique long that is the same at every reading: the key itself where it is unique, else a number (stored)."""
    if is_unique(df, key):
        return df.select(F.col(key).cast("long").alias("_row"), "*")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = pa.array(np.arange(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, *batch.columns], names=["_row", *batch.schema.names])

    schema = StructType([StructField("_row", LongType()), *df.schema.fields])
    return stored(df.mapInArrow(number, schema), "numbered")

"""Tables that are replaced and deleted by key, several in one commit.

A commit adds to each of its tables a batch of rows and a batch of keys that are gone.
Nothing that stands is rewritten, so a commit costs what it brings. Readers
merge: a row counts unless its key went in a later batch. A line in the log,
written last and by the rename of one file, makes a commit visible in all its
tables at once; what a failed writer left is never read. ``compact`` writes the rows
that count as one batch, after which readers merge with later batches alone.

One writer at a time. The log has a line a table and commit since the last
compaction; its lines, not rows, come to the driver. Old batches stay, so readers that
began before a commit go on; clear them when no reader is left.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

LOG = "version long, batch string, name string, keys array<string>, has_rows boolean, has_gone boolean, base boolean"


def log(spark: SparkSession, path: str) -> list[Row]:
    """The committed lines since each table's last compaction, by version."""
    try:
        lines = sorted(spark.read.schema(LOG).parquet(f"{path}/log/*").collect(), key=lambda r: r.version)
    except AnalysisException:  # nothing was committed yet
        return []
    base = {r.name: r.version for r in lines if r.base}
    return [r for r in lines if r.version >= base.get(r.name, 0)]


def commit(spark: SparkSession, path: str, keys: dict[str, tuple[str, ...]], rows: dict[str, DataFrame], gone: dict[str, DataFrame], base: bool = False) -> int:
    """Add ``rows`` and drop the rows of earlier commits whose keys are ``gone``, in all tables or none; returns the version.

    ``keys``: the key columns of each table. A key that is gone may have new rows in the same commit.
    """
    version = 1 + max((r.version for r in log(spark, path)), default=0)
    batch = f"{version:012}-{uuid.uuid4().hex}"
    lines = []
    for name in dict.fromkeys([*rows, *gone]):
        mark = F.lit(version).cast("long").alias("_version")
        if name in rows:
            rows[name].select("*", mark).write.parquet(f"{path}/{name}/rows/{batch}")
        if name in gone:
            gone[name].select(*keys[name]).distinct().select("*", mark).write.parquet(f"{path}/{name}/gone/{batch}")
        lines.append((version, batch, name, list(keys[name]), name in rows, name in gone, base))
    # A writer that was cut off left no line under this version: what it may have left there goes.
    spark.createDataFrame(lines, LOG).coalesce(1).write.mode("overwrite").parquet(f"{path}/log/{version:012}")
    return version


def read(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The rows of a table that count (None if it was never written)."""
    lines = [r for r in log(spark, path) if r.name == name]
    places = [f"{path}/{name}/rows/{r.batch}" for r in lines if r.has_rows]
    if not places:
        return None
    rows = spark.read.option("mergeSchema", "true").parquet(*places)
    for keys in {tuple(r["keys"]): None for r in lines if r.has_gone}:  # a table's keys are most often the same in all commits
        gone = spark.read.parquet(*[f"{path}/{name}/gone/{r.batch}" for r in lines if r.has_gone and tuple(r["keys"]) == keys])
        last = gone.groupBy(*keys).agg(F.max("_version").alias("_gone"))
        same = reduce(lambda a, b: a & b, [rows[k] == last[k] for k in keys])
        rows = rows.join(last, same & (rows["_version"] < last["_gone"]), "left_anti")
    return rows.drop("_version")


def compact(spark: SparkSession, path: str) -> int:
    """Write what counts of every table as one batch."""
    keys = {r.name: tuple(r["keys"]) for r in log(spark, path)}
    rows = {name: found for name in keys if (found := read(spark, path, name)) is not None}
    return commit(spark, path, keys, rows, {}, base=True)

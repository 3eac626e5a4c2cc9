"""Table access and lineage cuts shared by the corpus operators."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import reachable


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the files make fewer tasks than that (a small table in one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes a task of a shuffle that we size ourselves is to read.
TASK_BYTES = 16 << 20


def tasks_for(spark: SparkSession, size: int) -> int:
    """Tasks for a shuffle of ``size`` bytes: ``TASK_BYTES`` each up to 8192 tasks, beyond that larger ones of a gigabyte at most; the cores at least."""
    return max(spark.sparkContext.defaultParallelism, min(math.ceil(size / TASK_BYTES), max(8192, math.ceil(size / 2**30))))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(reachable(spark).read.parquet(f"{sf_dir}/documents.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. A local session without one (tests) gets a temporary folder, a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.readloom.scratch", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="readloom-")
        spark.conf.set("spark.readloom.scratch", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there and a lost executor costs only the tasks it ran."""
    spark = reachable(df.sparkSession)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


WRITTEN: list[str] = []


def deleted(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Deletes the tables ``written`` has made, once no frame reads them any more."""
    deleted(spark, WRITTEN)
    WRITTEN.clear()


def released(spark: SparkSession) -> None:
    """Has Spark remove shuffle and checkpoint files of frames that nothing refers to any more: it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


class Latest:
    """The newest of a series of small written tables (steps of a loop): when the next is there, the one before goes.

    Parquet tables are read by as few tasks as their bytes need, where a checkpoint keeps the partitions of the shuffle before
    it, each with files of its own in every shuffle that follows."""

    def __init__(self, name: str):
        self.name, self.path = name, None

    def of(self, df: DataFrame) -> DataFrame:
        out = written(df, self.name)
        before, self.path = self.path, WRITTEN[-1]
        if before:
            deleted(df.sparkSession, [before])
            WRITTEN.remove(before)
        return out


def held(df: DataFrame, **columns) -> DataFrame:
    """``df`` with computed columns that later steps read but the optimiser does not copy into their expressions.

    Filters and lambdas over a projected column otherwise get its whole expression inlined, and then a text is split
    anew for every word of it. A one-element generator is a barrier to that.
    """
    value = F.struct(*[c.alias(k) for k, c in columns.items()])
    (name,) = unused([*df.columns, *columns], "held")
    out = df.select(*[c for c in df.columns if c not in columns], F.explode(F.array(value)).alias(name))
    return out.select(*[c for c in out.columns if c != name], *[F.col(name)[k].alias(k) for k in columns])


def let(value, body):
    """``body`` of ``value`` within one expression, ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column bears them (Spark does not tell cases apart)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def matched(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi, anti or left join with narrow ``keys`` (null-safe), whose other columns come with them.

    The plan is the same at every size: both sides are dealt by the key, and each task holds its part of the keys in a
    hash table while the wide rows stream past, unsorted. Nothing that grows with the input is broadcast."""
    names = unused(df.columns, *[f"_k_{c}" for c in on])
    keys = keys.withColumnsRenamed(dict(zip(on, names, strict=True)))
    if how != "left":
        keys = keys.select(*names).distinct()
    same = [df[c].eqNullSafe(keys[k]) for c, k in zip(on, names, strict=True)]
    out = df.join(keys.hint("shuffle_hash"), same, how)
    return out.drop(*names) if how == "left" else out

"""The corpus pipeline: each stage reads what its predecessor kept and returns documents; the last returns packed pieces."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import reachable
from readloom.llm import mixing, near_dedup, packing, quality, secrets
from readloom.llm._tables import WRITTEN, deleted, matched, released, unused, written


#: Tables that the stage before wrote for itself.
SCRATCH: list[str] = []


def stage(run):
    """A stage reads what its predecessor's result was written to, so by then that one's own tables (but those that ``docs``
    still reads) and shuffle files can go."""

    @functools.wraps(run)
    def one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if SCRATCH else []
        done = [path for path in SCRATCH if not any(path.rsplit("/", 1)[-1] in name for name in read)]
        deleted(reachable(spark), done)
        SCRATCH[:] = [path for path in SCRATCH if path not in done]
        released(spark)
        before = len(WRITTEN)
        out = run(spark, docs, sf_dir)
        if run.__name__ != "best_fit_packing":  # the last stage's result still reads its tables
            SCRATCH.extend(WRITTEN[before:])
            del WRITTEN[before:]
        return out

    return one


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line frequencies reject go; the others lose the lines above the limit.

    Null and empty texts fail the base rules and go; equal rows meet the same fate; an empty table stays empty."""
    return quality.filtered(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id; of repeated rows, one.

    Rows without an id or without words are linked with nothing and stay."""
    return near_dedup.deduplicated(docs)


@stage
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific secrets are masked in place; all documents stay, null and empty texts as they are."""
    return secrets.masked(docs)


@stage
def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole copy (blocks cut at most one document per source).

    Documents without words are never taken. Rows that repeat an id and text are taken equally often, as their mean is.
    The counts, a narrow table, meet the texts in one join dealt by id and text."""
    key, copies, number = unused(docs.columns, "text_key", "copies", "number")
    named = docs.withColumns({key: F.xxhash64(F.coalesce("text", F.lit(""))), number: F.col("doc_id").cast("long")})
    taken = mixing.mixed(docs).groupBy(F.col("doc_id").cast("long").alias(number), F.col("text_key").alias(key))
    taken = taken.agg(F.round(F.avg("taken") / F.nullif(F.max("size"), F.lit(0))).cast("int").alias(copies))
    out = matched(named, written(taken.filter(F.col(copies) > 0), "taken"), [number, key], "left").filter(F.col(copies) > 0)
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets. A null or empty text is one piece, its end id; rows that
    repeat are packed as often as they occur; an empty table gives no rows."""
    return packing.packed(written(packing.pieces(docs), "pieces"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_weights),
    ("best-fit packing", best_fit_packing),
]

#: MinHash components and packing can't be expressed in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, one in STAGES[:-1]:
        docs = written(one(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)

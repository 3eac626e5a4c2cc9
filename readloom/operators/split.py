"""Spike-in splitting of reads into classes, its statistics, and index counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.reads import has
from readloom.operators.filters import LIBRARY, ReadFilter, staged
from readloom.schemas import DUPLICATE, QCFAIL, SECONDARY, UNMAPPED

#: The output a class goes to; reads of other classes vanish.
OUTPUTS = {"endogenous": "endogenous", "exogenous": "exogenous", "unmapped": "unmapped", "qcfail": "unmapped", "duplicate": "unmapped", "secondary": "unmapped"}


def classified(reads: DataFrame, prefix: str, spec: ReadFilter = LIBRARY) -> DataFrame:
    """``reads`` with ``class``, in this order: unmapped, qcfail, duplicate, secondary, filtered, unplaced, exogenous, endogenous."""
    if not prefix:
        raise ValueError("an exogenous prefix is needed")
    kind = F.when(has(UNMAPPED), "unmapped").when(has(QCFAIL), "qcfail").when(has(DUPLICATE), "duplicate").when(has(SECONDARY), "secondary")
    kind = kind.when(F.col("fail_stage") == "no_reference", "unplaced").when(F.col("fail_stage").isNotNull(), "filtered")
    return staged(reads, spec).withColumn("class", kind.when(F.col("chrom").startswith(prefix), "exogenous").otherwise("endogenous")).drop("fail_stage")


def split_stats(classes: DataFrame, sample: str = "sample") -> DataFrame:
    """One row: counts by class, the factor 1e6 / exogenous (1 of none) and exogenous / endogenous in percent."""
    n = lambda *k: F.count_if(F.col("class").isin(*k))
    out = classes.agg(
        F.count("*").alias("n_total_reads"), n("unmapped", "unplaced").alias("n_unmapped_reads"), n("qcfail").alias("n_qcfail_reads"), n("duplicate").alias("n_duplicate_reads"),
        n("secondary").alias("n_secondary_reads"), n("filtered").alias("n_filtered_reads"), n("endogenous").alias("n_endogenous"), n("exogenous").alias("n_exogenous"),
    )
    zero = F.lit(0).cast("long")
    out = out.select(F.lit(sample).alias("sample"), "*", zero.alias("n_both_genomes"), zero.alias("n_low_maq"))
    factor = F.coalesce(F.try_divide(F.lit(1e6), F.col("n_exogenous")), F.lit(1.0))
    return out.withColumns({"spike_in_factor": factor, "spike_in_percentage": F.coalesce(F.try_divide(F.col("n_exogenous") * 100.0, F.col("n_endogenous")), F.lit(float("inf")))})


def fanned_out(classes: DataFrame) -> dict[str, DataFrame]:
    """The four outputs; ``both`` is empty by construction."""
    out = F.lit(None).cast("string")
    for kind, name in OUTPUTS.items():
        out = F.when(F.col("class") == kind, name).otherwise(out)
    marked = classes.withColumn("_out", out)
    return {name: marked.filter(F.col("_out") == name).drop("_out", "class") for name in ("endogenous", "exogenous", "both", "unmapped")}


def index_stats(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """(sample, ref_id, chrom, length, mapped, unmapped), with references no read lies on."""
    counts = reads.filter("ref_id >= 0").groupBy("sample", "ref_id").agg(F.count_if(~has(UNMAPPED)).alias("m"), F.count_if(has(UNMAPPED)).alias("u"))
    cells = reads.select("sample").distinct().join(F.broadcast(refs.select("ref_id", "chrom", "length")))
    return cells.join(counts, ["sample", "ref_id"], "left").select("sample", "ref_id", "chrom", "length", F.coalesce("m", F.lit(0)).alias("mapped"), F.coalesce("u", F.lit(0)).alias("unmapped"))


def mapped_by_prefix(index: DataFrame, prefix: str) -> DataFrame:
    mine = F.col("chrom").startswith(prefix)
    return index.groupBy("sample").agg(F.sum(F.when(mine, F.col("mapped")).otherwise(0)).alias("exogenous"), F.sum(F.when(~mine, F.col("mapped")).otherwise(0)).alias("endogenous"))

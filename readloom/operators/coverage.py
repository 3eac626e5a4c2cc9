"""Coverage of reads or fragments in bins, its normalisation, and several samples side by side."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.reads import is_scaffold
from readloom.operators.binning import checked, collapsed, counted, grid, run_lengths
from readloom.operators.filters import LIBRARY, ReadFilter, passing
from readloom.operators.intervals import coordinates

METHODS = ("raw", "cpm", "rpkm")


def single(x: float) -> float:
    """The value as a 32-bit float, which scale factors are."""
    return struct.unpack("f", struct.pack("f", x))[0]


def factor(method: str, retained: Column, bin_size: int, scale: float = 1.0) -> Column:
    """Raw: the scale; CPM: per million reads; RPKM: per million reads and kilobase; 0 without reads."""
    f = F.lit(single(scale))
    if method == "raw":
        return f
    if method not in METHODS:
        raise ValueError(f"unknown normalisation {method!r}")
    out = f * 1e6 / F.nullif(retained.cast("double"), F.lit(0.0))
    if method == "rpkm":
        out = out * 1e3 / float(bin_size)
    return F.coalesce(out, F.lit(0.0))


def pileup(reads: DataFrame, refs: DataFrame, bin_size: int = 50, spec: ReadFilter = LIBRARY, fragments: bool = False, shift=(0, 0, 0, 0), truncate=(None, None), keys: tuple[str, ...] = (), ignore_scaffolds: bool = False, method: str = "raw", scale: float = 1.0, dense: bool = True) -> DataFrame:
    """(chrom, start, end, score), every bin of every chromosome (``dense``) or those with reads.

    The reads retained, which CPM and RPKM divide by, are all that pass the filter, whatever they project to.
    """
    bs = checked(bin_size)
    if ignore_scaffolds:
        refs = refs.filter(~is_scaffold())
    kept = passing(reads, spec)
    counts = counted(coordinates(kept, refs, fragments, shift, truncate), bs, keys)
    if dense:
        cells = grid(refs, bs)
        if keys:
            cells = reads.select(*keys).distinct().join(cells)
        out = cells.join(counts, [*keys, "chrom", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    else:
        out = counts.join(F.broadcast(refs.select("chrom", "length")), "chrom").withColumns({"start": F.col("bin") * bs, "end": F.least((F.col("bin") + 1) * bs, F.col("length"))})
    if method == "raw":
        return out.select(*keys, "chrom", "start", "end", (F.col("n") * factor("raw", F.lit(0), bs, scale)).alias("score"))
    retained = kept.groupBy(*keys).agg(F.count("*").alias("_retained")) if keys else kept.agg(F.count("*").alias("_retained"))
    out = out.join(F.broadcast(retained), list(keys), "left") if keys else out.join(F.broadcast(retained))  # a row, or one per sample
    return out.select(*keys, "chrom", "start", "end", (F.col("n") * factor(method, F.coalesce("_retained", F.lit(0)), bs, scale)).alias("score"))


def collapsed_coverage(reads: DataFrame, refs: DataFrame, **options) -> DataFrame:
    """Coverage with touching bins of equal score joined."""
    keys = options.get("keys", ())
    return run_lengths(pileup(reads, refs, **options), (*keys, "chrom"), ("score",))


def count_matrix(reads: DataFrame, refs: DataFrame, bin_size: int = 10_000, spec: ReadFilter = LIBRARY, fragments: bool = False, ignore_scaffolds: bool = False) -> DataFrame:
    """Long matrix (bin_idx, chrom, start, end, sample, count) on one grid; bins are numbered by chromosome name and start."""
    from pyspark.sql import Window

    counts = pileup(reads, refs, bin_size, spec, fragments, keys=("sample",), ignore_scaffolds=ignore_scaffolds)
    refs = refs.filter(~is_scaffold()) if ignore_scaffolds else refs
    per = refs.filter("length > 0").withColumn("_bins", F.expr(f"(length - 1) div {bin_size} + 1"))
    # one row per chromosome: the bins before it
    first = per.select("chrom", (F.sum("_bins").over(Window.partitionBy(F.lit(0)).orderBy("chrom")) - F.col("_bins")).alias("_first"))
    out = counts.join(F.broadcast(first), "chrom")
    return out.select((F.col("_first") + F.expr(f"start div {bin_size}")).alias("bin_idx"), "chrom", "start", "end", "sample", F.col("score").cast("long").alias("count"))


def library_sizes(reads: DataFrame, spec: ReadFilter = LIBRARY) -> DataFrame:
    """(sample, library_size): reads retained; a sample of which none are has 0."""
    kept = passing(reads, spec).groupBy("sample").agg(F.count("*").alias("n"))
    return reads.select("sample").distinct().join(kept, "sample", "left").select("sample", F.coalesce("n", F.lit(0)).alias("library_size"))


def wide(long: DataFrame, samples: list[str], value: str = "count", keys: tuple[str, ...] = ("chrom", "start", "end")) -> DataFrame:
    """One column per sample, 0 where a sample has no row."""
    return long.groupBy(*keys).pivot("sample", samples).agg(F.first(value)).na.fill(0, samples)


def side_by_side(reads: DataFrame, refs: DataFrame, samples: list[str], collapse: bool = False, **options) -> DataFrame:
    """Samples as columns over (chrom, start, end); ``collapse`` joins touching bins equal in all of them."""
    out = wide(pileup(reads, refs, keys=("sample",), **options), samples, "score")
    return run_lengths(out, ("chrom",), tuple(samples)) if collapse else out

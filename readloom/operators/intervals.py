"""Reads to intervals (0-based, half-open): spans, fragments, shifts, truncation; the transposase adjustment of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.reads import has
from readloom.schemas import FIRST, PROPER, REVERSE


def read_intervals(reads: DataFrame) -> DataFrame:
    return reads.withColumn("start", F.col("pos") - 1).withColumn("end", F.col("pos") - 1 + F.col("ref_span"))


def fragment_intervals(reads: DataFrame) -> DataFrame:
    """One interval per template, from its first read; a zero template length makes none."""
    size = F.abs(F.col("tlen").cast("long"))
    start = F.when(F.col("tlen") > 0, F.col("pos") - 1).otherwise(F.col("mate_pos") - 1)
    return reads.filter(has(FIRST) & (F.col("tlen") != 0)).withColumn("start", start).withColumn("end", start + size)


def shifted(intervals: DataFrame, shift: tuple[int, int, int, int]) -> DataFrame:
    """Starts and ends moved by strand and read number, clipped to the chromosome (``length``); ``dtlen`` is what was used."""
    five, three, five_r, three_r = shift
    rev, first = has(REVERSE), has(FIRST)
    if not any(shift):
        return intervals.withColumn("dtlen", F.lit(0).cast("long"))
    by_start = F.when(rev & first, three).when(rev, three_r).otherwise(five).cast("long")
    by_end = F.when(rev, five_r).when(first, three).otherwise(three_r).cast("long")
    out = intervals.withColumn("dtlen", by_start + by_end)
    start = F.greatest(F.col("start") - by_start, F.lit(0))
    return out.withColumns({"start": start, "end": F.least(F.greatest(F.col("end") + by_end, F.lit(0)), F.col("length"))})


def truncated(intervals: DataFrame, five: int | None = None, three: int | None = None) -> DataFrame:
    """Both ends drawn in, whatever the strand; the end doesn't fall below 0. The result may be empty (end <= start)."""
    return intervals.withColumns({"start": F.col("start") + (five or 0), "end": F.greatest(F.col("end") - (three or 0), F.lit(0))})


def coordinates(reads: DataFrame, refs: DataFrame, fragments: bool = False, shift=(0, 0, 0, 0), truncate=(None, None)) -> DataFrame:
    """Reads that pass a filter to non-empty intervals with their chromosome's length."""
    out = (fragment_intervals if fragments else read_intervals)(reads)
    out = out.join(F.broadcast(refs.select("chrom", "length")), "chrom")
    out = truncated(shifted(out, shift), *truncate)
    return out.filter(F.col("end") > F.col("start"))


def rewritten(reads: DataFrame, refs: DataFrame, shift: tuple[int, int, int, int]) -> DataFrame:
    """Reads at their shifted start, the template length changed by what was used and keeping its sign."""
    out = shifted(read_intervals(reads).join(F.broadcast(refs.select("chrom", "length")), "chrom"), shift)
    tlen = F.when(F.col("tlen") < 0, F.col("tlen") - F.col("dtlen")).otherwise(F.col("tlen") + F.col("dtlen"))
    clamped = F.least(F.greatest(tlen, F.lit(-(2**31)).cast("long")), F.lit(2**31 - 1).cast("long")).cast("int")
    return out.withColumns({"pos": F.col("start") + 1, "tlen": clamped}).drop("start", "end", "length", "dtlen")


def tn5_adjusted(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """Properly paired reads moved to the centre of the transposase cut.

    Forward reads start 4 bases later, reverse reads end 5 earlier, so the mate of a reverse read starts 4 later and
    templates shrink by 9. Reads that would leave the chromosome are dropped; a mate that would is left where it is.
    """
    rev = has(REVERSE)
    out = reads.filter(has(PROPER)).join(F.broadcast(refs.select("chrom", "length")), "chrom")
    start = F.greatest(F.col("pos") - 1, F.lit(0)) + F.when(rev, 0).otherwise(4)
    end = F.greatest(F.col("pos") - 1, F.lit(0)) + F.col("seq_len") - F.when(rev, 5).otherwise(0)
    out = out.withColumns({"_start": start, "_end": end}).filter((F.col("_start") >= 0) & (F.col("_end") <= F.col("length")) & (F.col("_start") <= F.col("length")))
    tlen = F.when(F.col("tlen") < 0, F.col("tlen").cast("long") + 9).otherwise(F.col("tlen").cast("long") - 9)
    tlen = F.greatest(F.least(tlen, F.lit(2**31 - 1).cast("long")), F.lit(-(2**31)).cast("long")).cast("int")
    mate = F.col("mate_pos") + 4
    mate = F.when(rev & (mate - 1 <= F.col("length")) & (mate >= 1), mate).otherwise(F.col("mate_pos"))
    return out.withColumns({"pos": F.col("_start") + 1, "tlen": tlen, "mate_pos": mate}).drop("_start", "_end", "length")

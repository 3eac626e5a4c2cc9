"""Bins, counts of intervals in bins, and joining of equal neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRIPE = 1_048_576
SMALL_BIN = 10


def checked(bin_size: int) -> int:
    if bin_size <= 0:
        raise ValueError("the bin size must be positive")
    return bin_size


def grid(refs: DataFrame, bin_size: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(chrom, bin, start, end): whole chromosomes in bins, the last one clipped."""
    bs = checked(bin_size)
    last = F.expr(f"(length - 1) div {bs}")
    out = refs.filter("length > 0").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return out.select(*keys, "chrom", "bin", (F.col("bin") * bs).alias("start"), F.least((F.col("bin") + 1) * bs, F.col("length")).alias("end"))


def counted(intervals: DataFrame, bin_size: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(chrom, bin, n): intervals that overlap each bin. Intervals have ``length``; what hangs over is cut off.

    Large bins: a row for each bin an interval meets, summed before the shuffle. Small bins, where a fragment meets
    many: +1 at its first bin and -1 after its last, within stripes of a megabase, and running sums.
    """
    bs = checked(bin_size)
    inside = intervals.withColumns({"start": F.greatest("start", F.lit(0)), "end": F.least("end", "length")}).filter("end > start")
    first, last = F.expr(f"start div {bs}"), F.expr(f"(end - 1) div {bs}")
    if bs > SMALL_BIN:
        return inside.select(*keys, "chrom", F.explode(F.sequence(first, last)).alias("bin")).groupBy(*keys, "chrom", "bin").agg(F.count("*").alias("n"))
    per = STRIPE // bs
    spans = inside.select(*keys, "chrom", first.alias("a"), last.alias("b"))
    spans = spans.withColumn("stripe", F.explode(F.sequence(F.expr(f"a div {per}"), F.expr(f"b div {per}"))))
    spans = spans.withColumns({"a": F.greatest("a", F.col("stripe") * per), "b": F.least("b", F.col("stripe") * per + per - 1)})
    steps = spans.select(*keys, "chrom", "stripe", F.explode(F.array(F.struct(F.col("a").alias("bin"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("bin"), F.lit(-1).alias("d")))).alias("s"))
    steps = steps.groupBy(*keys, "chrom", "stripe", "s.bin").agg(F.sum("s.d").alias("d"))
    w = Window.partitionBy(*keys, "chrom", "stripe").orderBy("bin")
    runs = steps.withColumn("n", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to", F.lead("bin").over(w)).filter("n > 0")
    return runs.select(*keys, "chrom", F.explode(F.sequence(F.col("bin"), F.col("to") - 1)).alias("bin"), "n")


def islands(rows: DataFrame, by: tuple[str, ...], same: Column, values: tuple[str, ...]) -> DataFrame:
    """Neighbouring rows (by start) joined where ``same`` holds against the ``_prev_*`` columns of the row before."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    out = rows.withColumns({f"_prev_{c}": F.lag(c).over(w) for c in ("end", *values)})
    out = out.withColumn("_g", F.sum((~F.coalesce(same, F.lit(False))).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    firsts = [F.min_by(c, "start").alias(c) for c in values]
    return out.groupBy(*by, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), *firsts).drop("_g")


def collapsed(signal: DataFrame, by: tuple[str, ...] = ("chrom",), value: str = "score", tolerance: float = 1e-6) -> DataFrame:
    """Touching rows whose score is within ``tolerance`` of the row before; the first score stays."""
    return islands(signal, by, (F.col("start") == F.col("_prev_end")) & (F.abs(F.col(value) - F.col(f"_prev_{value}")) <= tolerance), (value,))


def run_lengths(rows: DataFrame, by: tuple[str, ...] = ("chrom",), values: tuple[str, ...] = ("value",)) -> DataFrame:
    """Touching rows with exactly equal values; NaN and null equal nothing."""
    same = F.col("start") == F.col("_prev_end")
    for v in values:
        same = same & (F.col(v) == F.col(f"_prev_{v}")) & ~F.coalesce(F.isnan(F.col(v).cast("double")), F.lit(True))
    return islands(rows, by, same, values)

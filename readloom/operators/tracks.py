"""Signal tracks (piecewise constant, gaps are 0): bin means, aggregates over tracks, comparison of two.

Intervals are cut at bin edges and the rest happens within ``(chrom, bin)``: that is the partition key, so parallelism is
not bound by chromosomes and no window is longer than a bin. Rounding to 32-bit floats follows the order of the
computation: bin means before scaling, results at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.binning import checked, grid, run_lengths

AGGREGATES = ("sum", "mean", "median", "max", "min")
COMPARISONS = ("subtraction", "ratio", "log-ratio")


def cut(tracks: DataFrame, refs: DataFrame, bin_size: int) -> DataFrame:
    """(track, chrom, bin, s, e, value): non-zero intervals cut at bin edges and chromosome ends."""
    bs = checked(bin_size)
    out = tracks.filter("end > start and value <> 0").join(F.broadcast(refs.select("chrom", "length")), "chrom")
    out = out.withColumn("end", F.least("end", "length")).filter("end > start")
    out = out.withColumn("bin", F.explode(F.sequence(F.expr(f"start div {bs}"), F.expr(f"(end - 1) div {bs}"))))
    return out.select("track", "chrom", "bin", F.greatest("start", F.col("bin") * bs).alias("s"), F.least("end", (F.col("bin") + 1) * bs).alias("e"), F.col("value").cast("double").alias("value"))


def _dense(cells: DataFrame, refs: DataFrame, bin_size: int, empty: float | Column, value: str = "value") -> DataFrame:
    out = grid(refs, bin_size).join(cells, ["chrom", "bin"], "left")
    return out.select("chrom", "start", "end", F.coalesce(F.col(value), F.lit(empty)).cast("float").alias("value"))


def bin_means(tracks: DataFrame, refs: DataFrame, bin_size: int) -> DataFrame:
    """(track, chrom, bin, mean): bins that a track covers; a mean is rounded to 32 bits."""
    bs = checked(bin_size)
    width = F.least((F.col("bin") + 1) * bs, F.col("length")) - F.col("bin") * bs
    sums = cut(tracks, refs, bs).groupBy("track", "chrom", "bin").agg(F.sum(F.col("value") * (F.col("e") - F.col("s"))).alias("sum"))
    return sums.join(F.broadcast(refs.select("chrom", "length")), "chrom").select("track", "chrom", "bin", (F.col("sum") / width).cast("float").alias("mean"))


def _scales(names: list, scales: list[float] | None) -> list[float]:
    if not names:
        raise ValueError("no tracks")
    if scales is not None and len(scales) != len(names):
        raise ValueError(f"{len(scales)} scale factors for {len(names)} tracks")
    return [float(x) for x in scales] if scales else [1.0] * len(names)


def _by_name(names: list, values: list[float]) -> Column:
    out = F.lit(None).cast("double")
    for n, v in zip(names, values, strict=True):
        out = F.when(F.col("track") == n, F.lit(v)).otherwise(out)
    return out


def segments(pieces: DataFrame, refs: DataFrame, bin_size: int, names: list) -> DataFrame:
    """(chrom, bin, v_0.., len, width): elementary stretches of a covered bin with every track's value, 0 in gaps.

    A step function is its changes: a track's value where an interval starts, 0 where one ends and none starts; between
    changes the last value holds.
    """
    bs = checked(bin_size)
    value = [F.coalesce(F.max(F.when((F.col("track") == n) & (F.col("at") == F.col("s")), F.col("value"))), F.max(F.when((F.col("track") == n) & (F.col("at") == F.col("e")), F.lit(0.0)))).alias(f"c_{k}") for k, n in enumerate(names)]
    points = pieces.withColumn("at", F.explode(F.array("s", "e", F.col("bin") * bs)))
    points = points.groupBy("chrom", "bin", "at").agg(*value)
    w = Window.partitionBy("chrom", "bin").orderBy("at")
    out = points.join(F.broadcast(refs.select("chrom", "length")), "chrom")
    stop = F.least((F.col("bin") + 1) * bs, F.col("length"))
    out = out.withColumn("len", F.coalesce(F.lead("at").over(w), stop) - F.col("at")).withColumn("width", stop - F.col("bin") * bs)
    for k in range(len(names)):
        out = out.withColumn(f"v_{k}", F.coalesce(F.last(f"c_{k}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    return out.filter("len > 0").select("chrom", "bin", *[f"v_{k}" for k in range(len(names))], "len", "width")


def aggregated(tracks: DataFrame, refs: DataFrame, names: list, method: str = "mean", bin_size: int = 50, pseudocount: float = 0.0, scales: list[float] | None = None) -> DataFrame:
    """(chrom, start, end, value) of all bins. Sum and mean combine bin means; maximum and minimum are taken base by
    base and then averaged; the median is the weighted lower one over all (track, base) values of a bin."""
    scale, pc, bs = _scales(names, scales), float(pseudocount), checked(bin_size)
    mine = tracks.filter(F.col("track").isin(names))
    if method in ("sum", "mean"):
        means = bin_means(mine, refs, bs).groupBy("chrom", "bin").agg(F.sum(F.col("mean").cast("double") * _by_name(names, scale)).alias("sum"))
        total, empty = F.col("sum") + len(names) * pc, len(names) * pc
        if method == "mean":
            total, empty = total / len(names), pc
        return _dense(means.select("chrom", "bin", total.alias("value")), refs, bs, empty)
    if method in ("max", "min"):
        values = [F.col(f"v_{k}") * s + pc for k, s in enumerate(scale)]
        pick = values[0] if len(values) == 1 else (F.greatest if method == "max" else F.least)(*values)
        out = segments(cut(mine, refs, bs), refs, bs, names).groupBy("chrom", "bin").agg((F.sum(pick * F.col("len")) / F.first("width")).alias("value"))
        return _dense(out, refs, bs, pc)
    if method != "median":
        raise ValueError(f"unknown aggregation {method!r}")
    pieces = cut(mine, refs, bs).select("chrom", "bin", (F.col("value") * _by_name(names, scale) + pc).alias("v"), (F.col("e") - F.col("s")).alias("w"))
    covered = pieces.groupBy("chrom", "bin").agg(F.sum("w").alias("w")).join(F.broadcast(refs.select("chrom", "length")), "chrom")
    width = F.least((F.col("bin") + 1) * bs, F.col("length")) - F.col("bin") * bs
    gaps = covered.select("chrom", "bin", F.lit(pc).alias("v"), (width * len(names) - F.col("w")).alias("w")).filter("w > 0")
    steps = pieces.unionByName(gaps).groupBy("chrom", "bin", "v").agg(F.sum("w").alias("w"))
    w = Window.partitionBy("chrom", "bin")
    steps = steps.withColumn("cum", F.sum("w").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("w").over(w))
    out = steps.filter(2 * F.col("cum") >= F.col("all")).groupBy("chrom", "bin").agg(F.min("v").alias("value"))
    return _dense(out, refs, bs, pc)


def _log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def _ratio(a: Column, b: Column) -> Column:
    at_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b != 0, F.try_divide(a, b)).otherwise(at_zero)


def compared(tracks: DataFrame, refs: DataFrame, first, second, method: str = "subtraction", bin_size: int = 50, pseudocount: float = 1e-12, scales: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(chrom, start, end, value): base-by-base comparison of two tracks, averaged over every bin."""
    if method not in COMPARISONS:
        raise ValueError(f"unknown comparison {method!r}")
    pc, bs = F.lit(float(pseudocount)), checked(bin_size)

    def op(a, b):
        return {"subtraction": lambda: a - b, "ratio": lambda: _ratio(a, b + pc), "log-ratio": lambda: _log_quotient(a + pc, b + pc)}[method]()

    def _log_quotient(a, b):
        return _log(_ratio(a, b))

    names = [first, second] if first != second else [first]
    parts = segments(cut(tracks.filter(F.col("track").isin(names)), refs, bs), refs, bs, names)
    value = op(F.col("v_0") * float(scales[0]), F.col("v_1" if len(names) == 2 else "v_0") * float(scales[1]))
    out = parts.groupBy("chrom", "bin").agg((F.sum(value * F.col("len")) / F.first("width")).alias("value"))
    return _dense(out, refs, bs, op(F.lit(0.0), F.lit(0.0)))


def joined_bins(bins: DataFrame) -> DataFrame:
    """Touching bins of exactly equal value joined, as tracks are written."""
    return run_lengths(bins, ("chrom",), ("value",))

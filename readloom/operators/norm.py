"""Between-sample scale factors from a long bin-count matrix (bin_idx, sample, count) and library sizes (sample, library_size).

An estimator is a function ``(counts, libraries, **options) -> DataFrame``; ``METHODS`` is their registry. A result has a
row per sample: library_size, norm_factor, scale_factor, n_bins_total, n_bins_used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = ("sample", "library_size", "norm_factor", "scale_factor", "n_bins_total", "n_bins_used")


def geometric_mean(x: Column) -> Column:
    """Of the positive finite values; 1 of none (as an aggregate or over a window)."""
    return F.avg(F.when((x > 0) & (x < float("inf")), F.ln(x)))


def _all() -> Window:
    return Window.partitionBy(F.lit(0))


def centred(rows: DataFrame, e: Column) -> DataFrame:
    """``scale_factor``: geometric mean of the effective sizes over each; 1 where one is 0. Rows are samples."""
    out = rows.withColumn("_e", e)
    gm = F.coalesce(F.exp(geometric_mean(F.col("_e")).over(_all())), F.lit(1.0))
    return out.withColumn("scale_factor", F.when(F.col("_e") == 0, 1.0).otherwise(gm / F.nullif(F.col("_e"), F.lit(0.0)))).drop("_e")


def _need(counts: DataFrame, n: int, method: str) -> None:
    if len(counts.select("sample").distinct().limit(n).collect()) < n:
        raise ValueError(f"{method} needs at least {n} samples")


def tmm(counts: DataFrame, libraries: DataFrame, reference: str | None = None, logratio_trim: float = 0.3, sum_trim: float = 0.05, weighted: bool = True, cutoff: float = -1e10) -> DataFrame:
    """Trimmed mean of M-values against a reference sample: the named one, or that whose bin total is closest to the geometric mean."""
    _need(counts, 2, "tmm")
    totals = counts.groupBy("sample").agg(F.sum("count").cast("double").alias("n"))
    if reference is None:
        gm = F.coalesce(F.exp(geometric_mean(F.col("n")).over(_all())), F.lit(1.0))
        ref = totals.withColumn("gm", gm).agg(F.min_by("sample", F.struct(F.abs(F.col("n") - F.col("gm")), "sample")).alias("ref"))
    else:
        if totals.filter(F.col("sample") == reference).isEmpty():
            raise ValueError(f"unknown reference sample {reference!r}")
        ref = totals.select(F.lit(reference).alias("ref")).limit(1)
    # the reference's counts stand beside every sample's by an equality join on the bin
    base = counts.join(F.broadcast(ref), F.col("sample") == F.col("ref"), "left_semi").select("bin_idx", F.col("count").cast("double").alias("yr"))
    ref_n = totals.join(F.broadcast(ref), F.col("sample") == F.col("ref"), "left_semi").select(F.col("n").alias("nr"))
    pairs = counts.filter("count > 0").select("bin_idx", "sample", F.col("count").cast("double").alias("y")).join(base.filter("yr > 0"), "bin_idx")
    pairs = pairs.join(F.broadcast(totals), "sample").join(F.broadcast(ref_n))
    p, q = F.col("y") / F.col("n"), F.col("yr") / F.col("nr")
    pairs = pairs.withColumns({"m": F.log2(p / q), "a": 0.5 * F.log2(p * q), "v": (F.col("n") - F.col("y")) / (F.col("n") * F.col("y")) + (F.col("nr") - F.col("yr")) / (F.col("nr") * F.col("yr"))})
    pairs = pairs.filter(F.col("a") > cutoff)
    own = Window.partitionBy("sample")
    ranked = pairs.withColumns({"k": F.count("*").over(own), "top": F.max(F.abs("m")).over(own), "rm": F.row_number().over(own.orderBy("m", "bin_idx")), "ra": F.row_number().over(own.orderBy("a", "bin_idx"))})
    lo_m, lo_a = F.floor(F.col("k") * F.lit(float(logratio_trim))) + 1, F.floor(F.col("k") * F.lit(float(sum_trim))) + 1
    inside = F.col("rm").between(lo_m, F.col("k") + 1 - lo_m) & F.col("ra").between(lo_a, F.col("k") + 1 - lo_a)
    if weighted:
        mean = F.try_divide(F.sum(F.when(inside, F.try_divide(F.col("m"), F.col("v")))), F.sum(F.when(inside, F.try_divide(F.lit(1.0), F.col("v")))))
    else:
        mean = F.avg(F.when(inside, F.col("m")))
    raw = ranked.groupBy("sample").agg(mean.alias("f"), F.first("top").alias("top"))
    raw = raw.select("sample", F.when(F.col("top") < 1e-6, 1.0).otherwise(F.pow(F.lit(2.0), F.coalesce(F.nanvl("f", F.lit(0.0)), F.lit(0.0)))).alias("f"))
    n_bins = counts.agg(F.countDistinct("bin_idx").alias("n_bins_total"))
    out = libraries.join(raw, "sample", "left").withColumn("f", F.coalesce("f", F.lit(1.0)))
    out = out.withColumn("norm_factor", F.col("f") / F.coalesce(F.exp(geometric_mean(F.col("f")).over(_all())), F.lit(1.0)))
    out = centred(out, F.col("library_size") * F.col("norm_factor")).join(F.broadcast(n_bins))
    return out.withColumn("n_bins_used", F.col("n_bins_total")).select(*RESULT)


def background_bins(counts: DataFrame, exclude_top_percent: float = 5.0) -> DataFrame:
    """(bin_idx) of bins left once the bins of the highest means and the empty ones are gone; ties by bin order."""
    means = counts.groupBy("bin_idx").agg(F.avg("count").alias("mean"), F.max("count").alias("top"))
    n = means.count()
    drop = int(n * exclude_top_percent / 100 + 0.5)
    # the bins are a table of genome size / bin size rows: ranked by a sort, as the window over all bins would do in one task
    top = means.orderBy(F.col("mean").desc(), "bin_idx").limit(drop).select("bin_idx")
    return means.join(top, "bin_idx", "left_anti").filter("top > 0").select("bin_idx")


def csaw_background(counts: DataFrame, libraries: DataFrame, exclude_top_percent: float = 5.0, inner: Callable | None = None, **options) -> DataFrame:
    kept = background_bins(counts, exclude_top_percent)
    if kept.isEmpty():
        raise ValueError("no background bins are left")
    out = (inner or tmm)(counts.join(kept, "bin_idx", "left_semi"), libraries, **options)
    total = counts.agg(F.countDistinct("bin_idx").alias("_t"))
    return out.join(F.broadcast(total)).withColumn("n_bins_total", F.col("_t")).select(*RESULT)


def cpm(counts: DataFrame, libraries: DataFrame) -> DataFrame:
    n = counts.agg(F.countDistinct("bin_idx").alias("n_bins_total"))
    out = libraries.withColumn("scale_factor", F.when(F.col("library_size") == 0, 0.0).otherwise(1e6 / F.nullif(F.col("library_size").cast("double"), F.lit(0.0))))
    return out.withColumn("norm_factor", F.lit(1.0)).join(F.broadcast(n)).withColumn("n_bins_used", F.col("n_bins_total")).select(*RESULT)


def median_of_ratios(counts: DataFrame, libraries: DataFrame) -> DataFrame:
    _need(counts, 2, "median-of-ratios")
    n = libraries.count()
    geo = counts.groupBy("bin_idx").agg(F.count_if(F.col("count") > 0).alias("k"), F.avg(F.when(F.col("count") > 0, F.ln("count"))).alias("g")).filter(F.col("k") == n)
    used = geo.count()
    if not used:
        raise ValueError("no bin has reads in every sample")
    s = counts.join(geo, "bin_idx").groupBy("sample").agg(F.median(F.col("count") / F.exp("g")).alias("s"))
    middle = s.agg(F.median("s").alias("mid"))
    out = libraries.join(s, "sample").join(F.broadcast(middle)).withColumns({"scale_factor": F.when(F.col("s") == 0, 1.0).otherwise(F.col("mid") / F.nullif(F.col("s"), F.lit(0.0)))})
    out = out.withColumn("norm_factor", F.when(F.col("scale_factor") == 0, 1.0).otherwise(1.0 / F.nullif(F.col("scale_factor"), F.lit(0.0))))
    total = counts.agg(F.countDistinct("bin_idx").alias("n_bins_total"))
    return out.join(F.broadcast(total)).withColumn("n_bins_used", F.lit(used).cast("long")).select(*RESULT)


def spike_in(index: DataFrame, prefix: str) -> DataFrame:
    """From index counts (sample, chrom, mapped): scale by the exogenous reads; ``library_size`` is all mapped reads."""
    if not prefix:
        raise ValueError("an exogenous prefix is needed")
    out = index.groupBy("sample").agg(F.sum("mapped").alias("library_size"), F.sum(F.when(F.col("chrom").startswith(prefix), F.col("mapped")).otherwise(0)).alias("exogenous"))
    if bad := [r["sample"] for r in out.filter("exogenous = 0").select("sample").limit(5).collect()]:
        raise ValueError(f"samples without exogenous reads: {', '.join(bad)}")
    gm = F.exp(geometric_mean(F.col("exogenous").cast("double")).over(_all()))
    out = out.withColumns({"scale_factor": gm / F.col("exogenous"), "norm_factor": F.col("exogenous") / gm})
    return out.withColumns({"n_bins_total": F.lit(0).cast("long"), "n_bins_used": F.lit(0).cast("long")}).select(*RESULT)


#: Name, estimator and samples needed.
METHODS: dict[str, tuple[Callable, int]] = {"tmm": (tmm, 2), "csaw-background": (csaw_background, 2), "cpm": (cpm, 1), "median-of-ratios": (median_of_ratios, 2)}


def estimator(name: str) -> Callable:
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}; known: {', '.join([*METHODS, 'spike-in'])}")
    return METHODS[name][0]

"""Python surface: the commands as functions on files, per-base signal, and scale factors.

Errors: ``KeyError`` for an unknown chromosome, ``ValueError`` for bad options, ``FileNotFoundError`` for missing inputs.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import parse
from readloom.functions.reads import is_scaffold
from readloom.operators import coverage as cov
from readloom.operators import infer, norm, split
from readloom.operators import tracks as trk
from readloom.operators.binning import collapsed
from readloom.operators.filters import COMMAND_LINE, LIBRARY, ReadFilter, funnel, passing, require_paired
from readloom.operators.intervals import tn5_adjusted
from readloom.sources import bam, bigwig, text

__all__ = ["ReadFilter", "ScaleFactorResult", "bam_coverage", "bigwig_aggregate", "bigwig_compare", "collapse_bedgraph", "compute_scale_factors", "get_signal_for_chromosome", "infer_scale", "modify", "multi_bam_coverage", "split_bam", "split_exogenous"]


def session(cores: int | None = None) -> SparkSession:
    return SparkSession.builder.appName("readloom").master(os.environ.get("SPARK_MASTER", f"local[{cores or '*'}]")).getOrCreate() if SparkSession.getActiveSession() is None else SparkSession.getActiveSession()


def _opened(spark: SparkSession, path: str, spec: ReadFilter | None, raw: bool = False, check: bool = True) -> tuple[DataFrame, DataFrame, ReadFilter]:
    bam.validate([path])
    reads, refs, spec = bam.read_bam(spark, path, raw=raw), bam.read_refs(spark, path), spec or LIBRARY
    if check:
        require_paired(reads, spec)
    if spec.blacklist is not None:
        text.check_chromosomes(spec.blacklist, refs)
    return reads, refs, spec


def _apart(path: str, *outputs: str) -> None:
    """A file can't be read and replaced at once."""
    if any(os.path.abspath(path) == os.path.abspath(o) for o in outputs):
        raise ValueError(f"{path} is the input; name another output")


def _written(signal: DataFrame, refs: DataFrame, output: str, ignore_scaffolds: bool = False) -> str:
    kind = text.kind_of(output)
    if kind == "bigwig":
        bigwig.write_bigwig(signal.filter(~is_scaffold()) if ignore_scaffolds else signal, refs, output, "score")
    elif kind == "bedgraph":
        text.write_bedgraph(signal, output, ignore_scaffolds=ignore_scaffolds)
    else:
        raise ValueError("coverage is written as bedGraph or BigWig")
    return output


def bam_coverage(spark: SparkSession, path: str, output: str | None = None, bin_size: int = 50, normalize: str = "raw", scale_factor: float = 1.0, fragment_counts: bool = False, shift=(0, 0, 0, 0), truncate=(None, None), ignore_scaffolds: bool = False, read_filter: ReadFilter | None = COMMAND_LINE) -> str:
    reads, refs, spec = _opened(spark, path, read_filter)
    out = cov.collapsed_coverage(reads, refs, bin_size=bin_size, spec=spec, fragments=fragment_counts, shift=shift, truncate=truncate, ignore_scaffolds=ignore_scaffolds, method=normalize, scale=scale_factor)
    return _written(out, refs, output or f"{path}.bedgraph", ignore_scaffolds)


def multi_bam_coverage(spark: SparkSession, paths: list[str], output: str = "output.tsv", bin_size: int = 50, normalize: str = "raw", scale_factor: float = 1.0, fragment_counts: bool = False, shift=(0, 0, 0, 0), truncate=(None, None), ignore_scaffolds: bool = False, read_filter: ReadFilter | None = COMMAND_LINE, barcode_sets: str | None = None) -> str:
    """``barcode_sets``: a CSV whose column i is the allowlist of file i."""
    bam.validate(paths)
    if text.kind_of(output) != "table":
        raise ValueError("several files give a table: name it .tsv or .txt")
    names = parse.sample_names(paths)
    reads, refs = bam.read_bam(spark, paths, names), bam.read_refs(spark, paths[0])
    if barcode_sets:
        sets = text.read_barcode_sets(spark, barcode_sets)
        known = sets.join(spark.createDataFrame(list(enumerate(names)), "sample_idx int, sample string"), "sample_idx").select("sample", F.col("barcode").alias("cb"))
        reads = reads.join(F.broadcast(known), ["sample", "cb"], "left_semi")
    out = cov.side_by_side(reads, refs, names, collapse=True, bin_size=bin_size, spec=read_filter or LIBRARY, fragments=fragment_counts, shift=shift, truncate=truncate, ignore_scaffolds=ignore_scaffolds, method=normalize, scale=scale_factor)
    text.write_table(out.select("chrom", "start", "end", *names), output)
    return output


def _tracks(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    names = [str(k) for k in range(len(paths))]
    rows = bigwig.read_bigwig(spark, paths, names)
    refs, have = bigwig.read_chroms(spark, paths[0]), [{n for n, _ in bigwig.File(p).chroms.values()} for p in paths]
    for p, mine in zip(paths[1:], have[1:], strict=True):
        if missing := have[0] - mine:
            raise ValueError(f"{p} lacks chromosomes {sorted(missing)}")
    return rows, refs, names


def bigwig_compare(spark: SparkSession, first: str, second: str, output: str, comparison: str, bin_size: int = 50, pseudocount: float = 1e-12, scale_factors: tuple[float, float] = (1.0, 1.0)) -> str:
    rows, refs, (a, b) = _tracks(spark, [first, second])
    out = trk.joined_bins(trk.compared(rows, refs, a, b, comparison, bin_size, pseudocount, scale_factors))
    return bigwig.write_bigwig(out, refs, output)


def bigwig_aggregate(spark: SparkSession, paths: list[str], output: str, method: str, bin_size: int = 50, pseudocount: float = 0.0, scale_factors: list[float] | None = None) -> str:
    if not paths:
        raise ValueError("no tracks")
    rows, refs, names = _tracks(spark, paths)
    return bigwig.write_bigwig(trk.joined_bins(trk.aggregated(rows, refs, names, method, bin_size, pseudocount, scale_factors)), refs, output)


def collapse_bedgraph(spark: SparkSession, path: str, output: str) -> str:
    text.write_bedgraph(collapsed(text.read_bedgraph(spark, path)), output)
    return output


def split_bam(spark: SparkSession, path: str, output: str, read_filter: ReadFilter | None = COMMAND_LINE, command: str = "") -> str:
    _apart(path, output)
    reads, _, spec = _opened(spark, path, read_filter, raw=True)
    return bam.write_bam(passing(reads, spec), output, header_from=path, command=command)


def modify(spark: SparkSession, path: str, output: str, tn5_shift: bool = False, read_filter: ReadFilter | None = COMMAND_LINE, command: str = "") -> str:
    _apart(path, output)
    reads, refs, spec = _opened(spark, path, read_filter, raw=True)
    kept = passing(reads, spec)
    return bam.write_bam(tn5_adjusted(kept, refs) if tn5_shift else kept, output, header_from=path, command=command)


def split_exogenous(spark: SparkSession, path: str, output: str, exogenous_prefix: str, stats: str | None = None, read_filter: ReadFilter | None = COMMAND_LINE, command: str = "") -> dict:
    """Writes ``<output>.endogenous.bam`` and its three siblings; returns (and writes) the statistics."""
    stem = os.path.splitext(output)[0]
    outputs = {name: f"{stem}.{name}.bam" for name in ("endogenous", "exogenous", "both", "unmapped")}
    _apart(path, *outputs.values())
    reads, _, spec = _opened(spark, path, read_filter, raw=True)
    classes = split.classified(reads, exogenous_prefix, spec).persist(StorageLevel.DISK_ONLY)  # four files and the statistics read it
    try:
        for name, rows in split.fanned_out(classes).items():
            bam.write_bam(rows, outputs[name], header_from=path, command=command)
        row = split.split_stats(classes, parse.sample_names([path])[0]).first().asDict()
    finally:
        classes.unpersist()
    if stats:
        with open(stats, "w") as f:
            json.dump(row, f)
    return row


def infer_scale(spark: SparkSession, path: str, min_stable_streak: int = 0, max_starts: int = 0) -> dict:
    """0 as the streak scans everything; 0 as the number of starts uses all."""
    rows = bigwig.read_bigwig(spark, path)
    return infer.infer_scale(rows, bigwig.read_chroms(spark, path), min_stable_streak or None, max_starts or None).first().asDict()


def get_signal_for_chromosome(spark: SparkSession, bam_path: str, chromosome_name: str, bin_size: int = 50, scale_factor: float = 1.0, use_fragment: bool = False, ignore_scaffold_chromosomes: bool = True, read_filter: ReadFilter | None = None) -> np.ndarray:
    """One float32 per base. What reaches the driver is runs of equal bins, and the array is as long as the chromosome."""
    bam.validate([bam_path])
    _, refs, _ = bam.read_header(bam_path)
    length = dict(refs).get(chromosome_name)
    if length is None:
        raise KeyError(f"unknown chromosome {chromosome_name!r}")
    spec = read_filter or LIBRARY
    reads = bam.read_bam(spark, bam_path, chrom=chromosome_name).filter(F.col("chrom") == chromosome_name)
    require_paired(reads, spec)
    names = bam.read_refs(spark, bam_path).filter(F.col("chrom") == chromosome_name)
    runs = cov.collapsed_coverage(reads, names, bin_size=bin_size, spec=spec, fragments=use_fragment, scale=scale_factor).filter("score <> 0").select("start", "end", "score").toArrow()
    out = np.zeros(length, "float32")
    for start, end, score in zip(*(runs.column(c).to_pylist() for c in ("start", "end", "score")), strict=True):
        out[start:end] = score
    return out


@dataclass(frozen=True, repr=False)
class ScaleFactorResult:
    """Lists by sample. ``counts()`` has a row per bin and a column per sample, ``bin_chroms``, ``bin_starts`` and ``bin_ends``
    (1-based, inclusive) an entry per row; they are empty, and the counts None, unless counts were asked for."""

    method: str
    sample_names: list[str]
    scale_factors: list[float]
    norm_factors: list[float]
    library_sizes: list[int]
    n_bins_total: int
    n_bins_used: int
    reference_sample: str | None = None
    matrix: np.ndarray | None = None
    bin_chroms: tuple[str, ...] = ()
    bin_starts: tuple[int, ...] = ()
    bin_ends: tuple[int, ...] = ()

    def counts(self) -> np.ndarray | None:
        return self.matrix

    @property
    def samples(self) -> list[str]:
        return self.sample_names

    def to_dict(self) -> dict:
        lists = ("method", "reference_sample", "n_bins_total", "n_bins_used", "sample_names", "library_sizes", "norm_factors", "scale_factors")
        return {k: getattr(self, k) for k in lists}

    def __repr__(self) -> str:
        return f"ScaleFactorResult(method={self.method!r}, sample_names={self.sample_names!r}, scale_factors={self.scale_factors!r})"


def compute_scale_factors(spark: SparkSession, bam_paths: list[str], method: str = "csaw-background", bin_size: int = 10_000, exclude_top_percent: float = 5.0, reference_sample: str | None = None, logratio_trim: float = 0.3, sum_trim: float = 0.05, exogenous_prefix: str | None = None, use_fragment: bool = False, ignore_scaffold_chromosomes: bool = True, read_filter: ReadFilter | None = None, return_counts: bool = False, sample_names: list[str] | None = None, counts_out: str | None = None) -> ScaleFactorResult:
    if not bam_paths:
        raise ValueError("no BAM files")
    names = sample_names or parse.sample_names(bam_paths)
    if len(set(names)) != len(names) or len(names) != len(bam_paths):
        raise ValueError("every file needs a sample name of its own")
    bam.validate(bam_paths)
    matrix, held, cells = None, None, []
    if method == "spike-in":
        if not exogenous_prefix:
            raise ValueError("spike-in needs an exogenous prefix")
        rows = norm.spike_in(bam.read_index_stats(spark, bam_paths, names), exogenous_prefix)
    else:
        run = norm.estimator(method)
        if len(names) < norm.METHODS[method][1]:
            raise ValueError(f"{method} needs at least {norm.METHODS[method][1]} samples")
        headers = [dict(bam.read_header(p)[1]) for p in bam_paths]
        if any(h != headers[0] for h in headers):
            raise ValueError("the files have different chromosomes")
        reads, refs, spec = bam.read_bam(spark, bam_paths, names), bam.read_refs(spark, bam_paths[0]), read_filter or LIBRARY
        require_paired(reads, spec)
        counts = held = cov.count_matrix(reads, refs, bin_size, spec, use_fragment, ignore_scaffold_chromosomes).persist()  # estimators read it many times
        options = {"tmm": {"reference": reference_sample, "logratio_trim": logratio_trim, "sum_trim": sum_trim}}
        options["csaw-background"] = options["tmm"] | {"exclude_top_percent": exclude_top_percent}
        rows = run(counts, cov.library_sizes(reads, spec), **options.get(method, {}))
        table = cov.wide(counts, names) if counts_out or return_counts else None
        if counts_out:
            text.write_table(table.select("chrom", "start", "end", *[F.col(f"`{n}`").cast("double").alias(n) for n in names]), counts_out)
        if return_counts:
            cells = table.orderBy("chrom", "start").collect()
            matrix = np.array([[r[n] for n in names] for r in cells], "uint64").reshape(-1, len(names))
    by = {r["sample"]: r for r in rows.collect()}
    if held is not None:
        held.unpersist()
    pick = lambda k: [by[n][k] for n in names]
    return ScaleFactorResult(method, names, pick("scale_factor"), pick("norm_factor"), pick("library_size"), by[names[0]]["n_bins_total"], by[names[0]]["n_bins_used"], reference_sample, matrix, tuple(r["chrom"] for r in cells), tuple(r["start"] + 1 for r in cells), tuple(r["end"] for r in cells))


def filter_report(spark: SparkSession, path: str, spec: ReadFilter) -> str:
    """What the filter does to a file's reads, stage by stage, under the settings that differ from no filter."""
    reads, _, spec = _opened(spark, path, spec, check=False)
    plain = ReadFilter()
    set_ = {f.name: getattr(spec, f.name) for f in fields(spec) if not isinstance(getattr(spec, f.name), DataFrame) and getattr(spec, f.name) != getattr(plain, f.name)}
    head = [f"file: {path}", "filter: " + (", ".join(f"{k} {v}" for k, v in set_.items()) or "none")]
    rows = sorted(funnel(reads, spec).collect(), key=lambda r: r["step"])
    return "\n".join([*head, *(f"{r['label']:<36}{r['remaining']:>15,}{r['dropped']:>15,}{r['percent']:>9.2f} %" for r in rows)])

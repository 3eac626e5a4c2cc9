"""Command line."""

from __future__ import annotations

import argparse
import json
import logging
import signal
import sys
import threading

from readloom import __version__, api
from readloom.functions import parse
from readloom.operators.filters import COMMAND_LINE
from readloom.sources import text

#: What the codes of the inference's warnings mean.
WARNINGS = {
    "variable_bin_sizes": "the intervals have no bin size in common; factors per kilobase cannot be told",
    "smoothing_detected": "the second value is no whole multiple of the smallest; the track may be smoothed",
    "pseudocount_detected": "the values look as if a constant had been added; the factor is that of the second value",
    "min_from_small_chrom": "the smallest value is on a chromosome of less than a thousandth of the genome",
}
LEVELS = (logging.ERROR, logging.WARNING, logging.INFO, logging.DEBUG, logging.NOTSET)


def _filters(p: argparse.ArgumentParser) -> None:
    p.add_argument("--strand", type=parse.strand, default="both")
    p.add_argument("--proper-pairs", action="store_true")
    p.add_argument("--min-mapq", type=int, default=20)
    p.add_argument("--min-length", type=int, default=20)
    p.add_argument("--max-length", type=int, default=1000)
    p.add_argument("--min-fragment-len", "--min-fragment-length", type=int)
    p.add_argument("--max-fragment-len", "--max-fragment-length", type=int)
    p.add_argument("--blacklist")
    p.add_argument("--barcode-allowlist")
    p.add_argument("--read-group")
    p.add_argument("--tag")
    p.add_argument("--tag-value")
    for name in ("duplicates", "secondary", "supplementary"):
        p.add_argument(f"--ignore-{name}", action="store_true")


def _coverage(p: argparse.ArgumentParser) -> None:
    p.add_argument("--bin-size", type=int, default=50)
    p.add_argument("--normalize", choices=("raw", "cpm", "rpkm"), default="raw")
    p.add_argument("--scale-factor", type=float, default=1.0)
    p.add_argument("--fragment-counts", action="store_true")
    p.add_argument("--shift", type=parse.shift, default=(0, 0, 0, 0), metavar="F,T,FR,TR")
    p.add_argument("--truncate", type=parse.truncation, default=(None, None), metavar="F,T")
    p.add_argument("--ignore-scaffolds", action="store_true")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="readloom", description=__doc__)
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("-v", "--verbose", type=int, choices=range(5), default=1)
    top.add_argument("--threads", type=int, default=6)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, *aliases):
        return sub.add_parser(name, aliases=aliases)

    p = command("bam-coverage", "coverage")
    p.add_argument("--bam", required=True)
    p.add_argument("-o", "--output")
    _coverage(p)
    _filters(p)
    p = command("multi-bam-coverage", "multi-coverage")
    p.add_argument("--bams", nargs="+", action="extend", required=True)
    p.add_argument("-o", "--output", default="output.tsv")
    p.add_argument("--barcode-sets")
    _coverage(p)
    _filters(p)
    p = command("bigwig-compare", "compare-bigwigs")
    p.add_argument("--bw1", required=True)
    p.add_argument("--bw2", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--comparison", choices=("subtraction", "ratio", "log-ratio"), required=True)
    p.add_argument("--bin-size", type=int, default=50)
    p.add_argument("--pseudocount", type=float, default=1e-12)
    p.add_argument("--scale-factor-bw1", type=float, default=1.0)
    p.add_argument("--scale-factor-bw2", type=float, default=1.0)
    p = command("bigwig-aggregate", "aggregate-bigwigs")
    p.add_argument("--bigwigs", nargs="+", action="extend", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--method", choices=("sum", "mean", "median", "max", "min"), required=True)
    p.add_argument("--bin-size", type=int, default=50)
    p.add_argument("--pseudocount", type=float, default=0.0)
    p.add_argument("--scale-factors", nargs="+", type=float)
    p = command("collapse-bedgraph", "collapse")
    p.add_argument("-i", "--input", default="-")
    p.add_argument("-o", "--output", default="-")
    for name, *aliases in (("split",), ("modify",), ("split-exogenous", "split-spikein")):
        p = command(name, *aliases)
        p.add_argument("-i", "--input", required=True)
        p.add_argument("-o", "--output", required=True)
        if name == "modify":
            p.add_argument("--tn5-shift", action="store_true")
        if name == "split-exogenous":
            p.add_argument("--exogenous-prefix", required=True)
            p.add_argument("--stats")
        _filters(p)
    p = command("bigwig-infer-scale", "infer-scale")
    p.add_argument("bigwig")
    p.add_argument("--format", choices=("table", "tsv", "json"), default="table")
    p.add_argument("-o", "--output")
    p.add_argument("--min-stable-streak", type=int, default=0, help="0 (the default) scans everything")
    p.add_argument("--max-starts", type=int, default=0, help="0 (the default) uses all starts")
    p = command("bam-normalize", "norm-factors")
    p.add_argument("--bams", nargs="+", action="extend")
    p.add_argument("--sample-sheet")
    p.add_argument("--method", choices=("tmm", "csaw-background", "cpm", "median-of-ratios", "spike-in"), default="csaw-background")
    p.add_argument("--bin-size", type=int, default=10_000)
    p.add_argument("--exclude-top-percent", type=float, default=5.0)
    p.add_argument("--reference-sample")
    p.add_argument("--logratio-trim", type=float, default=0.3)
    p.add_argument("--sum-trim", type=float, default=0.05)
    p.add_argument("--exogenous-prefix")
    p.add_argument("--fragment-counts", action="store_true")
    p.add_argument("--ignore-scaffolds", action="store_true")
    p.add_argument("--counts-out")
    p.add_argument("--format", choices=("table", "tsv", "json"), default="table")
    p.add_argument("-o", "--output")
    _filters(p)
    return top


def _spec(spark, a):
    return COMMAND_LINE.having(
        strand=a.strand, proper_pair=a.proper_pairs, min_mapq=a.min_mapq, min_length=a.min_length, max_length=a.max_length, min_fragment=a.min_fragment_len, max_fragment=a.max_fragment_len,
        ignore_duplicates=a.ignore_duplicates, ignore_secondary=a.ignore_secondary, ignore_supplementary=a.ignore_supplementary, read_group=a.read_group, tag=a.tag, tag_value=a.tag_value,
        blacklist=text.read_bed(spark, a.blacklist) if a.blacklist else None, barcodes=text.read_barcodes(spark, a.barcode_allowlist) if a.barcode_allowlist else None,
    )


def shown(rows: list[dict], kind: str) -> str:
    """Rows as an aligned table, as tab-separated text, or as JSON."""
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else ", ".join(v) if isinstance(v, list) else str(v)
    if kind == "json":
        return json.dumps(rows[0] if len(rows) == 1 else rows, indent=2)
    names = list(rows[0])
    lines = [names, *[[cell(r[n]) for n in names] for r in rows]]
    if kind == "tsv":
        return "\n".join("\t".join(x) for x in lines)
    if len(rows) == 1:
        lines = [list(x) for x in zip(*lines, strict=True)]
    width = [max(len(x[k]) for x in lines) for k in range(len(lines[0]))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(x, width, strict=True)).rstrip() for x in lines)


def _put(out: str, a) -> None:
    if a.output:
        with open(a.output, "w") as f:
            f.write(out + "\n")
    else:
        print(out)


def _report(rows: list[dict], a) -> None:
    _put(shown(rows, a.format), a)


def run(a: argparse.Namespace) -> None:
    spark = api.session(a.threads)
    name, line = a.command, " ".join(sys.argv)
    cover = lambda: {k: getattr(a, k) for k in ("bin_size", "normalize", "scale_factor", "fragment_counts", "shift", "truncate", "ignore_scaffolds")} | {"read_filter": _spec(spark, a)}
    if name in ("bam-coverage", "coverage"):
        options = cover()
        if a.verbose >= 2:
            print(api.filter_report(spark, a.bam, options["read_filter"]), file=sys.stderr)
        api.bam_coverage(spark, a.bam, a.output, **options)
    elif name in ("multi-bam-coverage", "multi-coverage"):
        api.multi_bam_coverage(spark, a.bams, a.output, barcode_sets=a.barcode_sets, **cover())
    elif name in ("bigwig-compare", "compare-bigwigs"):
        api.bigwig_compare(spark, a.bw1, a.bw2, a.output, a.comparison, a.bin_size, a.pseudocount, (a.scale_factor_bw1, a.scale_factor_bw2))
    elif name in ("bigwig-aggregate", "aggregate-bigwigs"):
        api.bigwig_aggregate(spark, a.bigwigs, a.output, a.method, a.bin_size, a.pseudocount, a.scale_factors)
    elif name in ("collapse-bedgraph", "collapse"):
        _collapse(spark, a)
    elif name == "split":
        api.split_bam(spark, a.input, a.output, _spec(spark, a), line)
    elif name == "modify":
        api.modify(spark, a.input, a.output, a.tn5_shift, _spec(spark, a), line)
    elif name in ("split-exogenous", "split-spikein"):
        api.split_exogenous(spark, a.input, a.output, a.exogenous_prefix, a.stats, _spec(spark, a), line)
    elif name in ("bigwig-infer-scale", "infer-scale"):
        row = api.infer_scale(spark, a.bigwig, a.min_stable_streak, a.max_starts)
        if a.format == "table":
            for w in row["warnings"]:
                print(f"warning: {WARNINGS[w]}", file=sys.stderr)
        _report([row], a)
    else:
        if bool(a.bams) == bool(a.sample_sheet):
            raise ValueError("give either --bams or --sample-sheet")
        pairs = text.read_sample_sheet(spark, a.sample_sheet) if a.sample_sheet else list(zip(parse.sample_names(a.bams), a.bams, strict=True))
        r = api.compute_scale_factors(spark, [b for _, b in pairs], a.method, a.bin_size, a.exclude_top_percent, a.reference_sample, a.logratio_trim, a.sum_trim, a.exogenous_prefix, a.fragment_counts, a.ignore_scaffolds, _spec(spark, a), sample_names=[s for s, _ in pairs], counts_out=a.counts_out)
        if a.format == "json":
            _put(json.dumps(r.to_dict(), indent=2), a)
        else:
            _report([{"sample": s, "method": r.method, "library_size": n, "norm_factor": f, "scale_factor": x, "n_bins_total": r.n_bins_total, "n_bins_used": r.n_bins_used} for s, n, f, x in zip(r.sample_names, r.library_sizes, r.norm_factors, r.scale_factors, strict=True)], a)


def _collapse(spark, a) -> None:
    from readloom.operators.binning import collapsed

    if a.input == "-":
        lines = spark.createDataFrame([(x,) for x in sys.stdin.read().splitlines()], "value string")  # a pipe ends on the driver
        import tempfile

        with tempfile.TemporaryDirectory() as folder:
            lines.write.mode("overwrite").text(f"{folder}/in")
            _collapsed_to(collapsed(text.read_bedgraph(spark, f"{folder}/in")), a.output)
    else:
        _collapsed_to(collapsed(text.read_bedgraph(spark, a.input)), a.output)


def _collapsed_to(rows, output: str) -> None:
    if output != "-":
        text.write_bedgraph(rows, output)
        return
    for r in rows.orderBy("chrom", "start").toLocalIterator():
        print(r["chrom"], r["start"], r["end"], f"{r['score']:g}", sep="\t")


def main(argv: list[str] | None = None) -> int:
    """0 if all went well (help and version, too), 1 on a failure, 2 on a bad command line. Interrupts end the program while it
    runs; the handler that was there before is put back."""
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    logging.basicConfig(level=LEVELS[a.verbose])
    main_thread = threading.current_thread() is threading.main_thread()
    before = signal.signal(signal.SIGINT, signal.SIG_DFL) if main_thread else None
    try:
        run(a)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        if main_thread:
            signal.signal(signal.SIGINT, before)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Registered queries over files: every source and sink, written to a shared folder and read again, and the functions on files."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import api
from readloom.operators import coverage as cov
from readloom.operators import infer
from readloom.operators.filters import LIBRARY, PYTHON, passing, stage_counts
from readloom.operators.intervals import rewritten
from readloom.plans import fixtures as fx
from readloom.plans.catalog import BASES, EDGES, LIB, MEANS, PASS, PC, SCALES, SHIFT, cov_sql, register, rounded, staged_sql, stop
from readloom.sources import bam, bigwig, text


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and tasks can both open: under ``spark.checkpoint.dir``, or in a local session without one a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared and (shared.startswith("file:") or "://" not in shared):
        path = f"{shared.removeprefix('file://').removeprefix('file:')}/files-{uuid.uuid4().hex}"
        os.makedirs(path)
        return path
    return tempfile.mkdtemp(prefix="readloom-")


COLUMNS = ("qname", "flag", "chrom", "pos", "mapq", "cigar", "seq_len", "ref_span", "mate_pos", "tlen", "cb", "rg")
READS = fx.prelude("refs", "alignments") + "\nSELECT " + ", ".join(COLUMNS) + " FROM alignments WHERE sample = 'S0'"


def _bams(spark, sf_dir, *samples: str) -> list[str]:
    folder, reads = scratch(spark), fx.alignments(spark, sf_dir)
    refs = [(r["chrom"], r["length"]) for r in fx.refs(spark).orderBy("ref_id").collect()]
    return [bam.write_bam(reads.filter(F.col("sample") == s), f"{folder}/{s}.bam", refs=refs, index=True) for s in samples]


@register("src_bam", READS)
def _bam(spark, sf_dir):
    return bam.read_bam(spark, _bams(spark, sf_dir, "S0")[0], split_bytes=65536).select(*COLUMNS)


@register("src_bam_chromosome", READS + " AND chrom = 'chr2'")
def _bam_chromosome(spark, sf_dir):
    return bam.read_bam(spark, _bams(spark, sf_dir, "S0")[0], chrom="chr2").filter("chrom = 'chr2'").select(*COLUMNS)


@register("src_bam_index", fx.prelude("refs", "alignments") + """
SELECT 'S0' AS sample, r.ref_id, r.chrom, r.length::BIGINT AS length, count(a.flag) FILTER (a.flag & 4 = 0) AS mapped, count(a.flag) FILTER (a.flag & 4 <> 0) AS unmapped
FROM refs r LEFT JOIN alignments a ON a.sample = 'S0' AND a.ref_id = r.ref_id GROUP BY ALL""")
def _bam_index(spark, sf_dir):
    return bam.read_index_stats(spark, _bams(spark, sf_dir, "S0"))


def _bigwig(spark, sf_dir, track: int) -> str:
    rows = fx.tracks(spark, sf_dir).filter(F.col("track") == track).select("chrom", "start", "end", "value")
    return bigwig.write_bigwig(rows, fx.track_refs(spark, sf_dir), f"{scratch(spark)}/{track}.bw")


@register("src_bigwig", fx.prelude("tracks") + "\nSELECT chrom, start, stop, value FROM tracks WHERE track = 0")
def _bigwig_rows(spark, sf_dir):
    return stop(bigwig.read_bigwig(spark, _bigwig(spark, sf_dir, 0)).select("chrom", "start", "end", "value"))


@register("src_bigwig_chromosomes", fx.prelude("track_refs") + "\nSELECT ref_id, chrom, length FROM track_refs")
def _bigwig_chromosomes(spark, sf_dir):
    return bigwig.read_chroms(spark, _bigwig(spark, sf_dir, 0)).select("ref_id", "chrom", "length")


@register("snk_bedgraph", cov_sql(bs=500, tail="\nSELECT chrom, start + 1 AS start, stop + 1 AS stop, CAST(n AS DOUBLE) AS score FROM cov"))
def _bedgraph(spark, sf_dir):
    path = f"{scratch(spark)}/cov.bedgraph"
    text.write_bedgraph(cov.pileup(fx.alignments(spark, sf_dir), fx.refs(spark), 500), path, base=1)
    return stop(text.read_bedgraph(spark, path))


@register("snk_table", cov_sql(sample=True, tail="\nSELECT chrom, start, stop, " + ", ".join(f"CAST(sum(n) FILTER (sample = 'S{k}') AS DOUBLE) AS S{k}" for k in range(3)) + " FROM cov GROUP BY ALL"))
def _table(spark, sf_dir):
    path = f"{scratch(spark)}/cov.tsv"
    text.write_table(cov.side_by_side(fx.alignments(spark, sf_dir), fx.refs(spark), ["S0", "S1", "S2"], bin_size=1000), path)
    return stop(spark.read.csv(path, sep="\t", header=True, schema="chrom string, start long, end long, S0 double, S1 double, S2 double"))


TWO = """, wide AS (SELECT chrom, start, stop, CAST(sum(n) FILTER (sample = 'S0') AS DOUBLE) AS S0, CAST(sum(n) FILTER (sample = 'S1') AS DOUBLE) AS S1 FROM cov WHERE sample <> 'S2' GROUP BY ALL),
f AS (SELECT *, CASE WHEN start = lag(stop) OVER w AND S0 = lag(S0) OVER w AND S1 = lag(S1) OVER w THEN 0 ELSE 1 END AS new FROM wide WINDOW w AS (PARTITION BY chrom ORDER BY start)),
g AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start) AS grp FROM f)
SELECT chrom, min(start) AS start, max(stop) AS stop, any_value(S0) AS S0, any_value(S1) AS S1 FROM g GROUP BY chrom, grp"""


@register("cmd_multi_bam_coverage", cov_sql(sample=True, bs=100, tail=TWO))
def _multi(spark, sf_dir):
    paths = _bams(spark, sf_dir, "S0", "S1")
    path = api.multi_bam_coverage(spark, paths, f"{os.path.dirname(paths[0])}/o.tsv", bin_size=100, read_filter=LIBRARY)
    return stop(spark.read.csv(path, sep="\t", header=True, schema="chrom string, start long, end long, S0 double, S1 double"))


S0 = "\nSELECT qname, flag, chrom, pos, tlen, mate_pos FROM "
OPEN = staged_sql()


@register("cmd_split", OPEN + S0 + "staged WHERE sample = 'S0' AND fail_stage IS NULL AND flag & 16 = 0")
def _split(spark, sf_dir):
    (path,) = _bams(spark, sf_dir, "S0")
    out = api.split_bam(spark, path, f"{os.path.dirname(path)}/forward.bam", PYTHON.having(strand="forward"))
    return bam.read_bam(spark, out).select("qname", "flag", "chrom", "pos", "tlen", "mate_pos")


@register("cmd_split_exogenous", staged_sql(**LIB) + f""", c AS (SELECT CASE WHEN flag & 4 <> 0 OR flag & 512 <> 0 OR flag & 1024 <> 0 OR flag & 256 <> 0 THEN 'unmapped' WHEN fail_stage IS NOT NULL THEN 'none' WHEN starts_with(chrom, '{fx.SPIKE}') THEN 'exogenous' ELSE 'endogenous' END AS file FROM staged WHERE sample = 'S0')
SELECT f.file, count(c.file) AS n FROM (VALUES ('endogenous'), ('exogenous'), ('both'), ('unmapped')) AS f(file) LEFT JOIN c USING (file) GROUP BY f.file""")
def _split_exogenous(spark, sf_dir):
    (path,) = _bams(spark, sf_dir, "S0")
    api.split_exogenous(spark, path, f"{os.path.dirname(path)}/x.bam", fx.SPIKE, read_filter=LIBRARY)
    names = ("endogenous", "exogenous", "both", "unmapped")
    each = [bam.read_bam(spark, f"{os.path.dirname(path)}/x.{n}.bam").agg(F.count("*").alias("n")).select(F.lit(n).alias("file"), "n") for n in names]
    out = each[0]
    for rows in each[1:]:
        out = out.unionByName(rows)
    return out


MEAN = "(" + MEANS + f" + 3 * {PC}) / 3"


@register("cmd_bigwig_aggregate", BASES + f""", b AS (SELECT {EDGES}, CAST({MEAN} AS FLOAT) AS v FROM wide GROUP BY chrom, bin)
SELECT chrom, sum(stop - start)::BIGINT AS bases, round(sum(CAST(v AS DOUBLE) * (stop - start)), 1) + 0.0 AS area FROM b GROUP BY chrom""")
def _aggregate(spark, sf_dir):
    paths = [_bigwig(spark, sf_dir, k) for k in range(3)]
    out = api.bigwig_aggregate(spark, paths, f"{os.path.dirname(paths[0])}/mean.bw", "mean", 50, PC, SCALES)
    width = F.col("end") - F.col("start")
    return bigwig.read_bigwig(spark, out).groupBy("chrom").agg(F.sum(width).alias("bases"), (F.round(F.sum(F.col("value").cast("double") * width), 1) + 0.0).alias("area"))


@register("cmd_signal", cov_sql(bs=1, where="chrom = 'chr3'", tail="\nSELECT start // 1000 AS part, CAST(sum(n) AS DOUBLE) AS total FROM cov WHERE sample = 'S0' GROUP BY ALL", sample=True))
def _signal(spark, sf_dir):
    import numpy as np

    (path,) = _bams(spark, sf_dir, "S0")
    x = api.get_signal_for_chromosome(spark, path, "chr3", 1, read_filter=LIBRARY)
    sums = np.add.reduceat(x.astype("float64"), np.arange(0, len(x), 1000))
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(sums)], "part long, total double")


@register("cmd_scale_factors", staged_sql(**LIB) + ", n AS (SELECT sample, count(*) FILTER (fail_stage IS NULL) AS n FROM staged WHERE sample <> 'S2' GROUP BY sample)\nSELECT sample, n AS library_size, 1.0::DOUBLE AS norm_factor, round(1e6 / n, 6) AS scale_factor FROM n")
def _scale_factors(spark, sf_dir):
    r = api.compute_scale_factors(spark, _bams(spark, sf_dir, "S0", "S1"), "cpm", read_filter=LIBRARY)
    rows = list(zip(r.sample_names, r.library_sizes, r.norm_factors, [round(x, 6) for x in r.scale_factors], strict=True))
    return spark.createDataFrame(rows, "sample string, library_size long, norm_factor double, scale_factor double")


# text sources ----------------------------------------------------------------------------------------------------------
@register("src_bed", fx.prelude("refs", "blacklist") + "\nSELECT chrom, start::BIGINT AS start, stop::BIGINT AS stop, stop::BIGINT - 1 AS stop_compat FROM blacklist")
def _bed(spark, sf_dir):
    path = f"{scratch(spark)}/black.bed"
    fx.blacklist(spark).select(F.concat_ws("\t", "chrom", "start", "end")).write.text(path)
    whole, short = text.read_bed(spark, path), text.read_bed(spark, path, compat=True)
    return stop(whole.join(short.withColumnRenamed("end", "stop_compat"), ["chrom", "start"]))


LISTED = ", ".join(f"('{b}')" for b in fx.BARCODES)


@register("src_barcodes", f"SELECT barcode FROM (VALUES {LISTED}) AS t(barcode)")
def _barcodes(spark, sf_dir):
    path = f"{scratch(spark)}/barcodes.csv"
    both = fx.barcodes(spark).unionByName(fx.barcodes(spark))
    both.withColumn("note", F.lit("x")).coalesce(1).write.csv(path, header=True)
    return text.read_barcodes(spark, path)


@register("src_barcode_sets", f"SELECT (row_number() OVER () - 1)::INT % 2 AS sample_idx, barcode FROM (VALUES {LISTED}) AS t(barcode)")
def _barcode_sets(spark, sf_dir):
    path = f"{scratch(spark)}/sets.csv"
    with open(path, "w") as f:
        f.write("\n".join(["a,b", *(f"{x}," if k % 2 == 0 else f",{x}" for k, x in enumerate(fx.BARCODES))]) + "\n")
    return text.read_barcode_sets(spark, path)


@register("src_sample_sheet", "SELECT concat('S', i) AS sample, concat('/data/', i, '.bam') AS bam FROM range(5) AS r(i)")
def _sample_sheet(spark, sf_dir):
    path = f"{scratch(spark)}/sheet.csv"
    with open(path, "w") as f:
        f.write("\n".join(["sample,bam", *(f"S{k},/data/{k}.bam" for k in range(5))]) + "\n")
    return spark.createDataFrame(text.read_sample_sheet(spark, path), "sample string, bam string")


# branches that the other queries don't meet ----------------------------------------------------------------------------
@register("flt_unplaced", staged_sql().replace("FROM alignments a", "FROM (SELECT * REPLACE (CASE WHEN tlen = 0 THEN -1 ELSE ref_id END AS ref_id, CASE WHEN mapq = 7 THEN NULL ELSE pos END AS pos) FROM alignments) a")
          + "\nSELECT sample, CASE WHEN fail_stage IS NOT NULL THEN fail_stage WHEN ref_id < 0 THEN 'no_reference' WHEN pos IS NULL THEN 'mapq' ELSE 'pass' END AS stage, count(*) AS n FROM staged GROUP BY ALL")
def _unplaced(spark, sf_dir):
    reads = fx.alignments(spark, sf_dir).withColumns({"ref_id": F.when(F.col("tlen") == 0, -1).otherwise(F.col("ref_id")), "pos": F.when(F.col("mapq") == 7, None).otherwise(F.col("pos"))})
    return stage_counts(reads, PYTHON, ("sample",)).select("sample", F.coalesce("fail_stage", F.lit("pass")).alias("stage"), "n")


@register("prj_rewritten", PASS + """,
m AS (SELECT sample, chrom, tlen, pos - 1 - CASE WHEN flag & 80 = 80 THEN -5 WHEN flag & 16 <> 0 THEN -4 ELSE 4 END AS s, CASE WHEN flag & 80 = 16 THEN 1 WHEN flag & 80 = 64 THEN -1 ELSE 0 END AS d FROM reads)
SELECT sample, chrom, count(*) AS n, CAST(sum(greatest(s, 0) + 1) AS BIGINT) AS starts, CAST(sum(CASE WHEN tlen < 0 THEN tlen - d ELSE tlen + d END) AS BIGINT) AS tlens FROM m GROUP BY ALL""")
def _rewritten(spark, sf_dir):
    out = rewritten(passing(fx.alignments(spark, sf_dir), LIBRARY), fx.refs(spark), SHIFT)
    return out.groupBy("sample", "chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("starts"), F.sum("tlen").alias("tlens"))


@register("cov_collapsed_samples", cov_sql(sample=True, bs=100, tail=TWO))
def _collapsed_samples(spark, sf_dir):
    return stop(cov.side_by_side(fx.alignments(spark, sf_dir).filter("sample <> 'S2'"), fx.refs(spark), ["S0", "S1"], collapse=True, bin_size=100))


def _decision(name: str, factor: float, want: str) -> None:
    sql = fx.prelude("norm_track") + f""", v AS (SELECT CAST(CAST(CAST(value AS DOUBLE) * {factor} AS FLOAT) AS DOUBLE) AS v FROM norm_track), g AS (SELECT min(v) AS a FROM v)
SELECT '{want}' AS norm_method, round(1 / a, 6) AS scale_factor, round(CASE WHEN '{want}' = 'RPKM' THEN 1e9 / (a * 10) ELSE 1e6 / a END, 3) AS library_size, 10::BIGINT AS bin_size, a AS min_val FROM g"""

    @register(name, sql)
    def run(spark, sf_dir):
        track = fx.norm_track(spark, sf_dir).withColumn("value", (F.col("value").cast("double") * factor).cast("float"))
        out = infer.infer_scale(track, fx.norm_refs(spark, sf_dir)).select("norm_method", "scale_factor", "library_size", "bin_size", "min_val")
        return rounded(rounded(out, 6, "scale_factor"), 3, "library_size")


_decision("inf_ambiguous", 10.0, "Ambiguous")
_decision("inf_rpkm", 128.0, "RPKM")
_decision("inf_unknown", 1e9, "Unknown")

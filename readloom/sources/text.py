"""Text formats: BED, bedGraph, barcode lists, sample sheets, tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.reads import is_scaffold

KINDS = {"bedgraph": "bedgraph", "bdg": "bedgraph", "bigwig": "bigwig", "bw": "bigwig", "tsv": "table", "txt": "table"}


def kind_of(path: str) -> str:
    """Output kind by extension."""
    end = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if end not in KINDS:
        raise ValueError(f"unknown output type of {path!r}; known: {', '.join(KINDS)}")
    return KINDS[end]


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line"))
    return lines.filter((F.col("line") != "") & ~F.col("line").startswith("#")).select(F.split("line", " ").alias("f"))


def read_bed(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """(chrom, start, end), 0-based half-open; an empty file is an error. ``compat`` leaves out every last base."""
    out = _fields(spark, path).filter((F.size("f") >= 3) & ~F.get("f", F.lit(0)).isin("track", "browser"))
    out = out.select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).cast("long").alias("start"), (F.get("f", F.lit(2)).cast("long") - int(compat)).alias("end"))
    if out.isEmpty():
        raise ValueError(f"{path} has no intervals")
    return out


def check_chromosomes(intervals: DataFrame, refs: DataFrame) -> DataFrame:
    """The intervals; those on a chromosome the references lack are an error."""
    odd = intervals.join(F.broadcast(refs.select("chrom")), "chrom", "left_anti").select("chrom").distinct().limit(5).collect()
    if odd:
        raise ValueError(f"unknown chromosomes: {', '.join(r[0] for r in odd)}")
    return intervals


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, score): blank and comment lines and those of fewer than four fields are skipped, bad numbers are errors."""
    f = lambda k: F.get("f", F.lit(k))
    return _fields(spark, path).filter(F.size("f") >= 4).select(f(0).alias("chrom"), f(1).cast("long").alias("start"), f(2).cast("long").alias("end"), f(3).cast("double").alias("score"))


def _to_file(rows: DataFrame, path: str, header: bool = False) -> None:
    """Tab-separated rows as one file: tasks write parts in order beside it, then they are put together under its name.

    The copy goes through the file system of the path, a buffer at a time; what was there before stays until it is whole."""
    spark = rows.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    rows.write.csv(parts, sep="\t")
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    names = sorted(f.getPath().getName() for f in fs.listStatus(at(parts)))
    out = fs.create(at(f"{parts}/whole"), True)
    if header:
        out.write(bytearray(("\t".join(rows.columns) + "\n").encode()))
    for name in (n for n in names if n.startswith("part-")):
        source = fs.open(at(f"{parts}/{name}"))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
        source.close()
    out.close()
    fs.delete(at(path), True)
    fs.rename(at(f"{parts}/whole"), at(path))
    fs.delete(at(parts), True)


def write_bedgraph(signal: DataFrame, path: str, value: str = "score", ignore_scaffolds: bool = False, base: int = 0, single: bool = True) -> None:
    """Tab-separated, without header, sorted by (chrom, start); ``base`` 1 writes 1-based coordinates. ``single=False`` leaves a folder of parts."""
    out = signal.filter(~is_scaffold()) if ignore_scaffolds else signal
    out = out.select("chrom", (F.col("start") + base).alias("start"), (F.col("end") + base).alias("end"), value).orderBy("chrom", "start")
    if single:
        _to_file(out, path)
    else:
        out.write.mode("overwrite").csv(path, sep="\t")


def write_table(rows: DataFrame, path: str, single: bool = True) -> None:
    """Tab-separated with a header, sorted by (chrom, start). ``single=False`` leaves a folder of parts."""
    out = rows.orderBy("chrom", "start")
    if single:
        _to_file(out, path, header=True)
    else:
        out.write.mode("overwrite").csv(path, sep="\t", header=True)


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """(barcode), distinct: a CSV with that column, or a plain list; a missing value in the column is an error."""
    first = spark.read.text(path).limit(1).collect()
    names = [c.strip() for c in first[0][0].split(",")] if first else []
    if "barcode" in names:
        rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        value = F.when(F.col("barcode").isNull(), F.raise_error(F.lit(f"{path} has a row without a barcode"))).otherwise(F.col("barcode"))
        return rows.select(value.cast("string").alias("barcode")).distinct()
    if len(names) > 1:
        raise ValueError(f"{path} has no barcode column")
    return spark.read.text(path).select(F.trim("value").alias("barcode")).filter("barcode <> ''").distinct()


def read_barcode_sets(spark: SparkSession, path: str) -> DataFrame:
    """(sample_idx, barcode): column i is the list of sample i; empty cells are skipped."""
    wide = spark.read.csv(path, header=True)
    cells = F.array(*[F.struct(F.lit(k).alias("sample_idx"), F.col(f"`{c}`").alias("barcode")) for k, c in enumerate(wide.columns)])
    return wide.select(F.explode(cells).alias("c")).select("c.*").filter("barcode is not null").distinct()


def read_sample_sheet(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """[(sample, bam)]; a missing value is an error."""
    rows = spark.read.csv(path, header=True).collect()
    if rows and not {"sample", "bam"} <= set(rows[0].asDict()):
        raise ValueError(f"{path} needs the columns sample and bam")
    if any(r["sample"] is None or r["bam"] is None for r in rows):
        raise ValueError(f"{path} has a row without a sample or bam")
    return [(r["sample"], r["bam"]) for r in rows]

"""Genomics tables derived from the synthetic star schema: the same SQL text for Spark and, with ``//`` for ``div``, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REFS = """SELECT * FROM (VALUES (0,'chr1',200000),(1,'chr2',150000),(2,'chr3',100003),(3,'chrM',16569),
  (4,'chrUn_s1',8000),(5,'chr1_alt',5000),(6,'chr2_random',6000),(7,'spike_chrI',30000)) AS t(ref_id,chrom,length)"""

ALIGNMENTS = """SELECT concat('S',CAST(l_orderkey%3 AS STRING)) AS sample, concat('r',CAST(l_orderkey AS STRING)) AS qname,
    CAST(1 + CASE WHEN l_discount>=0.015 THEN 2 ELSE 0 END + CASE WHEN l_orderkey%97=0 THEN 4 ELSE 0 END
      + CASE WHEN l_linestatus='F' THEN 16 ELSE 0 END + CASE WHEN l_linenumber%2=1 THEN 64 ELSE 128 END
      + CASE WHEN l_partkey%31=0 THEN 256 ELSE 0 END + CASE WHEN l_partkey%41=0 THEN 512 ELSE 0 END
      + CASE WHEN l_orderkey%23=0 THEN 1024 ELSE 0 END + CASE WHEN l_orderkey%37=0 THEN 2048 ELSE 0 END AS INT) AS flag,
    rid AS ref_id, chrom, CAST(p AS BIGINT) AS pos,
    CAST(CASE WHEN l_partkey%50=0 THEN NULL ELSE l_partkey%61 END AS INT) AS mapq,
    CAST(sl AS INT) AS seq_len, CAST(sl+indel AS INT) AS ref_span,
    CASE WHEN indel>0 THEN concat(CAST(sl-10 AS STRING),'M',CAST(indel AS STRING),'D10M')
         WHEN indel<0 THEN concat(CAST(sl-10+indel AS STRING),'M',CAST(-indel AS STRING),'I10M')
         ELSE concat(CAST(sl AS STRING),'M') END AS cigar,
    CAST(tl AS INT) AS tlen,
    CAST(CASE WHEN tl<0 THEN greatest(1,p+sl+indel+tl) ELSE greatest(1,p+tl-sl-indel) END AS BIGINT) AS mate_pos,
    CASE WHEN l_partkey%11=0 THEN NULL ELSE concat('BC',CAST(l_suppkey%16 AS STRING)) END AS cb,
    concat('RG_',l_returnflag) AS rg, concat('VP',CAST(l_linenumber AS STRING)) AS vp
FROM (SELECT a.*, r.chrom, r.length,
    1+(l_orderkey*7919+l_linenumber*104729+l_partkey*31)%r.length AS p,
    CASE WHEN l_orderkey%53=0 THEN 0 WHEN l_linestatus='F' THEN -(100+l_partkey%400) ELSE 100+l_partkey%400 END AS tl
    FROM (SELECT *,
        CAST(CASE WHEN l_partkey%20<6 THEN 0 WHEN l_partkey%20<11 THEN 1 WHEN l_partkey%20<15 THEN 2 ELSE l_partkey%20-12 END AS INT) AS rid,
        19+CAST(l_quantity AS INT) AS sl, CAST(l_partkey%7 AS INT)-3 AS indel FROM lineitem) a JOIN refs r ON a.rid=r.ref_id) b"""

TRACKS = """SELECT CAST(event_id%3 AS INT) AS track, CASE WHEN (event_id div 3)%2=0 THEN 'chr1' ELSE 'chr2' END AS chrom,
    (event_id div 6)*20 AS start, (event_id div 6)*20+5+user_id%16 AS stop, CAST(value AS FLOAT) AS value FROM events"""

TRACK_REFS = """SELECT r.ref_id, r.chrom, CAST((m div 6 + 1)*20+7 AS BIGINT) AS length
FROM (SELECT max(event_id) AS m FROM events) e CROSS JOIN (VALUES (0,'chr1'),(1,'chr2')) AS r(ref_id,chrom)"""

NORM_TRACK = """SELECT CASE WHEN event_id%2=0 THEN 'chr5' ELSE 'chr7' END AS chrom, event_id*10 AS start, event_id*10+10 AS stop,
    CAST((1+user_id%5)*0.015625 AS FLOAT) AS value FROM events"""

BLACKLIST = """SELECT chrom, 500+ref_id*37 AS start, 1200+ref_id*37 AS stop FROM refs
UNION ALL SELECT chrom, length-900, length-100 FROM refs"""

BARCODES = [f"BC{k}" for k in range(8)]
READ_GROUP, TAG, TAG_VALUE, SPIKE = "RG_A", "VP", "VP3", "spike_"


def _sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    for name in tables:
        text = text.replace(f"FROM {name})", f"FROM {{{name}}})").replace(f"FROM {name}", f"FROM {{{name}}}") if f"FROM {{{name}}}" not in text else text
        text = text.replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    return spark.sql(text, **tables)


def refs(spark: SparkSession) -> DataFrame:
    return spark.sql(REFS).withColumn("length", F.col("length").cast("long"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _sql(spark, ALIGNMENTS, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"), refs=refs(spark))
    return out.withColumn("tags", F.create_map(F.lit("VP"), F.col("vp"), F.lit("RG"), F.col("rg"))).drop("vp")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, TRACKS, events=_events(spark, sf_dir)).withColumnRenamed("stop", "end")


def track_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, TRACK_REFS, events=_events(spark, sf_dir))


def norm_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, NORM_TRACK, events=_events(spark, sf_dir)).withColumnRenamed("stop", "end")


def norm_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _events(spark, sf_dir).agg(((F.max("event_id") + 1) * 10).alias("length"))
    return spark.sql("SELECT * FROM (VALUES (0,'chr5'),(1,'chr7')) AS t(ref_id,chrom)").join(F.broadcast(top))


def blacklist(spark: SparkSession) -> DataFrame:
    return _sql(spark, BLACKLIST, refs=refs(spark)).withColumnRenamed("stop", "end")


def barcodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b,) for b in BARCODES], "barcode string")


def duck(text: str) -> str:
    return text.replace(" div ", " // ")


def prelude(*names: str) -> str:
    """The tables as common table expressions for DuckDB."""
    known = {"refs": REFS, "alignments": ALIGNMENTS, "tracks": TRACKS, "track_refs": TRACK_REFS, "norm_track": NORM_TRACK, "blacklist": BLACKLIST}
    return "WITH " + ",\n".join(f"{n} AS ({duck(known[n])})" for n in names)

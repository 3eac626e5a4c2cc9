"""The corpus operators' queries, one per operator, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle
from ._tables import documents
from .fingerprints import op3_fingerprints
from .licenses import op1_license_scan
from .mixing import interleaved, op10_mixing
from .near_dedup import deduplicated, op2_near_dedup
from .packing import op5_best_fit_packing, op9_token_matrices
from .pii import op7_pii
from .quality import filtered, op6_quality_rules
from .secrets import op4_secret_scan
from .sharding import op8_sharding


#: More of the operators' outputs, for which SQL says the same: texts, the mix itself, the documents that stay.
def lines_removed(spark, sf_dir: str):
    """At a limit that even the smaller tables pass."""
    docs = documents(spark, sf_dir)
    kept = filtered(docs, max_docs=5).withColumn("lines", F.size(F.split("text", "\n")))
    before = docs.select("doc_id", F.size(F.split("text", "\n")).alias("before"))
    return kept.join(before, "doc_id").select("doc_id", (F.col("before") - F.col("lines")).cast("long").alias("n_cut"), "n_chars", F.md5("text").alias("text_md5"))


def mix_interleaved(spark, sf_dir: str):
    out = interleaved(documents(spark, sf_dir))
    return out.select("slot", F.col("idx").cast("long").alias("idx"), "block", "doc_id", "start", "length")


def documents_kept(spark, sf_dir: str):
    return deduplicated(documents(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_md5"))


def queries():
    ops = (op1_license_scan, op2_near_dedup, op3_fingerprints, op4_secret_scan, op5_best_fit_packing, op6_quality_rules, op7_pii, op8_sharding, op9_token_matrices, op10_mixing)
    return {f.__name__: f for f in (*ops, lines_removed, mix_interleaved, documents_kept)}


def oracle_sql():
    return {
        "op1_license_scan": oracle.license_scan(), "op2_near_dedup": oracle.near_dedup(), "op6_quality_rules": oracle.quality_rules(), "op10_mixing": oracle.mixing(),
        "lines_removed": oracle.lines_removed(5), "mix_interleaved": oracle.mixing(interleaved=True),
        "documents_kept": f"SELECT doc_id, md5(text) AS text_md5 FROM documents JOIN ({oracle.near_dedup(5)}) USING (doc_id) WHERE kept",
    }

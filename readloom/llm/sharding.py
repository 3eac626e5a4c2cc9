"""Sharding by a hierarchical weighted hash tree (law ``key``).

Method. Shards are the leaves of a tree of regions, racks and shards. At every level each child draws
``-ln(u) / weight`` with ``u`` hashed from the document id and the child's name; the smallest draw wins. A child wins
with probability proportional to its weight, and a change of weight moves documents only between that child and its
siblings: movement stays within the subtree. Shards beyond the ``planned`` tree each open a region of weight one, so
one more shard changes one weight, that of the new region, and takes documents only into itself.

Slots are numbered without one task per shard: shards are cut into hash buckets, the buckets' counts are added up
(``shards x buckets`` rows, a fixed number), and rows are numbered within their bucket.

Edge cases: null ids share one shard; null texts have size 8 and the checksum of no bytes; equal rows get the shard of
their id and slots of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import documents

BUCKETS = 512


def tree(shards: int, planned: int = 24, regions: int = 2, racks: int = 3, weights: dict[int, float] | None = None) -> list:
    """[(region, weight, [(rack, weight, [(shard, weight)])])]; an inner weight is the sum of its children's."""
    per = -(-planned // (regions * racks))
    leaf = lambda s: (s, float((weights or {}).get(s, 1.0)))
    groups = [[list(range(planned))[(r * racks + k) * per : (r * racks + k + 1) * per] for k in range(racks)] for r in range(regions)]
    groups = [[[s for s in rack if s < shards] for rack in region] for region in groups] + [[[s]] for s in range(planned, shards)]
    out = []
    for r, region in enumerate(groups):
        kids = [(f"{r}.{k}", sum(w for _, w in leaves), leaves) for k, rack in enumerate(region) if (leaves := [leaf(s) for s in rack])]
        if kids:
            out.append((str(r), sum(w for _, w, _ in kids), kids))
    return out


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / float(2**53)
    return -F.ln(u) / F.lit(weight)


def _pick(key: Column, kids: list, prefix: str, then) -> Column:
    """The winner's ``then``: a chain of conditions, of which only the winner's branch is evaluated."""
    if len(kids) == 1:
        return then(kids[0])
    draws = [_draw(key, f"{prefix}{kid[0]}", kid[1]) for kid in kids]

    def chosen(d: Column) -> Column:
        least, out = F.array_min(d), then(kids[-1])
        for k in reversed(range(len(kids) - 1)):
            out = F.when(F.get(d, F.lit(k)) == least, then(kids[k])).otherwise(out)
        return out

    return F.get(F.transform(F.array(F.array(*draws)), chosen), F.lit(0))


def shard_of(key: Column, nodes: list) -> Column:
    rack = lambda r: _pick(key, r[2], "shard:", lambda s: F.lit(s[0]))
    region = lambda g: _pick(key, g[2], "rack:", rack)
    return _pick(key, nodes, "region:", region)


def assigned(docs: DataFrame, shards: int = 24, planned: int = 24, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row per document: size, checksum, shard, slot and the shard under ``shards + 1``."""
    key = F.col("doc_id")
    plain = F.coalesce(F.col(text), F.lit(""))
    place = [shard_of(key, tree(shards, planned)).alias("shard"), F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(buckets)).cast("int").alias("bucket")]
    rows = docs.select("doc_id", (F.octet_length(plain) + 8).cast("long").alias("size"), F.crc32(plain.cast("binary")).alias("text_crc32"), *place, shard_of(key, tree(shards + 1, planned)).alias("grown_shard"))
    # counts need the ids alone: this scan reads one narrow column
    counts = docs.select("doc_id").select(*place).groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # at most shards x buckets rows
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("own", F.row_number().over(own)).join(F.broadcast(firsts), ["shard", "bucket"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("own") - 1).cast("long").alias("slot"), "grown_shard")


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return assigned(documents(spark, sf_dir))

"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Method. Source sizes give targets (weights, each at most ``cap`` times its source, the excess reshared by weight until
none is above). Every source's documents are shuffled by hash and laid end to end; the stream is cut into blocks of
``block`` tokens, read again from the start once used up. The schedule has one slot per block needed: slot ``t`` has
the golden-ratio point ``frac(t * phi)``, which falls into one source's stretch of the cumulative weights; slots are
ranked per source, and rank ``k`` takes the source's block ``k mod blocks``. Points are not perfectly even, so a
source may get a few slots too many (its surplus ends with its target) or too few (appended at the end). The last slot
of a source is cut at the target, so what is taken meets the target to the word.

No step puts a source into one task: streams are cut by leading hash digits and slots by number, their sums are added
up per cut, and rows are numbered within it. Point-to-source search is an equality join on cells of the unit interval.

Edge cases: a null text has size 0; null sources are one source, last in order; documents without words are returned
and never taken; equal rows are separate documents; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import documents, written
from .quality import words

WEIGHTS = (3, 1, 2)
GOLDEN, CELLS = 2654435769, 4096  # 2^32 / phi


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source: index, size and target. ``min(cap * size, level * weight)`` with the level that makes the sum right.

    One row per source enters, so the windows over all of them are small."""
    whole, by_name = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    out = sizes.withColumn("idx", F.row_number().over(by_name) - 1)
    out = out.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("idx") % len(weights) + 1))
    out = out.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("budget", F.least(F.lit(share), F.lit(cap)) * F.sum("source_size").over(whole))
    rank = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("w"), "idx")
    full = F.sum("most").over(rank.rowsBetween(Window.unboundedPreceding, 0)) + F.col("most") / F.col("w") * F.coalesce(F.sum("w").over(rank.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    out = out.withColumn("capped", full < F.col("budget"))
    level = (F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(whole), F.lit(0.0))) / F.nullif(F.sum(F.when(~F.col("capped"), F.col("w"))).over(whole), F.lit(0.0))
    return out.select("idx", "source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.least("most", level * F.col("w"))).alias("target"))


def schedule(spark, plan: DataFrame, block: int) -> DataFrame:
    """The slots: (idx, slot, rank, block, tokens). ``plan`` has one row per source."""
    T, size = F.col("take"), F.col("source_size")
    plan = plan.withColumn("take", F.round("target").cast("long")).withColumn("blocks", F.ceil(size / block).cast("long"))
    plan = plan.withColumn("rest", F.when(size > 0, T % size).otherwise(0)).withColumn("need", F.when(size > 0, F.expr("take div source_size") * F.col("blocks") + F.ceil(F.col("rest") / block)).otherwise(0).cast("long"))
    after = F.sum("need").over(Window.partitionBy(F.lit(0)).orderBy("idx"))
    plan = plan.withColumn("hi", after).withColumn("lo", after - F.col("need"))
    n = plan.agg(F.sum("need")).first()[0] or 0
    chunk = max(64, math.isqrt(n))  # slots are numbered in chunks, whose sums are added up: about as many chunks as slots in each
    cell = lambda y: F.floor(y * F.lit(CELLS / max(n, 1))).cast("int")
    spans = plan.filter("need > 0").withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    point = F.floor((F.col("id") % 2**31 * GOLDEN) % 2**32 / float(2**32) * n)
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("y")).withColumn("cell", cell(F.col("y")))
    slots = slots.join(spans.select("idx", "cell", "lo", "hi"), "cell").filter("y >= lo and y < hi").select("idx", "slot", F.expr(f"slot div {chunk}").alias("chunk"))
    counts = slots.groupBy("idx", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("idx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("idx", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy("idx")).alias("got"))
    own = F.row_number().over(Window.partitionBy("idx", "chunk").orderBy("slot"))
    ranked = slots.withColumn("own", own).join(counts, ["idx", "chunk"]).select("idx", "slot", (F.col("first") + F.col("own") - 1).alias("rank"))
    short = plan.join(counts.groupBy("idx").agg(F.max("got").alias("got")), "idx", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < need")
    lacks = Window.partitionBy(F.lit(0)).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("from", F.lit(n) + F.coalesce(F.sum(F.col("need") - F.col("got")).over(lacks), F.lit(0)))  # a row per source at most
    extra = short.select("idx", "from", "got", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank")).select("idx", (F.col("from") + F.col("rank") - F.col("got")).alias("slot"), "rank")
    out = ranked.unionByName(extra).join(plan.select("idx", "need", "blocks", "rest", "source_size"), "idx").filter("rank < need")
    last = (F.col("rank") == F.col("need") - 1) & (F.col("rest") > 0)
    out = out.withColumn("block", F.col("rank") % F.col("blocks"))
    whole = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    cut = F.col("rest") - F.col("block") * block
    return out.select("idx", "slot", "rank", "block", F.when(last, F.least(cut, whole)).otherwise(whole).alias("tokens"), last.alias("cut"))


def placed(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, block: int = 1024, text: str = "text", seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The documents, each with its place (``at``) in its source's shuffled stream, and the schedule's slots."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", F.size(words(F.col(text))).cast("long").alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"), F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("h"))
    rows = written(rows, "mixing").withColumn("cut", F.substring("h", 1, 3))
    plan = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    parts = rows.groupBy("source", "cut").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    own = Window.partitionBy("source", "cut").orderBy("h", "doc_id", "size", "text_key")
    rows = rows.withColumn("no", F.row_number().over(own)).withColumn("at", F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumnsRenamed({"source": "_s", "cut": "_c"}).join(parts, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_c") == F.col("cut"))).drop("_s", "source")
    rows = rows.select("doc_id", "text_key", "idx", "cut", "no", "size", "source_size", "target", (F.col("base") + F.col("at")).alias("at"))
    return rows, schedule(spark, plan, block)


def _in_blocks(rows: DataFrame, block: int, outer: bool = False) -> DataFrame:
    """A row per block that a document has words in: from word ``lo`` of the stream up to ``hi``."""
    blocks = F.when(F.col("size") > 0, F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}")))
    out = rows.withColumn("block", (F.explode_outer if outer else F.explode)(blocks))
    return out.withColumns({"lo": F.greatest(F.col("at"), F.col("block") * block), "hi": F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)})


def interleaved(docs: DataFrame, block: int = 1024, **options) -> DataFrame:
    """The mix itself, in order of (slot, start): (slot, idx, block, doc_id, text_key, start, length), a document's words from
    ``start`` on that the slot holds. Reading the rows in that order reads the corpus in its target proportions at any point."""
    rows, slots = placed(docs, block=block, **options)
    slots = slots.select("idx", "block", "slot", (F.col("block") * block + F.col("tokens")).alias("end"))
    out = _in_blocks(rows, block).join(slots, ["idx", "block"]).withColumn("hi", F.least("hi", "end")).filter("hi > lo")
    return out.select("slot", "idx", "block", "doc_id", "text_key", (F.col("lo") - F.col("at")).alias("start"), (F.col("hi") - F.col("lo")).alias("length"))


def mixed(docs: DataFrame, block: int = 1024, **options) -> DataFrame:
    """One row per document: size, its source's size and target, the words taken, and the slots of the schedule that take
    them: how many, and the first (null where none does). These are sums of ``interleaved``'s rows, over the uses of each
    block instead of each slot, so a block that is read several times costs one row."""
    rows, slots = placed(docs, block=block, **options)
    uses = slots.groupBy("idx", "block").agg(
        F.count_if(~F.col("cut")).alias("uses"), F.min(F.when(~F.col("cut"), F.col("slot"))).alias("whole_slot"),
        F.coalesce(F.max(F.when(F.col("cut"), F.col("tokens"))), F.lit(0)).alias("part"), F.max(F.when(F.col("cut"), F.col("slot"))).alias("cut_slot"),
    )
    each = _in_blocks(rows, block, outer=True).join(uses, ["idx", "block"], "left")
    part = F.greatest(F.least("hi", F.col("block") * block + F.coalesce("part", F.lit(0))) - F.col("lo"), F.lit(0))
    each = each.withColumn("in_cut", F.coalesce(part, F.lit(0))).withColumns({
        "took": F.coalesce((F.col("hi") - F.col("lo")) * F.col("uses"), F.lit(0)) + F.col("in_cut"),
        "times": F.coalesce("uses", F.lit(0)) + (F.col("in_cut") > 0).cast("long"),
        "first": F.least("whole_slot", F.when(F.col("in_cut") > 0, F.col("cut_slot"))),
    })
    keys, same = ["idx", "cut", "no"], ("doc_id", "text_key", "size", "source_size", "target")
    out = each.groupBy(*keys).agg(*[F.first(c).alias(c) for c in same], F.sum("took").cast("long").alias("taken"), F.sum("times").cast("long").alias("n_slots"), F.min("first").alias("first_slot"))
    return out.drop("cut", "no")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "n_slots", "first_slot")

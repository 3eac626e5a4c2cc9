"""Quality rules: per-text rules plus cross-document line frequency.

Method. Lines are normalised (outer and repeated blanks removed, lower case), hashed and counted in distinct documents
(ids) per host. A line in more than ``max_docs`` documents of its host is boilerplate: it is removed from every
document but the first that holds it (smallest id), so one witness of any passage survives. A document that keeps less
than ``min_share`` of the characters of its lines, or fewer than ``min_chars`` where it lost any, is depleted and
rejected. The base rules reject texts of fewer than 10 words, or with more than a fifth of the words in repeated
five-word windows.

One pass over the texts writes counts and line hashes as a narrow table in the shared folder; the rest works on that.
Counting is pre-aggregated before its shuffle, so a line in a third of all documents is as cheap as any other.

Edge cases: null and empty texts have no words or lines and fail the base rules; null hosts form a host of their own;
rows without an id are one document per text; equal rows get equal verdicts, one output row per input row; columns of
other names, whatever they are, are ignored or, in ``filtered``, returned unchanged (``n_chars`` is renewed). Blank lines stay. Line hashes are 64-bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import documents, held, let, matched, unused, written

BLANK = r"[ \t-\r]+"
WINDOW = 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def _windows(w: Column) -> Column:
    n = F.size(w) - (WINDOW - 1)
    return F.when(n > 0, F.transform(F.slice(w, 1, F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]))).otherwise(F.array().cast("array<bigint>"))


def _repeated(hashes: Column) -> Column:
    """Words in windows that occur twice or more: sort (hash, place), keep those with an equal neighbour, merge the stretches."""

    def places(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(let(ordered, places), covered))


def _normal(line: Column) -> Column:
    plain = F.lower(F.trim(line))
    return F.when(plain.rlike(r"[ \t-\r]{2}|[\t-\r]"), F.trim(F.regexp_replace(plain, BLANK, " "))).otherwise(plain)


def measured(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The narrow table: id, row key, host, counts and the hash and characters of every line."""
    plain = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    out = docs.select("doc_id", F.col(host).alias("host"), plain.alias("_t"))
    out = held(out, _w=words(F.col("_t")), _l=lines)
    out = held(out, _h=_windows(F.col("_w")))
    normal = F.transform("_l", lambda x: F.struct(F.xxhash64(_normal(x)).alias("line"), F.length(x).alias("chars")))

    return out.select(
        "doc_id", F.xxhash64("_t").alias("key"), "host",
        F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("_h")).alias("n_repeat_words"), normal.alias("lines"),
    )


def _frequent(rows: DataFrame, max_docs: int) -> DataFrame:
    """Every place of a line in more than ``max_docs`` documents of its host: the row, the line, its characters and the line's first holder."""
    line = F.col("line")
    each = rows.select("doc_id", "key", "host", F.explode("lines").alias("line")).select("doc_id", "key", "host", line["line"].alias("line"), line["chars"].alias("chars"))
    often = _holders(each).filter(F.col("n") > max_docs)
    hit = each.alias("e").join(often.alias("o"), F.col("e.host").eqNullSafe(F.col("o.host")) & (F.col("e.line") == F.col("o.line")))
    return hit.select("e.*", "o.holder")


def _holders(each: DataFrame) -> DataFrame:
    """Per host and line: its documents and the first holder. Rows that repeat an id are one document, so ids are made
    distinct first; the counts are then sums of what each task has counted."""
    nameless = F.when(F.col("doc_id").isNull(), F.col("key"))
    documents = each.groupBy("host", "line", "doc_id", nameless.alias("nameless")).agg(F.min("key").alias("key"))
    return documents.groupBy("host", "line").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").alias("first"), "key")).alias("holder"))


def _beyond(hit: DataFrame) -> DataFrame:
    return hit.filter(~(F.col("key").eqNullSafe(F.col("holder.key")) & F.col("doc_id").eqNullSafe(F.col("holder.first"))))


def _verdicts(rows: DataFrame, hit: DataFrame, min_share: float, min_chars: int) -> DataFrame:
    lost = _beyond(hit).groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("host").alias("_h")).agg(F.sum("chars").alias("hits"))
    # equal rows (same id, text and host) share the lines, so their sums are of as many rows
    same = rows.groupBy("doc_id", "key", "host").agg(F.count("*").alias("copies"))
    lost = lost.join(same, lost["_d"].eqNullSafe(same["doc_id"]) & (lost["_k"] == same["key"]) & lost["_h"].eqNullSafe(same["host"]))
    lost = lost.select("_d", "_k", "_h", (F.col("hits") / F.col("copies")).cast("long").alias("removed_chars"))
    out = rows.withColumn("line_chars", F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["chars"])).drop("lines")
    out = out.join(lost, out["doc_id"].eqNullSafe(lost["_d"]) & (out["key"] == lost["_k"]) & out["host"].eqNullSafe(lost["_h"]), "left").drop("_d", "_k", "_h")
    removed = F.coalesce("removed_chars", F.lit(0).cast("long"))
    left = F.col("line_chars") - removed
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("removed_chars", removed).withColumn("base_failed", failed)
    out = out.withColumn("depleted", (removed > 0) & ((left < min_share * F.col("line_chars")) | (left < min_chars)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def judged(docs: DataFrame, host: str = "source", text: str = "text", max_docs: int = 50, min_share: float = 0.2, min_chars: int = 40) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``removed_chars``, ``line_chars``, ``depleted`` and ``kept``."""
    rows = written(measured(docs, host, text), "quality")
    return _verdicts(rows, _frequent(rows, max_docs), min_share, min_chars)


def filtered(docs: DataFrame, host: str = "source", text: str = "text", max_docs: int = 50, min_share: float = 0.2, min_chars: int = 40) -> DataFrame:
    """The kept documents, their texts without the lines above the limit and ``n_chars`` renewed where lines went.

    A frequent line stays in its first holder among the kept documents: where the first of all is itself rejected, the next
    keeps it. Verdicts and lines to cut are a narrow table, which meets the texts in one join dealt by id, text and host."""
    rows = written(measured(docs, host, text), "quality")
    hit = written(_frequent(rows, max_docs), "frequent")
    row = ["doc_id", "key", "host"]
    rejected = written(_verdicts(rows, hit, min_share, min_chars).filter(~F.col("kept")).select(*row), "rejected")
    here = matched(hit.drop("holder"), rejected, row, "left_anti")
    holders = _holders(here).select(F.col("host").alias("_h"), F.col("line").alias("_l"), "holder")
    lines = _beyond(here.join(holders, here["host"].eqNullSafe(holders["_h"]) & (here["line"] == holders["_l"])))
    cuts = lines.groupBy(*row).agg(F.collect_set("line").alias("cut"))
    key, at, cut, done, new = unused(docs.columns, "key", "host", "cut", "rejected", "new")
    none = F.lit(None).cast("array<bigint>")
    changed = cuts.withColumn("rejected", F.lit(False)).unionByName(rejected.distinct().withColumns({"cut": none, "rejected": F.lit(True)}))
    changed = written(changed, "changed").withColumnsRenamed({"key": key, "host": at, "cut": cut, "rejected": done})
    out = docs.withColumns({key: F.xxhash64(F.coalesce(F.col(text), F.lit(""))), at: F.col(host)})
    out = matched(out, changed, ["doc_id", key, at], "left").filter(~F.coalesce(F.col(done), F.lit(False)))
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(cut, F.xxhash64(_normal(x)))), "\n")
    out = held(out, **{new: F.when(F.col(cut).isNotNull(), rest).otherwise(F.col(text))})
    renewed = {text: F.col(new)}
    if "n_chars" in docs.columns:
        renewed["n_chars"] = F.when(F.col(cut).isNotNull(), F.length(new).cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[renewed[c].alias(c) if c in renewed else F.col(c) for c in docs.columns])


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars", "line_chars", "depleted")

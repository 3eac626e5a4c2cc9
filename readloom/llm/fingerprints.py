"""Document fingerprints: a Merkle tree of sentences, paragraphs and sections.

Method. A paragraph is a line; its leaves are its sentences (overlong ones are cut after words chosen by hash). Paragraphs
are grouped into sections whose ends paragraph hashes choose, so an edit moves no boundary but those beside it. Every
node hashes its level and its children; the root, 256 bits, is the fingerprint: equal roots mean equal texts, and from two
differing roots the differing branches lead to the edits (``edits``). Likeness is the share of both texts' characters
that lie in leaves they have in common.

The query compares every text with the next document's, and lists (``edits``) the spans of the text under branches that
the edited text's tree lacks. Documents are dealt by id ranges, as many as the texts' bytes need, each into a partition of
its own that is read in order with one row of lookahead; the first document of each range is also sent to the range
before (of the first, to the last). Texts are shuffled once, and the driver sees range bounds only.

Edge cases: null texts are empty; the empty text has a fingerprint and likeness 1 to another; null ids come first; equal
ids follow one another by text; a single document is its own next; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import documents, let, tasks_for

SENTENCE = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+$")
LONG = 400


def _hash(level: bytes, *parts: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(level + b"".join(parts), digest_size=size).digest()


def leaves(paragraph: str) -> list[str]:
    out = []
    for s in SENTENCE.findall(paragraph):
        if len(s) <= LONG:
            out.append(s)
            continue
        part: list[str] = []
        for w in re.findall(r"\s*\S+|\s+$", s):
            part.append(w)
            if zlib.crc32(w.encode()) % 16 == 0:
                out.append("".join(part))
                part = []
        if part:
            out.append("".join(part))
    return out


class Tree:
    """``root``; ``sections``: [(hash, [(hash, start, [(hash, start, length)])])]; ``shares``: characters by leaf hash."""

    def __init__(self, text: str | None):
        self.n = len(text or "")
        self.shares: dict[bytes, int] = {}
        self.sections: list = []
        at, now = 0, []
        for p in (text or "").split("\n"):
            kids, here = [], at
            for leaf in leaves(p):
                h = _hash(b"0", leaf.encode())
                kids.append((h, here, len(leaf)))
                self.shares[h] = self.shares.get(h, 0) + len(leaf)
                here += len(leaf)
            h = _hash(b"1", *(k[0] for k in kids))
            now.append((h, at, kids))
            at += len(p) + 1
            if h[0] < 32:
                self.sections.append((_hash(b"2", *(x[0] for x in now)), now))
                now = []
        if now:
            self.sections.append((_hash(b"2", *(x[0] for x in now)), now))
        self.root = _hash(b"3", *(s[0] for s in self.sections), size=32).hex()

    def likeness(self, other: Tree) -> float:
        if self.root == other.root:
            return 1.0
        a, b = sum(self.shares.values()), sum(other.shares.values())
        if len(other.shares) < len(self.shares):
            self, other = other, self
        return 2 * sum(min(n, other.shares.get(h, 0)) for h, n in self.shares.items()) / (a + b) if a + b else 0.0

    def edits(self, other: Tree) -> list[tuple[int, int]]:
        """(start, end) of this text's leaves, neighbours joined, under branches that the other tree lacks."""
        sections = {h for h, _ in other.sections}
        paragraphs = {p[0] for _, ps in other.sections for p in ps}
        out: list[tuple[int, int]] = []
        for h, ps in self.sections:
            for p in [] if h in sections else ps:
                for leaf, start, n in [] if p[0] in paragraphs else p[2]:
                    if leaf not in other.shares:
                        first = out.pop()[0] if out and out[-1][1] == start else start
                        out.append((first, start + n))
        return out


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint, sections): root and section hashes with their paragraphs' hashes and starts."""

    def rows(batches):
        kind = pa.list_(pa.struct([("hash", pa.string()), ("paragraphs", pa.list_(pa.struct([("hash", pa.string()), ("start", pa.int64())])))]))
        for batch in batches:
            trees = [Tree(t.as_py()) for t in batch.column(1)]
            tops = [[{"hash": h.hex(), "paragraphs": [{"hash": p[0].hex(), "start": p[1]} for p in ps]} for h, ps in t.sections] for t in trees]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.n for t in trees], pa.int64()), pa.array([t.root for t in trees]), pa.array(tops, kind)], ["doc_id", "n_chars", "fingerprint", "sections"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(rows, "doc_id long, n_chars long, fingerprint string, sections array<struct<hash: string, paragraphs: array<struct<hash: string, start: bigint>>>>")


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` lie below ``value``: searched in two steps, so thousands of ranges cost about two square roots."""
    if not bounds:
        return F.lit(0)
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    below = lambda some: F.size(F.filter(some, lambda b: b < value))
    tops = F.array(*[F.lit(g[-1]) for g in groups]).cast("array<bigint>")
    every = F.array(*[F.array(*[F.lit(b) for b in g]).cast("array<bigint>") for g in groups])
    return let(below(tops), lambda k: k * width + F.when(k < len(groups), below(F.get(every, k))).otherwise(len(groups[-1]) - width))


def in_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """(part, role, doc_id, text): rows of an id range, then with role 1 the first of the next range."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("o"))
    parts = tasks_for(spark, docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    bounds = sorted(set(docs.filter("doc_id is not null").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    part = range_of(F.col("o"), [int(b) for b in bounds])
    rows = rows.withColumn("part", part)
    heads = sorted((r["part"], r["head"]) for r in rows.groupBy("part").agg(F.min("o").alias("head")).collect())  # a row per range
    known = spark.createDataFrame([(p, h, heads[k - 1][0]) for k, (p, h) in enumerate(heads)], "part int, head long, before int")
    also = F.when(F.col("o") == F.col("head"), F.array(F.struct(F.col("part"), F.lit(0).alias("role")), F.struct(F.col("before").alias("part"), F.lit(1).alias("role"))))
    rows = rows.join(F.broadcast(known), "part").withColumn("to", F.explode(F.coalesce(also, F.array(F.struct(F.col("part"), F.lit(0).alias("role"))))))
    return rows.select("to.part", "to.role", "doc_id", "text", "o").repartitionById(parts, F.col("part")).sortWithinPartitions("part", "role", "o", "text"), parts


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its text with the last half replaced from the next one's, likenesses, and where the edit is."""

    def rows(batches):
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edits"]
        last = None
        for batch in batches:
            out: list[tuple] = []
            for part, role, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "role", "doc_id", "text")), strict=True):
                if last is None or last[0] != part:
                    if role:
                        continue  # rows that share the first id of the next range
                    last = (part, doc, text, Tree(text))
                    continue
                _, d, t, tree = last
                following = Tree(text)
                half = len(t) // 2
                edited = t[: len(t) - half] + text[:half]
                other = Tree(edited)
                out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), tree.root, other.root, tree.likeness(other), tree.likeness(following), [{"start": a, "end": b} for a, b in tree.edits(other)]))
                last = None if role else (part, doc, text, following)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)], names)

    dealt, _ = in_order(docs)
    return dealt.mapInArrow(rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits array<struct<start: bigint, end: bigint>>")


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compared_with_next(documents(spark, sf_dir))

"""Packing token sequences: large-item matching with best fit (op5), best-fit-decreasing with a segment tree (op9).

A packing depends on lengths alone, and there are at most ``capacity`` of them. So the plan is made on the histogram of
piece lengths, a table of bounded size whatever the corpus: groups of equal bins are filled with runs of equal pieces,
and a plan is a few thousand runs ``(length, ranks, first bin, pieces per bin, offset)``. Pieces are then ranked within
their length, in salted parts whose counts are added up, and each finds its run by binary search. The result is the
packing the sequential algorithm gives, with one shuffle of narrow rows.

Matching: pieces above a third of the capacity share a bin with at most one more of their kind; the largest takes the
largest partner that fits. Smaller pieces then go, longest first, into the tightest gap. BFD: all pieces, longest first,
into the tightest gap, which a segment tree over gap sizes finds.

Longer documents are cut into whole-capacity pieces and a rest, losslessly.

Edge cases: a null or empty text is the end id alone; equal rows and ids are packed as often as they occur; null ids are
kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import documents, tasks_for, written
from .tokens import encoder

CAPACITY, TOKENIZER, END = 2048, "word_bpe_49k.json", 0


# plans on histograms ---------------------------------------------------------------------------------------------------
class Bins:
    """Groups of equal bins by gap, and the runs placed so far."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.runs = capacity, 0, []
        self.ranks: dict[int, int] = {}
        self.gaps: list[int] = []
        self.groups: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in self.groups:
                insort(self.gaps, gap)
            self.groups.setdefault(gap, []).append((first, n))

    def take(self, gap: int) -> tuple[int, int]:
        first, n = self.groups[gap].pop()
        if not self.groups[gap]:
            del self.groups[gap]
            self.gaps.pop(bisect_left(self.gaps, gap))
        return first, n

    def run(self, length: int, n: int, first: int, each: int, offset: int) -> None:
        lo = self.ranks.get(length, 0)
        self.runs.append((length, lo, first, each, offset))
        self.ranks[length] = lo + n

    def open(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def fit(self, length: int, count: int, tightest) -> None:
        """``count`` pieces one by one into the tightest gaps: a bin is filled as far as it goes before the next."""
        while count:
            gap = tightest(length)
            if gap is None:
                gap, n = self.capacity, -(-count // (self.capacity // length))
                first = self.open(n)
            else:
                first, n = self.take(gap)
            each = gap // length
            whole = min(n, count // each)
            if whole:
                self.run(length, whole * each, first, each, self.capacity - gap)
                self.add(gap - length * each, first, whole)
                count -= whole * each
            if whole < n and count:
                self.run(length, count, first + whole, count, self.capacity - gap)
                self.add(gap - length * count, first + whole, 1)
                self.add(gap, first + whole + 1, n - whole - 1)
                count = 0
            elif whole < n:
                self.add(gap, first + whole, n - whole)

    def tightest(self, length: int):
        k = bisect_left(self.gaps, length)
        return self.gaps[k] if k < len(self.gaps) else None


def plan_matching(histogram: dict[int, int], capacity: int) -> Bins:
    out, left = Bins(capacity), dict(histogram)
    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        if k < 0:
            n = left[a]
            out.run(a, n, first := out.open(n), 1, 0)
            out.add(capacity - a, first, n)
            large.pop()
            continue
        b = large[k]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        if n == 0:  # one of its kind left, the next smaller one may fit
            if k == 0:
                out.run(a, 1, first := out.open(1), 1, 0)
                out.add(capacity - a, first, 1)
                large.pop()
                continue
            b, n = large[k - 1], 1
        first = out.open(n)
        if a == b:
            out.run(a, 2 * n, first, 2, 0)
        else:
            out.run(a, n, first, 1, 0)
            out.run(b, n, first, 1, a)
        out.add(capacity - a - b, first, n)
        for x in (a, b):
            left[x] -= n
        large = [x for x in large if left[x]]
    for x in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        out.fit(x, left[x], out.tightest)
    return out


class SegmentTree:
    """Bins by gap; ``at_least(x)`` is the smallest gap of x or more that a bin has."""

    def __init__(self, capacity: int, held):
        self.size, self.held = 1 << capacity.bit_length(), held
        self.any = [False] * (2 * self.size)

    def refresh(self, gap: int) -> None:
        k = gap + self.size
        self.any[k] = gap in self.held
        while k > 1:
            k //= 2
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def at_least(self, gap: int):
        k = gap + self.size
        while not self.any[k]:
            while k & 1:
                k //= 2
            if k == 0:
                return None
            k += 1
        while k < self.size:
            k = 2 * k if self.any[2 * k] else 2 * k + 1
        return k - self.size


class TreeBins(Bins):
    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.tree = SegmentTree(capacity, self.groups)

    def add(self, gap, first, n):
        if n and gap:
            self.groups.setdefault(gap, []).append((first, n))
            self.tree.refresh(gap)

    def take(self, gap):
        first, n = self.groups[gap].pop()
        if not self.groups[gap]:
            del self.groups[gap]
            self.tree.refresh(gap)
        return first, n

    def tightest(self, length):
        return self.tree.at_least(length)


def plan_bfd(histogram: dict[int, int], capacity: int) -> Bins:
    out = TreeBins(capacity)
    for x in sorted(histogram, reverse=True):
        out.fit(x, histogram[x], out.tightest)
    return out


# pieces ----------------------------------------------------------------------------------------------------------------
def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids as compressed uint16 bytes]); checksums are of 32-bit ids."""
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches):
        encode, tail = encoder(tokenizer), np.array([end], "<u2").tobytes()
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress if with_ids else None
        for batch in batches:
            rows: list[list] = [[] for _ in range(5 + with_ids)]
            for doc, ids in zip(batch.column(0).to_pylist(), (encode(x.as_py()) for x in batch.column(1)), strict=True):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 2 * capacity)):
                    part = ids[at : at + 2 * capacity]
                    row = (doc, k, at // 2, len(part) // 2, zlib.crc32(np.frombuffer(part, "<u2").astype("<u4").tobytes()), pack and pack(part))
                    for column, value in zip(rows, row, strict=False):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=False)], names[: len(rows)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


#: Pieces of one length that are ranked together, about.
RANKED = 500


def packed(parts: DataFrame, plan=plan_matching, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (a written table) with ``sequence_id`` and ``offset``. Each length is ranked in as many salted parts as its
    count needs, whichever lengths are frequent."""
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    tasks = tasks_for(spark, sum(n * (64 + 2 * length * ("ids" in parts.columns)) for length, n in histogram.items()))
    salts = spark.createDataFrame([(length, -(-n // RANKED)) for length, n in histogram.items()], "length int, salts long")
    rows = parts.join(F.broadcast(salts), "length").withColumn("salt", F.expr("pmod(xxhash64(doc_id, piece, ids_crc32), salts)").cast("int"))
    counts = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    runs = sorted(plan(histogram, capacity).runs)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.repartition(tasks, "length", "salt").withColumn("own", F.row_number().over(own)).join(firsts, ["length", "salt"])
    rows = rows.withColumn("rank", F.col("first") + F.col("own") - 1).select(*parts.columns, "rank")
    table = np.array(runs, "int64").reshape(-1, 5)

    def place(batches):
        keys = table[:, 0] * 2**40 + table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (np.asarray(batch.column(c)).astype("int64") for c in ("length", "rank"))
            run = table[np.searchsorted(keys, length * 2**40 + rank, "right") - 1]
            k = rank - run[:, 1]
            more = [pa.array(run[:, 2] + k // run[:, 3]), pa.array(run[:, 4] + k % run[:, 3] * length)]
            names = [*(x for x in batch.schema.names if x != "rank"), "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names[:-2]), *more], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields)
    return rows.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    out = packed(written(pieces(documents(spark, sf_dir)), "pieces"))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


# token-id matrices -----------------------------------------------------------------------------------------------------
MATRIX = "sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, doc_ids array<bigint>, pieces array<int>, position_starts array<bigint>"


def matrices(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end: int = END, pad: int = 0) -> DataFrame:
    """One row per packed sequence: a matrix row of ``capacity`` uint16 ids (little-endian, padded), the cumulative segment
    lengths from 0 to ``n_tokens``, and per segment its document, piece and the position its first token has in the
    document. Positions restart at every entry of ``cu_seqlens`` (at ``position_starts`` for continued documents)."""
    parts = written(pieces(docs, capacity, tokenizer, end, with_ids=True), "token-ids")
    rows = packed(parts, plan_bfd, capacity).select("sequence_id", "offset", "doc_id", "piece", "start", "ids")
    tasks = tasks_for(docs.sparkSession, 2 * (parts.agg(F.sum("length")).first()[0] or 0))
    rows = rows.repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id", "offset")

    def joined(batches):
        types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        names = ("sequence_id", "n_tokens", "ids", "cu_seqlens", "doc_ids", "pieces", "position_starts")
        done: list[tuple] = []
        now, segments = None, []
        unpack = zstandard.ZstdDecompressor().decompress

        def close():
            if segments:
                ids = b"".join(s[3] for s in segments)
                ends = [0, *np.cumsum([len(s[3]) // 2 for s in segments]).tolist()]
                full = ids + np.full(capacity - ends[-1], pad, "<u2").tobytes()
                done.append((now, ends[-1], full, ends, *([s[k] for s in segments] for k in range(3))))
                segments.clear()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
            done.clear()
            return out

        for batch in batches:
            for seq, doc, piece, start, ids in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "doc_id", "piece", "start", "ids")), strict=True):
                if seq != now:
                    close()
                    now = seq
                segments.append((doc, piece, start, unpack(ids)))
            if len(done) > 500:
                yield flush()
        close()
        if done:
            yield flush()

    return rows.mapInArrow(joined, MATRIX)


def op9_token_matrices(spark, sf_dir: str) -> DataFrame:
    return matrices(documents(spark, sf_dir))

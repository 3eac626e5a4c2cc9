"""BigWig tracks as a Spark data source, from the public format description: reading by data block, writing with one global index.

Reading deals the blocks the R-tree lists to tasks; an equality on ``chrom`` keeps that chromosome's. Writing expects rows
in (chromosome, start) order over the partitions (``write_bigwig`` sorts them): tasks compress blocks of ``ITEMS`` rows
into part files, the commit writes header, chromosome tree, data and index around them.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

from readloom import reachable
from readloom.schemas import REFS

MAGIC, TREE_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
ITEMS, FAN, U32 = 1024, 256, 2**32 - 1
#: Bases a summary record of each zoom level covers.
ZOOMS = (2048, 16_384, 131_072)
SCHEMA = "track STRING, chrom STRING, start BIGINT, end BIGINT, value FLOAT"


class File:
    """Header, chromosomes and block list of a file, in either byte order."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            head = f.read(64)
            self.order = next((o for o in "<>" if len(head) == 64 and struct.unpack(o + "I", head[:4])[0] == MAGIC), None)
            if self.order is None:
                raise ValueError(f"{path} is not a BigWig file")
            _, zooms, tree, _, index, _, _, _, _, self.packed, _ = struct.unpack(self.order + "HHQQQHHQQIQ", head[4:])
            self.index = index
            #: (bases of a record, data, index) of each zoom level
            self.zooms = [(level, data, at) for level, _, data, at in (struct.unpack(self.order + "IIQQ", f.read(24)) for _ in range(zooms))]
            f.seek(tree)
            magic, _, key, _, _, _ = struct.unpack(self.order + "IIIIQQ", f.read(32))
            if magic != TREE_MAGIC:
                raise ValueError(f"{path} has a damaged chromosome tree")
            self.chroms: dict[int, tuple[str, int]] = {}
            self._chroms(f, tree + 32, key)

    def _chroms(self, f, at: int, key: int) -> None:
        f.seek(at)
        leaf, _, n = struct.unpack(self.order + "BBH", f.read(4))
        data = f.read(n * (key + 8))
        for k in range(n):
            name = data[k * (key + 8) :][:key].rstrip(b"\0").decode()
            if leaf:
                number, size = struct.unpack_from(self.order + "II", data, k * (key + 8) + key)
                self.chroms[number] = (name, size)
            else:
                self._chroms(f, struct.unpack_from(self.order + "Q", data, k * (key + 8) + key)[0], key)

    def blocks(self, index: int | None = None) -> list[tuple[int, int, int, int]]:
        """(first chromosome, last chromosome, offset, size), of the data or of a zoom level's index."""
        index = self.index if index is None else index
        out, todo = [], [index + 48]
        with open(self.path, "rb") as f:
            f.seek(index)
            if struct.unpack(self.order + "I", f.read(4))[0] != INDEX_MAGIC:
                raise ValueError(f"{self.path} has a damaged index")
            while todo:
                f.seek(todo.pop())
                leaf, _, n = struct.unpack(self.order + "BBH", f.read(4))
                for _ in range(n):
                    a, _, b, _, offset = struct.unpack(self.order + "IIIIQ", f.read(24))
                    if leaf:
                        out.append((a, b, offset, struct.unpack(self.order + "Q", f.read(8))[0]))
                    else:
                        todo.append(offset)
        return sorted(out, key=lambda x: x[2])

    def rows(self, data: bytes) -> list[tuple[int, int, int, float]]:
        """(chromosome, start, end, value) of one block of any of the three kinds."""
        if self.packed:
            data = zlib.decompress(data)
        o = self.order
        chrom, start, _, step, span, kind, _, n = struct.unpack_from(o + "IIIIIBBH", data)
        if kind == 1:
            return [(chrom, *x) for x in struct.iter_unpack(o + "IIf", data[24 : 24 + 12 * n])]
        if kind == 2:
            return [(chrom, s, s + span, v) for s, v in struct.iter_unpack(o + "If", data[24 : 24 + 8 * n])]
        return [(chrom, start + k * step, start + k * step + span, v) for k, (v,) in enumerate(struct.iter_unpack(o + "f", data[24 : 24 + 4 * n]))]


    def summaries(self, level: int) -> list[tuple]:
        """(chromosome, start, end, bases, min, max, sum, sum of squares) of a zoom level."""
        index = next(at for bases, _, at in self.zooms if bases == level)
        out = []
        with open(self.path, "rb") as f:
            for _, _, offset, size in self.blocks(index):
                f.seek(offset)
                data = f.read(size)
                out += struct.iter_unpack(self.order + "IIIIffff", zlib.decompress(data) if self.packed else data)
        return out


class Summaries:
    """One zoom level of a task's rows: records of the bases they cover, in compressed blocks."""

    def __init__(self, level: int, path: str):
        self.level, self.path, self.file = level, path, open(path, "wb")  # noqa: SIM115
        self.open: list | None = None
        self.rows: list[tuple] = []
        self.blocks: list[tuple[int, int, int, int, int]] = []
        self.n = self.at = 0

    def add(self, chrom: int, start: int, end: int, value: float) -> None:
        while start < end:
            stop = min(end, (start // self.level + 1) * self.level)
            n, o = stop - start, self.open
            if o is None or o[0] != chrom or o[1] // self.level != start // self.level:
                self._close()
                self.open = [chrom, start, stop, n, value, value, value * n, value * value * n]
            else:
                o[2], o[3], o[4], o[5], o[6], o[7] = stop, o[3] + n, min(o[4], value), max(o[5], value), o[6] + value * n, o[7] + value * value * n
            start = stop

    def _close(self) -> None:
        if self.open:
            if self.rows and (len(self.rows) >= ITEMS or self.rows[0][0] != self.open[0]):
                self._flush()
            self.rows.append(tuple(self.open))
            self.open = None

    def _flush(self) -> None:
        if self.rows:
            data = zlib.compress(b"".join(struct.pack("<IIIIffff", *r) for r in self.rows))
            self.blocks.append((self.rows[0][0], self.rows[0][1], self.rows[-1][2], self.at, len(data)))
            self.file.write(data)
            self.n, self.at = self.n + len(self.rows), self.at + len(data)
            self.rows = []

    def done(self) -> tuple[str, int, list]:
        self._close()
        self._flush()
        self.file.close()
        return self.path, self.n, self.blocks


@dataclass
class Blocks(InputPartition):
    path: str
    track: str
    blocks: list[tuple[int, int]] = field(default_factory=list)


class BigWigReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.names = options["tracks"].split(",") if "tracks" in options else [os.path.splitext(os.path.basename(p))[0] for p in self.paths]
        self.per = int(options.get("blocks_per_partition", 2048))
        self.chrom = options.get("chrom")

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chrom",) and self.chrom is None:
                self.chrom = f.value
            yield f

    def partitions(self):
        out = []
        for path, name in zip(self.paths, self.names, strict=True):
            file = File(path)
            mine = {k for k, (n, _) in file.chroms.items() if self.chrom in (None, n)}
            blocks = [(offset, size) for a, b, offset, size in file.blocks() if any(a <= k <= b for k in mine)]
            out += [Blocks(path, name, blocks[k : k + self.per]) for k in range(0, len(blocks), self.per)]
        return out

    def read(self, part):
        if part is None:
            return
        file, rows = File(part.path), []

        def batch():
            chroms, starts, ends, values = zip(*rows, strict=True)
            names = [file.chroms[c][0] for c in chroms]
            arrays = [pa.array([part.track] * len(rows)), pa.array(names), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(values, pa.float32())]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, ["track", "chrom", "start", "end", "value"])

        with open(part.path, "rb") as f:
            for offset, size in part.blocks:
                f.seek(offset)
                rows += [r for r in file.rows(f.read(size)) if r[2] > r[1]]
                if len(rows) > 20_000:
                    yield batch()
        if rows:
            yield batch()


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    blocks: list[tuple[int, int, int, int, int]]  # chromosome, start, end, offset, size
    totals: tuple[int, float, float, float, float]  # bases, min, max, sum, sum of squares
    longest: int
    zooms: list[tuple[str, int, list]]  # by level: part file, records, blocks


def _levels(leaves: list[tuple]) -> list[list[list]]:
    """Groups of at most FAN entries, from the leaves to the root."""
    out = [[leaves[k : k + FAN] for k in range(0, len(leaves), FAN)] or [[]]]
    while len(out[-1]) > 1:
        tops = [(g[0][0], g[0][1], *max((e[2], e[3]) for e in g)) for g in out[-1]]
        out.append([tops[k : k + FAN] for k in range(0, len(tops), FAN)])
    return out


class BigWigWriter(DataSourceWriter):
    def __init__(self, options, overwrite):
        self.path, self.overwrite = options["path"], overwrite
        self.refs = [(n, int(k)) for n, _, k in (x.rpartition(":") for x in options["refs"].split(","))]
        if not self.refs or any(size > U32 for _, size in self.refs):
            raise ValueError("chromosome lengths must fit 32 bits")
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator):
        from pyspark import TaskContext

        context, ids = TaskContext.get(), {n: k for k, (n, _) in enumerate(self.refs)}
        os.makedirs(self.parts, exist_ok=True)
        path = f"{self.parts}/{context.partitionId():06d}-{context.attemptNumber()}"
        blocks, rows, longest, at, now = [], [], 0, 0, None
        n, low, high, total, squares = 0, float("inf"), float("-inf"), 0.0, 0.0
        zooms = [Summaries(level, f"{path}-z{level}") for level in ZOOMS]
        with open(path, "wb") as f:

            def flush():
                nonlocal at, longest
                if rows:
                    data = struct.pack("<IIIIIBBH", now, rows[0][0], rows[-1][1], 0, 0, 1, 0, len(rows)) + b"".join(struct.pack("<IIf", *r) for r in rows)
                    packed = zlib.compress(data)
                    blocks.append((now, rows[0][0], rows[-1][1], at, len(packed)))
                    f.write(packed)
                    at, longest = at + len(packed), max(longest, len(data))
                    rows.clear()

            for row in iterator:
                chrom, start, end, value = ids[row["chrom"]], row["start"], row["end"], row["value"]
                if not 0 <= start < end <= U32:
                    raise ValueError(f"interval [{start}, {end}) doesn't fit a BigWig file")
                if rows and (chrom != now or len(rows) >= ITEMS):
                    flush()
                if chrom == now and rows and start < rows[-1][1]:
                    raise ValueError("rows must be sorted and disjoint")
                now = chrom
                rows.append((start, end, value))
                for z in zooms:
                    z.add(chrom, start, end, value)
                n, low, high = n + end - start, min(low, value), max(high, value)
                total, squares = total + value * (end - start), squares + value * value * (end - start)
            flush()
        return Part(context.partitionId(), path, blocks, (n, low, high, total, squares), longest, [z.done() for z in zooms])

    def commit(self, messages):
        if os.path.exists(self.path) and not self.overwrite:
            raise FileExistsError(self.path)
        done = sorted((m for m in messages if m), key=lambda m: m.partition)
        key = max(len(n.encode()) for n, _ in self.refs)
        with open(f"{self.parts}.bw", "wb") as f:
            f.write(b"\0" * (64 + 24 * len(ZOOMS)))
            summary_at = f.tell()
            f.write(b"\0" * 40)
            tree_at = f.tell()
            self._tree(f, key)
            data_at = f.tell()
            blocks = []
            f.write(struct.pack("<Q", 0))
            for m in done:
                base = f.tell()
                with open(m.path, "rb") as part:
                    shutil.copyfileobj(part, f, 2**20)
                blocks += [(c, s, c, e, base + offset, size) for c, s, e, offset, size in m.blocks]
            index_at = f.tell()
            self._index(f, blocks, index_at)
            levels = []
            for k, level in enumerate(ZOOMS):
                zoom_at, some = f.tell(), []
                f.write(struct.pack("<I", sum(m.zooms[k][1] for m in done)))
                for m in done:
                    base = f.tell()
                    with open(m.zooms[k][0], "rb") as part:
                        shutil.copyfileobj(part, f, 2**20)
                    some += [(c, s, c, e, base + offset, size) for c, s, e, offset, size in m.zooms[k][2]]
                levels.append((level, 0, zoom_at, f.tell()))
                self._index(f, some, f.tell())
            f.write(struct.pack("<I", MAGIC))
            f.seek(data_at)
            f.write(struct.pack("<Q", len(blocks)))
            full = [m.totals for m in done if m.totals[0]]
            f.seek(summary_at)
            f.write(struct.pack("<Q4d", sum(t[0] for t in full), min((t[1] for t in full), default=0), max((t[2] for t in full), default=0), sum(t[3] for t in full), sum(t[4] for t in full)))
            f.seek(0)
            f.write(struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, len(ZOOMS), tree_at, data_at, index_at, 0, 0, 0, summary_at, max([32 * ITEMS, *(m.longest for m in done)]), 0))
            f.write(b"".join(struct.pack("<IIQQ", *z) for z in levels))
        os.replace(f"{self.parts}.bw", self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def _tree(self, f, key: int) -> None:
        leaves = sorted((n.encode().ljust(key, b"\0"), k, size) for k, (n, size) in enumerate(self.refs))
        per = max(2, min(FAN, len(leaves)))
        f.write(struct.pack("<IIIIQQ", TREE_MAGIC, per, key, 8, len(leaves), 0))
        levels: list[list[list]] = [[leaves[k : k + per] for k in range(0, len(leaves), per)]]
        while len(levels[-1]) > 1:
            tops = [g[0] for g in levels[-1]]
            levels.append([tops[k : k + per] for k in range(0, len(tops), per)])
        node = 4 + per * (key + 8)
        at = f.tell()
        for depth in reversed(range(len(levels))):
            below = at + len(levels[depth]) * node
            child = 0
            for group in levels[depth]:
                data = struct.pack("<BBH", depth == 0, 0, len(group))
                for entry in group:
                    data += entry[0] + (struct.pack("<II", entry[1], entry[2]) if depth == 0 else struct.pack("<Q", below + child * node))
                    child += 1
                f.write(data.ljust(node, b"\0"))
            at = below

    def _index(self, f, blocks: list, index_at: int) -> None:
        lo, hi = (blocks[0][:2], max(b[2:4] for b in blocks)) if blocks else ((0, 0), (0, 0))
        f.write(struct.pack("<IIQIIIIQII", INDEX_MAGIC, FAN, len(blocks), *lo, *hi, index_at, ITEMS, 0))
        levels = _levels(blocks)
        size = lambda depth: 4 + FAN * (32 if depth == 0 else 24)
        at = index_at + 48
        for depth in reversed(range(len(levels))):
            below = at + len(levels[depth]) * size(depth)
            child = 0
            for group in levels[depth]:
                data = struct.pack("<BBH", depth == 0, 0, len(group))
                for e in group:
                    data += struct.pack("<IIII", *e[:4]) + (struct.pack("<QQ", e[4], e[5]) if depth == 0 else struct.pack("<Q", below + child * size(depth - 1)))
                    child += 1
                f.write(data.ljust(size(depth), b"\0"))
            at = below

    def abort(self, messages):
        shutil.rmtree(self.parts, ignore_errors=True)


class BigWigSource(DataSource):
    @classmethod
    def name(cls):
        return "bigwig"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BigWigReader(self.options)

    def writer(self, schema, overwrite):
        return BigWigWriter(self.options, overwrite)


def read_bigwig(spark: SparkSession, paths: str | list[str], tracks: list[str] | None = None, **options) -> DataFrame:
    many = [paths] if isinstance(paths, str) else list(paths)
    reachable(spark).conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BigWigSource)
    reader = spark.read.format("bigwig").options(**{k: str(v) for k, v in options.items()})
    if tracks:
        reader = reader.option("tracks", ",".join(tracks))
    return reader.load(",".join(many))


def read_chroms(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, chrom, length) in the file's order."""
    return spark.createDataFrame([(k, n, size) for k, (n, size) in sorted(File(path).chroms.items())], REFS)


def write_bigwig(signal: DataFrame, refs: DataFrame, path: str, value: str = "value") -> str:
    """``signal`` (chrom, start, end, value) to one file, chromosomes in the order of ``refs`` (a bounded table)."""
    reachable(signal.sparkSession).dataSource.register(BigWigSource)
    names = [(r["chrom"], r["length"]) for r in refs.orderBy("ref_id").select("chrom", "length").collect()]
    rows = signal.select("chrom", "start", "end", F.col(value).cast("float").alias("value")).join(F.broadcast(refs.select("ref_id", "chrom")), "chrom")
    rows = rows.repartitionByRange("ref_id", "start").sortWithinPartitions("ref_id", "start").select(F.lit(None).cast("string").alias("track"), "chrom", "start", "end", "value")
    rows.write.format("bigwig").mode("overwrite").option("refs", ",".join(f"{n}:{k}" for n, k in names)).save(path)
    return path

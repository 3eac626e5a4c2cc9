"""BAM files and their indexes as Spark data sources, from the public format specification.

Reading splits a file at record starts that its index names, so a read belongs to the task that holds its start and none
is read twice, whatever the partitioning; a file without an index is one task. Unplaced reads come last. An equality on
``chrom`` reads that reference's stretch only (with ``spark.sql.python.filterPushdown.enabled``).

Writing: each task compresses its records into a part file beside the target; the commit puts header, parts in partition
order and end marker together. Records keep their raw bytes; position, mate position, template length and bin follow the
columns. Rows without raw bytes are encoded from their columns.
"""

from __future__ import annotations

import os
import re
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

from readloom import reachable
from readloom.schemas import ALIGNMENTS, INDEX_STATS, REFS
from readloom.sources import bgzf

OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
SPLIT_BYTES, ROWS = 16 * 2**20, 20_000
METADATA_BIN = 37450


# header ----------------------------------------------------------------------------------------------------------------
def read_header(path: str) -> tuple[str, list[tuple[str, int]], int]:
    """(text, [(name, length)], virtual offset of the first record). The binary reference list rules; odd text does no harm."""
    with bgzf.Reader(path) as r:
        if r.read(4) != b"BAM\1":
            raise ValueError(f"{path} is not a BAM file")
        text = r.read(struct.unpack("<i", r.read(4))[0]).rstrip(b"\0").decode(errors="replace")
        refs = []
        for _ in range(struct.unpack("<i", r.read(4))[0]):
            name = r.read(struct.unpack("<i", r.read(4))[0])[:-1].decode()
            refs.append((name, struct.unpack("<i", r.read(4))[0]))
        return text, refs, r.tell()


def header_bytes(text: str, refs: list[tuple[str, int]]) -> bytes:
    raw = text.encode()
    out = b"BAM\1" + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(refs))
    for name, length in refs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    return out


def header_text(refs: list[tuple[str, int]], base: str = "", command: str = "") -> str:
    """``base`` (or a plain header) with this program's line of provenance at its end."""
    from readloom import __version__

    text = base if "@SQ" in base else "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in refs)
    if not text.endswith("\n"):
        text += "\n"
    if text.startswith("@HD") and "VN:" not in text.split("\n", 1)[0]:
        text = text.replace("@HD", "@HD\tVN:1.6", 1)
    ids = set(re.findall(r"^@PG\t.*?ID:([^\t\n]+)", text, re.M))
    name = next(n for n in ("readloom", *(f"readloom.{k}" for k in range(1, 10_000))) if n not in ids)
    return text + f"@PG\tID:{name}\tPN:readloom\tVN:{__version__}" + (f"\tCL:{command}" if command else "") + "\n"


# records ---------------------------------------------------------------------------------------------------------------
def _tags(data: bytes, at: int) -> dict[str, str]:
    """The string-valued tags."""
    sizes, out = {65: 1, 99: 1, 67: 1, 115: 2, 83: 2, 105: 4, 73: 4, 102: 4}, {}
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2].decode(), data[at + 2]
        at += 3
        if kind in (90, 72):
            end = data.index(0, at)
            if kind == 90:
                out[tag] = data[at:end].decode()
            at = end + 1
        elif kind == 66:
            sub, n = data[at], struct.unpack_from("<i", data, at + 1)[0]
            at += 5 + n * sizes[sub]
        else:
            at += sizes[kind]
    return out


def parse(data: bytes, refs: list[tuple[str, int]], keep_raw: bool) -> tuple:
    ref, pos, name_len, mapq, _, n_ops, flag, seq, _, mate, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + name_len
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in ops) or "*"
    span = sum(x >> 4 for x in ops if (x & 15) in (0, 2, 3, 7, 8))
    tags = _tags(data, at + 4 * n_ops + (seq + 1) // 2 + seq)
    name = data[32 : at - 1].decode()
    return (name, flag, ref, refs[ref][0] if 0 <= ref < len(refs) else None, pos + 1 if pos >= 0 else None, None if mapq == 255 else mapq, cigar, seq, span, mate + 1 if mate >= 0 else None, tlen, tags.get("CB"), tags.get("RG"), tags, data if keep_raw else None)


def reg2bin(start: int, end: int) -> int:
    """The smallest index bin that holds [start, end)."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return first + (start >> shift)
    return 0


def encode(row, ref_ids: dict[str, int]) -> bytes:
    """A record from columns; bases are unknown and qualities absent."""
    ops = [(int(n), OPS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", row["cigar"] or "")]
    name = (row["qname"] or "*").encode() + b"\0"
    ref = ref_ids.get(row["chrom"], -1)
    start = (row["pos"] or 0) - 1
    mate = (row["mate_pos"] or 0) - 1
    out = struct.pack("<iiBBHHHiiii", ref, start, len(name), 255 if row["mapq"] is None else row["mapq"], reg2bin(max(start, 0), max(start, 0) + max(1, row["ref_span"] or 0)), len(ops), row["flag"], row["seq_len"], ref if mate >= 0 else -1, mate, row["tlen"] or 0)
    out += name + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + b"\xff" * ((row["seq_len"] + 1) // 2) + b"\xff" * row["seq_len"]
    tags = dict(row["tags"] or {})
    tags.update({k: row[c] for k, c in (("CB", "cb"), ("RG", "rg")) if row[c] is not None})
    return out + b"".join(k.encode() + b"Z" + v.encode() + b"\0" for k, v in tags.items())


def patched(row, ref_ids: dict[str, int]) -> bytes:
    if row["raw"] is None:
        return encode(row, ref_ids)
    data = bytearray(row["raw"])
    start = (row["pos"] or 0) - 1
    struct.pack_into("<i", data, 4, start)
    struct.pack_into("<H", data, 10, reg2bin(max(start, 0), max(start, 0) + max(1, row["ref_span"] or 0)))
    struct.pack_into("<ii", data, 24, (row["mate_pos"] or 0) - 1, row["tlen"] or 0)
    return bytes(data)


def records(path: str, start: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, record) from ``start`` until one begins at or after ``end``."""
    with bgzf.Reader(path, start) as r:
        while end is None or r.tell() < end:
            at, size = r.tell(), r.read(4)
            if len(size) < 4:
                return
            yield at, r.read(struct.unpack("<i", size)[0])


# index -----------------------------------------------------------------------------------------------------------------
@dataclass
class RefIndex:
    chunks: list[tuple[int, int]]
    linear: list[int]
    mapped: int = 0
    unmapped: int = 0


def index_path(path: str) -> str | None:
    return next((p for p in (f"{path}.bai", f"{os.path.splitext(path)[0]}.bai") if os.path.exists(p)), None)


def read_index(path: str) -> list[RefIndex]:
    with open(path, "rb") as f:
        data = f.read()
    if data[:4] != b"BAI\1":
        raise ValueError(f"{path} is not a BAM index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        ref = RefIndex([], [])
        n_bins = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(n_bins):
            b, n = struct.unpack_from("<Ii", data, at)
            pairs = struct.unpack_from(f"<{2 * n}Q", data, at + 8)
            at += 8 + 16 * n
            if b == METADATA_BIN:
                ref.mapped, ref.unmapped = pairs[2], pairs[3]
            else:
                ref.chunks += list(zip(pairs[::2], pairs[1::2], strict=True))
        n = struct.unpack_from("<i", data, at)[0]
        ref.linear = list(struct.unpack_from(f"<{n}Q", data, at + 4))
        at += 4 + 8 * n
        out.append(ref)
    return out


def with_ends(path: str, start: int) -> Iterator[tuple[int, int, bytes]]:
    """(offset, offset of the next record, record); after the last one comes the end of the file."""
    before = None
    for at, data in records(path, start, None):
        if before:
            yield before[0], at, before[1]
        before = (at, data)
    if before:
        yield before[0], os.path.getsize(path) << 16, before[1]


def write_index(path: str) -> str:
    """Indexes a coordinate-sorted file."""
    _, refs, first = read_header(path)
    bins: list[dict[int, list[list[int]]]] = [{} for _ in refs]
    linear: list[dict[int, int]] = [{} for _ in refs]
    meta = [[0, 0, 0, 0] for _ in refs]
    unplaced, last = 0, None
    for at, end, d in with_ends(path, first):
        (ref, pos), (n_ops, flag) = struct.unpack_from("<ii", d), struct.unpack_from("<HH", d, 12)
        if ref < 0:
            unplaced += 1
            continue
        if last is not None and (ref, pos) < last:
            raise ValueError("only coordinate-sorted files can be indexed")
        last = (ref, pos)
        ops = struct.unpack_from(f"<{n_ops}I", d, 32 + d[8])
        stop = pos + max(1, sum(x >> 4 for x in ops if (x & 15) in (0, 2, 3, 7, 8)))
        chunks = bins[ref].setdefault(reg2bin(pos, stop), [])
        if chunks and chunks[-1][1] == at:
            chunks[-1][1] = end
        else:
            chunks.append([at, end])
        for w in range(pos >> 14, ((stop - 1) >> 14) + 1):
            linear[ref].setdefault(w, at)
        m = meta[ref]
        m[0], m[1] = m[0] or at, end
        m[3 if flag & 4 else 2] += 1
    out = bytearray(b"BAI\1" + struct.pack("<i", len(refs)))
    for k in range(len(refs)):
        out += struct.pack("<i", len(bins[k]) + (meta[k][1] > 0))
        for b, chunks in sorted(bins[k].items()):
            out += struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        if meta[k][1]:
            out += struct.pack("<Ii4Q", METADATA_BIN, 2, *meta[k])
        n, known = max(linear[k], default=-1) + 1, 0
        out += struct.pack("<i", n)
        for w in range(n):
            known = linear[k].get(w, known)
            out += struct.pack("<Q", known)
    out += struct.pack("<Q", unplaced)
    with open(f"{path}.bai", "wb") as f:
        f.write(out)
    return f"{path}.bai"


# sources ---------------------------------------------------------------------------------------------------------------
@dataclass
class Stretch(InputPartition):
    path: str
    sample: str
    start: int
    end: int | None


def stretches(path: str, sample: str, chrom: str | None, split_bytes: int) -> list[Stretch]:
    _, refs, first = read_header(path)
    index = index_path(path)
    if index is None:
        return [Stretch(path, sample, first, None)]
    known = read_index(index)
    lo, hi = first, None
    if chrom is not None:
        mine = [c for (name, _), ref in zip(refs, known, strict=False) if name == chrom for c in ref.chunks]
        if not mine:
            return []
        lo, hi = min(c[0] for c in mine), max(c[1] for c in mine)
    starts = sorted({x for ref in known for x in (*ref.linear, *(c[0] for c in ref.chunks)) if x > lo and (hi is None or x < hi)})
    cuts = [lo]
    for x in starts:
        if (x >> 16) - (cuts[-1] >> 16) >= split_bytes:
            cuts.append(x)
    return [Stretch(path, sample, a, b) for a, b in zip(cuts, [*cuts[1:], hi], strict=True)]


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.samples = options["samples"].split(",") if "samples" in options else [os.path.splitext(os.path.basename(p))[0] for p in self.paths]
        self.raw = options.get("raw", "false").lower() == "true"
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.chrom = options.get("chrom")

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chrom",) and self.chrom is None:
                self.chrom = f.value
            yield f

    def partitions(self):
        return [s for p, n in zip(self.paths, self.samples, strict=True) for s in stretches(p, n, self.chrom, self.split_bytes)]

    def read(self, part):
        if part is None:
            return
        _, refs, _ = read_header(part.path)
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [c.split()[0] for c in re.sub(r"<.*?>", "", ALIGNMENTS).split(", ")]

        def batch(rows):
            columns = list(zip(*rows, strict=True))
            columns[14] = [list(m.items()) for m in columns[14]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        rows: list[tuple] = []
        for _, data in records(part.path, part.start, part.end):
            rows.append((part.sample, *parse(data, refs, self.raw)))
            if len(rows) >= ROWS:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str


class BamWriter(DataSourceWriter):
    def __init__(self, options, overwrite):
        self.path, self.overwrite = options["path"], overwrite
        source = options.get("header_from")
        text, refs = "", []
        if source:
            text, refs, _ = read_header(source)
        elif "refs" in options:
            refs = [(n, int(k)) for n, _, k in (x.rpartition(":") for x in options["refs"].split(","))]
        self.refs, self.text = refs, header_text(refs, text, options.get("command", ""))
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator):
        from pyspark import TaskContext

        context, ids = TaskContext.get(), {n: k for k, (n, _) in enumerate(self.refs)}
        os.makedirs(self.parts, exist_ok=True)
        path = f"{self.parts}/{context.partitionId():06d}-{context.attemptNumber()}"
        with open(path, "wb") as f:
            out = bgzf.Writer(f)
            for row in iterator:
                data = patched(row, ids)
                out.write(struct.pack("<i", len(data)) + data)
            out.flush()
        return Part(context.partitionId(), path)

    def commit(self, messages):
        if os.path.exists(self.path) and not self.overwrite:
            raise FileExistsError(self.path)
        with open(f"{self.parts}.bam", "wb") as f:
            head = bgzf.Writer(f)
            head.write(header_bytes(self.text, self.refs))
            head.flush()
            for m in sorted((m for m in messages if m), key=lambda m: m.partition):
                with open(m.path, "rb") as part:
                    shutil.copyfileobj(part, f, 2**20)
            f.write(bgzf.EOF)
        os.replace(f"{self.parts}.bam", self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.parts, ignore_errors=True)


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return ALIGNMENTS

    def reader(self, schema):
        return BamReader(self.options)

    def writer(self, schema, overwrite):
        return BamWriter(self.options, overwrite)


class IndexReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.samples = options["samples"].split(",") if "samples" in options else [os.path.splitext(os.path.basename(p))[0] for p in self.paths]

    def partitions(self):
        return [Stretch(p, n, 0, None) for p, n in zip(self.paths, self.samples, strict=True)]

    def read(self, part):
        _, refs, _ = read_header(part.path)
        index = index_path(part.path)
        if index is None:
            raise FileNotFoundError(f"{part.path} has no index")
        known = read_index(index)
        for k, (name, length) in enumerate(refs):
            r = known[k] if k < len(known) else RefIndex([], [])
            yield part.sample, k, name, length, r.mapped, r.unmapped


class IndexSource(DataSource):
    @classmethod
    def name(cls):
        return "bam_index"

    def schema(self):
        return INDEX_STATS

    def reader(self, schema):
        return IndexReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    reachable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (BamSource, IndexSource):
        spark.dataSource.register(source)
    return spark


def read_bam(spark: SparkSession, paths: str | list[str], samples: list[str] | None = None, **options) -> DataFrame:
    many = [paths] if isinstance(paths, str) else list(paths)
    reader = register(spark).read.format("bam").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()})
    if samples:
        reader = reader.option("samples", ",".join(samples))
    return reader.load(",".join(many))


def read_refs(spark: SparkSession, path: str) -> DataFrame:
    _, refs, _ = read_header(path)
    return spark.createDataFrame([(k, n, size) for k, (n, size) in enumerate(refs)], REFS)


def read_index_stats(spark: SparkSession, paths: list[str], samples: list[str] | None = None) -> DataFrame:
    reader = register(spark).read.format("bam_index")
    return (reader.option("samples", ",".join(samples)) if samples else reader).load(",".join(paths))


def write_bam(reads: DataFrame, path: str, header_from: str | None = None, refs: list[tuple[str, int]] | None = None, command: str = "", sort: bool = True, index: bool = False) -> str:
    """One coordinate-sorted file (references in header order, unplaced reads last)."""
    spark = register(reads.sparkSession)
    from pyspark.sql import functions as F

    if sort:
        place = F.when(F.coalesce(F.col("ref_id"), F.lit(-1)) < 0, F.lit(2**31 - 1)).otherwise(F.col("ref_id"))
        reads = reads.withColumn("_place", place).repartitionByRange("_place", F.col("pos").asc_nulls_last()).sortWithinPartitions("_place", F.col("pos").asc_nulls_last()).drop("_place")
    names = [c.split()[0] for c in re.sub(r"<.*?>", "", ALIGNMENTS).split(", ")]
    kinds = spark.createDataFrame([], ALIGNMENTS).schema
    reads = reads.select(*[(F.col(c) if c in reads.columns else F.lit(None)).cast(kinds[c].dataType).alias(c) for c in names])
    out = reads.write.format("bam").mode("overwrite").option("command", command)
    if header_from:
        out = out.option("header_from", header_from)
    elif refs:
        out = out.option("refs", ",".join(f"{n}:{k}" for n, k in refs))
    out.save(path)  # the target is replaced when all parts are written, not before
    if index:
        write_index(path)
    return path


class MissingInput(FileNotFoundError, RuntimeError):
    """A file that is needed does not exist."""


def validate(paths: list[str]) -> None:
    for p in paths:
        if not os.path.exists(p):
            raise MissingInput(f"{p} does not exist")
        if index_path(p) is None:
            raise MissingInput(f"{p} has no index ({p}.bai)")

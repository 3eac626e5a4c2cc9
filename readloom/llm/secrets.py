"""Secret scans with corpus-wide ownership frequency.

Method. Every text is searched for assignments, access ids and long hex runs (base kinds) and for further high-entropy
tokens. Candidate values are hashed and counted over the corpus by distinct owners and by distinct repositories per
owner; both counts are sums of pre-aggregated rows. A value that ``min_owners`` owners or ``min_repositories``
repositories hold is a widely copied example; any other is an owner-specific, live-looking credential. Live high-entropy
tokens join the spans; base spans stay whatever their verdict. Masking replaces live spans.

Edge cases: null texts are empty; a null owner or repository counts as one of its own; equal rows get equal results,
one row per row; texts without candidates pass no join and stay where they are when others are masked; values are known
by 64-bit hashes; extra columns, whatever their names, are ignored or returned unchanged. Work on a text is in
proportion to its length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import documents, matched, unused, written

KINDS = ("assign", "access", "hex", "entropy")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ENTROPY = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
#: Every text with a candidate matches this (for Spark's ``rlike``); it decides only which rows a join can concern.
TRIGGER = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}|[A-Za-z0-9+/_=-]{24}"
HEX_BYTES = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
TOKEN_BYTES = bytes(1 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-" else 0 for b in range(256))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def candidates(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) in order. Cheap byte searches decide which patterns can match at all."""
    raw = (text or "").encode()
    out: list[tuple[int, int, int, str]] = []
    low = raw.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if b"\1" * 32 in raw.translate(HEX_BYTES):
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    if b"\1" * 24 in raw.translate(TOKEN_BYTES):
        taken = joined_spans([(s, e) for s, _, e, _ in out])
        starts = [s for s, _ in taken]
        for m in ENTROPY.finditer(text):
            v, before = m[0], bisect_right(starts, m.end() - 1)
            if before and taken[before - 1][1] > m.start():
                continue
            if re.search("[0-9]", v) and re.search("[A-Za-z]", v) and entropy(v) >= 3.5:
                out.append((m.start(), 3, m.end(), v))
    return sorted(out)


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping (start, end) joined, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def found(docs: DataFrame, owner: str = "source", repository: str = "doc_id", text: str = "text") -> DataFrame:
    """The narrow table: (doc_id, key, owner, repository, spans of start, kind, end, value)."""

    def rows(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.int64())]))
        for batch in batches:
            spans = []
            for t in batch.column(4):
                value = lambda v: int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True)
                spans.append([{"start": s, "kind": k, "end": e, "value": value(v)} for s, k, e, v in candidates(t.as_py())])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(spans, kind)], ["doc_id", "key", "owner", "repository", "spans"])

    plain = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(plain).alias("key"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), plain.alias("text"))
    return named.mapInArrow(rows, "doc_id long, key long, owner string, repository string, spans array<struct<start: int, kind: int, end: int, value: bigint>>")


def scanned(docs: DataFrame, min_owners: int = 5, min_repositories: int = 1000, owner: str = "source", repository: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, key, spans) with each span's kind, owners, repositories and ``live``."""
    rows = written(found(docs, owner, repository, text), "secrets")
    some = rows.filter(F.size("spans") > 0)
    each = some.select("doc_id", "key", "owner", "repository", F.explode("spans").alias("s"))
    per_repository = each.groupBy("s.value", "owner", "repository").agg(F.lit(1).alias("one"))
    per_owner = per_repository.groupBy("value", "owner").agg(F.count("*").alias("repositories"))
    values = per_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    judged = each.join(values, F.col("s.value") == F.col("value")).select("doc_id", "key", F.struct("s.start", "s.kind", "s.end", "owners", "repositories", ((F.col("owners") < min_owners) & (F.col("repositories") < min_repositories)).alias("live")).alias("span"))
    judged = judged.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.array_sort(F.collect_set("span")).alias("spans"))
    with_spans = some.select("doc_id", "key").join(judged, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).select("doc_id", "key", "spans")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,owners:bigint,repositories:bigint,live:boolean>>")
    return with_spans.unionByName(rows.filter(F.size("spans") == 0).select("doc_id", "key", none.alias("spans")))


def covered(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with ``mark`` for each span; a span that begins within one before it is part of that one."""
    parts, at = [], 0
    for s, e in spans:
        if s >= at:
            parts += [text[at:s], mark]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def masked(docs: DataFrame, mark: str = "[secret]", **options) -> DataFrame:
    """``docs`` with live spans replaced by ``mark`` and ``n_chars`` renewed; other rows and columns as they are.

    Whether a text can have candidates shows in the text alone: only such rows are dealt by id and text to meet their live
    spans, the others pass where they are."""
    live = F.filter("spans", lambda s: s["live"] & (s["end"] > s["start"]))
    spans = scanned(docs, **options).select("doc_id", "key", live.alias("spans")).filter(F.size("spans") > 0)
    spans = written(spans.groupBy("doc_id", "key").agg(F.first("spans").alias("spans")), "live")  # equal rows have equal spans

    @F.arrow_udf("string")
    def cover(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True)
        return pa.array([t if s is None else covered(t, list(zip(s, e, strict=True)), mark) for t, s, e in rows], pa.string())

    key, number, mine = unused(docs.columns, "key", "number", "spans")
    may = F.coalesce(F.col("text").rlike(TRIGGER), F.lit(False))
    some = docs.filter(may).withColumns({key: F.xxhash64("text"), number: F.col("doc_id").cast("long")})
    some = matched(some, spans.withColumnsRenamed({"doc_id": number, "key": key, "spans": mine}), [number, key], "left")
    renewed = {"text": cover("text", F.transform(mine, lambda s: s["start"]), F.transform(mine, lambda s: s["end"]))}
    some = some.withColumn("text", renewed["text"])
    if "n_chars" in docs.columns:
        some = some.withColumn("n_chars", F.when(F.col(mine).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return docs.filter(~may).unionByName(some.select(*docs.columns))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = scanned(documents(spark, sf_dir))
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.filter("spans", lambda s: (s["kind"] < 3) | s["live"])).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )

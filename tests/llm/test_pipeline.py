"""Each stage of the pipeline against a plain version on what its predecessor kept."""

import struct
import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from readloom.llm import oracle, secrets

from .test_contracts import SCHEMA, SF, awkward, brute_components, brute_quality, check_bins, tokens_of


@pytest.fixture(scope="module", params=["small", "awkward", "empty"])
def steps(request, spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    rows = spark.read.parquet(f"{SF}/documents.parquet") if request.param == "small" else spark.createDataFrame(awkward() if request.param == "awkward" else [], SCHEMA)
    rows.write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out, folder


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_columns_and_order(steps):
    frames, _ = steps
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "secret scans", "mixing sources to target weights", "best-fit packing"]
    assert all(f.columns == frames[0].columns for f in frames[:-1])


def test_quality_stage(steps):
    frames, _ = steps
    want = [r for r in rows_of(frames[0]) if not brute_quality({"text": r[1]})[-1]]
    assert Counter(rows_of(frames[1])) == Counter(want)


def test_near_dedup_stage(steps):
    frames, _ = steps
    rows = rows_of(frames[1])
    _, find = brute_components([{"doc_id": r[0], "text": r[1]} for r in rows if r[0] is not None], 5)
    stay = [r for r in rows if r[0] is None or find(r[0]) == r[0]]
    assert Counter(rows_of(frames[2])) == Counter([r for r in stay if r[0] is None] + list({r for r in stay if r[0] is not None}))


def test_secret_stage(steps):
    frames, _ = steps
    rows, owners = rows_of(frames[2]), {}
    for r in rows:
        for *_, v in secrets.candidates(r[1]):
            owners.setdefault(v, set()).add(r[3])
    want = []
    for d, t, lang, source, n in rows:
        live = [(s, e) for s, _, e, v in secrets.candidates(t) if len(owners[v]) < 5]
        if live:
            out, at = "", 0
            for s, e in live:
                if s >= at:
                    out, at = out + t[at:s] + "[secret]", e
                else:
                    at = max(at, e)
            t = out + t[at:]
            n = len(t)
        want.append((d, t, lang, source, n))
    assert Counter(rows_of(frames[3])) == Counter(want)


def test_mixing_stage(steps):
    frames, folder = steps
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/2/*.parquet'")
    taken = {(r[0], r[1]): r[2] for r in c.sql(f"SELECT doc_id, size, taken FROM ({oracle.mixing()})").fetchall()}
    copies = {d: (int(t / n + 0.5) if n else 0) for (d, n), t in taken.items()}
    want = Counter()
    for r in rows_of(frames[3]):
        if copies[r[0]]:
            want[r] += copies[r[0]]
    assert Counter(rows_of(frames[4])) == want


def test_packing_stage(steps):
    frames, _ = steps
    got = frames[5].collect()
    want = Counter()
    for r in rows_of(frames[4]):
        ids = tokens_of(r[1])
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[r[0], k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    check_bins((r["sequence_id"], r["offset"], r["length"]) for r in got)


def test_run(spark, steps):
    frames, folder = steps
    assert corpus_pipeline.run(spark, str(folder)).count() == frames[5].count()

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom import api, cli
from readloom.operators.coverage import pileup
from readloom.operators.filters import LIBRARY, PYTHON
from readloom.plans import fixtures as fx
from readloom.sources import bam, bgzf, bigwig, text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bams(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bam")
    reads = fx.alignments(spark, SF)
    refs = [(r["chrom"], r["length"]) for r in fx.refs(spark).orderBy("ref_id").collect()]
    return [bam.write_bam(reads.filter(F.col("sample") == s), str(folder / f"{s}.bam"), refs=refs, index=True) for s in ("S0", "S1")]


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_bgzf_round_trip(tmp_path):
    data = bytes(range(256)) * 1000
    with open(tmp_path / "x", "wb") as f:
        w = bgzf.Writer(f)
        w.write(data)
        w.flush()
        f.write(bgzf.EOF)
    with bgzf.Reader(str(tmp_path / "x")) as r:
        assert r.read(70_000) == data[:70_000]
        at = r.tell()
        rest = r.read(10**7)
        assert rest == data[70_000:]
        r.seek(at)
        assert r.read(10) == rest[:10]


def test_bam_round_trip_reads_each_record_once(spark, bams):
    names = ["qname", "flag", "chrom", "pos", "mapq", "cigar", "seq_len", "ref_span", "mate_pos", "tlen", "cb", "rg"]
    want = fx.alignments(spark, SF).filter("sample = 'S0'").select(*names)
    whole = bam.read_bam(spark, bams[0])
    cut = bam.read_bam(spark, bams[0], split_bytes=1)
    assert cut.rdd.getNumPartitions() > 3
    for got in (whole, cut):
        assert same(got.select(*names), want)
    one = whole.filter("chrom = 'chr2'")
    assert same(one.select(*names), want.filter("chrom = 'chr2'"))
    assert whole.select(F.element_at("tags", F.lit("VP"))).distinct().count() == 7


def test_index_counts(spark, bams):
    got = bam.read_index_stats(spark, bams).select("sample", "chrom", "mapped", "unmapped")
    from readloom.operators.split import index_stats

    want = index_stats(fx.alignments(spark, SF).filter("sample in ('S0','S1')"), fx.refs(spark)).select("sample", "chrom", "mapped", "unmapped")
    assert same(got, want)


def test_split_keeps_bytes_and_adds_provenance(spark, bams, tmp_path):
    out = api.split_bam(spark, bams[0], str(tmp_path / "o.bam"), PYTHON.having(strand="forward"), "a command")
    before = bam.read_bam(spark, bams[0], raw=True).filter("flag & 16 = 0 and flag & 4 = 0").select("raw")
    assert same(before, bam.read_bam(spark, out, raw=True).select("raw"))
    head = bam.read_header(out)[0]
    assert "@PG\tID:readloom.1" in head and "CL:a command" in head


def test_modify_and_split_exogenous(spark, bams, tmp_path):
    from readloom.operators.intervals import tn5_adjusted
    from readloom.operators.filters import passing

    out = api.modify(spark, bams[0], str(tmp_path / "m.bam"), True, PYTHON)
    want = tn5_adjusted(passing(bam.read_bam(spark, bams[0]), PYTHON), fx.refs(spark)).select("qname", "pos", "tlen", "mate_pos")
    assert same(bam.read_bam(spark, out).select("qname", "pos", "tlen", "mate_pos"), want)
    row = api.split_exogenous(spark, bams[0], str(tmp_path / "x.bam"), "spike_", str(tmp_path / "s.json"), PYTHON)
    assert json.loads((tmp_path / "s.json").read_text())["n_exogenous"] == row["n_exogenous"] > 0
    assert bam.read_bam(spark, str(tmp_path / "x.exogenous.bam")).count() == row["n_exogenous"]
    assert bam.read_bam(spark, str(tmp_path / "x.both.bam")).count() == 0


def test_bigwig_round_trip(spark, tmp_path):
    refs, rows = fx.track_refs(spark, SF), fx.tracks(spark, SF).filter("track = 0").select("chrom", "start", "end", "value")
    path = bigwig.write_bigwig(rows, refs, str(tmp_path / "t.bw"))
    assert same(bigwig.read_bigwig(spark, path).select("chrom", "start", "end", "value"), rows)
    assert same(bigwig.read_bigwig(spark, path, blocks_per_partition=1).filter("chrom = 'chr2'").drop("track"), rows.filter("chrom = 'chr2'"))
    assert [tuple(r) for r in bigwig.read_chroms(spark, path).orderBy("ref_id").select("chrom", "length").collect()] == [tuple(r) for r in refs.orderBy("ref_id").select("chrom", "length").collect()]


def test_bigwig_zoom_levels(spark, tmp_path):
    refs, rows = fx.track_refs(spark, SF), fx.tracks(spark, SF).filter("track = 0").select("chrom", "start", "end", "value")
    file = bigwig.File(bigwig.write_bigwig(rows, refs, str(tmp_path / "z.bw")))
    want = rows.agg(F.sum(F.col("end") - F.col("start")), F.sum(F.col("value").cast("double") * (F.col("end") - F.col("start"))), F.min("value"), F.max("value")).first()
    assert [z[0] for z in file.zooms] == list(bigwig.ZOOMS)
    for level in bigwig.ZOOMS:
        got = file.summaries(level)
        assert sum(r[3] for r in got) == want[0] and sum(r[6] for r in got) == pytest.approx(want[1], rel=1e-5)
        assert (min(r[4] for r in got), max(r[5] for r in got)) == (want[2], want[3])
        assert all(r[1] // level == (r[2] - 1) // level for r in got) and got == sorted(got)


def test_bigwig_many_blocks_and_chromosomes(spark, tmp_path):
    refs = spark.range(600).select(F.col("id").cast("int").alias("ref_id"), F.concat(F.lit("c"), F.col("id")).alias("chrom"), F.lit(1000).cast("long").alias("length"))
    rows = refs.crossJoin(spark.range(2)).select("chrom", (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 5).alias("end"), F.col("ref_id").cast("float").alias("value"))
    path = bigwig.write_bigwig(rows, refs, str(tmp_path / "m.bw"))
    assert same(bigwig.read_bigwig(spark, path).drop("track"), rows)


def test_bigwig_commands(spark, tmp_path):
    refs = spark.createDataFrame([(0, "chr2", 200), (1, "chr1", 200)], "ref_id int, chrom string, length bigint")
    paths = []
    for k, values in enumerate([(2.0, 8.0), (6.0, 12.0)]):
        rows = spark.createDataFrame([("chr2", 0, 100, values[0]), ("chr1", 0, 100, values[1])], "chrom string, start bigint, end bigint, value double")
        paths.append(bigwig.write_bigwig(rows, refs, str(tmp_path / f"{k}.bw")))
    out = api.bigwig_aggregate(spark, paths, str(tmp_path / "mean.bw"), "mean", 100)
    got = {(r["chrom"], r["start"]): (r["end"], r["value"]) for r in bigwig.read_bigwig(spark, out).collect()}
    assert got == {("chr2", 0): (100, 4.0), ("chr2", 100): (200, 0.0), ("chr1", 0): (100, 10.0), ("chr1", 100): (200, 0.0)}
    assert [r["chrom"] for r in bigwig.read_chroms(spark, out).orderBy("ref_id").collect()] == ["chr2", "chr1"]
    out = api.bigwig_compare(spark, paths[1], paths[0], str(tmp_path / "d.bw"), "subtraction", 100)
    assert {r["value"] for r in bigwig.read_bigwig(spark, out).collect()} == {4.0, 0.0}
    with pytest.raises(ValueError):
        api.bigwig_aggregate(spark, paths, str(tmp_path / "e.bw"), "mean", 100, scale_factors=[1.0])


def test_signal_array(spark, bams):
    got = api.get_signal_for_chromosome(spark, bams[0], "chr3", 1)
    assert got.dtype == np.float32 and got.shape == (100_003,)
    want = np.zeros(100_003, "float32")
    for r in bam.read_bam(spark, bams[0]).filter("chrom = 'chr3' and flag & 4 = 0 and flag & 2 <> 0").collect():
        want[r["pos"] - 1 : r["pos"] - 1 + r["ref_span"]] += 1
    assert (got == want).all()
    with pytest.raises(KeyError):
        api.get_signal_for_chromosome(spark, bams[0], "chr99")
    with pytest.raises(FileNotFoundError):
        api.get_signal_for_chromosome(spark, "/nowhere.bam", "chr1")


def test_scale_factors(spark, bams, tmp_path):
    for method in ("tmm", "csaw-background", "cpm", "median-of-ratios"):
        r = api.compute_scale_factors(spark, bams, method, 20_000, return_counts=method == "cpm")
        assert len(r.scale_factors) == 2 and all(x > 0 for x in r.scale_factors)
        if method == "cpm":
            assert r.counts().shape == (len(r.bin_chroms), 2) and r.counts().dtype == np.uint64 and r.counts().sum() > 0
            assert len(r.bin_starts) == len(r.bin_ends) == len(r.bin_chroms) and min(r.bin_starts) == 1
        else:
            assert r.counts() is None and r.bin_chroms == ()
    r = api.compute_scale_factors(spark, [bams[0], bams[0]], "tmm", 20_000)
    assert r.samples == ["S0", "S0_1"] and r.norm_factors == pytest.approx([1, 1])
    assert api.compute_scale_factors(spark, bams, "spike-in", exogenous_prefix="spike_").library_sizes[0] > 0
    for bad in ({"method": "none"}, {"method": "spike-in"}):
        with pytest.raises(ValueError):
            api.compute_scale_factors(spark, bams, **bad)
    for bad in ((bams[:1], "tmm"), ([], "cpm")):
        with pytest.raises(ValueError):
            api.compute_scale_factors(spark, *bad)
    with pytest.raises(RuntimeError):
        api.compute_scale_factors(spark, ["does_not_exist.bam"], "cpm")
    assert api.compute_scale_factors(spark, bams, "cpm", sample_names=["p", "q"]).sample_names == ["p", "q"]


def test_command_line(spark, bams, tmp_path, capsys):
    assert cli.main(["coverage", "--bam", bams[0], "-o", str(tmp_path / "c.bw"), "--bin-size", "1000", "--normalize", "cpm"]) == 0
    got = bigwig.read_bigwig(spark, str(tmp_path / "c.bw"))
    want = pileup(bam.read_bam(spark, bams[0]), fx.refs(spark), 1000, LIBRARY.having(proper_pair=False, min_mapq=20, min_length=20), method="cpm")
    assert got.agg(F.round(F.sum(F.col("value") * (F.col("end") - F.col("start"))), -3)).first()[0] == want.agg(F.round(F.sum(F.col("score") * (F.col("end") - F.col("start"))), -3)).first()[0]
    assert cli.main(["multi-coverage", "--bams", *bams, "-o", str(tmp_path / "m.tsv"), "--bin-size", "5000"]) == 0
    assert spark.read.csv(str(tmp_path / "m.tsv"), sep="\t", header=True).columns == ["chrom", "start", "end", "S0", "S1"]
    assert cli.main(["norm-factors", "--bams", *bams, "--method", "cpm", "--format", "tsv"]) == 0
    assert capsys.readouterr().out.startswith("sample\tmethod")
    assert cli.main(["coverage", "--bam", "/nowhere.bam"]) == 1
    assert cli.main(["bigwig-compare"]) == 2 and cli.main(["nonesuch"]) == 2 and cli.main(["--help"]) == 0
    import signal

    before = signal.getsignal(signal.SIGINT)
    assert cli.main(["--version"]) == 0 and cli.main(["coverage", "--bam", "/nowhere.bam"]) == 1 and signal.getsignal(signal.SIGINT) is before
    (tmp_path / "far.bed").write_text("chr77\t5\t9\n")
    assert cli.main(["split", "-i", bams[0], "-o", str(tmp_path / "f.bam"), "--blacklist", str(tmp_path / "far.bed")]) == 1
    kept = open(bams[0], "rb").read()
    assert cli.main(["split", "-i", bams[0], "-o", bams[0]]) == 1 and open(bams[0], "rb").read() == kept
    assert cli.main(["-v", "2", "coverage", "--bam", bams[0], "-o", str(tmp_path / "c.bedgraph"), "--bin-size", "5000"]) == 0
    assert "reads kept" in capsys.readouterr().err
    lines = [x.split("\t") for x in (tmp_path / "c.bedgraph").read_text().splitlines()]
    assert all(len(x) == 4 for x in lines) and [(x[0], int(x[1])) for x in lines] == sorted((x[0], int(x[1])) for x in lines)
    assert (tmp_path / "m.tsv").read_text().startswith("chrom\tstart\tend\tS0\tS1\nchr1\t0\t")
    assert [p.name for p in tmp_path.iterdir() if "parts-" in p.name] == []


def test_infer_scale_command(spark, tmp_path, capsys):
    rows = spark.createDataFrame([(c, k * 10, k * 10 + 10, v) for c in ("chr5", "chr7") for k, v in enumerate((0.01, 0.02, 0.01, 0.02), 1)], "chrom string, start bigint, end bigint, value double")
    refs = spark.createDataFrame([(0, "chr5", 1000), (1, "chr7", 1000)], "ref_id int, chrom string, length bigint")
    path = bigwig.write_bigwig(rows, refs, str(tmp_path / "i.bw"))
    assert cli.main(["infer-scale", path, "--format", "json"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["norm_method"] == "CPM" and got["bin_size"] == 10 and got["confident"] and got["scale_factor"] == pytest.approx(100, rel=1e-5)


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.bdg").write_text("# c\n\nchr1 0 10 1.0\nchr1\t10\t20\t1.0000004\nchr1 20 30 2\nchr1 5\n")
    api.collapse_bedgraph(spark, str(tmp_path / "a.bdg"), str(tmp_path / "o.bdg"))
    assert sorted(text.read_bedgraph(spark, str(tmp_path / "o.bdg")).collect()) == [("chr1", 0, 20, 1.0), ("chr1", 20, 30, 2.0)]
    (tmp_path / "bad.bdg").write_text("chr1 x 10 1.0\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        text.read_bedgraph(spark, str(tmp_path / "bad.bdg")).collect()
    (tmp_path / "b.bed").write_text("chr1\t5\t9\tx\n")
    assert text.read_bed(spark, str(tmp_path / "b.bed")).collect() == [("chr1", 5, 9)]
    assert text.read_bed(spark, str(tmp_path / "b.bed"), compat=True).collect() == [("chr1", 5, 8)]
    (tmp_path / "e.bed").write_text("")
    with pytest.raises(ValueError):
        text.read_bed(spark, str(tmp_path / "e.bed"))
    (tmp_path / "c.csv").write_text("barcode,x\nA,1\nA,2\nB,3\n")
    (tmp_path / "p.txt").write_text("A\nB\n")
    for name in ("c.csv", "p.txt"):
        assert sorted(r[0] for r in text.read_barcodes(spark, str(tmp_path / name)).collect()) == ["A", "B"]
    (tmp_path / "n.csv").write_text("barcode,x\n,1\n")
    with pytest.raises(Exception, match="without a barcode"):
        text.read_barcodes(spark, str(tmp_path / "n.csv")).collect()
    (tmp_path / "s.csv").write_text("a,b\nX,Y\n,Z\n")
    assert sorted(text.read_barcode_sets(spark, str(tmp_path / "s.csv")).collect()) == [(0, "X"), (1, "Y"), (1, "Z")]
    (tmp_path / "sheet.csv").write_text("sample,bam\nq,/x.bam\n")
    assert text.read_sample_sheet(spark, str(tmp_path / "sheet.csv")) == [("q", "/x.bam")]
    assert text.kind_of("a.BW") == "bigwig" and text.kind_of("b.tsv") == "table"
    with pytest.raises(ValueError):
        text.kind_of("x.bam")

import math

import pytest
from pyspark.sql import functions as F

from readloom.functions import parse
from readloom.functions.reads import cigar_span, gcd_of
from readloom.operators import infer, norm, split
from readloom.operators import tracks as trk
from readloom.operators.binning import collapsed, counted, grid, run_lengths
from readloom.operators.coverage import pileup, side_by_side
from readloom.operators.filters import LIBRARY, PYTHON, funnel, merged_intervals, passing, require_paired, staged
from readloom.operators.intervals import coordinates, fragment_intervals, rewritten, shifted, tn5_adjusted, truncated

READ = "qname string, flag int, ref_id int, chrom string, pos long, mapq int, seq_len int, ref_span int, tlen int, mate_pos long, cb string, rg string, tags map<string,string>, sample string"


def reads(spark, *rows):
    base = {"qname": "q", "flag": 3, "ref_id": 0, "chrom": "chr1", "pos": 101, "mapq": 60, "seq_len": 50, "ref_span": 50, "tlen": 200, "mate_pos": 251, "cb": None, "rg": None, "tags": {}, "sample": "s"}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], READ)


def refs(spark, **lengths):
    return spark.createDataFrame([(k, c, n) for k, (c, n) in enumerate((lengths or {"chr1": 1000}).items())], "ref_id int, chrom string, length long")


def signal(spark, rows, value="score", kind="double"):
    return spark.createDataFrame(rows, f"chrom string, start long, end long, {value} {kind}")


def rows_of(df, *c):
    return sorted(tuple(r) for r in df.select(*c).collect())


def test_parsers():
    assert parse.shift("4,-5, 5,x") == (4, -5, 5, 0) and parse.truncation("3,x") == (3, None)
    assert [parse.strand(s) for s in ("FWD", "-", "both")] == ["forward", "reverse", "both"]
    assert parse.sample_names(["/a/x.bam", "/b/x.bam", "y.bam", "x.bam"]) == ["x", "x_1", "y", "x_2"]
    assert parse.sample_names(["a/x", "b/x", "c/x_1"]) == ["x", "x_2", "x_1"]
    for f, bad in ((parse.shift, "1,2"), (parse.truncation, "1"), (parse.strand, "up")):
        with pytest.raises(ValueError):
            f(bad)


def test_span_and_gcd(spark):
    df = spark.createDataFrame([("10M2D5M3I4S", [20, 50, 30]), ("5=1X2N3H", []), ("*", [7])], "c string, v array<long>")
    assert [(r[0], r[1]) for r in df.select(cigar_span("c"), gcd_of(F.col("v"))).collect()] == [(17, 10), (8, 0), (0, 7)]


@pytest.mark.parametrize(("row", "options", "stage"), [
    ({"flag": 1024 | 256 | 3}, {"ignore_duplicates": True, "ignore_secondary": True}, "duplicate"),
    ({"flag": 256 | 3}, {"ignore_secondary": True}, "secondary"),
    ({"flag": 2048 | 3}, {"ignore_supplementary": True}, "supplementary"),
    ({"flag": 16 | 3}, {"strand": "forward"}, "strand"),
    ({}, {"strand": "reverse"}, "strand"),
    ({"flag": 1}, {"proper_pair": True}, "proper_pair"),
    ({"flag": 7}, {}, "mapq"),
    ({"mapq": 5}, {"min_mapq": 6}, "mapq"),
    ({"mapq": None}, {"min_mapq": 6}, None),
    ({"seq_len": 1001}, {}, "read_length"),
    ({"tlen": -99}, {"min_fragment": 100}, "fragment_length"),
    ({"tlen": -100}, {"min_fragment": 100, "max_fragment": 100}, None),
    ({"ref_id": -1, "chrom": None}, {}, "no_reference"),
    ({"pos": None}, {}, "mapq"),
    ({"rg": "a"}, {"read_group": "b"}, "read_group"),
    ({}, {"read_group": "b"}, "read_group"),
    ({"tags": {"XX": "1"}}, {"tag": "XX", "tag_value": "1"}, None),
    ({"tags": {"XX": "1"}}, {"tag": "XX", "tag_value": "2"}, "tag"),
    ({"tags": {"XXX": "1"}}, {"tag": "XXX", "tag_value": "1"}, "tag"),
    ({"tags": {"XX": "1"}}, {"tag": "XX"}, None),
])
def test_filter_stages(spark, row, options, stage):
    assert staged(reads(spark, row), PYTHON.having(**options)).first()["fail_stage"] == stage


def test_blacklist_edges_and_barcodes(spark):
    black = spark.createDataFrame([("chr1", 0, 10), ("chr1", 5, 100), ("chr1", 150, 151), ("chr1", 40_000, 40_010)], "chrom string, start long, end long")
    assert rows_of(merged_intervals(black), "chrom", "start", "end") == [("chr1", 0, 100), ("chr1", 150, 151), ("chr1", 40_000, 40_010)]
    got = staged(reads(spark, *[{"pos": p, "qname": str(p)} for p in (100, 101, 102, 151, 152, 39_951, 39_952)]), PYTHON.having(blacklist=black))
    assert {r["qname"]: r["fail_stage"] for r in got.collect()} == {"100": "blacklist", "101": None, "102": "blacklist", "151": "blacklist", "152": None, "39951": None, "39952": "blacklist"}
    allow = spark.createDataFrame([("A",), ("A",)], "barcode string")
    got = staged(reads(spark, {"cb": "A"}, {"cb": "B"}, {}), PYTHON.having(barcodes=allow))
    assert sorted(str(r["fail_stage"]) for r in got.collect()) == ["None", "barcode", "barcode"]


def test_presets_funnel_and_pairing(spark):
    r = reads(spark, {}, {"flag": 1}, {"flag": 1025})
    assert passing(r, LIBRARY).count() == 1 and passing(r, PYTHON).count() == 3
    got = {x["label"]: (x["remaining"], x["dropped"]) for x in funnel(r, PYTHON.having(ignore_duplicates=True, proper_pair=True)).collect()}
    assert got == {"all reads": (3, 0), "first copies": (2, 1), "reads in a proper pair": (1, 1), "reads kept": (1, 0)}
    assert {x["percent"] for x in funnel(r.limit(0), PYTHON).collect()} == {0.0}
    with pytest.raises(ValueError):
        require_paired(reads(spark, {"flag": 0}), PYTHON.having(min_fragment=1))


@pytest.mark.parametrize(("flag", "start", "end", "used"), [(16 | 64, 100 + 20, 150 + 30, 50), (16, 100 - 40, 150 + 30, 70), (64, 100 - 10, 150 + 20, 30), (0, 100 - 10, 150 + 40, 50)])
def test_shift_cases(spark, flag, start, end, used):
    """Shifts (10, -20 or 20, 30, 40): starts move back by the first of the pair used, ends forward by the second."""
    three = -20 if flag == 80 else 20
    out = shifted(reads(spark, {"flag": flag}).selectExpr("*", "100L as start", "150L as end", "1000L as length"), (10, three, 30, 40)).first()
    assert (out["start"], out["end"]) == (start, end)
    assert out["dtlen"] == (used if flag != 80 else 10)


def test_shift_clamps_and_truncation_inverts(spark):
    iv = reads(spark, {}).selectExpr("*", "5L as start", "990L as end", "1000L as length")
    out = shifted(iv, (50, 0, 0, 50)).first()
    assert (out["start"], out["end"]) == (0, 1000)
    assert truncated(iv, 600, 600).filter("end > start").isEmpty()
    assert coordinates(reads(spark, {}), refs(spark), truncate=(30, 30)).isEmpty()
    assert rewritten(reads(spark, {"flag": 64, "tlen": -200}), refs(spark), (10, 5, 0, 0)).first()["tlen"] == -215


def test_fragments(spark):
    r = reads(spark, {"flag": 64}, {"flag": 64, "tlen": -150}, {"flag": 64, "tlen": 0}, {"flag": 128})
    assert rows_of(fragment_intervals(r), "start", "end") == [(100, 300), (250, 400)]


@pytest.mark.parametrize(("flag", "pos", "tlen", "want"), [(3, 101, 200, (105, 191, 251)), (19, 101, -200, (101, -191, 255)), (1, 101, 200, None), (3, 998, 200, None), (19, 951, -200, (951, -191, 255)), (19, 957, -200, None)])
def test_tn5(spark, flag, pos, tlen, want):
    out = tn5_adjusted(reads(spark, {"flag": flag, "pos": pos, "tlen": tlen}), refs(spark)).collect()
    assert [(r["pos"], r["tlen"], r["mate_pos"]) for r in out] == ([want] if want else [])
    far = tn5_adjusted(reads(spark, {"flag": 19, "tlen": -9, "mate_pos": 998}), refs(spark)).first()
    assert (far["mate_pos"], far["tlen"]) == (998, 0)


def test_counts_both_ways_and_grid(spark):
    iv = spark.createDataFrame([("chr1", 0, 25, 103), ("chr1", 9, 10, 103), ("chr1", 95, 400, 103), ("chr1", 50, 50, 103)], "chrom string, start long, end long, length long")
    for bs in (3, 10, 50, 500):
        want = {}
        for a, b in ((0, 25), (9, 10), (95, 103)):
            for k in range(a // bs, (b - 1) // bs + 1):
                want[k] = want.get(k, 0) + 1
        assert {r["bin"]: r["n"] for r in counted(iv, bs).collect()} == want
    assert rows_of(grid(refs(spark, chr1=103), 50), "start", "end") == [(0, 50), (50, 100), (100, 103)]
    with pytest.raises(ValueError):
        grid(refs(spark), 0)


def test_small_bins_over_stripes(spark):
    iv = spark.createDataFrame([("c", 1_048_570, 2_200_000, 3_000_000)], "chrom string, start long, end long, length long")
    got = counted(iv, 10)
    assert got.count() == 220_000 - 104_857 and got.agg(F.min("bin"), F.max("bin"), F.max("n")).first() == (104_857, 219_999, 1)


def test_coverage_factors_and_empty(spark):
    r = reads(spark, *[{}] * 4)
    score = lambda **o: pileup(r, refs(spark), 1000, PYTHON, **o).first()["score"]
    assert score() == 4 and score(method="cpm") == 1e6 and score(method="rpkm") == 1e6 and score(scale=0.5) == 2
    assert [x["score"] for x in pileup(r.limit(0), refs(spark), 500, method="cpm").collect()] == [0.0, 0.0]
    assert pileup(r, refs(spark), 5_000_000, PYTHON).count() == 1
    assert side_by_side(r.union(reads(spark, {"sample": "t", "flag": 7})), refs(spark), ["s", "t"], bin_size=1000, spec=PYTHON).first()[3:] == (4.0, 0.0)


def test_collapse_vectors(spark):
    s = signal(spark, [("chr1", 0, 10, 1.0), ("chr1", 10, 20, 1.0), ("chr1", 21, 30, 1.0), ("chr1", 30, 40, 2.0), ("chr2", 0, 5, 1.0), ("chr2", 5, 10, 1.0)])
    assert rows_of(collapsed(s), "chrom", "start", "end", "score") == [("chr1", 0, 20, 1.0), ("chr1", 21, 30, 1.0), ("chr1", 30, 40, 2.0), ("chr2", 0, 10, 1.0)]
    s = signal(spark, [("c", 0, 10, 1.0), ("c", 10, 20, 1.0000004), ("c", 20, 30, 1.000002)])
    assert rows_of(collapsed(s), "start", "end", "score") == [(0, 20, 1.0), (20, 30, 1.000002)]
    drift = signal(spark, [("c", k * 10, k * 10 + 10, 1 + k * 9e-7) for k in range(5)])
    assert rows_of(collapsed(drift), "start", "end", "score") == [(0, 50, 1.0)]
    assert collapsed(s.limit(0)).isEmpty()
    runs = signal(spark, [("c", k * 100, k * 100 + 100, v) for k, v in enumerate((1.0, 1.0, 2.0, 2.0, 1.0, math.nan, math.nan))], "value")
    assert [r[:2] for r in rows_of(run_lengths(runs), "start", "end", "value")] == [(0, 200), (200, 400), (400, 500), (500, 600), (600, 700)]


def track(spark, *rows):
    return spark.createDataFrame(list(rows), "track int, chrom string, start long, end long, value float")


def test_track_vectors(spark):
    t = track(spark, (0, "chr1", 0, 100, 10.0), (0, "chr1", 100, 200, 20.0), (1, "chr1", 0, 100, 5.0), (1, "chr1", 100, 200, 10.0), (2, "chr1", 0, 100, 10.0))
    r = refs(spark, chr1=200)
    values = lambda df: [x[1] for x in rows_of(df, "start", "value")]
    assert values(trk.compared(t, r, 0, 1, "subtraction", 100)) == [5.0, 10.0]
    assert values(trk.compared(t, r, 0, 1, "ratio", 100)) == pytest.approx([2.0, 2.0])
    assert values(trk.compared(t, r, 0, 0, "log-ratio", 100)) == [0.0, 0.0]
    for method in ("ratio", "log-ratio"):
        assert all(math.isfinite(v) for v in values(trk.compared(t, r, 0, 2, method, 100, 1e-3)))
    assert values(trk.compared(t, r, 0, 2, "ratio", 100, 0.0))[1] == math.inf
    with pytest.raises(ValueError):
        trk.compared(t, r, 0, 1, "product")


def test_maximum_is_taken_base_by_base(spark):
    t = track(spark, (0, "c", 0, 5, 4.0), (1, "c", 5, 10, 4.0))
    r = refs(spark, c=10)
    got = lambda m, **o: trk.aggregated(t, r, [0, 1], m, 10, **o).first()["value"]
    assert (got("max"), got("min"), got("mean"), got("sum"), got("median")) == (4.0, 0.0, 2.0, 4.0, 0.0)
    assert got("sum", pseudocount=0.5) == 5.0 and got("mean", scales=[2.0, 1.0]) == 3.0
    # lower median: half of the weight lies at the gaps' value, so it is the answer
    assert trk.aggregated(track(spark, (0, "c", 0, 6, 4.0)), r, [0], "median", 10).first()["value"] == 4.0
    for bad in ({"scales": [1.0]}, {"names": []}, {"method": "mode"}):
        with pytest.raises(ValueError):
            trk.aggregated(t, r, bad.get("names", [0, 1]), bad.get("method", "mean"), 10, scales=bad.get("scales"))


def matrix(spark, columns):
    return spark.createDataFrame([(b, s, int(v)) for s, c in columns.items() for b, v in enumerate(c)], "bin_idx long, sample string, count long")


def libs(spark, **sizes):
    return spark.createDataFrame(list(sizes.items()), "sample string, library_size long")


def result(df):
    return {r["sample"]: r for r in df.collect()}


def test_tmm(spark):
    same = matrix(spark, {s: [10 + k for k in range(20)] for s in "abc"})
    got = result(norm.tmm(same, libs(spark, a=100, b=100, c=100)))
    assert all(r["norm_factor"] == 1 and r["scale_factor"] == pytest.approx(1) for r in got.values())
    base = [50 + k for k in range(20)]
    got = result(norm.tmm(matrix(spark, {"a": base, "b": [x * (50 if k < 3 else 1) for k, x in enumerate(base)], "c": base}), libs(spark, a=2000, b=3500, c=2000)))
    assert math.prod(r["norm_factor"] for r in got.values()) == pytest.approx(1)
    assert got["a"]["norm_factor"] / got["c"]["norm_factor"] == pytest.approx(1, rel=0.05)
    with pytest.raises(ValueError):
        norm.tmm(matrix(spark, {"a": base}), libs(spark, a=1))
    with pytest.raises(ValueError):
        norm.tmm(same, libs(spark, a=1, b=1, c=1), reference="z")


def test_other_factors(spark):
    got = result(norm.cpm(matrix(spark, {"a": [1], "b": [1]}), libs(spark, a=1_000_000, b=2_000_000)))
    assert [(got[s]["scale_factor"], got[s]["norm_factor"]) for s in "ab"] == [(1.0, 1.0), (0.5, 1.0)]
    a = [10 * (k + 1) for k in range(10)] + [0]
    got = result(norm.median_of_ratios(matrix(spark, {"a": a, "b": [2 * x for x in a]}), libs(spark, a=1, b=1)))
    assert got["b"]["scale_factor"] / got["a"]["scale_factor"] == pytest.approx(0.5)
    assert (got["a"]["n_bins_total"], got["a"]["n_bins_used"]) == (11, 10)
    c = [1000, 1000, 0, 0] + [20 + k for k in range(16)]
    got = result(norm.csaw_background(matrix(spark, {"a": c, "b": c}), libs(spark, a=1, b=1), 10))
    assert (got["a"]["n_bins_total"], got["a"]["n_bins_used"]) == (20, 16)
    index = spark.createDataFrame([("a", "x1", 100), ("a", "c", 5), ("b", "x1", 400)], "sample string, chrom string, mapped long")
    got = result(norm.spike_in(index, "x"))
    assert got["a"]["scale_factor"] == pytest.approx(2) and got["b"]["norm_factor"] == pytest.approx(2)
    with pytest.raises(ValueError):
        norm.spike_in(index, "c")
    with pytest.raises(ValueError):
        norm.estimator("none")


GENOME = [("chr5", 1000), ("chr7", 1000)]


def low(*rows):
    return [{"chrom": c, "min1": a, "min2": b, "starts": s} for c, a, b, s in rows]


@pytest.mark.parametrize(("rows", "want"), [
    ([("chr5", 0.01, 0.02, [10, 20]), ("chr7", 0.01, 0.02, [30])], {"norm_method": "CPM", "scale_factor": 100, "library_size": 1e8, "bin_size": 10, "ratio": 2, "confident": True}),
    ([("chr5", 10.0, 20.0, [10, 20]), ("chr7", 10.0, 20.0, [30])], {"norm_method": "RPKM", "scale_factor": 0.1, "library_size": 1e7}),
    ([("chr5", 1000.0, 2000.0, [10]), ("chr7", 1000.0, 2000.0, [30])], {"norm_method": "RPKM" if 1e9 / 10_000 >= 1e6 else "Unknown", "confident": True, "chroms_scanned": 2}),
    ([("chr5", 0.0625, 0.1875, [10]), ("chr7", 0.0625, 0.1875, [20])], {"pseudocount": 0.5, "scale_factor": 1 / 0.1875, "ratio": 3}),
    ([("chr5", 0.25, 0.375, [10]), ("chr7", 0.25, 0.375, [20])], {"ratio": 1.5, "confident": False, "warnings": ["smoothing_detected"]}),
    ([("chr5", 0.01, 0.02, [10, 21]), ("chr7", 0.01, 0.02, [50])], {"bin_size": 1, "warnings": ["variable_bin_sizes"]}),
    ([("chr5", 0.01, 0.02, [10, 30, 60])], {"confident": False, "bin_size": 10}),
])
def test_infer_decisions(rows, want):
    got = infer.decide(low(*rows), GENOME)
    assert {k: got[k] for k in want} == pytest.approx(want) if "warnings" not in want else all(got[k] == v for k, v in want.items())


def test_infer_priorities_and_errors():
    p = infer.chrom_priority
    assert [p("chr5", 10, 100), p("chr1", 30, 100), p("chr22", 1, 100), p("chrM", 10, 100), p("MT", 10, 100), p("a_random", 10, 100), p("chrUn", 10, 100), p("x", 1, 0)] == [0, 1, 2, 2, 2, 2, 2, 1]
    with pytest.raises(ValueError):
        infer.decide([], GENOME)
    with pytest.raises(ValueError):
        infer.decide([], [])


def test_late_minimum(spark):
    values = [3.0] * 5 + [2.0] * 13 + [1.0]
    t = signal(spark, [("c", k * 10, k * 10 + 10, v) for k, v in enumerate(values, 1)], "value")
    assert infer.minima(t).first()["min1"] == 1.0 and infer.minima(t).first()["min2"] == 2.0
    assert infer.streak_minima(t, 8).first()["min1"] == 2.0
    assert infer.streak_minima(t, 10**6).first()["min1"] == 1.0
    assert infer.minima(t, 3).first()["starts"] == [10, 20, 30]


def test_late_unaligned_start(spark):
    t = signal(spark, [(c, k * 10 + (3 if k == 700 else 0), k * 10 + 10, 1.0 + k % 2) for c in "cd" for k in range(1, 801)], "value").repartition(3)
    assert infer.common_bin_size(infer.minima(t)).first()[0] == 1
    assert infer.common_bin_size(infer.minima(t, 512)).first()[0] == 10
    assert infer.common_bin_size(infer.minima(t.filter("start % 10 = 0"))).first()[0] == 10
    assert infer.common_bin_size(infer.minima(t.limit(0))).first()[0] == 0


def test_split_precedence_and_stats(spark):
    r = reads(spark, {"flag": 4 | 512}, {"flag": 512 | 1024}, {"flag": 1024 | 256}, {"flag": 256}, {"flag": 1}, {}, {"chrom": "x1", "ref_id": 1}, {"chrom": "x1", "ref_id": 1, "pos": 7})
    classes = split.classified(r, "x")
    assert sorted(x["class"] for x in classes.collect()) == ["duplicate", "endogenous", "exogenous", "exogenous", "filtered", "qcfail", "secondary", "unmapped"]
    s = split.split_stats(classes).first()
    assert (s["n_total_reads"], s["n_exogenous"], s["spike_in_factor"], s["spike_in_percentage"], s["n_both_genomes"]) == (8, 2, 5e5, 200.0, 0)
    outs = split.fanned_out(classes)
    assert {k: v.count() for k, v in outs.items()} == {"endogenous": 1, "exogenous": 2, "both": 0, "unmapped": 4}
    assert split.split_stats(classes.limit(0)).first()["spike_in_factor"] == 1.0

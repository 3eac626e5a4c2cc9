"""Registered queries: every operator on the derived tables, with the SQL that says the same in another way.

The SQL is written from the definitions (range joins, base-by-base expansion), not from the Spark plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom import reachable
from readloom.functions.reads import cigar_span
from readloom.operators import coverage as cov
from readloom.operators import infer, norm, split
from readloom.operators import tracks as trk
from readloom.operators.binning import collapsed, run_lengths
from readloom.operators.filters import LIBRARY, ReadFilter, funnel, passing, stage_counts
from readloom.operators.intervals import coordinates, fragment_intervals, shifted, tn5_adjusted, truncated
from readloom.plans import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(reachable(spark), sf_dir)
        if sql:
            SQL[name] = sql
        return f

    return add


def queries():
    from readloom.plans import files  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql():
    from readloom.plans import files  # noqa: F401

    return dict(SQL)


def stop(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("end", "stop")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) + 0.0 for n in names})


# filters ---------------------------------------------------------------------------------------------------------------
def stage_case(dup=False, sec=False, sup=False, strand=None, pair=False, mapq=0, low=0, high=1000, fmin=None, fmax=None, black=False, barcode=False, rg=False, tag=False) -> str:
    w = []
    if dup:
        w.append("flag & 1024 <> 0 THEN 'duplicate'")
    if sec:
        w.append("flag & 256 <> 0 THEN 'secondary'")
    if sup:
        w.append("flag & 2048 <> 0 THEN 'supplementary'")
    if strand:
        w.append(f"flag & 16 {'<>' if strand == 'forward' else '='} 0 THEN 'strand'")
    if pair:
        w.append("flag & 2 = 0 THEN 'proper_pair'")
    w += ["flag & 4 <> 0 THEN 'mapq'", f"mapq < {mapq} THEN 'mapq'", f"seq_len < {low} OR seq_len > {high} THEN 'read_length'"]
    if fmin is not None:
        w.append(f"abs(tlen) < {fmin} THEN 'fragment_length'")
    if fmax is not None:
        w.append(f"abs(tlen) > {fmax} THEN 'fragment_length'")
    if black:
        w.append("EXISTS (SELECT 1 FROM blacklist k WHERE k.chrom = a.chrom AND k.start < a.pos - 1 + a.seq_len AND k.stop > a.pos - 1) THEN 'blacklist'")
    if barcode:
        w.append(f"cb IS NULL OR cb NOT IN ({', '.join(repr(b) for b in fx.BARCODES)}) THEN 'barcode'")
    if rg:
        w.append(f"rg <> '{fx.READ_GROUP}' THEN 'read_group'")
    if tag:
        w.append(f"vp <> '{fx.TAG_VALUE}' THEN 'tag'")
    return "CASE " + " ".join(f"WHEN {x}" for x in w) + " END"


def staged_sql(**o) -> str:
    return fx.prelude("refs", "alignments", "blacklist") + f",\nstaged AS (SELECT a.*, {stage_case(**o)} AS fail_stage FROM alignments a)"


LIB = {"pair": True}
SPECS = {
    "duplicates": ({"ignore_duplicates": True}, {"dup": True}),
    "secondary": ({"ignore_secondary": True}, {"sec": True}),
    "supplementary": ({"ignore_supplementary": True}, {"sup": True}),
    "strand_fwd": ({"strand": "forward"}, {"strand": "forward"}),
    "strand_rev": ({"strand": "reverse"}, {"strand": "reverse"}),
    "proper_pair": ({"proper_pair": True}, {"pair": True}),
    "mapq": ({"min_mapq": 20}, {"mapq": 20}),
    "read_length": ({"min_length": 25, "max_length": 60}, {"low": 25, "high": 60}),
    "fragment_length": ({"min_fragment": 120, "max_fragment": 450}, {"fmin": 120, "fmax": 450}),
    "blacklist": ({"black": True}, {"black": True}),
    "barcode": ({"barcode": True}, {"barcode": True}),
    "read_group": ({"read_group": fx.READ_GROUP}, {"rg": True}),
    "tag": ({"tag": fx.TAG, "tag_value": fx.TAG_VALUE}, {"tag": True}),
}
EVERYTHING = {k: v for o, _ in SPECS.values() for k, v in o.items() if k != "strand"} | {"strand": "forward"}
EVERYTHING_SQL = {k: v for _, o in SPECS.values() for k, v in o.items() if k != "strand"} | {"strand": "forward"}


def spec_of(spark, options: dict) -> ReadFilter:
    o = dict(options)
    if o.pop("black", None):
        o["blacklist"] = fx.blacklist(spark)
    if o.pop("barcode", None):
        o["barcodes"] = fx.barcodes(spark)
    return ReadFilter(**o)


def _filters():
    for name, (options, sql) in (SPECS | {"all": (EVERYTHING, EVERYTHING_SQL)}).items():
        oracle = staged_sql(**sql) + "\nSELECT sample, coalesce(fail_stage, 'pass') AS stage, count(*) AS n FROM staged GROUP BY ALL"

        def run(spark, sf_dir, options=options):
            return stage_counts(fx.alignments(spark, sf_dir), spec_of(spark, options), ("sample",)).select("sample", F.coalesce("fail_stage", F.lit("pass")).alias("stage"), "n")

        register(f"flt_{name}", oracle)(run)


_filters()

_ORDER = ["duplicate", "secondary", "supplementary", "strand", "proper_pair", "mapq", "read_length", "fragment_length", "blacklist", "barcode", "read_group", "tag"]


@register("flt_funnel", staged_sql(**EVERYTHING_SQL) + f""",
steps AS (SELECT * FROM (VALUES {', '.join(f"({k + 1}, '{s}')" for k, s in enumerate(_ORDER))}) AS t(step, stage)),
drops AS (SELECT step, (SELECT count(*) FROM staged WHERE fail_stage = stage) AS dropped FROM steps),
every AS (SELECT 0 AS step, 0 AS dropped UNION ALL SELECT * FROM drops UNION ALL SELECT 13, 0),
run AS (SELECT step, dropped, (SELECT count(*) FROM staged) - sum(dropped) OVER (ORDER BY step) AS remaining FROM every)
SELECT step, CAST(remaining AS BIGINT) AS remaining, CAST(dropped AS BIGINT) AS dropped, round(remaining * 100.0::DOUBLE / (SELECT count(*) FROM staged), 6) AS percent
FROM run WHERE dropped > 0 OR step IN (0, 13)""")
def _funnel(spark, sf_dir):
    return rounded(funnel(fx.alignments(spark, sf_dir), spec_of(spark, EVERYTHING)).drop("label"), 6, "percent")


# projections -----------------------------------------------------------------------------------------------------------
PASS = staged_sql(**LIB) + ",\nreads AS (SELECT s.*, r.length FROM staged s JOIN refs r USING (ref_id) WHERE fail_stage IS NULL)"
READ_IV = "SELECT *, pos - 1 AS s, pos - 1 + ref_span AS e FROM reads"
FRAG_IV = "SELECT *, CASE WHEN tlen > 0 THEN pos - 1 ELSE mate_pos - 1 END AS s, CASE WHEN tlen > 0 THEN pos - 1 ELSE mate_pos - 1 END + abs(tlen) AS e FROM reads WHERE flag & 64 <> 0 AND tlen <> 0"


def _kept(spark, sf_dir):
    return passing(fx.alignments(spark, sf_dir), LIBRARY)


def _sums(df):
    return df.groupBy("sample", "chrom").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.sum(F.col("start") * F.col("end")).alias("products"))


SUMS = "SELECT sample, chrom, count(*) AS n, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends, CAST(sum(s * e) AS BIGINT) AS products FROM iv GROUP BY ALL"


@register("prj_cigar_span", fx.prelude("refs", "alignments") + "\nSELECT cigar, ref_span AS span, count(*) AS n FROM alignments GROUP BY ALL")
def _span(spark, sf_dir):
    return fx.alignments(spark, sf_dir).groupBy("cigar").agg(F.count("*").alias("n")).select("cigar", cigar_span("cigar").cast("int").alias("span"), "n")


@register("prj_fragment", PASS + f",\niv AS ({FRAG_IV})\n{SUMS}")
def _fragment(spark, sf_dir):
    return _sums(fragment_intervals(_kept(spark, sf_dir)))


SHIFT = (4, -5, 5, -4)
SHIFTED = """SELECT sample, chrom, length, greatest(s - CASE WHEN flag & 80 = 80 THEN -5 WHEN flag & 16 <> 0 THEN -4 ELSE 4 END, 0) AS s,
  least(greatest(e + CASE WHEN flag & 16 <> 0 THEN 5 WHEN flag & 64 <> 0 THEN -5 ELSE -4 END, 0), length) AS e FROM iv0"""


@register("prj_shift", PASS + f",\niv0 AS ({READ_IV}), iv AS ({SHIFTED})\n{SUMS}")
def _shift(spark, sf_dir):
    reads = _kept(spark, sf_dir).join(fx.refs(spark).select("chrom", "length"), "chrom")
    return _sums(shifted(reads.withColumns({"start": F.col("pos") - 1, "end": F.col("pos") - 1 + F.col("ref_span")}), SHIFT))


@register("prj_truncate", PASS + f",\niv0 AS ({FRAG_IV}), iv1 AS (SELECT sample, chrom, s + 30 AS s, greatest(e - 90, 0) AS e FROM iv0), iv AS (SELECT * FROM iv1 WHERE e > s)\n{SUMS}")
def _truncate(spark, sf_dir):
    return _sums(truncated(fragment_intervals(_kept(spark, sf_dir)), 30, 90).filter("end > start"))


@register("prj_tn5", fx.prelude("refs", "alignments") + """,
moved AS (SELECT a.*, r.length, a.flag & 16 <> 0 AS rev FROM alignments a JOIN refs r USING (ref_id) WHERE a.flag & 2 <> 0)
SELECT sample, chrom, count(*) AS n, CAST(sum(CASE WHEN rev THEN pos ELSE pos + 4 END) AS BIGINT) AS starts,
  CAST(sum(CASE WHEN tlen < 0 THEN tlen + 9 ELSE tlen - 9 END) AS BIGINT) AS tlens,
  CAST(sum(CASE WHEN rev AND mate_pos + 3 <= length THEN mate_pos + 4 ELSE mate_pos END) AS BIGINT) AS mates
FROM moved WHERE pos - 1 + seq_len - CASE WHEN rev THEN 5 ELSE 0 END <= length AND (rev OR pos + 3 <= length) GROUP BY ALL""")
def _tn5(spark, sf_dir):
    out = tn5_adjusted(fx.alignments(spark, sf_dir), fx.refs(spark))
    return out.groupBy("sample", "chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("starts"), F.sum("tlen").alias("tlens"), F.sum("mate_pos").alias("mates"))


# coverage --------------------------------------------------------------------------------------------------------------
def cov_sql(iv: str = READ_IV, bs: int = 1000, where: str = "TRUE", value: str = "n", sample: bool = False, tail: str | None = None, options: dict | None = None) -> str:
    head = staged_sql(**(options or LIB)) + ",\nreads AS (SELECT s.*, r.length FROM staged s JOIN refs r USING (ref_id) WHERE fail_stage IS NULL)"
    k, key, on = ("sample, ", "b.sample, ", "i.sample = b.sample AND ") if sample else ("", "", "")
    cells = "samples CROSS JOIN grid0" if sample else "grid0"
    out = head + f""",
iv AS ({iv}), grid0 AS (SELECT chrom, length, unnest(range(0, CAST(length AS BIGINT), {bs})) AS start FROM refs WHERE {where}), samples AS (SELECT DISTINCT sample FROM alignments),
b AS (SELECT {k}chrom, start, least(start + {bs}, length) AS stop FROM {cells}),
cov AS (SELECT {key}b.chrom, b.start, b.stop, count(i.s) AS n FROM b LEFT JOIN iv i ON {on}i.chrom = b.chrom AND i.s < b.stop AND i.e > b.start GROUP BY ALL)"""
    return out + (tail or f"\nSELECT {k}chrom, start, stop, round(CAST({value} AS DOUBLE), 6) AS score FROM cov")


def _cov(name: str, sql: str, keys=(), **options):
    options.setdefault("bin_size", 1000)

    def run(spark, sf_dir):
        return rounded(stop(cov.pileup(fx.alignments(spark, sf_dir), fx.refs(spark), keys=keys, **options)), 6, "score")

    register(name, sql)(run)


N = "(SELECT count(*) FROM reads)"
_cov("cov_raw", cov_sql())
_cov("cov_cpm", cov_sql(value=f"n * 1e6 / {N}"), method="cpm")
_cov("cov_rpkm", cov_sql(value=f"n * (1e6 / {N} * 1e3 / 500.0)", bs=500), method="rpkm", bin_size=500)
_cov("cov_scaled", cov_sql(value="n * CAST(CAST(0.1 AS FLOAT) AS DOUBLE)"), scale=0.1)
_cov("cov_fragment", cov_sql(FRAG_IV, 250), fragments=True, bin_size=250)
_cov("cov_small_bins", cov_sql(FRAG_IV, 5), fragments=True, bin_size=5)
_cov("cov_stranded", cov_sql(options={"strand": "reverse"}), spec=ReadFilter(strand="reverse"))
_cov("cov_no_scaffold", cov_sql(where="NOT regexp_matches(chrom, '^chrUn|_alt$|_random$')"), ignore_scaffolds=True)
_cov("cov_multi_sample", cov_sql(sample=True), keys=("sample",))
_cov("cov_shift_truncate", PASS + f",\niv0 AS ({READ_IV}), ivs AS ({SHIFTED}), " + cov_sql("SELECT sample, chrom, s + 3 AS s, greatest(e - 2, 0) AS e FROM ivs WHERE greatest(e - 2, 0) > s + 3").split(",\niv AS", 1)[1].join(["iv AS", ""]), shift=SHIFT, truncate=(3, 2))


@register("cov_single_chrom", cov_sql(where="chrom = 'chr2'", bs=100))
def _single_chrom(spark, sf_dir):
    return rounded(stop(cov.pileup(fx.alignments(spark, sf_dir).filter("chrom = 'chr2'"), fx.refs(spark).filter("chrom = 'chr2'"), 100)), 6, "score")


ISLANDS = """, f AS (SELECT *, CASE WHEN start = lag(stop) OVER w AND score = lag(score) OVER w THEN 0 ELSE 1 END AS new FROM {0} WINDOW w AS (PARTITION BY chrom ORDER BY start)),
g AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start) AS grp FROM f)
SELECT chrom, min(start) AS start, max(stop) AS stop, round(CAST(min(score) AS DOUBLE), 6) AS score FROM g GROUP BY chrom, grp"""


@register("cov_collapsed", cov_sql(bs=20, tail=", sc AS (SELECT chrom, start, stop, n AS score FROM cov)" + ISLANDS.format("sc")))
def _collapsed(spark, sf_dir):
    return rounded(stop(cov.collapsed_coverage(fx.alignments(spark, sf_dir), fx.refs(spark), bin_size=20)), 6, "score")


@register("cov_side_by_side", cov_sql(sample=True, tail="\nSELECT chrom, start, stop, " + ", ".join(f"CAST(sum(n) FILTER (sample = 'S{k}') AS DOUBLE) AS S{k}" for k in range(3)) + " FROM cov GROUP BY ALL"))
def _side_by_side(spark, sf_dir):
    return stop(cov.side_by_side(fx.alignments(spark, sf_dir), fx.refs(spark), ["S0", "S1", "S2"], bin_size=1000))


# tracks ----------------------------------------------------------------------------------------------------------------
BS, PC = 50, 0.25
SCALES = [1.0, 0.5, 2.0]
#: every base of every chromosome with the three tracks' values, 0 in gaps
BASES = fx.prelude("tracks", "track_refs") + f""",
base AS (SELECT chrom, length, unnest(range(0, length)) AS p FROM track_refs),
each AS (SELECT track, chrom, unnest(range(start, stop)) AS p, CAST(value AS DOUBLE) AS v FROM tracks WHERE stop > start),
wide AS (SELECT b.chrom, b.p, b.p // {BS} AS bin, b.length, coalesce(t0.v, 0) AS v0, coalesce(t1.v, 0) AS v1, coalesce(t2.v, 0) AS v2 FROM base b
  LEFT JOIN each t0 ON t0.track = 0 AND t0.chrom = b.chrom AND t0.p = b.p LEFT JOIN each t1 ON t1.track = 1 AND t1.chrom = b.chrom AND t1.p = b.p LEFT JOIN each t2 ON t2.track = 2 AND t2.chrom = b.chrom AND t2.p = b.p)"""
EDGES = f"chrom, bin * {BS} AS start, least((bin + 1) * {BS}, any_value(length)) AS stop"


#: Track values have two decimals, so bin values lie on a grid with ties at three; results are 32-bit floats. This clears the ties.
NUDGE = 0.00003


def track_rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round(F.col("value").cast("double") + NUDGE, 3) + 0.0)


def per_bin(value: str) -> str:
    return BASES + f"\nSELECT {EDGES}, round({value} + {NUDGE}, 3) + 0.0 AS value FROM wide GROUP BY chrom, bin"


def _track(name: str, value: str, run):
    register(name, per_bin(value))(lambda spark, sf_dir: track_rounded(stop(run(fx.tracks(spark, sf_dir), fx.track_refs(spark, sf_dir)))))


def _agg(method):
    return lambda t, r: trk.aggregated(t, r, [0, 1, 2], method, BS, PC, SCALES)


def _cmp(method, pc=PC):
    return lambda t, r: trk.compared(t, r, 0, 1, method, BS, pc, (1.0, 0.5))


MEANS = "CAST(CAST(avg(v0) AS FLOAT) AS DOUBLE) * 1.0 + CAST(CAST(avg(v1) AS FLOAT) AS DOUBLE) * 0.5 + CAST(CAST(avg(v2) AS FLOAT) AS DOUBLE) * 2.0"
_track("trk_bin_mean", "avg(v0)", lambda t, r: trk.aggregated(t, r, [0], "mean", BS))
_track("trk_sum", f"{MEANS} + 3 * {PC}", _agg("sum"))
_track("trk_mean", f"({MEANS} + 3 * {PC}) / 3", _agg("mean"))
_track("trk_max", f"avg(greatest(v0, v1 * 0.5, v2 * 2.0) + {PC})", _agg("max"))
_track("trk_min", f"avg(least(v0, v1 * 0.5, v2 * 2.0) + {PC})", _agg("min"))
_track("trk_subtract", "avg(v0 - v1 * 0.5)", _cmp("subtraction"))
_track("trk_ratio", f"avg(v0 / (v1 * 0.5 + {PC}))", _cmp("ratio"))
_track("trk_log_ratio", f"avg(ln((v0 + {PC}) / (v1 * 0.5 + {PC})))", _cmp("log-ratio"))


@register("trk_median", BASES + f""",
long AS (SELECT chrom, bin, length, v0 + {PC} AS v FROM wide UNION ALL SELECT chrom, bin, length, v1 * 0.5 + {PC} FROM wide UNION ALL SELECT chrom, bin, length, v2 * 2.0 + {PC} FROM wide)
SELECT {EDGES}, round(quantile_disc(v, 0.5) + {NUDGE}, 3) + 0.0 AS value FROM long GROUP BY chrom, bin""")
def _median(spark, sf_dir):
    return track_rounded(stop(trk.aggregated(fx.tracks(spark, sf_dir), fx.track_refs(spark, sf_dir), [0, 1, 2], "median", BS, PC, SCALES)))


@register("trk_rle", BASES + f""", sc AS (SELECT {EDGES}, CAST(count(*) FILTER (v0 > 0) > 25 AS INT) AS score FROM wide GROUP BY chrom, bin)""" + ISLANDS.format("sc"))
def _rle(spark, sf_dir):
    t = fx.tracks(spark, sf_dir).filter("value > 0").withColumn("value", F.lit(1.0).cast("float"))
    bins = trk.aggregated(t, fx.track_refs(spark, sf_dir), [0], "sum", BS)
    width = F.col("end") - F.col("start")
    bins = bins.withColumn("score", (F.round(F.col("value") * width) > 25).cast("double"))
    return rounded(stop(run_lengths(bins.drop("value"), ("chrom",), ("score",))), 6, "score")


@register("bg_collapse", fx.prelude("tracks") + """, bg AS (SELECT chrom, start, stop, floor(value / 40) AS score FROM tracks WHERE track = 0)""" + ISLANDS.format("bg"))
def _bg(spark, sf_dir):
    bg = fx.tracks(spark, sf_dir).filter("track = 0").select("chrom", "start", "end", F.floor(F.col("value").cast("double") / 40).cast("double").alias("score"))
    return rounded(stop(collapsed(bg)), 6, "score")


# normalisation ---------------------------------------------------------------------------------------------------------
COUNTS = cov_sql(sample=True, tail="""
, m AS (SELECT dense_rank() OVER (ORDER BY chrom, start) - 1 AS bin_idx, chrom, start, stop, sample, n AS count FROM cov),
lib AS (SELECT s.sample, count(r.sample) AS library_size FROM samples s LEFT JOIN reads r ON r.sample = s.sample GROUP BY ALL)""")


def _matrix(spark, sf_dir):
    reads, refs = fx.alignments(spark, sf_dir), fx.refs(spark)
    return cov.count_matrix(reads, refs, 1000), cov.library_sizes(reads)


@register("nf_counts", COUNTS + "\nSELECT bin_idx, chrom, start, stop, sample, count FROM m")
def _counts(spark, sf_dir):
    return stop(_matrix(spark, sf_dir)[0])


@register("nf_library_size", COUNTS + "\nSELECT sample, library_size FROM lib")
def _lib(spark, sf_dir):
    return _matrix(spark, sf_dir)[1]


def _factors(df):
    return rounded(df, 6, "norm_factor", "scale_factor")


NB = "(SELECT count(DISTINCT bin_idx) FROM m)"


@register("nf_cpm", COUNTS + f"\nSELECT sample, library_size, 1.0::DOUBLE AS norm_factor, round(1e6 / library_size, 6) AS scale_factor, {NB} AS n_bins_total, {NB} AS n_bins_used FROM lib")
def _nf_cpm(spark, sf_dir):
    return _factors(norm.cpm(*_matrix(spark, sf_dir)))


def tmm_sql(source: str) -> str:
    return f""", mm AS ({source}),
tot AS (SELECT sample, CAST(sum(count) AS DOUBLE) AS n FROM mm GROUP BY ALL), gm AS (SELECT exp(avg(ln(n))) AS g FROM tot WHERE n > 0),
ref AS (SELECT sample AS rs, n AS nr FROM tot, gm ORDER BY abs(n - g), sample LIMIT 1),
p AS (SELECT y.sample, y.bin_idx, CAST(y.count AS DOUBLE) AS y, CAST(r.count AS DOUBLE) AS yr, t.n, ref.nr FROM mm y JOIN ref ON TRUE JOIN mm r ON r.sample = ref.rs AND r.bin_idx = y.bin_idx JOIN tot t ON t.sample = y.sample WHERE y.count > 0 AND r.count > 0),
q AS (SELECT sample, bin_idx, log2((y / n) / (yr / nr)) AS lm, 0.5::DOUBLE * log2((y / n) * (yr / nr)) AS la, (n - y) / (n * y) + (nr - yr) / (nr * yr) AS v FROM p),
k AS (SELECT *, count(*) OVER (PARTITION BY sample) AS k, max(abs(lm)) OVER (PARTITION BY sample) AS top, row_number() OVER (PARTITION BY sample ORDER BY lm, bin_idx) AS rm, row_number() OVER (PARTITION BY sample ORDER BY la, bin_idx) AS ra FROM q),
raw AS (SELECT sample, CASE WHEN max(top) < 1e-6 THEN 1.0::DOUBLE ELSE pow(2.0::DOUBLE, coalesce(sum(lm / v) FILTER (keep) / sum(1.0::DOUBLE / v) FILTER (keep), 0)) END AS f
  FROM (SELECT *, rm BETWEEN floor(k * 0.3::DOUBLE) + 1 AND k - floor(k * 0.3::DOUBLE) AND ra BETWEEN floor(k * 0.05::DOUBLE) + 1 AND k - floor(k * 0.05::DOUBLE) AS keep FROM k) GROUP BY sample),
nf AS (SELECT l.sample, l.library_size, f / exp(avg(ln(f)) OVER ()) AS nf FROM lib l JOIN raw USING (sample)),
res AS (SELECT *, exp(avg(ln(library_size * nf)) OVER ()) / (library_size * nf) AS sf FROM nf)
SELECT sample, library_size, round(nf, 6) AS norm_factor, round(sf, 6) AS scale_factor, {NB} AS n_bins_total, (SELECT count(DISTINCT bin_idx) FROM mm) AS n_bins_used FROM res"""


@register("nf_tmm", COUNTS + tmm_sql("SELECT * FROM m"))
def _tmm(spark, sf_dir):
    return _factors(norm.tmm(*_matrix(spark, sf_dir)))


@register("nf_csaw", COUNTS + tmm_sql("""SELECT m.* FROM m JOIN (SELECT bin_idx, max(count) AS top, row_number() OVER (ORDER BY avg(count) DESC, bin_idx) AS rk, count(*) OVER () AS nb FROM m GROUP BY bin_idx) o USING (bin_idx)
  WHERE o.top > 0 AND o.rk > floor(o.nb * 5.0::DOUBLE / 100 + 0.5)"""))
def _csaw(spark, sf_dir):
    return _factors(norm.csaw_background(*_matrix(spark, sf_dir)))


@register("nf_median_ratio", COUNTS + f""", geo AS (SELECT bin_idx, avg(ln(count)) AS g FROM m WHERE count > 0 GROUP BY bin_idx HAVING count(*) = 3),
s AS (SELECT sample, median(count / exp(g)) AS s FROM m JOIN geo USING (bin_idx) GROUP BY sample)
SELECT sample, library_size, round(s / (SELECT median(s) FROM s), 6) AS norm_factor, round((SELECT median(s) FROM s) / s, 6) AS scale_factor, {NB} AS n_bins_total, (SELECT count(*) FROM geo) AS n_bins_used FROM lib JOIN s USING (sample)""")
def _ratios(spark, sf_dir):
    return _factors(norm.median_of_ratios(*_matrix(spark, sf_dir)))


INDEX = fx.prelude("refs", "alignments") + """, idx AS (SELECT s.sample, r.ref_id, r.chrom, r.length, count(a.flag) FILTER (a.flag & 4 = 0) AS mapped, count(a.flag) FILTER (a.flag & 4 <> 0) AS unmapped
FROM (SELECT DISTINCT sample FROM alignments) s CROSS JOIN refs r LEFT JOIN alignments a ON a.sample = s.sample AND a.ref_id = r.ref_id GROUP BY ALL)"""


@register("idx_stats", INDEX + "\nSELECT sample, ref_id, chrom, CAST(length AS BIGINT) AS length, mapped, unmapped FROM idx")
def _idx(spark, sf_dir):
    return split.index_stats(fx.alignments(spark, sf_dir), fx.refs(spark))


@register("idx_prefix", INDEX + f"\nSELECT sample, CAST(sum(mapped) FILTER (starts_with(chrom, '{fx.SPIKE}')) AS BIGINT) AS exogenous, CAST(sum(mapped) FILTER (NOT starts_with(chrom, '{fx.SPIKE}')) AS BIGINT) AS endogenous FROM idx GROUP BY ALL")
def _prefix(spark, sf_dir):
    return split.mapped_by_prefix(split.index_stats(fx.alignments(spark, sf_dir), fx.refs(spark)), fx.SPIKE)


@register("nf_spikein", INDEX + f""", e AS (SELECT sample, CAST(sum(mapped) AS BIGINT) AS library_size, CAST(sum(mapped) FILTER (starts_with(chrom, '{fx.SPIKE}')) AS DOUBLE) AS x FROM idx GROUP BY ALL), g AS (SELECT exp(avg(ln(x))) AS g FROM e)
SELECT sample, library_size, round(x / g, 6) AS norm_factor, round(g / x, 6) AS scale_factor, 0::BIGINT AS n_bins_total, 0::BIGINT AS n_bins_used FROM e, g""")
def _spikein(spark, sf_dir):
    return _factors(norm.spike_in(split.index_stats(fx.alignments(spark, sf_dir), fx.refs(spark)), fx.SPIKE))


# inference -------------------------------------------------------------------------------------------------------------
LOW = fx.prelude("norm_track") + ", v AS (SELECT chrom, start, CAST(value AS DOUBLE) AS v FROM norm_track WHERE value > 0 AND stop > start), lo AS (SELECT chrom, min(v) AS min1, count(*) AS n FROM v GROUP BY chrom)"


@register("inf_minima", LOW + "\nSELECT chrom, min1, (SELECT min(v) FROM v WHERE v.chrom = lo.chrom AND v > lo.min1 + 1e-9) AS min2, n FROM lo")
def _minima(spark, sf_dir):
    return infer.minima(fx.norm_track(spark, sf_dir)).drop("starts")


@register("inf_gcd", LOW + ", s AS (SELECT DISTINCT start FROM v WHERE start > 0)\nSELECT list_reduce(list(start), lambda a, b: gcd(a, b)) AS bin_size FROM s")
def _gcd(spark, sf_dir):
    return infer.common_bin_size(infer.minima(fx.norm_track(spark, sf_dir)))


@register("inf_decision", LOW + """, g AS (SELECT min(min1) AS a FROM lo), h AS (SELECT a, (SELECT min(v) FROM v WHERE v > a + 1e-9) AS b FROM g)
SELECT 'CPM' AS norm_method, round(1 / a, 6) AS scale_factor, round(1e6 / a, 3) AS library_size, 10::BIGINT AS bin_size, a AS min_val, b AS second_min_val, round(b / a, 6) AS ratio, TRUE AS confident, 2 AS chroms_scanned FROM h""")
def _decision(spark, sf_dir):
    out = infer.infer_scale(fx.norm_track(spark, sf_dir), fx.norm_refs(spark, sf_dir)).drop("warnings", "pseudocount")
    return rounded(rounded(out, 6, "scale_factor", "ratio"), 3, "library_size")


# splitting -------------------------------------------------------------------------------------------------------------
CLASSES = staged_sql(**LIB) + f""", c AS (SELECT *, CASE WHEN flag & 4 <> 0 THEN 'unmapped' WHEN flag & 512 <> 0 THEN 'qcfail' WHEN flag & 1024 <> 0 THEN 'duplicate' WHEN flag & 256 <> 0 THEN 'secondary'
  WHEN fail_stage IS NOT NULL THEN 'filtered' WHEN starts_with(chrom, '{fx.SPIKE}') THEN 'exogenous' ELSE 'endogenous' END AS class FROM staged)"""


@register("spl_classes", CLASSES + "\nSELECT sample, class, count(*) AS n FROM c GROUP BY ALL")
def _classes(spark, sf_dir):
    return split.classified(fx.alignments(spark, sf_dir), fx.SPIKE).groupBy("sample", "class").agg(F.count("*").alias("n"))


_N = {"n_unmapped_reads": "unmapped", "n_qcfail_reads": "qcfail", "n_duplicate_reads": "duplicate", "n_secondary_reads": "secondary", "n_filtered_reads": "filtered", "n_endogenous": "endogenous", "n_exogenous": "exogenous"}


@register("spl_stats", CLASSES + "\nSELECT 'all' AS sample, count(*) AS n_total_reads, " + ", ".join(f"count(*) FILTER (class = '{v}') AS {k}" for k, v in _N.items()) + """, 0::BIGINT AS n_both_genomes, 0::BIGINT AS n_low_maq,
round(1e6 / count(*) FILTER (class = 'exogenous'), 6) AS spike_in_factor, round(count(*) FILTER (class = 'exogenous') * 100.0::DOUBLE / count(*) FILTER (class = 'endogenous'), 6) AS spike_in_percentage FROM c""")
def _stats(spark, sf_dir):
    return rounded(split.split_stats(split.classified(fx.alignments(spark, sf_dir), fx.SPIKE), "all"), 6, "spike_in_factor", "spike_in_percentage")

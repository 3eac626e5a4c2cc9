"""MinHash near-duplicates: banded signatures, verification, and connected components by large-star and small-star.

Method. A text's set is its distinct word shingles (64-bit hashes of lower-cased words). ``bands x rows`` universal hash
minima ``(a x + b mod 2^64) >> 32`` form its signature; texts that agree on a whole band are candidates. With the
default 32 bands of 4 rows, a pair at the threshold of 0.8 escapes with probability 5e-8. Candidates first compare signatures
(pairs whose estimate lies more than seven standard deviations under the threshold fall away), then full sets. Verified
links go through alternating large-star and small-star steps; a component is named by its smallest id.

Groups of copies never turn into all their pairs. Equal word sequences are one node, their smallest id. In each band
bucket the members are compared with one centre, drawn anew every round, so a group of n similar texts costs n
comparisons a round; rounds end when they bring few links. Members that then still lie in different components meet in
blocks of bounded size, where they are compared exactly without a row for each pair: the search is exact over all
candidates. Sets are computed for the documents that share a bucket only, and shuffled for those a round compares.

Edge cases: null and empty texts have empty sets and are linked with nothing; fewer words than a shingle count as one
shingle of the whole sequence; rows without an id are linked with nothing, their component is null and they are kept;
repeated rows are copies of one document; equal ids with different texts are one node, whose set is that of the text
with the smallest hash; extra columns, whatever their names, are ignored or returned unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import Latest, documents, matched, released, unused, written

SHINGLE, THRESHOLD, BANDS, ROWS, SEED = 5, 80, 32, 4, 20240229
#: Rounds go on while at least one in so many comparisons links; shingles (and 1000 a text) in a block.
USEFUL, BLOCK = 4, 1_500_000
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], "uint64")


def text_words(text: str | None) -> list[bytes]:
    """A-Z lowered, split at ASCII white space: what ``bytes`` does."""
    return (text or "").encode().lower().split()


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    if not words:
        return np.empty(0, "uint64")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(size, len(words)), "uint64")
    for k in range(min(size, len(words))):
        out = out * MIX[0] + h[k : k + n]
        out ^= out >> np.uint64(29)
    out = (out ^ (out >> np.uint64(32))) * MIX[2]
    return np.unique(out ^ (out >> np.uint64(29)))


def hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, n, "uint64") | np.uint64(1), rng.integers(0, 2**64, n, "uint64")


def signature(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = items >> np.uint64(32)
    out = np.full(len(a), 2**64 - 1, "uint64")
    for at in range(0, len(x), 2048):
        part = a[:, None] * x[None, at : at + 2048]
        part += b[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype("uint32")


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    parts = sig.reshape(bands, -1).astype("uint64")
    key = np.zeros(bands, "uint64")
    for k in range(parts.shape[1]):
        key = (key ^ parts[:, k]) * MIX[1]
        key ^= key >> np.uint64(31)
    return key.view("int64")


def sketches(docs: DataFrame, size: int, bands: int, rows: int, seed: int) -> DataFrame:
    def sketch(batches):
        a, b = hash_family(bands * rows, seed)
        for batch in batches:
            keys, counts, buckets = [], [], []
            for text in batch.column(1):
                words = text_words(text.as_py())
                items = shingle_set(words, size)
                keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                counts.append(len(items))
                buckets.append(band_keys(signature(items, a, b), bands) if len(items) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(buckets, pa.list_(pa.int64())), batch.column(2)], ["doc_id", "key", "n_shingles", "buckets", "text_key"])

    return docs.select(F.col("doc_id").cast("long"), "text", _text_key().alias("text_key")).mapInArrow(sketch, "doc_id long, key binary, n_shingles long, buckets array<bigint>, text_key long")


def _text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def full_sets(docs: DataFrame, size: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(id, sig, items): signature and full set."""

    def expand(batches):
        a, b = hash_family(bands * rows, seed)
        for batch in batches:
            items = [shingle_set(text_words(t.as_py()), size) for t in batch.column(1)]
            sigs = [signature(x, a, b).view("int32") for x in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.list_(pa.int32())), pa.array([x.view("int64") for x in items], pa.list_(pa.int64()))], ["id", "sig", "items"])

    return docs.mapInArrow(expand, "id long, sig array<int>, items array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (u > v) whose sets reach the threshold: signatures first, then the sets themselves."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id"))
    some = matched(sets, ids, ["id"], "left_semi")
    left, right = (some.select(F.col("id").alias(c), F.col("sig").alias(f"{c}_sig"), F.col("items").alias(f"{c}_items")) for c in ("u", "v"))
    both = pairs.join(left, "u").join(right, "v")
    n = F.size("u_sig")
    agree = F.aggregate(F.zip_with("u_sig", "v_sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    p = F.lit(threshold / 100)
    likely = agree >= n * (p - 7 * F.sqrt(p * (1 - p) / n))
    common = F.size(F.array_intersect("u_items", "v_items"))
    linked = 100 * common >= threshold * (F.size("u_items") + F.size("v_items") - common)
    return both.filter(F.when(likely, linked).otherwise(False)).select("u", "v")


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least neighbour of ``u``; minima are taken before the shuffle, and a join of one node's many edges can be split."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (u, v); component is the smallest id reachable."""
    step = Latest("edges")
    edges = step.of(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_least(large).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = step.of(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
        released(edges.sparkSession)  # a step's shuffles are not needed by the next
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def block_links(here: DataFrame, sets: DataFrame, threshold: int, bands: int) -> DataFrame:
    """Links between the components that still share buckets, by exact comparison in blocks of bounded size.

    ``here``: (band, bucket, id, n, component, c). Ids that buckets connect form a cluster. A cluster is cut into blocks of about
    ``BLOCK`` shingles, a large component into blocks of its own; every two blocks meet in one task, but for two of one
    component. A task compares pairs of different components that agree on a band, with their full sets, and returns
    links that join them, at most one for each id.
    """
    joint = components(here.select(F.col("id").alias("u"), F.col("c.id").alias("v"))).withColumnRenamed("component", "cluster")
    nodes = written(here.select("id", "n", "component").distinct().join(joint, "id").withColumn("weight", F.col("n") + 1000), "cluster-nodes")
    comps = nodes.groupBy("cluster", "component").agg(F.sum("weight").alias("w")).withColumn("part", F.when(F.col("w") > BLOCK / 2, F.col("component")))
    parts = comps.groupBy("cluster", "part").agg(F.ceil(F.sum("w") / BLOCK).cast("int").alias("nb"))
    order = Window.partitionBy("cluster").orderBy(F.col("part").asc_nulls_first())
    parts = parts.select("cluster", "part", "nb", (F.sum("nb").over(order) - F.col("nb")).cast("int").alias("off"), F.sum("nb").over(Window.partitionBy("cluster")).cast("int").alias("total"))
    placed = nodes.join(comps.select("cluster", "component", "part"), ["cluster", "component"]).withColumnsRenamed({"cluster": "_c", "part": "_p"})
    placed = placed.join(parts, (F.col("_c") == F.col("cluster")) & F.col("_p").eqNullSafe(F.col("part")))
    block = F.col("off") + F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("total") - 1)))
    same = F.col("part").isNotNull() & (F.col("other") >= F.col("off")) & (F.col("other") < F.col("off") + F.col("nb"))
    placed = placed.filter(~same).select("id", "component", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    some = matched(sets, nodes.select("id"), ["id"], "left_semi")
    rows = placed.join(some, "id")

    def compare(table: pa.Table) -> pa.Table:
        ids, comp = table["id"].to_numpy(), table["component"].to_numpy()
        block = table["block"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        items = [np.asarray(x.values) for x in table["items"]]
        keys = np.array([band_keys(np.asarray(x.values).view("uint32"), bands) for x in table["sig"]])
        size = np.array([len(x) for x in items])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        root = {c: c for c in comp.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out: list[tuple[int, int]] = []
        for at in range(0, len(left), 256):
            a = left[at : at + 256]
            meet = np.zeros((len(a), len(right)), bool)
            for band in range(keys.shape[1]):
                meet |= keys[a, band][:, None] == keys[right, band]
            meet &= comp[a][:, None] != comp[right]
            meet &= 100 * np.minimum(size[a][:, None], size[right]) >= threshold * np.maximum(size[a][:, None], size[right])
            if not meet.any():
                continue
            rows_, cols = np.flatnonzero(meet.any(1)), np.flatnonzero(meet.any(0))
            common = overlaps([items[a[x]] for x in rows_], [items[right[y]] for y in cols])
            total = size[a[rows_]][:, None] + size[right[cols]] - common
            for x, y in np.argwhere(meet[np.ix_(rows_, cols)] & (100 * common >= threshold * total)):
                u, v = a[rows_[x]], right[cols[y]]
                p, q = find(int(comp[u])), find(int(comp[v]))
                if p != q:
                    root[p] = q
                    out.append((int(ids[u]), int(ids[v])))
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    return rows.groupBy("cluster", "i", "j").applyInArrow(compare, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from incidence matrices over the items both sides have, some columns at a time."""
    known = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), "float32")
    for at in range(0, len(known), 8192):
        some = known[at : at + 8192]

        def incidence(sets):
            m = np.zeros((len(sets), len(some)), "float32")
            for k, x in enumerate(sets):
                at_ = np.minimum(np.searchsorted(some, x), len(some) - 1)
                m[k, at_[some[at_] == x]] = 1
            return m

        out += incidence(left) @ incidence(right).T
    return out.astype("int64")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """One row per document: ``n_shingles``, ``component_id``, ``kept``."""
    return labelled(docs, size, threshold, bands, rows, seed).select("doc_id", "n_shingles", "component_id", "kept")


def labelled(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """``near_duplicates`` with each row's ``text_key``, the node ``id`` it belongs to, and whether its text stands for that id."""
    base = written(sketches(docs, size, bands, rows, seed), "sketches")
    some = base.filter("doc_id is not null and n_shingles > 0")
    nodes = some.groupBy("key").agg(F.min(F.struct("doc_id", "text_key")).alias("r")).select("key", F.col("r.doc_id").alias("id"), F.col("r.text_key").alias("first_text"))
    nodes = written(nodes.withColumn("stands", F.col("key") == F.min("key").over(Window.partitionBy("id"))), "nodes")
    first = nodes.filter("stands")
    reps = some.join(first, (some["key"] == first["key"]) & (some["doc_id"] == first["id"]), "left_semi")
    each = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.posexplode("buckets").alias("band", "bucket"))
    shared = each.groupBy("band", "bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("band", "bucket")
    members = written(each.join(shared, ["band", "bucket"]).dropDuplicates(["band", "bucket", "id"]), "members")
    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text", _text_key().alias("first_text"))
    wanted = matched(wanted, members.select("id").distinct().join(first, "id"), ["id", "first_text"], "left_semi").drop("first_text")
    sets = written(full_sets(wanted, size, bands, rows, seed).dropDuplicates(["id"]), "sets")  # rows that repeat have equal sets

    links, tested, labels, turn, found_all, useful = None, None, None, 0, False, None
    meeting, labelling = Latest("meeting"), Latest("labels")
    while True:
        here = members if labels is None else members.join(labels, "id", "left")
        here = here.withColumn("component", F.col("id") if labels is None else F.coalesce("component", "id"))
        open_ = here.groupBy("band", "bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("draw"), "id", "n", "component")).alias("c")).filter("lo < hi")
        here = meeting.of(here.join(open_.select("band", "bucket", "c"), ["band", "bucket"]))
        if found_all := here.isEmpty():
            break
        if useful is not None and not useful:
            break
        pairs = here.filter("component <> c.component and 100 * least(n, c.n) >= {0} * greatest(n, c.n)".format(threshold))
        pairs = pairs.select(F.greatest("id", "c.id").alias("u"), F.least("id", "c.id").alias("v")).distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        found = written(verified(pairs, sets, threshold), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        turn += 1
        n_found = found.count()
        useful = n_found > 0 and USEFUL * n_found >= pairs.count()
        if not n_found:
            break
        links = found if links is None else links.unionByName(found)
        labels = labelling.of(components(links))
        released(docs.sparkSession)  # a round's shuffles are not needed by the next
    if not found_all:
        found = written(block_links(here, sets, threshold, bands), "links")
        if not found.isEmpty():
            labels = labelling.of(components(found if links is None else links.unionByName(found)))
    of = nodes.drop("first_text").withColumnRenamed("key", "_k")
    out = base.select("doc_id", "n_shingles", "key", "text_key").join(of, (F.col("key") == F.col("_k")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    if labels is not None:
        out = out.join(labels, "id", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "id", "doc_id").alias("component_id"), "text_key", "id", "stands")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, whole rows: that with the smallest id; of rows that repeat an id and text, one.

    Rows without an id, and those without words, are linked with nothing: all stay. Where an id bears several texts, a text
    that is not compared for it (``stands``) goes only as an exact copy. What becomes of a row is a narrow table of ids and
    text keys, which meets the texts in one join; only rows that repeat are then brought together."""
    named = labelled(docs, **options).filter("doc_id is not null and n_shingles > 0")
    gone = ~F.col("kept") & ((F.col("id") != F.col("doc_id")) | F.col("stands"))
    fate = named.groupBy("doc_id", "text_key").agg(F.max(gone).alias("gone"), (F.count("*") > 1).alias("again"))
    fate = written(fate.filter("gone or again"), "fate")
    key, gone, again, number = unused(docs.columns, "text_key", "gone", "again", "number")
    fate = fate.withColumnsRenamed({"text_key": key, "gone": gone, "again": again})
    out = matched(docs.withColumns({key: _text_key(), number: F.col("doc_id").cast("long")}), fate.withColumnRenamed("doc_id", number), [number, key], "left")
    out = out.filter(~F.coalesce(F.col(gone), F.lit(False)))
    once = out.filter(F.col(again)).groupBy(number, key).agg(*[F.first(c).alias(c) for c in docs.columns])
    return out.filter(~F.coalesce(F.col(again), F.lit(False))).select(*docs.columns).unionByName(once.select(*docs.columns))


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=4)

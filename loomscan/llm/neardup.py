"""Near-duplicate documents (operator 3): MinHash with b-bit signatures, confirmed on full shingle sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begin, bounded, dealt_join, freed, materialize, ship, table, workspace
from .components import components

K, ROWS, BITS = 128, 4, 2  # minima, minima a band, bits kept of each minimum
PER_LONG = 64 // BITS
MISS = 1e-7  # chance that a pair right at the threshold shares no band
SIGMAS = 6  # of the estimate, by which a candidate may fall short before its sets are compared
SLICE = 256
CACHE = 200_000  # words whose hashes a worker keeps
BLOCK = 1000  # classes of a bucket that are compared with as many others in one place
SIZE_STEP = 1.05  # between classes of set sizes, in the last pass

_rng = np.random.Generator(np.random.PCG64(20240229))
_MUL = _rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2)
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _forget() -> None:
    _hashes.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _C2
    return (x ^ (x >> np.uint64(29))) * _C3


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (A-Z lower-cased); of all words where they are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_hashes) > CACHE:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    s = np.full(n, min(width, len(h)), np.uint64)
    for k in range(min(width, len(h))):
        s = _mix(s * _C1 + h[k : k + n])
    return np.unique(s)


def minima(s: np.ndarray) -> np.ndarray:
    low = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 4096):
        low = np.minimum(low, (s[k : k + 4096][None, :] * _MUL[:, None] + _ADD[:, None]).min(1))
    return low


def band_count(percent: int) -> int:
    """Bands so that a pair at the threshold shares none with a chance of MISS at most."""
    n = math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))
    if n * ROWS > K:
        raise ValueError(f"similarities under 0.8 need more than {K} minima")
    return n


def sketch(s: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, packed low bits of all minima), as signed 64-bit integers."""
    low = minima(s)
    keys = np.arange(bands, dtype=np.uint64)
    for k in range(ROWS):
        keys = _mix(keys * _C1 + low[: bands * ROWS].reshape(bands, ROWS)[:, k])
    bits = (_mix(low) & np.uint64((1 << BITS) - 1)).reshape(-1, PER_LONG)
    packed = (bits << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS))[None, :]).sum(1, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


def least_matches(percent: int) -> int:
    """Equal b-bit minima a pair at the threshold has at least, but for SIGMAS standard deviations.

    Unequal minima agree in their low bits with a chance of 2^-BITS: that is the collision correction.
    """
    j = percent / 100
    p = j + (1 - j) * 2.0**-BITS
    return max(0, math.floor(K * p - SIGMAS * math.sqrt(K * p * (1 - p))))


def _matches(a: Column, b: Column) -> Column:
    """Equal minima of two signatures, by bit counts."""
    out = F.lit(K)
    for k in range(K // PER_LONG):
        x = a[k].bitwiseXOR(b[k])
        out = out - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return out


def _sketched(rows: DataFrame, width: int, bands: int) -> DataFrame:
    def run(batches):
        begin("neardup", _forget)
        for batch in freed(batches):
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                sets = [shingles(t, width) for t in part.column(3).to_pylist()]
                made = [sketch(s, bands) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_pydict(
                    {"id": part.column(0), "t1": part.column(1), "t2": part.column(2), "n": pa.array(map(len, sets), pa.int64()), "set_key": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), "bands": pa.array([a for a, _ in made], pa.list_(pa.int64())), "sig": pa.array([b for _, b in made], pa.list_(pa.int64()))}
                )

    return rows.mapInArrow(run, "id long, t1 long, t2 long, n long, set_key binary, bands array<long>, sig array<long>")


def _sets(rows: DataFrame, width: int) -> DataFrame:
    def run(batches):
        begin("neardup", _forget)
        for batch in freed(batches):
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                yield pa.RecordBatch.from_pydict({"node": part.column(0), "hashes": pa.array([shingles(t, width).view(np.int64) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))})

    return rows.mapInArrow(run, "node long, hashes array<long>")


def _keys(text: Column) -> tuple[Column, Column]:
    """128 bits of a text's hash; with the id they tell rows apart."""
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets are similar enough; an x may be in very many pairs."""
    pairs = materialize(pairs, "near-pairs")
    a, b = sets.select(F.col("node").alias("x"), F.col("hashes").alias("a")), sets.select(F.col("node").alias("y"), F.col("hashes").alias("b"))
    a = a.join(pairs.groupBy("x").agg(F.count("*").alias("w")), "x")
    both = F.size(F.array_intersect("a", "b"))
    joined = dealt_join(pairs.join(b, "y"), a, "x", "w", pairs.count())
    return materialize(joined.filter(100 * both >= percent * (F.size("a") + F.size("b") - both)).select("x", "y"), "near-links")


def _first_shared(rest: DataFrame, sets: DataFrame, percent: int, close) -> DataFrame:
    """Pairs (x, y) of the classes in rest (node, component, n, sig) that can be similar and lie in different components.

    With all sets in one order, rare shingles first, the first shingle that x and y share stands at places i and j, counted
    from 0, and they share min(n(x) - i, n(y) - j) at most; a pair is similar only if that reaches what its sizes ask for.
    So a class stands under the shingles of its first places only, and under each of them once for every class of sizes
    that its partners can have, which the place narrows.
    """
    words = sets.join(rest.select("node", "n"), "node").select("node", "n", F.explode("hashes").alias("h"))
    counts = materialize(words.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"), "near-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    order = dealt_join(words, counts, "h", "c", total).groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("common"))
    alone = F.col("n") - F.size("common")  # shingles that no other class here has stand before all others
    places = F.floor((100 - percent) * F.col("n") / 100).cast("int") + 1
    first = order.select("node", "n", alone.alias("alone"), F.posexplode(F.slice("common", F.lit(1), F.greatest(F.lit(0), places - alone).cast("int"))))

    def size_class(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / math.log(SIZE_STEP)).cast("int")

    n = F.col("n")
    low, high = F.ceil(percent * n / 100), F.floor(100 * n / percent)
    high = F.least(high, F.floor((n - F.col("at")) * (100 + percent) / percent) - n)  # sizes of partners with which place `at` can be the first shared
    first = first.select("node", "n", (F.col("alone") + F.col("pos")).alias("at"), F.col("col.h").alias("h")).withColumn("low", low).withColumn("high", high).filter("low <= high")
    first = first.withColumn("own", size_class(n)).select("node", "n", "at", "h", "own", F.explode(F.sequence(size_class(F.col("low")), size_class(F.col("high")))).alias("other"))
    bucket = F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")).alias("bucket")
    first = materialize(first.select(bucket, "node", "at", "own", "other").join(rest, "node"), "near-first")
    by_component = first.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    major = by_component.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("major"), F.sum("c").alias("in_bucket"), F.count("*").alias("several")).filter("several > 1")
    major = materialize(major.select("bucket", "major", "in_bucket"), "near-major")
    total = major.agg(F.coalesce(F.sum("in_bucket"), F.lit(0))).first()[0]
    first = dealt_join(first, major, "bucket", "in_bucket", total).withColumn("blocks", F.ceil(F.col("in_bucket") / BLOCK).cast("int"))
    first = materialize(first.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "near-first")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    held = ("node", "component", "n", "at", "sig")
    a = first.filter("component <> major").select("bucket", "own", "other", F.col("block").alias("block_a"), every.alias("block_b"), *[F.col(c).alias(f"{c}_a") for c in held])
    b = first.select("bucket", F.col("other").alias("own"), F.col("own").alias("other"), every.alias("block_a"), F.col("block").alias("block_b"), (F.col("component") == F.col("major")).alias("in_major"), *[F.col(c).alias(f"{c}_b") for c in held])
    once = (F.col("component_a") != F.col("component_b")) & (F.col("in_major") | (F.col("node_a") < F.col("node_b")))
    able = (100 + percent) * F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= percent * (F.col("n_a") + F.col("n_b"))
    pairs = a.join(b, ["bucket", "own", "other", "block_a", "block_b"]).filter(once & able & close("n_a", "sig_a", "n_b", "sig_b"))
    return pairs.select(F.col("node_a").alias("x"), F.col("node_b").alias("y")).distinct()


def _linked(reps: DataFrame, sets_of, bands: int, percent: int) -> DataFrame:
    """(node, component) of the classes in reps that are linked with others; see near_duplicates."""
    least = least_matches(percent)

    def close(nx: str, sx: str, ny: str, sy: str) -> Column:
        """What sizes and signatures don't rule out."""
        return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (_matches(F.col(sx), F.col(sy)) >= least)

    at = reps.select("node", "n", "sig", F.explode("bands").alias("bucket"))
    shared = materialize(at.groupBy("bucket").agg(F.count("*").alias("in_bucket")).filter("in_bucket > 1"), "near-shared")
    total = shared.agg(F.coalesce(F.sum("in_bucket"), F.lit(0))).first()[0]
    members = materialize(dealt_join(at, shared, "bucket", "in_bucket", total), "near-members")
    degree = members.groupBy("node").agg(F.sum("in_bucket").alias("degree"))
    members = materialize(members.drop("in_bucket").join(degree, "node"), "near-members")
    sets = sets_of(materialize(members.select("node").distinct(), "near-candidates"))

    leaders = members.groupBy("bucket").agg(F.max_by(F.struct("node", "n", "sig"), F.struct("degree", (-F.col("node")).alias("r"))).alias("l"), F.max("degree").alias("leads"), F.count("*").alias("in_bucket"))
    leaders = materialize(leaders.select("bucket", "leads", "in_bucket", F.col("l.node").alias("leader"), F.col("l.n").alias("nl"), F.col("l.sig").alias("sl")), "near-leaders")
    best = dealt_join(members, leaders, "bucket", "in_bucket", total).filter(F.col("node") != F.col("leader")).filter(close("nl", "sl", "n", "sig"))
    best = best.groupBy("node").agg(F.max_by("leader", F.struct("leads", (-F.col("leader")).alias("r"))).alias("x"))
    links = _confirmed(best.select("x", F.col("node").alias("y")), sets, percent)
    found = components(links, "x", "y")

    def mixed(found: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """Members, with their components, of the buckets that hold more than one component; these buckets; the members' number."""
        x = materialize(members.join(found, "node", "left").select("bucket", "node", "n", "sig", F.coalesce("component", "node").alias("component")), "near-named")
        many = x.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("in_bucket")).filter("low <> high")
        many = materialize(many.select("bucket", "in_bucket"), "near-many")
        n = many.agg(F.coalesce(F.sum("in_bucket"), F.lit(0))).first()[0]
        return materialize(dealt_join(x, many, "bucket", "in_bucket", n).drop("in_bucket"), "near-mixed"), many, n

    open_, many, n = mixed(found)
    if n:
        its = found.select(F.col("node").alias("leader"), F.col("component").alias("its"))
        led = many.join(leaders.drop("in_bucket"), "bucket").join(its, "leader", "left").withColumn("its", F.coalesce("its", "leader"))
        second = dealt_join(open_, led, "bucket", "in_bucket", n).filter("component <> its").filter(close("nl", "sl", "n", "sig"))
        more = _confirmed(second.select(F.col("leader").alias("x"), F.col("node").alias("y")).distinct(), sets, percent)
        if not more.isEmpty():
            links = links.union(more)
            found = components(links, "x", "y")
            open_, many, n = mixed(found)
    if n:
        more = _confirmed(_first_shared(materialize(open_.select("node", "component").distinct(), "near-rest").join(reps.select("node", "n", "sig"), "node"), sets, percent, close), sets, percent)
        if not more.isEmpty():
            found = components(links.union(more), "x", "y")
    return found


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """id, t1, t2, n, component_id of each row, and of those with shingles the group's row that stays (i0, t1, t2)."""
    spark = docs.sparkSession
    ship(spark)
    bands = band_count(percent)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *_keys(F.col(text_col)), F.col(text_col).alias("text"))
    with workspace(spark):
        sketched = materialize(_sketched(rows, width, bands), "near-sketches")
        row = F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")
        reps = sketched.filter("n > 0").groupBy("set_key").agg(F.count("*").alias("copies"), F.min(row).alias("row"), *[F.any_value(c).alias(c) for c in ("n", "bands", "sig")])
        reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "near-reps")
        repeated = not sketched.filter("n > 0").groupBy("id", "t1", "t2").count().filter("count > 1").isEmpty()

        def sets_of(nodes: DataFrame) -> DataFrame:
            wanted = reps.join(nodes, "node").select("node", F.col("row.id").alias("i"), F.col("row.t1").alias("a"), F.col("row.t2").alias("b"))
            wanted = bounded(materialize(wanted, "near-wanted"))
            texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("i")) & (F.col("t1") == F.col("a")) & (F.col("t2") == F.col("b")))
            sets = _sets(texts.select("node", "text"), width)
            return materialize(sets.dropDuplicates(["node"]) if repeated else sets, "near-sets")

        found = _linked(reps, sets_of, bands, percent)
        named = materialize(reps.join(found, "node", "left").select("set_key", "copies", "row", F.coalesce("component", "node").alias("component")), "near-named")
        groups = named.groupBy("component").agg(F.min("row").alias("first"), F.count("*").alias("classes"))
        named = materialize(dealt_join(named.select("component", "set_key", "copies"), groups, "component", "classes", named.count()), "near-groups")
        narrow = sketched.select("id", "t1", "t2", "n", "set_key")
        out = dealt_join(narrow.filter("n > 0"), named, "set_key", "copies", sketched.count())
        out = out.select("id", "t1", "t2", "n", F.col("first.id").alias("component_id"), "first")
        none = narrow.filter("n = 0").select("id", "t1", "t2", "n", F.col("id").alias("component_id"), F.lit(None).cast(out.schema["first"].dataType).alias("first"))
        return materialize(out.union(none), "near-rows", keep=True)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near copies: id, n_shingles, component_id, kept.

    Two documents are linked if the Jaccard similarity of their sets of `width`-word shingles is percent/100 or more;
    component_id is the smallest id that links reach, kept marks the document that has it. 1. Rows with equal sets are
    one class from here on, however many they are. 2. Classes that share a band of minima are candidates. 3. Their
    similarity is estimated from the low bits of the minima, with the collision correction, and what could be similar
    is confirmed on the full sets. A pair at the threshold is missed with a chance of 1e-7 (bands) or 1e-9 (estimate).

    In a large bucket not all pairs are compared: first each class with the most connected class of its buckets, then
    all with the leaders of their buckets. What still lies in different components meets by rare shingles: of two sets
    in one order, rare shingles first, the first one shared and its places bound what they share (_first_shared).
    Skipped pairs lie in one component or can't be links, so none is lost. Large buckets, shingles, classes and groups
    are dealt over many tasks; the pairs left under a hot shingle are met by blocks.

    Null, empty and blank texts have empty sets, component_id = id, and are kept. Shorter texts are one shingle. Rows
    that repeat an id and text are kept alike, and rows that repeat an id with other texts are documents of their own;
    rows with a null id get the component of their equals, and are kept if they have none. An empty table gives no
    rows; other columns are ignored.
    """
    out = _grouped(docs, id_col, text_col, width, percent)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies, with the columns of docs: the one with the smallest id.

    Of rows with that id, the text with the least hash stays; of rows that repeat id and text, one of them. Rows with
    null ids stay only where a group has no other. Texts without words are in no group and all stay. Rows are told
    apart by id and 128 bits of their text's hash.
    """
    spark = docs.sparkSession
    rows = _grouped(docs, id_col, text_col, width, percent).filter("n > 0")
    first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("t1") == F.col("first.t1")) & (F.col("t2") == F.col("first.t2"))
    names = [F.col(c).alias(f"_loomscan_{c}") for c in ("id", "t1", "t2")]
    gone = bounded(materialize(rows.filter(~first).select(*names).distinct(), "near-gone"))
    again = materialize(rows.filter(first).groupBy("id", "t1", "t2").count().filter("count > 1").select(*names), "near-again")
    t1, t2 = _keys(F.col(text_col))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_loomscan_id")) & (t1 == F.col("_loomscan_t1")) & (t2 == F.col("_loomscan_t2"))
    out = docs.join(gone, same, "left_anti")
    if again.isEmpty():
        return out
    again = bounded(again)
    once = docs.join(again, same).dropDuplicates(["_loomscan_id", "_loomscan_t1", "_loomscan_t2"]).select(*docs.columns)
    return out.join(again, same, "left_anti").union(once)


def op3_minhash_bbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


QUERIES = {"op3_minhash_bbit": op3_minhash_bbit}
ORACLES = {
    "op3_minhash_bbit": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles, sh FROM s),
k AS (SELECT list_sort(sh) AS sk, min(doc_id) AS rep, any_value(n_shingles) AS n FROM n WHERE n_shingles > 0 GROUP BY sk),
p AS (SELECT rep, n, unnest(sk) AS t FROM k),
c AS (SELECT a.rep AS x, b.rep AS y FROM p a JOIN p b ON a.t = b.t AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM c UNION SELECT y, x FROM c),
r AS (SELECT rep AS node, rep AS other FROM k UNION SELECT r.node, e.y FROM r JOIN e ON r.other = e.x),
m AS (SELECT node, min(other) AS component FROM r GROUP BY node)
SELECT n.doc_id, n_shingles, coalesce(m.component, n.doc_id) AS component_id, n.doc_id = coalesce(m.component, n.doc_id) AS kept
FROM n LEFT JOIN k ON list_sort(n.sh) = k.sk LEFT JOIN m ON k.rep = m.node
"""
}

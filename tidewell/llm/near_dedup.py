"""Operator 8, near duplicates by MinHash with tensored banding.

A text's set holds its distinct word shingles. Two collections of short keys are made for each set, one of 26 keys of five
minhashes, one of 15 keys of three; a table of the tensored scheme is a pair of one key from each collection. 390 tables
thus cost 175 minhashes. Documents that agree in a pair are candidates, and candidates are confirmed on the full sets.
Sets of equal content are one vertex from the start, so copies never meet pair by pair. A 1024-bit image of each set rules
out candidates that can't be similar; it never rules out others.

Documents that share a key of the first collection are first compared with the pivot they meet most often, if they also
share one of the second. Where a bucket then still holds several components, the rows outside the largest are compared
with all others; are they many, pairs of keys are formed and their smaller buckets compared in full. No link is lost to
the pivots.

At a similarity of exactly 0.8 a link is a candidate with probability (1 - 0.672^26) * (1 - 0.488^15), 0.99995 here.

Defined results: a null or empty text, or one of white space, has an empty set and links with nothing. Rows of equal
doc_id are told apart by their texts. A row with a null doc_id takes part; its component is the smallest id that it
reaches, null if there is none. An empty table gives no rows. Columns other than doc_id and text aren't read.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import carried, discard, materialize, table, unpacked
from tidewell.llm.graph import components

#: Keys of the two collections, and minhashes in each key of them.
TABLES, ROWS = (26, 15), (5, 3)
#: Pivots of a bucket in each round, and rows outside its main component up to which these are compared with all its rows.
PIVOTS, DIRECT = (2, 8), 1000
#: Bits of a set's image.
IMAGE = 1024
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles, A-Z lower-cased; of the whole sequence if it is shorter."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * ODD + h[j : len(h) - k + 1 + j]
    out = (out ^ (out >> np.uint64(32))) * ODD
    return np.unique(out ^ (out >> np.uint64(29)))


def image(s: np.ndarray) -> np.ndarray:
    """The set's image in IMAGE bits: each member turns one over. Two images differ in no more bits than their sets in members."""
    odd = np.bincount((s & np.uint64(IMAGE - 1)).astype(np.int64), minlength=IMAGE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(2024).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def half_keys(s: np.ndarray, odd: np.ndarray, tables: tuple[int, int], rows: tuple[int, int]) -> np.ndarray:
    """The keys of both collections, each mixed from as many minhashes as `rows` says for its collection."""
    low = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):  # memory holds for sets of any size
        np.minimum(low, np.multiply.outer(odd, s[i : i + 2048]).min(1), out=low)
    out = np.arange(1, sum(tables) + 1, dtype=np.uint64)
    cut = tables[0] * rows[0]
    for keys, part in ((out[: tables[0]], low[:cut].reshape(tables[0], rows[0])), (out[tables[0] :], low[cut:].reshape(tables[1], rows[1]))):
        for j in range(part.shape[1]):
            keys ^= part[:, j]
            keys *= ODD
            keys ^= keys >> np.uint64(31)
    return out


def signatures(docs: DataFrame, k: int, tables: tuple[int, int], rows: tuple[int, int]) -> DataFrame:
    """For each row v (distinct in this table), doc_id, the text's hash th, set size n, set hash s1 and s2, the half-keys and the set's image."""
    n_tables, n_rows, words = tables, rows, k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        odd, v = multipliers(n_tables[0] * n_rows[0] + n_tables[1] * n_rows[1]), TaskContext.get().partitionId() << 40
        for b in batches:
            out = []
            for doc_id, th, text in zip(b["doc_id"], b["th"], b["text"]):
                s = shingles(text, words)
                keys = half_keys(s, odd, n_tables, n_rows).view(np.int64) if len(s) else np.zeros(0, np.int64)
                with np.errstate(over="ignore"):
                    s1, s2 = np.bitwise_xor.reduce(s * ODD) if len(s) else np.uint64(0), s.sum(dtype=np.uint64)
                out.append((v, doc_id, th, len(s), np.uint64(s1).view(np.int64), np.uint64(s2).view(np.int64), keys[: n_tables[0]], keys[n_tables[0] :], image(s)))
                v += 1
            frame = pd.DataFrame(out, columns=["v", "doc_id", "th", "n", "s1", "s2", "ka", "kb", "bits"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"), th=frame["th"].astype("Int64"))

    rows_in = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    return rows_in.mapInPandas(run, "v long, doc_id long, th long, n long, s1 long, s2 long, ka array<long>, kb array<long>, bits array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(v, s): the full sets of the wanted rows (v, doc_id, th)."""
    words = k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"v": b["v"], "s": [shingles(t, words).view(np.int64) for t in b["text"]]})

    d = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), "text")
    found = d.join(wanted, d["d"].eqNullSafe(wanted["doc_id"]) & (d["h"] == wanted["th"])).select("v", "text")
    return found.mapInPandas(run, "v long, s array<long>")


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with `linked`: whether 100 * intersection reaches percent * union on the full sets."""
    left, right = sets.select(F.col("v").alias("a"), F.col("s").alias("sa")), sets.select(F.col("v").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - both
    return pairs.join(left, "a").join(right, "b").select("a", "b", (100 * both >= percent * union).alias("linked")).distinct()


def close(a: str, b: str, percent: int):
    """Whether sizes allow two sets to be similar."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def alike(a: str, b: str, na: str, nb: str, percent: int):
    """Whether images differ in few enough bits; sets of `percent` similarity always pass."""
    differ = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(1, IMAGE // 64)), F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))
    return (100 + percent) * differ <= (100 - percent) * (F.col(na) + F.col(nb))


def plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) that share a key of the second collection and whose images are alike."""
    left, right = (reps.select(F.col("v").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "kb", "bits")]) for x in "ab")
    met = pairs.join(left, "a").join(right, "b")
    return met.where(F.arrays_overlap("kb_a", "kb_b") & alike("bits_a", "bits_b", "n_a", "n_b", percent)).select("a", "b")


def with_pivots(rows: DataFrame, salt: int, many: int) -> DataFrame:
    """rows (ka, v, n, part) of the buckets that hold several components, with the bucket's size c and `many` pivots ps."""
    me = F.struct("v", "n", "part").alias("m")
    picks = [F.min(F.struct(F.xxhash64("v", F.lit(100 * salt + i)).alias("x"), me)).alias(f"p{i}") for i in range(many)]
    buckets = rows.groupBy("ka").agg(F.count("*").alias("c"), F.min("part").alias("x"), F.max("part").alias("y"), *picks).where("x != y")
    return rows.join(buckets.select("ka", "c", F.array_distinct(F.array(*[F.col(f"p{i}.m") for i in range(many)])).alias("ps")), "ka")


def pivot_pairs(alive: DataFrame, reps: DataFrame, percent: int, best: bool) -> DataFrame:
    """Candidates (a, b), a > b, from the keys of the first collection: in buckets of two the pair, in larger ones each
    member with the bucket's pivots, with `best` only with the one it meets most often. Only plausible pairs."""
    near = alive.select("v", "n", "part", "c", F.explode("ps").alias("p")).where((F.col("part") != F.col("p.part")) & close("n", "p.n", percent))
    met = near.groupBy("v", F.col("p.v").alias("w")).agg(F.count("*").alias("t"), F.min("c").alias("c"))
    most = met.groupBy("v").agg(F.max(F.struct("t", F.col("w").alias("x"))).alias("m"))
    met = met.join(most, "v").where("c = 2 or w = m.x" if best else "true").select(F.greatest("v", "w").alias("a"), F.least("v", "w").alias("b")).distinct()
    return plausible(met, reps, percent)


def minor_pairs(rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b), a > b, of different components: of rows (ka, v, n, part, main) those outside their bucket's
    main component with all others. A pair comes up in the first bucket that it shares, and in no other."""
    rows = rows.join(reps.select("v", F.col("ka").alias("fa"), F.col("kb").alias("fb"), "bits"), "v")
    left, right = (rows.select("ka", *[F.col(c).alias(f"{c}_{x}") for c in ("v", "n", "part", "main", "fa", "fb", "bits")]) for x in "ab")
    once = (F.col("part_a") != F.col("part_b")) & ((F.col("part_b") == F.col("main_b")) | (F.col("v_a") > F.col("v_b"))) & close("n_a", "n_b", percent)
    first = F.get(F.array_intersect("fa_a", "fa_b"), F.lit(0)) == F.col("ka")
    met = left.where("part_a != main_a").join(right, "ka").where(once & alike("bits_a", "bits_b", "n_a", "n_b", percent) & first & F.arrays_overlap("fb_a", "fb_b"))
    return met.select(F.greatest("v_a", "v_b").alias("a"), F.least("v_a", "v_b").alias("b")).distinct()


def tensored(open_: DataFrame, halves: DataFrame) -> DataFrame:
    """(key, v, n, part): the members of the tensored tables' buckets that hold several components."""
    keys = open_.join(halves.select("v", "kb"), "v").select("v", "n", "part", "ka", F.explode("kb").alias("kb"))  # keys of different tables never meet
    keys = keys.select(F.xxhash64("ka", "kb").alias("key"), "v", "n", "part")
    mixed = keys.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x != y").select("key")
    return materialize(keys.join(mixed, "key"))


def link(docs: DataFrame, k: int = 2, percent: int = 80, tables: tuple[int, int] = TABLES, rows: tuple[int, int] = ROWS) -> DataFrame:
    """doc_id, th (the text's hash), n_shingles and component_id of every row of docs."""
    sig = materialize(signatures(docs, k, tables, rows))
    full = sig.where("n > 0")
    classes = materialize(full.groupBy("s1", "s2", "n").agg(F.min("v").alias("v"), F.min("doc_id").alias("least_id")))
    reps = materialize(full.join(classes.select("v"), "v", "left_semi").select("v", "n", "ka", "kb", "bits"))

    def compare(pairs: DataFrame) -> DataFrame:
        """pairs with `linked`, judged on full sets."""
        involved = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
        sets = materialize(sets_of(docs, sig.join(involved, "v", "left_semi").select("v", "doc_id", "th"), k))
        out = materialize(similar_pairs(pairs, sets, percent))
        discard(sets)
        return out

    seen, parts = None, None

    def settle(pairs: DataFrame) -> None:
        """Compares pairs that are new and joins the components of those that are linked."""
        nonlocal seen, parts
        judged = compare(materialize(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti")))
        links = judged.where("linked").select("a", "b")
        # what is already known to hang together goes in as one star a component, not by all its links
        parts = components(links if parts is None else links.unionAll(parts.select(F.col("v").alias("a"), F.col("component").alias("b"))))
        seen = judged if seen is None else seen.unionAll(judged)

    def tagged(rows: DataFrame, key: str) -> DataFrame:
        return rows.select(key, "v", "n").join(parts, "v", "left").select(key, "v", "n", F.coalesce("component", "v").alias("part"))

    open_ = reps.select(F.explode("ka").alias("ka"), "v", "n", F.col("v").alias("part"))
    for salt, many in enumerate(PIVOTS):
        alive = materialize(with_pivots(open_, salt, many))
        settle(pivot_pairs(alive, reps, percent, salt == 0))
        open_ = tagged(alive.where("c > 2"), "ka")  # buckets of two are done with
    sizes = open_.groupBy("ka", "part").agg(F.count("*").alias("c")).groupBy("ka").agg(F.sum("c").alias("c"), F.max(F.struct("c", "part")).alias("m"))
    sizes = sizes.select("ka", (F.col("c") - F.col("m.c")).alias("minor"), F.col("m.part").alias("main")).where("minor > 0")
    left = materialize(open_.join(sizes, "ka"))
    settle(minor_pairs(left.where(F.col("minor") <= DIRECT), reps, percent))
    members = tensored(tagged(left.where(F.col("minor") > DIRECT), "ka"), reps)
    discard(alive, left)

    def pivoted(m: DataFrame, salt: int) -> DataFrame:
        """Each member with its bucket's pivot, another one by each salt."""
        first = m.groupBy("key").agg(F.min(F.struct(F.xxhash64("v", F.lit(salt)).alias("x"), F.col("v").alias("p"), F.col("n").alias("pn"))).alias("p"))
        out = m.join(first, "key").where(close("n", "p.pn", percent))
        return out.select(F.greatest("v", "p.p").alias("a"), F.least("v", "p.p").alias("b")).where("a != b").distinct()

    open_, salt = members, 1
    while True:
        at_most = open_.groupBy("key").agg(F.count("*").alias("c")).agg(F.sum(F.expr("c * (c - 1) / 2")).alias("s"), F.sum("c").alias("c")).first()
        if not at_most["c"]:
            break
        last = at_most["s"] <= 16 * at_most["c"] or salt > 2
        if last:
            left = open_.select("key", F.col("v").alias("a"), F.col("n").alias("na"), F.col("part").alias("pa"))
            right = open_.select("key", F.col("v").alias("b"), F.col("n").alias("nb"), F.col("part").alias("pb"))
            pairs = left.join(right, "key").where((F.col("a") > F.col("b")) & (F.col("pa") != F.col("pb")) & close("na", "nb", percent)).select("a", "b").distinct()
        else:
            pairs = pivoted(open_, salt)
        settle(plausible(pairs, reps, percent))
        if last:
            break
        again = tagged(members, "key")
        mixed = again.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x != y").select("key")
        open_, salt = materialize(again.join(mixed, "key")), salt + 1
    named = classes.join(parts, "v", "left").select("s1", "s2", "n", "least_id", F.coalesce("component", "v").alias("part"))
    least = named.groupBy("part").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "part").select("s1", "s2", "n", "component_id")
    out = sig.select("doc_id", "th", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest doc_id. Of rows alike in id and text one stays."""
    found = link(docs.select("doc_id", "text"), k, percent)
    found = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "th").distinct()
    rows = carried(docs, F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("x"))
    # rows of an id that occurs once, as ids should, need no further look: dropDuplicates works on what is kept
    kept = rows.join(found, rows["d"].eqNullSafe(found["doc_id"]) & (rows["x"] == found["th"])).dropDuplicates(["d", "x"])
    return unpacked(kept, docs.columns)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s FROM w
), t AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS common
  FROM t a JOIN t b ON a.sh = b.sh AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL
), e AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (total - common)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, l.b FROM reach r JOIN links l ON r.u = l.a),
c AS (SELECT v AS doc_id, min(u) AS component_id FROM reach GROUP BY v)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

"""Operator 9, suffix-array dedup: removes every byte covered by a string of `length` bytes that also starts earlier.

Each window of `length` bytes is dealt to the smallest hash of its GRAM-byte strings; equal windows have equal hashes,
so they meet. Runs of windows with one hash are spans; hashes that come up once in the corpus are dropped. Of spans of
equal bytes the first is left, grouped by the bytes themselves before they are shuffled; the others are repeats outright.
What is left of a hash meets in one bucket, where a two-stage suffix sort and the adjacent common prefixes show which
windows are equal. A hash whose different spans fill more than a bucket has its windows grouped by their bytes instead, so
that no task holds all of a passage that many documents share. Whole texts whose SHA-256 and size equal an earlier one's
never enter: all their bytes are repeats.

Order of starts: doc_id (null first), rows of equal doc_id as they are read, then offset. Matches never cross
documents. Defined results: a null text is empty; a text shorter than `length` keeps everything. Repeated rows each get
a row, the later ones with all bytes removed. An empty table gives no rows. Columns other than doc_id and text aren't read.
"""

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import discard, materialize, table
from tidewell.llm.suffixes import agree, suffix_order

GRAM = 24
#: Bytes looked at together in very long texts, and most windows in a span.
BLOCK, SPAN = 1 << 20, 1024
#: Stands for a null doc_id.
LEAST = -(1 << 63)
#: Bytes of spans that a suffix sort takes at once, about; it needs some 80 times as many.
BUCKET = 1_500_000


def byte_table() -> np.ndarray:
    return np.random.default_rng(99).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A hash of the GRAM = 16 + 8 bytes from each position on."""
    h, width, parts = codes[x], 1, {}
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93):
        h = h[:-width] * np.uint64(factor) + h[width:]
        width *= 2
        parts[width] = h
    out = parts[16][: len(x) - GRAM + 1] * np.uint64(0xFF51AFD7ED558CCD) + parts[8][16 : 16 + len(x) - GRAM + 1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    out ^= out >> np.uint64(29)
    return out


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    width, m = 1, h
    while 2 * width <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(h) - w + 1], m[w - width : w - width + len(h) - w + 1])


def spans(x: np.ndarray, length: int, codes: np.ndarray):
    """(hash, first start, last start, whether the hash stands twice in the span) of the runs of windows with one hash."""
    w = length - GRAM + 1
    for at in range(0, len(x) - length + 1, BLOCK):
        h = gram_hashes(x[at : at + BLOCK + length - 1], codes)
        m = sliding_min(h, w)
        new = np.ones(len(m), bool)
        new[1:] = m[1:] != m[:-1]
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(m)) - 1
        if (hi - lo).max() >= SPAN:
            lo = np.concatenate([np.arange(a, b + 1, SPAN) for a, b in zip(lo, hi)])
            hi = np.append(lo[1:], len(m)) - 1
        key, reach = m[lo], np.arange(w)
        twice = np.zeros(len(lo), bool)
        for i in range(0, len(lo), 4096):
            s = slice(i, i + 4096)
            a, b = h[lo[s, None] + reach] == key[s, None], h[hi[s, None] + reach] == key[s, None]
            twice[s] = (a.sum(1) > 1) | (b.sum(1) > 1) | (lo[s] + a.argmax(1) != hi[s] + b.argmax(1))
        yield key.view(np.int64), lo + at, hi + at, twice


def least_id() -> Column:
    """doc_id, the least number for null: pandas would make fractions of numbers beside nulls."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST).cast("long")).alias("doc_id")


def rows(docs: DataFrame, length: int) -> DataFrame:
    """A row for each text, with v (distinct), doc_id (null: the least), the text's hash, size and SHA-256, and for each block of a text's
    spans a row with v and, for each span, its hash h, its place `at` (first start and windows) and whether h stands twice in it."""
    least = length

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, codes, v = ["v", "doc_id", "th", "n", "sha", "h", "at", "twice"], byte_table(), TaskContext.get().partitionId() << 40

        def frame(out: list) -> pd.DataFrame:
            columns = dict(zip(names, zip(*out))) if out else {c: [] for c in names}
            return pd.DataFrame({c: pd.array(x, "Int64") if c in ("doc_id", "th", "n") else list(x) for c, x in columns.items()})

        for b in batches:
            out = []
            for doc_id, th, text in zip(b["doc_id"], b["th"], b["text"]):
                raw = (text or "").encode("utf-8", "replace")
                out.append((v, doc_id, th, len(raw), hashlib.sha256(raw).digest(), None, None, None))
                for h, lo, hi, twice in spans(np.frombuffer(raw, np.uint8), least, codes):
                    out.append((v, None, None, None, None, h, lo * SPAN + hi - lo, twice))
                    if len(out) > 10_000:
                        yield frame(out)
                        out = []
                v += 1
            yield frame(out)

    return docs.select(least_id(), F.xxhash64("text").alias("th"), "text").mapInPandas(run, "v long, doc_id long, th long, n long, sha binary, h array<long>, at array<long>, twice array<boolean>")


def with_texts(docs: DataFrame, heads: DataFrame, per_v: DataFrame) -> DataFrame:
    """doc_id (null: least), text and per_v's columns of each row v of per_v; a row of docs that is repeated comes again."""
    need = heads.select("v", "doc_id", "th").join(per_v, "v")
    return docs.where("text is not null").select(least_id(), F.xxhash64("text").alias("th"), "text").join(need, ["doc_id", "th"]).drop("th")


def cut_out(texts: DataFrame, length: int) -> DataFrame:
    """The bytes s of each span in `parts` of the texts (v, doc_id, text, parts), from its first start lo on, and their digest d1, d2."""
    size = length

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        names, out, held = ["h", "d1", "d2", "doc_id", "v", "lo", "s"], [], 0
        for b in batches:
            for v, doc_id, text, parts in zip(b["v"], b["doc_id"], b["text"], b["parts"]):
                raw = text.encode("utf-8", "replace")
                for p in parts:
                    lo, more = divmod(p["at"], SPAN)
                    s = raw[lo : lo + more + size]
                    held += len(s)
                    out.append((p["h"], *struct.unpack(">qq", xxhash.xxh3_128_digest(s)), doc_id, v, lo, s))
                if held > 4_000_000:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    return texts.mapInPandas(run, "h long, d1 long, d2 long, doc_id long, v long, lo long, s binary")


def by_bytes(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (h, d1, d2, doc_id, v, lo, s) the first of each h and s, and of the others (v, lo, n). Rows are grouped by the
    bytes themselves, in part before they are shuffled. The others are found by digest if that says the same: if no
    two groups have one."""
    o = F.struct("doc_id", "v", "lo")
    firsts = materialize(found.groupBy("h", "d1", "d2", "s").agg(F.min(o).alias("f")))
    keys = ["h", "d1", "d2"]
    keys = keys if firsts.groupBy(*keys).count().where("count > 1").isEmpty() else [*keys, "s"]
    others = found.select(*keys, o.alias("o"), F.length("s").alias("n")).join(firsts.select(*keys, "f"), keys).where("o != f")
    return firsts, materialize(others.select("o.v", "o.lo", "n"))


def repeats(dealt: DataFrame, length: int) -> DataFrame:
    """(v, lo, hi): starts of windows that an earlier one equals, among spans (bucket, doc_id, v, lo, s)."""
    size = length

    def run(key, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["doc_id", "v", "lo"])
        parts = list(b["s"])
        sizes = np.array([len(p) for p in parts])
        text = np.frombuffer(b"".join(parts), np.uint8)
        begin = np.cumsum(sizes) - sizes
        wanted = np.zeros(len(text) + 1, np.int32)
        np.add.at(wanted, begin, 1)
        np.add.at(wanted, begin + sizes - size + 1, -1)
        wanted = np.cumsum(wanted[:-1]) > 0
        order = suffix_order(text, wanted, size)
        same = agree(text, order, size)
        # of equal windows the first start stays; positions are in that order
        group = np.cumsum(~same)
        first = np.full(group[-1] + 1 if len(group) else 1, len(text), np.int64)
        np.minimum.at(first, group, order)
        late = np.sort(order[order != first[group]])
        own = np.searchsorted(begin, late, side="right") - 1
        at = b["lo"].to_numpy()[own] + late - begin[own]
        v = b["v"].to_numpy()[own]
        edge = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
        last = np.append(edge[1:], len(at))[: len(edge)] - 1
        return pd.DataFrame({"v": v[edge], "lo": at[edge], "hi": at[last]}).astype("int64")

    return dealt.groupBy("bucket").applyInPandas(run, "v long, lo long, hi long")


def remove_repeats(docs: DataFrame, length: int = 100, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs(doc_id, text)."""
    sig = materialize(rows(docs, length))
    heads = materialize(sig.where("n is not null").select("v", "doc_id", "th", "n", "sha"))
    copies = heads.groupBy("sha", "n").agg(F.min(F.struct("doc_id", "v")).alias("f"), F.count("*").alias("c")).where("c > 1")
    copies = materialize(heads.join(copies, ["sha", "n"]).where(F.col("v") != F.col("f.v")).select("v"))
    blocks = sig.where("h is not null").join(copies, "v", "left_anti")
    grams = blocks.select("v", F.explode(F.arrays_zip("h", "at", "twice")).alias("g"))
    often = grams.groupBy("g.h").agg(F.count("*").alias("c"), F.max("g.twice").alias("t")).where("c > 1 or t").select("h")
    often = materialize(often)
    wanted = materialize(grams.select("v", "g.h", "g.at").join(often, "h"))
    discard(sig, often)
    per = wanted.groupBy("v").agg(F.collect_list(F.struct("h", "at")).alias("parts"))
    found = materialize(cut_out(with_texts(docs, heads, per), length))
    discard(wanted)
    own, others = by_bytes(found)
    discard(found)
    # hashes whose different spans fill more than a bucket: their windows
    many = materialize(own.groupBy("h").agg(F.sum(F.length("s")).alias("n")).where(F.col("n") > bucket).select("h"))
    windows = own.join(many, "h", "left_semi").select("h", "f", "s", F.explode(F.sequence(F.lit(0), F.length("s") - length)).alias("i"))
    w = F.substring("s", F.col("i") + 1, F.lit(length))
    windows = windows.select("h", F.xxhash64(w).alias("d1"), F.xxhash64(F.lit(7), w).alias("d2"), "f.doc_id", "f.v", (F.col("f.lo") + F.col("i")).alias("lo"), w.alias("s"))
    singles, late = by_bytes(windows)
    deal = own.join(many, "h", "left_anti")
    total = deal.agg(F.sum(F.length("s"))).first()[0] or 0
    deal = deal.select(F.pmod(F.xxhash64("h"), F.lit(int(total // bucket + 1))).alias("bucket"), "f.*", "s")
    whole = others.unionAll(late).select("v", "lo", (F.col("lo") + F.col("n") - length).alias("hi"))
    hits = materialize(repeats(deal, length).unionByName(whole))
    discard(own, others, singles, late, many)
    size = length
    cuts = hits.select("v", "lo", (F.col("hi") + size).alias("end")).groupBy("v").agg(F.collect_list(F.struct("lo", "end")).alias("cuts"))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v, text, cuts in zip(b["v"], b["text"], b["cuts"]):
                raw, at, gone, n, kept = text.encode("utf-8", "replace"), 0, 0, 0, hashlib.sha256()
                merged: list[list[int]] = []
                for lo, end in sorted((c["lo"], c["end"]) for c in cuts):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([lo, end])
                for lo, end in merged:
                    kept.update(raw[at:lo])
                    at, gone, n = end, gone + end - lo, n + 1
                kept.update(raw[at:])
                out.append((v, gone, n, kept.hexdigest()))
            yield pd.DataFrame(out, columns=["v", "gone", "spans", "kept"])

    edited = materialize(with_texts(docs, heads, cuts).mapInPandas(apply, "v long, gone long, spans long, kept string"))
    out = heads.join(copies.withColumn("copy", F.lit(True)), "v", "left").join(edited.dropDuplicates(["v"]), "v", "left")
    whole = F.col("copy") & (F.col("n") >= length)  # an earlier row has the same text
    return out.select(
        F.when(F.col("doc_id") != LEAST, F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))

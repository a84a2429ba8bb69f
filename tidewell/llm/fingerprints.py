"""Operator 5, document fingerprints: canonical exact digest, in DataFrame and SQL functions only.

A text's canonical form: compatibility composition (NFKC), case folded, white space run together, trimmed. Its
fingerprint is two 64-bit xxhashes. Documents whose fingerprints meet are compared by their canonical bytes, edited texts
by SHA-256; should different ones have met, each gets its own SHA-256 as extension, so that equal fingerprints mean equal
canonical texts.
Likeness of two fingerprints is 1 where they are equal, else 0: an exact digest knows nothing between.

The next document, by descending doc_id, is found in buckets of neighbouring ids; each bucket also gets the head of the
next one. Rows of equal doc_id are ordered by a hash of their texts, null ids come last.

Defined results: a null text counts as empty; the only document is its own next one. An empty table gives no rows.
Columns other than doc_id and text aren't read.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, table

#: Rows of a bucket of neighbouring ids, about, and the quantiles between which ids are dealt evenly.
NEIGHBOURS, QUANTILES = 1000, 64


def nfkc(c: Column) -> Column:
    """Compatibility composition by the JVM's Unicode library; plain ASCII is its own form."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))).otherwise(c)


def canonical(c: Column) -> Column:
    folded = F.when(c.rlike(r"[^\x00-\x7F]"), nfkc(F.lower(F.upper(nfkc(c))))).otherwise(F.lower(c))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x{85}]+", " "))


def digest(c: Column) -> Column:
    """128 bits of a canonical text, in hex."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(c)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second"), c, F.length(c))), 16, "0")))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, h, text and next (text) of each row of docs; h is the text's hash."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n, cuts = rows.agg(F.count("*"), F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000)).first()
    cuts = sorted(set(cuts or [0]))
    parts = max(1, -(-n // (QUANTILES * NEIGHBOURS)))
    # an id's bucket: its quantile, and its place between the quantile's ends
    bounds = F.array(*[F.lit(c) for c in cuts])
    cell = F.greatest(F.size(F.filter(bounds, lambda c: c <= F.col("doc_id"))), F.lit(1))
    low, high = F.get(bounds, F.col("cell") - 1), F.coalesce(F.get(bounds, F.col("cell")), F.get(bounds, F.col("cell") - 1) + 1)
    place = F.floor((F.col("doc_id") - low) / (high - low).cast("double") * parts)
    # null ids, which come last, are dealt by their texts' hashes, in order, to buckets below 0
    bucket = F.when(F.col("doc_id").isNull(), F.shiftright("h", 52) - 4096).otherwise(F.col("cell").cast("long") * parts + F.least(F.greatest(place, F.lit(0)), F.lit(parts - 1)))
    rows = rows.withColumn("cell", cell).withColumn("bucket", bucket.cast("long")).drop("cell")
    heads = materialize(rows.groupBy("bucket").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("d"), F.col("h"))).alias("o")))
    # a row for each bucket; each takes the head of the next lower bucket, the last that of the first
    down = Window.orderBy(F.desc("bucket"))
    every = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    guests = heads.select(F.coalesce(F.lag("bucket").over(down), F.min("bucket").over(every)).alias("to"), F.col("bucket").alias("from"), F.col("o.d").alias("d"), F.col("o.h").alias("x"))
    met = rows.join(guests, (F.col("bucket") == F.col("from")) & (F.col("h") == F.col("x")) & (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("d")))
    both = rows.withColumn("guest", F.lit(0)).unionByName(met.select("doc_id", "text", "h", F.col("to").alias("bucket"), F.lit(1).alias("guest")))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("h"))
    return both.select("doc_id", "h", "text", "guest", F.lead("text").over(order).alias("next")).where("guest = 0").drop("guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)))
    rows = rows.select("doc_id", "h", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("own"), canonical(F.col("edited")).alias("other"), canonical(F.col("next")).alias("following"))
    same = lambda x: F.when(F.col("own") == F.col(x), 1.0).otherwise(0.0)
    return rows.select("doc_id", "n_chars", "edited_sha256", digest(F.col("own")).alias("f"), digest(F.col("other")).alias("g"), same("other").alias("near_edited"), same("following").alias("near_next"), F.sha2("own", 256).alias("fs"), F.sha2("other", 256).alias("gs"))


def checked(docs: DataFrame) -> DataFrame:
    """The fingerprints, after the canonical texts of those that meet have been compared."""
    out = materialize(fingerprints(docs))
    met = out.select(F.explode(F.array("f", "g")).alias("f")).groupBy("f").agg(F.count("*").alias("c")).where("c > 1").select("f")
    met = materialize(met)
    # texts whose fingerprint met another: whole documents first, then edited ones
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(canonical(F.col("text")).alias("t"))
    rows = rows.select(digest(F.col("t")).alias("f"), "t").join(met, "f")
    clash = rows.groupBy("f").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a != b").select("f")
    # edited texts, among themselves and against whole documents, by SHA-256
    both = out.select(F.explode(F.array(F.struct("f", F.col("fs").alias("s")), F.struct(F.col("g").alias("f"), F.col("gs").alias("s")))).alias("e")).select("e.*")
    clash = clash.unionAll(both.groupBy("f").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a != b").select("f")).distinct()
    clash = materialize(clash)
    for c, s in (("f", "fs"), ("g", "gs")):
        met = clash.select(F.col("f").alias("_met"))
        out = out.join(met, F.col(c) == F.col("_met"), "left").withColumn(c, F.when(F.col("_met").isNull(), F.col(c)).otherwise(F.concat(c, F.lit("-"), s))).drop("_met")
    return out.drop("fs", "gs")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = checked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("f").alias("fingerprint"), F.col("g").alias("edited_fingerprint"), "near_edited", "near_next")

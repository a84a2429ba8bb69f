"""Operator 1, mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's rate is its target divided by its size: every document is taken floor(rate) times and once more with
probability rate - floor(rate). These fractions are rounded in pairs: of two documents one hands expected words to the
other, at random and without changing the pair's sum, until one of them is taken or not for certain; the other goes on
to the next pair. Buckets of about `bucket` documents are rounded each in one fold, what each leaves over goes up to
the next level of a reduction tree, and a source ends with one document left to chance. The words taken thus miss the
target by less than one document's size.

Randomness is a hash of the rows' contents: reruns agree whatever the partitioning.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source of its own, the last in order;
a source of no words gets target 0. Repeated rows are rounded each for itself. An empty table gives no rows.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import WORD, carried, materialize, table, unpacked


def targets(items: DataFrame, weights: tuple, cap: float, share: float) -> DataFrame:
    """source, source_size, target, documents with words. One row a source."""
    by = items.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("m"))
    # all windows below order the table of sources, a row each, not documents
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("w", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    by = by.withColumn("level", left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    by = by.withColumn("i", F.row_number().over(order))
    open_ = F.when(F.col("w") * F.col("level") <= F.col("most"), F.col("i"))
    final = F.min_by("level", open_).over(everything)
    return by.select("source", "source_size", F.coalesce(F.least("most", F.col("w") * final), F.col("most")).alias("target"), "m")


#: One step of the fold. a: what is left over so far (row, key, size, expected words; null at first), x: the next document.
#: Either a gains from x (probability `lose / (gain + lose)`) or x from a, as much as the first to become certain allows.
STEP = """
aggregate(items, named_struct('a', cast(null as struct<rid:bigint,k:bigint,size:double,mass:double>), 'done', cast(array() as array<struct<rid:bigint,hit:int>>)), (s, x) ->
  case when s.a is null then named_struct('a', x, 'done', s.done)
  when (xxhash64(s.a.k, x.k, {level}) & 9007199254740991) / 9007199254740992D * (least(s.a.size - s.a.mass, x.mass) + least(s.a.mass, x.size - x.mass)) < least(s.a.mass, x.size - x.mass) then
    if(s.a.size - s.a.mass <= x.mass,
       named_struct('a', named_struct('rid', x.rid, 'k', x.k, 'size', x.size, 'mass', greatest(0D, s.a.mass + x.mass - s.a.size)), 'done', concat(s.done, array(named_struct('rid', s.a.rid, 'hit', 1)))),
       named_struct('a', named_struct('rid', s.a.rid, 'k', s.a.k, 'size', s.a.size, 'mass', s.a.mass + x.mass), 'done', concat(s.done, array(named_struct('rid', x.rid, 'hit', 0)))))
  else
    if(s.a.mass <= x.size - x.mass,
       named_struct('a', named_struct('rid', x.rid, 'k', x.k, 'size', x.size, 'mass', s.a.mass + x.mass), 'done', concat(s.done, array(named_struct('rid', s.a.rid, 'hit', 0)))),
       named_struct('a', named_struct('rid', s.a.rid, 'k', s.a.k, 'size', s.a.size, 'mass', greatest(0D, s.a.mass + x.mass - x.size)), 'done', concat(s.done, array(named_struct('rid', x.rid, 'hit', 1)))))
  end)
"""


def round_pairs(items: DataFrame, bucket: int) -> DataFrame:
    """(rid, hit) for items (source, m, rid, k, size, mass): hit is 1 for those taken."""
    todo = items.withColumn("n", F.ceil(F.col("m") / bucket)).withColumn("b", F.pmod(F.xxhash64("k", F.lit("bucket")), F.col("n")))
    most = items.agg(F.max("m")).first()[0] or 1
    n, level, done = -(-most // bucket), 0, []
    while True:
        packed = todo.groupBy("source", "b", "n").agg(F.array_sort(F.collect_list(F.struct("k", "rid", "size", "mass"))).alias("items"))
        packed = packed.withColumn("items", F.transform("items", lambda x: F.struct(x["rid"].alias("rid"), x["k"].alias("k"), x["size"].alias("size"), x["mass"].alias("mass"))))
        folded = materialize(packed.select("source", "b", "n", F.expr(STEP.format(level=level)).alias("s")).select("source", "b", "n", "s.a", "s.done"))
        done.append(folded.select(F.explode("done").alias("d")).select("d.rid", "d.hit"))
        if n <= 1:
            chance = (F.xxhash64("a.k", F.lit("last")).bitwiseAND(9007199254740991) / 9007199254740992.0 * F.col("a.size") < F.col("a.mass")).cast("int")
            done.append(folded.select("a.rid", chance.alias("hit")))
            break
        todo = folded.select("source", F.floor(F.col("b") / bucket).alias("b"), F.ceil(F.col("n") / bucket).alias("n"), "a.*")
        n, level = -(-n // bucket), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def copies(docs: DataFrame, weights: tuple = (1, 2, 3), cap: int = 3, share: float = 1.0, bucket: int = 200) -> DataFrame:
    """doc_id, source, h (the text's hash), size, source_size, target, copies and taken, for each row of docs."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("h"), size.alias("size"))
    items = materialize(rows.select("*", F.monotonically_increasing_id().alias("rid"), F.xxhash64("doc_id", "h", "size").alias("k")))
    by = materialize(targets(items, weights, cap, share))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    by = by.withColumn("whole", F.floor(rate + 1e-9)).withColumn("part", F.greatest(F.lit(0.0), rate - F.col("whole")))
    named = items.join(by, items["source"].eqNullSafe(by["source"])).drop(by["source"])
    mass = (F.col("size") * F.col("part")).alias("mass")
    loose = named.where("size > 0 and part > 1e-9").select("source", "m", "rid", "k", F.col("size").cast("double").alias("size"), mass)
    out = named.join(round_pairs(loose, bucket).hint("merge"), "rid", "left")  # a row a document: not to be broadcast
    n = (F.col("whole") + F.coalesce("hit", F.lit(0))).cast("long")
    return out.select("doc_id", "source", "h", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mix takes it. Of rows alike in id, source and text, one stands for all of them."""
    taken = copies(docs.select("doc_id", "source", "text"), **how)
    total = taken.where("copies > 0").groupBy("doc_id", "source", "h").agg(F.sum("copies").cast("int").alias("times"))
    rows = carried(docs, F.col("doc_id").alias("d"), F.col("source").alias("s"), F.xxhash64("text").alias("x"))
    same = rows["d"].eqNullSafe(total["doc_id"]) & rows["s"].eqNullSafe(total["source"]) & (rows["x"] == total["h"])
    once = rows.join(total, same).dropDuplicates(["d", "s", "x"])
    return unpacked(once.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("i")), docs.columns)

"""Operator 4, exact top-k search by inner product: norm-bucketed retrieval.

Vectors are grouped by length (norm). What a query has to reach, its k-th best product so far, becomes in each bucket a
cosine threshold: product / (query's norm * bucket's largest norm). Above 1 the bucket is passed over; where it is high,
coordinate pruning keeps the vectors whose entries at the query's largest coordinates can still make that cosine; where
it is low, length pruning keeps the bucket's vectors that are long enough. What is kept is verified by its product.

Queries and candidates are dealt into blocks that meet once each; a first round against some of the longest vectors
gives the thresholds with which blocks are passed over. Each meeting returns at most k rows a query.

Defined results: a vector that is null, empty or holds a null or non-finite component takes no part, nor does a row
with a null id. Vectors of different numbers of components are not compared. Rows alike in id and vector count once,
rows of the query's own id are no candidates. Products must stay below 2^53 to be exact. An empty table gives no rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import materialize, table

#: Rows of a query block, of a candidate block, and of a bucket inside a block.
QUERIES, CANDIDATES, BUCKET = 1024, 16384, 512
#: Cosine threshold from which coordinate pruning is tried, and the coordinates it looks at.
HIGH, FOCUS = 0.75, 4


def integers(rows: DataFrame, scale: int = 64) -> DataFrame:
    """(id, x, dim, norm): the rows that take part, each component floored after scaling."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * scale).cast("double"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    out = rows.where(good).where(fine).select(F.col("vec_id").cast("long").alias("id"), x.alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, e: a + e * e))
    return out.dropDuplicates(["id", "x"]).withColumn("dim", F.size("x")).withColumn("norm", norm)


class Best:
    """A query's k best so far: higher products first, then smaller ids."""

    def __init__(self, k: int, floor: float):
        self.k, self.scores, self.ids, self.floor = k, np.zeros(0), np.zeros(0, np.int64), floor

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.floor
        scores, ids = scores[keep], ids[keep]
        if not len(ids):
            return
        s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((i, -s))[: self.k]
        self.scores, self.ids = s[order], i[order]
        if len(order) == self.k:
            self.floor = max(self.floor, self.scores[-1])


def search(q: np.ndarray, q_ids: np.ndarray, floors: np.ndarray, p: np.ndarray, p_ids: np.ndarray, k: int) -> list[Best]:
    """The k best of the candidates p for each query, left out those under its floor."""
    norms = np.sqrt((p * p).sum(1))
    order = np.argsort(-norms, kind="stable")
    p, p_ids, norms = p[order], p_ids[order], norms[order]
    q_norms = np.sqrt((q * q).sum(1))
    best = [Best(k, f) for f in floors]
    focus = np.argsort(-np.abs(q), axis=1)[:, :FOCUS]
    for at in range(0, len(p), BUCKET):
        b, ids, longest = p[at : at + BUCKET], p_ids[at : at + BUCKET], norms[at]
        floor = np.array([x.floor for x in best])
        reach = q_norms * longest
        open_ = floor <= reach * (1 + 1e-12)
        cosine = np.where((reach > 0) & np.isfinite(floor), np.divide(floor, reach, out=np.zeros_like(reach), where=reach > 0), -1.0)
        by_coordinate = open_ & (cosine >= HIGH)
        unit = b / np.maximum(norms[at : at + BUCKET], 1e-300)[:, None] if by_coordinate.any() else None
        for i in np.flatnonzero(by_coordinate):
            c, kept = min(1.0, cosine[i]) - 1e-9, np.arange(len(b))
            for f in focus[i]:
                u = q[i, f] / q_norms[i]
                spread = np.sqrt((1 - c * c) * max(0.0, 1 - u * u)) + 1e-9
                v = unit[kept, f]
                # an entry above c * u + spread or below c * u - spread leaves too little for the other coordinates
                kept = kept[(v >= u * c - spread) & (v <= (u * c + spread if u * 1.0 < c else 1.0))] if u >= 0 else kept[(v <= u * c + spread) & (v >= (u * c - spread if -u < c else -1.0))]
            kept = kept[ids[kept] != q_ids[i]]
            best[i].offer(b[kept] @ q[i], ids[kept])
        rest = np.flatnonzero(open_ & ~by_coordinate)
        if len(rest):
            scores = q[rest] @ b.T
            long_enough = q_norms[rest, None] * norms[None, at : at + BUCKET] * (1 + 1e-12) >= floor[rest, None]
            scores[(ids[None, :] == q_ids[rest, None]) | ~long_enough] = -np.inf
            for i, s in zip(rest, scores):
                best[i].offer(s[s > -np.inf], ids[s > -np.inf])
    return best


def meet(queries: DataFrame, candidates: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(query_id, qx, vec_id, score): each query block with each candidate block of the same keys."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "qh": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            q, p = np.array(left["x"].tolist(), np.float64), np.array(right["c_x"].tolist(), np.float64)
            floors = left["floor"].fillna(-np.inf).to_numpy(np.float64)
            for qid, qh, b in zip(left["id"], left["qh"], search(q, left["id"].to_numpy(), floors, p, right["c_id"].to_numpy(), k)):
                out["query_id"] += [qid] * len(b.ids)
                out["qh"] += [qh] * len(b.ids)
                out["vec_id"] += b.ids.tolist()
                out["score"] += b.scores.tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "qh": "int64", "vec_id": "int64", "score": "int64"})

    other = candidates.select(*[F.col(c).alias(f"c_{c}") for c in candidates.columns])
    return queries.groupBy(*keys).cogroup(other.groupBy(*[f"c_{c}" for c in keys])).applyInPandas(run, "query_id long, qh long, vec_id long, score long")


def top_k(rows: DataFrame, is_query, k: int = 20, levels: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that satisfy is_query (a condition on vec_id), against all rows."""
    v = materialize(integers(rows))
    counted = v.agg(F.percentile_approx("norm", [i / levels for i in range(1, levels)], 1000)).first()
    cuts = sorted(set(counted[0] or []))
    level = F.lit(0)
    for c in cuts:  # the longest vectors have level 0
        level = level + (F.col("norm") < F.lit(c)).cast("int")
    sized = v.withColumn("level", level)
    sizes = sized.groupBy("level", "dim").agg(F.count("*").alias("c"))
    # a level of many rows, whatever makes it so large, is dealt into blocks by a hash of the id
    block = F.pmod(F.xxhash64("id", F.lit("c")), F.ceil(F.col("c") / CANDIDATES))
    dealt = materialize(sized.join(F.broadcast(sizes), ["level", "dim"]).withColumn("block", block).drop("c"))
    blocks = dealt.groupBy("level", "dim", "block").agg(F.max("norm").alias("longest"))  # a row for each 16,384 vectors or level
    q = v.withColumnRenamed("id", "vec_id").where(is_query).withColumnRenamed("vec_id", "id")
    blocks_of_q = max(1, -(-q.count() // QUERIES))
    q = q.withColumn("qh", F.xxhash64("x")).withColumn("qb", F.pmod(F.xxhash64("id", F.lit("q")), F.lit(blocks_of_q)))
    # first round: against one block of the longest vectors
    head = dealt.where("level = 0 and block = 0").select("id", "x", "dim")
    head = head.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks_of_q - 1).cast("long"))))  # one block for each query block
    first = meet(q.withColumn("floor", F.lit(None).cast("double")), head, ["qb", "dim"], k)
    first = materialize(first)
    floors = first.groupBy("query_id", "qh").agg(F.count("*").alias("c"), F.min("score").alias("s")).where(f"c >= {k}")
    floors = floors.select(F.col("query_id").alias("id"), "qh", F.col("s").cast("double").alias("floor"))
    q = q.join(floors, ["id", "qh"], "left")
    # second round: the blocks that can still reach a query's floor; a block's row is repeated for each query block
    wanted = q.join(blocks, "dim").where("floor is null or floor <= norm * longest * 1.000001")
    pairs = wanted.select("qb", "dim", "level", "block").distinct()
    keys = ["qb", "dim", "level", "block"]
    hits = meet(wanted.select(*keys, "id", "qh", "x", "floor"), dealt.join(pairs, ["dim", "level", "block"]).select(*keys, "id", "x"), keys, k)
    rank = F.row_number().over(Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

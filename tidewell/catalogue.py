"""The queries of the feature operators over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import ieee
from tidewell.operators import arrays, digest, lookups, scalars, scalers
from tidewell.operators.base import DOUBLE, Chain, Fan, Field, Function, Identity, Spread, schema_fields, transform
from tidewell.plans.fit import FitPlan
from tidewell.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LINE = ("l_orderkey", "l_linenumber")
FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FOUR_WORDS = "list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: w)"


def query(sql: str | None = None):
    def note(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return note


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def scaled(df: DataFrame, scaler, column: str, keys, out: str = "y") -> DataFrame:
    scaler.fit(df, column)
    return df.select(*keys, F.round(scaler(F.col(column)), 6).alias(out))


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / s, 6) AS y FROM lineitem, (SELECT avg(l_extendedprice) m, stddev_samp(l_extendedprice) s FROM lineitem)")
def standard_score(spark, d):
    return scaled(read(spark, d, "lineitem"), scalers.StandardScore(), "l_extendedprice", LINE)


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / s, 6) AS y FROM lineitem, (SELECT avg(l_extendedprice) m, stddev_pop(l_extendedprice) s FROM lineitem)")
def standard_score_pop(spark, d):
    return scaled(read(spark, d, "lineitem"), scalers.StandardScore(0), "l_extendedprice", LINE)


@query("SELECT event_id, round((value - a) / (b - a), 6) AS y FROM events, (SELECT min(value) a, max(value) b FROM events)")
def min_max(spark, d):
    return scaled(read(spark, d, "events"), scalers.MinMaxScale(), "value", ["event_id"])


@query("SELECT o_orderkey, round((o_totalprice - m) / (b - a), 6) AS y FROM orders, (SELECT avg(o_totalprice) m, min(o_totalprice) a, max(o_totalprice) b FROM orders)")
def mean_scale(spark, d):
    return scaled(read(spark, d, "orders"), scalers.MeanScale(), "o_totalprice", ["o_orderkey"])


@query(
    "SELECT o_orderkey, round((o_totalprice - m) / (b - a), 6) AS y FROM orders, "
    "(SELECT avg(m) m, min(a) a, max(b) b FROM (SELECT avg(o_totalprice) m, min(o_totalprice) a, max(o_totalprice) b FROM orders GROUP BY o_orderstatus))"
)
def mean_scale_batches(spark, d):
    return scaled(read(spark, d, "orders"), scalers.MeanScale(batch="o_orderstatus"), "o_totalprice", ["o_orderkey"])


@query(
    "SELECT o_orderkey, round(least(greatest((o_totalprice - m) / (b - a), -0.25), 0.25), 6) AS y FROM orders, "
    "(SELECT avg(m) m, min(a) a, max(b) b FROM (SELECT avg(o_totalprice) m, min(o_totalprice) a, max(o_totalprice) b FROM orders GROUP BY o_orderstatus))"
)
def mean_scale_batches_in_a_plan(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    tree = Chain(Field(None, "o_totalprice", DOUBLE), scalers.MeanScale(batch="o_orderstatus"), scalars.Clamp(-0.25, 0.25))
    FitPlan(tree).fit(df)
    return transform(df, tree, "y").select("o_orderkey", F.round("y", 6).alias("y"))


@query(
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS y{i}" for i, c in enumerate(FOUR))
    + " FROM lineitem"
)
def stacked_scores(spark, d):
    df = read(spark, d, "lineitem").select(*LINE, F.array(*[F.col(c) for c in FOUR]).alias("v"))
    op = scalers.Stacked([scalers.StandardScore() for _ in FOUR]).fit(df, "v")
    out = transform(df, op, "z", [F.col("v")])
    return out.select(*LINE, *[F.round(F.col("z")[i], 6).alias(f"y{i}") for i in range(len(FOUR))])


@query(
    "SELECT event_id, round((value - q[2]) / (q[3] - q[1]), 6) AS y FROM events, (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) q FROM events)"
)
def robust_exact(spark, d):
    return scaled(read(spark, d, "events"), scalers.RobustScale(), "value", ["event_id"])


@query(
    "SELECT l_orderkey, l_linenumber, round((l_extendedprice - q[2]) / (q[3] - q[1]), 6) AS y, round((l_quantity - p[2]) / (p[3] - p[1]), 6) AS z "
    "FROM lineitem, (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) q, quantile_cont(l_quantity, [0.25, 0.5, 0.75]) p FROM lineitem)"
)
def robust_stacked(spark, d):
    """Exact quartiles of many rows, and of a column of few different values."""
    df = read(spark, d, "lineitem").select(*LINE, F.array("l_extendedprice", "l_quantity").alias("v"))
    op = scalers.Stacked([scalers.RobustScale(), scalers.RobustScale()]).fit(df, "v")
    out = transform(df, op, "z", [F.col("v")])
    return out.select(*LINE, F.round(F.col("z")[0], 6).alias("y"), F.round(F.col("z")[1], 6).alias("z"))


@query("SELECT true AS median_ok, true AS iqr_ok")
def robust_approx_ok(spark, d):
    """A property, not values: the sketches' quantiles are within 1 % of the exact ones' distance."""
    df = read(spark, d, "events")
    exact, approx, sketched = scalers.RobustScale().fit(df, "value"), scalers.RobustScale("approx").fit(df, "value"), digest.DigestRobustScale().fit(df, "value")
    near = lambda a, b: abs(a - b) <= 0.01 * exact.iqr
    ok = [all(near(x.median, exact.median) for x in (approx, sketched)), all(near(x.iqr, exact.iqr) for x in (approx, sketched))]
    return spark.createDataFrame([tuple(map(bool, ok))], "median_ok boolean, iqr_ok boolean")


@query(
    "WITH e AS (SELECT event_id, value, rank() OVER (ORDER BY value) r, count(*) OVER () n, min(value) OVER () a, max(value) OVER () b FROM events) "
    "SELECT event_id, round(CASE WHEN value <= a THEN 0 WHEN value >= b THEN 1 ELSE (r - 1) / n::DOUBLE END, 6) AS y FROM e"
)
def cdf_compat_rank(spark, d):
    """The older way of reading a digest, over every event. The SQL is that of single values, which are ranked and not sketched."""
    df = read(spark, d, "events").select("event_id", "value")
    return digest.compat_ranks(df, "value", "y").select("event_id", F.round("y", 6).alias("y"))


@query("SELECT event_id, round(cume_dist() OVER (ORDER BY value), 6) AS y FROM events")
def cdf_ecdf(spark, d):
    df = read(spark, d, "events").select("event_id", "value")
    return scalers.empirical_cdf(df, "value").select("event_id", F.round("cdf", 6).alias("y"))


@query("SELECT true AS close")
def cdf_digest_ok(spark, d):
    """A property: the digest's shares are within 0.01 of the exact ones."""
    df = read(spark, d, "events").select("value")
    op = digest.TDigestDistribution(200.0).fit(df, "value")
    exact = scalers.empirical_cdf(df, "value")
    return exact.agg((F.max(F.abs(F.col("cdf") - op(F.col("value")))) <= 0.01).alias("close"))


def encoded(spark, d, table, key, lookup, keys):
    df = read(spark, d, table).select(*keys, *([key] if key not in keys else []))
    lookup.fit(df, key)
    return transform(df, lookup, "y", [F.col(key)]).select(*keys, "y")


@query("SELECT o_orderkey, c AS y FROM orders JOIN (SELECT o_orderpriority, count(*) c FROM orders GROUP BY 1) USING (o_orderpriority)")
def count_lookup(spark, d):
    return encoded(spark, d, "orders", "o_orderpriority", lookups.CountLookup(), ["o_orderkey"])


@query(
    "SELECT o_orderkey, round(c / t::DOUBLE, 9) AS y FROM orders JOIN (SELECT o_orderpriority, count(*) c, sum(count(*)) OVER () t FROM orders GROUP BY 1) USING (o_orderpriority)"
)
def ratio_lookup(spark, d):
    out = encoded(spark, d, "orders", "o_orderpriority", lookups.RatioLookup(), ["o_orderkey"])
    return out.withColumn("y", F.round("y", 9))


BRANDS = "SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) + 1 i, count(*) c FROM part GROUP BY 1"


@query(f"SELECT p_partkey, i AS y FROM part JOIN ({BRANDS}) USING (p_brand)")
def index_lookup(spark, d):
    return encoded(spark, d, "part", "p_brand", lookups.IndexLookup(), ["p_partkey"])


@query("SELECT p_partkey, c AS y FROM part JOIN (SELECT p_size, count(*) c FROM part GROUP BY 1) USING (p_size)")
def int_count(spark, d):
    return encoded(spark, d, "part", "p_size", lookups.IntCountLookup(), ["p_partkey"])


@query("SELECT p_partkey, round(c / t::DOUBLE, 9) AS y FROM part JOIN (SELECT p_size, count(*) c, sum(count(*)) OVER () t FROM part GROUP BY 1) USING (p_size)")
def int_ratio(spark, d):
    return encoded(spark, d, "part", "p_size", lookups.IntRatioLookup(), ["p_partkey"]).withColumn("y", F.round("y", 9))


@query("SELECT p_partkey, i AS y FROM part JOIN (SELECT p_size, row_number() OVER (ORDER BY count(*) DESC, p_size::VARCHAR) + 1 i FROM part GROUP BY 1) USING (p_size)")
def int_index(spark, d):
    return encoded(spark, d, "part", "p_size", lookups.IntIndexLookup(), ["p_partkey"])


@query("SELECT o_orderkey, i AS y FROM orders JOIN (SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, o_custkey::VARCHAR) + 1 i FROM orders GROUP BY 1) USING (o_custkey)")
def int_index_joined(spark, d):
    """A dictionary too large for a literal map: joined."""
    return encoded(spark, d, "orders", "o_custkey", lookups.IntIndexLookup(), ["o_orderkey"])


def brands(spark, d, eliminator):
    return eliminator(lookups.CountLookup().count(read(spark, d, "part"), "p_brand")).select("key", "count")


@query('SELECT p_brand AS key, count(*) AS "count" FROM part GROUP BY 1 HAVING count(*) >= 80')
def min_threshold(spark, d):
    return brands(spark, d, lookups.MinThreshold(80))


@query('SELECT key, c AS "count" FROM (SELECT p_brand AS key, count(*) c, sum(count(*)) OVER () t FROM part GROUP BY 1) WHERE c / t::DOUBLE >= 0.04')
def ratio_threshold(spark, d):
    return brands(spark, d, lookups.RatioThreshold(0.04))


@query('SELECT p_brand AS key, count(*) AS "count" FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7')
def top_k(spark, d):
    return brands(spark, d, lookups.TopK(7))


@query('SELECT p_brand AS key, count(*) AS "count" FROM part GROUP BY 1')
def no_threshold(spark, d):
    return brands(spark, d, lookups.NoThreshold())


@query(
    "WITH k AS (SELECT p_size, row_number() OVER (ORDER BY count(*) DESC, p_size::VARCHAR) - 1 r FROM part WHERE p_size < 25 GROUP BY 1) "
    "SELECT p_partkey, coalesce(CASE WHEN r = 0 THEN 0 ELSE r + 2 END, 1) AS y FROM part LEFT JOIN k USING (p_size)"
)
def index_unknown_holdout(spark, d):
    """Fitted on some sizes, applied to all; ids 1 (unknown) and 2 (padding) are reserved."""
    df = read(spark, d, "part").select("p_partkey", "p_size")
    op = lookups.IntIndexLookup(padding_idx=2, unknown_idx=1).fit(df.where("p_size < 25"), "p_size")
    return transform(df, op, "y", [F.col("p_size")]).select("p_partkey", "y")


@query("SELECT p_partkey, CASE WHEN c >= 80 THEN round(c / t::DOUBLE, 9) ELSE 0 END AS y FROM part JOIN (SELECT p_brand, count(*) c, sum(count(*)) FILTER (count(*) >= 80) OVER () t FROM part GROUP BY 1) USING (p_brand)")
def ratio_eliminated(spark, d):
    """The share among the kept keys."""
    return encoded(spark, d, "part", "p_brand", lookups.RatioLookup(lookups.MinThreshold(80)), ["p_partkey"]).withColumn("y", F.round("y", 9))


@query("SELECT count(DISTINCT lang) + 2 AS size FROM documents")
def dictionary_size(spark, d):
    df = read(spark, d, "documents")
    n = lookups.IndexLookup().fit(df, "lang").dictionary_size()
    return df.limit(1).select(F.lit(n).cast("long").alias("size"))


@query(
    "WITH s AS (SELECT avg(l_quantity) m, stddev_samp(l_quantity) s FROM lineitem), "
    "r AS (SELECT l_orderkey, l_linenumber, ((l_quantity - m) / s) / (l_discount - 0.05) q, l_discount x, (l_quantity - m) / s z FROM lineitem, s), "
    "v AS (SELECT *, CASE WHEN x = 0.05 THEN CASE WHEN z > 0 THEN 1.7976931348623157e308 WHEN z < 0 THEN -1.7976931348623157e308 ELSE 0 END ELSE q END n FROM r) "
    "SELECT l_orderkey, l_linenumber, round(least(greatest(n, -1.0), 1.0), 6) AS y FROM v"
)
def nan_to_num_clamp(spark, d):
    """Standard score, divided by what is sometimes zero, made finite, clamped."""
    df = read(spark, d, "lineitem").select(*LINE, "l_quantity", "l_discount")
    score = scalers.StandardScore().fit(df, "l_quantity")
    divided = Function(lambda x: ieee.ieee_div(x, F.col("l_discount") - 0.05), (DOUBLE,), DOUBLE, "divided")
    chain = Chain(Field(None, "l_quantity", DOUBLE), score, divided, scalars.NanToNum(), scalars.Clamp(-1.0, 1.0))
    return transform(df, chain, "y").select(*LINE, F.round("y", 6).alias("y"))


@query("SELECT p_partkey, p_size::VARCHAR AS y FROM part")
def to_str(spark, d):
    return transform(read(spark, d, "part").select("p_partkey", "p_size"), scalars.ToStr(), "y", [F.col("p_size")]).select("p_partkey", "y")


@query("SELECT l_orderkey, l_linenumber, l_quantity AS a, l_tax AS b, l_quantity AS c FROM lineitem")
def stack_split(spark, d):
    """Columns to an array, the array to named values, these merged with others."""
    df = read(spark, d, "lineitem").select(*LINE, "l_quantity", "l_tax")
    both = Chain(Fan([Field(None, "l_quantity", DOUBLE), Field(None, "l_tax", DOUBLE)]), scalars.Stack(1), scalars.SplitToDict(["a", "b"]))
    more = Chain(Fan([Field(None, "l_quantity", DOUBLE)]), scalars.SplitToDict(["c"]))
    merged = scalars.CombineDicts(["a", "b"], ["c"])
    tree = Chain(Fan([both, more], into=tuple), Spread(merged))
    return transform(df, tree, "s").select(*LINE, "s.a", "s.b", "s.c")


@query("SELECT 0::INTEGER AS position, c_custkey AS key, c_acctbal AS value FROM customer UNION ALL SELECT 1, s_suppkey, s_acctbal FROM supplier")
def cat_rows(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    b = read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value"))
    return scalars.cat_rows(a, b).select("position", "key", "value")


@query("SELECT 0::INTEGER AS position, c_custkey, c_acctbal AS value FROM customer UNION ALL SELECT 1, c_custkey, c_nationkey::DOUBLE FROM customer")
def stack_rows(spark, d):
    df = read(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("n"))
    return scalars.stack_long(df, "c_custkey", ["c_acctbal", "n"])


@query("SELECT l_orderkey, l_linenumber, [l_quantity, l_tax, l_discount] AS y FROM lineitem")
def cat_columns(spark, d):
    """Values made arrays of one, arrays put end to end."""
    one = [Chain(Field(None, c, DOUBLE), scalars.Unsqueeze(1)) for c in ("l_quantity", "l_tax", "l_discount")]
    return transform(read(spark, d, "lineitem").select(*LINE, "l_quantity", "l_tax", "l_discount"), Chain(Fan(one), scalars.Cat(1)), "y").select(*LINE, "y")


@query("SELECT vec_id, list_resize(embedding[1:70], 70, 0::FLOAT) AS y FROM embeddings")
def sparse_trunc_pad(spark, d):
    return transform(read(spark, d, "embeddings").select("vec_id", "embedding"), arrays.SparseTruncPad(70, 0.0, "float"), "y", [F.col("embedding")]).select("vec_id", "y")


def words(spark, d):
    return read(spark, d, "documents").select("doc_id", F.filter(F.split("text", " "), lambda w: w != "").alias("v"))


@query(f"SELECT doc_id, ({FOUR_WORDS})[1:5] AS y FROM documents")
def sparse_trunc(spark, d):
    return transform(words(spark, d), arrays.SparseTrunc(5), "y", [F.col("v")]).select("doc_id", "y")


@query(f"SELECT doc_id, len({FOUR_WORDS}) AS y FROM documents")
def sparse_len(spark, d):
    return transform(words(spark, d), arrays.SparseLen(), "y", [F.col("v")]).select("doc_id", "y")


OFFSETS = f"SELECT doc_id, len({FOUR_WORDS}) n, sum(len({FOUR_WORDS})) OVER (ORDER BY doc_id)::BIGINT e FROM documents"


@query(f'SELECT doc_id, e - n AS "begin", e AS "end" FROM ({OFFSETS})')
def sparse_indices(spark, d):
    return arrays.sparse_indices(words(spark, d), "doc_id", "v")


@query(f'SELECT doc_id, e - n AS "begin", least(e - n + 5, e) AS "end" FROM ({OFFSETS})')
def sparse_trunc_indices(spark, d):
    at = arrays.sparse_indices(words(spark, d), "doc_id", "v").select("doc_id", F.struct("begin", "end").alias("s"))
    return transform(at, arrays.SparseTruncIndices(5), "y", [F.col("s")]).select("doc_id", "y.begin", "y.end")


@query(f"SELECT doc_id, i::INTEGER - 1 AS position, v[i] AS value FROM (SELECT doc_id, {FOUR_WORDS} v, unnest(range(1, len({FOUR_WORDS}) + 1)) i FROM documents)")
def sparse_values(spark, d):
    return arrays.sparse_values(words(spark, d), "doc_id", "v")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS y FROM embeddings")
def sparse_map_sum(spark, d):
    out = transform(read(spark, d, "embeddings").select("vec_id", "embedding"), arrays.SparseMapSequences(arrays.array_sum), "y", [F.col("embedding")])
    return out.select("vec_id", F.round("y", 4).alias("y"))


@query(
    "WITH a AS (SELECT l_orderkey, l_linenumber, least(greatest((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER (), -1.0), 1.0) c FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, round((c - avg(c) OVER ()) / stddev_samp(c) OVER (), 6) AS y FROM a"
)
def two_stage_fit(spark, d):
    df = read(spark, d, "lineitem").select(*LINE, "l_extendedprice")
    tree = Chain(Field(None, "l_extendedprice", DOUBLE), scalers.StandardScore(), scalars.Clamp(-1.0, 1.0), scalers.StandardScore())
    FitPlan(tree).fit(df)
    return transform(df, tree, "y").select(*LINE, F.round("y", 6).alias("y"))


@schema_fields
class Order:
    o_totalprice: float
    o_orderpriority: str
    o_orderstatus: str
    o_custkey: int


@query(
    "WITH p AS (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) + 1 i FROM orders GROUP BY 1), "
    "s AS (SELECT o_orderstatus, count(*) / sum(count(*)) OVER ()::DOUBLE r FROM orders GROUP BY 1), "
    "k AS (SELECT o_custkey, count(*) c FROM orders GROUP BY 1), "
    "m AS (SELECT avg(o_totalprice) m, stddev_samp(o_totalprice) s, min(o_totalprice) a, max(o_totalprice) b FROM orders) "
    "SELECT o_orderkey, round(least(greatest((o_totalprice - m) / s, -1.0), 1.0), 6) AS score, round((o_totalprice - a) / (b - a), 6) AS span, i AS priority, round(r, 9) AS status, c AS orders_of_customer "
    "FROM orders JOIN p USING (o_orderpriority) JOIN s USING (o_orderstatus) JOIN k USING (o_custkey), m"
)
def feature_row(spark, d):
    """A whole feature row from one tree and one fit: two scalers, three dictionaries, one of them joined."""
    df = read(spark, d, "orders")
    tree = Fan(
        [
            Chain(Order.o_totalprice, scalers.StandardScore(), scalars.NanToNum(), scalars.Clamp(-1.0, 1.0)),
            Chain(Order.o_totalprice, scalers.MinMaxScale()),
            Chain(Order.o_orderpriority, lookups.IndexLookup()),
            Chain(Order.o_orderstatus, lookups.RatioLookup()),
            Chain(Order.o_custkey, lookups.IntCountLookup()),
        ],
        ["score", "span", "priority", "status", "orders_of_customer"],
        dict,
    )
    FitPlan(tree).fit(df)
    out = transform(df.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_custkey"), tree, "f")
    return out.select("o_orderkey", F.round("f.score", 6).alias("score"), F.round("f.span", 6).alias("span"), "f.priority", F.round("f.status", 9).alias("status"), "f.orders_of_customer")


@query("SELECT n_nationkey, n_nationkey AS a, n_name AS b, n_regionkey AS c FROM nation")
def fan_record(spark, d):
    """A dataclass filled by name, given in another order; Identity passes its argument on."""
    import dataclasses

    record = dataclasses.make_dataclass("Record", ["a", "b", "c"])
    tree = Fan([Function(lambda s: s["n_name"]), Function(lambda s: s["n_regionkey"]), Function(lambda s: s["n_nationkey"])], ["b", "c", "a"], record)
    df = read(spark, d, "nation").select("n_nationkey", F.struct("n_nationkey", "n_name", "n_regionkey").alias("s"))
    return transform(df, Chain(Identity(), tree), "r", [F.col("s")]).select("n_nationkey", "r.a", "r.b", "r.c")



"""Feature operators against literal inputs and closed forms."""

import dataclasses
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import catalogue
from tidewell.functions import ieee
from tidewell.operators import arrays, digest, lookups, scalars, scalers
from tidewell.operators.base import DOUBLE, LONG, STRING, Chain, Fan, Field, Function, Identity, Spread, transform
from tidewell.plans.fit import ALL, BYPASS, FitPlan
from tidewell.sources import tables
from tidewell.streaming.fit import RunningMoments

NAN, INF = math.nan, math.inf
#: Keys with counts 9, 7, 7, 4 and 2: two share a count.
KEYS = ["pine", "oak", "elm", "fir", "ash"]
SEEN = [k for i, k in enumerate(KEYS) for _ in range((9, 7, 7, 4, 2)[i])]


def values(df, c="y"):
    return [r[c] for r in df.collect()]


def column(spark, xs, kind="double"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}").repartition(3).orderBy("i")


def apply(df, op):
    return values(transform(df, op, "y", [F.col("x")]).orderBy("i"))


def test_ieee_division(spark):
    rows = [(1.0, 0.0, INF), (-1.0, 0.0, -INF), (0.0, 0.0, NAN), (NAN, 0.0, NAN), (None, 0.0, None), (6.0, 3.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, want double").repartition(2)
    for r in df.select("want", ieee.ieee_div(F.col("a"), F.col("b")).alias("y")).collect():
        assert r.want == r.y or (r.want != r.want and r.y != r.y)


def test_extremes_with_nan(spark):
    df = column(spark, [1.0, NAN, 3.0])
    assert math.isnan(df.agg(ieee.nan_min(F.col("x"))).first()[0])


def test_nan_to_num_and_clamp(spark):
    df = column(spark, [1.0, NAN, INF, -INF, None])
    assert apply(df, scalars.NanToNum()) == [1.0, 0.0, ieee.HIGHEST, -ieee.HIGHEST, None]
    assert apply(df, scalars.NanToNum(5.0, 6.0, -6.0)) == [1.0, 5.0, 6.0, -6.0, None]
    got = apply(df, scalars.Clamp(-2.0, 2.0))
    assert got[0] == 1.0 and math.isnan(got[1]) and got[2:] == [2.0, -2.0, None]
    assert apply(column(spark, [-40, 7, 12, 30, None], "long"), scalars.Clamp(7, 20)) == [7, 7, 12, 20, None]


def test_text_of_numbers(spark):
    assert apply(column(spark, [1, -2, None], "long"), scalars.ToStr()) == ["1", "-2", None]
    assert apply(column(spark, [1e10, 0.1, NAN, INF, None]), scalars.ToStr(DOUBLE)) == ["10000000000.0", "0.1", "nan", "inf", None]


@pytest.mark.parametrize("parts", [1, 7])
def test_scalers_equal_whole_data(spark, parts):
    x = np.random.default_rng(3).random(200)
    df = column(spark, x.tolist()).repartition(parts).orderBy("i")
    for op, want in (
        (scalers.MeanScale(), (x - x.mean()) / (x.max() - x.min())),
        (scalers.MinMaxScale(), (x - x.min()) / (x.max() - x.min())),
        (scalers.StandardScore(), (x - x.mean()) / x.std(ddof=1)),
        (scalers.StandardScore(0), (x - x.mean()) / x.std()),
        (scalers.RobustScale(), (x - np.median(x)) / (np.quantile(x, 0.75) - np.quantile(x, 0.25))),
    ):
        assert np.allclose(apply(df, op.fit(df, "x")), want)


def test_unfitted_and_degenerate_scalers(spark):
    df = column(spark, [1.0, 2.0])
    assert apply(df, scalers.StandardScore()) == [1.0, 2.0] and apply(df, scalers.RobustScale()) == [1.0, 2.0]
    assert all(map(math.isnan, apply(df, scalers.MinMaxScale())))
    one = df.limit(1)
    assert math.isnan(apply(one, scalers.StandardScore().fit(one, "x"))[0])
    empty = df.where("false")
    assert apply(df, scalers.StandardScore().fit(empty, "x")) == [1.0, 2.0]


def test_stacked_equals_single(spark):
    x = np.random.default_rng(4).random((50, 2))
    df = column(spark, x.tolist(), "array<double>")
    op = scalers.Stacked([scalers.StandardScore(), scalers.StandardScore()]).fit(df, "x")
    assert np.allclose(apply(df, op), (x - x.mean(0)) / x.std(0, ddof=1))


def test_digest(spark):
    d = digest.sketch(column(spark, [-3.0, 8.0, 8.0, 8.0, 20.0]), "x")
    assert list(digest.quantile(d, [0, 0.5, 1])) == [-3, 8, 20]
    # between -3 and 8 the older reading falls from two values of five to one
    assert np.allclose(digest.cdf(d, [-1.9, 2.5, 8.0], compat=True), [0.38, 0.3, 0.2])
    one = digest.sketch(column(spark, [-7.5]), "x")
    assert list(digest.quantile(one, [0, 0.9, 1])) == [-7.5] * 3 and list(digest.cdf(one, [-8, -7.5, 0])) == [0, 0.5, 1]
    assert list(digest.cdf(digest.Digest.empty(), [4.0])) == [0]
    x = np.random.default_rng(5).random(2000)
    big = digest.merge([digest.add(digest.Digest.empty(), p, 100) for p in np.split(x, 4)], 100)
    p = np.linspace(0, 1, 101)
    assert len(big.means) <= 110 and np.abs(digest.cdf(big, np.quantile(x, p)) - p).max() < 1e-2
    shares = digest.cdf(big, np.linspace(-1, 2, 500))
    assert (np.diff(shares) >= 0).all()


def test_digest_compat_reads_weighted_centroids(spark):
    d = digest.Digest(np.array([1.0, 3.0, 7.0]), np.array([2.0, 4.0, 2.0]), 0.0, 9.0)
    assert np.allclose(digest.cdf(d, [-1, 0.5, 1, 1.5, 2, 3, 6, 7, 8, 10], compat=True), [0, 0, 0, 0.625, 0.5, 0.25, 0.8125, 1, 1, 1])
    assert np.allclose(digest.quantile(d, [0.1, 0.2, 0.25, 0.5, 0.625, 0.75, 1], compat=True), [0.8, 7, 3, 2, 1.5, 9, 9])
    same, one = digest.Digest(np.full(2, 3.0), np.ones(2), 3.0, 3.0), digest.Digest(np.array([2.0]), np.array([4.0]), 1.0, 5.0)
    assert list(digest.cdf(same, [2, 3, 4], compat=True)) == [0, 1, 1] and list(digest.cdf(one, [1, 2, 4, 5], compat=True)) == [0, 0.5, 0.5, 1]
    x = np.random.default_rng(6).permutation(3000) / 1.0
    df = column(spark, x.tolist())
    op = digest.TDigestDistribution(100.0, compat=True).fit(df, "x")
    m, w = op.digest.means, op.digest.weights
    assert w.max() > 1
    upto = np.cumsum(w)
    for v, y in zip(x, apply(df, op)):
        k = int((m < v).sum())
        inner = 0 if v <= m[0] else 1 if v >= m[-1] else (upto[k - 1] * (v - m[k - 1]) + upto[k] * (m[k] - v)) / (m[k] - m[k - 1]) / 3000
        assert abs(y - inner) < 1e-9


def test_compat_rank_covers_every_event(spark, tmp_path):
    x = np.random.default_rng(7).integers(0, 900, 2500) / 4.0
    rows = [(i, float(v)) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "event_id long, value double").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.y for r in catalogue.queries()["cdf_compat_rank"](spark, str(tmp_path)).collect()}
    want = {i: 0 if v <= x.min() else 1 if v >= x.max() else round((x < v).sum() / 2500, 6) for i, v in rows}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1.5e-6 for i in want)


def test_empirical_cdf(spark):
    out = scalers.empirical_cdf(column(spark, [3.0, 1.0, 1.0, 2.0, None]), "x").orderBy("i")
    assert values(out, "cdf") == [1.0, 0.5, 0.5, 0.75, None]


@pytest.mark.parametrize("ints", [False, True])
def test_lookups(spark, ints):
    kind = "long" if ints else "string"
    as_key = (lambda k: {"pine": 70, "oak": -5, "elm": 11, "fir": 8, "ash": 900, "yew": 1}[k]) if ints else str
    kinds = ("IntCountLookup", "IntRatioLookup", "IntIndexLookup") if ints else ("CountLookup", "RatioLookup", "IndexLookup")
    count, ratio, index = (getattr(lookups, k) for k in kinds)
    seen, probes = list(map(as_key, SEEN)), [as_key(k) for k in [*KEYS, "yew"]]
    counts = Counter(seen)
    order = sorted(counts, key=lambda k: (-counts[k], str(k)))
    df, probe = column(spark, seen, kind), column(spark, [*probes, None], kind)

    def over(least):
        return {k: n for k, n in counts.items() if n >= least}

    def ids(keys, padding=0, unknown=1):
        free = [i for i in range(len(keys) + 2) if i not in (padding, unknown)]
        return [dict(zip(keys, free)).get(k, unknown) for k in [*probes, None]]

    assert apply(probe, count().fit(df, "x")) == [counts[k] for k in probes] + [0]
    assert np.allclose(apply(probe, ratio().fit(df, "x")), [counts[k] / len(seen) for k in probes] + [0])
    assert np.allclose(apply(probe, ratio(lookups.MinThreshold(7)).fit(df, "x")), [over(7).get(k, 0) / sum(over(7).values()) for k in probes] + [0])
    op = index().fit(df, "x")
    assert apply(probe, op) == ids(order) and op.dictionary_size() == len(counts) + 2
    assert apply(probe, index(padding_idx=2, unknown_idx=4).fit(df, "x")) == ids(order, 2, 4)
    few = index(lookups.MinThreshold(5)).fit(df, "x")
    assert apply(probe, few) == ids([k for k in order if k in over(5)]) and few.dictionary_size() == len(over(5)) + 2
    empty = df.where("false")
    assert apply(probe, count().fit(empty, "x")) == [0] * 7 and index().fit(empty, "x").dictionary_size() == 2


def test_large_dictionaries_are_frozen_saved_and_loaded(spark, tmp_path):
    n = 120_000
    rows = spark.range(n).select(F.concat(F.lit("k"), F.col("id")).alias("k")).unionAll(spark.range(300).select(F.concat(F.lit("k"), F.col("id") * 7).alias("k")))
    rows.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    tree = lambda: Fan([Chain(Field(None, "k", STRING), lookups.IndexLookup()), Chain(Field(None, "k", STRING), lookups.CountLookup())], into=tuple)
    plan = FitPlan(tree())
    plan.fit(df)
    twice = sorted(f"k{i * 7}" for i in range(300))
    once = sorted({f"k{i}" for i in range(n)} - set(twice))
    want = {k: i for i, k in enumerate([*twice, *once], 2)}
    tables.save(spark, plan, str(tmp_path / "m"))
    spark.range(5).select(F.lit("new").alias("k")).write.mode("append").parquet(str(tmp_path / "rows"))
    again = tables.load(spark, FitPlan(tree()), str(tmp_path / "m"))
    for root in (plan.root, again.root):
        got = transform(df, root, "y").select("k", "y._1", "y._2").toPandas()
        assert list(got["_1"]) == [want[k] for k in got["k"]] and got["_2"].sum() == n + 900
        assert root[0][1].dictionary_size() == n + 2 and root[0][1].small is None


def test_many_keys_share_a_count(spark):
    keys = [f"{i * 7919 % 1000:03d}" for i in range(1000)]
    got = lookups.ranked(spark.createDataFrame([(k, 2 if k < "010" else 1) for k in keys], "key string, count long")).collect()
    assert sorted((r.rank, r.key) for r in got) == list(enumerate(sorted(keys), 1))


def test_ties_of_integers_go_by_text(spark):
    df = column(spark, [2, 10, 2, 10], "long")
    assert apply(df, lookups.IntIndexLookup().fit(df, "x")) == [3, 2, 3, 2]


def test_large_dictionary_is_joined(spark):
    df = column(spark, [f"k{i // 2}" for i in range(400)], "string")
    op = lookups.CountLookup().fit(df, "x")
    assert op.small is None and apply(df, op) == [2] * 400


def test_eliminators(spark):
    counts = {"red": 31, "tan": 4, "teal": 30, "gold": 31, "grey": 4}
    df = spark.createDataFrame(list(counts.items()), "key string, count long")
    keys = lambda e: sorted(r.key for r in e(df).collect())
    assert keys(lookups.MinThreshold(30)) == ["gold", "red", "teal"] and keys(lookups.MinThreshold(31)) == ["gold", "red"]
    assert keys(lookups.RatioThreshold(0.3)) == ["gold", "red", "teal"] and keys(lookups.RatioThreshold(0.31)) == ["gold", "red"]
    assert keys(lookups.TopK(1)) == ["gold"] and keys(lookups.TopK(4)) == ["gold", "grey", "red", "teal"] and keys(lookups.TopK(0)) == []
    with pytest.raises(ValueError):
        lookups.TopK(-1)


def test_ragged(spark):
    r = np.random.default_rng(12)
    rows = [r.integers(-50, 50, k).tolist() for k in (6, 0, 1, 2, 9, 0, 4)]
    df = column(spark, rows, "array<int>")
    assert apply(df, arrays.SparseLen()) == [len(v) for v in rows]
    assert apply(df, arrays.SparseTrunc(2)) == [v[:2] for v in rows]
    assert apply(df, arrays.SparseTruncPad(4, -1, "int")) == [(v + [-1] * 4)[:4] for v in rows]
    assert apply(df, arrays.SparseMapSequences(arrays.array_sum)) == [sum(v) for v in rows]
    at = arrays.sparse_indices(df, "i", "x", blocks=2).orderBy("i").collect()
    ends = np.cumsum([len(v) for v in rows]).tolist()
    assert [(q.begin, q.end) for q in at] == list(zip([0, *ends], ends))
    assert values(arrays.sparse_values(df, "i", "x").orderBy("i", "position"), "value") == [x for v in rows for x in v]


def test_batch_means_in_a_plan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0)], "g string, x double")
    tree = Chain(Field(None, "x", DOUBLE), scalers.MeanScale(batch="g"))
    FitPlan(tree).fit(df)
    assert (tree[1].mean, tree[1].delta) == (6.0, 9.0)
    alone = scalers.MeanScale(batch="g").fit(df, "x")
    assert (alone.mean, alone.delta) == (6.0, 9.0)


@pytest.mark.parametrize("most", [3, 20_000])
def test_exact_quantiles(spark, most):
    r = np.random.default_rng(13)
    for x in (r.normal(size=3001), r.integers(0, 3, 4000) / 1.0, np.full(700, 2.5), np.exp(40 * r.normal(size=2500)), r.random(1)):
        df = column(spark, [*x.tolist(), None])
        got = scalers.exact_quantiles(df, F.col("x"), [0.0, 0.25, 0.5, 0.9, 1.0], most, 50)
        assert np.allclose(got, np.quantile(x, [0.0, 0.25, 0.5, 0.9, 1.0]), rtol=1e-12)
    assert scalers.exact_quantiles(df.where("false"), F.col("x"), [0.5]) is None


def test_composition(spark):
    double, text = Function(lambda x: x * 2, (DOUBLE,), DOUBLE, "double"), Function(lambda x: x.cast("string"), (DOUBLE,), STRING, "text")
    chain = Chain(Identity(), double, double, text)
    assert len(chain) == 4 and chain[-1] is text and chain.takes == (DOUBLE,) and chain.gives == STRING
    with pytest.raises(IndexError):
        chain[9]
    with pytest.raises(TypeError):
        Chain(text, double)
    with pytest.raises(ValueError):
        Chain(Identity())
    with pytest.raises(ValueError):
        Chain(print)
    df = column(spark, [1.0, 2.0])
    assert apply(df, chain) == ["4.0", "8.0"]
    assert apply(df, Fan([double, Identity()])) == [[2.0, 1.0], [4.0, 2.0]]
    assert [r.asDict() for r in apply(df, Fan([double, text], ["a", "b"], dict))] == [{"a": 2.0, "b": "1.0"}, {"a": 4.0, "b": "2.0"}]
    assert [tuple(r) for r in apply(df, Fan([double, text], into=tuple))] == [(2.0, "1.0"), (4.0, "2.0")]
    record = dataclasses.make_dataclass("R", ["a", "b", "c"])
    three = [Function(lambda x, k=k: x * 0 + k) for k in (2, 3, 1)]
    assert apply(df, Fan(three, ["b", "c", "a"], record))[0].asDict() == {"a": 1, "b": 2, "c": 3}
    for bad in ({"names": ["a"]}, {"names": ["a", "a"], "into": dict}, {"into": dict}):
        with pytest.raises(ValueError):
            Fan([double, text], **bad)
    with pytest.raises(TypeError):
        Fan([double, text])
    add = Function(lambda a, b: a + b, (DOUBLE, DOUBLE), DOUBLE, "add")
    assert apply(df, Chain(Fan([double, Identity()], into=tuple), Spread(add))) == [3.0, 6.0]
    with pytest.raises(ValueError):
        scalars.CombineDicts(["a"], ["a"])


def chain_of(*ops):
    return Chain(*ops)


def test_plan_tables():
    est, plus = scalers.StandardScore, Function(lambda x: x + 1, (DOUBLE,), DOUBLE, "plus")
    total = Function(lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x), (None,), DOUBLE, "total")
    root = Chain(est(), Fan([Chain(plus, est(), plus, est()) for _ in range(3)]), total, est())
    plan = FitPlan(root)
    assert [s.paths for s in plan.stages] == [["0"], ["1.0.1", "1.1.1", "1.2.1"], ["1.0.3", "1.1.3", "1.2.3"], ["3"]]
    assert [s.mapping for s in plan.stages] == [[BYPASS], [0, 1, 2], [0, 1, 2], [ALL]]
    assert plan.dependencies["1.0.3"] == {"0", "1.0.1"} and plan.dependencies["0"] == set() and len(plan.dependencies["3"]) == 7


def test_plan_fit_save_load(spark, tmp_path):
    x = np.random.default_rng(6).random(60)
    df = column(spark, x.tolist())
    tree = lambda: Chain(Field(None, "x", DOUBLE), scalers.StandardScore(), scalars.Clamp(-1.0, 1.0), scalers.MinMaxScale())
    plan = FitPlan(tree())
    plan.fit(df)
    z = np.clip((x - x.mean()) / x.std(ddof=1), -1, 1)
    assert np.allclose(values(transform(df, plan.root, "y").orderBy("i")), (z - z.min()) / (z.max() - z.min()))
    tables.save(spark, plan, str(tmp_path / "m"))
    again = tables.load(spark, FitPlan(tree()), str(tmp_path / "m"))
    assert values(transform(df, again.root, "y").orderBy("i")) == values(transform(df, plan.root, "y").orderBy("i"))


def test_two_dictionaries_share_a_pass(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "k string, n long")
    root = Fan([Chain(Field(None, "k", STRING), lookups.CountLookup()), Chain(Field(None, "k", STRING), lookups.IndexLookup()), Chain(Field(None, "n", LONG), lookups.IntCountLookup())])
    FitPlan(root).fit(df)
    assert sorted(map(tuple, values(transform(df, root, "y")))) == [(1, 3, 2), (2, 2, 1), (2, 2, 2)]


def test_running_moments(spark):
    x = np.random.default_rng(8).random(90)
    run = RunningMoments("x")
    for i, part in enumerate(np.split(x, 3)):
        run.update(column(spark, part.tolist()), i)
        run.update(column(spark, part.tolist()), i)
    op = run.standard_score()
    assert np.isclose(op.mean, x.mean()) and np.isclose(op.std, x.std(ddof=1)) and run.min_max().low == x.min()


def test_running_moments_go_on_after_a_restart(spark, tmp_path):
    x = np.random.default_rng(9).normal(3, 2, 60)
    path = str(tmp_path / "moments")
    for i, part in enumerate(np.split(x, 3)):
        run = RunningMoments("x", path)
        run.update(column(spark, part.tolist()), i)
    again = RunningMoments("x", path)
    again.update(column(spark, [1e9]), 2)
    op = again.standard_score()
    assert again.last == 2 and np.isclose(op.mean, x.mean()) and np.isclose(op.std, x.std(ddof=1))


def test_stack_and_rows(spark):
    df = spark.createDataFrame([(1, 1.0, 4.0), (2, 2.0, 5.0)], "k int, a double, b double")
    out = scalars.stack_long(df, "k", ["a", "b"]).orderBy("position", "k").collect()
    assert [(r.position, r.k, r.value) for r in out] == [(0, 1, 1.0), (0, 2, 2.0), (1, 1, 4.0), (1, 2, 5.0)]
    both = scalars.cat_rows(df.select("a"), df.select(F.col("b").alias("a")))
    assert sorted(r.a for r in both.collect()) == [1.0, 2.0, 4.0, 5.0]
    with pytest.raises(Exception):
        transform(df, Chain(Fan([Field(None, "a", DOUBLE)]), scalars.SplitToDict(["x", "y"])), "s").collect()


def test_digest_tails_in_the_older_reading():
    x = np.concatenate([np.random.default_rng(21).normal(10, 1, 5000), [-90.0, 300.0]])
    d = digest.merge([digest.add(digest.Digest.empty(), p, 6.0) for p in np.split(x, 2)], 6.0)
    assert len(d.means) <= 6 and d.weights.max() > 100
    assert list(digest.cdf(d, [-91, -90, -50, 200, 300, 301], compat=True)) == [0, 0, 0, 1, 1, 1]
    assert list(digest.cdf(d, [-91, 301])) == [0, 1]


def test_compat_ranks_equal_the_sketch_of_single_values(spark, tmp_path):
    r = np.random.default_rng(4)
    for xs in ([*r.integers(-40, 40, 300) / 4, NAN, None, -0.0, 0.0], [2.5, 2.5, None], [7.0], [None, NAN]):
        df = column(spark, [None if x is None else float(x) for x in xs])
        op = digest.TDigestDistribution(1000.0, compat=True).fit(df, "x")
        want = {q.i: q.y for q in df.select("i", op(F.col("x")).alias("y")).collect()}
        got = {q.i: q.y for q in digest.compat_ranks(df, "x", "y").collect()}
        assert got.keys() == want.keys()
        assert all((got[i] is None) == (y is None) and (y is None or np.isclose(got[i], y, equal_nan=True)) for i, y in want.items()), xs


def test_compat_rank_has_no_python_worker(spark, tmp_path):
    """The sketch of single values was held whole by the driver, by a task that merged it and by each worker that read it."""
    column(spark, [3.0, 1.0, 2.0]).select(F.col("i").cast("long").alias("event_id"), F.col("x").alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    plan = catalogue.queries()["cdf_compat_rank"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "Arrow"))

"""Corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and extra columns, against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import fingerprints, language_id, line_dedup, mixing, near_dedup, packing, quality, substring_dedup, suffixes, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, v long, n string"


def words(seed, n, vocabulary=300):
    r = np.random.default_rng(seed)
    return " ".join(f"w{k}x" for k in r.integers(0, vocabulary, n))


def corpus():
    a, b, passage = words(1, 120), words(2, 90), words(3, 40, 10_000)
    texts = [
        a, a, a + " tail", None, "", " \t\n ", "One", "two words", b + "\n" + passage + "\n" + words(4, 30), passage + "\n" + b.upper() + "\n" + words(5, 50),
        "Élan café   x", "Élan café x", "ab" * 400, words(6, 4000), words(7, 10) + "\n" + words(7, 10), words(6, 3900) + " q", "中文 \U0001f600",
    ]
    rows = [(i, t, "en" if i % 2 else None, [None, "s1", "s2"][i % 3], len(t or ""), 1, 2, "x") for i, t in enumerate(texts)]
    return rows + [rows[8], (None, a, None, None, 1, 1, 1, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_mixing(docs, empty):
    got = rows(mixing.copies(docs))
    assert len(got) == len(corpus()) and mixing.copies(empty).count() == 0
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        by.setdefault(r["source"], []).append(r)
    size = {s: sum(r["size"] for r in g) for s, g in by.items()}
    weight = {"s1": 1.0, "s2": 2.0, None: 3.0}
    want, capped = {}, set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        free = [s for s in size if s not in capped]
        want = {s: 3.0 * size[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in size}
        over = {s for s in free if want[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    for s, g in by.items():
        assert abs(g[0]["target"] - want[s]) < 1e-6
        assert abs(sum(r["taken"] for r in g) - want[s]) <= max(r["size"] for r in g)
    again = sorted((r["doc_id"] or -1, r["taken"]) for r in rows(mixing.copies(docs.repartition(5))))
    assert again == sorted((r["doc_id"] or -1, r["taken"]) for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)


def test_line_dedup(docs, empty):
    got = line_dedup.dedup_lines(docs.select("doc_id", "text")).collect()
    assert line_dedup.dedup_lines(empty.select("doc_id", "text")).count() == 0
    seen = []
    for i, t in sorted({(-1 if r[0] is None else r[0], r[1]) for r in corpus() if r[1] is not None}, key=lambda p: p[0]):
        kept, gone = [], 0
        for line in t.split("\n"):
            s = set(line.split(" ")) - {""} if line.strip() else set()
            like = len(s) >= 5 and any(len(s & o) * 100 >= 80 * len(s | o) for o in seen)
            gone += like
            kept += [] if like else [line]
            if len(s) >= 5:
                seen.append(s)
        for r in got:
            if (-1 if r.doc_id is None else r.doc_id) == i:
                assert (r.n_removed, r.text) == (gone, "\n".join(kept) if gone else t)
    assert line_dedup.keep_lines(docs).columns == docs.columns


def test_line_dedup_takes_short_lines(spark):
    texts = ["Les.\na b c d\n\nx y", "a b c d e\nLes.\n \t\ny  x\nx y z", "b a b a b a\nx\n\nlong long", "a b b a\n x\nLes\nlong", None, "", "Les.\nx y"]
    got = line_dedup.keep_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    seen, want = [], {}
    for i, t in enumerate(texts):
        kept = []
        for line in (t or "").split("\n"):
            s = set(line.split())
            if not any(len(s & o) * 100 >= 80 * len(s | o) for o in seen if s):
                kept.append(line)
            seen += [s] if s else []
        if kept:
            want[i] = t if t is None else "\n".join(kept)
    assert 6 not in want and want[1] == " \t\nx y z" and {r.doc_id: r.text for r in got.collect()} == want


def test_language(spark, docs, empty):
    train = spark.createDataFrame([("de", "der hund und die katze"), ("en", "the dog and the cat")] * 5, "lang string, text string")
    model = language_id.fit(train)
    probe = spark.createDataFrame([(1, "die Katze"), (2, "the cats"), (3, None), (4, "123 !"), (5, ""), (6, "hundd " * 9000)], "doc_id int, text string")
    out = {r.doc_id: r._p for r in language_id.predict(spark, probe, model).collect()}
    assert [out[k].lang_pred for k in range(1, 7)] == ["de", "en", "und", "und", "und", "de"] and all(0 <= p.score <= 1 for p in out.values())
    none = language_id.fit(empty)
    assert {r._p.lang_pred for r in language_id.predict(spark, probe, none).collect()} == {"und"}
    assert language_id.keep_identified(docs, model).columns == docs.columns


def test_language_bound_leaves_places_to_rare_languages(spark):
    train = spark.createDataFrame([("de", "eins zwei drei vier")] * 20 + [("fi", "yksi yksi kaksi")], "lang string, text string")
    assert set(language_id.fit(train, max_words=4).words) == {"drei", "yksi", "eins", "kaksi"}
    assert set(language_id.fit(train, max_words=5).words) == {"drei", "yksi", "eins", "kaksi", "vier"}


def test_top_k(spark):
    r = np.random.default_rng(1)
    vs = [(int(i), [float(x) for x in r.normal(size=8) * (1 + 5 * (i % 3))], "x") for i in range(90)]
    vs += [(200 + i, vs[5][1], "x") for i in range(30)] + [(300, None, "x"), (301, [1.0, None] * 4, "x"), (302, [float("nan")] * 8, "x"), (320, [0.0] * 8, "x"), (340, [1.0] * 3, "x"), vs[20], (None, vs[1][1], "x")]
    got = rows(topk.top_k(spark.createDataFrame(vs, "vec_id long, embedding array<float>, rank string"), F.col("vec_id") % 20 == 0, 5))
    x = {i: np.floor(64 * np.array(v, np.float32).astype(float)) for i, v, _ in vs if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in x if i % 20 == 0):
        best = sorted((-int(x[q] @ x[p]), p) for p in x if p != q and len(x[p]) == len(x[q]))[:5]
        want += [(q, k + 1, p, -s) for k, (s, p) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_coordinate_pruning_loses_nothing():
    r = np.random.default_rng(2)
    base = r.normal(size=16)
    p = np.floor(64 * (base + 0.1 * r.normal(size=(3000, 16))))
    q = np.floor(64 * np.stack([base, -base, r.normal(size=16)]))
    for b, v in zip(topk.search(q, np.array([-1, -2, -3]), np.full(3, -np.inf), p, np.arange(3000), 20), q):
        assert b.ids.tolist() == [i for _, i in sorted((-(p[i] @ v), i) for i in range(3000))[:20]]


def test_fingerprints(docs, empty):
    got = fingerprints.checked(docs.select("doc_id", "text")).collect()
    assert len(got) == len(corpus()) and fingerprints.checked(empty.select("doc_id", "text")).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[0].f == by[1].f != by[2].f and by[10].f == by[11].f and by[3].f == by[4].f == by[5].f
    texts = {r[0]: r[1] or "" for r in corpus() if r[0] is not None}
    for i in (0, 2, 6, 13):
        after = texts[i - 1] if i else corpus()[-1][1]
        t, half = texts[i], len(texts[i]) // 2
        assert by[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest() and by[i].n_chars == len(t)
    assert by[1].near_next == 1.0 and by[2].near_next == 0.0


def test_packing(docs, empty):
    got = rows(packing.pack(packing.materialize(packing.pieces(docs, 64, packing.default_tokenizer())), 64, bucket_items=40, fan_in=2, carry=8))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for r in corpus():
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r[0] if r[0] is not None else -1, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 64))]
    key = lambda r: (-1 if r["doc_id"] is None or r["doc_id"] != r["doc_id"] else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got)) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) <= 1.05 * sum(w[3] for w in want) / 64 + 2
    assert packing.best_fit_packing(empty).count() == 0


def test_toxicity():
    texts = [f"{words(i, 30)} {'idiot' if i % 3 == 0 else 'trash can' if i % 3 == 1 else ''} end" for i in range(90)] + ["trash talk here"] * 5
    y = np.array([float(i % 3 == 0) for i in range(90)] + [1.0] * 5)
    lexicon = toxicity.learn(texts, y)
    table, a = toxicity.folding_table(), toxicity.automaton(lexicon.terms, lexicon.exceptions)
    p = lambda t: float(1 / (1 + np.exp(-toxicity.features(*toxicity.evidence(t, table, a)) @ lexicon.curve)))
    assert p("you іd1оt there") > 0.7 > p("good day to you") and p(None) == p("") < 0.7


def test_near_dedup(docs, empty):
    got = rows(near_dedup.link(docs.select("doc_id", "text"), 2))
    sets = {}
    for r in got:
        t = next(x[1] for x in corpus() if x[0] == r["doc_id"])
        w = (t or "").encode().lower().split()
        sets[r["doc_id"]] = frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])
        assert r["n_shingles"] == len(sets[r["doc_id"]])
    group = {i: {i} for i in sets}
    for i in sets:
        for j in sets:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] is not group[j]:
                group[i] |= group[j]
                for k in group[j]:
                    group[k] = group[i]
    for r in got:
        assert r["component_id"] == min((k for k in group[r["doc_id"]] if k is not None), default=None)
    assert near_dedup.link(empty.select("doc_id", "text")).count() == 0
    assert near_dedup.keep_one(docs).columns == docs.columns


def test_near_dedup_pairs_of_keys(docs, monkeypatch):
    by = lambda: {(r["doc_id"], r["th"]): r["component_id"] for r in rows(near_dedup.link(docs.select("doc_id", "text"), 2))}
    want = by()
    monkeypatch.setattr(near_dedup, "DIRECT", 0)
    monkeypatch.setattr(near_dedup, "PIVOTS", (2,))
    assert by() == want


def test_images_rule_out_nothing_similar():
    rng = np.random.default_rng(3)
    for n in (1, 5, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - n // 10], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
        differ = sum(bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") for x, y in zip(near_dedup.image(a), near_dedup.image(b)))
        assert differ <= len(np.setxor1d(a, b))


def test_substring_dedup(docs, empty):
    got = rows(substring_dedup.remove_repeats(docs, 100, bucket=900))
    seen, want = set(), []
    for _, t in sorted(((-1 if r[0] is None else r[0], r[1]) for r in corpus()), key=lambda p: p[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        want.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(want)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_two_stage_sort():
    for seed in range(20):
        r = np.random.default_rng(seed)
        t = r.integers(97, 97 + 1 + seed % 4, 300).astype(np.uint8)
        wanted = r.random(300) < 0.7
        order = suffixes.suffix_order(t, wanted, 400)
        assert order.tolist() == sorted(np.flatnonzero(wanted).tolist(), key=lambda k: bytes(t[k:]))
        same = suffixes.agree(t, order, 9)
        assert all(same[i] == (bytes(t[order[i] : order[i] + 9]) == bytes(t[order[i - 1] : order[i - 1] + 9]) and max(order[i], order[i - 1]) + 9 <= 300) for i in range(1, len(order)))


def test_quality(spark):
    texts = [words(i, 60) for i in range(60)] + ["!! ".join(words(i, 60).upper().split()) for i in range(60)]
    net = quality.Net().fit(texts, np.array([1.0] * 60 + [0.0] * 60), epochs=6)
    s = net.state()
    assert quality.probability(words(900, 3000), s) > 0.5 > quality.probability("!! ".join(words(901, 90).upper().split()), s)
    assert 0 <= quality.probability(None, s) == quality.probability("", s) <= 1
    raw = quality.codes(words(5, 700))
    whole = quality.pair_tables(net.taps)
    got = quality.chunk_maxima(raw, *whole)
    for k, at in enumerate(quality.chunk_starts(len(raw))):
        own = quality.chunk_maxima(raw[at : at + quality.CHUNK], *whole)[0]
        assert np.allclose(got[k], own)
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id int, text string")
    assert [r.score for r in quality.score(spark, df, None).collect()] == [0.5] * 3


def test_quality_learns_from_all_of_a_text():
    def text(seed, poor):
        t = words(seed, 1300)[:5000]
        return t[:300] + "!! ".join(t[300:1000].upper().split())[:600] + t[900:] if poor else t

    s = quality.Net().fit([text(k, k % 2) for k in range(80)], np.array([1.0 - k % 2 for k in range(80)]), batch=8).state()
    assert all((quality.probability(text(k, k % 2), s) < 0.5) == (k % 2 == 1) for k in range(900, 920))


def test_pipeline(spark, docs):
    import corpus_pipeline

    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, corpus_pipeline.materialize(stage(spark, out, ""))
        if name != "packing":
            assert out.columns == docs.columns
    assert "sequence_id" in out.columns and before.count() > 0


def test_pipeline_stages_keep_the_right_rows(spark):
    import collections

    import corpus_pipeline
    from tokenizers import Tokenizer

    base = words(50, 120, 10_000).split()
    broken = lambda ws, n: "\n".join(" ".join(ws[i : i + n]) for i in range(0, len(ws), n))
    changed = lambda at: [f"other{i}y" if i in at else w for i, w in enumerate(base)]
    texts = [broken(base, 12), broken(changed({60}), 17), broken(changed({15, 45, 75, 105}), 23), words(51, 40) + "\nLes.\n" + words(52, 40), "Les.\n\n" + words(53, 30), "Les.", None, "123 !"]
    docs = spark.createDataFrame([(i, t, "en", ["s1", "s2"][i % 2], len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        if name == "packing":
            mixed = docs
        if name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in rows(mixing.copies(docs))}
        docs = corpus_pipeline.materialize(stage(spark, docs, ""))
        out[name] = rows(docs)
    assert sorted(r["doc_id"] for r in out["language_id"]) == [0, 1, 2, 3, 4, 5]
    seen, want = [], {}
    for i, t in enumerate(texts[:6]):
        kept = []
        for line in t.split("\n"):
            s = set(line.split())
            if not s or not any(len(s & o) * 100 >= 80 * len(s | o) for o in seen):
                kept.append(line)
            seen += [s] if s else []
        if kept:
            want[i] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in out["line_dedup"]} == want and all(r["n_chars"] == len(r["text"]) for r in out["line_dedup"])
    assert list(want) == [0, 1, 2, 3, 4] and want[4].startswith("\n")
    shingles = {i: set(zip(*[t.lower().split()[k:] for k in range(5)])) for i, t in want.items()}
    like = lambda i, j: 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j])
    assert sorted(r["doc_id"] for r in out["near_dedup"]) == [i for i in want if not any(like(i, j) for j in want if j < i)] == [0, 2, 3, 4]
    assert collections.Counter(r["doc_id"] for r in out["mixing"]) == {i: n for i, n in copies.items() if n}
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    lengths = [(r["doc_id"], len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1) for r in rows(mixed)]
    assert sorted((r["doc_id"], r["length"]) for r in out["packing"]) == sorted(lengths)

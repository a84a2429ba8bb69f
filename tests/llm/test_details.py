"""Parts of the corpus operators against plain versions of themselves: borders of pieces, large groups, clashing names, empty tables."""

import gc
import hashlib
import math
import os
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import fingerprints, language_id, line_dedup, mixing, near_dedup, packing, quality, topk, toxicity
from tidewell.llm.common import id_mod, materialize, relieve


def words(seed, n, vocabulary=300):
    r = np.random.default_rng(seed)
    return " ".join(f"w{k}x" for k in r.integers(0, vocabulary, n))


def test_held_out_rule(spark):
    ids = [0, 1, 7, 12345678901, -4, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(id_mod(F.col("doc_id"), 3).alias("m")).collect()
    assert [r.m for r in got] == [None if i is None else zlib.crc32(str(i).encode()) % 3 for i in ids]


# toxicity


def naive_evidence(text, table, terms, exceptions):
    """Every start against every term, over the whole folded text."""
    s = toxicity.fold(text or "", table)
    spared = [(m.start(), m.start() + len(e) - 1) for e in exceptions for m in re.finditer(f"(?={re.escape(e)})", s)]
    total = 0.0
    for k in range(len(s)):
        best = max((w for t, w in terms.items() if s.startswith(t, k)), default=0.0)
        total += 0.0 if any(a <= k < b for a, b in spared) else best
    return total, len(s.split())


@pytest.mark.parametrize("piece", [1, 7, 30, 1 << 20])
def test_toxicity_pieces_change_nothing(monkeypatch, piece):
    terms, exceptions = {" trash ": 1.0, " tras": 0.4, " idiot": 2.0, " can ": 0.3}, {" trash can ": True, " village idiot": True, " trash talk ": True}
    table, a = toxicity.folding_table(), toxicity.automaton(terms, exceptions)
    monkeypatch.setattr(toxicity, "PIECE", piece)
    r = np.random.default_rng(4)
    pool = ["trash", "can", "idiot", "id1ots", "village", "the", "trash-can", "talk", "a", "tra$h,", "中文", "x" * 40]
    for _ in range(150):
        text = str(r.choice(["", " ", "!"])) + str(r.choice([" ", "  ", "\n", "."])).join(r.choice(pool, r.integers(0, 12)))
        got, want = toxicity.evidence(text, table, a), naive_evidence(text, table, terms, exceptions)
        assert math.isclose(got[0], want[0], abs_tol=1e-9) and got[1] == want[1], text
    assert toxicity.evidence(None, table, a) == (0.0, 0)


def labelled(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("op, label, limit", [(toxicity, "toxic", 0.7), (quality, "quality", 0.5)])
def test_fitted_queries(spark, tmp_path, op, label, limit):
    marked = lambda i: i % 3 == 0
    text = lambda i: words(i, 40) + (" you idiot " if marked(i) else " good day ") * 3 + ("!! ZZ %% " * 12 if marked(i) else "")
    docs = [(i, text(i), "x") for i in range(150)] + [(3, text(3), "x"), (500, None, "x"), (501, "", "x"), (None, "you idiot", "x")]
    labels = [(i, int(not marked(i)), int(marked(i))) for i in range(150)] + [(0, None, None), (None, 1, 1), (7, 1, 0)]
    got = op.query(spark, labelled(spark, tmp_path, docs, labels)).collect()
    assert len(got) == len(docs) and {"doc_id", "held_out", "score", "predicted"} <= set(got[0].asDict())
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 150]
    right = sum(r.predicted == (int(marked(r.doc_id)) if label == "toxic" else int(not marked(r.doc_id))) for r in held)
    assert len(held) > 30 and right >= 0.95 * len(held)
    by = {r.doc_id: r.score for r in got}
    assert by[500] == by[501]
    none = op.query(spark, labelled(spark, tmp_path / "none", [], []))
    assert none.count() == 0


def test_quality_responses_by_hand():
    net = quality.Net(3)
    raw = quality.codes(words(8, 260))
    got = quality.chunk_maxima(raw, *quality.pair_tables(net.taps))
    for k, at in enumerate(quality.chunk_starts(len(raw))):
        chunk = raw[at : at + quality.CHUNK]
        want = [sum(net.taps[j][chunk[i + j]] for j in range(quality.WIDTH)) for i in range(len(chunk) - quality.WIDTH + 1)]
        assert np.allclose(got[k], np.max(want, 0), atol=1e-5)


# language


def test_letters_are_letters():
    assert language_id.letters("½ ² ① Ⅷ 12 _") == [] and language_id.letters("Ab½cd x² Çé中") == ["ab", "cd", "x", "çé中"]


def test_language_scores_by_hand(spark):
    train = [("de", "der hund und die katze laufen"), ("en", "the dog and the cat are running"), ("fr", "le chien et le chat")] * 3
    model = language_id.fit(spark.createDataFrame(train, "lang string, text string"))
    counts = {lang: Counter(w for k, t in train if k == lang for w in t.split()) for lang in ("de", "en", "fr")}
    grams = {lang: Counter() for lang in counts}
    for lang, c in counts.items():
        for w, n in c.items():
            p = f"\x02{w}\x03"
            for g in [*w, *[p[i : i + 2] for i in range(len(p) - 1)], *[p[i : i + 3] for i in range(len(p) - 2)]]:
                grams[lang][g] += n
    vocabulary = set().union(*counts.values())
    known = set().union(*grams.values())
    tokens = {k: 1 + sum(c.values()) for k, c in counts.items()}

    def log_of_gram(g, lang):
        same = [h for h in known if len(h) == len(g)]
        return math.log((grams[lang][g] + 0.5) / (sum(grams[lang][h] for h in same) + 0.5 * len(same)))

    def log_of_word(w, lang):
        if w in vocabulary:
            return math.log((counts[lang][w] + 0.5) / (tokens[lang] + 0.5 * len(vocabulary) + 1))
        p = f"\x02{w}\x03"
        found = [next((g for g in (p[i : i + 3], p[i + 1 : i + 3], p[i + 1]) if g in known), None) for i in range(len(w))]
        found = [g for g in found if g]
        return sum(log_of_gram(g, lang) for g in found) / len(found) if found else 0.0

    score = language_id.Scorer(model.state())
    texts = ["die katze", "hunde laufen", "chats", "runs qqq", "xyz", "the chien und", "zz " * 50]
    for text, (lang, p) in zip(texts, score(texts)):
        total = {k: math.log(tokens[k] / sum(tokens.values())) + sum(log_of_word(w, k) for w in text.split()) for k in counts}
        top = max(total.values())
        assert math.isclose(p, 1 / sum(math.exp(v - top) for v in total.values()), rel_tol=1e-3) and total[lang] > top - 1e-4


def test_language_parts_change_nothing(spark, monkeypatch):
    train = [("de", words(1, 200, 80).replace("x", "ung")), ("en", words(2, 200, 80).replace("x", "ing"))]
    model = language_id.fit(spark.createDataFrame(train, "lang string, text string"))
    texts = [words(k, 300, 500).replace("x", "ing" if k % 2 else "ung") for k in range(8)] + [None, "", "1 2"]
    want = language_id.Scorer(model.state())(texts)
    monkeypatch.setattr(language_id, "PART", 7)
    monkeypatch.setattr(language_id, "PARTS", 20)
    monkeypatch.setattr(language_id, "MEMO", 25)
    got = language_id.Scorer(model.state())(texts)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-6)
    assert want[-3:] == [("und", 0.0)] * 3


# fingerprints


def test_next_documents_of_null_ids(spark):
    rows = [(None, f"text {k}") for k in range(40)] + [(i, f"number {i}") for i in (3, 9, -5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = sorted(docs.withColumn("h", F.xxhash64("text")).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -r.h))
    want = set()
    for r, after in zip(order, order[1:] + order[:1]):
        half = len(r.text) // 2
        want.add((r.doc_id, hashlib.sha256((r.text[: len(r.text) - half] + after.text[:half]).encode()).hexdigest()))
    assert {(r.doc_id, r.edited_sha256) for r in fingerprints.checked(docs).collect()} == want


# lines


@pytest.mark.parametrize("group, few", [(2, 0), (2, 30), (3, 120), (64, 1 << 22)])
def test_lines_in_large_groups(spark, monkeypatch, group, few):
    """Families of near-copies of lines, mixed with lines that share their rare words only."""
    monkeypatch.setattr(line_dedup, "GROUP", group)
    monkeypatch.setattr(line_dedup, "DIRECT", few)
    r = np.random.default_rng(group)
    lines = []
    for _ in range(3):
        base = [f"b{k}q" for k in r.integers(0, 60, 14)]
        for _ in range(15):
            s = list(base)
            for at in r.integers(0, len(s), r.integers(0, 4)):
                s[at] = f"b{r.integers(0, 60)}q"
            lines.append(" ".join(s))
        lines += [" ".join([*base[:4], *[f"b{k}q" for k in r.integers(0, 60, 8)]]) for _ in range(8)]
    r.shuffle(lines)
    docs = [(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(-(-len(lines) // 4))]
    seen, want = [], {}
    for i, t in docs:
        kept = []
        for line in t.split("\n"):
            s = set(line.split())
            if not any(len(s & o) * 100 >= 80 * len(s | o) for o in seen):
                kept.append(line)
            seen.append(s)
        want[i] = "\n".join(kept)
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 80, 1)
    assert {q.doc_id: q.text for q in got.collect()} == want


# columns that clash, names with a dot


def test_stages_keep_clashing_columns(spark):
    names = ["doc_id", "text", "lang", "source", "row", "n_removed", "n_lines", "_p", "_d", "_h", "h", "a.b", "found", "score", "copies", "times", "i", "gone"]
    rows = [(i, words(i, 30) + "\nLes.", "en", f"s{i % 2}", *[f"{n}{i}" for n in names[4:]]) for i in range(6)]
    rows.append((9, rows[0][1] + " tail", "en", "s1", *[f"{n}9" for n in names[4:]]))
    schema = ", ".join([f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names])
    docs = spark.createDataFrame(rows, schema).repartition(2)
    model = language_id.fit(docs.select("lang", "text"))
    stages = {"language": lambda d: language_id.keep_identified(d, model, 0.0), "lines": line_dedup.keep_lines, "near": near_dedup.keep_one, "mix": mixing.mix}
    for name, stage in stages.items():
        out = stage(docs)
        assert out.columns == names, name
        got = out.collect()
        assert got and all(q[k] == f"{n}{q[0]}" for q in got for k, n in enumerate(names) if k >= 4), name
    assert stages["near"](docs).count() == 6


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors, F.col("vec_id") % 20 == 0).count() == 0
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""))
    assert docs.count() == 0 and "sequence_id" in docs.columns


# packing


def test_encoder_equals_the_tokenizer():
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        encode = packing.Encoder(f.read())
    r = np.random.default_rng(9)
    parts = [*"ab1 '.,!\n\t\r", " ", " ", "'s", "'ll", "é", "中", " ", "\x1c", "\x85", " ", "１", "  ", " \n", "<|endoftext|>", "😀", "́", "word", "Word,", "\r\n"]
    texts = ["".join(r.choice(parts, r.integers(0, 14))) for _ in range(4000)] + ["", "x" * 5000, words(3, 3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in encode.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert encode(texts) == want and encode(texts[::-1]) == want[::-1]


def test_lines_in_slices(spark, monkeypatch):
    """Slices of keys find what one shuffle finds, whatever a slice holds, and each is written by itself."""
    r = np.random.default_rng(5)
    bases = [[f"w{k}" for k in r.integers(0, 90, 18)] for _ in range(12)]
    lines = [" ".join(w if r.random() > 0.06 else f"w{r.integers(0, 90)}" for w in bases[i % 12]) for i in range(160)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(40)], "doc_id long, text string").repartition(3)
    seen, want = [], 0
    for line in lines:
        s = set(line.split())
        want += any(len(s & o) * 100 >= 80 * len(s | o) for o in seen)
        seen.append(s)
    monkeypatch.setattr(line_dedup, "GROUP", 6)
    monkeypatch.setattr(line_dedup, "DIRECT", 40)
    monkeypatch.setattr(line_dedup, "SLICE", 300)
    monkeypatch.setattr(line_dedup, "SLICES", 2)
    parts, write = [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda *p: parts.append(len(p)) or write(*p))
    assert line_dedup.dedup_lines(docs, 80, 1).agg(F.sum("n_removed")).first()[0] == want > 0
    assert max(parts) == line_dedup.SLICES


def test_sieve_keeps_every_key_and_little_else(spark):
    keys = spark.range(0, 3000, 3)
    left = {r.id for r in line_dedup.among(spark.range(3000), keys).collect()}
    assert set(range(0, 3000, 3)) <= left and len(left) < 1100
    assert line_dedup.among(spark.range(3000), keys.limit(0)).count() == 0


def test_sieve_grows_with_its_keys(spark, monkeypatch):
    """More keys than the least sieve can tell apart: it is made wider, up to WIDEST, and not given up."""
    monkeypatch.setattr(line_dedup, "SIEVE", 256)
    keys = spark.range(0, 9000, 3)
    left = {r.id for r in line_dedup.among(spark.range(9000), keys).collect()}
    assert set(range(0, 9000, 3)) <= left and len(left) < 5400


def test_sets_that_come_once_are_not_shuffled(spark, monkeypatch):
    """Of the lines only those whose set comes again, and few more, are joined to find the first of their set."""
    docs = [(d, "\n".join(words(40 * d + k, 12) if k else "one line that all of the documents have" for k in range(20))) for d in range(40)]
    df, rows, cut = spark.createDataFrame(docs, "doc_id long, text string"), [], line_dedup.sliced

    def told(df, k, key="w"):
        if key == "s1" and "prefix" in df.columns:
            rows.append(df.count())
        return cut(df, k, key)

    monkeypatch.setattr(line_dedup, "sliced", told)
    assert line_dedup.dedup_lines(df, 80, 1).agg(F.sum("n_removed")).first()[0] >= 39
    assert len(rows) == 1 and 40 <= rows[0] < 100


def test_plans_of_lines_hold_no_tables_as_text(spark):
    docs = spark.createDataFrame([(i, words(i, 30)) for i in range(20)], "doc_id long, text string")
    for df in (line_dedup.sets(docs, 80), line_dedup.among(spark.range(30), spark.range(3))):
        plan = df._jdf.queryExecution()
        assert len(plan.toString()) < 50_000
        assert "AS classes" not in plan.executedPlan().toString()  # else each line's row would carry the whole table


def test_lines_leave_one_table_and_need_no_sieve(spark, monkeypatch):
    """What is written on the way goes before the texts are joined; sieves that are too full change nothing."""
    import os

    from tidewell.sources.store import shared_folder

    r = np.random.default_rng(8)
    bases = [[f"w{k}" for k in r.integers(0, 60, 16)] for _ in range(8)]
    lines = [" ".join(w if r.random() > 0.07 else f"w{r.integers(0, 60)}" for w in bases[i % 8]) for i in range(120)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(30)], "doc_id long, text string").repartition(3)
    seen, want = [], 0
    for line in lines:
        s = set(line.split())
        want += any(len(s & o) * 100 >= 80 * len(s | o) for o in seen)
        seen.append(s)
    monkeypatch.setattr(line_dedup, "GROUP", 6)
    monkeypatch.setattr(line_dedup, "SIEVE", 8)
    tables = lambda: {x for x in os.listdir(shared_folder(spark).removeprefix("file:")) if x.startswith("tidewell-")}
    before = tables()
    out = line_dedup.dedup_lines(docs, 80, 1)
    assert len(tables() - before) == 1
    assert out.agg(F.sum("n_removed")).first()[0] == want > 0


def test_lines_of_large_groups_are_compared_with_earlier_ones_only(spark, monkeypatch):
    """Near misses of a large group's first line: an open line is compared with what is earlier, not with what is later."""
    r = np.random.default_rng(3)
    base = [f"w{k}" for k in range(26)]
    lines = [" ".join([*base[:3], *[w if r.random() > 0.07 else f"x{r.integers(0, 400)}" for w in base[3:]]]) for _ in range(120)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(30)], "doc_id long, text string").repartition(3)
    seen, want = [], 0
    for line in lines:
        s = set(line.split())
        want += any(len(s & o) * 100 >= 80 * len(s | o) for o in seen)
        seen.append(s)
    monkeypatch.setattr(line_dedup, "GROUP", 6)
    asked, verify = [], line_dedup.verified

    def told(docs, firsts, pairs, percent):
        a, b = (firsts.select(F.col("id").alias(x), F.col("o").alias(f"o_{x}")) for x in "ab")
        asked.append(pairs.join(a, "a").join(b, "b").select((F.col("o_b") < F.col("o_a")).alias("earlier")).collect())
        return verify(docs, firsts, pairs, percent)

    monkeypatch.setattr(line_dedup, "verified", told)
    assert line_dedup.dedup_lines(docs, 80, 1).agg(F.sum("n_removed")).first()[0] == want > 0
    assert len(asked) == 2 and asked[1] and all(q.earlier for q in asked[1])


def test_lines_keys_and_pairs_are_narrow(spark, monkeypatch):
    """What is written and shuffled for pairs: 32 bits a key; two ids, one number and a count a pair."""
    words = [f"w{i}" for i in range(40)]
    docs = [(d, "\n".join(" ".join(words[d % 7 + k : d % 7 + k + 12] + [f"x{d}{k}"] * (d % 3)) for k in range(5))) for d in range(40)]
    df, gone = spark.createDataFrame(docs, "doc_id long, text string"), 0
    seen: list[set] = []
    for _, text in docs:
        for line in text.split("\n"):
            s = set(line.split())
            gone += any(5 * len(s & e) >= 4 * len(s | e) for e in seen)
            seen.append(s)
    every, pairs, times = line_dedup.sets(df, 80), [], line_dedup.times_met
    assert every.schema["prefix"].dataType.simpleString() == "array<int>"
    # the keys of a set are in order, in 32 bits too
    assert all(list(r.prefix) == sorted(r.prefix) for r in every.collect())
    monkeypatch.setattr(line_dedup, "times_met", lambda met: pairs.append(times(met)) or pairs[-1])
    assert line_dedup.dedup_lines(df, 80, 1).agg(F.sum("n_removed")).first()[0] == gone > 0
    assert pairs and all(p.columns == ["a", "b", "x", "m"] for p in pairs)


def test_plain_words_need_no_lines(monkeypatch):
    """Words of letters and digits, also with a mark behind, go past `atoms`; ids stay the tokenizer's."""
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        encode, asked = packing.Encoder(f.read()), []
    atoms = encode.atoms
    monkeypatch.setattr(encode, "atoms", lambda word: asked.append(word) or atoms(word))
    texts = ["thus he said, 12 times: 3rd größe. x² ½ und٣ 漢字! don't a.b, end.\nNext line; ??", "", "a", ".", "mot, mot,"]
    want = [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode(texts) == want
    assert not {w.strip() for w in asked} & {"thus", "said,", "times:", "größe.", "a", "mot,", "漢字!"} and " end.\nNext" in asked


def test_plain_words_are_not_searched_for_pieces():
    """Words of letters, and what marks and digits cut off of them, don't pass through the tokenizer's own split."""
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        encode = packing.Encoder(f.read())
    text = "One thhareha&&& of. erälich%%% ab12, ÉÊCH!! one-two end"
    odd = [text, text + " don't st.\nThe a\n\nb x\n y日本 ¼a", "", " ", "×÷ ªb a×b"]
    want = [x.tobytes() for x in encode.ids(odd)]
    asked, encode.ids = [], lambda texts, ids=encode.ids: (asked.extend(texts), ids(texts))[1]
    assert encode([text]) == want[:1]
    assert "".join(asked).strip() == "One"
    assert encode(odd) == want


def test_materialize_gives_free_native_memory_back(spark):
    """What the driver's JVM has freed outside its heap goes back to the system with the next table written."""
    jvm = spark.sparkContext._jvm
    status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup"
    mb = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open(status).read()))) // 1024
    if not os.path.exists(status) or relieve(spark) is None:
        pytest.skip("this system or its Java can't tell")
    materialize(spark.range(1))  # what the first write of a session takes
    buffers = [jvm.java.nio.ByteBuffer.allocateDirect(1 << 16) for _ in range(3000)]
    last = buffers[-1]  # noqa: F841 - holds the end of what malloc has
    del buffers
    gc.collect()
    jvm.System.gc()
    time.sleep(2)  # buffers are freed by a thread of their own
    jvm.System.gc()
    before = mb()
    materialize(spark.range(1))
    assert before - mb() > 100

"""Operator 3, language identification by words first, then shorter and shorter character n-grams.

A word known from training scores its log frequency in each language. A word never seen is scored by its characters:
at each position by the longest of the trigram, bigram and single character that training knows. The sums over the
whole text, with the languages' prior, give the language and its posterior probability.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if nothing could be
learned (no training row). Rows with a null doc_id can be scored but aren't learned from. Repeated rows each get a row.
Other columns, whatever their names, are carried along by `keep_identified` and not read otherwise.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import carried, id_mod, materialize, table, unpacked

#: Runs of letters; with a few signs among them that count as numbers, which `letters` takes out.
LETTERS = re.compile(r"[^\W\d_]+")
#: Distinct (language, word) counts that a task holds before it hands them on.
FLUSH = 400_000
#: Words that a scorer remembers beside the model's; words of a text, and of all texts, that it looks up at once.
MEMO, PART, PARTS = 200_000, 20_000, 100_000
#: Parts in which a language's words are ranked.
SALTS = 32
#: Texts scored together.
TEXTS = 256


def letters(text: str) -> list:
    """The text's words, in lower case: runs of characters of the letter categories."""
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]


def _grams(word: str, n: int):
    padded = f"\x02{word}\x03" if n > 1 else word
    return (padded[i : i + n] for i in range(len(padded) - n + 1))


def _count_words(batches):
    held: Counter = Counter()

    def out():
        frame = pd.DataFrame({"lang": [k[0] for k in held], "word": [k[1] for k in held], "n": list(held.values())})
        held.clear()
        return frame

    for b in batches:
        for lang, text in zip(b["lang"], b["text"]):
            held.update([(lang, w) for w in letters(text)])
            if len(held) > FLUSH:
                yield out()
    if held:
        yield out()


def _count_grams(batches):
    held: Counter = Counter()
    for b in batches:
        for lang, word, n in zip(b["lang"], b["word"], b["n"]):
            for size in (1, 2, 3):
                for g in _grams(word, size):
                    held[(lang, g)] += n
        if len(held) > FLUSH:
            yield pd.DataFrame({"lang": [k[0] for k in held], "gram": [k[1] for k in held], "n": list(held.values())})
            held.clear()
    if held:
        yield pd.DataFrame({"lang": [k[0] for k in held], "gram": [k[1] for k in held], "n": list(held.values())})


class WordBackoff:
    """The fitted model: log frequencies of words and n-grams, one column a language."""

    def __init__(self, words: pd.DataFrame, grams: pd.DataFrame, totals: pd.DataFrame):
        self.langs = sorted(totals["lang"])
        at = {k: i for i, k in enumerate(self.langs)}
        n = len(self.langs)
        tokens = np.ones(n)
        for lang, m in zip(totals["lang"], totals["n"]):
            tokens[at[lang]] += m
        self.prior = np.log(tokens / tokens.sum()) if n else np.zeros(0)
        self.words, w = self._matrix(words, "word", at, n)
        self.word_logs = np.log((w + 0.5) / (tokens + 0.5 * len(self.words) + 1)).astype(np.float32)
        self.grams, g = self._matrix(grams, "gram", at, n)
        size = np.array([len(k) for k in self.grams], int)
        self.gram_logs = np.zeros_like(g, dtype=np.float32)
        for k in (1, 2, 3):
            m = size == k
            self.gram_logs[m] = np.log((g[m] + 0.5) / (g[m].sum(0) + 0.5 * max(1, m.sum())))

    @staticmethod
    def _matrix(frame, key, at, n):
        rows = {k: i for i, k in enumerate(sorted(set(frame[key])))}
        m = np.zeros((len(rows), n))
        for k, lang, c in zip(frame[key], frame["lang"], frame["n"]):
            m[rows[k], at[lang]] += c
        return rows, m

    def state(self) -> tuple:
        """Plain values: what is broadcast mustn't need this module's classes."""
        return self.langs, self.prior, self.words, self.word_logs, self.grams, self.gram_logs


class Scorer:
    def __init__(self, state: tuple):
        self.langs, self.prior, self.words, self.word_logs, self.grams, self.gram_logs = state
        self.known = len(self.words)
        self.reset()

    def unseen(self, words: list) -> np.ndarray:
        """For each word the mean over its positions of the longest known n-gram's log frequency; zeros where none is known."""
        get, rows, sizes = self.grams.get, [], []
        for w in words:
            p = f"\x02{w}\x03"
            own = [get(p[i : i + 3]) for i in range(len(w))]
            if None in own:
                own = [r if r is not None else get(p[i + 1 : i + 3], get(p[i + 1])) for i, r in enumerate(own)]
                own = [r for r in own if r is not None]
            rows += own
            sizes.append(len(own))
        sizes = np.array(sizes)
        out = np.zeros((len(words), len(self.langs)), np.float32)
        known = np.flatnonzero(sizes)
        if len(known):
            ends = np.cumsum(sizes[known])
            out[known] = np.add.reduceat(self.gram_logs[rows], ends - sizes[known], axis=0) / sizes[known, None]
        return out

    def reset(self):
        self.at = dict(self.words)
        self.logs = np.zeros((self.known + MEMO, len(self.langs)), np.float32)
        self.logs[: self.known] = self.word_logs
        self.n = self.known

    def learn(self, parts: list) -> None:
        """Notes the logs of the words in parts that are new. Words are few: PART for each of parts."""
        new = list(set().union(*parts).difference(self.at))
        if self.n + len(new) > len(self.logs):
            self.reset()
            new = list(set().union(*parts).difference(self.at))
        self.logs[self.n : self.n + len(new)] = self.unseen(new)
        self.at.update(zip(new, range(self.n, self.n + len(new))))
        self.n += len(new)

    def __call__(self, texts: list) -> list:
        """(language, probability) of each text. Parts of at most PART words are looked up together, PARTS words or so at a time."""
        out, sums = [], []
        todo = [(k, words[i : i + PART]) for k, words in enumerate(letters(t) if t else [] for t in texts) for i in range(0, len(words), PART)]
        sums = [None] * len(texts)
        i = 0
        while i < len(todo) and self.langs:
            j, size = i, 0
            while j < len(todo) and (j == i or size + len(todo[j][1]) <= PARTS):
                size += len(todo[j][1])
                j += 1
            self.learn([w for _, w in todo[i:j]])
            place = self.at.__getitem__
            for k, w in todo[i:j]:
                total = self.logs[list(map(place, w))].sum(0, dtype=np.float64)
                sums[k] = total if sums[k] is None else sums[k] + total
            i = j
        for total in sums:
            if total is None:
                out.append(("und", 0.0))
                continue
            total = total + self.prior
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())))
        return out


def fit(docs: DataFrame, max_words: int = 60_000, max_grams: int = 60_000) -> WordBackoff:
    """Learn from all rows of docs(lang, text): counts cover every word; of these `max_words` words and `max_grams` n-grams
    make the model, which bounds what the driver collects and broadcasts. They go by their best rank by frequency inside a
    language, so that each language has its share of the places and what one doesn't need is left to the others."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = train.mapInPandas(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialize(counts)

    def most(frame: DataFrame, key: str, bound: int) -> pd.DataFrame:
        # a language of any number of words is ranked in SALTS parts first; at most SALTS * bound rows of it go on
        order, part = [F.desc("n"), F.col(key)], F.pmod(F.xxhash64(key), F.lit(SALTS))
        some = frame.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("r") <= bound)
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
        best = some.withColumn("r", rank).where(F.col("r") <= bound).groupBy(key).agg(F.min("r").alias("r"))
        top = best.orderBy("r", key).limit(bound).select(key)  # `bound` words: a few MB whatever the input
        return frame.join(F.broadcast(top), key).select(key, "lang", "n").toPandas()

    grams = counts.mapInPandas(_count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = materialize(grams)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n")).toPandas()
    return WordBackoff(most(counts, "word", max_words), most(grams, "gram", max_grams), totals)


def predict(spark: SparkSession, docs: DataFrame, model: WordBackoff, name: str = "_p") -> DataFrame:
    """docs with a struct of lang_pred and score, by the name given."""
    sent = spark.sparkContext.broadcast(model.state())

    @F.pandas_udf("lang_pred string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        s = Scorer(sent.value)
        for texts in batches:
            each = list(texts)
            yield pd.DataFrame([p for i in range(0, len(each), TEXTS) for p in s(each[i : i + TEXTS])], columns=["lang_pred", "score"])

    return docs.withColumn(name, score(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(id_mod(F.col("doc_id"), 4) != 2))
    out = predict(spark, docs.select("doc_id", "text"), model)
    return out.select("doc_id", (id_mod(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("_p.lang_pred").alias("lang_pred"), F.col("_p.score").alias("score"))


def keep_identified(docs: DataFrame, model: WordBackoff, min_score: float = 0.5) -> DataFrame:
    """docs without the rows whose language can't be told: `und`, or a posterior under min_score."""
    out = predict(docs.sparkSession, carried(docs, "text"), model, "found")
    return unpacked(out.where((F.col("found.lang_pred") != "und") & (F.col("found.score") >= min_score)), docs.columns)

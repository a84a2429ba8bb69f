"""Operator 7, toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, homoglyphs and digit substitutions to Latin letters, accents off, anything else to
one space. The lexicon holds whole words (` word `) and word beginnings (` stem`); its weights are log odds of a term's
presence in toxic against other labelled texts. Exception phrases (a term with a neighbour that only ever stands in
harmless texts) cancel the matches inside them. The summed weights, also divided by the text's length, go through a
fitted logistic curve.

The lexicon is learned from a bounded sample (`max_rows` labelled rows, whole texts); every whole text is scored, in pieces
that overlap by the words that an exception phrase can hold, so that memory stays bounded and no border changes a score.

Defined results: a null text counts as empty; an empty text has no match and gets the curve's value at zero; without
labelled rows every score is 0. Repeated rows each get a row; an empty table gives no rows. Columns other than doc_id and text aren't read.
"""

import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import id_mod, labelled_sample, table

#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": " ", "|": " "}
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһӏкмтвнαορνικτυϲɑɡı", "aeopcyxijsdhlkmtbhaopviktucagi"))
#: Shortest and longest word beginning that becomes a term.
STEM = (4, 8)
#: Characters folded and matched at once.
PIECE = 1 << 20


def folding_table() -> dict:
    """Code point to its folded letter, for the ranges that occur in Latin, Greek and Cyrillic text and full-width forms."""
    t = {}
    for c in [*range(0x250), *range(0x300, 0x530), *range(0x1E00, 0x2070), *range(0xFF00, 0xFF5F)]:
        ch = unicodedata.normalize("NFKD", chr(c))[0].lower()
        ch = SUBSTITUTES.get(ch) or HOMOGLYPHS.get(ch) or ch
        t[c] = ch if ch.isalpha() else ("" if unicodedata.combining(chr(c)) or 0x200B <= c <= 0x200F else " ")
    return t


def fold(text: str, table: dict) -> str:
    """The folded words, each between single spaces."""
    return f" {' '.join(text.translate(table).split())} "


def _terms(words: set) -> set:
    out = {f" {w} " for w in words if len(w) >= 3}
    for w in words:
        out.update(f" {w[:k]}" for k in range(STEM[0], min(len(w), STEM[1] + 1)))
    return out


class Lexicon:
    """Terms with weights, exception phrases, and the curve's coefficients."""

    def __init__(self, terms: dict, exceptions: dict, curve: np.ndarray):
        self.terms, self.exceptions, self.curve = terms, exceptions, curve

    def state(self) -> tuple:
        return self.terms, self.exceptions, self.curve


def automaton(terms: dict, exceptions: dict):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t, w in terms.items():
        a.add_word(t, (len(t), w))
    for t in exceptions:
        a.add_word(t, (len(t), None))
    a.make_automaton()
    return a


def pieces(text: str, table: dict) -> Iterator[list]:
    """The folded words of a text, some PIECE characters at a time. Pieces end where no word goes on."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and not text[end].isspace() and table.get(ord(text[end])) != " ":
            end += 1
        yield text[at:end].translate(table).split()
        at = end


def matched(words: list, a, first: int, last: int) -> float:
    """Sum of the weights matched in words[first:last]. Of terms that share a start the heaviest counts, those inside an exception don't."""
    s = f" {' '.join(words)} "
    from_, to = (sum(map(len, words[:k])) + k for k in (first, last))
    best, spared = {}, []
    for stop, (n, w) in a.iter(s):
        start = stop - n + 1
        if w is None:
            spared.append((start, stop))
        elif from_ <= start < to:
            best[start] = max(w, best.get(start, 0.0))
    spared.sort()
    starts, reach = [x for x, _ in spared], list(accumulate((y for _, y in spared), max))
    return sum(w for k, w in best.items() if not (i := bisect_right(starts, k)) or reach[i - 1] <= k)


def evidence(text, table: dict, a) -> tuple[float, int]:
    """(sum of the weights matched, number of words) of a whole text. Each piece is read with two words before and two behind it."""
    total, n, words, first = 0.0, 0, [], 0
    for new in pieces(text or "", table):
        n += len(new)
        words += new
        if len(a) and len(words) > first + 2:
            total += matched(words, a, first, len(words) - 2)
            words = words[max(0, len(words) - 4) :]
            first = len(words) - 2
    if len(a) and words:
        total += matched(words, a, first, len(words))
    return total, n


def features(total: float, words: int) -> np.ndarray:
    """What the curve sees: a constant, the weights matched, and these for the text's length."""
    return np.array([1.0, np.log1p(total), np.log1p(100.0 * total / (words + 20.0))])


def learn(texts: list, y: np.ndarray, min_docs: int = 3) -> Lexicon:
    """Lexicon, exceptions and curve from labelled texts."""
    table = folding_table()
    folded = [fold(t or "", table) for t in texts]
    hits, seen = Counter(), Counter()
    for s, toxic in zip(folded, y):
        found = _terms(set(s.split()))
        seen.update(found)
        if toxic:
            hits.update(found)
    pos, neg = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    # A rare term that happens to stand in toxic texts only is noise: the log odds are taken at a lower bound of its share
    weights = {}
    for t, h in hits.items():
        if h >= min_docs and h / seen[t] >= 0.6:
            other = seen[t] - h
            low = (h - 1.6 * h**0.5 + 0.1) / pos
            if low > 0 and (w := np.log(low / ((other + 0.7 + other**0.5) / neg))) > 0.7:
                weights[t] = float(w)
    # a stem replaces the longer terms it covers where it is as telling; a stem no better than one of its terms goes
    kept: dict = {}
    for t in sorted(weights, key=lambda t: (-hits[t] * weights[t], len(t), t)):
        stem = any(t[:k] in kept for k in range(2, len(t)))
        longer = not t.endswith(" ") and any(u.startswith(t) for u in kept)
        if not stem and not longer:
            kept[t] = weights[t]
    a = automaton(kept, {})
    # exceptions: a term and its neighbour that stand together in harmless texts again and again, in toxic ones never
    around, toxic_around = Counter(), set()
    for s, toxic in zip(folded, y):
        phrases = set()
        for stop, (n, _) in a.iter(s) if len(a) else []:
            start = stop - n + 1
            word_end = s.find(" ", start + 1)
            left = s.rfind(" ", 0, start) if start else -1
            right = s.find(" ", word_end + 1)
            if left >= 0:
                phrases.add(s[left : word_end + 1])
            if right >= 0:
                phrases.add(s[start : right + 1])
        if toxic:
            toxic_around |= phrases
        else:
            around.update(phrases)
    exceptions = {p: True for p, n in around.items() if n >= max(3, min_docs) and p not in toxic_around}
    lexicon = Lexicon(kept, exceptions, np.zeros(3))
    a = automaton(kept, exceptions)
    x = np.array([features(*evidence(t, table, a)) for t in texts])
    lexicon.curve = logistic(x, y)
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Newton's method with a small ridge; slopes are kept from falling below 0, more evidence never lowers a score."""
    use = list(range(x.shape[1]))
    while True:
        b = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            g = x[:, use].T @ (p - y) + ridge * b[use]
            h = (x[:, use] * (p * (1 - p))[:, None]).T @ x[:, use] + ridge * np.eye(len(use))
            d = np.linalg.solve(h, g)
            b[use] -= np.clip(d, -3, 3)
        if (bad := [k for k in use[1:] if b[k] < 0]) == []:
            return b
        use.remove(min(bad, key=lambda k: b[k]))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> Lexicon | None:
    sample = labelled_sample(spark, docs, labels, "toxic", max_rows).toPandas().sort_values(["doc_id", "text"])
    return learn(list(sample["text"]), sample["y"].to_numpy(np.float64)) if len(sample) else None


def score(spark: SparkSession, docs: DataFrame, lexicon: Lexicon | None) -> DataFrame:
    """docs with a column `score`, which replaces one of docs."""
    if lexicon is None:
        return docs.withColumn("score", F.lit(0.0))
    sent = spark.sparkContext.broadcast(lexicon.state())

    @F.pandas_udf("double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms, exceptions, curve = sent.value
        table, a = folding_table(), automaton(terms, exceptions)
        for texts in batches:
            x = np.array([features(*evidence(t, table, a)) for t in texts]).reshape(-1, 3)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ curve, -30, 30))), dtype="float64")

    return docs.withColumn("score", apply(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = fit(spark, docs, table(spark, sf_dir, "labels"))
    held = (id_mod(F.col("doc_id"), 3) == 1).alias("held_out")
    return score(spark, docs, lexicon).select("doc_id", held, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

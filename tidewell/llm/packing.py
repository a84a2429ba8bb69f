"""Operator 6, best-fit packing: hierarchical residual packing of tokenized documents into sequences.

Documents are tokenized where they are read; those longer than a sequence are cut, the first piece takes the remainder.
Pieces are dealt into buckets of about `bucket_items`. Each bucket is packed by best fit, longest first; bins with at
most `slack` tokens free are final, the others go up as items of the next round, `fan_in` buckets to one, until one
bucket is left. A bucket sends up at most `carry` bins, the emptiest; fuller ones are final as they are. That bounds
what a task holds and costs a little fill, never a piece.

Defined results: a null or empty text is one piece of length 1, the end mark. Rows with equal or null doc_id are packed
each for itself. An empty table gives no rows. Columns other than doc_id and text aren't read.
"""

import json
import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, table

#: Byte-level BPE's split into pieces, as the tokenizer's file format defines it. Fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Marks that are pieces by themselves behind a letter or digit.
MARKS = ".,;:!?"
#: Letters in every version of Unicode that tokenizers know; words of them, and words that begin with them and go on with
#: marks and digits, but no apostrophe, in which contractions begin; and the pieces of such words.
LETTERS, MARK = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
LETTERS_ONLY = re.compile(f"[{LETTERS}]+").fullmatch
PLAIN = re.compile(rf"[{LETTERS}][{LETTERS}0-9{MARK}]*").fullmatch
PLAIN_PIECES = re.compile(rf"[{LETTERS}]+|[0-9]+|[{MARK}]+").findall
#: Byte-level BPE's characters for bytes, as the tokenizer's file format defines them. Fixed values.
SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = dict(zip([b for b in range(256) if b not in SHOWN], range(256, 512)))
BLANK = chr(BYTES[32])
#: Words whose ids a worker remembers.
MEMO = 1_000_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def shown(piece: str) -> str:
    """The piece's UTF-8 bytes in byte-level BPE's characters."""
    return piece.encode().decode("latin-1").translate(BYTES)


def bare_model(spec: str) -> tuple:
    """The tokenizer's model alone, for pieces in byte-level characters with blanks between them, and of each id whether its
    token begins with a piece's blank. (None, None) for tokenizers that aren't plainly byte-level BPE with all 256 bytes."""
    from tokenizers import Tokenizer

    form = json.loads(spec)
    split, model = form.get("pre_tokenizer") or {}, form["model"]
    by_bytes = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    odd = form.get("normalizer") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    vocabulary = model["vocab"] if model.get("type") == "BPE" else {}
    if not by_bytes or odd or not all(chr(BYTES.get(b, b)) in vocabulary for b in range(256)):
        return None, None
    begins = np.zeros(max(vocabulary.values()) + 1, bool)
    begins[[k for token, k in vocabulary.items() if token.startswith(BLANK)]] = True
    bare = {"pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
    return Tokenizer.from_str(json.dumps(form | bare)), begins


class Encoder:
    """A text's ids as little-endian unsigned 32-bit integers. Each distinct word is encoded once and remembered.

    No piece that the tokenizer splits a text into goes on behind a blank, but in a run of white space with a blank inside
    it. Texts without such a run are split at blanks, each part keeps the blank before it, and the parts' ids are the
    text's. Other texts are split into pieces by SPLIT; texts with a special token are encoded whole.
    """

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.special = regex.compile("|".join(regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)").search
        self.find = regex.compile(SPLIT).findall
        self.odd = re.compile(r"\s \s|\s \Z").search
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.bare, self.begins = bare_model(spec)
        self.behind_blank: dict = {}
        self.alone: dict = {}

    def ids(self, texts: list) -> list:
        return [array("I", e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def atoms(self, word: str) -> list:
        """The word in parts whose ids add up to its own: at line ends and before a mark at a line's end. Empty if in doubt."""
        out, lines = [], word.split("\n")
        for k, line in enumerate(lines):
            core = line[1:] if k == 0 and line[:1] == " " else line
            if not core or core[0].isspace() or core[-1].isspace():
                return []
            if k:
                out.append("\n")
            if core[-1] in MARKS and core[-2:-1].isalnum():
                out += (line[:-1], line[-1])
            else:
                out.append(line)
        return out

    def learn_plain(self, memo: dict, new: set) -> list:
        """Learns plain words, each behind a blank, without a search for pieces in the tokenizer; the other words are returned."""
        whole, mixed, rest = [], [], []
        for p in new:
            (whole if p.isascii() and p.isalpha() or LETTERS_ONLY(p) else mixed if PLAIN(p) else rest).append(p)
        cut = [PLAIN_PIECES(p) for p in mixed]
        whole += {c[0] for c in cut}.difference(memo, whole)
        for a in range(0, len(whole), 1024):
            part = whole[a : a + 1024]
            ids = np.array(self.bare.encode_batch_fast([BLANK + f" {BLANK}".join([p if p.isascii() else shown(p) for p in part])], add_special_tokens=False)[0].ids, "<u4")
            starts = (4 * np.flatnonzero(self.begins[ids])).tolist()
            raw = ids.tobytes()
            memo.update(zip(part, [raw[i:j] for i, j in zip(starts, [*starts[1:], len(raw)])], strict=True))
        tails, tokenize = set().union(*[c[1:] for c in cut]).difference(self.alone), self.bare.model.tokenize
        self.alone.update((t, array("I", [x.id for x in tokenize(shown(t))]).tobytes()) for t in tails)
        alone = self.alone.__getitem__
        memo.update((p, memo[c[0]] + b"".join(map(alone, c[1:]))) for p, c in zip(mixed, cut))
        return rest

    def learn(self, memo: dict, parts: list, before: str) -> None:
        new = set().union(*parts).difference(memo)
        new = self.learn_plain(memo, new) if before and self.bare else list(new)
        known, mark = {}, self.newline[0]
        # most words are letters and digits, or those and a mark: told without looking at their lines
        plainly = lambda p: (before + p,) if p.isalnum() else (before + p[:-1], p[-1]) if p[-1:] in MARKS and p[:-1].isalnum() else self.atoms(before + p)
        split = [plainly(p) if len(self.newline) == 1 else [] for p in new]
        # atoms are encoded many at once, with a line's end behind each
        plain = list(set().union(*split).difference("\n"))
        known["\n"] = np.array(self.newline, "<u4").tobytes()
        for a in range(0, len(plain), 256):
            part = plain[a : a + 256]
            ids = np.array(self.ids(["\n".join(part) + "\n"])[0])
            raw, ends = ids.tobytes(), (4 * np.flatnonzero(ids == mark)).tolist()
            known.update(zip(part, [raw[i:j] for i, j in zip([0, *[e + 4 for e in ends]], ends)]))
        get = known.__getitem__
        memo.update((p, known[s[0]] if len(s) == 1 else b"".join(map(get, s))) for p, s in zip(new, split) if s)
        rest = [p for p, s in zip(new, split) if not s]
        memo.update(zip(rest, [i.tobytes() for i in self.ids([before + p for p in rest])]))

    def run(self, texts: list) -> list:
        out, at, firsts, rests = [None] * len(texts), [], [], []
        for k, t in enumerate(texts):
            if self.special(t):
                out[k] = self.ids([t])[0].tobytes()
                continue
            at.append(k)
            if self.odd(t):
                firsts.append(self.find(t))
                rests.append(())
            else:
                words = t.split(" ")
                firsts.append(words[:1] if words[0] else ())
                rests.append(words[1:])
        self.learn(self.alone, firsts, "")
        self.learn(self.behind_blank, rests, " ")
        alone, behind_blank = self.alone.__getitem__, self.behind_blank.__getitem__
        for k, f, r in zip(at, firsts, rests):
            out[k] = b"".join(map(alone, f)) + b"".join(map(behind_blank, r))
        return out

    def __call__(self, texts: list) -> list:
        out, i = [], 0
        while i < len(texts):  # a bounded run of texts at a time
            if len(self.alone) + len(self.behind_blank) > MEMO:
                self.alone.clear()
                self.behind_blank.clear()
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < 2_000_000):
                size += len(texts[j])
                j += 1
            out += self.run(texts[i:j])
            i = j
        return out


def encoder(spec: str) -> Encoder:
    """The worker's own encoder: it stays between the tasks of a reused worker, with what it remembers."""
    kept = sys.modules.setdefault("_tidewell_kept", types.ModuleType("_tidewell_kept"))
    if getattr(kept, "spec", None) != spec:
        kept.spec, kept.encoder = spec, Encoder(spec)
    return kept.encoder


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes the remainder."""
    first = n if n <= size else (n % size or size)
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, size: int, tokenizer: str) -> DataFrame:
    """A row for each piece, and `uid`, distinct in this table."""
    with open(tokenizer, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # a tokenizer's file: a few MB whatever the input

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, n = encoder(sent.value), TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for doc_id, raw in zip(b["doc_id"], encode([t or "" for t in b["text"]])):
                raw += b"\0\0\0\0"
                for k, (s, m) in enumerate(cut(len(raw) // 4, size)):
                    rows.append((doc_id, k, s, m, zlib.crc32(raw[4 * s : 4 * (s + m)]), n))
                    n += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "uid"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(tokenize, PIECE + ", uid long")


def best_fit(sizes: np.ndarray, size: int) -> list[list[int]]:
    """Bins of item numbers: longest item first, each into the bin that it leaves fullest. Free spaces are bits of one integer."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0
    for k in np.argsort(-sizes, kind="stable"):
        n = int(sizes[k])
        if m := mask >> n:
            gap = n + (m & -m).bit_length() - 1
            b = free[gap].pop()
            if not free[gap]:
                mask &= ~(1 << gap)
            bins[b].append(int(k))
        else:
            gap, b = size, len(bins)
            bins.append([int(k)])
        free[gap - n].append(b)
        mask |= 1 << (gap - n)
    return bins


def pack(items: DataFrame, size: int, bucket_items: int = 5000, fan_in: int = 16, slack: int = 4, carry: int = 2500) -> DataFrame:
    """The pieces with sequence_id and offset."""
    kind = f"array<struct<{PIECE.replace(' long', ':long').replace(' int', ':int')}>>"
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    todo = items.select(F.col("uid").alias("key"), F.col("length").alias("fill"), F.array(F.struct(*columns)).cast(kind).alias("parts"))
    buckets = max(1, -(-items.count() // bucket_items))
    done, level = [], 0
    while True:
        top, at = buckets == 1, level

        def run(key, b: pd.DataFrame) -> pd.DataFrame:
            sizes, parts = b["fill"].to_numpy(), list(b["parts"])
            bins = best_fit(sizes, size)
            fill = [int(sizes[x].sum()) for x in bins]
            order = sorted(range(len(bins)), key=lambda k: fill[k])
            up = set() if top else {k for k in order[:carry] if fill[k] < size - slack}
            return pd.DataFrame({
                "bucket": [int(key[0])] * len(bins), "key": [(at << 56) | (int(key[0]) << 24) | k for k in range(len(bins))], "fill": fill,
                "parts": [[p for i in x for p in parts[i]] for x in bins], "final": [k not in up for k in range(len(bins))],
            })

        dealt = todo.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)) if level == 0 else F.col("bucket"))
        bins = materialize(dealt.groupBy("bucket").applyInPandas(run, f"bucket long, key long, fill long, parts {kind}, final boolean"))
        done.append(bins.where("final"))
        if top:
            break
        buckets, level = -(-buckets // fan_in), level + 1
        todo = bins.where("not final").withColumn("bucket", F.floor(F.col("bucket") / fan_in))
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    out = out.select(F.col("key").alias("sequence_id"), "parts", F.posexplode("parts").alias("at", "p"))
    before = F.aggregate(F.slice("parts", 1, F.col("at")), F.lit(0).cast("long"), lambda a, p: a + p["length"])
    return out.select(*[F.col(f"p.{c}").alias(c) for c in columns], "sequence_id", before.alias("offset"))


def best_fit_packing(docs: DataFrame, size: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most `size` tokens."""
    return pack(materialize(pieces(docs, size, tokenizer or default_tokenizer())), size)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))

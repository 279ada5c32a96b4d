"""Toxicity scores of texts restored by a noisy-channel decoder.

The channel writes letters as look-alike signs (leetspeak), repeats them, or puts spaces and
marks between them.  Every token that could have come out of it becomes a lattice of
characters; Viterbi's algorithm finds the likeliest letters under a character language model
and the channel's costs.  A lexicon learned from labelled rows then scores the restored text.

The language model is a trigram model over the words of the whole corpus: each word weighs
the logarithm of its count, so its words have to meet in one shuffle, partially summed before.
Trigrams are hashed into a fixed number of buckets, so the model is of one size at any scale.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, stored

#: Look-alikes and the letters that they may stand for (fixed values).
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i"}
BUCKETS = 1 << 18
SIGNS = "@$!|+€£¡"
GAP = r"[\s.\-_*~,]"
#: Four or more single characters or runs of one, each a letter, digit or sign, with gaps between.
SPACED = re.compile(rf"(?<![^\W_])(?<![^\W_]['’])((?<![{SIGNS}])[{SIGNS}]|[^\W_])\1*+(?:{GAP}++([^\W_]|[{SIGNS}])\2*+){{3,}}(?![^\W_])")
RUN = re.compile(rf"({GAP})(?:{GAP})*|(.)\2*", re.S)
WORD = re.compile(r"[^\W\d_]+")
ODD = re.compile(r"[^\W\d_][^\w\s]*[0-9@$!|+€£¡]|[0-9@$!|+€£¡][^\W\d_]|([^\W\d_])\1\1")
DOUBLED = re.compile(r"([^\W\d_])\1")
#: Bits by which a word has to be likelier without some of its doubled letters than as it stands.
GAIN = 6.0
#: Longest token whose restored word is kept for the next time.
KEPT = 64
CACHE = 300_000


def crc_fold(id_col: str):
    """crc32 of the id as text, modulo 5; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(0))


def _bucket(x: str) -> int:
    return zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS


class Channel:
    """Character language model and decoder."""

    def __init__(self, counts: np.ndarray, restore: bool = True):
        self.counts, self.restore = counts, restore
        self.seen: dict[str, float] = {}
        self.restored: dict[str, str] = {}

    def cost(self, a: str, b: str, c: str) -> float:
        """-log2 of P(c | a b), interpolated with P(c | b) and P(c)."""
        key = a + b + c
        if key not in self.seen:
            if len(self.seen) > CACHE:
                self.seen.clear()
            n = self.counts
            three, two, one = n[_bucket("3" + key)], n[_bucket("2" + b + c)], n[_bucket("1" + c)]
            of_two, of_one, all_ = n[_bucket("c" + a + b)], n[_bucket("c" + b)], n[_bucket("c")]
            p = 0.6 * three / (of_two + 1) + 0.3 * two / (of_one + 1) + 0.09 * one / (all_ + 1) + 1e-6
            self.seen[key] = -math.log2(p)
        return self.seen[key]

    def arcs(self, token: str, gaps: bool) -> list[list[tuple[str, float]]]:
        """For each run of a character, the letters it may stand for and their prices; "$" ends
        a word.  With ``gaps``, separators stand between letters and are nothing or a word end,
        the wide ones rather that."""
        runs = [m[0] for m in RUN.finditer(token)] if gaps else [m[0] for m in re.finditer(r"(.)\1*", token, re.S)]
        held = [i for i, x in enumerate(runs) if x[0].isalnum()]
        first, last = (held[0], held[-1]) if held else (0, len(runs))
        width = lambda x: len(x) + any(c.isspace() for c in x)
        narrow = min((width(x) for x in runs if gaps and re.match(GAP, x)), default=0)
        out: list[list[tuple[str, float]]] = []
        before, alike = "", 0
        for i, run in enumerate(runs):
            c, k = run[0], len(run)
            if gaps and re.match(GAP, c):
                wide = width(run) > narrow
                out.append([("", 3.0 * wide), ("$", 3.0 * (not wide))])
                continue
            before, alike = c, alike + 1 if c == before else 1
            if c.isalpha():
                some = [(c * n, 1.5 * (2 - n) if k == 2 else 1.0 if k > 2 else 0.0) for n in {1, min(k, 2)}]
                if k == 1 and not gaps:
                    some = [(c, 1.0)]
                if alike > 1:  # a repeat over a gap
                    some = [(x, price + 4.0 * (alike > 2)) for x, price in some] + [("", 5.0 * (alike == 2))]
            else:
                letters = LOOKALIKES.get(c, "")
                drop = 10.0 if letters else 3.0
                if not c.isalnum() and (i > last or i < first and not letters):
                    drop = 4.0 if letters and c != "!" else 0.0  # punctuation
                some = [(x * n, 1.0 * min(k, 3) + min(k - n, 2)) for x in letters for n in ({1, k} if k < 3 else {1})] + [("", drop)]
            out.append(some)
        return out

    def best(self, arcs: list[list[tuple[str, float]]]) -> tuple[float, str]:
        """Bits and letters of the cheapest way through the lattice."""
        best: dict[tuple[str, str], tuple[float, tuple | None]] = {("^", "^"): (0.0, None)}
        for choices in arcs:
            new: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in best.items():
                for out, price in choices:
                    x, y, total = a, b, cost + price
                    for c in out:
                        total += self.cost(x, y, c)
                        x, y = (y, c) if c != "$" else ("^", "^")
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = total, (path, out) if out else path
            best = new
        total, path = min(((cost + self.cost(a, b, "$"), path) for (a, b), (cost, path) in best.items()), key=lambda x: x[0])
        found = []
        while path:
            path, out = path
            found.append(out)
        return total, "".join(reversed(found))

    def decode(self, token: str) -> str:
        """The likeliest word behind a token; marks that stand for nothing are dropped."""
        return self.kept(token, lambda: self.best(self.arcs(token, False))[1])

    def undoubled(self, word: str) -> str:
        """The likeliest word with doubled letters as one, if it is likelier by ``GAIN``."""
        found = DOUBLED.findall(word)
        if len(found) == 1:  # one choice: the trigrams that differ tell, with no search
            i, x = word.index(2 * found[0]), found[0]
            before, after = word[i - 1] if i else "^", word[i + 2] if i + 2 < len(word) else "$"
            gain = self.cost(before, x, x) + self.cost(x, x, after) - self.cost(before, x, after) - 1.5
            return word[:i] + word[i + 1 :] if gain >= GAIN else word

        def run():
            arcs = [[(out, price - (len(c) == 1)) for out, price in c] for c in self.arcs(word, False)]
            total, text = self.best(arcs)
            return text if self.best([[(word, 0.0)]])[0] - total >= GAIN else word

        return self.kept("2" + word, run)

    def kept(self, key: str, run) -> str:
        if key in self.restored:
            return self.restored[key]
        if len(self.restored) > CACHE:
            self.restored.clear()
        text = run()
        if len(key) <= KEPT:
            self.restored[key] = text
        return text

    def split(self, chunk: str) -> tuple[list[str], list[str]]:
        """(words as they stand, words restored) of a lower-case part between white space."""
        if not self.restore:
            return WORD.findall(chunk), []
        doubled = DOUBLED.search(chunk)
        if chunk.isalpha() and not doubled:
            return [chunk], []
        found, i, j = WORD.findall(chunk), 0, len(chunk)
        while i < j and not (chunk[i].isalnum() or chunk[i] in LOOKALIKES):
            i += 1
        while i < j and not (chunk[j - 1].isalnum() or chunk[j - 1] in LOOKALIKES):
            j -= 1
        core = chunk[i:j]
        if ODD.search(core):
            return found, [self.decode(core)]
        if doubled:
            return found, [x for w in found if DOUBLED.search(w) and (x := self.undoubled(w)) != w]
        return found, []

    def words(self, chunk: str) -> tuple[str, ...]:
        plain, restored = self.split(chunk)
        return (*plain, *restored)

    def spaced(self, text: str) -> list[str]:
        """Words written with marks or spaces between their letters."""
        if not self.restore:
            return []
        return [w for m in SPACED.finditer(text) for w in self.kept(m[0], lambda m=m: self.best(self.arcs(m[0], True))[1]).split("$") if w]


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n`` over all texts: runs of letters in lower case."""

    def run(batches):
        held: Counter = Counter()

        def out():
            words: Counter = Counter()
            for chunk, n in held.items():
                for w in [chunk] if chunk.isalpha() else WORD.findall(chunk):
                    words[w] += n
            held.clear()
            keys = list(words)
            for at in range(0, len(keys), 50_000):
                some = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, type=pa.string()), pa.array([words[w] for w in some], type=pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in slices(batch, text_col):
                for text in part.column(0).to_pylist():
                    if text:
                        held.update(text.lower().split())
                if len(held) > 400_000:
                    yield from out()
        yield from out()

    return df.select(text_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def language_model(words: DataFrame) -> np.ndarray:
    """Bucket weights of 1- to 3-grams and their contexts: an array of BUCKETS numbers."""

    def run(batches):
        total = np.zeros(BUCKETS)
        grams: dict[str, float] = {}
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                weight, w = math.log2(1 + n), "^^" + word + "$"
                for i in range(2, len(w)):
                    g = w[i - 2 : i + 1]
                    grams[g] = grams.get(g, 0.0) + weight
        for g, weight in grams.items():
            for key in ("3" + g, "2" + g[1:], "1" + g[2:], "c" + g[:2], "c" + g[1:2], "c"):
                total[_bucket(key)] += weight
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, type=pa.int32()), pa.array(total[some])], names=["bucket", "weight"])

    got = words.select("word", "n").mapInArrow(run, "bucket int, weight double").groupBy("bucket").agg(F.sum("weight").alias("weight")).toPandas()
    out = np.zeros(BUCKETS)
    out[got["bucket"].to_numpy()] = got["weight"].to_numpy()
    return out


def _single(word: str) -> str:
    """The mark of a restored word whose doubled letters may have been lost or added."""
    return "~" + DOUBLED.sub(r"\1", word)


def _forms(word: str, restored: bool) -> tuple[str, ...]:
    """A word, its beginning (five letters) if it is longer, and its mark if it was restored."""
    return (word, *(("^" + word[:5],) if len(word) > 5 else ()), *((_single(word),) if restored else ()))


def _of_chunk(channel: Channel, chunk: str) -> tuple[str, ...]:
    plain, restored = channel.split(chunk)
    return tuple(x for words, odd in ((plain, False), (restored, True)) for w in words if w for x in _forms(w, odd))


def _features(channel: Channel, text: str | None, cache: dict, known=None) -> set[str]:
    """Restored words of a text in all their forms; with ``known`` those of them that it holds.

    ``cache`` keeps what a part between white space gives, so a cache goes with one ``known``.
    """
    if not text:
        return set()
    low, out = text.lower(), set()
    for chunk in set(low.split()):
        got = cache.get(chunk)
        if got is None:
            got = _of_chunk(channel, chunk)
            if known is not None:
                got = tuple(w for w in got if w in known)
            if len(cache) > CACHE:
                cache.clear()
            cache[chunk] = got
        if got:
            out.update(got)
    for w in channel.spaced(low):
        out.update(x for x in _forms(w, True) if known is None or x in known)
    return out


def fit_lexicon(train: DataFrame, counts: np.ndarray, text_col: str, label_col: str, min_support: int = 3, least: float = 0.7, size: int = 5_000, restore: bool = True) -> tuple[dict[str, float], float]:
    """(probability of the label given a word, probability without any such word).

    Candidates are the ``size`` most frequent words of at least ``min_support`` texts of label
    1 whose share of label 1 is at least ``least``.  A greedy cover then takes the word that
    explains most texts of label 1 as yet unexplained, while it explains ``min_support`` and
    more than it has texts of label 0, so that words that merely come along stay out.
    ``train`` is a bounded sample; what the driver gets is its texts of label 1, as word numbers.
    """
    shared = train.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        channel, cache, pos, neg = Channel(shared.value, restore), {}, Counter(), Counter()
        for batch in batches:
            for part in slices(batch, text_col):
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    (pos if label == 1 else neg).update(x for x in _features(channel, text, cache) if x[0] != "~")
        words = list(pos | neg)
        for at in range(0, len(words), 50_000):
            some = words[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, type=pa.string()), pa.array([pos[w] for w in some], type=pa.int64()), pa.array([neg[w] for w in some], type=pa.int64())], names=["word", "pos", "neg"])

    table = train.select(text_col, label_col).mapInArrow(run, "word string, pos bigint, neg bigint").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    chosen = table.filter((F.col("pos") >= min_support) & (F.col("pos") / (F.col("pos") + F.col("neg") + 1) >= least))
    rows = chosen.orderBy(F.desc("pos"), "word").limit(size).collect()
    number = train.sparkSession.sparkContext.broadcast({r["word"]: i for i, r in enumerate(rows)})

    def contained(batches):
        channel, cache = Channel(shared.value, restore), {}
        for batch in batches:
            for part in slices(batch, text_col):
                found = [sorted(number.value[w] for w in _features(channel, t, cache, number.value)) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.list_(pa.int32()))], names=["words"])

    open_ = [set(r["words"]) for r in train.filter(F.col(label_col) == 1).select(text_col).mapInArrow(contained, "words array<int>").collect()]
    lexicon: dict[str, float] = {}
    while True:
        left = Counter(i for words in open_ for i in words)
        best = max(((n - rows[i]["neg"], n, -i) for i, n in left.items()), default=None)
        if best is None or best[0] <= 0 or best[1] < min_support:
            break
        r = rows[-best[2]]
        lexicon[r["word"]] = max(0.5, r["pos"] / (r["pos"] + r["neg"] + 1))
        open_ = [words for words in open_ if -best[2] not in words]
    # A restored word is also known by its letters without doubling, but for short words, which would be mistaken.
    for word, p in list(lexicon.items()):
        if len(word) >= 5 and word[0] != "^":
            lexicon[_single(word)] = max(p, lexicon.get(_single(word), 0.0))
    known = train.sparkSession.sparkContext.broadcast(set(lexicon))

    def rest(batches):
        channel, cache = Channel(shared.value, restore), {}
        for batch in batches:
            for part in slices(batch, text_col):
                labels = [label for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if not _features(channel, text, cache, known.value)]
                yield pa.RecordBatch.from_arrays([pa.array([sum(x == 1 for x in labels)], type=pa.int64()), pa.array([len(labels)], type=pa.int64())], names=["pos", "n"])

    left = train.select(text_col, label_col).mapInArrow(rest, "pos bigint, n bigint").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).first()
    base = ((left["pos"] or 0) + 0.5) / ((left["n"] or 0) + 2)
    return lexicon, min(base, 0.49)


def toxicity_scores(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = 20_000,
    lexicon_size: int = 5_000,
    restore: bool = True,
) -> DataFrame:
    """``id, held_out, score, predicted`` of every row.

    Labels are learned from the rows of ``labels`` whose crc32(id as text) modulo 5 isn't 0,
    from at most ``max_labelled`` of them, those of the smallest hash.  A document's score is
    1 less the product, over its words in the lexicon, of 1 less their probability; without
    any such word it is the rate of label 1 among such training texts, under one half.  Equal
    texts of equal label are learned from once.  The lexicon is taken from the ``lexicon_size`` most
    frequent words that training texts of label 1 have nearly to themselves.  Without ``restore``
    words count as they are written, which is for comparison.  Null
    and empty texts have no words.  Rows with null or conflicting labels are left out of the
    training; ids are passed on, null or repeated, other columns are left out.
    """
    spark = df.sparkSession
    counts = language_model(word_counts(df, text_col))
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (crc_fold(id_col) != 0))
    usable = usable.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__label"), F.max(label_col).alias("__most")).filter("__label = __most").select("__id", "__label")
    sample = usable.orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    train = stored(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "__id").select("text", F.col("__label").alias("label")).dropDuplicates(), "labelled")
    lexicon, base = fit_lexicon(train, counts, "text", "label", size=lexicon_size, restore=restore)
    discard(train)
    shared = spark.sparkContext.broadcast((counts, lexicon, base))

    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), F.col(text_col), (crc_fold(id_col) == 0).alias("__held"))

    def run(batches):
        counts, lexicon, base = shared.value
        channel, cache = Channel(counts, restore), {}

        def score(text):
            hits = _features(channel, text, cache, lexicon)
            if not hits:
                return base
            told = {_single(w) for w in hits if w[0] != "~"}  # a word and its mark are one finding
            return 1 - math.prod(1 - lexicon[w] for w in sorted(hits - told))

        for batch in batches:
            for part in slices(batch, text_col):
                scores = [score(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(scores, type=pa.float64()), pa.array([int(s >= 0.5) for s in scores], type=pa.int32())], names=[id_col, "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int")

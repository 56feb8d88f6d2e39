"""Toxicity scores from a counterfactual-regularised classifier.

A text is the set of its lower-cased words and of the first three to eight letters of each. A sparse
logistic regression is fitted on a bounded sample of labelled rows. Where a labelled sentence
names a group, copies with each other term of the same set in its place are made, and the
fit also pays for the squared change of the score between a text and its copies. So the
terms themselves cannot carry a verdict, however they are spread over the labels.

Terms come from two places: written sets for groups of people, and pairs found in the sample, words that stand in
the same place of sentences that are otherwise equal and that toxic and other texts use about
equally often. What is swapped there changes no label either.

The fit minimises the mean logistic loss, both kinds weighing the same, + ``sparse`` * |w| + ``fair`` * mean squared change by proximal gradient
steps. Everything else runs over all rows: each worker holds the non-zero weights only.

NULL and empty texts score as the intercept alone. Labels that are NULL are left out; a document with
several labels counts as toxic if one says so. Repeated rows are scored alike.
Without labelled rows of both kinds every text scores 0 or 1, as the only kind there is, or 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import ship

#: Labelled rows that the fit reads, at most half of them toxic; they are the first by a hash of their id.
FIT_ROWS = 5_000
#: Word pairs that are found in the sample, and swapped copies that one text gets of them.
PAIRS, PAIR_COPIES = 200, 3
#: Words of a sentence in which a pair may be found, and the texts of each kind in which each word has to occur.
SENTENCE_WORDS, BOTH_KINDS = range(4, 31), 3
#: Places of words that a task sends at once.
SLOTS_SENT = 20_000
PREFIXES = range(3, 9)
SPARSE, FAIR, STEPS = 1e-3, 1.0, 200
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: Words whose active features a worker remembers.
REMEMBERED = 500_000

#: Fixed sets of terms for groups of people; a term is swapped with the others of its set.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("gay", "lesbian", "straight", "bisexual", "heterosexual", "homosexual", "transgender", "queer"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("german", "french", "spanish", "american", "mexican", "chinese", "indian", "turkish", "polish"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly"),
    ("blind", "deaf", "disabled"),
    ("muslime", "christen", "juden", "hindus", "buddhisten"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("ausländer", "flüchtlinge", "einheimische"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes"),
    ("femmes", "hommes", "filles", "garçons"),
    ("étrangers", "réfugiés", "immigrés"),
    ("musulmanes", "cristianos", "judíos", "budistas"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("extranjeros", "refugiados", "inmigrantes"),
)


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings; a whole word is told apart from an equal beginning."""
    return [zlib.crc32(f"{word} ".encode()), *(zlib.crc32(word[:k].encode()) for k in PREFIXES if k <= len(word))]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def text_features(words: set[str]) -> np.ndarray:
    return np.unique(np.fromiter((f for w in words for f in word_features(w)), np.uint32))


def others_of(terms: Sequence[Sequence[str]]) -> dict[str, list[str]]:
    """For each term the others of its sets."""
    others: dict[str, list[str]] = {}
    for group in terms:
        for t in group:
            others.setdefault(t, []).extend(o for o in group if o != t and o not in others.get(t, ()))
    return others


def swapped(text: str | None, others: dict[str, list[str]]) -> Iterator[set[str]]:
    """The words of each copy of ``text`` in which one term of one sentence gives way to another; made one by one."""
    sentences = [WORD.findall(s) for s in SENTENCE.findall((text or "").lower())]
    for k, sentence in enumerate(sentences):
        found = sorted(set(sentence) & others.keys())
        if found:
            rest = {w for j, s in enumerate(sentences) if j != k for w in s}
            for term in found:
                for other in others[term]:
                    yield rest | {other if w == term else w for w in sentence}


def swaps(text: str | None, terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[set[str]]:
    """All copies of ``text`` in which one identity term of one sentence gives way to another of its set."""
    return list(swapped(text, others_of(terms)))


@dataclass
class Model:
    intercept: float
    weights: dict[int, float] = field(default_factory=dict)

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        active, out = _Active(self.weights), np.empty(len(texts))
        for i, text in enumerate(texts):
            features = set()
            for found in map(active.__getitem__, words_of(text)):
                features.update(found)
            out[i] = self.intercept + sum(self.weights[f] for f in sorted(features))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


class _Active(dict):
    """The features of each word that have a weight, remembered."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = tuple(f for f in word_features(word) if f in self.weights)
        return found


class _Rows:
    """Sparse rows of ones and minus ones."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.at = np.repeat(np.arange(self.n), [len(i) for i, _ in rows])
        self.column = np.concatenate([i for i, _ in rows]) if rows else np.empty(0, np.int64)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.empty(0)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * w[self.column], self.n)

    def transposed_times(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.at], width)


def fit(
    rows: list[np.ndarray], toxic: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]],
    sparse: float = SPARSE, fair: float = FAIR, steps: int = STEPS,
) -> Model:
    """Fit on feature sets. ``changes``: for each swapped copy, the features it loses and those it gains."""
    if len(rows) == 0 or toxic.min() == toxic.max():
        return Model(500.0 if len(rows) and toxic[0] else -500.0)
    weight = np.where(toxic > 0, 0.5 / toxic.sum(), 0.5 / (1 - toxic).sum())  # both kinds weigh the same
    # Only features whose pull at the start exceeds the price of a weight are worth holding.
    known, pull = np.empty(0, np.uint32), np.empty(0)
    for kind in (False, True):
        own = [r for r, y in zip(rows, toxic) if (y > 0) == kind]
        found, times = np.unique(np.concatenate(own), return_counts=True)
        both = np.union1d(known, found)
        total = np.zeros(len(both))
        total[np.searchsorted(both, known)] = pull
        total[np.searchsorted(both, found)] += times * (0.25 if kind else -0.25) / len(own)
        known, pull = both, total
    kept = known[np.abs(pull) > sparse]

    def indexed(features: np.ndarray) -> np.ndarray:
        i = np.searchsorted(kept, features)
        i[i == len(kept)] = 0
        return i[kept[i] == features] if len(kept) else i[:0]

    ones = [indexed(r) for r in rows]
    x = _Rows([(i, np.ones(len(i))) for i in ones])
    moved = []
    for lost, gained in changes:
        a, b = indexed(lost), indexed(gained)
        moved.append((np.concatenate([a, b]), np.concatenate([np.ones(len(a)), -np.ones(len(b))])))
    d = _Rows(moved)
    width = max(len(kept), 1)

    def curvature(v: np.ndarray) -> np.ndarray:
        out = x.transposed_times(weight * (x.times(v[:-1]) + v[-1]) / 4, width)
        if d.n:
            out = out + 2 * fair / d.n * d.transposed_times(d.times(v[:-1]), width)
        return np.append(out, (weight * (x.times(v[:-1]) + v[-1])).sum() / 4)

    probe = np.random.default_rng(5).random(width + 1)
    top = 1.0
    for _ in range(30):
        probe = curvature(probe)
        top = float(np.linalg.norm(probe))
        probe = probe / top
    step = 1 / (1.1 * top)
    w = np.zeros(width + 1)
    ahead, pace = w.copy(), 1.0
    for _ in range(steps):
        error = weight * (1 / (1 + np.exp(-(x.times(ahead[:-1]) + ahead[-1]))) - toxic)
        slope = np.append(x.transposed_times(error, width), error.sum())
        if d.n:
            slope[:-1] += 2 * fair / d.n * d.transposed_times(d.times(ahead[:-1]), width)
        new = ahead - step * slope
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * sparse, 0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, w, pace = new + (pace - 1) / faster * (new - w), new, faster
    return Model(float(w[-1]), {int(f): float(v) for f, v in zip(kept, w) if v})


def training_rows(docs: DataFrame, labels: DataFrame, eligible: Column, rows: int = FIT_ROWS) -> DataFrame:
    """The bounded sample of labelled rows (doc_id, toxic, text): at most ``rows``, half of each kind where there are enough.

    Only the ids and labels of at most ``rows`` rows are broadcast.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(eligible)
    drawn = None
    for kind in (0, 1):
        own = known.where((F.col("toxic") > 0) == F.lit(bool(kind)))
        # A cut by the hash leaves somewhat more rows than wanted; of these the first by hash and id, whatever the order of files.
        share = min(1.0, 1.3 * rows / 2 / max(own.count(), 1))
        hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
        part = own.where(hashed < int(share * (1 << 30))).orderBy(hashed, "doc_id").limit(rows // 2)
        part = part.withColumn("toxic", F.lit(kind))
        drawn = part if drawn is None else drawn.unionByName(part)
    # Of rows with equal ids the least text is read.
    held = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return held.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def _slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each word of each sentence a hash of the rest of the sentence around it, a bounded number of rows at a time."""
    import xxhash

    slots: list[int] = []
    held: list[str] = []
    for batch in batches:
        for text in batch["text"]:
            for sentence in SENTENCE.findall((text or "").lower()):
                words = WORD.findall(sentence)
                if len(words) in SENTENCE_WORDS:
                    slots += [xxhash.xxh3_64_intdigest(" ".join([*words[:i], "\0", *words[i + 1 :]])) - (1 << 63) for i in range(len(words))]
                    held += words
                if len(slots) >= SLOTS_SENT:
                    yield pd.DataFrame({"slot": slots, "word": held})
                    slots, held = [], []
    yield pd.DataFrame({"slot": pd.Series(slots, dtype="int64"), "word": pd.Series(held, dtype=object)})


def like_words(sample: DataFrame, most: int = PAIRS) -> list[tuple[str, str]]:
    """Pairs of words found in the same slot of ``sample`` (toxic, text), used by both kinds of text at rates within a factor of two.

    At most ``most`` pairs, those of the most slots first. The sample is bounded, and so is what comes back.
    """
    ship(sample.sparkSession)
    slots = sample.select("text").mapInPandas(_slots, "slot long, word string").distinct()
    pairs = slots.groupBy("slot").agg(F.min("word").alias("a"), F.max("word").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
    kinds = sample.groupBy().agg(F.count_if(F.col("toxic") > 0).alias("t"), F.count_if(F.col("toxic") == 0).alias("f")).first()
    words = sample.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))).alias("word"))
    used = words.groupBy("word").agg(F.count_if(F.col("toxic") > 0).alias("t"), F.count_if(F.col("toxic") == 0).alias("f"))
    rate = (F.col("t") * max(kinds["f"], 1)) / (F.col("f") * max(kinds["t"], 1))
    even = used.where((F.col("t") >= BOTH_KINDS) & (F.col("f") >= BOTH_KINDS)).where(rate.between(0.5, 2.0)).select("word")
    found = pairs.join(even.withColumnRenamed("word", "a"), "a", "left_semi").join(even.withColumnRenamed("word", "b"), "b", "left_semi")
    return [(r["a"], r["b"]) for r in found.orderBy(F.desc("n"), "a", "b").limit(most).collect()]


def train(sample: DataFrame, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, pairs: int = PAIRS, **settings) -> Model:
    """Fit on ``sample`` (toxic, text), whose features are made in tasks and gathered."""
    written, found_pairs = others_of(terms), others_of(like_words(sample, pairs) if pairs else [])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for toxic, text in zip(batch["toxic"], batch["text"]):
                own = text_features(words_of(text))
                lost, gained = [], []
                for copy in chain(swapped(text, written), islice(swapped(text, found_pairs), PAIR_COPIES)):
                    other = text_features(copy)
                    lost.append(np.setdiff1d(own, other, assume_unique=True).tobytes())
                    gained.append(np.setdiff1d(other, own, assume_unique=True).tobytes())
                out.append((int(toxic), own.tobytes(), lost, gained))
            yield pd.DataFrame(out, columns=["toxic", "own", "lost", "gained"])

    ship(sample.sparkSession)
    schema = "toxic int, own binary, lost array<binary>, gained array<binary>"
    found = sorted(sample.mapInPandas(features, schema).collect(), key=lambda r: bytes(r["own"]))  # sums do not depend on the order of tasks

    def unpack(held) -> np.ndarray:
        return np.frombuffer(bytes(held), np.uint32)

    changes = [(unpack(a), unpack(b)) for r in found for a, b in zip(r["lost"], r["gained"])]
    return fit([unpack(r["own"]) for r in found], np.array([r["toxic"] for r in found], float), changes, **settings)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Add the score of every row of ``docs`` as column ``name``; a column of that name gives way."""
    held = docs.drop(name)
    spark = docs.sparkSession
    ship(spark)
    model_there = spark.sparkContext.broadcast(model)  # bounded: weights of features of the sample

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model_there.value.score(texts.tolist()))

    return held.withColumn(name, scored(F.coalesce("text", F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame, eligible: Column | None = None) -> DataFrame:
    """Fit on the labelled rows that are ``eligible`` (a condition on doc_id) and score every row of ``docs``."""
    sample = training_rows(docs, labels, F.lit(True) if eligible is None else eligible)
    return score(docs, train(sample))

"""Counterfactual-regularised toxicity classifier.

Features of a text are its distinct words and their beginnings (4 and 5 letters), hashed. Only features that are seen in
enough toxic sample texts, and clearly more often there than elsewhere, keep a weight of their own; evidence therefore
doesn't pile up with a text's length. Before fitting, each sampled sentence with an identity term gets copies with the term
swapped for others, and neutral sentences get a term inserted; the fit penalises any change of score between the copies, so
that a neutral mention of a group carries no weight even where the sample links it with toxic texts.

The model is fitted on the driver on at most ``sample_rows`` labelled rows, chosen by a hash of the id; texts stay on the
executors. There their features are counted by class, and only those that will have a weight are sent to the driver: of pairs
the ones that differ, each different pair once with its count, as the penalty needs no more. The weights (at most
``2 ** BITS`` numbers) are broadcast, and every whole text is scored by one pass.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import by_bytes, cut
from graphloom.llm.linear import Rows, fit
from graphloom.shipping import shipped

BITS = 20
SAMPLE_ROWS = 12_000
THRESHOLD = 0.7
PAIR_WEIGHT = 10.0
COPIES = 3
CACHE_WORDS = 100_000

#: Identity terms; only their own score changes are penalised, and no score uses them otherwise. A parameter.
IDENTITY_TERMS = (
    "women men woman man girls boys gay lesbian straight trans christian christians muslim muslims jewish jews hindu buddhist atheist "
    "black white asian african american european latino immigrant immigrants refugees disabled deaf blind old young elderly "
    "frauen männer juden muslime christen femmes hommes juifs musulmans chrétiens mujeres hombres judíos musulmanes cristianos"
).split()

_WORD = re.compile(r"[^\W_]+")


def features_of(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: itself, and its first 4 and 5 letters if it is longer."""
    mask = (1 << BITS) - 1
    names = [f"w {word}"] + [f"{n} {word[:n]}" for n in (4, 5) if len(word) > n]
    return tuple(zlib.crc32(n.encode("utf-8", "surrogatepass")) & mask for n in names)


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def text_features(words: set[str]) -> np.ndarray:
    return np.unique(np.fromiter((f for w in words for f in features_of(w)), np.int64))


def counterfactuals(text: str, terms: tuple[str, ...], seed: int, copies: int = COPIES) -> list[tuple[set[str], set[str]]]:
    """Pairs of word sets of sentences that must score alike.

    Sentences with a term get the term swapped for ``copies`` others; a text without any term gets one of its sentences with
    and without an inserted term. Terms and sentence go round with ``seed``, so a run can be repeated.
    """
    known = set(terms)
    sentences = [s for s in re.split(r"[.!?\n]+", text) if s.strip()]
    out = []
    for n, sentence in enumerate(sentences):
        words = words_of(sentence)
        for term in sorted(words & known):
            for c in range(copies):
                other = terms[(seed + 7 * n + c) % len(terms)]
                if other != term:
                    out.append((words, (words - {term}) | {other}))
    if not out and sentences and terms:
        words = words_of(sentences[seed % len(sentences)])
        out.append((words, words | {terms[seed % len(terms)]}))
    return out


def difference(a: set[str], b: set[str]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Features of a pair that only one side has: the others don't change its difference of scores."""
    of = lambda words: {f for w in words for f in features_of(w)}
    left, right = of(a - b), of(b - a)
    common = (left & right) | (of(a & b) & (left | right))
    return tuple(sorted(left - common)), tuple(sorted(right - common))


class Model:
    """Weights of words, by a bounded cache over the hashed features."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept, self.cache = weights, intercept, {}

    def _value(self, word: str) -> float:
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        v = self.cache[word] = float(sum(self.weights[f] for f in features_of(word)))
        return v

    def score(self, text: str) -> float:
        words, cache = words_of(text), self.cache
        try:
            total = sum(map(cache.__getitem__, words))
        except KeyError:
            total = sum(cache[w] if w in cache else self._value(w) for w in words)
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, total + self.intercept))))


#: A feature has a weight if it is in so many toxic texts of the sample at least, and so many times as often there as elsewhere.
LEAST_TOXIC, LEAST_RATIO = 3, 3


def is_telling(n1, n0, toxic: float, others: float):
    """Whether features that are in ``n1`` toxic and ``n0`` other texts have a weight: of numbers, arrays or columns."""
    return (n1 >= LEAST_TOXIC) & ((n1 + 0.1) / max(1.0, toxic) >= LEAST_RATIO * (n0 + 0.1) / max(1.0, others))


def among(features: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of those features in the sorted array ``known`` that are there."""
    if not len(known):
        return np.empty(0, np.int64)
    at = np.searchsorted(known, features)
    at[at == len(known)] = 0
    return at[known[at] == features]


def fit_rows(rows: list[tuple[np.ndarray, int]], pairs: list[tuple[np.ndarray, np.ndarray]], pair_weight: float = PAIR_WEIGHT, counts: np.ndarray | None = None) -> Model:
    """A model of sample rows (features, label) and counterfactual pairs, which ``counts`` may weight."""
    y = np.array([label for _, label in rows], float)
    flat = np.concatenate([f for f, _ in rows]) if rows else np.empty(0, np.int64)
    names, at = np.unique(flat, return_inverse=True)
    toxic = np.repeat(y > 0, [len(f) for f, _ in rows])
    # The rest has no weight at any length of text.
    known = names[is_telling(np.bincount(at, toxic, len(names)), np.bincount(at, ~toxic, len(names)), (y > 0).sum(), (y <= 0).sum())]
    sample = Rows([among(f, known) for f, _ in rows])
    both = Rows([among(a, known) for a, _ in pairs]), Rows([among(b, known) for _, b in pairs])
    w, b = fit(sample, y, len(known), l2=3e-6, steps=250, pairs=both, pair_weight=pair_weight, counts=counts)
    weights = np.zeros(1 << BITS, np.float32)
    weights[known.astype(np.int64)] = w
    return Model(weights, float(b))


def _featurise(terms: tuple[str, ...]):
    """Features of each sampled text, and the different pairs of it with their counts."""
    ints, nested = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 3):
            out: tuple[list, ...] = [], [], [], []
            for text, h in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = Counter(difference(a, b) for a, b in counterfactuals(text or "", terms, h & 0xFFFF))
                for column, value in zip(out, (text_features(words_of(text or "")), [a for a, _ in found], [b for _, b in found], list(found.values())), strict=True):
                    column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(out, (ints, nested, nested, pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(4), *arrays], names=["__id", "y", "t", "f", "a", "b", "n"])

    return run


def _narrow(known: np.ndarray):
    """The same rows with those features only that have a weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = lambda f: known[among(np.asarray(f, np.int64), known)]
        for batch in batches:
            f, a, b = (batch.column(k).to_pylist() for k in (1, 2, 3))
            sides = [pa.array([[keep(x) for x in pairs] for pairs in side], pa.list_(pa.list_(pa.int32()))) for side in (a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([keep(x) for x in f], pa.list_(pa.int32())), *sides, batch.column(4)], names=["y", "f", "a", "b", "n"])

    return run


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int, terms: tuple[str, ...]):
    """Features and labels of a bounded sample, all counterfactual pairs of its texts, and their counts.

    Texts and their features stay on the executors: only features that have a weight come to the driver, and of pairs each
    different one with its count. An id that several rows have gives one row, that with the least hash of its text.
    """
    named = labels.select(F.col(id_col).alias("__lid"), F.col(label_col).cast("int").alias("y"), F.xxhash64(F.col(id_col), F.lit(5)).alias("h")).dropna()
    # The least hashes, in halves by class, so that rare toxic rows are all there. Only ids and labels are sorted.
    half = sample_rows // 2
    chosen = named.filter("y > 0").orderBy("h", "__lid").limit(half).unionByName(named.filter("y <= 0").orderBy("h", "__lid").limit(sample_rows - half))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen.distinct()), F.col("__id") == F.col("__lid")).select("__id", "y", "h", "text", F.xxhash64("text").alias("t"))
    pairs_of = "a array<array<int>>, b array<array<int>>, n array<long>"
    found = shipped(rows).mapInArrow(_featurise(terms), f"__id {rows.schema['__id'].dataType.simpleString()}, y int, t long, f array<int>, {pairs_of}")
    found = cut(found.groupBy("__id", "y").agg(F.min_by(F.struct("f", "a", "b", "n"), "t").alias("r")).select("y", "r.*"))

    sizes = {r.toxic: r["count"] for r in found.groupBy((F.col("y") > 0).alias("toxic")).count().collect()}
    seen = found.select((F.col("y") > 0).cast("int").alias("one"), F.explode("f").alias("x")).groupBy("x").agg(F.sum("one").alias("n1"), F.sum(1 - F.col("one")).alias("n0"))
    telling = seen.filter(is_telling(F.col("n1"), F.col("n0"), sizes.get(True, 0), sizes.get(False, 0))).select("x").toArrow()
    known = np.sort(telling.column(0).to_numpy()).astype(np.int64)

    short = cut(shipped(found).mapInArrow(_narrow(known), f"y int, f array<int>, {pairs_of}"))
    array_of = lambda x: np.asarray(x, np.int64)
    table = short.select("f", "y").toArrow()
    sample = [(array_of(f.values), y) for f, y in zip(table.column("f"), table.column("y").to_pylist(), strict=True)]
    # Rows come in any order; the fit must not depend on it.
    sample.sort(key=lambda r: (r[1], len(r[0]), r[0].tobytes()))
    pairs = short.select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("n")).collect()
    pairs.sort(key=lambda r: (r.a, r.b))
    return sample, [(array_of(r.a), array_of(r.b)) for r in pairs], np.array([r.n for r in pairs], float)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, terms: tuple[str, ...] = tuple(IDENTITY_TERMS)) -> Model:
    """A model of at most ``sample_rows`` labelled rows. Rows without id, label or text, and labels without document, give nothing."""
    sample, pairs, counts = training_sample(docs, labels, id_col, text_col, label_col, sample_rows, terms)
    return fit_rows(sample, pairs, counts=counts)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: its id, ``score`` (0 to 1) and ``predicted`` (1 from the threshold on).

    Null and empty texts get the score of a text without evidence, that is the intercept's. Repeated rows score alike, null
    ids are kept. Only the text is looked at. A model fitted without labels scores every text 0.5.
    """
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    handle = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*handle.value)
        for batch in by_bytes(batches, 1):
            scores = pa.array([own.score(t or "") for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["__id", "score"])

    out = shipped(source).mapInArrow(run, f"__id {source.schema['__id'].dataType.simpleString()}, score double")
    return out.select(F.col("__id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all columns, in one pass without a join."""
    handle = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*handle.value)
        for batch in by_bytes(batches, at):
            yield batch.filter(pa.array([own.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return shipped(docs).mapInArrow(run, docs.schema)

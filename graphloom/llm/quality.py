"""Quality by hierarchical empirical Bayes: a document's own evidence, and what its host and path have shown.

A logistic regression on the text's shape (character classes, word and line repetition, lengths), fitted on a bounded sample of labelled
rows, gives each document a probability of being good. These are averaged by path (a part of a host), by host, and overall,
by partial aggregation. A host's mean is shrunk towards the global mean, and a path's mean towards its host's, the more so the fewer
documents it has; how strongly follows from the variance between groups beyond what chance explains (method of moments). A
document's final odds are its own odds times its path's posterior odds over the global odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import as_bytes, cut
from graphloom.llm.linear import sigmoid
from graphloom.shipping import shipped

SAMPLE_ROWS = 20_000
THRESHOLD = 0.5

_KIND = np.zeros(256, np.int64)  # 0: other ASCII marks
for _b in range(256):
    _KIND[_b] = 1 if 97 <= _b <= 122 else 2 if 65 <= _b <= 90 else 3 if 48 <= _b <= 57 else 4 if _b == 32 else 5 if _b == 10 else 6 if _b >= 128 else 7 if chr(_b) in ".,;:" else 8 if chr(_b) in "|<>{}[]" else 0
NAMES = ["log_bytes", "lower", "upper", "digit", "space", "line", "beyond_ascii", "stops", "frames", "marks", "word_bytes", "distinct_words", "distinct_lines", "stops_a_word", "words_a_line", "marks_a_word", "top_word"]


def shape(text: bytes) -> list[float]:
    """The features of one text, in the order of ``NAMES``; an empty text has zeros."""
    n = len(text)
    counts = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=9) if n else np.zeros(9)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    m = max(1, n)
    w = max(1, len(words))
    kinds = len(set(words))
    # Distinct words among texts of any length: compared with what a text of that length has by rule of thumb (n ** 0.9).
    return [
        float(np.log1p(n)), *(float(counts[k]) / m for k in (1, 2, 3, 4, 5, 6, 7, 8, 0)), n / w, kinds / w**0.9 if words else 0.0,
        len(set(lines)) / max(1, len(lines)), float(counts[7]) / w, w / max(1, len(lines)) / 100, float(counts[0]) / w, 1 - kinds / w,
    ]


class ShapeModel:
    """Logistic regression on standardised features and their squares."""

    def __init__(self, mean, scale, weights, intercept):
        self.mean, self.scale, self.weights, self.intercept = mean, scale, weights, intercept

    def _z(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z], 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self._z(x) @ self.weights + self.intercept)


def fit_shape(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 30) -> ShapeModel:
    """By Newton's method, which takes a few steps for so few features."""
    width = len(NAMES)
    if not len(x):
        return ShapeModel(np.zeros(width), np.ones(width), np.zeros(2 * width), 0.0)
    model = ShapeModel(x.mean(0), x.std(0) + 1e-6, np.zeros(2 * width), 0.0)
    z = np.concatenate([model._z(x), np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    ridge = np.r_[np.full(2 * width, l2), 1e-6]
    for _ in range(steps):
        p = sigmoid(z @ w)
        h = (z * (p * (1 - p) / len(y))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(h, z.T @ (y - p) / len(y) - ridge * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    model.weights, model.intercept = w[:-1], float(w[-1])
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> ShapeModel:
    """A model of at most ``sample_rows`` labelled rows, those with the least hashes; whole texts, of which only features leave the executors."""
    named = labels.select(F.col(id_col).alias("__lid"), F.col(label_col).cast("int").alias("y"), F.xxhash64(F.col(id_col), F.lit(7)).alias("h")).dropna()
    chosen = named.orderBy("h", "__lid").limit(sample_rows).select("__lid", "y").distinct()
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("__id") == F.col("__lid")).select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shape(t or b"") for t in as_bytes(batch.column(0)).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    table = shipped(rows).mapInArrow(run, "x array<double>, y int").toArrow()
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    order = np.lexsort(x.T) if len(x) else np.empty(0, np.int64)  # rows come in any order
    return fit_shape(x[order], np.array(table.column("y").to_pylist(), float)[order])


def document_scores(docs: DataFrame, model: ShapeModel, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """``id, host, path, p``: each document's own probability of being good."""
    source = docs.select(F.col(id_col).alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = handle.value
        for batch in batches:
            texts = as_bytes(batch.column(3)).to_pylist()
            p = own.predict(np.array([shape(t or b"") for t in texts], float)) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(p, pa.float64())], names=["id", "host", "path", "p"])

    return shipped(source).mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, host string, path string, p double")


def shrinkage(groups: DataFrame, prior: str) -> DataFrame:
    """One row: ``k``, the number of documents that the prior counts for, from groups of ``n``, ``mean`` and their ``prior`` mean.

    Between-group variance is what the groups' means vary beyond chance; without any, the prior counts for very much.
    """
    within = F.greatest(F.col(prior) * (1 - F.col(prior)), F.lit(1e-4))
    sums = groups.agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("mean") - F.col(prior)) ** 2).alias("ss"), F.count(F.lit(1)).alias("g"),
        (F.sum(F.col("n") * within) / F.sum("n")).alias("within"), F.sum(F.col("n") * F.col("n")).alias("n2"),
    )
    between = F.greatest((F.col("ss") - F.col("g") * F.col("within")) / F.greatest(F.col("n") - F.col("n2") / F.col("n"), F.lit(1.0)), F.col("within") / 1e5)
    return sums.select((F.col("within") / between).alias("k"))


def quality_scores(
    docs: DataFrame,
    model: ShapeModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: Column | None = None,
    path: Column | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``p_document, host_posterior, path_posterior, quality, kept``.

    Null and empty texts have the features' zeros and are judged like others; null hosts form one host, null paths one path
    of their host. A host of one document gets nearly the global mean. Repeated rows count in their site's mean like any row.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = cut(document_scores(docs, model, id_col, text_col, host, path))
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean"))
    paths = cut(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    whole = hosts.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("all"))  # one row, as are the shrinkages
    hosts = hosts.crossJoin(F.broadcast(whole))
    hosts = hosts.crossJoin(F.broadcast(shrinkage(hosts, "all")))
    hosts = cut(hosts.select(F.col("host").alias("h"), "all", ((F.col("n") * F.col("mean") + F.col("k") * F.col("all")) / (F.col("n") + F.col("k"))).alias("host_posterior")))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    paths = paths.crossJoin(F.broadcast(shrinkage(paths, "host_posterior")))
    sites = cut(paths.select("h", F.col("path").alias("q"), "all", "host_posterior", ((F.col("n") * F.col("mean") + F.col("k") * F.col("host_posterior")) / (F.col("n") + F.col("k"))).alias("path_posterior")))
    odds = lambda c: F.log(F.greatest(c, F.lit(1e-9)) / F.greatest(1 - c, F.lit(1e-9)))
    final = odds(F.col("p")) + odds(F.col("path_posterior")) - odds(F.col("all"))
    out = rows.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    out = out.select(F.col("id").alias(id_col), F.col("p").alias("p_document"), "host_posterior", "path_posterior", (1 / (1 + F.exp(-final))).alias("quality"))
    return out.withColumn("kept", F.col("quality") >= threshold)

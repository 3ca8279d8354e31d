"""Quality of documents by hierarchical empirical Bayes.

A logistic classifier of the text gives each document its own evidence.  The
sums of that evidence by host and by path below it are beta posteriors: a
host's mean is drawn towards the global mean, and a path's towards its
host's, by as many pseudo-documents as the spread of the groups' means in the
whole corpus calls for.  A sparse site so takes its parent's prior and a large
one keeps its own.  A document's posterior is its evidence on top of the prior
of its path, taken without the document itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.arrow import bound_batches, slices
from sievelight.llm.encoding import forget_encoders
from sievelight.llm.hashing import batches, word_hashes
from sievelight.llm.rows import drop_rows
from sievelight.plans.sizing import join_groups
from sievelight.plans.staging import stage

#: Labelled documents that the classifier is fitted on, at most: those with the least hash of their id.
TRAINING_ROWS = 20_000
#: Documents whose posterior is below this are rejected.
THRESHOLD = 0.5

_GROUPS = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"'\"-;:?()", b"!", b"|<>[]{}=\\/", b"#$%&*+@^_`~",
)
N_CLASSES = len(_GROUPS) + 2
_CLASS = np.full(256, len(_GROUPS), np.int64)
_CLASS[128:] = len(_GROUPS) + 1
for _k, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _k
PAIRS = N_CLASSES * N_CLASSES
#: Shares of neighbouring character classes, then length, distinct words, word length, repeated lines.
FEATURES = PAIRS + 4


def features(texts: list[str | None]) -> np.ndarray:
    """One row of ``FEATURES`` numbers a text; all zero for a null or empty one."""
    out = np.zeros((len(texts), FEATURES))
    for a, b in batches(texts):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]]
        lengths = np.array([len(p) for p in parts])
        classes = _CLASS[np.frombuffer(b"".join(parts), np.uint8)]
        owner = np.repeat(np.arange(b - a), lengths)
        if len(classes) > 1:
            within = owner[1:] == owner[:-1]
            code = (owner[1:] * PAIRS + classes[:-1] * N_CLASSES + classes[1:])[within]
            pairs = np.bincount(code, minlength=(b - a) * PAIRS).reshape(b - a, PAIRS)
            out[a:b, :PAIRS] = np.sqrt(pairs / np.maximum(1, lengths - 1)[:, None])
        words, at = word_hashes(texts[a:b])
        n_words = np.diff(at)
        order = np.lexsort((words, np.repeat(np.arange(b - a), n_words)))
        by_doc = np.repeat(np.arange(b - a), n_words)
        new = np.ones(len(words), bool)
        sorted_words = words[order]
        new[1:] = (sorted_words[1:] != sorted_words[:-1]) | (by_doc[1:] != by_doc[:-1])
        distinct = np.bincount(by_doc[new], minlength=b - a)
        some = np.maximum(1, n_words)
        out[a:b, PAIRS] = np.log1p(lengths) / 10
        out[a:b, PAIRS + 1] = distinct / some
        out[a:b, PAIRS + 2] = np.log1p(lengths / some)
        for k, t in enumerate(texts[a:b]):
            lines = (t or "").split("\n")
            out[a + k, PAIRS + 3] = 1 - len(set(lines)) / len(lines)
        out[a:b][lengths == 0] = 0
    return out


@dataclass(frozen=True)
class Classifier:
    """Weights of the standardised features; ``rate`` is the share of good documents it was fitted on."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    rate: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -30, 30)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 2.0, rounds: int = 25) -> Classifier:
    """Penalised logistic regression by Newton's method; without both kinds of labels only the rate is used."""
    rate = float((y.sum() + 1) / (len(y) + 2))
    mean = x.mean(0) if len(x) else np.zeros(FEATURES)
    scale = x.std(0) if len(x) else np.ones(FEATURES)
    scale = np.where(scale > 1e-6, scale, 1e9)  # a feature that never varies says nothing
    weights, bias = np.zeros(FEATURES), float(np.log(rate / (1 - rate)))
    if 0 < y.sum() < len(y):
        z = np.c_[(x - mean) / scale, np.ones(len(x))]
        ridge = np.r_[np.full(FEATURES, penalty), 1e-6]
        w = np.r_[weights, bias]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        weights, bias = w[:-1], float(w[-1])
    return Classifier(mean, scale, weights, bias, rate)


def _featurise(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_encoders()
    for batch in slices(batches_, 0):
        x = features(batch.column(0).to_pylist())
        flat = pa.array(x.reshape(-1))
        offsets = pa.array(np.arange(0, x.size + 1, FEATURES), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, flat), batch.column(1), batch.column(2)], names=["x", "y", "h"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS) -> Classifier:
    """Fit on at most ``rows`` labelled documents; a document's labels are averaged.

    Of the labels those with the least hash of their id count.  Rows equal in
    id and text are one, and of those that are left the ``rows`` with the
    least hash of id and text are fitted on, in that order, so that runs
    agree.  Null ids and labels count for nothing.
    """
    bound_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).where("__id is not null and __y is not null")
    known = known.groupBy("__id").agg((F.avg("__y") >= 0.5).cast("double").alias("__y"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)  # the broadcast below is of so many rows at most
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(known), "__id")
    # a document id that comes with several texts adds a row for each, so the bound is kept once more
    rank = found.select("__id", F.xxhash64("__id", "__text").alias("__h")).distinct().orderBy("__h", "__id").limit(rows)
    rank = stage(rank.select(F.col("__id").alias("__i"), "__h"), "quality-sample")
    same = (F.col("__id") == F.col("__i")) & (F.xxhash64("__id", "__text") == F.col("__h"))
    found = found.join(F.broadcast(rank), same).groupBy("__h", "__id", "__y").agg(F.first("__text").alias("__text"))
    made = found.select("__text", "__y", "__h").mapInArrow(_featurise, "x array<double>, y double, h long")
    table = made.orderBy("h").toArrow()
    x = np.asarray(table.column("x").combine_chunks().flatten()).reshape(-1, FEATURES) if len(table) else np.zeros((0, FEATURES))
    return fit(x, np.asarray(table.column("y")) if len(table) else np.zeros(0))


def _score(model, batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classifier: Classifier = model.value
    forget_encoders()
    for batch in slices(batches_, 1):
        logits = classifier.logits(features(batch.column(1).to_pylist()))
        columns = [batch.column(0), *batch.columns[2:], pa.array(logits)]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "host", "path", "logit"])


def _logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def _strength(groups: DataFrame, mean: str, prior: str) -> float:
    """Pseudo-documents of the prior by moments.

    ``groups`` has ``n`` and ``s`` (documents and the sum of their evidence),
    the group's mean, and its prior.  What the means vary beyond the variance
    within groups is the spread of the groups themselves.
    """
    g = groups.agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("nn"),
        F.sum(F.col("n") * (F.col(mean) - F.col(prior)) ** 2).alias("between"),
        F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("within"), F.sum(F.col("n") * F.col(prior) * (1 - F.col(prior))).alias("whole"),
    ).first()
    if not g.n or g.g < 2:
        return 10.0
    within, whole = g.within / g.n, g.whole / g.n
    spread = (g.between - (g.g - 1) * within) / max(1.0, g.n - g.nn / g.n)
    return float(min(1e4, max(1.0, whole / spread - 1))) if spread > 0 else 1e4


def score_documents(
    docs: DataFrame,
    model: Classifier,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``id_col, text_hash, evidence, host_quality, path_quality, score, keep`` for every row.

    Null and empty texts bring no evidence of their own beyond the
    classifier's constant; null hosts and paths are groups like others; null
    and repeated ids keep their rows (``text_hash`` tells them apart); an
    empty table gives no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"),
        F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"),
    )
    kind = dict(docs.dtypes)[id_col]
    scored = rows.mapInArrow(partial(_score, spark.sparkContext.broadcast(model)), f"id {kind}, text_hash long, host string, path string, logit double")
    scored = stage(scored.withColumn("p", 1 / (1 + F.exp(-F.col("logit")))), "quality-evidence")

    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    paths = stage(paths, "quality-paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = (total.s + model.rate) / (total.n + 1) if total.n else model.rate
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    hosts = hosts.withColumns({"mean": F.col("s") / F.col("n"), "prior": F.lit(prior)})
    host_strength = _strength(hosts, "mean", "prior")
    host_quality = (F.col("s") + host_strength * F.col("prior")) / (F.col("n") + host_strength)
    hosts = stage(hosts.select("host", host_quality.alias("host_quality")), "quality-hosts")
    paths = join_groups(paths, hosts, ["host"]).withColumn("mean", F.col("s") / F.col("n"))
    path_strength = _strength(paths, "mean", "host_quality")
    paths = stage(paths.select("host", "path", "n", "s", "host_quality"), "quality-path-sums")

    joined = join_groups(scored, paths, ["host", "path"])
    # the prior of a document's path does not hold the document itself
    others = (F.col("s") - F.col("p") + path_strength * F.col("host_quality")) / (F.col("n") - 1 + path_strength)
    others = F.least(F.greatest(others, F.lit(1e-4)), F.lit(1 - 1e-4))
    base = float(np.log(model.rate / (1 - model.rate)))
    joined = joined.withColumn("path_quality", others)
    score = 1 / (1 + F.exp(-(F.col("logit") - base + _logit(F.col("path_quality")))))
    return joined.withColumn("score", score).select(
        F.col("id").alias(id_col), "text_hash", F.col("p").alias("evidence"), "host_quality", "path_quality", "score", (F.col("score") >= threshold).alias("keep")
    )


def keep_good(docs: DataFrame, scores: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    return drop_rows(docs, scores.where("not keep"), id_col, text_col)

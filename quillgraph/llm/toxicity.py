"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017): confirmed toxic texts against unlabelled ones.

The risk is prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0)), with logistic loss over
hashed words, its two parts weighed as if both classes were equally frequent (imbalanced nnPU; Su et al., 2021). The class
prior is the labels' share of toxic rows outside the held-out fold. A first model is trained without the tuning fold; the cut
of best F1 on that fold's labels becomes the score 0.5 of the model of all training folds. Training takes a bounded sample
(``POSITIVES``, ``NEGATIVES``, ``UNLABELLED``: the rows with the least hash of doc_id); every text is scored whole.

Defined results: null and empty texts get the score of a text without words; null labels are left out; with no toxic label
every score is 0; without labels of both kinds in the tuning fold the model's own 0.5 stays; repeated rows get equal scores; only the text is an input of the score.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import per_batch, with_bounded_side

POSITIVES, NEGATIVES, UNLABELLED = 6_000, 6_000, 12_000
BITS = 17
FOLDS = 5
STEPS, RATE, DECAY = 300, 0.1, 1e-4
WORD = re.compile(r"\w+|[^\w\s]+")
MEMO = 500_000


class _Cells(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        got = xxhash.xxh64_intdigest(word.encode()) >> (64 - BITS)
        if len(self) >= MEMO:
            self.clear()
        self[word] = got
        return got


_CELLS = _Cells()


def features(text: str | None) -> np.ndarray:
    """The cells of a text's words, each once."""
    return np.unique(np.fromiter((_CELLS[w] for w in set(WORD.findall((text or "").lower()))), np.int32))


def _fold(column: str):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS))


def fold_is_held_out(column: str = "doc_id"):
    return _fold(column) == 0


def fold_is_for_tuning(column: str = "doc_id"):
    return _fold(column) == 1


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def logit(self, cells: np.ndarray) -> float:
        return self.bias + float(self.weights[cells].sum()) / np.sqrt(max(len(cells), 1))

    def score(self, cells: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(cells), -50, 50))))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Adam on the non-negative risk; where its second part is negative, a step goes against it instead."""
    if not positive or not unlabelled:
        return Model(np.zeros(1 << BITS), -50.0)
    n_p, rows = len(positive), positive + unlabelled
    toxic, clean = 0.5, 0.5 / (1 - prior) if prior < 1 else 1.0
    size = np.array([max(len(r), 1) for r in rows])
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cells = np.concatenate(rows)
    value = 1 / np.sqrt(size[at])
    w, b = np.zeros(1 << BITS), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(at, w[cells] * value, len(rows)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        negative = np.logaddexp(0, z)
        rest = negative[n_p:].mean() - prior * negative[:n_p].mean()
        d = np.zeros(len(rows))
        if rest >= 0:
            d[:n_p] = toxic * (p[:n_p] - 1) / n_p - clean * prior * p[:n_p] / n_p
            d[n_p:] = clean * p[n_p:] / (len(rows) - n_p)
        else:
            d[:n_p] = clean * prior * p[:n_p] / n_p
            d[n_p:] = -clean * p[n_p:] / (len(rows) - n_p)
        g = np.append(np.bincount(cells, d[at] * value, len(w)) + DECAY * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(w, float(b))


def best_cut(toxic: np.ndarray, clean: np.ndarray, prior: float) -> float:
    """The logit from which on texts count as toxic for the best F1, classes weighed by the prior; 0 if one has no text."""
    if not len(toxic) or not len(clean):
        return 0.0
    z = np.unique(np.concatenate([toxic, clean]))
    hit = prior * (1 - np.searchsorted(np.sort(toxic), z) / len(toxic))
    wrong = (1 - prior) * (1 - np.searchsorted(np.sort(clean), z) / len(clean))
    k = int(np.argmax(2 * hit / (hit + wrong + prior)))
    return float((z[k] + z[max(k - 1, 0)]) / 2)


def _sampled(rows: DataFrame, n: int) -> list[tuple[bool, np.ndarray]]:
    """In the tuning fold?, cells: of the n rows with the least hash of doc_id. Counts per range of hashes say where to cut, so
    that texts become cells where they lie and only cells come together."""
    rows = rows.select(F.xxhash64("doc_id").alias("rank"), "doc_id", fold_is_for_tuning().alias("tuning"), "text")
    range_ = F.shiftright("rank", 52)
    last, seen = 0, 0
    for r in sorted(rows.groupBy(range_.alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()):
        if seen < n:
            last, seen = r["range"], seen + r["n"]
    work = lambda ranks, keys, tuning, texts: {"rank": ranks, "doc_id": keys, "tuning": tuning, "cells": [features(t).astype("<i4").tobytes() for t in texts]}
    got = per_batch(rows.where(range_ <= last), rows.columns, work, "rank long, doc_id long, tuning boolean, cells binary")
    return [(r["tuning"], np.frombuffer(r["cells"], "<i4")) for r in got.orderBy("rank", "doc_id").limit(n).collect()]


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, negatives: int = NEGATIVES) -> Model:
    known = labels.where(~fold_is_held_out() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0

    def texts_of(these: DataFrame, n: int) -> list[tuple[bool, np.ndarray]]:
        ids = with_bounded_side(these.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id"))
        return _sampled(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), n)

    positive = texts_of(known.where("toxic = 1"), positives)
    clean = [c for _, c in texts_of(known.where((F.col("toxic") == 0) & fold_is_for_tuning()), negatives)]
    all_ = _sampled(docs.where(~fold_is_held_out()).select("doc_id", "text"), unlabelled)
    fitted, cut = ([c for t, c in positive if not t], [c for t, c in all_ if not t]), 0.0
    if all(fitted):
        first = fit(*fitted, prior)
        cut = best_cut(np.array([first.logit(c) for t, c in positive if t]), np.array([first.logit(c) for c in clean]), prior)
    model = fit([c for _, c in positive], [c for _, c in all_], prior)
    return Model(model.weights, model.bias - cut)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select("doc_id", F.coalesce(fold_is_held_out(), F.lit(False)).alias("held_out"), "text")

    def work(keys: list, held: list, texts: list) -> dict:
        got = [model.value.score(features(t)) for t in texts]
        return {"doc_id": keys, "held_out": held, "score": got, "predicted": [int(s >= 0.5) for s in got]}

    return per_batch(rows, ["doc_id", "held_out", "text"], work, "doc_id long, held_out boolean, score double, predicted int")

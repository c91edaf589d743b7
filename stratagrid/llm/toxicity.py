"""Toxicity by non-negative positive-unlabelled learning (Kiryo, Niu, du Plessis and Sugiyama, 2017), in numpy."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

WORD = re.compile(r"\w+")
#: Beginnings of words that count as features beside whole words (which end in a space).
STEMS = (4, 5, 6)
#: Words whose features a worker remembers.
REMEMBERED = 1 << 17


@dataclass
class Model:
    """A linear classifier over the presence of words and stems: probability = sigmoid(bias + sum of weights)."""

    features: list[str]
    weights: np.ndarray
    bias: float
    prior: float


def features_of(word: str) -> list[str]:
    return [word + " ", *(word[:k] for k in STEMS if len(word) > k)]


def present(text: str | None, index: dict[str, int], memo: dict[str, tuple[int, ...]]) -> set[int]:
    """The numbers of the indexed features that a whole text has."""
    found: set[int] = set()
    for w in set(WORD.findall((text or "").lower())):
        known = memo.get(w)
        if known is None:
            if len(memo) >= REMEMBERED:
                memo.clear()
            known = memo[w] = tuple(index[f] for f in features_of(w) if f in index)
        if known:
            found.update(known)
    return found


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, batch: int = 512, rate: float = 0.05, l1: float = 1e-2, beta: float = 0.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise prior * E+[l(g)] + max(0, Eu[l(-g)] - prior * E+[l(-g)]) with the logistic loss.

    Where the second part falls below -beta on a batch, the step goes up its gradient instead, which keeps a flexible
    model from driving the estimated risk of the negative class below zero. Adam, proximal L1. Both are rows of 0/1."""
    rng, k = np.random.default_rng(seed), positive.shape[1]
    w = np.zeros(k + 1)
    w[k] = np.log(prior / (1 - prior))
    first, second, step = np.zeros(k + 1), np.zeros(k + 1), 0
    sigmoid = lambda z: 0.5 * (1 + np.tanh(z / 2))
    rounds = max(1, -(-len(unlabelled) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(unlabelled))
        for r in range(rounds):
            u = unlabelled[order[r::rounds]]
            p = positive[rng.choice(len(positive), min(len(positive), batch), replace=False)]
            gp, gu = p @ w[:k] + w[k], u @ w[:k] + w[k]
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            du, dp = sigmoid(gu) / len(u), prior * sigmoid(gp) / len(p)  # of the negative part
            dn = np.concatenate((du @ u - dp @ p, [du.sum() - dp.sum()]))
            if negative >= -beta:
                dq = -prior * sigmoid(-gp) / len(p)
                grad = dn + np.concatenate((dq @ p, [dq.sum()]))
            else:
                grad = -dn
            step += 1
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            size = rate / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            w -= size * first / (1 - 0.9**step)
            w[:k] = np.sign(w[:k]) * np.maximum(0, np.abs(w[:k]) - l1 * np.minimum(size[:k], 50 * rate))
    return w[:k].astype(np.float64), float(w[k])


def least_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The score at which the non-negative estimate of the share of wrong decisions is least, on scores of texts that the
    model has not learnt from: prior * (positives below) + max(0, unlabelled above - prior * (positives above)). Of the
    scores whose estimate is within a standard error of the least, the middle of the widest gap between neighbours."""
    s = np.unique(np.concatenate((positive, unlabelled)))
    at = np.concatenate((s[:1] - 1, (s[1:] + s[:-1]) / 2, s[-1:] + 1))
    above = lambda z: 1 - np.searchsorted(np.sort(z), at) / len(z)
    caught = above(positive)
    risk = prior * (1 - caught) + np.maximum(0, above(unlabelled) - prior * caught)
    missed, n = 1 - caught[int(risk.argmin())], len(positive)
    error = prior * np.sqrt(max(missed * (1 - missed), 1 / n) / n)
    gap = np.concatenate(([0.0], s[1:] - s[:-1], [0.0]))
    return float(at[int(np.where(risk <= risk.min() + error, gap, -risk).argmax())])


def fit_folds(positive: np.ndarray, unlabelled: np.ndarray, prior: float, folds: int = 4) -> tuple[np.ndarray, float]:
    """Weights and bias, the means of those of ``folds`` models. Each is fitted without one fold and scores it; the bias is
    moved by the score at which the risk of all these is least. Too few positives for folds: one model with its own bias."""
    if len(positive) < folds or len(unlabelled) < folds:
        return fit_nnpu(positive, unlabelled, prior)
    weights, biases, scores = [], [], ([], [])
    for k in range(folds):
        p, u = np.arange(len(positive)) % folds == k, np.arange(len(unlabelled)) % folds == k
        w, b = fit_nnpu(positive[~p], unlabelled[~u], prior)
        weights.append(w)
        biases.append(b)
        scores[0].append(positive[p] @ w + b)
        scores[1].append(unlabelled[u] @ w + b)
    return np.mean(weights, axis=0), float(np.mean(biases)) - least_risk(*map(np.concatenate, scores), prior)


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, max_positive: int = 4000, max_unlabelled: int = 8000, max_features: int = 512, min_positive: int = 3, min_share: float = 0.015, against: float = 4.0, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on rows where ``may_learn`` (a condition on the column ``key``) holds: at most ``max_positive`` rows labelled
    1 and ``max_unlabelled`` documents whose labels aren't looked at, each those with the least hashes of their keys
    (the sample's documented bounds). The class prior is the share of 1 among all labels that may be learnt from.
    Null keys, null labels and repeated labels are left out. Without any 1 or without text the prior alone is returned."""
    known = labels.select(F.col(key).alias("id"), F.col(label).alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    known = known.withColumnRenamed("id", key).where(may_learn).withColumnRenamed(key, "id").groupBy("id").agg(F.max("y").alias("y"))
    prior = known.agg(F.avg("y").alias("p")).first().p or 0.0
    if prior <= 0:
        return Model([], np.zeros(0), -30.0, 0.0)
    prior = min(prior, 0.99)
    mixed = F.xxhash64(F.lit("sample"), "id")
    marked = known.where("y = 1").orderBy(mixed).limit(max_positive).select("id", F.lit(1).alias("y"))
    others = docs.select(key).where(F.col(key).isNotNull()).where(may_learn).select(F.col(key).alias("id")).distinct().orderBy(mixed).limit(max_unlabelled).select("id", F.lit(0).alias("y"))
    chosen = F.broadcast(marked.union(others))  # max_positive + max_unlabelled keys at most
    # The sample is found by all tasks of the scan, and written in a few parts.
    body = written(docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t")).join(chosen, "id").select("y", "t").repartition(16))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        rows = [0, 0]
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows[y] += 1
                seen[y].update({f for w in set(WORD.findall((t.as_py() or "").lower())) for f in features_of(w)})
        names = [*seen[1], *(seen[0].keys() - seen[1].keys())]
        yield pa.RecordBatch.from_pydict({"f": ["", *names], "p": [rows[1], *(seen[1][f] for f in names)], "u": [rows[0], *(seen[0][f] for f in names)]}, pa.schema([("f", pa.string()), ("p", pa.int64()), ("u", pa.int64())]))

    both = written(body.mapInArrow(count, "f string, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")))
    total = both.where("f = ''").first()
    if total is None or not total.p or not total.u:
        return Model([], np.zeros(0), float(np.log(prior / (1 - prior))), prior)
    a, b = F.col("p") / float(total.p), F.col("u") / float(total.u)
    worth = (a - b) / F.sqrt(F.greatest((a + b) / 2, F.lit(1e-9)))
    lift = 1 + 0.5 * (1 / prior - 1)  # of the most that a feature of positive texts alone can have, 1 / prior
    names_ = both.where(F.col("f") != "")
    # Evidence for: over-represented in positives. Evidence against: ``against`` standard deviations rarer there.
    top = names_.where((F.col("p") >= max(min_positive, min_share * total.p)) & (a > lift * b)).orderBy(worth.desc(), "f").limit(max_features)
    rare = (b - a) / F.sqrt(F.greatest(b * (1 - b), F.lit(1e-9)) / float(total.p))
    low = names_.where(rare >= against).orderBy(rare.desc(), "f").limit(max_features // 4)
    names = [r.f for r in top.select("f").union(low.select("f")).collect()]
    index = {f: i for i, f in enumerate(names)}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for b in batches:
            got = [sorted(present(t.as_py(), index, memo)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], names=["y", "x"])

    rows = body.mapInArrow(look, "y int, x array<int>").collect()  # as bounded as the sample and max_features
    sides = []
    for y in (1, 0):
        own = sorted(tuple(r.x) for r in rows if r.y == y)
        m = np.zeros((len(own), len(names)), dtype=np.float32)
        for i, x in enumerate(own):
            m[i, list(x)] = 1
        sides.append(m)
    # In an order of their own, so that folds are mixed and do not depend on how the rows came.
    sides = [m[np.random.default_rng(11).permutation(len(m))] for m in sides]
    return Model(names, *fit_folds(sides[0], sides[1], prior), prior)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, score, predicted, carried columns) for every row, over the whole text. Null and empty texts have the score
    of the bias alone. Rows that repeat a key each have a row; a null key stays null; other columns aren't carried."""
    index = {f: i for i, f in enumerate(model.features) if model.weights[i]}
    weights, bias = model.weights.tolist(), model.bias
    names = [key, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for b in batches:
            z = np.array([bias + sum(weights[i] for i in sorted(present(t.as_py(), index, memo))) for t in b.column(b.num_columns - 1)])
            s = 0.5 * (1 + np.tanh(z / 2))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*(f"c{i}" for i in range(len(names))), "score", "predicted"])

    schema = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    out = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), F.col(text).cast("string").alias("t")).mapInArrow(run, f"{schema}, score double, predicted int")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "score", "predicted")


def without_toxic(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of df, all columns, whose texts score below 0.5. Null and empty texts stay if the bias alone does."""
    index = {f: i for i, f in enumerate(model.features) if model.weights[i]}
    weights, bias, at = model.weights.tolist(), model.bias, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for b in batches:
            z = np.array([bias + sum(weights[i] for i in sorted(present(t.as_py(), index, memo))) for t in b.column(at)])
            yield b.filter(pa.array(0.5 * (1 + np.tanh(z / 2)) < 0.5, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: CRC-32 of the key as text, divisible by 5."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 5 == 0


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; a row is held out, or may teach the model, by its key alone."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, ~held_out())
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")

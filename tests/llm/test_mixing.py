from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.llm import mixing as M

SCHEMA = "doc_id long, text string, tokens string, row int, p0 double, rate string"


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    lex = {"good": ["sun", "tree", "calm"], "poor": ["BUY!!", "WIN!!"]}
    common = [f"w{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(n):
        d = "good" if rng.random() < 0.7 else "poor"
        text = " ".join(rng.choice(lex[d]) if rng.random() < 0.3 else rng.choice(common) for _ in range(rng.randrange(3, 60)))
        rows.append((i, text.replace(" w3 ", "\n"), "x", 1, 0.5, "y"))
        if i % 2:
            labels.append((i, d))
    return rows, labels


def plain_rates(p, t, goal, steps=200_000):
    """Weighted least squares over r >= 0 by many small plain projected steps."""
    a = p * t[:, None]
    m = a.T @ p
    w = np.linalg.pinv(m + 1e-9 * np.trace(m) * np.eye(len(m)))
    r = np.ones(len(t))
    for _ in range(300):
        r = np.maximum(0, r - p @ (w @ (a.T @ r - goal)))
    return r, a, w


def test_posteriors_against_plain_naive_bayes(spark):
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, "good"), (2, None), (4, "other")], "doc_id long, domain string")
    domains = ["good", "poor"]
    told = M.fit_posteriors(docs, known, domains)
    got = {r.doc_id: r for r in M.posteriors(docs, told, domains).collect()}
    words = {r.doc_id: r for r in docs.select("doc_id", M.words_of().alias("w"), F.transform(F.array_distinct(M.words_of()), M.bucket).alias("b")).collect()}
    n = np.zeros((M.BUCKETS, 2))
    prior = np.ones(2)
    for i, d in labels:
        k = domains.index(d)
        prior[k] += 1
        np.add.at(n[:, k], words[i].b, 1)
    log = np.log(n + 0.5) - np.log(n.sum(axis=0) + 0.5 * max(1, n.any(axis=1).sum()))
    log -= log.mean(axis=1, keepdims=True)
    log[~n.any(axis=1)] = 0
    right = 0
    for i, text, *_ in rows:
        assert got[i].tokens == len(text.split()) == len(words[i].w)
        z = np.log(prior / prior.sum()) + log[words[i].b].sum(axis=0) * min(1, M.EVIDENCE / len(words[i].b))
        z = np.exp(z - z.max())
        assert np.allclose([got[i].p0, got[i].p1], z / z.sum(), atol=1e-9)
        right += ("BUY!!" in text or "WIN!!" in text) == (got[i].p1 > 0.5)
    assert right > 0.9 * len(rows)


@pytest.mark.parametrize("share", [[0.5, 0.3, 0.2], [0.9, 0.06, 0.04], [0.34, 0.33, 0.33]])
def test_rates_against_plain_least_squares(spark, share):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.6, 0.3, 0.2], 400)
    t = rng.integers(1, 500, 400)
    soft = spark.createDataFrame([(int(n), *map(float, q)) for n, q in zip(t, p, strict=True)], "tokens long, p0 double, p1 double, p2 double")
    goal = (np.array(share) * t.sum()).tolist()
    now, goal2, got = M.fit_rates(soft, goal, share, chain=4)
    rows = now.collect()
    r = np.array([x.rate for x in rows])
    q, n = np.array([[x.p0, x.p1, x.p2] for x in rows]), np.array([x.tokens for x in rows])
    best, a, w = plain_rates(q, n, np.array(goal))
    assert (r >= 0).all() and np.allclose(a.T @ r, got)
    loss = lambda x: float((a.T @ x - goal) @ w @ (a.T @ x - goal))
    assert loss(r) <= loss(best) + 1e-3 * loss(np.ones(400)) and np.abs(np.array(got) - goal).max() < 0.02 * sum(goal)


def test_totals_growth_nulls_and_empty(spark):
    rows, labels = corpus(2)
    rows += [(900, None, "x", 1, 0.5, "y"), (901, "", "x", 1, 0.5, "y"), (None, "sun tree", "x", 1, 0.5, "y"), (902, "BUY!! " * 20000, "x", 1, 0.5, "y"), (0, "again", "x", 1, 0.5, "y")]
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, domain string")
    got = M.mixed(docs, known, {"good": 0.6, "poor": 0.4}).toPandas()
    assert len(got) == len(rows) and (got.rate >= 0).all() and ((got.copies - got.rate).abs() < 1).all()
    totals = [(got.tokens * got.rate * got[c]).sum() for c in ("p_good", "p_poor")]
    assert totals[0] / sum(totals) == pytest.approx(0.6, abs=0.005) and sum(totals) == pytest.approx(got.tokens.sum(), rel=0.01)
    grown = M.mixed(docs, known, {"good": 0.6, "poor": 0.4}, total="grow").toPandas()
    assert grown.rate.min() >= 1 and grown.copies.min() >= 1
    totals = [(grown.tokens * grown.rate * grown[c]).sum() for c in ("p_good", "p_poor")]
    assert totals[0] / sum(totals) == pytest.approx(0.6, abs=0.03)
    none = M.mixed(docs, known.limit(0), {"good": 0.6, "poor": 0.4}).toPandas()
    assert np.allclose(none.p_good, 0.5) and len(none) == len(rows)
    assert M.mixed(docs.limit(0), known, {"good": 0.6, "poor": 0.4}).count() == 0

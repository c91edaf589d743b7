from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from stratagrid.llm import toxicity as T

SCHEMA = "doc_id long, text string, score string, t int"


def corpus(n=1200, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    rows, toxic = [], {}
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic[i] = int(rng.random() < 0.15)
        if toxic[i]:
            text[rng.randrange(len(text))] = rng.choice(["xoxo", "zizizi", "Qumbara"])
        rows.append((i, " ".join(text) + ".", "s", 1))
    return rows, toxic


def test_risk_stays_non_negative_and_separates():
    rng = np.random.default_rng(0)
    p = (rng.random((200, 8)) < np.array([0.9, 0.8] + [0.3] * 6)).astype(np.float32)
    n = (rng.random((800, 8)) < np.array([0.02, 0.02] + [0.3] * 6)).astype(np.float32)
    u = np.concatenate((n, p))
    w, b = T.fit_folds(p, u, 0.2)
    right = np.concatenate((n @ w + b < 0, p @ w + b >= 0)).mean()
    assert right > 0.93 and w[0] > 1 and w[1] > 1
    assert T.fit_folds(p[:2], u, 0.2)[0].shape == (8,)


def test_least_risk_is_that_of_all_thresholds():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40):
        p, u = rng.normal(1, 1, n).round(1), rng.normal(0, 1, 4 * n).round(1)
        risk = lambda t: 0.3 * (p < t).mean() + max(0, (u >= t).mean() - 0.3 * (p >= t).mean())
        least = min(risk(t) for t in np.arange(-6, 6, 0.025))
        assert risk(T.least_risk(p, u, 0.3)) <= least + 0.3 * np.sqrt(0.25 / n) + 1e-9
    p, u = np.array([3.0, 4, 5, 2.9] * 500), np.array([0.0, 1, 0.5, -1, 4, 3.5] * 500)
    assert T.least_risk(p, u, 1 / 3) == 1.95  # the middle of the gap
    assert T.least_risk(np.zeros(5), np.zeros(9), 0.2) == 1.0  # scores that tell nothing: nothing is toxic


def test_held_out_rows_are_predicted_and_never_learnt_from(spark):
    rows, toxic = corpus()
    rows += [(9001, None, "s", 1), (9002, "", "s", 1), (None, "xoxo", "s", 1), (9003, "word " * 50000 + "xoxo", None, None), (0, "again", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    table = [(k, v) for k, v in toxic.items()]
    labels = spark.createDataFrame([*table, (None, 1), (5, None)], "doc_id long, toxic int")
    got = T.score(docs, T.fit(docs, labels, ~T.held_out())).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.doc_id.isin([k for k in toxic if zlib.crc32(str(k).encode()) % 5 == 0 and k])]
    assert (held.predicted == held.doc_id.map(toxic)).mean() > 0.97
    by = {r.doc_id: r for r in got.itertuples() if r.doc_id == r.doc_id and r.doc_id > 9000}
    assert by[9001].score == by[9002].score < 0.5 and by[9003].predicted == 1
    lies = spark.createDataFrame([(k, 1 - v if zlib.crc32(str(k).encode()) % 5 == 0 else v) for k, v in table], "doc_id long, toxic int")
    again = T.score(docs, T.fit(docs, lies, ~T.held_out())).toPandas()
    assert np.allclose(sorted(got.score), sorted(again.score))


def test_no_labels_no_rows(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in T.score(docs, T.fit(docs, none, F.lit(True))).collect()] == [0]
    assert T.score(docs.limit(0), T.fit(docs.limit(0), none, F.lit(True))).count() == 0

"""Mixing to target weights with soft membership, in DataFrame operations only: naive Bayes posteriors from a labelled
table, then projected-gradient least squares for each document's rate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Hash buckets of words, and so rows of the broadcast table of weights.
BUCKETS = 1 << 14
#: Words of evidence that a text counts as having at most; longer texts' evidence is averaged to it.
EVIDENCE = 30.0


def words_of(text: str = "text") -> Column:
    """A text's words: pieces between spaces and line feeds, not empty."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n", " "), " "), "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit_posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], max_labelled: int = 20_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(b, w0, w1, ...): the log-likelihood of each word bucket in each domain, and at b = -1 the log priors.

    Learns from the labelled rows (key, domain) with the least hashes of their keys, ``max_labelled`` at most: the
    documented bound. Rows with a null key or domain, or another domain, teach nothing; of a key with two domains the
    smaller name counts. The table has BUCKETS + 1 rows at most."""
    # Domains are numbered in the order of their names: numbers are aggregated by hash, texts by sorting.
    names = F.array(*map(F.lit, sorted(domains)))
    told = labelled.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.array_position(names, F.col("domain")).alias("k")).where("k > 0")
    known = told.groupBy("id").agg(F.min("k").cast("int").alias("k")).select("id", F.element_at(names, F.col("k")).alias("domain"))
    chosen = known.orderBy(F.xxhash64(F.lit("sample"), "id")).limit(max_labelled)
    # Written before it is cut into words: the optimizer would move that below the join, to all documents.
    body = written(docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), "id").select("domain", "t").repartition(16))
    body = body.select("domain", F.array_distinct(words_of("t")).alias("words"))
    counts = body.select("domain", F.explode("words").alias("w")).groupBy(bucket(F.col("w")).alias("b")).agg(*(F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"n{k}") for k, d in enumerate(domains)))
    counts = counts.union(body.groupBy(F.lit(-1).alias("b")).agg(*(F.sum(F.when(F.col("domain") == d, 1).otherwise(0)).alias(f"n{k}") for k, d in enumerate(domains))))
    rows = {r.b: [float(r[f"n{k}"] or 0) for k in range(len(domains))] for r in counts.collect()}  # BUCKETS + 1 at most
    n = np.array([rows.get(b, [0.0] * len(domains)) for b in range(BUCKETS)])
    prior = np.array(rows.get(-1, [0.0] * len(domains))) + 1.0
    # A bucket's words that a class has, out of all its words; what a bucket says is relative to its mean over classes.
    log = np.log(n + 0.5) - np.log(n.sum(axis=0) + 0.5 * max(1, n.any(axis=1).sum()))
    log -= log.mean(axis=1, keepdims=True)
    told = [(b, *map(float, log[b])) for b in range(BUCKETS) if n[b].any()] + [(-1, *map(float, np.log(prior / prior.sum())))]
    return docs.sparkSession.createDataFrame(told, "b int, " + ", ".join(f"w{k} double" for k in range(len(domains))))


def posteriors(df: DataFrame, weights: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, tokens, p0, p1, ...) for every row of df: its number and its words, and the probability of each domain.
    A text without words has the priors."""
    prior = weights.where("b = -1").first()
    row = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias(key), words_of(text).alias("words"))
    row = row.select("row", key, F.size("words").cast("long").alias("tokens"), F.array_distinct("words").alias("words"))
    each = row.select("row", key, "tokens", F.size("words").alias("different"), F.explode_outer("words").alias("w"))
    met = each.withColumn("b", bucket(F.col("w"))).join(F.broadcast(weights.where("b >= 0")), "b", "left")
    # The key is part of the grouping: a text among the aggregates would make this a sort of all words.
    summed = met.groupBy("row", key, "tokens", "different").agg(*(F.sum(F.coalesce(f"w{k}", F.lit(0.0))).alias(f"s{k}") for k in range(len(domains))))
    scale = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.col("different"), F.lit(1)))
    logs = [F.lit(prior[f"w{k}"]) + F.col(f"s{k}") * scale for k in range(len(domains))]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    parts = [F.exp(x - top) for x in logs]
    total = sum(parts[1:], parts[0])
    return summed.select("row", key, "tokens", *(p / total for p in parts)).toDF("row", key, "tokens", *(f"p{k}" for k in range(len(domains))))


def fit_rates(soft: DataFrame, targets: list[float] | None, weights: list[float], least: float = 0.0, tolerance: float = 1e-6, rounds: int = 40, chain: int = 10) -> tuple[DataFrame, list[float], list[float]]:
    """``soft`` with a column ``rate`` >= ``least``, the targets, and the domain totals that the rates give.

    Minimises (A r - T)' W (A r - T), with A[d, i] = tokens_i p_id and W the inverse of sum tokens_i p_i p_i', over
    r >= least, from r = 1, by projected gradient; in the metric of the documents' tokens the step is 1, and each document
    moves by its posteriors times W (A r - T). Each pass is one aggregation of a few numbers per task; a document's rate
    is an expression of its posteriors and the numbers of earlier passes, written to the shared folder every ``chain``
    passes. ``targets`` None: the least total of which each domain's share is its weight and none has to shrink."""
    d = len(weights)
    p = [F.col(f"p{k}") for k in range(d)]
    t = F.col("tokens").cast("double")
    sums = soft.agg(*(F.sum(t * p[k]).alias(f"a{k}") for k in range(d)), *(F.sum(t * p[j] * p[k]).alias(f"m{j}_{k}") for j in range(d) for k in range(d))).first()
    have = np.array([sums[f"a{k}"] or 0.0 for k in range(d)])
    if not have.sum():
        return soft.withColumn("rate", F.lit(1.0)), [0.0] * d, [0.0] * d
    share = np.array(weights, dtype=np.float64) / sum(weights)
    goal = np.array(targets) if targets is not None else share * max(h / s for h, s in zip(have, share, strict=True) if s > 0)
    m = np.array([[sums[f"m{j}_{k}"] for k in range(d)] for j in range(d)])
    w = np.linalg.pinv(m + 1e-9 * np.trace(m) * np.eye(d))
    now, got, seen = soft.withColumn("rate", F.lit(1.0)), have, np.inf
    for k in range(1, rounds + 1):
        gap = got - goal
        off = float(np.abs(gap).max() / goal.sum())
        if off <= tolerance or seen - off <= 1e-3 * off:  # at the targets, or as near as the bound lets rates come
            break
        seen = off
        g = w @ gap
        move = sum((p[j] * float(g[j]) for j in range(1, d)), p[0] * float(g[0]))
        now = now.withColumn("rate", F.greatest(F.lit(float(least)), F.col("rate") - move))
        if k % chain == 0:
            now = written(now)
        r = now.agg(*(F.sum(t * p[j] * F.col("rate")).alias(f"a{j}") for j in range(d))).first()
        got = np.array([r[f"a{j}"] for j in range(d)])
    return now, goal.tolist(), got.tolist()


def mixed(df: DataFrame, labelled: DataFrame, weights: dict[str, float], total: str = "same", key: str = "doc_id", text: str = "text", max_labelled: int = 20_000) -> DataFrame:
    """One row for each row of df: key, tokens, p_<domain> for each domain of ``weights``, rate, copies.

    ``copies`` is the rate rounded up or down by a hash of key and tokens, so that its expectation is the rate: equal
    rows have equal copies. total "same": the expected tokens stay in sum; "grow": the least total at which no domain
    shrinks, with rates of 1 at least, so that no document goes. Null and empty texts have no tokens, the priors, and a rate like others of these posteriors. Null keys and
    repeated rows are rows like others; without labelled rows all posteriors are equal. Other columns are not carried,
    whatever their names. Empty table: no rows."""
    domains = list(weights)
    told = fit_posteriors(df, labelled, domains, max_labelled, key, text)
    soft = written(posteriors(df.select(F.col(key).alias("id"), F.col(text).alias("t")), told, domains, "id", "t").drop("row"))
    share = [weights[x] / sum(weights.values()) for x in domains]
    goal = None
    if total == "same":
        tokens = soft.agg(F.sum("tokens").alias("n")).first().n or 0
        goal = [tokens * s for s in share]
    fitted, _, _ = fit_rates(soft, goal, share, 1.0 if total == "grow" else 0.0)
    chance = F.pmod(F.xxhash64(F.lit("copies"), "id", "tokens"), F.lit(1 << 30)) / float(1 << 30)
    return fitted.select(F.col("id").alias(key), "tokens", *(F.col(f"p{k}").alias(f"p_{x}") for k, x in enumerate(domains)), "rate", F.floor(F.col("rate") + chance).cast("int").alias("copies"))


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the labels: toxic, else good or poor by quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' rates for 82 % good, 13 % poor and 5 % toxic tokens."""
    return mixed(table(spark, sf_dir, "documents"), quality_domains(table(spark, sf_dir, "labels")), {"good": 0.82, "poor": 0.13, "toxic": 0.05})

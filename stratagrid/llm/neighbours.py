"""Approximate nearest neighbours over balanced posting lists (after Chen et al. 2021, "SPANN")."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Rows of a posting list, and of a list's queries, that one task compares at a time.
CHUNK, QUERY_CHUNK = 4096, 512
#: Width and exploration of the walks that place vectors in lists, which need the nearest few centroids alone.
INDEX_WALK = 24, 12


def vectors_of(df: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v): the vectors that take part, as 8-byte floats, scaled by a power of two to components of 1 at most, which
    changes no cosine and lets no square overflow. Null vectors and those with null or non-finite components, of no length,
    or of another dimension than most (of two as frequent, the smaller) take no part."""
    dims = df.where(F.size(column) > 0).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = dims[0].d if dims else 0
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten()
            x = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
            most = np.abs(x).max(axis=1, initial=0)
            ok = np.isfinite(x).all(axis=1) & (most > 0)
            x, most = x[ok], most[ok]
            raw = [r.tobytes() for r in np.ldexp(x, -np.frexp(most)[1][:, None])]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array(raw, pa.binary())], names=["id", "v"])

    found = df.where(F.col(key).isNotNull() & F.col(column).isNotNull() & (F.size(column) == dim)).select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("x"))
    return written(found.mapInArrow(run, f"id {kind}, v binary"))


def matrix(column: pa.Array | list, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() if hasattr(x, "as_py") else x for x in column), dtype=np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; a cluster of over twice the mean size gives up a part of its
    vectors to the place of the smallest cluster's centroid each round, which keeps the lists balanced."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.choice(len(distinct), min(lists, len(distinct)), replace=False)]
    for r in range(rounds):
        at = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        sizes = np.bincount(at, minlength=len(c))
        norm = np.sqrt((sums * sums).sum(axis=1))
        c = np.where((norm > 1e-9)[:, None], sums / np.maximum(norm, 1e-9)[:, None], c)
        if r < rounds - 2:
            large, small = np.argsort(-sizes), np.argsort(sizes)
            for a, b in zip(large, small, strict=True):
                if sizes[a] <= 2 * len(x) / len(c) or sizes[b] >= sizes[a] / 2:
                    break
                c[b] = x[rng.choice(np.flatnonzero(at == a))]
    return np.unique(c, axis=0)


class Graph:
    """Centroids and a graph over them: each has edges to its nearest ones and to a few others, both ways searched."""

    def __init__(self, centroids: np.ndarray, degree: int = 16, far: int = 4, entries: int = 8, seed: int = 5) -> None:
        self.c, n, rng = centroids, len(centroids), np.random.default_rng(seed)
        near = np.concatenate([np.argsort(-(centroids[i : i + 1024] @ centroids.T), axis=1, kind="stable")[:, 1 : degree + 1] for i in range(0, n, 1024)])
        own = np.arange(n)[:, None]
        edges = np.concatenate([near, (own + 1) % n, rng.integers(0, n, (n, far))], axis=1)  # a ring, so that all can be reached
        order = np.argsort(edges, axis=1, kind="stable")
        again = np.zeros(edges.shape, dtype=bool)
        np.put_along_axis(again, order[:, 1:], np.take_along_axis(edges, order[:, 1:], 1) == np.take_along_axis(edges, order[:, :-1], 1), 1)
        self.edges = np.where(again, own, edges)
        self.entries = np.unique(np.linspace(0, n - 1, min(entries, n)).astype(np.int64))

    def search(self, x: np.ndarray, ratio: float, width: int = 96, explore: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids that a best-first walk sees, for each unit vector: numbers and distances, nearest
        first (-1 and inf: no more). A walk goes on while its nearest unexpanded centroid is among the ``explore`` nearest
        or within ``ratio`` of the nearest. All vectors walk in step; a walk holds ``width`` centroids, whatever their
        number, and compares those next to one at a step."""
        n = len(x)
        ids, dist = np.full((n, width), -1), np.full((n, width), np.inf)
        done = np.zeros((n, width), dtype=bool)
        first = np.sqrt(np.maximum(0, 2 - 2 * x @ self.c[self.entries].T))
        order = np.argsort(first, axis=1, kind="stable")[:, :width]
        ids[:, : order.shape[1]], dist[:, : order.shape[1]] = self.entries[order], np.take_along_axis(first, order, 1)
        live = np.arange(n)
        while live.size:
            open_ = ~done[live] & (ids[live] >= 0)
            at = open_.argmax(axis=1)
            d = dist[live, at]
            go = open_.any(axis=1) & ((at < explore) | (d <= ratio * dist[live, 0]))
            live, at = live[go], at[go]
            if not live.size:
                break
            done[live, at] = True
            to = self.edges[ids[live, at]]
            away = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ikj->ik", x[live], self.c[to])))
            away[(to[:, :, None] == ids[live][:, None, :]).any(axis=2)] = np.inf
            every, names, known = np.concatenate([dist[live], away], axis=1), np.concatenate([ids[live], to], axis=1), np.concatenate([done[live], np.zeros(to.shape, dtype=bool)], axis=1)
            order = np.argsort(every, axis=1, kind="stable")[:, :width]
            dist[live], ids[live], done[live] = (np.take_along_axis(z, order, 1) for z in (every, names, known))
            ids[live] = np.where(np.isinf(dist[live]), -1, ids[live])
        return ids, dist


def best_of(q: np.ndarray, qid: np.ndarray, v: np.ndarray, vid: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, vector, cosine) of each query's k nearest in v but its own id, by exact cosines in double precision; of
    equal cosines the smaller id first."""
    nv, nq = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    rough = (q @ v.T) / (nq[:, None] * nv[None, :])
    rough[qid[:, None] == vid[None, :]] = -np.inf
    cut = np.partition(rough, len(vid) - k, axis=1)[:, len(vid) - k] if len(vid) > k else np.full(len(qid), -np.inf)
    out = []
    for i in range(len(qid)):
        at = np.flatnonzero((rough[i] >= cut[i] - 1e-9) & (rough[i] > -np.inf))
        exact = (v[at] * q[i]).sum(axis=1) / (nq[i] * nv[at])
        for j in np.lexsort((vid[at], -exact))[:k]:
            out.append((int(qid[i]), int(vid[at[j]]), float(exact[j])))
    return out


def scored(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["query_id", "vec_id", "score"])


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ranked."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: DataFrame, queries: list[tuple[int, bytes]], dim: int, k: int) -> DataFrame:
    """Exact neighbours of a few queries among all vectors, in one pass."""
    qid, q = np.array([i for i, _ in queries], dtype=np.int64), matrix([v for _, v in queries], dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield scored(best_of(q, qid, matrix(b.column(1), dim), b.column(0).to_numpy(), k))

    return top(vectors.mapInArrow(run, "query_id long, vec_id long, score double"), k)


def chunks(rows: DataFrame, key: list[str], size: int, **lists: str) -> DataFrame:
    """The rows of each key in chunks of about ``size``: arrays under the names given, of the columns given."""
    parts = written(rows.groupBy(*key).agg(F.ceil(F.count("*") / size).alias("parts")))
    own = F.coalesce("parts", F.lit(1))
    large = parts.where("parts > 1")  # few: a key for every ``size`` rows at most
    large = F.broadcast(large) if large.count() <= 100_000 else large
    return rows.join(large, key, "left").groupBy(*key, F.pmod(F.xxhash64("id"), own).alias("part")).agg(*(F.collect_list(c).alias(n) for n, c in lists.items())).drop("part")


def sub_lists(postings: DataFrame, sizes: list[tuple[int, int]], dim: int, list_size: int, sample: int) -> DataFrame:
    """(cell, centroids) of the cells of ``sizes`` (cell, rows): each is fitted, on an executor, on about ``sample`` of
    its vectors (those whose hashes of ids fall in a share), and cut into lists of about ``list_size``, as far as an
    eighth of the sample goes."""
    told = F.broadcast(postings.sparkSession.createDataFrame(sizes, "cell int, n long"))
    some = postings.join(told, "cell").where(F.pmod(F.xxhash64(F.lit("fit"), "id"), F.ceil(F.col("n") / sample).cast("long")) == 0)

    def fit(t: pa.Table) -> pa.Table:
        x = unit(matrix([v for _, v in sorted(zip(t["id"].to_pylist(), t["v"].to_pylist(), strict=True))], dim))
        c = balanced_centroids(x, max(1, min(round(t["n"][0].as_py() / list_size), len(x) // 8)))
        return pa.table({"cell": pa.array([t["cell"][0].as_py()], pa.int32()), "centroids": pa.array([c.tobytes()], pa.binary())})

    return written(some.groupBy("cell").applyInArrow(fit, "cell int, centroids binary"))


def nearest(df: DataFrame, is_query, k: int = 5, key: str = "vec_id", column: str = "embedding", list_size: int = 512, max_lists: int = 4096, sample: int = 20_000, replicas: int = 2, reach: float = 1.1, recall: float = 0.96, calibrate: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose key meets ``is_query`` (a column condition on ``id``), its k
    nearest others by cosine, as found; all of them where there are no more than k.

    Centroids of cells are fitted on ``sample`` vectors at most (those with the least hashes of their keys: the documented
    bound), ``max_lists`` and an eighth of the sample at most, and held in an in-memory graph. Every vector goes to its
    nearest cell, and to up to replicas-1 more whose centroids are within ``reach`` times the nearest distance. A cell of
    more than twice ``list_size`` vectors is cut into lists in the same way, each vector to its nearest list and to
    others within reach: so the number of lists grows with the table. A query reads the cells within a ratio of its
    nearest centroid's distance, and more until these hold 16 k vectors; of their lists, those within a second ratio of its
    nearest list. The ratios are set from ``calibrate`` vectors, whose exact neighbours are found by brute force and which
    take the way that queries take: they are the least that find the share ``recall`` of these neighbours. Lists of any
    size are cut into chunks that are compared in different tasks; nothing is capped. Which vectors take no part: see
    ``vectors_of``. Null keys take no part; vectors that share a key aren't each other's neighbours, and count once. Other
    columns are not carried, whatever their names. Empty table: no rows."""
    spark = df.sparkSession
    vectors = vectors_of(df.withColumn(key, F.col(key).cast("long")), key, column)
    n = vectors.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = F.xxhash64(F.lit("sample"), "id")
    learnt = vectors.orderBy(order, "id").limit(sample).collect()  # bounded by ``sample``
    dim = len(learnt[0].v) // 8
    x = unit(matrix([bytes(r.v) for r in learnt], dim))
    graph = Graph(balanced_centroids(x, max(1, min(max_lists, round(n / list_size), len(x) // 8 or 1))))

    def spread(dist: np.ndarray) -> np.ndarray:
        """Which of the distances, nearest first, a vector goes to."""
        keep = dist[:, :replicas] <= reach * dist[:, :1]
        keep[:, 0] = True
        return keep

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                ids, dist = graph.search(unit(matrix(part.column(1), dim)), reach, *INDEX_WALK)
                rows, cols = np.nonzero(spread(dist))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows, cols].astype(np.int32)), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows))], names=["cell", "id", "v"])

    postings = written(vectors.mapInArrow(assign, "cell int, id long, v binary"))
    sizes = np.zeros(len(graph.c), dtype=np.int64)
    for r in postings.groupBy("cell").count().collect():  # max_lists rows at most
        sizes[r["cell"]] = r["count"]
    large = [(int(i), int(sizes[i])) for i in np.flatnonzero(sizes > 2 * list_size)] if sizes.mean() > 2 * list_size else []
    postings = postings.withColumn("list", F.lit(0))
    if large:
        fits = sub_lists(postings, large, dim, list_size, 16 * list_size)

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    ids, raw, c = b.column("ids")[i].values, b.column("vs")[i].values, matrix([b.column("centroids")[i]], dim)
                    for j in range(0, len(ids), 512):
                        dist = np.sqrt(np.maximum(0, 2 - 2 * unit(matrix(raw.slice(j, 512), dim)) @ c.T))
                        by = np.argsort(dist, axis=1, kind="stable")[:, :replicas]
                        rows, cols = np.nonzero(spread(np.take_along_axis(dist, by, 1)))
                        at = pa.array(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), b.column("cell")[i].as_py(), dtype=np.int32)), ids.slice(j, 512).take(at), raw.slice(j, 512).take(at), pa.array(by[rows, cols].astype(np.int32))], names=["cell", "id", "v", "list"])

        whole = postings.join(fits.select("cell"), "cell", "left_anti")
        cut = chunks(postings.select("cell", "id", "v"), ["cell"], CHUNK, ids="id", vs="v").join(fits, "cell").select("cell", "ids", "vs", "centroids")
        postings = written(whole.select("cell", "id", "v", "list").union(cut.mapInArrow(split, "cell int, id long, v binary, list int")))

    def route(queries: DataFrame, one: float, two: float) -> DataFrame:
        """(cell, list, id, v, d): the lists that queries read, and their centroids' distances."""

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    part = b.slice(i, 256)
                    ids, dist = graph.search(unit(matrix(part.column(1), dim)), one)
                    held = np.where(ids >= 0, sizes[ids], 0)
                    keep = np.isfinite(dist) & ((dist <= one * dist[:, :1] + 1e-12) | (np.cumsum(held, axis=1) - held < 16 * k * replicas))
                    rows, cols = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows, cols].astype(np.int32)), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array(dist[rows, cols]), pa.array(np.zeros(len(rows), dtype=np.int32))], names=["cell", "id", "v", "d", "list"])

        found = queries.mapInArrow(cells, "cell int, id long, v binary, d double, list int")
        if not large:
            return written(found)
        found = written(found)

        def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    ids, raw, c = b.column("ids")[i].values, b.column("vs")[i].values, matrix([b.column("centroids")[i]], dim)
                    dist = np.sqrt(np.maximum(0, 2 - 2 * unit(matrix(raw, dim)) @ c.T))
                    rows, cols = np.nonzero(dist <= two * dist.min(axis=1, keepdims=True) + 1e-12)
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), b.column("cell")[i].as_py(), dtype=np.int32)), ids.take(at), raw.take(at), pa.array(dist[rows, cols]), pa.array(cols.astype(np.int32))], names=["cell", "id", "v", "d", "list"])

        whole = found.join(fits.select("cell"), "cell", "left_anti").select("cell", "id", "v", "d", "list")
        cut = chunks(found.select("cell", "id", "v"), ["cell"], QUERY_CHUNK, ids="id", vs="v").join(fits, "cell").select("cell", "ids", "vs", "centroids")
        every = written(whole.union(cut.mapInArrow(lists, "cell int, id long, v binary, d double, list int")))
        least = every.groupBy("id").agg((F.min("d") * two + 1e-12).alias("most"))
        return written(every.join(least, "id").where("d <= most").select("cell", "id", "v", "d", "list"))

    tried = [(r.id, bytes(r.v)) for r in learnt[:: max(1, len(learnt) // calibrate)][:calibrate]]
    true = brute_force(vectors, tried, dim, k).collect()
    one = two = 1.0
    if true:
        asked = spark.createDataFrame(tried, "id long, v binary")
        wanted = F.broadcast(spark.createDataFrame([(r.query_id, r.vec_id) for r in true], "query_id long, vec_id long"))
        lists_of = written(postings.join(wanted, postings.id == wanted.vec_id).select("query_id", "vec_id", "cell", "list"))

        def needed(ways: DataFrame, by: list[str], share: float) -> float:
            """The ratio within which the share of the neighbours is met."""
            first = ways.groupBy("id").agg(F.min("d").alias("least"))
            met = lists_of.join(ways.join(first, "id").select(F.col("id").alias("query_id"), *by, (F.col("d") / F.greatest("least", F.lit(1e-12))).alias("r")), ["query_id", *by])
            need = [r.r for r in met.groupBy("query_id", "vec_id").agg(F.min("r").alias("r")).collect()]
            need += [max(need, default=1.0)] * (len(true) - len(need))
            return float(np.quantile(need, share, method="higher")) * (1 + 1e-9)

        one = needed(cells_only(asked, graph, dim), ["cell"], (1 + recall) / 2 if large else recall)
        two = needed(route(asked, one, 1e9), ["cell", "list"], (1 + recall) / 2) if large else 1.0

    asked = route(vectors.where(is_query), one, two)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                vid, v, qid, q = (b.column(c)[i].values for c in ("ids", "vs", "qids", "qs"))
                yield scored(best_of(matrix(q, dim), qid.to_numpy(), matrix(v, dim), vid.to_numpy(), k))

    at = ["cell", "list"]
    pairs = chunks(postings, at, CHUNK, ids="id", vs="v").join(chunks(asked, at, QUERY_CHUNK, qids="id", qs="v"), at).select("ids", "vs", "qids", "qs")
    return top(pairs.mapInArrow(compare, "query_id long, vec_id long, score double"), k)


def cells_only(queries: DataFrame, graph: Graph, dim: int) -> DataFrame:
    """(id, cell, d): all cells that the walk of a few queries sees."""
    rows = []
    for r in queries.collect():
        ids, dist = graph.search(unit(matrix([bytes(r.v)], dim)), 1e9)
        rows += [(r.id, int(i), float(d)) for i, d in zip(ids[0], dist[0], strict=True) if i >= 0]
    return queries.sparkSession.createDataFrame(rows, "id long, cell int, d double")


def op7_posting_list_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th vector among all."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)

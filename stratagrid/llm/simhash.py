"""SimHash near-duplicates by tiled exact comparison (Charikar 2002; blocks as in Manku, Jain and Das Sarma 2007)."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, join_to, remove, table, written

#: Words looked at at a time: bounds memory for texts of any length.
WORDS_AT_A_TIME = 1 << 16


#: Odd multipliers that make further 64-bit lanes of a shingle's hash (the first lane is the hash itself).
LANES = tuple((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64 for k in range(1, 64))


def hashes_of(text: str | None, width: int, seed: int) -> Iterator[np.ndarray]:
    """The XXH64 hashes of a text's shingles in order, with repeats: A-Z lower-cased, words split at ASCII white space, a
    shingle for every ``width`` words (fewer words: all of them). No words: nothing."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - width + 1) if words else 0
    for at in range(0, n, WORDS_AT_A_TIME):
        part = words[at : min(n, at + WORDS_AT_A_TIME) + width - 1]
        run = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1) - 1
        begins = np.concatenate(([0], ends[:-1] + 1))
        last = min(width, len(part)) - 1
        yield np.array([digest(run[a:b], seed) for a, b in zip(begins[: len(part) - last].tolist(), ends[last:].tolist(), strict=True)], dtype=np.uint64)


def shingles(text: str | None, width: int, seed: int) -> np.ndarray:
    """The different shingles of a text, as sorted hashes."""
    found = list(hashes_of(text, width, seed))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def print_of(parts: Iterable[np.ndarray], lanes: int) -> bytes:
    """The SimHash bits of hashes, 64 for each lane; a bit is 1 if set in over half. No hashes: 0."""
    ones, n = np.zeros((lanes, 64), dtype=np.int64), 0
    for hashes in parts:
        n += len(hashes)
        for lane in range(lanes):
            own = hashes if lane == 0 else (hashes ^ (hashes >> np.uint64(29))) * np.uint64(LANES[lane - 1])
            own = own if lane == 0 else own ^ (own >> np.uint64(32))
            for k in range(0, len(own), 4096):
                ones[lane] += np.unpackbits(own[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones.ravel() > n, bitorder="little").tobytes()


def bits_of(text: str | None, width: int, seed: int, lanes: int = 1) -> bytes:
    """The SimHash bits of a text's shingles, each as often as it stands there."""
    return print_of(hashes_of(text, width, seed), lanes)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash as a number."""
    return int.from_bytes(bits_of(text, width, seed), "little")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp long: the fingerprint's 64 bits as a signed number) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), width, seed) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"id {kind}, fp long")


def joined(a: np.ndarray, b: np.ndarray | None, radius: int, side: int = 256) -> list[tuple[int, int]]:
    """Pairs of row numbers that join what lies within ``radius`` in one tile (b is None) or between two; rows of b count
    on from those of a. Rows are prints of one or more 64-bit words. They are compared in squares of ``side``, by
    population count; a square whose counts all differ by more than the radius is skipped. Every link is found; returned
    is one pair for each member of a group but its first."""
    def by_ones(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        order = np.lexsort((x[:, 0], n))
        return x[order], n[order], order

    x, nx, ox = by_ones(a)
    y, ny, oy = (x, nx, ox) if b is None else by_ones(b)
    n = len(x)
    shift = 0 if b is None else n
    up = np.arange(n + (0 if b is None else len(y)))

    def roots(v: np.ndarray) -> np.ndarray:
        while (w := up[v])[up[w] != w].size:
            up[v] = up[w]
        return w

    for i in range(0, n, side):
        for j in range(i if b is None else 0, len(y), side):
            if ny[j] - nx[min(n, i + side) - 1] > radius:
                break
            if nx[i] - ny[min(len(y), j + side) - 1] > radius:
                continue
            away = np.bitwise_count(x[i : i + side, None, 0] ^ y[None, j : j + side, 0]).astype(np.int64)
            for k in range(1, x.shape[1]):
                away += np.bitwise_count(x[i : i + side, None, k] ^ y[None, j : j + side, k])
            us, vs = np.nonzero(away <= radius)
            us, vs = us + i, vs + j + shift
            while us.size:  # joins groups in parallel: each round halves their number at least
                ru, rv = roots(us), roots(vs)
                if not (new := ru != rv).any():
                    break
                us, vs, ru, rv = us[new], vs[new], ru[new], rv[new]
                np.minimum.at(up, np.maximum(ru, rv), np.minimum(ru, rv))
    name = ox if b is None else np.concatenate((ox, oy + n))
    top = roots(np.arange(len(up)))
    moved = np.flatnonzero(top != np.arange(len(up)))
    return list(zip(name[moved].tolist(), name[top[moved]].tolist(), strict=True))


def forest(left: np.ndarray, right: np.ndarray | None, radius: int, side: int = 256) -> list[tuple[int, int]]:
    """``joined`` for 64-bit prints, as pairs of prints."""
    every = left if right is None else np.concatenate((left, right))
    pairs = joined(left[:, None], None if right is None else right[:, None], radius, side)
    return [(int(every[u]), int(every[v])) for u, v in pairs]


def masks(n: int, radius: int, tile: int) -> list[int]:
    """Bit masks, signed, such that two prints within the radius agree under one of them at least: all choices of some of
    the blocks that the bits are cut into, with radius more blocks than are chosen. As many blocks are chosen as keep n
    random prints at about a tile for each value, three at most."""
    for agree in (1, 2, 3):
        blocks = radius + agree
        if n <= tile << (64 * agree // blocks):
            break
    own = [sum(1 << b for b in range(64 * k // blocks, 64 * (k + 1) // blocks)) for k in range(blocks)]
    every = [sum(own[k] for k in kept) for kept in itertools.combinations(range(blocks), agree)]
    return [m - (1 << 64) if m >> 63 else m for m in every]


def links(prints: DataFrame, radius: int = 3, tile: int = 1024, n: int | None = None) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp, n of them) that join exactly what links within ``radius``
    joins.

    Prints that agree under a mask (see ``masks``) are compared in tiles of about ``tile``: a bucket that fits is one
    tile; a larger one is dealt to tiles by population count and a hash, and all pairs of its tiles are compared but
    those whose population counts differ by more than the radius. No bucket is capped, and no task holds more than two
    tiles. With the number of prints the masks widen, so that buckets stay at about a tile."""
    cut = F.array(*(F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("value")) for k, m in enumerate(masks(prints.count() if n is None else n, radius, tile))))
    rows = prints.select("fp", F.bit_count("fp").alias("ones"), F.explode(cut).alias("c")).select("c.block", "c.value", "ones", "fp")
    large = rows.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("block", "value")
    parts = (
        rows.join(large, ["block", "value"])
        .groupBy("block", "value", "ones")
        .agg(F.ceil(F.count("*") / tile).alias("parts"))
    )
    tiles = (
        rows.join(parts, ["block", "value", "ones"], "left")
        .select("block", "value", F.when(F.col("parts").isNull(), -1).otherwise(F.col("ones")).alias("ones"), F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).alias("part"), "fp")
        .groupBy("block", "value", "ones", "part")
        .agg(F.collect_list("fp").alias("fps"))
    )

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges: list[tuple[int, int]] = []
            for x in b.column("fps"):
                edges += forest(x.values.to_numpy().view(np.uint64), None, radius)
            yield as_edges(edges)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges: list[tuple[int, int]] = []
            for x, y in zip(b.column("fps"), b.column("more"), strict=True):
                edges += forest(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), radius)
            yield as_edges(edges)

    def as_edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        got = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["u", "v"])

    alone = tiles.where(F.size("fps") > 1).select("fps").mapInArrow(own, "u long, v long")
    split = tiles.where("ones >= 0")
    other = split.select("block", "value", F.col("ones").alias("ones2"), F.col("part").alias("part2"), F.col("fps").alias("more"))
    pairs = split.join(other, ["block", "value"]).where(
        (F.col("ones2") - F.col("ones")).between(0, radius) & ((F.col("ones2") > F.col("ones")) | (F.col("part2") > F.col("part")))
    )
    return alone.union(pairs.select("fps", "more").mapInArrow(across, "u long, v long"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3, seed: int = 42, tile: int = 1024) -> DataFrame:
    """One row for each row of df: key, fingerprint (16 hex digits), component_id: the smallest key among all rows whose
    fingerprints can be reached by steps of at most ``radius`` bits, the row itself included.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows that repeat a key each have a row.
    Null keys take no part in the smallest key; a group of null keys alone has a null component. Other columns are not
    carried, whatever their names. Empty table: no rows. Texts and their copies meet as one fingerprint, so groups of
    copies cost no pairs."""
    prints = written(fingerprints(df, key, text, width, seed))
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    edges = written(links(nodes, radius, tile))
    reached = components(edges)
    remove(edges)
    joined = nodes.join(reached, nodes.fp == reached.node, "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("group"))
    ids = joined.groupBy("group").agg(F.min("least").alias("smallest"), F.count("*").alias("n")).where("n > 1")
    names = join_to(joined, ids, "group", F.col("fp")).select("fp", "n", F.coalesce("smallest", "least").alias("component_id"))
    return join_to(prints, names, "fp", F.xxhash64("id")).select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def few(buckets: DataFrame, limit: int = 100_000) -> DataFrame:
    """A table of large buckets, written and counted: broadcast up to ``limit`` rows of under 40 bytes, so that the prints
    are not shuffled to meet it; a longer one is joined as Spark sees fit."""
    kept = written(buckets)
    return F.broadcast(kept) if kept.count() <= limit else kept


def words(fps: list[bytes]) -> np.ndarray:
    """Prints as rows of 64-bit words."""
    return np.frombuffer(b"".join(fps), dtype=np.uint64).reshape(len(fps), -1)


def wide_links(prints: DataFrame, radius: int, tile: int = 512) -> DataFrame:
    """Edges (u, v) of node numbers that join the prints (columns node long, fp binary, ones int) within ``radius`` that
    agree in one 12-bit block at least. A bucket of equal blocks that fits is one tile; a larger one is dealt to tiles by
    population count, in steps of the radius, and a hash; all pairs of its tiles are compared but those whose counts
    differ by more than the radius. No bucket is capped. Edges are those of ``joined``, whose ends may be further apart
    than the radius."""
    width = 3
    h = F.hex("fp")
    rows = prints.select("node", "fp", "ones", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("fp") * 2 - width + 1, F.lit(width)), lambda at: F.substring(h, at, F.lit(width)))).alias("block", "value"))
    step = F.floor(F.col("ones") / F.lit(radius + 1)).cast("int")
    large = few(rows.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("block", "value"))
    parts = few(rows.join(large, ["block", "value"]).groupBy("block", "value", step.alias("step")).agg(F.ceil(F.count("*") / tile).alias("parts")))
    dealt = rows.withColumn("step", step).join(parts, ["block", "value", "step"], "left")
    dealt = dealt.select("block", "value", F.when(F.col("parts").isNull(), -1).otherwise(F.col("step")).alias("step"), F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).alias("part"), "node", "fp")
    tiles = dealt.groupBy("block", "value", "step", "part").agg(F.collect_list("node").alias("nodes"), F.collect_list("fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = [], []
            for i in range(b.num_rows):
                found = [b.column(c)[i].values for c in range(b.num_columns)]
                nodes = np.concatenate([x.to_numpy() for x in found[::2]])
                x, y = words(found[1].to_pylist()), words(found[3].to_pylist()) if len(found) > 2 else None
                for u, v in joined(x, y, radius):
                    us.append(nodes[u])
                    vs.append(nodes[v])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    alone = tiles.where(F.size("nodes") > 1).select("nodes", "fps").mapInArrow(run, "u long, v long")
    split = tiles.where("step >= 0")
    other = split.select("block", "value", F.col("step").alias("step2"), F.col("part").alias("part2"), F.col("nodes").alias("nodes2"), F.col("fps").alias("fps2"))
    pairs = split.join(other, ["block", "value"]).where((F.col("step2") - F.col("step")).between(0, 1) & ((F.col("step2") > F.col("step")) | (F.col("part2") > F.col("part"))))
    return alone.union(pairs.select("nodes", "fps", "nodes2", "fps2").mapInArrow(run, "u long, v long"))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) if len(a) or len(b) else 1.0


def join_labels(one: list[dict], two: list[dict] | None, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Edges between nodes of a tile (two is None), or of two tiles, whose prints are within the radius and whose shingles
    are alike: one for each label but the first of those that the tiles' links join. Nodes are dicts of node, label, fp
    and shingles. Labels that are joined already are compared no more."""
    x, y = words([r["fp"] for r in one]), words([r["fp"] for r in (two or one)])
    sets = [[np.asarray(r["shingles"], dtype=np.int64) for r in rows] for rows in (one, two or one)]
    names, number = np.unique([r["label"] for r in [*one, *(two or [])]], return_inverse=True)
    of_x, of_y = number[: len(one)], number[len(one) :] if two else number
    up = np.arange(len(names))
    edges = []
    for i in range(len(one)):
        at = 0 if two else i + 1
        near = at + np.flatnonzero(np.bitwise_count(y[at:] ^ x[i]).sum(axis=1, dtype=np.int64) <= radius)
        for j in near[up[of_y[near]] != up[of_x[i]]].tolist():
            a, b = up[of_x[i]], up[of_y[j]]
            if a != b and jaccard(sets[0][i], sets[1][j]) >= similarity:
                edges.append((one[i]["node"], (two or one)[j]["node"]))
                up[up == max(a, b)] = min(a, b)
    return edges


def label_links(nodes: DataFrame, radius: int, similarity: float, tile_bytes: int = 2 << 20) -> DataFrame:
    """Edges (u, v) that join what links between different labels of one component join: prints within the radius and
    shingles alike. ``nodes``: component, label, node, fp, ones, shingles (sorted).

    A component's nodes are dealt to tiles of about ``tile_bytes``: those of a label with more have tiles of its own, the
    others share tiles. Tiles are compared in pairs but those of one label alone, and those whose population counts differ
    by more than the radius; no more than two tiles are held at a time, and a pair of tiles gives no more edges than it
    has labels. No component is capped."""
    size = F.size("shingles") * 8 + F.length("fp") + 64
    sized = written(nodes.groupBy("component", "label").agg(F.sum(size).alias("bytes")))
    large = F.col("bytes") > tile_bytes
    shared = sized.where(~large).groupBy("component").agg(F.ceil(F.sum("bytes") / tile_bytes).alias("shared"))
    deal = few(sized.join(shared, "component", "left").select("component", "label", large.alias("pure"), F.when(large, F.ceil(F.col("bytes") / tile_bytes)).otherwise(F.col("shared")).cast("long").alias("parts")))
    dealt = nodes.join(deal, ["component", "label"])
    part = F.pmod(F.xxhash64(F.when(F.col("pure"), F.col("node")).otherwise(F.col("label"))), F.col("parts"))
    dealt = dealt.withColumn("own", F.when(F.col("pure"), F.col("label"))).withColumn("tile", F.xxhash64("pure", "own", part))
    tiles = written(dealt.groupBy("component", "tile", "own").agg(F.min("ones").alias("lo"), F.max("ones").alias("hi"), F.collect_list(F.struct("node", "label", "fp", "shingles")).alias("rows")))
    one = tiles.select("component", "tile", "own", "lo", "hi")
    two = one.select("component", *(F.col(c).alias(f"{c}2") for c in ("tile", "own", "lo", "hi")))
    pairs = one.join(two, "component").where((F.col("tile") < F.col("tile2")) & ~F.coalesce(F.col("own") == F.col("own2"), F.lit(False)) & (F.col("lo") - F.col("hi2") <= radius) & (F.col("lo2") - F.col("hi") <= radius))
    held = tiles.select("component", "tile", "rows")
    met = written(pairs.select("component", "tile", "tile2")).join(held, ["component", "tile"]).join(held.select("component", F.col("tile").alias("tile2"), F.col("rows").alias("rows2")), ["component", "tile2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = [b.column(c)[i].as_py() for c in range(b.num_columns)]
                edges = np.array(join_labels(found[0], found[1] if len(found) > 1 else None, radius, similarity), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["u", "v"])

    alone = tiles.where(F.col("own").isNull() & (F.size("rows") > 1)).select("rows").mapInArrow(run, "u long, v long")
    return alone.union(met.select("rows", "rows2").mapInArrow(run, "u long, v long"))


def alike(similarity: float, a: str, b: str) -> Column:
    """Whether two arrays of different shingles have that Jaccard similarity or more."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both) >= F.lit(similarity)


def exact_links(nodes: DataFrame, found: DataFrame, sets: DataFrame, radius: int, similarity: float, rounds: int = 4) -> DataFrame:
    """Edges (u, v) between nodes that share the part ``similarity`` of their shingles, which join all that the candidate
    pairs (prints within the radius that agree in a block) with that similarity join. ``found``: (node, component) of the
    candidates' groups; ``sets``: (node, shingles) of their nodes.

    Pairs in one group are too many where a group is large. So some rounds compare each node of a group with one of
    them, and those alike are done with; what is then still apart in a group is compared in tiles (``label_links``)."""
    left = found.join(sets, "node")
    edges = None
    for _ in range(rounds):
        left = written(left)
        heads = left.groupBy("component").agg(F.min("node").alias("head"), F.count("*").alias("n"))
        heads = heads.join(left.select(F.col("node").alias("head"), F.col("shingles").alias("those")), "head")
        met = join_to(left, heads, "component", F.col("node"), hot=1000, row_bytes=F.size("those") * 8 + 64)
        near = written(met.where(alike(similarity, "shingles", "those")).select(F.col("node").alias("u"), F.col("head").alias("v")))
        edges = near if edges is None else edges.union(near)
        left = left.join(near.select(F.col("u").alias("node")), "node", "left_anti")
        if left.limit(1).count() == 0:
            break
    heads = edges.select(F.col("u").alias("node"), F.col("v").alias("head"))
    labels = found.join(heads, "node", "left").select("node", "component", F.coalesce("head", "node").alias("label"))
    several = labels.groupBy("component").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("component")
    open_ = written(labels.join(few(several), "component", "left_semi").select("component", "node", "label"))
    return edges.union(label_links(nodes.select("node", "fp", "ones").join(open_, "node").join(sets, "node"), radius, similarity))


def similar_documents(df: DataFrame, similarity: float = 0.8, key: str = "doc_id", text: str = "text", width: int = 5, seed: int = 42, lanes: int = 8) -> DataFrame:
    """(key, component_id) as ``near_duplicates`` has them, for links of texts that share the given part of their different
    shingles (Jaccard, exact). Candidates come from prints of ``lanes`` times 64 bits: at a similarity J, sets of about
    one size have a cosine of 2 J / (1 + J), and bits differ with probability arccos / pi. The radius is the expected
    difference at ``similarity`` and three standard deviations; candidates agree in one of 42 blocks of 12 bits too (8
    lanes). With independent bits both hold for 0.997 of the pairs at 0.8. Each candidate pair counts only if the shingles
    themselves are alike. Rows with the same shingles are one node. Nulls, ties, repeated keys and empty tables: as there."""
    miss = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits = 64 * lanes
    radius = int(bits * miss + 3 * np.sqrt(bits * miss * (1 - miss)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            fps, nodes = [], []
            for t in b.column(1):
                own = shingles(t.as_py(), width, seed)
                fps.append(print_of([own], lanes))
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), seed))
            ones = np.bitwise_count(np.frombuffer(b"".join(fps), dtype=np.uint64).reshape(len(fps), lanes)).sum(axis=1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), pa.array(ones), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), b.column(2)], names=["id", "fp", "ones", "node", "text_id"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t.as_py(), width, seed).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int64()))], names=["node", "shingles"])

    kind = df.schema[key].dataType.simpleString()
    texts = df.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("text_id", F.xxhash64("t"))
    prints = written(texts.select("id", "t", "text_id").mapInArrow(run, f"id {kind}, fp binary, ones int, node long, text_id long"))
    nodes = written(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.first("ones").alias("ones"), F.min("id").alias("least"), F.count("*").alias("n"), F.min(F.struct("text_id", F.xxhash64("id").alias("id_hash"))).alias("one")))
    found = written(components(written(wide_links(nodes, radius))))
    # Of a node's copies one row is asked for, so that hot texts don't meet.
    asked = nodes.join(found, "node", "left_semi").select("node", "one.text_id", "one.id_hash")
    sets = texts.select("t", "text_id", F.xxhash64("id").alias("id_hash")).join(asked, ["text_id", "id_hash"]).groupBy("node").agg(F.first("t").alias("t"))
    sets = written(sets.mapInArrow(sets_of, "node long, shingles array<long>"))
    reached = components(written(exact_links(nodes, found, sets, radius, similarity)))
    remove(sets)
    group = nodes.join(reached, "node", "left").select("node", "n", "least", F.coalesce("component", "node").alias("group"))
    smallest = group.groupBy("group").agg(F.min("least").alias("smallest"), F.count("*").alias("n")).where("n > 1")
    names = join_to(group, smallest, "group", F.col("node")).select("node", "n", F.coalesce("smallest", "least").alias("component_id"))
    found = join_to(prints.select("id", "node"), names, "node", F.xxhash64("id")).select(F.col("id").alias(key), "component_id")
    remove(nodes)
    return found


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: 3-word shingles, radius 3."""
    return near_duplicates(table(spark, sf_dir, "documents"))

"""Packing of token sequences by non-negative least squares (Krell, Kosec, Perez and Fitzgibbon 2021, "Efficient
Sequence Packing without Cross-contamination")."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dense_positions, table, written

#: Least number of parts that a length's pieces are dealt to when they are numbered; more for more than 64 million rows.
SALTS = 64


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file lies (the package is installed beside Python, here under /opt/tokenizers)."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The added token of byte_bpe_50k.json, which ``tokenizers`` finds in any text.
SPECIAL = {"<|endoftext|>": 50256}


def encoder(ranks_file: str, pattern: str, special: dict[str, int] | None = None):
    """Text to token ids. tiktoken over the same byte-pair vocabulary gives the ids that ``tokenizers`` gives for the
    .json file (tests hold the two against each other) in a third of the time. The strings in ``special`` are the tokens
    named there, as with ``tokenizers`` at its defaults; others are ordinary text."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})
    return (lambda text: own.encode(text, allowed_special="all")) if special else own.encode_ordinary


def combinations(window: int) -> np.ndarray:
    """All ways to fill the window with two or three lengths: rows (a, b, c), a >= b >= c, zeros for none."""
    a = np.arange(1, window)
    two = np.stack([a[a >= window - a], window - a[a >= window - a], np.zeros_like(a[a >= window - a])], axis=1)
    b, c = np.meshgrid(a, a, indexing="ij")
    first = window - b - c
    ok = (first >= b) & (b >= c)
    return np.concatenate([two, np.stack([first[ok], b[ok], c[ok]], axis=1)]).astype(np.int64)


def nnls(strategies: np.ndarray, counts: np.ndarray, least: float = 0.5, rounds: int = 20_000) -> np.ndarray:
    """x >= 0 that minimises |A x - counts| with A[l, s] = pieces of length l in strategy s: coordinate descent, always
    on the strategy whose best step is the longest, until no step is longer than ``least`` (rounding would hide it).
    From zero this uses few strategies, as rounding needs. counts[l] is the histogram; counts[0] is ignored."""
    one, two, three = (strategies[:, k] for k in range(3))
    miss = counts.astype(np.float64)
    miss[0] = 0.0
    same = (one == two).astype(np.int64) * (two > 0) + (two == three) * (three > 0) + (one == three) * (three > 0)
    norm = ((one > 0).astype(np.float64) + (two > 0) + (three > 0)) + 2.0 * same
    x = np.zeros(len(strategies))
    for _ in range(rounds):
        step = np.maximum(-x, (miss[one] + miss[two] + miss[three]) / norm)
        s = int(np.argmax(np.abs(step)))
        if abs(step[s]) <= least:
            break
        x[s] += step[s]
        for u in (one[s], two[s], three[s]):
            if u:
                miss[u] -= step[s]
    return x


def plan(counts: np.ndarray, window: int) -> list[tuple[int, tuple[tuple[int, int, int], ...]]]:
    """What to pack from a histogram of lengths 1 to window-1: (repeats, parts), and a part is (length, from, to): the
    tokens [from, to) of a piece of that length. Every piece is used whole, or cut into parts of which each is used once.

    The solution of the least squares is rounded and trimmed to the histogram. What is left is packed greedily: the
    longest piece first, then the longest that fits; where none fits, one is cut, and its rest goes back. So all
    sequences are full but the last, which is cut into powers of two (those need no padding)."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    found: list[tuple[int, tuple[tuple[int, int, int], ...]]] = []
    ways = combinations(window)
    x = np.floor(nnls(ways, left) + 0.5).astype(np.int64)
    for s in np.argsort(-x, kind="stable")[: int((x > 0).sum())].tolist():
        lengths = [int(v) for v in ways[s] if v]
        times = min(int(x[s]), *(left[v] // lengths.count(v) for v in lengths))
        if times > 0:
            for v in lengths:
                left[v] -= times
            found.append((int(times), tuple((v, 0, v) for v in lengths)))
    # Rests: a whole piece of length v is (v, 0); a rest that starts at f is (v, f). All of one kind are interchangeable.
    rest: dict[tuple[int, int], int] = {(int(v), 0): int(left[v]) for v in np.flatnonzero(left)}
    size = lambda k: k[0] - k[1]
    while rest:
        order = sorted(rest, key=lambda k: (-size(k), k))
        room, parts, need = window, [], {}
        while room:
            fit = next((k for k in order if size(k) <= room and rest[k] - need.get(k, 0) > 0), None)
            if fit is None:
                break
            parts.append((fit[0], fit[1], fit[0]))
            need[fit] = need.get(fit, 0) + 1
            room -= size(fit)
        cut = None
        if room:
            cut = next((k for k in reversed(order) if size(k) > room and rest[k] - need.get(k, 0) > 0), None)
            if cut:
                parts.append((cut[0], cut[1], cut[1] + room))
                need[cut] = need.get(cut, 0) + 1
        times = min(rest[k] // n for k, n in need.items())
        full = room == 0 or cut is not None
        for k, n in need.items():
            rest[k] -= n * (times if full else 1)
            if not rest[k]:
                del rest[k]
        if full:
            found.append((times, tuple(parts)))
            if cut:
                key = (cut[0], cut[1] + room)
                rest[key] = rest.get(key, 0) + times
        else:  # all that is left is less than a window: lengths that are powers of two
            found += [(1, p) for p in powers(parts)]
    return found


def powers(parts: list[tuple[int, int, int]]) -> list[tuple[tuple[int, int, int], ...]]:
    """The parts, cut into sequences whose lengths are the powers of two in their sum."""
    total, out, queue = sum(b - a for _, a, b in parts), [], list(parts)
    for bit in range(total.bit_length() - 1, -1, -1):
        room = total & (1 << bit)
        own = []
        while room:
            v, a, b = queue.pop(0)
            take = min(room, b - a)
            own.append((v, a, a + take))
            if take < b - a:
                queue.insert(0, (v, a + take, b))
            room -= take
        if own:
            out.append(tuple(own))
    return out


def placements(chosen: list[tuple[int, tuple[tuple[int, int, int], ...]]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, cut from, cut to, first rank, last rank + 1, first sequence, offset) of each part of a plan: the pieces
    of a length that have these ranks give these tokens to consecutive sequences. Parts that start at 0 take new ranks;
    a part further on goes to the pieces whose earlier parts are placed, in the order in which they were."""
    ranks: dict[tuple[int, int], list[list[int]]] = {}  # (length, token to place next): runs of ranks
    fresh: dict[int, int] = {}
    out, sequence = [], 0
    for times, parts in chosen:
        offset = 0
        for v, a, b in parts:
            want, at = times, sequence
            queue = ranks.setdefault((v, a), [])
            if a == 0:
                queue.append([fresh.get(v, 0), fresh.get(v, 0) + times])
                fresh[v] = fresh.get(v, 0) + times
            while want:
                lo, hi = queue[0]
                n = min(want, hi - lo)
                out.append((v, a, b, lo, lo + n, at, offset))
                if b < v:
                    ranks.setdefault((v, b), []).append([lo, lo + n])
                queue[0][0] += n
                if queue[0][0] == queue[0][1]:
                    queue.pop(0)
                want, at = want - n, at + n
            offset += b - a
        sequence += times
    return out


def pack(df: DataFrame, window: int = 1024, key: str = "doc_id", text: str = "text", ranks: str = "byte_bpe_50k.tiktoken", end: int = 0, special: dict[str, int] | None = SPECIAL) -> DataFrame:
    """One row for each piece of each row of df: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A row's ids are its text's, then ``end``. Full windows are sequences of their own. The rests, shorter than a window,
    are counted by length (a histogram of window-1 numbers, all that the driver sees), planned by ``plan``, and numbered
    within their length by parts, so that no task holds all pieces of a length. Null text: as empty, the end id alone.
    Rows that repeat a key, and null keys, are each packed. Other columns are not carried. Empty table: no rows. Ids are
    made once; those of a rest are kept (2 bytes each) until it is placed."""
    import public_tokenizers

    file, pattern, spark = vocabulary_path(ranks), public_tokenizers.PATTERN, df.sparkSession

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        encode = encoder(file, pattern, special)
        for b in (x.slice(k, 512) for x in batches for k in range(0, x.num_rows, 512)):  # ids of a few rows at a time
            n, crcs, rests = [], [], []
            for t in b.column(1):
                ids = np.array([*encode(t.as_py() or ""), end], dtype="<u4")
                full = len(ids) // window * window
                n.append(len(ids))
                crcs.append([zlib.crc32(ids[i : i + window].tobytes()) for i in range(0, full, window)])
                rests.append(ids[full:].astype("<u2" if ids.max() < 65536 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary())], names=["id", "n", "crcs", "rest"])

    kind = df.schema[key].dataType.simpleString()
    made = written(df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(tokens, f"id {kind}, n long, crcs array<long>, rest binary"))
    tail, body = F.col("n") % window, F.floor(F.col("n") / F.lit(window))
    sizes = made.where(tail > 0).groupBy(tail.cast("int").alias("size")).count().collect()  # window - 1 rows at most
    counts = np.zeros(window, dtype=np.int64)
    for r in sizes:
        counts[r["size"]] = r["count"]
    chosen = plan(counts, window)
    salts = min(1024, max(SALTS, int(counts.sum()) // 1_000_000))
    placed = spark.createDataFrame(placements(chosen), "size int, a int, b int, lo long, hi long, sequence long, offset int")
    first = sum(t for t, _ in chosen)
    mixed = F.xxhash64(F.lit("pack"), "id", "n")
    order = ["id", "n", F.crc32("rest")]

    # The plan has a few thousand rows for any input: rounding leaves less than one piece for each strategy used.
    ranked = dense_positions(made.where(tail > 0).withColumn("size", tail.cast("int")), ["size"], order, mixed, "rank", salts)
    rests = ranked.join(F.broadcast(placed), "size").where("rank >= lo and rank < hi")
    rests = rests.select("id", (F.col("n") - F.col("size") + F.col("a")).alias("start"), (F.col("b") - F.col("a")).cast("long").alias("length"), "rest", "n", "size", "a", (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("offset").cast("long").alias("offset"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            got = []
            for raw, size, a, n in zip(b.column("rest"), b.column("size").to_pylist(), b.column("a").to_pylist(), b.column("length").to_pylist(), strict=True):
                raw = raw.as_buffer()
                ids = np.frombuffer(raw, dtype="<u2" if raw.size == 2 * size else "<u4")
                got.append(zlib.crc32(ids[a : a + n].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("start"), b.column("length"), pa.array(got, pa.int64()), b.column("n"), b.column("sequence_id"), b.column("offset")], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    columns = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    pieces = rests.mapInArrow(check, columns)
    whole = made.where(body > 0).withColumn("full", body.cast("long")).withColumn("one", F.lit(1)).select("id", "n", "crcs", "full", "one", F.xxhash64("crcs").alias("mark"))
    whole = dense_positions(whole, ["one"], ["id", "n", "mark"], mixed, "before", salts, "full")
    whole = whole.select("id", "n", "before", F.posexplode("crcs").alias("k", "crc")).select("id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.lit(first) + F.col("before") + F.col("k")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.union(whole).withColumnRenamed("id", key)


def op4_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into sequences of 1024."""
    return pack(table(spark, sf_dir, "documents"))

"""Near-duplicate lines: a segment-partition edit join (PassJoin: Li, Deng, Wang and Feng 2011), in DataFrame operations only.

Edit distances count code points. Two lines link when both have at least ``min_chars`` code points and their distance is
at most ``distance``; shorter lines (by default those under 6, of which two may have nothing in common at a distance of
2) link with equal ones alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, join_to, remove, table, written

#: Letters whose counts a line's histogram holds, a class each; all other characters are one more class. An edit changes
#: the sum of the counts' differences by 2 at most, so a pair within the distance has a sum of twice the distance at most.
#: Digits tell apart the lines that one template makes with numbers.
LETTERS, DIGITS = "etnarosilhdcump gbfvwyk,.xj", "0123456789"
#: Lines that share one segment hash: above this many the segment is crowded and its lines are told apart by histogram.
CROWDED = 16
#: Candidate ids up to this many (8 bytes each) are broadcast to the scan that fetches their lines; more are joined.
BROADCAST_IDS = 500_000


def lines_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no, line, id, n_chars) for every line of every row: a text is cut at each line feed. A null text has
    no lines, an empty one has one empty line. id is the line's 64-bit XXH64; two lines of n collide with odds n^2/2^65."""
    cut = df.select(F.col(key).alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return cut.select("doc", F.col("line_no").cast("long").alias("line_no"), "line", F.xxhash64("line").alias("id"), F.char_length("line").alias("n_chars"))


def segment(k: int, parts: int, length: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment k of a line of the given length cut into ``parts`` about equal segments."""
    start = F.floor(length * k / F.lit(parts)).cast("int")
    return start, F.floor(length * (k + 1) / F.lit(parts)).cast("int") - start


def index_key(k: int, distance: int) -> Column:
    """A line's own index entry for segment k: the hash of its length, k and the segment."""
    start, size = segment(k, distance + 1, F.col("n_chars"))
    return F.xxhash64("n_chars", F.lit(k), F.substring(F.col("line"), start + 1, size))


def probe_keys(distance: int) -> list[Column]:
    """The index entries of lines up to ``distance`` shorter that a line probes. For a line shorter by d, segment k of
    it can stand in this line only where at most k edits lie before it and at most distance-k behind it."""
    found = []
    for d in range(distance + 1):
        other = F.col("n_chars") - d
        for k in range(distance + 1):
            start, size = segment(k, distance + 1, other)
            for shift in range(max(-k, d - (distance - k)), min(k, d + (distance - k)) + 1):
                at = start + shift
                found.append(F.when((at >= 0) & (at + size <= F.col("n_chars")), F.xxhash64(other, F.lit(k), F.substring(F.col("line"), at + 1, size))))
    return found


def histogram() -> Column:
    """The counts of LETTERS, of DIGITS and of the rest in a line."""
    count = lambda x: F.col("n_chars") - F.char_length(F.replace("line", F.lit(x), F.lit("")))
    with_digits = F.col("line").rlike("[0-9]")
    return F.array(*map(count, LETTERS), *(F.when(with_digits, count(x)).otherwise(0) for x in DIGITS), F.char_length(F.translate("line", LETTERS + DIGITS, "")))


def may_match(a: str, b: str, distance: int) -> Column:
    """Whether two histograms allow a distance; true for every pair within it."""
    total = F.lit(0)
    for k in range(len(LETTERS) + len(DIGITS) + 1):
        total = total + F.abs(F.col(a)[k] - F.col(b)[k])
    return total <= 2 * distance


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once for each row and names it in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def bounded_edit_distance(pairs: DataFrame, distance: int, a: str = "a", b: str = "b") -> DataFrame:
    """Adds ``edits``: the edit distance of columns a and b if at most ``distance``, else null.

    Common ends are cut off. Then a banded bit-parallel automaton reads the shorter rest: bit d of row e says that what
    was read matches the other rest up to d-distance code points further with at most e edits. A row is one integer of
    2*distance+1 bits; each character costs a few integer operations for each row."""
    width = 2 * distance + 1
    full = (1 << width) - 1
    halves = ", ".join(str(1 << k) for k in range(30, -1, -1))
    shared = "aggregate(array({h}), 0, (n, k) -> if(k <= char_length({p}.s) - n and {side}({p}.s, n + k) = {side}({p}.l, n + k), n + k, n))"
    masks = " + ".join(f"if(get(y, i + {d - distance}) = c, {1 << d}, 0)" for d in range(width))
    rows = ["(s.r0 & m)"]
    for e in range(1, distance + 1):
        rows.append(f"((s.r{e} & m) | s.r{e - 1} | shiftright(s.r{e - 1}, 1) | (shiftleft({rows[-1]}, 1) & {full}))")
    first = ", ".join(f"'r{e}', {sum(1 << (distance + d) for d in range(e + 1))}" for e in range(distance + 1))
    step = ", ".join(f"'r{e}', {r}" for e, r in enumerate(rows))
    read = let("regexp_extract_all(q.l, '(?s).', 0)", "y", f"aggregate(transform(regexp_extract_all(q.s, '(?s).', 0), (c, i) -> {masks}), named_struct({first}), (s, m) -> named_struct({step}))")
    ahead = "(char_length(q.l) - char_length(q.s))"
    cases = " ".join(f"when (shiftright(z.r{e}, {distance} + {ahead}) & 1) = 1 then {e}" for e in range(distance + 1))
    body = f"if(char_length(q.s) = 0, {ahead}, {let(read, 'z', f'case {cases} end')})"
    body = let(shared.format(h=halves, p="o", side="right"), "w", let("named_struct('s', left(o.s, char_length(o.s) - w), 'l', left(o.l, char_length(o.l) - w))", "q", body))
    body = let(shared.format(h=halves, p="p", side="left"), "v", let("named_struct('s', substring(p.s, v + 1), 'l', substring(p.l, v + 1))", "o", body))
    body = let(f"if(char_length({a}) <= char_length({b}), named_struct('s', {a}, 'l', {b}), named_struct('s', {b}, 'l', {a}))", "p", body)
    return pairs.withColumn("edits", F.expr(f"if(abs(char_length({a}) - char_length({b})) <= {distance}, {body}, null)"))


def small(df: DataFrame) -> DataFrame:
    """df, a written table of 8-byte columns, to be broadcast if its counted rows are few, else joined as Spark sees fit."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def edit_links(lines: DataFrame, distance: int = 2, min_chars: int = 6) -> DataFrame:
    """(u, v, edits): every pair of different lines of ``lines_of`` within the distance, u < v by id.

    Each different line is reduced to its segment hashes before the first shuffle, so that a line that stands in a
    third of all rows is one row of each task; texts are fetched again for candidates alone."""
    parts = distance + 1
    if min_chars < 2 * parts:
        raise ValueError("min_chars must be at least twice the number of segments")
    probes = probe_keys(distance)
    wide = lines.where(F.col("n_chars") >= min_chars).select(
        "id", *(index_key(k, distance).alias(f"i{k}") for k in range(parts)), *(p.alias(f"p{k}") for k, p in enumerate(probes))
    )
    unique = written(wide.groupBy("id").agg(*(F.max(c).alias(c) for c in wide.columns[1:])))
    index = unique.select("id", F.explode(F.array(*(f"i{k}" for k in range(parts)))).alias("key"))
    probe = unique.select(F.col("id").alias("id2"), F.explode(F.array(*(f"p{k}" for k in range(len(probes))))).alias("key")).where("key is not null")
    crowded = written(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("key"))
    many = small(crowded)
    met = index.join(many, "key", "left_anti").join(probe, "key").where("id <> id2").select("id", "id2")
    met = met.union(crowded_pairs(lines, index.join(many, "key", "left_semi"), probe.join(many, "key", "left_semi"), distance))
    candidates = written(met.select(F.least("id", "id2").alias("u"), F.greatest("id", "id2").alias("v")).distinct())
    remove(unique)
    ids = small(written(candidates.select(F.col("u").alias("id")).union(candidates.select("v")).distinct()))
    texts = lines.select("id", "line").join(ids, "id", "left_semi").groupBy("id").agg(F.first("line").alias("line"))
    texts = written(texts.withColumn("n_chars", F.char_length("line")).select("id", "line", histogram().alias("h")))
    one, two = (texts.select(F.col("id").alias(i), F.col("line").alias(t), F.col("h").alias(h)) for i, t, h in (("u", "a", "ha"), ("v", "b", "hb")))
    # The histograms are a cheap bound of the distance; most pairs of other words with a segment in common end here.
    pairs = candidates.join(one, "u").join(two, "v").where(may_match("ha", "hb", distance)).select("u", "v", "a", "b")
    found = written(bounded_edit_distance(pairs, distance).where("edits is not null").select("u", "v", "edits"))
    remove(candidates)
    remove(texts)
    return found


def crowded_pairs(lines: DataFrame, index: DataFrame, probe: DataFrame, distance: int) -> DataFrame:
    """(id, id2) of the lines that meet in a crowded segment and whose histograms allow the distance. The counts of the
    two commonest letters, in bins, are part of the join's key, which deals one crowded segment to many tasks."""
    index, probe = written(index), written(probe)
    ids = small(written(index.select("id").union(probe.select("id2")).distinct()))
    counts = written(lines.select("id", "line", "n_chars").join(ids, "id", "left_semi").select("id", histogram().alias("h")).groupBy("id").agg(F.max("h").alias("h")))
    bin_ = 2 * distance + 1
    left = index.join(counts, "id").select("key", "id", "h", F.floor(F.col("h")[0] / F.lit(bin_)).alias("x"), F.floor(F.col("h")[1] / F.lit(bin_)).alias("y"))
    near = lambda k: F.array_distinct(F.array(F.floor((F.col("h2")[k] - distance) / F.lit(bin_)), F.floor((F.col("h2")[k] + distance) / F.lit(bin_))))
    right = probe.join(counts.select(F.col("id").alias("id2"), F.col("h").alias("h2")), "id2")
    right = right.select("key", "id2", "h2", F.explode(near(0)).alias("x")).select("key", "id2", "h2", "x", F.explode(near(1)).alias("y"))
    return left.join(right, ["key", "x", "y"]).where((F.col("id") != F.col("id2")) & may_match("h", "h2", distance)).select("id", "id2")


def near_duplicate_lines(df: DataFrame, distance: int = 2, min_chars: int = 6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each line of each row of df: key, line_no (from 0), n_chars, class_doc_id and class_line_no (the first
    line, by key and number, that equal lines and links reach), n_links (different lines within the distance of this
    one), n_copies (rows with an equal line, this one included), first boolean (this is the class's first line).

    Null texts have no lines; empty texts have an empty one. Null keys come first in the order. Where rows repeat a key,
    lines tie and each tied line counts as first. Other columns are not carried, whatever their names. Empty table: no
    rows."""
    lines = lines_of(df, key, text)
    links = edit_links(lines, distance, min_chars)
    reached = components(links.select("u", "v"))
    counts = links.select(F.col("u").alias("id")).union(links.select("v")).groupBy("id").agg(F.count("*").alias("n_links"))
    places = written(lines.select("doc", "line_no", "n_chars", "id"))
    same = places.groupBy("id").agg(F.min(F.struct("doc", "line_no")).alias("at"), F.count("*").alias("n_copies"))
    known = same.join(reached, same.id == reached.node, "left").drop("node").join(counts, "id", "left")
    known = written(known.select("id", "at", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component"))
    tops = known.where("component is not null").groupBy("component").agg(F.min("at").alias("top"), F.count("*").alias("n"))
    info = join_to(known, tops, "component", F.col("id")).select("id", F.col("n_copies").alias("n"), "n_copies", "n_links", F.coalesce("top", "at").alias("top"))
    return join_to(places, info, "id", F.xxhash64("doc", "line_no")).select(
        F.col("doc").alias(key), "line_no", "n_chars", F.col("top.doc").alias("class_doc_id"), F.col("top.line_no").alias("class_line_no"), "n_links", "n_copies",
        (F.col("top.doc").eqNullSafe(F.col("doc")) & (F.col("top.line_no") == F.col("line_no"))).alias("first"),
    )


def op3_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents at a distance of 2."""
    return near_duplicate_lines(table(spark, sf_dir, "documents"))

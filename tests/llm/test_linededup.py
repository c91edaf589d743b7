from __future__ import annotations

import random

from stratagrid.llm import linededup as L

SCHEMA = "doc_id long, text string, line_no int, id string, key double"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, line, n):
    out = list(line)
    for _ in range(n):
        k = rng.randrange(len(out) or 1)
        what = rng.randrange(3)
        out[k : k + (what > 0)] = [rng.choice("aé😀b ")] if what < 2 else []
    return "".join(out)


def some_lines(rng, n, alphabet="ab é😀"):
    lines = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12, 40))) for _ in range(n)]
    return lines + [edited(rng, x, rng.randrange(1, 5)) for x in lines for _ in range(3)]


def test_bounded_edit_distance_against_the_full_table(spark):
    rng = random.Random(2)
    lines = some_lines(rng, 60) + ["", "a", "😀", "\n"]
    pairs = [(a, edited(rng, a, rng.randrange(0, 5)) if a and rng.random() < 0.8 else rng.choice(lines)) for a in lines * 3]
    for k in (1, 2, 3):
        got = L.bounded_edit_distance(spark.createDataFrame(pairs, "a string, b string"), k).collect()
        for r in got:
            d = distance(r.a, r.b)
            assert r.edits == (d if d <= k else None), (r, d)


def test_links_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(L, "CROWDED", 3)
    rng = random.Random(4)
    base = "the quick brown fox jumps over the lazy dog again and again"
    lines = some_lines(rng, 40) + [edited(rng, base, rng.randrange(0, 4)) for _ in range(60)] + [base[:k] + "zzzz " + base[k:] for k in range(0, 50, 2)]
    rows = [(i, "\n".join(lines[i * 5 : i * 5 + 5]), 1, "x", 0.5) for i in range(len(lines) // 5)]
    every = sorted({x for r in rows for x in r[1].split("\n") if len(x) >= 12})
    want = {frozenset((a, b)): d for i, a in enumerate(every) for b in every[:i] if abs(len(a) - len(b)) <= 2 and (d := distance(a, b)) <= 2}
    df = L.lines_of(spark.createDataFrame(rows, SCHEMA))
    name = {r.id: r.line for r in df.select("id", "line").distinct().collect()}
    got = {frozenset((name[r.u], name[r.v])): r.edits for r in L.edit_links(df, 2, 12).collect()}
    assert got == want and len(want) > 100


def test_classes_copies_short_lines_and_nulls(spark):
    long = "a line that is surely long enough to be compared"
    rows = [(5, f"{long}\nab\n", 1, "", 0.1), (2, f"ab\n{long}!", 1, "", 0.1), (9, f"{long[:-1]}!?", 1, "", 0.1), (7, None, 1, "", 0.1), (8, "", 1, "", 0.1), (None, "ac", 1, "", 0.1), (5, long, 1, "", 0.1)]
    got = {(r.doc_id, r.line_no, r.n_chars): r for r in L.near_duplicate_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 8 and {k[0] for k in got} == {5, 2, 9, 8, None}
    same = [got[5, 0, len(long)], got[2, 1, len(long) + 1], got[9, 0, len(long) + 1]]
    assert [(r.class_doc_id, r.class_line_no, r.n_links) for r in same] == [(2, 1, 2)] * 3
    assert same[0].n_copies == 2 and same[1].first and not same[0].first
    assert got[2, 0, 2].first and not got[5, 1, 2].first and got[5, 1, 2].class_doc_id == 2 and got[5, 1, 2].n_links == 0
    assert got[None, 0, 2].first and got[8, 0, 0].class_doc_id == 5 and got[5, 2, 0].first
    assert L.near_duplicate_lines(spark.createDataFrame([], SCHEMA)).count() == 0

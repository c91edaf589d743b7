from __future__ import annotations

import gc
import random
import shutil
import subprocess
import time
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as C
from stratagrid.llm import common
from stratagrid.llm import mixing as M
from stratagrid.llm.packing import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies string, _id int"


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    at, rows, labels = tmp_path_factory.mktemp("docs"), [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 90))]
        toxic, poor = rng.random() < 0.12, rng.random() < 0.2
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["xoxoxo", "qumbara"])
        if poor:
            text = [w + "!!" for w in text]
        third = len(text) // 3
        rows.append([i, "\n".join(" ".join(text[k * third : (k + 1) * third]) for k in range(3)), "en", "s", 0, "c", 1])
        labels.append((i, int(not poor), int(toxic)))
    rows += [[1000 + i, rows[i][1], "en", "s", 0, "c", 1] for i in range(20)]  # copies
    rows += [[1100 + i, rows[i][1] + "\nand a tail of this copy, number " + " ".join(words[7 * i : 7 * i + 7]), "en", "s", 0, "c", 1] for i in range(20, 40)]
    rows += [[2000, None, "en", "s", 0, "c", 1], [2001, "", None, None, None, None, None], [None, "a document without an id stands here", "en", "s", 0, "c", 1]]
    for r in rows:
        r[4] = len(r[1] or "")
    spark.createDataFrame([tuple(r) for r in rows], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), {r[0]: r for r in rows}, {k: (q, t) for k, q, t in labels}


def test_stages_one_after_the_other(spark, folder):
    at, rows, labels = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    one = C.drop_toxic(spark, docs, at).cache()
    assert one.columns == list(C.COLUMNS)
    kept = {r.doc_id for r in one.collect()}
    clean = {k for k in rows if labels.get(k if k is None or k < 1000 else k % 1000 if k < 1100 else k - 1100, (1, 0))[1] == 0}
    assert len(kept ^ clean) <= 0.02 * len(rows)

    two = C.dedup_lines(spark, one, at).cache()
    seen, want = set(), {}
    for r in sorted(one.collect(), key=lambda r: (r.doc_id is not None, r.doc_id)):
        left = []
        for x in (r.text or "").split("\n"):
            if len(x) < C.MIN_CHARS or x not in seen:
                left.append(x)
            if len(x) >= C.MIN_CHARS:
                seen.add(x)
        if left:
            want[r.doc_id] = "\n".join(left) if r.text is not None else None
    assert {r.doc_id: r.text for r in two.collect()} == want and two.columns == list(C.COLUMNS)
    assert all(r.n_chars == len(r.text or "") for r in two.collect())

    three = C.dedup_documents(spark, two, at).cache()
    ids = {r.doc_id for r in three.collect()}
    assert ids <= set(want) and 2001 not in ids and 2000 in ids and len(ids) >= len(want) - 30 and three.columns == list(C.COLUMNS)
    again = C.dedup_documents(spark, one, at)
    assert {1000 + i for i in range(20)}.isdisjoint({r.doc_id for r in again.collect()}) and again.where("doc_id is null").count() == 1

    four = C.mix(spark, three, at).cache()
    assert {r.doc_id for r in four.collect()} == ids and four.columns == list(C.COLUMNS) and four.count() > len(ids)
    check_mixing(spark, three, four, labels)
    check_packing(four.collect(), C.pack(spark, four, at).collect())


def check_mixing(spark, before, after, labels):
    """Copies against plain least squares over rates of 1 at least, on the documents' posteriors."""
    domains = ["good", "poor"]
    known = spark.createDataFrame([(k, domains[1 - q]) for k, (q, t) in labels.items() if not t], "doc_id long, domain string")
    told = M.fit_posteriors(before, known, domains)
    rows = M.posteriors(before, told, domains).collect()
    p, t = np.array([[r.p0, r.p1] for r in rows]), np.array([r.tokens for r in rows], dtype=float)
    a, share = p * t[:, None], np.array([0.90, 0.10])
    goal = share * (a.sum(axis=0) / share).max()
    m = a.T @ p
    w = np.linalg.pinv(m + 1e-9 * np.trace(m) * np.eye(2))
    r = np.ones(len(t))
    for _ in range(2000):
        r = np.maximum(1, r - p @ (w @ (a.T @ r - goal)))
    copies = Counter(x.doc_id for x in after.collect())
    loss = lambda x: float((a.T @ x - goal) @ w @ (a.T @ x - goal))
    had = np.array([copies[x.doc_id] for x in rows], dtype=float)
    assert (np.abs(had - r) < 1.1).all() and loss(had) <= loss(r) + 0.02 * loss(np.ones(len(r)))


def check_packing(rows, pieces):
    """Every row's ids, by the tokenizers library at its defaults, lie in its pieces once; sequences have no gap."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    left = defaultdict(list)
    for r in rows:
        left[r.doc_id].append(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4"))
    assert sum(r.length for r in pieces) == sum(len(x) for v in left.values() for x in v)
    met, filled = defaultdict(Counter), defaultdict(list)
    for r in pieces:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in left[r.doc_id])
        for k in range(r.start, r.start + r.length):
            met[r.doc_id, r.doc_tokens][k] += 1
        filled[r.sequence_id].append((r.offset, r.length))
    for (doc, n), c in met.items():
        copies = sum(len(x) == n for x in left[doc])
        assert sorted(c) == list(range(n)) and set(c.values()) == {copies}
    for parts in filled.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at == 1024 or at < 1024 and at & (at - 1) == 0


def test_run_and_empty_documents(spark, folder):
    at = folder[0]
    mark = len(common.MADE)
    assert C.run(spark, at).count() > 300
    made = [x._stratagrid_path for x in common.MADE[mark:]]
    assert len(made) <= 8  # the rows that packing reads, and its own tables
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        out = stage(spark, docs, at)
        assert out.count() == 0
        docs = docs if "start" in out.columns else out


def test_exact_copies_with_line_crc(spark, folder):
    at, rows, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").where("doc_id in (0, 1000)")
    got = [r.text for r in C.dedup_lines(spark, docs, at).collect()]
    assert [zlib.crc32(x.encode()) for x in got] == [zlib.crc32(rows[0][1].encode())]


def rows_of(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_lines_go_from_rows_and_not_from_ids(spark):
    line = lambda w: f"{w} " * 12 + "ends here"
    rows = [(None, [line("nose"), line("pear")]), (None, [line("quay"), line("quiz")]), (1, [line("loom"), line("lamp")])]
    rows += [(7, [line("loom"), line("mast")]), (7, [line("name"), line("nose")]), (7, [line("oven"), line("oars")])]
    got = C.dedup_lines(spark, rows_of(spark, [(k, "\n".join(t)) for k, t in rows]), "").collect()
    want = [*rows[:3], (7, [line("mast")]), (7, [line("name")]), rows[5]]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.text) for r in got], key=order) == sorted([(k, "\n".join(t)) for k, t in want], key=order)


def test_documents_go_by_rows_and_not_by_ids(spark):
    rng = random.Random(8)
    text = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(6)]
    rows = [(None, text[0]), (None, text[1]), (8, text[1]), (7, text[2]), (7, text[3]), (7, text[3]), (None, text[4]), (None, text[4])]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    got = [(r.doc_id, r.text) for r in C.dedup_documents(spark, rows_of(spark, rows), "").collect()]
    assert sorted(got, key=order) == sorted([rows[0], *rows[2:5], rows[6]], key=order)
    got = [(r.doc_id, r.text) for r in C.dedup_documents(spark, rows_of(spark, rows[:3]), "").collect()]
    assert sorted(got, key=order) == sorted([rows[0], rows[2]], key=order)


def test_driver_keeps_nothing_of_tables_that_no_one_reads(spark):
    def statuses() -> int:
        """File statuses that live on the driver after a full collection."""
        gc.collect()
        time.sleep(1)  # for py4j, which lets go of what Python has freed
        found = subprocess.run([jcmd, str(spark._jvm.java.lang.ProcessHandle.current().pid()), "GC.class_histogram"], capture_output=True, text=True, check=True, timeout=60).stdout
        return sum(int(x.split()[1]) for x in found.split("\n") if ".LocatedFileStatus" in x)

    if not (jcmd := shutil.which("jcmd")):
        pytest.skip("needs a JDK's jcmd")
    key = "spark.sql.hive.filesourcePartitionFileCacheSize"
    before, usual = statuses(), spark.conf.get(key)
    gone = []
    for _ in range(5):
        made = common.written(spark.range(0, 3000, 1, 40))
        rows = made.count()
        assert rows == 3000
        gone.append(weakref.ref(made))
        path = made._stratagrid_path
        del made
    # The last action's plan may live on in a thread of Spark that waits for its next.
    assert statuses() <= before + 50 and all(x() is None for x in gone) and spark.conf.get(key) == usual
    assert common.MADE[-1]._stratagrid_path == path  # it is still known, and removed at the end of a stage
    mark = len(common.MADE) - 1
    left = common.written(spark.range(3))
    common.remove_since(mark, left)
    assert [x._stratagrid_path for x in common.MADE[mark:]] == [left._stratagrid_path] and left.count() == 3
    with pytest.raises(Exception, match="(?i)PATH_NOT_FOUND"):
        spark.read.parquet(path)
    common.remove(left)
    assert len(common.MADE) == mark

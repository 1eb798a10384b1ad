import random
import re
from itertools import combinations

import numpy as np

from pathloom.llm import near_dedup as N

P = N.NearParams()


def shingles(t):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    return frozenset(tuple(w[i : i + P.shingle]) for i in range(len(w) - P.shingle + 1)) if len(w) >= P.shingle else frozenset([tuple(w)]) if w else frozenset()


def groups(pairs):
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        if a != b:
            up[b] = a
    return {x: top(x) for x in up}


def copies(seed=3, n=40, group=12):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for g in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        rows.append(words)
        for _ in range(rng.randint(0, 3) if g else group):
            rows.append([rng.choice(vocabulary) if rng.random() < 0.04 else w for w in words])
    return [(k, " ".join(w), "en", "a") for k, w in enumerate(rows)]


def test_against_all_pairs(make):
    rows = copies()
    sets = {i: shingles(t) for i, t, *_ in rows}
    true = {(a, b) for a, b in combinations(sets, 2) if (j := len(sets[a] & sets[b])) and j / len(sets[a] | sets[b]) >= P.threshold}
    root = {r.doc_id: r.keeper_id for r in N.pairs(make(rows)).collect()}
    found = sum(root.get(a, a) == root.get(b, b) for a, b in true)
    assert len(true) > 50 and found >= 0.9 * len(true)
    want = groups(true)
    wrong = [d for d in root if d not in want]
    assert len(wrong) <= 0.05 * len(want)


def test_many_copies_make_one_group(make):
    rows = copies(5, 2, 400)
    root = {r.doc_id: r.keeper_id for r in N.pairs(make(rows)).collect()}
    assert sum(v == 0 for k, v in root.items()) >= 0.97 * 400
    stay = {r.doc_id for r in N.deduplicate(make(rows)).collect()}
    assert stay == {i for i, *_ in rows} - set(root)


def test_estimate_is_unbiased():
    rng = np.random.default_rng(0)
    for j in (0.3, 0.6, 0.9):
        n = 600
        common = int(n * 2 * j / (1 + j))
        got = []
        for k in range(40):
            a = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
            x, y = a[:n], a[n - common :]
            sig = [N.packed(N.minima(s, np.zeros(len(s), int), P)[1], P.bits) for s in (x, y)]
            got.append(N.similarity(sig[0], sig[1], P)[0])
        assert abs(np.mean(got) - common / (2 * n - common)) < 0.03


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    assert {(r.doc_id, r.root) for r in N.components(edges).collect()} == {(k, 0) for k in range(1, 61)} | {(101, 100)}


def test_unlike_members_of_a_bucket_are_still_compared(spark):
    p = N.NearParams(hashes=64, rows=4)
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 1 << 63, 50, dtype=np.uint64), rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    sig = lambda s: N.packed(N.minima(s, np.zeros(len(s), int), p)[1], p.bits)[0].tobytes()
    rows = [(7, 1, sig(x)), (7, 2, sig(y)), (7, 3, sig(x)), (7, 4, sig(y)), (8, 9, sig(x))]
    members = spark.createDataFrame(rows, "bucket long, doc_id long, sig binary").coalesce(1).sortWithinPartitions("bucket", "doc_id")
    assert {(r.a, r.b) for r in N.compared(members, p).collect()} == {(1, 3), (2, 4)}


def test_odd_rows(make, odd_rows):
    rows = odd_rows + [(30, odd_rows[0][1].upper(), "en", "z"), (31, "word", "en", "z")]
    got = {(r.keeper_id, r.doc_id) for r in N.pairs(make(rows, extra=True)).collect()}
    assert got == {(1, 30), (5, 31)}
    kept = N.deduplicate(make(rows, extra=True))
    ids = sorted((r.doc_id or 0) for r in kept.collect())
    assert ids == sorted([0, 0, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9]) and len(kept.columns) == len(make(rows, extra=True).columns)
    assert N.deduplicate(make([])).count() == 0 and N.pairs(make([])).count() == 0


def test_near_copies_in_text_without_blanks_are_found(make):
    from pathloom.llm import near_dedup

    text = "山下有一条很长的小河，孩子们每天放学以后都到河边玩水。老人坐在树下讲从前的故事，大家听得非常认真，直到太阳落到山的后面才慢慢回家。"
    other = "图书馆新买了许多关于天文和历史的书籍，学生们排队登记借阅，管理员忙得没有时间喝茶。"
    docs = make([(1, text, "zh", "a"), (2, text.replace("老", "男"), "zh", "a"), (3, other, "zh", "a")])
    assert [(r.keeper_id, r.doc_id) for r in near_dedup.pairs(docs).collect()] == [(1, 2)]


def test_large_buckets_give_the_same_in_blocks(make):
    """Pages of a template: half of each is shared by all, so buckets are large and hold many that are unlike."""
    import dataclasses

    rng = random.Random(9)
    head = [f"t{k}" for k in range(60)]
    bodies = [[f"w{rng.randint(0, 5000)}" for _ in range(60)] for _ in range(60)]
    rows = [(k, " ".join(head + [w if rng.random() > 0.02 else "x" for w in bodies[k % 60]]), "en", "a") for k in range(150)]
    plain = lambda p: sorted((r.keeper_id, r.doc_id, r.similarity) for r in N.pairs(make(rows), p).collect())
    want = plain(P)
    assert want and plain(dataclasses.replace(P, block=5)) == want


def test_texts_of_ids_that_stand_once_are_moved_once(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = N.deduplicate(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("text#") <= 4

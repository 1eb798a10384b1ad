import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import line_dedup as D

P = D.LineDedupParams(min_chars=3)


def brute(rows, least):
    """First (doc_id, line) keeps; equal rows are one document."""
    seen, out = {}, {}
    for i, t in sorted({(i, t) for i, t in rows}):
        lines = t.split("\n")
        out[i] = "\n".join(x for k, x in enumerate(lines) if len(x.strip()) < least or seen.setdefault(x.strip(), (i, k)) == (i, k))
    return out


def test_against_brute_force(make):
    rng = np.random.default_rng(1)
    lines = [f"line number {k}" for k in range(30)] + ["", "ab", "  padded line ", "padded line"]
    rows = [(i, "\n".join(rng.choice(lines, rng.integers(1, 9)))) for i in range(80)]
    want = brute(rows, 3)
    got = {r.doc_id: r.text for r in D.deduplicate(make([(i, t, "en", "a") for i, t in rows]), P).collect()}
    assert got == want


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**32))
def test_cuckoo_has_no_false_negatives_and_forgets(n, seed):
    rng = np.random.default_rng(seed)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    c = D.Cuckoo.of(keys)
    assert c.contains(keys).all()
    others = np.setdiff1d(rng.integers(0, 1 << 63, 4000, dtype=np.uint64), keys)
    assert c.contains(others).mean() < 0.01
    half = len(keys) // 2
    c.delete(keys[:half])
    assert c.contains(keys[half:]).all() and (c.slots != 0).sum() == len(keys) - half


def table(store):
    return sorted((r.k1, r.k2, r.n_refs, tuple(r["first"])) for r in store.refs.collect())


def test_insert_and_delete_are_inverse(make, spark):
    a = make([(i, f"shared line one\nonly in {i}\nshared line two {i % 2}", "en", "s") for i in range(10)])
    b = make([(i, f"shared line one\nnew in {i}\nonly in 3", "en", "s") for i in range(-5, 0)])
    empty = D.LineStore.empty(spark, 4)
    one = empty.insert(a)
    both = one.insert(b)
    assert table(both) == table(empty.insert(b.unionByName(a)))
    back = both.delete(b, a)
    assert table(back) == table(one)
    live = {(r.shard, r.k1) for r in back.refs.collect()}
    slots = {r.shard: D.Cuckoo(slots=np.frombuffer(r.slots, np.uint16).reshape(-1, D.SLOTS)) for r in back.filters.collect()}
    assert all(slots[s].contains(np.array([k], np.int64).view(np.uint64))[0] for s, k in live)
    assert sum((c.slots != 0).sum() for c in slots.values()) == len(live)


def test_a_copy_leaves_nothing_that_counts(make):
    text = "Title\n\nthe first long line of it\nthe second long line of it"
    rows = [(1, text, "en", "a"), (2, text, "en", "b"), (3, text + "\nand a third line of its own", "en", "b"), (4, "short", "en", "a"), (5, None, "en", "a")]
    out = D.deduplicate(make(rows))
    assert {r.doc_id for r in out.filter(D.something_left()).collect()} == {1, 3, 4, 5}


def test_odd_rows(make, odd_rows):
    out = D.deduplicate(make(odd_rows, extra=True))
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    assert sorted(r.text for r in rows if r.doc_id == 1) == sorted(t for i, t, *_ in odd_rows if i == 1)
    by = {r.doc_id: r for r in rows if r.doc_id not in (None, 1, 7)}
    assert by[2].text is None and by[3].text == "" and by[6].text == "two\n\nlines\n" and isinstance(by[3].lines_removed, int)
    assert [r.text for r in rows if r.doc_id is None and r.source == "b"] == [odd_rows[3][1]]
    assert D.deduplicate(make([])).count() == 0


def test_long_text_with_a_hot_line(make):
    hot = "the same line everywhere in this text"
    out = D.deduplicate(make([(1, "\n".join([hot] * 20_000), "en", "a"), (2, hot + "\nand another one", "en", "a")])).collect()
    assert {r.doc_id: r.text for r in out} == {1: hot, 2: "and another one"}


def test_the_pipeline_keeps_short_lines_of_a_document_that_lost_one(make, spark):
    import corpus_pipeline

    header = "this header stands in many documents"
    numbers = "\n".join(f"{k} {k * k}" for k in range(40))
    rows = [(1, header + "\nand a first line of its own", "en", "a"), (2, header + "\n" + numbers, "en", "a"), (3, header + "\n春眠不觉晓\n处处闻啼鸟", "zh", "a"), (4, header, "en", "b"), (5, header + "\n \t\u00a0\n", "en", "b"), (6, "", "en", "b"), (7, None, "en", "b")]
    out = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, make(rows), "").collect()}
    assert set(out) == {1, 2, 3, 6, 7} and out[2] == numbers and out[3] == "春眠不觉晓\n处处闻啼鸟"


def test_many_shards_in_one_task(make, spark):
    """Filters of one task follow each other; few keys a shard, and all shards in one partition."""
    rng = np.random.default_rng(4)
    rows = [(i, "\n".join(f"line number {k}" for k in rng.integers(0, 300, 12)), "en", "a") for i in range(120)]
    p = D.LineDedupParams(min_chars=3, chars_per_shard=100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        docs = make(rows)
        assert D.shards_for(docs, p) > 100
        got = {r.doc_id: r.text for r in D.deduplicate(docs, p).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute([(i, t) for i, t, *_ in rows], 3)


def test_store_takes_odd_documents(make, odd_rows, spark):
    a = make(odd_rows, extra=True)
    one = D.LineStore.empty(spark, 4).insert(a)
    assert table(one) == table(D.LineStore.empty(spark, 4).insert(a.filter("doc_id is not null and text is not null").distinct()))
    assert table(one.insert(a)) == table(one)  # a document that is there already
    strange = make([(1, "another text than that of one", "en", "a"), (99, odd_rows[0][1], "en", "a"), (None, odd_rows[0][1], "en", "a"), (4, None, "en", "a")])
    assert table(one.delete(strange)) == table(one)  # none of these is in it
    assert table(one.delete(a)) == [] and one.delete(a).filters.filter("n_keys > 0").count() == 0
    back = one.delete(a).insert(a)
    assert table(back) == table(one) == table(back.compact())
    assert table(D.LineStore.empty(spark, 4).insert(make([]))) == []


def test_filters_grow_with_their_shards(make, spark):
    store = D.LineStore.empty(spark, 2)
    for k in range(3):
        store = store.insert(make([(k, "\n".join(f"line {k} number {n} of many" for n in range(400 * (k + 1))), "en", "a")]))
    assert sum(r.n_keys for r in store.filters.collect()) == store.refs.count() == 2400
    keys = {s: np.array([r.k1 for r in store.refs.filter(f"shard = {s}").collect()], np.int64).view(np.uint64) for s in (0, 1)}
    assert all(D.Cuckoo(slots=np.frombuffer(r.slots, np.uint16).reshape(-1, D.SLOTS)).contains(keys[r.shard]).all() for r in store.filters.collect())


def test_whole_copies_are_told(make, odd_rows):
    rows = [(1, "a first long line\nshort", "en", "a"), (2, "a first long line\nshort", "en", "a"), (3, "a first long line\nsmall", "en", "a"), (4, "tiny", "en", "a"), (5, "tiny", "en", "a"), (6, " ", "en", "a"), (7, " ", "en", "a"), (8, None, "en", "a"), (5, "tiny", "en", "a")]
    out = D.deduplicate(make(rows, extra=True), whole=True).collect()
    assert sorted((r.doc_id, r.lines_removed, r.whole_copy) for r in out) == [(1, 0, False), (2, 1, True), (3, 1, False), (4, 0, False), (5, 0, True), (5, 0, True), (6, 0, False), (7, 0, False), (8, 0, False)]
    plain = lambda df: sorted((str(r.doc_id), str(r.text), r.lines_removed) for r in df.collect())
    assert plain(D.deduplicate(make(odd_rows), whole=True)) == plain(D.deduplicate(make(odd_rows)))

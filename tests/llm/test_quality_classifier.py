import numpy as np
import pyarrow as pa
import pytest

from pathloom.llm import common, quality_classifier as Q


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=40).astype(np.float32), rng.normal(size=(40, 5)).astype(np.float32)
    rows = [rng.choice(40, rng.integers(1, 12), replace=False) for _ in range(20)]
    idx, indptr = np.concatenate(rows).astype(np.int32), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    val = rng.uniform(0.5, 1.5, len(idx)).astype(np.float32)
    got = Q.raw_score(0.3, w, v, indptr, idx, val)
    for k, r in enumerate(rows):
        x = val[indptr[k] : indptr[k + 1]]
        want = 0.3 + sum(w[i] * a for i, a in zip(r, x)) + sum(float(v[r[i]] @ v[r[j]]) * x[i] * x[j] for i in range(len(r)) for j in range(i))
        assert got[k] == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_pairs_are_learnt():
    """Neither feature tells anything alone; their product does."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, 600), rng.integers(0, 2, 600)
    idx = np.stack([a, 2 + b, 4 + rng.integers(0, 3, 600)], axis=1).astype(np.int32).ravel()
    indptr = np.arange(601) * 3
    y = (a == b).astype(float)
    m = Q.fit(indptr, idx, np.ones(len(idx), np.float32), y, Q.QualityParams(epochs=60, rate=0.3))
    w, v = m.dense(10)
    assert ((Q.raw_score(m.bias, w, v, indptr, idx, np.ones(len(idx), np.float32)) > 0) == (y > 0)).mean() > 0.95


def test_held_out_accuracy(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    train = labels.filter("doc_id % 4 <> 0")
    rows = Q.classify(docs.filter("doc_id % 4 = 0").unionByName(docs.filter("doc_id % 4 <> 0")), train).join(labels.filter("doc_id % 4 = 0"), "doc_id").collect()
    clean = [r.keep for r in rows if r.quality == 1 and not r.toxic]
    junk = [r.keep for r in rows if r.quality == 0]
    toxic = [r.keep for r in rows if r.toxic and r.lang == "en"]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.2 and np.mean(toxic) < 0.3


def test_features_don_t_depend_on_the_batch():
    texts = ["One two, two THREE!", "", "x | y | z", "One two, two THREE!"]
    batch = lambda t: pa.RecordBatch.from_arrays([pa.array(t), pa.array(["en"] * len(t)), pa.array(["s"] * len(t))], names=["text", "lang", "source"])
    one = {t: list(next(iter(Q.features(batch([t]), Q.QualityParams())))[2]) for t in texts}
    ((_, indptr, idx, _),) = list(Q.features(batch(texts), Q.QualityParams()))
    assert all(sorted(idx[indptr[k] : indptr[k + 1]]) == sorted(one[t]) for k, t in enumerate(texts))


def test_odd_rows(make, odd_rows, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (3, 0, 0), (4, 1, 0), (7, None, 1), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    docs = make(odd_rows, extra=True)
    rows = Q.classify(docs, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.quality_score <= 1 and r.keep == (r.quality_score >= 0.5) for r in rows)
    assert len({r.quality_score for r in rows if r.doc_id == 1}) == 1
    assert Q.classify(docs, labels.limit(0)).filter("keep").count() == len(odd_rows)
    assert Q.classify(docs, labels.filter("quality = 1")).filter("keep").count() == len(odd_rows)
    assert Q.classify(make([]), labels).count() == 0


def test_the_sample_has_one_row_an_id(make, spark):
    rows = [(1, f"text number {k} of one id", "en", "a") for k in range(300)] + [(2, None, None, "a"), (2, None, "en", None)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    out = Q.labelled(make(rows, extra=True), labels, Q.QualityParams()).collect()
    assert sorted((r.doc_id, r["__pl_y"]) for r in out) == [(1, 1), (2, 0)]

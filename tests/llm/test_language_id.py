import math

import numpy as np
import pyarrow as pa
import pytest

from pathloom.llm import common, language_id as L, textvec


def ppm(text: bytes, models, order):
    """Code length by the definition, byte by byte."""
    bits = 0.0
    for i, sym in enumerate(text):
        k = min(order, i)
        while True:
            if k < 0:
                bits += 8
                break
            counts = models[k].get(text[i - k : i], {})
            if counts:
                total = sum(counts.values()) + len(counts)
                if sym in counts:
                    bits -= math.log2(counts[sym] / total)
                    break
                bits -= math.log2(len(counts) / total)
            k -= 1
    return bits


def counted(texts, order):
    out = [{} for _ in range(order + 1)]
    for t in texts:
        b = t.encode()
        for k in range(order + 1):
            for i in range(k, len(b)):
                c = out[k].setdefault(b[i - k : i], {})
                c[b[i]] = c.get(b[i], 0) + 1
    return out


def test_code_lengths_are_those_of_the_definition():
    sample = {"a": ["abracadabra abra", "cad"], "b": ["bbbb cccc bcbc", "é zz"]}
    coder = L.Coder({n: L.Trees(t, 3) for n, t in sample.items()}, 3)
    texts = ["abra cad", "bcz é", "", "q", "xyz abracadabra"]
    ((_, data, offsets),) = textvec.chunks(pa.array(texts), 1 << 30)
    got = coder.code_lengths(data, offsets)
    for i, t in enumerate(texts):
        for j, n in enumerate(coder.names):
            assert got[i, j] == pytest.approx(ppm(t.encode(), counted(sample[n], 3), 3), abs=1e-3)


def test_held_out_accuracy(spark):
    docs = common.table(spark, "/root/testdata/sf0.1", "documents")
    sample = L.train(docs)
    seen = {t for texts in sample.values() for t in texts}
    rows = [r for r in L.identify(docs.filter("doc_id % 4 = 0"), sample).collect() if r.text not in seen]
    assert len(rows) > 1500 and sum(r.lang == r.lang_id for r in rows) >= 0.99 * len(rows)


def test_odd_rows(make, odd_rows, spark):
    docs = make(odd_rows, extra=True)
    out = L.identify(docs, L.train(docs))
    rows = out.collect()
    assert len(rows) == len(odd_rows) and [c for c in out.columns if c in ("lang_id", "margin")] == ["lang_id", "margin"]
    for r in rows:
        assert (r.lang_id is None) == (not r.text)
    assert len({(r.lang_id, r.code_bits) for r in rows if r.doc_id == 1}) == 1
    empty = docs.limit(0)
    assert L.identify(empty, L.train(empty)).count() == 0
    assert {r.lang_id for r in L.identify(docs, {}).collect()} == {None}


def test_long_texts_are_coded_by_blocks(monkeypatch):
    sample = {"a": ["abracadabra abra", "cad"], "b": ["bbbb cccc bcbc", "é zz"]}
    coder = L.Coder({n: L.Trees(t, 3) for n, t in sample.items()}, 3)
    data = np.frombuffer(("abra cad bcz é xyz abracadabra " * 9).encode(), np.uint8)
    want = coder.code_lengths(data, np.array([0, len(data)]))
    for block in (3, 7, 64):
        monkeypatch.setattr(textvec, "BLOCK_BYTES", block)
        assert coder.code_lengths(data, np.array([0, len(data)])) == pytest.approx(want, rel=1e-6)


def test_the_sample_has_one_text_an_id(make):
    rows = [(1, f"text number {k} of one id", "en", "a") for k in range(300)] + [(2, "another", "en", "a")]
    assert {k: len(v) for k, v in L.train(make(rows)).items()} == {"en": 2}

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import textvec as V

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab1 é-\n語", max_size=40)), min_size=1, max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words_are_those_of_a_regular_expression(texts):
    got = []
    for row, data, offsets in V.chunks(pa.array(texts, pa.string()), 20):
        s, e, r = V.words(data, offsets)
        h = V.span_hashes(data, s, e)
        raw = data.tobytes()
        got += [(row + int(k), raw[a:b], int(x)) for a, b, k, x in zip(s, e, r, h)]
    want = [(k, m.group()) for k, t in enumerate(texts) for m in re.finditer(rb"[A-Za-z0-9\x80-\xff]+", (t or "").encode())]
    assert [(k, w) for k, w, _ in got] == want
    assert len({h for *_, h in got}) == len({w for _, w, _ in got})


def test_windows_stay_in_their_row():
    h, r = np.arange(1, 8, dtype=np.uint64), np.array([0, 0, 0, 1, 1, 2, 2])
    first, _ = V.windows(h, r, 2)
    assert list(first) == [0, 1, 3, 5]


def test_hash_table_grows_and_finds():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 1 << 63, 20_000, dtype=np.uint64))
    table = V.HashTable(16)
    for part in np.array_split(keys, 7):
        table.put(part, (part % np.uint64(1000)).astype(np.int32))
    assert (table.get(keys) == keys % np.uint64(1000)).all()
    assert (table.get(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()


def tokens_of(texts, most=20):
    out = [[] for _ in texts]
    for row, data, offsets in V.chunks(pa.array(texts, pa.string()), most):
        s, e, r = V.tokens(data, offsets)
        raw = data.tobytes()
        for a, b, k in zip(s, e, r):
            out[row + int(k)].append(raw[a:b].decode())
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab1 é-\n語か“—。\u00a0ก\u0e34กе\U00020000…😀", max_size=40)), min_size=1, max_size=8))
def test_tokens_are_those_of_a_regular_expression(texts):
    want = [re.findall("[語か\U00020000ก]|[ab1éе😀]+", t or "") for t in texts]
    plain = [(g, w) for g, w, t in zip(tokens_of(texts), want, texts) if "\u0e34" not in (t or "")]
    assert [g for g, _ in plain] == [w for _, w in plain]
    assert all("".join(g) == "".join(c for c in t or "" if c in "ab1é語かก\u0e34е\U00020000😀") for g, t in zip(tokens_of(texts), texts))


def test_scripts_without_blanks_marks_and_typographic_signs():
    got = tokens_of(["全文检索，很快。ok", "“it’s” — a\u00a0test…", "\"it's\" - a test...", "ที่นี่", "e\u0301a naïve", "か\u3099き", "日本go語", "한국어 문장"], 1000)
    assert got == [list("全文检索很快") + ["ok"], ["it", "s", "a", "test"], ["it", "s", "a", "test"], ["ที่", "นี่"], ["e\u0301a", "naïve"], ["か\u3099", "き"], ["日", "本", "go", "語"], ["한국어", "문장"]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab1 é-\n語か“", max_size=60), min_size=1, max_size=5), st.integers(1, 40))
def test_blocks_of_any_size_give_the_same(texts, block):
    ((_, data, offsets),) = V.chunks(pa.array(texts, pa.string()), 1 << 40)
    before, made = V.BLOCK_BYTES, []
    try:
        for V.BLOCK_BYTES in (before, block):
            s, e, r = V.tokens(data, offsets)
            made.append([list(x) for x in (s, e, r, V.span_hashes(data, s, e))])
    finally:
        V.BLOCK_BYTES = before
    assert made[0] == made[1]

import dataclasses
import random
import re

import pytest

from pathloom.llm import decontaminate as C

P = C.DecontaminateParams()
NORMAL = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(f"q{rng.randint(0, 400)}" for _ in range(rng.randint(5, 40)))) for k in range(30)]
    return spark.createDataFrame(rows + [(90, "of"), (91, None), (None, "x y z w v"), (5, rows[5][1])], "item_id long, text string")


def planted(items):
    rng = random.Random(2)
    rows = items.filter("text is not null and item_id < 30").collect()
    docs, truth = [], {}
    for k in range(60):
        words = [f"t{rng.randint(0, 300)}" for _ in range(rng.randint(0, 80))]
        if k % 3 == 0:
            r = rng.choice(rows)
            text = r.text.upper() if k % 2 else r.text.replace(" ", ",  ")
            at = rng.randint(0, len(words))
            words[at:at] = [text]
            truth[k] = r.item_id
        docs.append((k, " ".join(words), "en", "a"))
    return docs, truth


def test_planted_items_are_found_and_removed(make, items):
    docs, truth = planted(items)
    out = {r.doc_id: r for r in C.annotate(make(docs), items).collect()}
    assert {k for k, r in out.items() if r.contaminated} == set(truth)
    texts = dict((r.item_id, NORMAL(r.text)) for r in items.filter("text is not null").collect() if r.item_id is not None)
    for k, item in truth.items():
        assert item in out[k].benchmark_items
        rest = [w for w in NORMAL(docs[k][1]) if w.startswith("t")]
        assert NORMAL(out[k].text) == rest and out[k].words_removed == len(texts[item])
        assert out[k].dropped == (len(texts[item]) >= 0.5 * (len(rest) + len(texts[item])))
    assert all(out[k].text == t for k, t, *_ in docs if k not in truth)
    assert {r.doc_id for r in C.decontaminate(make(docs), items).collect()} == {k for k, r in out.items() if not r.dropped}


def test_the_shuffled_way_gives_the_same(make, items):
    docs, _ = planted(items)
    plain = lambda df: sorted((r.doc_id, r.text, tuple(r.benchmark_items), r.words_removed, r.dropped) for r in df.collect())
    assert plain(C.annotate(make(docs), items)) == plain(C.annotate(make(docs), items, dataclasses.replace(P, broadcast_chars=0)))


def test_short_overlaps_are_left_alone(make, spark):
    item = spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(40)))], "item_id long, text string")
    few = "x " + " ".join(f"b{k}" for k in range(9)) + " y"
    enough = "x " + " ".join(f"b{k}" for k in range(3, 17)) + " y z " * 30
    out = {r.doc_id: r.contaminated for r in C.annotate(make([(1, few, "en", "a"), (2, enough, "en", "a")]), item).collect()}
    assert out == {1: False, 2: True}


def test_lower_case_of_another_length(make, spark):
    item = spark.createDataFrame([(1, "eins zwei drei vier fünf sechs sieben acht neun")], "item_id long, text string")
    out = C.annotate(make([(1, "İİ Ⱥ head, EINS ZWEI DREI VIER FÜNF SECHS SIEBEN ACHT NEUN. tail İ of it " + "more " * 20, "en", "a")]), item).first()
    assert out.contaminated and out.text.startswith("İİ Ⱥ head, . tail İ of it")


def test_odd_rows(make, odd_rows, items, spark):
    out = C.annotate(make(odd_rows, extra=True), items)
    assert out.count() == len(odd_rows) and out.filter("contaminated").count() == 0
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted((i or 0, t or "") for i, t, *_ in odd_rows)
    none = spark.createDataFrame([], "item_id long, text string")
    assert C.decontaminate(make(odd_rows), none).count() == len(odd_rows)
    assert C.decontaminate(make([]), items).count() == 0


def test_every_text_of_an_item_is_searched_in_both_ways(make, spark):
    question, answer = (" ".join(f"{c}{k}" for k in range(20)) for c in "qa")
    items = spark.createDataFrame([(1, question), (1, answer), (2, question)], "item_id long, text string")
    docs = [(k, "head " * 30 + t + " tail" * 30, "en", "a") for k, t in enumerate((question, answer, answer + " " + question))]
    for p in (P, dataclasses.replace(P, broadcast_chars=0)):
        out = {r.doc_id: (r.words_removed, list(r.benchmark_items)) for r in C.annotate(make(docs), items, p).collect()}
        assert out == {0: (20, [1]), 1: (20, [1]), 2: (40, [1])}


def test_passages_inside_text_without_blanks_and_with_other_quotes(make, spark):
    items = spark.createDataFrame([(1, "请问水在标准大气压下的沸点是多少摄氏度"), (2, "the so-called \"long\" night wasn't over before the ninth bell")], "item_id long, text string")
    docs = [(1, "昨天老师说请问水在标准大气压下的沸点是多少摄氏度然后大家都笑了" + "因为今天天气很好我们一起去公园散步吃饭聊天" * 3, "zh", "a"), (2, "so the so‑called “long” night wasn’t over before the ninth bell — " + "and more " * 20, "en", "a")]
    out = {r.doc_id: r for r in C.annotate(make(docs), items).collect()}
    assert list(out[1].benchmark_items) == [1] and out[1].text.startswith("昨天老师说然后大家都笑了") and out[1].words_removed == 19
    assert list(out[2].benchmark_items) == [2]
    assert sorted(map(str, out.values())) == sorted(str(r) for r in C.annotate(make(docs), items, dataclasses.replace(P, broadcast_chars=0)).collect())


def brute(text, items, p):
    """By nested loops over all items and alignments: (text, item ids, words removed)."""
    spans = [(m.start(), m.end(), m.group().lower()) for m in re.finditer("[A-Za-z0-9]+", text)]
    words, counted, ids = [w for *_, w in spans], {}, {}
    for item, t in items:
        want = tuple(NORMAL(t))
        if len(want) >= p.least:
            ids[want] = min([i for i, u in items if tuple(NORMAL(u)) == want], key=lambda i: (i is None, i or 0))
    for want, item in ids.items():
        own = []
        for shift in range(-len(want), len(words)):
            same = [k for k in range(len(want)) if 0 <= k + shift < len(words) and words[k + shift] == want[k]]
            for k in same:
                if k - 1 not in same:
                    end = k
                    while end in same:
                        end += 1
                    if end - k >= min(p.gram, len(want)):
                        own.append((k + shift, end + shift))
        near = [{r} for r in own]
        for a in own:  # runs that are near each other, or to one that is, are one group
            for b in own:
                x, y = sorted((a, b))
                if y[0] - x[1] <= p.gram:
                    ga, gb = (next(g for g in near if r in g) for r in (a, b))
                    if ga is not gb:
                        ga |= gb
                        near.remove(gb)
        for g in near:
            n = len({k for a, b in g for k in range(a, b)})
            if n >= p.run or 2 * n >= len(want):
                for run in g:
                    counted.setdefault(run, set()).add(item)
    key = lambda i: (i is None, i or 0)
    gone = {k for a, b in counted for k in range(a, b)}
    out, at = [], 0
    for k in sorted(gone):
        if k - 1 not in gone:  # what lies between two removed words goes with them
            out.append(text[at : spans[k][0]])
        at = spans[k][1]
    return "".join([*out, text[at:]]), sorted({min(i, key=key) for i in counted.values()}, key=key), len(gone)


def test_against_brute_force_in_both_ways(make, spark):
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(9)]
    items = [(k if k % 7 else None, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 5, 7, 8, 12, 20, 40])))) for k in range(40)]
    items += [(50, items[4][1]), (3, items[5][1]), (60, None)]
    docs = []
    for k in range(150):
        words = []
        for _ in range(rng.randint(0, 6)):
            piece = (rng.choice(items[:40])[1]).split()
            a = rng.randint(0, len(piece))
            words += rng.choice([piece, piece[a:], piece[:a], [w if rng.random() > 0.08 else "z" for w in piece]]) + [f"d{rng.randint(0, 99)}" for _ in range(rng.randint(0, 12))]
        docs.append((k, "".join(w + rng.choice([" ", ", ", "\n"]) for w in words), "en", "a"))
    p = dataclasses.replace(P, least=4)
    want = {k: brute(t, [x for x in items if x[1]], p) for k, t, *_ in docs}
    table = spark.createDataFrame(items, "item_id long, text string")
    for q in (p, dataclasses.replace(p, broadcast_chars=0)):
        got = {r.doc_id: (r.text, list(r.benchmark_items), r.words_removed) for r in C.annotate(make(docs), table, q).collect()}
        assert {k: (got[k], want[k]) for k in got if got[k] != want[k]} == {}
    assert sum(n > 0 for *_, n in want.values()) > 40 and any(None in ids for _, ids, _ in want.values())


def test_an_altered_copy_counts_by_its_runs_together(make, spark):
    words = [f"b{k}" for k in range(30)]
    item = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    altered = [w if k not in (10, 20) else "other" for k, w in enumerate(words)]
    far = words[:9] + ["x"] * 30 + words[15:23]
    out = {r.doc_id: r.words_removed for r in C.annotate(make([(1, "head " * 40 + " ".join(altered), "en", "a"), (2, " ".join(far), "en", "a")]), item).collect()}
    assert out == {1: 28, 2: 0}


def test_few_windows_leave_the_documents(make, spark):
    """Beyond the broadcast, a document sends on only grams that an item may have."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    texts = spark.createDataFrame([(k, " ".join(f"q{rng.randint(0, 400)}" for _ in range(20))) for k in range(30)], "i long, text string")
    docs = spark.createDataFrame([(k, " ".join(f"t{rng.randint(0, 400)}" for _ in range(200))) for k in range(50)], "k long, text string")
    assert C.document_grams(docs, C.item_grams(texts, P), P).count() < 20
    assert C.document_grams(texts.select(F.col("i").alias("k"), "text"), C.item_grams(texts, P), P).count() == C.item_grams(texts, P).count()

import random

from pathloom.llm import quality_rules as Q


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(["river", "bridge", "stone", "under", "light", "over", "small", "the", "a", "water", "and", "of"]) + rng.choice(["", "s", "ed"]) for _ in range(n)) + "."


def test_thresholds_follow_the_group(make):
    rows = [(k, prose(k), "en", "a") for k in range(60)] + [(100 + k, prose(k).replace(" ", " # "), "en", "code") for k in range(60)]
    rows += [(300, prose(1).replace(" ", " # "), "en", "a"), (301, prose(3).upper(), "en", "a"), (302, "same " * 60, "en", "a")]
    got = {r.doc_id: r for r in Q.judge(make(rows)).collect()}
    assert all(got[k].keep for k in (*range(60), *range(100, 160)))
    assert "symbol_share" in got[300].broken and "upper_share" in got[301].broken and "distinct_share" in got[302].broken


def test_small_groups_take_their_language_s(make):
    rows = [(k, prose(k), "en", f"s{k}") for k in range(60)] + [(99, prose(9).upper(), "en", "s99")]
    got = {r.doc_id: r.keep for r in Q.judge(make(rows)).collect()}
    assert not got[99] and sum(got.values()) == 60


def test_odd_rows(make, odd_rows):
    rows = Q.judge(make(odd_rows, extra=True)).collect()
    assert len(rows) == len(odd_rows)
    assert sorted((r.doc_id or 0) for r in rows if "empty" in r.broken) == [0, 2, 3, 9]
    assert all(r.keep == (r.broken == "") for r in rows) and len({r.keep for r in rows if r.doc_id == 1}) == 1
    assert Q.judge(make([])).count() == 0
    assert Q.judge(make(odd_rows).drop("lang", "source")).count() == len(odd_rows)

from pyspark.sql import functions as F

from pathloom.llm import license_scan as L

MIT = L.SENTENCES["mit_grant"][0] + "\n\n" + L.SENTENCES["mit_notice"][0] + "\n\n" + L.SENTENCES["as_is"][0]


def found(make, *texts):
    rows = L.scan(make([(k, t, "en", "a") for k, t in enumerate(texts)])).collect()
    return {(r.doc_id, r.licence): r.rule for r in rows}


def test_rules_and_order(make):
    wrapped = MIT.replace(", ", ",\n")
    backwards = L.SENTENCES["as_is"][0] + "\n\n" + L.SENTENCES["mit_grant"][0]
    got = found(make, MIT, wrapped, backwards, "Some words.\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0. All rights reserved.", "talk of a licence")
    assert got == {(0, "MIT"): "text", (1, "MIT"): "text", (2, "MIT"): "grant", (3, "MIT"): "mention", (4, "CC-BY-NC-4.0"): "mention", (4, "Proprietary"): "mention"}


def test_longer_rules_exclude_shorter_licences(make):
    bsd = [L.SENTENCES[k][0] for k in ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")]
    assert found(make, "\n\n".join(bsd), "\n\n".join(bsd[:3])) == {(0, "BSD-3-Clause"): "text", (1, "BSD-2-Clause"): "text"}


def test_every_sentence_passes_the_hint_and_is_known_once():
    import re

    forms = [s for v in L.SENTENCES.values() for s in v]
    assert len(L.KNOWN) == len({L.plain(s) for s in forms})
    assert [s for s in forms if not re.search(L.HINT.replace("(?i)", ""), s, re.I)] == []


def test_odd_rows(make, odd_rows):
    line = "Licensed under the Apache License, Version 2.0."
    rows = odd_rows + [(50, line, "en", "a"), (50, line, "en", "a"), (None, line, None, None)]
    got = L.scan(make(rows, extra=True)).collect()
    assert sorted((r.doc_id or 0, r.licence, r.n_sentences) for r in got) == [(0, "Apache-2.0", 1), (50, "Apache-2.0", 1), (50, "Apache-2.0", 1)]
    assert L.scan(make([])).count() == 0


def test_every_sentence_and_rule_is_found_in_its_own_text(make):
    forms = [(k, s) for k, v in L.SENTENCES.items() for s in v]
    ways = [lambda s: s, lambda s: "Some title\n// " + s + "\nint x = 1", lambda s: "One word. " + s.replace(" ", "\n * ") + "\nmore text"]
    texts = [w(s) for _, s in forms for w in ways[:2]] + [ways[2](s) for k, s in forms if s in L.inner()]
    want = [k for k, _ in forms for _ in ways[:2]] + [k for k, s in forms if s in L.inner()]
    got = make([(k, t, "en", "a") for k, t in enumerate(texts)]).select("doc_id", L.sequence(F.col("text")).alias("ids")).collect()
    assert [(texts[r.doc_id], r.ids) for r in got if want[r.doc_id] not in r.ids] == []
    rules = [(a, b, "\n".join(L.SENTENCES[k][-1] for k in needs)) for a, b, needs in L.RULES]
    assert found(make, *[t for *_, t in rules]) == {(k, a): b for k, (a, b, _) in enumerate(rules)}


def test_pieces_and_longer_sentences_are_no_inner_sentence(make):
    spdx = "SPDX-License-Identifier: "
    assert found(make, spdx + "MIT-0", spdx + "\n\nMIT", spdx + "MIT License", spdx + "Apache-2.0 WITH LLVM-exception") == {(2, "MIT"): "title"}


def test_all_rights_reserved_above_a_licence_text_is_no_licence(make):
    bsd = "\n\n".join(L.SENTENCES[k][0] for k in ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"))
    assert found(make, "Copyright 2020 A.\nAll rights reserved.\n\n" + bsd, "All rights reserved.") == {(0, "BSD-3-Clause"): "text", (1, "Proprietary"): "mention"}


def test_the_sql_finds_every_form_too(make):
    import duckdb

    forms = [s for v in L.SENTENCES.values() for s in v]
    texts = [w for s in forms for w in (s, "Title\n// " + s + "\nint x = 1", "One word. " + s.replace(" ", "\n * ") + "\nmore text")]
    texts += ["SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0", "\n\n".join(L.SENTENCES[k][0] for k in ("all_rights", "isc_grant")), MIT, "", "plain"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = con.execute(f"SELECT doc_id, licence, rule, n_sentences, sentences FROM ({L.ORACLE})").fetchall()
    assert sorted(map(tuple, L.scan(make([(k, t, "en", "a") for k, t in enumerate(texts)])).collect())) == sorted(want)
    assert {k: b for k, a, b, *_ in want if k == len(texts) - 5} and {a for k, a, *_ in want if k == len(texts) - 5} == {"MIT", "Apache-2.0"}

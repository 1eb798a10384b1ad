"""Licence scan by sentences and rules.

A text is cut into sentences; a sentence that runs over line ends is read once as a whole and
once line by line. Known sentences with a mark inside after which a text is cut (SPDX lines, GPL and
MPL headers) are found before that and kept in one piece. Each sentence is normalised to lower-case
words and mapped to the identifier of a known licence sentence. The identifiers, in order, form the
document's sequence; a rule is an ordered list of identifiers that must occur in that order, others
may stand between. A licence is reported once, by its first rule that matches (full text before
header, header before mention). "All rights reserved" makes a document proprietary only where no licence
was found by its text or header, as licences open with these words themselves.

Everything happens inside a row: no shuffle, and texts in which no word stands that every known
sentence has one of are dropped first.

Defined results: documents without a recognised licence, and null or empty texts, are not in the
result. Rows with a null doc_id are reported under null; repeated rows give repeated results. A
document may hold several licences, a row each; a known sentence that no rule uses alone gives
none. A very long text is read whole, in one row like any other. Columns other than doc_id and text are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import common

#: sentence identifier: its text, as licences have it
SENTENCES = {
    "mit_ref": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This software is released under the MIT License.", "SPDX-License-Identifier: MIT"],
    "mit_title": ["The MIT License (MIT)", "MIT License"],
    "mit_grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as_is": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "apache2_ref": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "apache2_header": ['Licensed under the Apache License, Version 2.0 (the "License");', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "apache2_obtain": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apache2_as_is": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "gpl3_ref": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl_free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl_warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl2_free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "cc_by_nc4_ref": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc_by4_ref": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc_by_sa4_ref": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0_ref": ["SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "bsd_grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd_source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd_binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd_endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "isc_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mpl2_form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "all_rights": ["All rights reserved."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: (licence, rule, ordered sentence identifiers); a licence's earlier rules go first
RULES = [
    ("MIT", "text", ["mit_grant", "mit_notice", "as_is"]),
    ("MIT", "grant", ["mit_grant"]),
    ("MIT", "title", ["mit_title"]),
    ("MIT", "mention", ["mit_ref"]),
    ("Apache-2.0", "header", ["apache2_header", "apache2_obtain", "apache2_as_is"]),
    ("Apache-2.0", "part of header", ["apache2_header"]),
    ("Apache-2.0", "mention", ["apache2_ref"]),
    ("GPL-3.0", "header", ["gpl_free", "gpl_warranty"]),
    ("GPL-3.0", "part of header", ["gpl_free"]),
    ("GPL-3.0", "mention", ["gpl3_ref"]),
    ("GPL-2.0", "header", ["gpl2_free", "gpl_warranty"]),
    ("GPL-2.0", "part of header", ["gpl2_free"]),
    ("BSD-3-Clause", "text", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", "text", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("ISC", "text", ["isc_grant"]),
    ("MPL-2.0", "header", ["mpl2_form"]),
    ("CC-BY-NC-4.0", "mention", ["cc_by_nc4_ref"]),
    ("CC-BY-4.0", "mention", ["cc_by4_ref"]),
    ("CC-BY-SA-4.0", "mention", ["cc_by_sa4_ref"]),
    ("CC0-1.0", "mention", ["cc0_ref"]),
    ("Unlicense", "text", ["unlicense"]),
    ("Proprietary", "mention", ["all_rights"]),
]

#: Every known sentence holds one of these, in any case.
MARKS = ["license", "licence", "copyright", "rights reserved", "permission", "warrant", "redistribut", "public domain", "free software", "copies"]
HINT = "(?i)" + "|".join(MARKS)


def plain(text: str) -> str:
    """The normal form of a sentence, as NORMAL makes it in Spark."""
    import re

    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


KNOWN = {plain(s): k for k, forms in SENTENCES.items() for s in forms}


def inner() -> list[str]:
    """Known sentences that the cut at marks would leave in pieces, none of which is known for the same."""
    import re

    cut = {s: re.split(r"(?<=[.!?:;])\s+", s) for forms in SENTENCES.values() for s in forms}
    return [s for s, parts in cut.items() if len(parts) > 1 and KNOWN[plain(s)] not in {KNOWN.get(plain(x)) for x in parts}]


def whole(text: Column) -> Column:
    """text, paragraphs ending in \\u0001, with each sentence of inner() in its normal form, which has no marks or line ends."""
    for s in inner():
        text = F.regexp_replace(text, broken(s), plain(s) + "$1")
    return text


def broken(sentence: str) -> str:
    """The words of a sentence, whatever stands between them, to a place where a text is cut; for Java and RE2 alike."""
    words = r"[^A-Za-z0-9\x{1}]+".join(plain(sentence).split(" "))
    return rf"(?i)\b{words}([^A-Za-z0-9\x{{1}}]*?(?:[\n\x{{1}}]|[.!?:;]\s|\z))"


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def sequence(text: Column) -> Column:
    """The identifiers of known sentences, in reading order: a sentence over several lines, then its lines."""
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    marked = F.regexp_replace(whole(F.regexp_replace(text, r"\n[ \t]*\n", "\u0001")), r"([.!?:;])\s+", "$1\u0001")
    readings = F.flatten(F.transform(F.split(marked, "\u0001"), lambda s: F.when(F.contains(s, F.lit("\n")), F.concat(F.array(s), F.split(s, "\n"))).otherwise(F.array(s))))
    return F.filter(F.transform(readings, lambda s: known[normal(s)]), lambda x: x.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licence, rule, n_sentences and the sequence, a row for each licence found."""
    ids = F.concat(F.lit(" "), F.array_join("__pl_ids", " "), F.lit(" "))
    found, order = [], list(dict.fromkeys(r[0] for r in RULES))
    for licence in order:
        best = F.lit(None).cast("string")
        for _, rule, needs in reversed([r for r in RULES if r[0] == licence]):
            best = F.when(F.col("__pl_seq").rlike(".* " + " (?:.* )?".join(needs) + " "), F.lit(rule)).otherwise(best)
        if licence == "BSD-2-Clause":
            best = F.when(F.contains("__pl_seq", F.lit(" bsd_endorse ")), F.lit(None)).otherwise(best)
        found.append(F.struct(F.lit(licence).alias("licence"), best.alias("rule")))
    hits = F.filter(F.array(*found), lambda x: x["rule"].isNotNull())
    return (
        docs.filter(common.holds_any("text", [], MARKS))
        .select("doc_id", sequence(F.col("text")).alias("__pl_ids"))
        .filter(F.size("__pl_ids") > 0)
        .select("doc_id", "__pl_ids", ids.alias("__pl_seq"))
        .select("doc_id", F.size("__pl_ids").alias("n_sentences"), F.trim("__pl_seq").alias("sentences"), hits.alias("__pl_hits"))
        .withColumn("__pl_text", F.exists("__pl_hits", lambda x: x["rule"] != "mention"))
        .select("doc_id", "n_sentences", "sentences", F.explode(F.filter("__pl_hits", lambda x: (x["licence"] != "Proprietary") | ~F.col("__pl_text"))).alias("r"))
        .select("doc_id", "r.licence", "r.rule", "n_sentences", "sentences")
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


def whole_sql(text: str) -> str:
    """whole() in SQL."""
    for s in inner():
        pattern = broken(s).replace("'", "''")
        text = f"regexp_replace({text}, '{pattern}', '{plain(s)}\\1', 'g')"
    return text


PARAGRAPHS = r"regexp_replace(text, '\n[ \t]*\n', chr(1), 'g')"
ORACLE = rf"""
WITH known(sentence, id) AS (VALUES {values(KNOWN.items())}),
rules(licence, rule, priority, needs) AS (VALUES {values((a, b, k, ".* " + " (?:.* )?".join(n) + " ") for k, (a, b, n) in enumerate(RULES))}),
sentences AS (
  SELECT doc_id, i, parts[i] AS s FROM (
    SELECT doc_id, string_split(regexp_replace({whole_sql(PARAGRAPHS)}, '([.!?:;])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts
    FROM documents WHERE regexp_matches(text, '{HINT}')), unnest(range(1, len(parts) + 1)) AS u(i)
), readings AS (
  SELECT doc_id, i, j, r[j] AS s FROM (
    SELECT doc_id, i, CASE WHEN contains(s, chr(10)) THEN list_concat([s], string_split(s, chr(10))) ELSE [s] END AS r FROM sentences), unnest(range(1, len(r) + 1)) AS u(j)
), found AS (
  SELECT doc_id, count(*) AS n, ' ' || string_agg(id, ' ' ORDER BY i, j) || ' ' AS seq
  FROM readings JOIN known ON known.sentence = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) GROUP BY doc_id
), hits AS (
  SELECT doc_id, licence, arg_min(rule, priority) AS rule, CAST(any_value(n) AS INTEGER) AS n_sentences, trim(any_value(seq)) AS sentences
  FROM found JOIN rules ON regexp_matches(seq, needs) AND NOT (licence = 'BSD-2-Clause' AND contains(seq, ' bsd_endorse '))
  GROUP BY doc_id, licence
)
SELECT * FROM hits h WHERE licence <> 'Proprietary' OR NOT EXISTS (SELECT 1 FROM hits o WHERE o.doc_id = h.doc_id AND o.rule <> 'mention')
"""

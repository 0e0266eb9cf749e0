"""Licence scans by sentence rules, on built-in functions only.

Texts are cut into pieces at sentence ends and line breaks, and pieces are normalised: lower case, runs of other characters than a-z and
0-9, so also comment marks, as one space. Consecutive pieces, from the start of the first to the end of the last, that spell a sentence
of the table of known licence sentences give its identifier, so a sentence may be wrapped over lines or cut inside, like one with a
colon; it counts only as a whole. Every other piece is unknown.

The identifiers, in text order and with the unknown pieces between them, are matched against the licence rules in their order. The
sentences of a rule may have up to ``GAP`` unknown pieces between them (a copyright line, a list number). A rule that matches takes
its identifiers out, so the parts of a longer licence are not reported again by the shorter rules after it.

The table is a literal of fixed size, one regular expression over the normalised pieces; documents are not shuffled.

Null or empty text: no pieces. An empty table gives an empty result. Rows are handled each by itself: repeated ones alike, whatever their id.
Texts of any length are read whole, in one pass. Where two known sentences start at one piece the longer one counts; licences are reported once each,
in order of their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import ASCII_LOWER

#: Unknown pieces that may stand between two sentences of one rule.
GAP = 8

# Names of public licences by identifier, as notices call them.
NAMES = {
    "MIT": ("MIT License", "MIT license"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "Apache-1.1": ("Apache Software License, Version 1.1",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "Modified BSD License", "New BSD License"),
    "0BSD": ("Zero-Clause BSD License",),
    "ISC": ("ISC License",),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License v2.0"),
    "GPL-2.0-or-later": ("GNU General Public License, version 2 or later", "GNU General Public License v2.0 or later"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0"),
    "GPL-3.0-or-later": ("GNU General Public License, version 3 or later", "GNU General Public License v3.0 or later"),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"),
    "LGPL-2.1-or-later": ("GNU Lesser General Public License, version 2.1 or later",),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"),
    "LGPL-3.0-or-later": ("GNU Lesser General Public License, version 3 or later",),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"),
    "AGPL-3.0-or-later": ("GNU Affero General Public License, version 3 or later",),
    "MPL-1.1": ("Mozilla Public License, version 1.1",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "EPL-1.0": ("Eclipse Public License v1.0",),
    "EPL-2.0": ("Eclipse Public License v2.0", "Eclipse Public License 2.0"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-3.0": ("CC BY 3.0",),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0",),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
    "Artistic-2.0": ("Artistic License 2.0",),
    "OFL-1.1": ("SIL Open Font License, Version 1.1",),
    "PostgreSQL": ("PostgreSQL License",),
    "WTFPL": ("WTFPL",),
}
#: How a notice names a licence in one sentence.
NOTICES = ("Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "This work is licensed under a {}.", "This project is licensed under the {}.", "Distributed under the {}.")

# Sentences of public licences and their notices, with an identifier each.
SENTENCES = {
    10: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    11: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    12: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    13: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    20: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    21: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    22: "See the License for the specific language governing permissions and limitations under the License.",
    23: "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    30: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    31: "See the GNU General Public License for more details.",
    32: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    33: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    34: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    35: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    36: "See the GNU Affero General Public License for more details.",
    37: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    38: "See the GNU Lesser General Public License for more details.",
    39: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    40: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    41: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    42: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    43: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    44: "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    60: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    61: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    62: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    63: "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    64: "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    65: "This software is provided 'as-is', without any express or implied warranty.",
    66: "In no event will the authors be held liable for any damages arising from the use of this software.",
    67: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    68: "Distributed under the Boost Software License, Version 1.0.",
    69: "This is free and unencumbered software released into the public domain.",
    70: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    71: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    72: "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
}
# Rules over SENTENCES, in order; longer sequences of identifiers first.
TEXT_RULES = (
    ("BSD-4-Clause", (40, 41, 42, 44)),
    ("BSD-3-Clause", (40, 41, 42, 43)),
    ("BSD-2-Clause", (40, 41, 42)),
    ("MIT", (10, 11, 12)),
    ("Apache-2.0", (20, 21, 22)),
    ("Apache-2.0", (20, 23, 22)),
    ("GPL-3.0-or-later", (30, 31)),
    ("GPL-2.0-or-later", (32, 31)),
    ("GPL-2.0-only", (33, 31)),
    ("GPL-2.0-only", (34, 31)),
    ("AGPL-3.0-or-later", (35, 36)),
    ("LGPL-2.1-or-later", (37, 38)),
    ("LGPL-3.0-or-later", (39, 38)),
    ("Zlib", (65, 66, 67)),
    ("MPL-2.0", (62, 63)),
    ("MPL-2.0", (62, 64)),
    ("Unlicense", (69, 70)),
    ("MIT", (10, 11)),
    ("MIT", (10,)),
    ("MIT-0", (13,)),
    ("Apache-2.0", (20,)),
    ("GPL-3.0-or-later", (30,)),
    ("GPL-2.0-or-later", (32,)),
    ("GPL-2.0-only", (33,)),
    ("GPL-2.0-only", (34,)),
    ("AGPL-3.0-or-later", (35,)),
    ("LGPL-2.1-or-later", (37,)),
    ("LGPL-3.0-or-later", (39,)),
    ("ISC", (60,)),
    ("0BSD", (61,)),
    ("MPL-2.0", (62,)),
    ("Zlib", (67,)),
    ("BSL-1.0", (68,)),
    ("Unlicense", (69,)),
    ("EPL-2.0", (71,)),
    ("WTFPL", (72,)),
)


def normalised(sentence: str) -> str:
    """What ``_normal`` gives."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def table() -> tuple[dict[str, int], list[tuple[str, tuple[int, ...]]]]:
    """Normalised sentence -> identifier, and the rules in order: those of SENTENCES, and a sentence and a rule for each way to name a licence."""
    known = {normalised(s): i for i, s in SENTENCES.items()}
    rules = list(TEXT_RULES)
    for n, (licence, names) in enumerate(NAMES.items()):
        own = [f"SPDX-License-Identifier: {licence}", *(x.format(name) for name in names for x in NOTICES)]
        for s in map(normalised, own):
            known.setdefault(s, 1000 + n)
        rules.append((licence, (1000 + n,)))
    return known, rules


KNOWN, RULES = table()
#: Sentence ends with the space after them, where texts are cut besides line breaks.
_CUT = r"([.!?:;])[ \t\r\n]+"
#: Every known sentence holds one of these words, and no line break is inside a word.
_MAY = "(?i)licens|permission|permitted|software|redistribution|materials|mpl|released|distributed|work"


def _alternatives() -> str:
    """A regular expression for the known sentences as a tree of their words, longer ones first.

    Between words is a space, or the end of a piece and the start of the next.
    """
    tree: dict = {}
    for s in sorted(KNOWN):
        node = tree
        for word in s.split(" "):
            node = node.setdefault(word, {})
        node[""] = {}

    def said(node: dict) -> str:
        inner = [(word + (f"(?: |[|][|]){said(below)}" if set(below) != {""} else "")) if "" not in below or set(below) == {""} else f"{word}(?:(?: |[|][|]){said({k: v for k, v in below.items() if k})}|)" for word, below in sorted(node.items())]
        return inner[0] if len(inner) == 1 else f"(?:{'|'.join(inner)})"

    return said(tree)


def rule_pattern(ids: tuple[int, ...], gap: int = GAP) -> str:
    """A regular expression over a sequence in which <i> is a known sentence and . an unknown piece."""
    return f"[.]{{0,{gap}}}".join(f"<{i}>" for i in ids)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_known, sentence_ids, positions, licenses of each row of ``docs`` (doc_id, text).

    n_sentences counts pieces that hold a letter or digit. positions has, for each known sentence, where it is among the known
    sentences and unknown pieces, from 0. sentence_ids is the sequence of identifiers; unknown pieces are not in it.
    """
    # Each piece stands between two bars, and a match takes whole pieces with theirs.
    pattern = f"[|](?:{_alternatives()}|[^|]*)[|]"
    ids = "map(" + ", ".join(f"'{s}', {i}" for s, i in KNOWN.items()) + ")"
    normal = f"trim(regexp_replace({ASCII_LOWER.format('raw')}, '[^a-z0-9]+', ' '))"
    rows = docs.select("doc_id", "text", F.split(F.regexp_replace(F.coalesce("text", F.lit("")), _CUT, "$1\n"), "\n").alias("lines"))
    rows = rows.select("doc_id", F.rlike("text", F.lit(_MAY)).alias("may"), F.expr("filter(lines, l -> l RLIKE '[A-Za-z0-9]')").alias("sentences"))
    joined = F.when(F.col("may") & (F.size("sentences") > 0), F.expr(f"concat('|', array_join(transform(sentences, raw -> {normal}), '||'), '|')")).otherwise("")
    rows = rows.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.regexp_extract_all(joined, F.lit(pattern), F.lit(0)).alias("found"))
    key = "replace(substr(s, 2, length(s) - 2), '||', ' ')"
    rows = rows.select("doc_id", "n_sentences", F.expr(f"transform(found, s -> element_at({ids}, {key}))").alias("ids"))
    rows = rows.select(
        "doc_id",
        "n_sentences",
        F.expr("cast(size(filter(ids, i -> i IS NOT NULL)) as bigint)").alias("n_known"),
        F.expr("array_join(transform(filter(ids, i -> i IS NOT NULL), i -> concat('<', i, '>')), '')").alias("sentence_ids"),
        F.expr("array_join(filter(transform(ids, (i, p) -> IF(i IS NULL, NULL, p)), p -> p IS NOT NULL), ',')").alias("positions"),
        F.expr("array_join(transform(ids, i -> coalesce(concat('<', i, '>'), '.')), '')").alias("seq"),
    )
    rules = "array(" + ", ".join(f"named_struct('name', '{n}', 'seq', '{rule_pattern(s)}')" for n, s in RULES) + ")"
    step = "IF(regexp_count(a.seq, r.seq) > 0, named_struct('seq', regexp_replace(a.seq, r.seq, '|'), 'got', array_append(a.got, r.name)), a)"
    got = f"aggregate({rules}, named_struct('seq', seq, 'got', cast(array() as array<string>)), (a, r) -> {step}).got"
    got = f"IF(n_known = 0, '', array_join(array_sort(array_distinct({got})), ','))"
    return rows.withColumn("licenses", F.expr(got)).drop("seq")


def _oracle() -> str:
    """The same by joins: pieces that spell a known sentence are found by equality of what consecutive pieces join to."""
    known = ", ".join(f"('{s}', {i})" for s, i in KNOWN.items())
    steps, at = [], "q0"
    for n, (name, ids) in enumerate(RULES, 1):
        p = rule_pattern(ids)
        steps.append(f"q{n} AS (SELECT r, regexp_replace(seq, '{p}', '|', 'g') AS seq, CASE WHEN regexp_matches(seq, '{p}') THEN list_append(got, '{name}') ELSE got END AS got FROM {at})")
        at = f"q{n}"
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  list_transform(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?:;])[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10)), lambda l: regexp_matches(l, '[A-Za-z0-9]')),
    lambda l: trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))) AS s FROM documents),
known(s, id) AS (VALUES {known}),
starts AS (SELECT DISTINCT string_split(s, ' ')[1] AS word FROM known),
e AS (SELECT r, p, s FROM (SELECT r, unnest(range(1, len(s) + 1)) AS p, unnest(s) AS s FROM d)),
grown(r, p, q, t) AS (
  SELECT r, p, p, s FROM e WHERE string_split(s, ' ')[1] IN (SELECT word FROM starts)
  UNION ALL SELECT g.r, g.p, g.q + 1, g.t || ' ' || e.s FROM grown g JOIN e ON e.r = g.r AND e.p = g.q + 1
    WHERE EXISTS (SELECT 1 FROM known k WHERE starts_with(k.s, g.t || ' ' || e.s))),
hit AS (SELECT r, p, max(q) AS q, arg_max(id, q) AS id FROM grown JOIN known ON known.s = t GROUP BY r, p),
taken(r, p, q, id) AS (
  SELECT r, p, q, id FROM hit WHERE p = (SELECT min(h.p) FROM hit h WHERE h.r = hit.r)
  UNION ALL SELECT h.r, h.p, h.q, h.id FROM taken t JOIN hit h ON h.r = t.r AND h.p = (SELECT min(x.p) FROM hit x WHERE x.r = t.r AND x.p > t.q)),
el AS (SELECT r, p, id FROM taken UNION ALL SELECT r, p, NULL FROM e WHERE r IN (SELECT r FROM taken) AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.r = e.r AND e.p BETWEEN t.p AND t.q)),
el2 AS (SELECT r, id, row_number() OVER (PARTITION BY r ORDER BY p) - 1 AS i FROM el),
el3 AS (SELECT r, count(id) AS n_known, string_agg(CASE WHEN id IS NOT NULL THEN '<' || id || '>' END, '' ORDER BY i) AS sentence_ids,
  string_agg(CASE WHEN id IS NOT NULL THEN i::VARCHAR END, ',' ORDER BY i) AS positions, string_agg(coalesce('<' || id || '>', '.'), '' ORDER BY i) AS seq FROM el2 GROUP BY r),
q0 AS (SELECT r, seq, CAST([] AS VARCHAR[]) AS got FROM el3),
{", ".join(steps)}
SELECT doc_id, len(s)::BIGINT AS n_sentences, coalesce(n_known, 0)::BIGINT AS n_known, coalesce(sentence_ids, '') AS sentence_ids, coalesce(positions, '') AS positions,
  coalesce(array_to_string(list_sort(list_distinct(got)), ','), '') AS licenses
FROM d LEFT JOIN el3 USING (r) LEFT JOIN {at} USING (r)
"""


ORACLE = _oracle()

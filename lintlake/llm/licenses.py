"""Licence scans by sentence rules, in DataFrame functions only.

Texts are cut into sentences and normalised (A-Z lower-cased, everything but
a-z and 0-9 to single spaces). Sentences that are known are replaced by their
identifiers; a document becomes a sequence of identifiers, without the
sentences in between. A rule is an ordered list of identifiers and matches
where it occurs as a run of that sequence. A matched rule that is part of a
longer matched rule is left out.

Two readings are matched: flowing text, where a line break is a space, and
lines, where it ends a sentence; licence texts come wrapped as well as in lists.

Everything is computed within the row: no shuffle, and no Python.

Defined cases: null and empty texts give empty results; a document may match
several rules; a sentence that repeats repeats in the sequence; other columns
are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Known licence sentences by identifier.
SENTENCES = {
    "apache-name": "Licensed under the Apache License, Version 2.0.",
    "apache-use": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-name": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-short-title": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "gpl3-name": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc-by-4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0-waive": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "reserved": "All rights reserved.",
}

# Ordered rules (licence, identifiers in order).
RULES = [
    ("Apache-2.0", ["apache-name"]),
    ("Apache-2.0", ["apache-use"]),
    ("Apache-2.0", ["apache-use", "apache-comply", "apache-copy", "apache-basis", "apache-see"]),
    ("MIT", ["mit-name"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["mit-short-title"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liable"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("GPL-3.0-only", ["gpl3-name"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-see"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-see", "gpl-received"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-see"]),
    ("AGPL-3.0-or-later", ["agpl-free"]),
    ("AGPL-3.0-or-later", ["agpl-free", "gpl-hope", "agpl-see"]),
    ("MPL-2.0", ["mpl-subject"]),
    ("MPL-2.0", ["mpl-subject", "mpl-obtain"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-long"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-4.0", ["cc-by-4-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC0-1.0", ["cc0-waive"]),
    ("Unlicense", ["unlicense-domain"]),
    ("Unlicense", ["unlicense-domain", "unlicense-anyone"]),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant"]),
    ("LicenseRef-All-Rights-Reserved", ["reserved"]),
]

#: Ends of sentences in flowing text, and in lines; white space follows the marks, so "2.0" stays whole.
FLOW_END, LINE_END = r"[.!?;:]+[\x20\x09-\x0D]+", r"[.!?;:]+[\x20\x09-\x0D]+|[\n\r]+"
OTHER = "[^A-Za-z0-9\n]+"


def normal_sentences(text: str) -> list[str]:
    """The flowing sentences of a known text, normalised as the engine does."""
    marked = re.sub(FLOW_END, "\n", text.replace("\n", " ") + " ")
    plain = re.sub(OTHER, " ", marked).lower()
    return [s.strip(" ") for s in plain.split("\n") if s.strip(" ")]


def known_sentences(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Normalised sentence: identifier. Further sentences of one text are "name.2" and so on; a sentence of two texts keeps its first name.

    Sentences without a letter, such as the rest of "v. 2.0.", say nothing and are left out.
    """
    known: dict[str, str] = {}
    for name, text in sentences.items():
        for i, s in enumerate(normal_sentences(text)):
            if re.search("[a-z]", s):
                known.setdefault(s, name if i == 0 else f"{name}.{i + 1}")
    return known


def rule_table(rules=RULES, sentences: dict[str, str] = SENTENCES) -> list[tuple[str, str, str]]:
    """(rule, licence, key) with the key as a run of identifiers, each between bars."""
    known = known_sentences(sentences)
    run = lambda ids: [known[s] for i in ids for s in normal_sentences(sentences[i]) if s in known]
    return [(f"{licence}:{'+'.join(ids)}", licence, f"|{'|'.join(run(ids))}|") for licence, ids in rules]


def _identifiers(text, end: str, known: dict[str, str]) -> F.Column:
    """Identifiers of the known sentences, in order."""
    flat = F.replace(text, F.lit("\n"), F.lit(" ")) if end == FLOW_END else text
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.concat(flat, F.lit(" ")), end, "\n"), OTHER, " "))
    sentences = F.transform(F.split(plain, "\n"), lambda s: F.trim(s))
    hits = F.filter(sentences, lambda s: s.isin(list(known)))
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.transform(hits, lambda s: F.element_at(names, s))


def scan_licenses(docs: DataFrame, rules=RULES, sentences: dict[str, str] = SENTENCES) -> DataFrame:
    """Per row: doc_id, n_known long, sequence (identifiers, flowing reading), rules and licenses (arrays, in order of name)."""
    known = known_sentences(sentences)
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", _identifiers(text, FLOW_END, known).alias("_flow"), _identifiers(text, LINE_END, known).alias("_line"))
    # A generator keeps the optimiser from repeating the cuts for every use of their results.
    found = found.select("doc_id", F.explode(F.array(F.struct("_flow", "_line"))).alias("_s")).select("doc_id", "_s.*")
    # No identifier holds a bar or a line break, so no run spans the two readings.
    joined = F.concat(*[F.concat(F.lit("|"), F.array_join(c, "|"), F.lit("|\n")) for c in ("_flow", "_line")])
    table = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(x).alias("license"), F.lit(k).alias("key")) for r, x, k in rule_table(rules, sentences)])
    hits = F.filter(table, lambda r: F.contains("_ids", r.key))
    found = found.withColumn("_ids", joined)
    found = found.withColumn("_hits", F.when((F.size("_flow") > 0) | (F.size("_line") > 0), hits).otherwise(F.slice(table, 1, 0)))
    longest = F.filter("_hits", lambda r: ~F.exists("_hits", lambda o: (o.key != r.key) & F.contains(o.key, r.key)))
    return found.select(
        "doc_id", F.greatest(F.size("_flow"), F.size("_line")).cast("long").alias("n_known"), F.col("_flow").alias("sequence"),
        F.array_sort(F.transform(longest, lambda r: r.rule)).alias("rules"),
        F.array_sort(F.array_distinct(F.transform(longest, lambda r: r.license))).alias("licenses"))


def license_digest(docs: DataFrame) -> DataFrame:
    found = scan_licenses(docs)
    return found.select("doc_id", "n_known", *[F.array_join(c, ",").alias(c) for c in ("sequence", "rules", "licenses")])


def digest_sql() -> str:
    """The same digest in DuckDB SQL over the whole table."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = known_sentences()
    names = ", ".join(map(quote, known))
    idents = ", ".join(quote(known[k]) for k in known)
    rules = ", ".join(f"({quote(r)}, {quote(x)}, {quote(k)})" for r, x, k in rule_table())

    def ids(flat: str, end: str) -> str:
        plain = f"lower(regexp_replace(regexp_replace(({flat}) || ' ', '{end}', chr(10), 'g'), '[^A-Za-z0-9\\n]+', ' ', 'g'))"
        return (f"list_transform(list_filter(list_transform(string_split({plain}, chr(10)), lambda s: trim(s, ' ')), lambda s: list_contains([{names}], s)), "
                f"lambda s: ([{idents}])[list_position([{names}], s)])")

    text = "coalesce(text, '')"
    flow, line = ids(f"replace({text}, chr(10), ' ')", FLOW_END), ids(text, LINE_END)
    return f"""
WITH rules(rule, license, key) AS (VALUES {rules}),
numbered AS (SELECT doc_id, text, row_number() OVER () AS place FROM documents),
read AS (SELECT place, doc_id, {flow} AS flow, {line} AS line FROM numbered),
joined AS (SELECT *, '|' || array_to_string(flow, '|') || '|' || chr(10) || '|' || array_to_string(line, '|') || '|' || chr(10) AS ids FROM read),
hits AS (SELECT place, rule, license, key FROM joined JOIN rules ON contains(ids, key) WHERE len(flow) > 0 OR len(line) > 0),
longest AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.place = h.place AND o.key <> h.key AND contains(o.key, h.key))),
named AS (SELECT place, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM longest GROUP BY place)
SELECT doc_id, CAST(greatest(len(flow), len(line)) AS BIGINT) AS n_known, array_to_string(flow, ',') AS sequence,
       coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses
FROM joined LEFT JOIN named USING (place)
"""

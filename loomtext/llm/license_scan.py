"""Licence recognition by sentence rules, in DataFrame functions only.

Texts are cut into sentences, normalised to lower-case letters and digits, and each sentence that is known becomes its
identifier. A licence rule is an ordered sequence of identifiers and matches where they follow each other among a
text's known sentences. Texts are cut twice, with line ends as sentence ends (notices on lines of their own) and as
spaces (wrapped paragraphs). A third reading takes sentences from each line that opens as a known one does, below
headings or copyright lines without a full stop, on to the sentence end or else to a blank line. A rule may match in any
reading; the SQL check has the first two.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ENDS = r"[.!?;]+[\x20\x09-\x0D]+"
# Licences, and the names that notices give them.
NAMES = {
    "MIT": ("MIT License", "MIT Licence", "MIT"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL v3", "GPL-3.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL v2", "GPL-2.0"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL-2.1"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause"),
    "ISC": ("ISC License", "ISC"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "EPL-2.0"),
    "CC-BY-4.0": ("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0-1.0", "CC0 1.0 Universal"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "Zlib": ("zlib License", "zlib/libpng License", "Zlib"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"),
}
# The notices that name a licence.
NOTICES = (
    "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}",
    "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}",
    "This file is licensed under the {}", "This software is licensed under the {}", "This project is licensed under the {}",
    "SPDX-License-Identifier: {}",
)
# The sentences of longer licence texts and headers, in order.
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "Apache-2.0": (
        "you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "BSD-2-Clause": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "BSD-3-Clause": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    ),
    "GPL-2.0": (
        "This program is free software;",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
        "either version 2 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "LGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    ),
    "LGPL-2.1": (
        "This library is free software;",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
        "either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "CC0-1.0": ("To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty.",
        "In no event will the authors be held liable for any damages arising from the use of this software.",
    ),
    "BSL-1.0": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",),
}
# Sentences that open the whole texts of long licences, and no other's.
PREAMBLES = {
    "GPL-3.0": ("The GNU General Public License is a free, copyleft license for software and other kinds of works.",),
    "AGPL-3.0": ("The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",),
    "GPL-2.0": (
        "The licenses for most software are designed to take away your freedom to share and change it.",
        "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    ),
    "LGPL-2.1": (
        "The licenses for most software are designed to take away your freedom to share and change it.",
        "By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    ),
    "LGPL-3.0": ("This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",),
    "Apache-2.0": (
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
        "\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    ),
    "EPL-2.0": ("THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\").",),
}
# Paths of Creative Commons licences, which their notices name.
DEEDS = {"CC-BY-4.0": "licenses/by/4.0", "CC-BY-SA-4.0": "licenses/by-sa/4.0", "CC-BY-NC-4.0": "licenses/by-nc/4.0", "CC-BY-ND-4.0": "licenses/by-nd/4.0", "CC0-1.0": "publicdomain/zero/1.0"}


def normal_sentence(text: str) -> str:
    return re.sub("[^A-Za-z0-9]+", " ", text).lower().strip()


def rules() -> tuple[list[str], list[tuple[str, list[int]]]]:
    """Known sentences (identifier: place from 1) and the rules: (licence, identifiers in order)."""
    known: dict[str, int] = {}
    found: list[tuple[str, list[int]]] = []
    for licence, names in NAMES.items():
        for name in names:
            for notice in NOTICES:
                at = known.setdefault(normal_sentence(notice.format(name)), len(known) + 1)
                if (licence, [at]) not in found:
                    found.append((licence, [at]))
    deeds = [(licence, (f"To view a copy of this license, visit {scheme}://creativecommons.org/{path}/",)) for licence, path in DEEDS.items() for scheme in ("http", "https")]
    for licence, parts in [*TEXTS.items(), *PREAMBLES.items(), *deeds]:
        pieces = [normal_sentence(x) for part in parts for x in re.split(r"(?<=[.!?;])\s+", part)]
        found.append((licence, [known.setdefault(p, len(known) + 1) for p in pieces]))
    return list(known), found


def _opening(known: list[str], lines: bool) -> str:
    """Pattern of the sentences that open with the first word of a known one; \\x01 stands for a sentence end."""
    words = "|".join(sorted({s.split()[0] for s in known}))
    end = r"\x01\n" if lines else r"\x01"
    return rf"(?i)(?:^|[{end}])[^A-Za-z0-9{end}]*((?:{words})[^{end}]*)"


def sentence_ids(cut: Column, known: list[str], lines: bool) -> Column:
    """Identifiers of the known sentences, in order, of a text whose sentence ends are \\x01."""
    table_ = F.array(*(F.lit(s) for s in known))
    plain = lambda s: F.trim(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")))
    at = F.transform(F.regexp_extract_all(cut, F.lit(_opening(known, lines)), F.lit(1)), lambda s: F.array_position(table_, plain(s)))
    return F.filter(at, lambda i: i > 0)


BLANK = r"\n[\x20\t\r]*\n"


def opened_ids(cut: Column, known: list[str]) -> Column:
    """As :func:`sentence_ids`, of sentences that start at a line or sentence start and run over line ends.

    Sentences may start within others, so those are looked ahead at; none is followed beyond the most words that a known
    one has. Where the whole sentence is not known, its part before the first blank line may be.
    """
    table_ = F.array(*(F.lit(s) for s in known))
    most = max(len(s.split()) for s in known)
    words = "|".join(sorted({r"[^A-Za-z0-9\x01]+".join(s.split()[:2]) for s in known}))
    pattern = rf"(?i)(?:^|[\x01\n])[^A-Za-z0-9\x01\n]*+(?=((?:{words})(?![A-Za-z0-9])(?:[^A-Za-z0-9\x01]++[A-Za-z0-9]++){{0,{most}}}+(?:[^A-Za-z0-9\x01]*+\x01)?))"
    plain = lambda s: F.trim(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")))

    def place(s: Column) -> Column:
        whole = F.when(s.endswith("\x01"), F.array_position(table_, plain(s))).otherwise(0)
        part = F.when(s.rlike(BLANK), F.array_position(table_, plain(F.split(s, BLANK, 2)[0]))).otherwise(0)
        return F.when(whole > 0, whole).otherwise(part)

    starts = F.regexp_extract_all(F.concat(cut, F.lit("\x01")), F.lit(pattern), F.lit(1))
    return F.filter(F.transform(starts, place), lambda i: i > 0)


def _contains(ids: Column, found: list[tuple[str, list[int]]]) -> Column:
    path = F.concat(F.lit("|"), F.array_join(ids.cast("array<string>"), "|"), F.lit("|"))
    names: dict[str, list[str]] = {}
    for licence, seq in found:
        names.setdefault(licence, []).append("|" + "|".join(map(str, seq)) + "|")
    hit = [F.when(F.exists(F.array(*map(F.lit, seqs)), lambda s: F.instr(path, s) > 0), F.lit(licence)) for licence, seqs in sorted(names.items())]
    return F.when(F.size(ids) > 0, F.array_compact(F.array(*hit))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence_ids, wrapped_ids, opened_ids, licenses) of every row: identifiers by reading, and the licences found.

    Null and empty texts have none; repeated rows stay repeated; an empty table gives no rows; other columns are
    ignored. Licences stand in code-point order, each once.
    """
    known, found = rules()
    cut = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), ENDS, "\x01").alias("cut")
    out = docs.select(F.col(id_col).alias("id"), cut)
    out = out.select("id", sentence_ids(F.col("cut"), known, True).alias("sentence_ids"), sentence_ids(F.col("cut"), known, False).alias("wrapped_ids"), opened_ids(F.col("cut"), known).alias("opened_ids"))
    readings = [_contains(F.col(c), found) for c in ("sentence_ids", "wrapped_ids", "opened_ids")]
    return out.withColumn("licenses", F.array_sort(F.array_distinct(F.flatten(F.array(*readings)))))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        F.size("sentence_ids").cast("long").alias("n_known"),
        F.array_join(F.col("sentence_ids").cast("array<string>"), ",").alias("sentences"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def oracle() -> str:
    known, found = rules()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(s)}, {i})" for i, s in enumerate(known, 1))
    seqs = ", ".join(f"({quoted(licence)}, '|{'|'.join(map(str, seq))}|')" for licence, seq in found)
    cut = f"regexp_replace(coalesce(text, ''), '{ENDS}', chr(1), 'g')"
    plain = "trim(lower(regexp_replace(piece, '[^A-Za-z0-9]+', ' ', 'g')), ' ')"
    reading = lambda lines: f"regexp_extract_all({cut}, '{_opening(known, lines)}', 1)"
    return rf"""
WITH known(sentence, id) AS (VALUES {values}), rules(licence, seq) AS (VALUES {seqs}),
texts AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
pieces AS (
    SELECT r, 1 AS kind, unnest(p) AS piece, unnest(range(len(p))) AS place FROM (SELECT r, {reading(True)} AS p FROM texts)
    UNION ALL
    SELECT r, 2 AS kind, unnest(p) AS piece, unnest(range(len(p))) AS place FROM (SELECT r, {reading(False)} AS p FROM texts)),
sentences AS (SELECT r, kind, place, {plain} AS sentence FROM pieces),
paths AS (SELECT r, kind, count(*) AS n, string_agg(CAST(id AS VARCHAR), '|' ORDER BY place) AS path FROM sentences JOIN known USING (sentence) GROUP BY r, kind),
hits AS (SELECT DISTINCT r, licence FROM paths, rules WHERE contains('|' || path || '|', seq)),
named AS (SELECT r, string_agg(licence, ',' ORDER BY licence) AS licenses FROM hits GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_known, coalesce(replace(path, '|', ','), '') AS sentences, coalesce(licenses, '') AS licenses
FROM texts LEFT JOIN (SELECT * FROM paths WHERE kind = 1) USING (r) LEFT JOIN named USING (r)
"""

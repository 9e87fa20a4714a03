"""Licence scan by sentence rules: known sentences become identifiers, identifier sequences meet ordered rules.

A text is cut into sentences at empty lines, before list marks and after closing punctuation; a single line break is a blank; comment marks at the
start of a line, tags and entities of HTML are none of its text, and tags of blocks end a sentence. Each sentence is normalised (lower case, letters and digits only, single blanks) and looked up
in a table of known licence sentences, those of notices and the whole ones of the licence texts; one over several lines that is
not there is looked up line by line. The identifiers found, in text order, form a sequence; the rules are tried in order and each asks for its identifiers one after the other, with any others
between. All of it is one projection of built-in functions: no shuffle, no Python.

An SPDX tag is a sentence of its own line and names one licence; expressions of several are not read. The SQL cuts and knows sentences as the columns do.

Defined cases: null or empty text has no sentences and no licence; a sentence that occurs twice is listed twice;
repeated rows are judged each by themselves; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.llm.shared import bind

# Licence sentences and their identifiers.
SENTENCES = {
    "Licensed under the Apache License, Version 2.0": "apache2-notice",
    "you may not use this file except in compliance with the License": "apache2-compliance",
    "You may obtain a copy of the License at": "apache2-copy",
    "distributed under the License is distributed on an AS IS BASIS": "apache2-as-is",
    "Released under the MIT License": "mit-notice",
    "This project is licensed under the MIT License": "mit-notice",
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit-grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": "mit-condition",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND": "mit-warranty",
    "Licensed under CC BY-NC 4.0": "cc-by-nc-4-notice",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc-4-notice",
    "Licensed under CC BY 4.0": "cc-by-4-notice",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4-notice",
    "Licensed under CC BY-SA 4.0": "cc-by-sa-4-notice",
    "This work is licensed under the GNU General Public License, version 3": "gpl3-notice",
    "This program is free software": "gpl-free-software",
    "either version 3 of the License, or (at your option) any later version": "gpl3-or-later",
    "either version 2 of the License, or (at your option) any later version": "gpl2-or-later",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd-grant",
    "Redistributions of source code must retain the above copyright notice": "bsd-source",
    "Redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "Neither the name of the copyright holder nor the names of its contributors may be used": "bsd-no-endorsement",
    "All rights reserved": "all-rights-reserved",
    "This library is free software": "lgpl-free-software",
    "either version 2.1 of the License, or (at your option) any later version": "lgpl21-or-later",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v": "mpl2-subject",
    "This is free and unencumbered software released into the public domain": "unlicense-notice",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means": "unlicense-grant",
    "Distributed under the Boost Software License, Version 1.0": "bsl1-notice",
    # Titles stand on lines of their own.
    "Version 2.0, January 2004": "apache2-title",
    "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION": "apache2-terms",
    "GNU GENERAL PUBLIC LICENSE": "gpl-title",
    "GNU LESSER GENERAL PUBLIC LICENSE": "lgpl-title",
    "GNU AFFERO GENERAL PUBLIC LICENSE": "agpl-title",
    "Version 2, June 1991": "gpl2-title",
    "Version 2.1, February 1999": "lgpl21-title",
    "Version 3, 29 June 2007": "gpl3-title",
    "Version 3, 19 November 2007": "agpl3-title",
    "Mozilla Public License Version 2.0": "mpl2-title",
    "Eclipse Public License - v 2.0": "epl2-title",
    "Boost Software License - Version 1.0 - August 17th, 2003": "bsl1-title",
    "CC0 1.0 Universal": "cc0-title",
}

# How a notice names a licence, and the identifier of the notice.
NAMED = {
    "the Apache License, Version 2.0": "apache2-notice",
    "the Apache License 2.0": "apache2-notice",
    "the MIT License": "mit-notice",
    "the ISC License": "isc-notice",
    "the BSD 2-Clause License": "bsd2-notice",
    "the BSD 3-Clause License": "bsd3-notice",
    "the Mozilla Public License 2.0": "mpl2-notice",
    "the Mozilla Public License, version 2.0": "mpl2-notice",
    "the Eclipse Public License 2.0": "epl2-notice",
    "the Eclipse Public License, version 2.0": "epl2-notice",
    "the Boost Software License 1.0": "bsl1-notice",
    "the Boost Software License, version 1.0": "bsl1-notice",
    "the Unlicense": "unlicense-notice",
    "CC0 1.0": "cc0-notice",
    "CC0 1.0 Universal": "cc0-notice",
    "CC BY 4.0": "cc-by-4-notice",
    "CC BY-SA 4.0": "cc-by-sa-4-notice",
    "CC BY-NC 4.0": "cc-by-nc-4-notice",
    "a Creative Commons Attribution 4.0 International License": "cc-by-4-notice",
    "a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4-notice",
    "a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc-4-notice",
    "the GNU General Public License, version 2": "gpl2-notice",
    "the GNU General Public License, version 3": "gpl3-notice",
    "the GNU Lesser General Public License, version 2.1": "lgpl21-notice",
    "the GNU Lesser General Public License, version 3": "lgpl3-notice",
    "the GNU Affero General Public License, version 3": "agpl3-notice",
}
# What comes before the name.
VERBS = ["Licensed under", "Released under", "Distributed under", "This project is licensed under", "This work is licensed under", "This software is licensed under", "This software is released under", "This file is licensed under"]

# Licences that an SPDX tag can name.
TAGS = [
    "Apache-2.0", "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later",
]

_TERMS, _PUBLISHED, _LATER = "you can redistribute it and/or modify it under the terms of the GNU ", " as published by the Free Software Foundation", ", either version {} of the License, or (at your option) any later version"
_GRANT = "Permission to use, copy, modify, {} distribute this software for any purpose with or without fee is hereby granted"
_EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at {}://www.eclipse.org/legal/epl-2.0"
_MPL = "If a copy of the MPL was not distributed with this file, You can obtain one at {}://mozilla.org/MPL/2.0"

# Whole sentences of the licence texts, as the breaks cut them.
WHOLE = {
    "Licensed under the Apache License, Version 2.0 (the License)": "apache2-notice",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "apache2-copy",
    "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0": "apache2-copy",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied": "apache2-as-is",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions": "mit-grant",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT": "mit-warranty",
    _TERMS + "General Public License" + _PUBLISHED + _LATER.format("3"): "gpl3-or-later",
    _TERMS + "General Public License" + _PUBLISHED + _LATER.format("2"): "gpl2-or-later",
    _TERMS + "General Public License version 2" + _PUBLISHED: "gpl2-only",
    _TERMS + "General Public License, version 2," + _PUBLISHED: "gpl2-only",
    _TERMS + "Lesser General Public License" + _PUBLISHED + _LATER.format("2.1"): "lgpl21-or-later",
    _TERMS + "Lesser General Public License" + _PUBLISHED + _LATER.format("3"): "lgpl3-or-later",
    _TERMS + "Lesser General Public License" + _PUBLISHED: "lgpl-terms",
    _TERMS + "Affero General Public License" + _PUBLISHED + _LATER.format("3"): "agpl3-or-later",
    _TERMS + "Affero General Public License" + _PUBLISHED: "agpl-terms",
    _GRANT.format("and/or") + ", provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    _GRANT.format("and") + ", provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    _GRANT.format("and/or"): "0bsd-grant",
    _MPL.format("http"): "mpl2-copy",
    _MPL.format("https"): "mpl2-copy",
    _EPL.format("http"): "epl2-notice",
    _EPL.format("https"): "epl2-notice",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following": "bsl1-grant",
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-dedication",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd-grant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "bsd-source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd-binary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-no-endorsement",
    # A name such as Company, Inc. ends a sentence.
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-no-endorsement",
}

# Fixed values: (licence, identifiers that must follow one another), in the order of trial.
RULES = [
    ("Apache-2.0", ["apache2-notice"]),
    ("Apache-2.0", ["apache2-compliance", "apache2-copy"]),
    ("Apache-2.0", ["apache2-title", "apache2-terms"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
    ("CC-BY-4.0", ["cc-by-4-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("CC0-1.0", ["cc0-dedication"]),
    ("CC0-1.0", ["cc0-title"]),
    ("AGPL-3.0", ["agpl3-notice"]),
    ("AGPL-3.0-or-later", ["agpl3-or-later"]),
    ("AGPL-3.0-or-later", ["agpl-terms", "gpl3-or-later"]),
    ("AGPL-3.0", ["agpl-title", "agpl3-title"]),
    ("LGPL-2.1", ["lgpl21-notice"]),
    ("LGPL-3.0", ["lgpl3-notice"]),
    ("LGPL-2.1-or-later", ["lgpl21-or-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-or-later"]),
    ("LGPL-3.0-or-later", ["lgpl-terms", "gpl3-or-later"]),
    ("LGPL-2.1", ["lgpl-title", "lgpl21-title"]),
    ("LGPL-3.0", ["lgpl-title", "gpl3-title"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("GPL-3.0-or-later", ["gpl-free-software", "gpl3-or-later"]),
    ("GPL-2.0-or-later", ["gpl-free-software", "gpl2-or-later"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("GPL-3.0", ["gpl-title", "gpl3-title"]),
    ("GPL-2.0", ["gpl-title", "gpl2-title"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("EPL-2.0", ["epl2-title"]),
    ("BSL-1.0", ["bsl1-notice"]),
    ("BSL-1.0", ["bsl1-title"]),
    ("BSL-1.0", ["bsl1-grant"]),
    ("Unlicense", ["unlicense-notice"]),
    ("Unlicense", ["unlicense-grant"]),
    ("ISC", ["isc-notice"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("BSD-3-Clause", ["bsd3-notice"]),
    ("BSD-2-Clause", ["bsd2-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-no-endorsement"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("proprietary", ["all-rights-reserved"]),
]
RULES = [(name, [f"spdx-{name.lower()}"]) for name in TAGS] + RULES


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


ALL = (
    {normal(f"SPDX-License-Identifier {name}"): f"spdx-{name.lower()}" for name in TAGS}
    | {normal(f"{verb} {name}"): i for verb in VERBS for name, i in NAMED.items()}
    | {normal(s): i for s, i in (SENTENCES | WHOLE).items()}
)
# What a text is put through before it is cut: pattern and replacement; the patterns mean the same to Java and RE2.
_LINE = r"(^|\n)[\x20\t\r]*"
CLEAN = [
    (r"&(?:quot|apos|nbsp|amp|ldquo|rdquo|lsquo|rsquo|#34|#39|#160);", " "),
    (r"(?i)</?(?:p|li|ul|ol|div|tr|table|pre|blockquote|h[1-6]|html|body|head)(?:[\x20\t\r\n/][^<>]{0,300})?>", "\n\n"),
    (r"(?i)</?(?:br|a|b|i|u|em|strong|span|tt|td|th|code|font|center|small|sup)(?:[\x20\t\r\n/][^<>]{0,300})?>", " "),
    (_LINE + r"(?://+|/?\*+/?|#+|--+|;+|%+|>+|<!--|dnl\b|(?i:rem)\b)[\x20\t\r]*", r"\1"),
    (_LINE + r"(?:\(?(?:[0-9]{1,2}|[A-Za-z]|[ivx]{2,4})[.)]|-|\x{2022})[\x20\t]+", r"\1" + "\n\n"),
    (r"(?i)(SPDX-License-Identifier):", "\n" + r"\1 "),
]
BREAK = r"\n[\x20\t\r]*\n[\x20\t\r\n]*|[.!?;:][\x20\t\r\n]+"
HOLDER = r"^neither the name of .{1,200}? nor the names of (?:its|their|any) contributors may be used to endorse"


def plain(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of text, in order."""
    known = F.create_map(*[F.lit(x) for pair in ALL.items() for x in pair])
    named = lambda w: F.when(w.startswith("neither the name of"), F.regexp_replace(w, HOLDER, "neither the name of the copyright holder nor the names of its contributors may be used to endorse")).otherwise(w)
    clean = F.coalesce(text, F.lit(""))
    for pattern, by in CLEAN:
        clean = F.regexp_replace(clean, pattern, by.replace("\\1", "$1"))
    parts = F.split(clean, BREAK)

    def lines(part: Column) -> Column:
        kept = F.filter(F.transform(F.split(part, "\n"), plain), lambda s: s.isin(*ALL))
        return F.transform(kept, lambda s: F.element_at(known, s))

    def found(part: Column) -> Column:
        whole = bind(named(plain(part)), lambda w: F.when(w.isin(*ALL), F.element_at(known, w)))
        return bind(whole, lambda i: F.when(i.isNotNull(), F.array(i)).when(F.contains(part, F.lit("\n")), lines(part)).otherwise(F.array().cast("array<string>")))

    return F.flatten(F.transform(parts, found))


def matches(ids: Column, rule: list[str]) -> Column:
    """Whether ids holds those of the rule one after the other."""
    line = F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))
    return line.rlike("," + ",(?:.*,)?".join(map(re.escape, rule)) + ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sentence_ids (comma-joined), license (first rule that fits, else null), licenses (all that fit)."""
    given = docs.select(F.col(doc_id).alias("doc_id"), bind(identifiers(F.col(text)), lambda ids: F.struct(ids.alias("ids"), F.size(ids).alias("n"))).alias("found"))
    ids = F.col("found.ids")
    fits = [F.when(matches(ids, rule), F.lit(name)) for name, rule in RULES]
    every = F.array_distinct(F.array_compact(F.array(*fits)))
    return given.select(
        "doc_id",
        F.col("found.n").cast("long").alias("n_sentences"),
        F.array_join(ids, ",").alias("sentence_ids"),
        F.when(F.col("found.n") > 0, F.coalesce(*fits)).alias("license"),
        F.when(F.col("found.n") > 0, F.array_join(every, ",")).otherwise("").alias("licenses"),
    )


def oracle(table: str = "documents") -> str:
    """The same in DuckDB SQL: sentences as rows, joined to the known ones."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    clean = "coalesce(text, '')"
    for pattern, by in CLEAN:
        clean = f"regexp_replace({clean}, {quoted(pattern)}, {quoted(by)}, 'g')"
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in ALL.items())
    plain_sql = lambda s: f"trim(regexp_replace(lower({s}), '[^a-z0-9]+', ' ', 'g'))"
    holder = f"regexp_replace(sentence, {quoted(HOLDER)}, 'neither the name of the copyright holder nor the names of its contributors may be used to endorse')"
    fits = [f"CASE WHEN regexp_matches(line, {quoted(',' + ',(?:.*,)?'.join(map(re.escape, r)) + ',')}) THEN {quoted(n)} END" for n, r in RULES]
    return f"""
    WITH known(sentence, id) AS (VALUES {known}),
    rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM {table}),
    cut AS (SELECT r, string_split_regex({clean}, {quoted(BREAK)}) AS parts FROM rows),
    parts AS (SELECT r, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut),
    plain AS (SELECT r, i, part, {plain_sql("part")} AS sentence FROM parts),
    named AS (SELECT r, i, part, CASE WHEN starts_with(sentence, 'neither the name of') THEN {holder} ELSE sentence END AS sentence FROM plain),
    whole AS (SELECT r, i, part, id FROM named LEFT JOIN known USING (sentence)),
    cut_lines AS (SELECT r, i, string_split(part, chr(10)) AS lines FROM whole WHERE id IS NULL AND contains(part, chr(10))),
    lines AS (SELECT r, i, unnest(lines) AS line, generate_subscripts(lines, 1) AS j FROM cut_lines),
    found AS (SELECT r, i, 0 AS j, id FROM whole WHERE id IS NOT NULL UNION ALL SELECT r, i, j, id FROM (SELECT r, i, j, {plain_sql("line")} AS sentence FROM lines) JOIN known USING (sentence)),
    ids AS (SELECT r, count(*) AS n_sentences, string_agg(id, ',' ORDER BY i, j) AS sentence_ids FROM found GROUP BY r),
    judged AS (SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids, ',' || coalesce(sentence_ids, '') || ',' AS line FROM rows LEFT JOIN ids USING (r)),
    fits AS (SELECT doc_id, n_sentences, sentence_ids, CASE WHEN n_sentences > 0 THEN [x FOR x IN [{", ".join(fits)}] IF x IS NOT NULL] ELSE [] END AS fit FROM judged)
    SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, sentence_ids, fit[1] AS license,
           coalesce(array_to_string([x FOR x, i IN fit IF list_position(fit, x) = i], ','), '') AS licenses FROM fits"""

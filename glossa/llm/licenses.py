"""Licence recognition by sentence rules.

Texts are normalised (lower case, letters and digits only, single spaces) and
known licence sentences looked for from one boundary to another. Sentence
stops, blank lines and the ends of lines are boundaries, but a sentence may run
over the ends of lines inside it, so that a wrapped notice is found as well as
one on a line of its own; signs that open a line, as of comments, are left out.
At each place the longest known sentence counts. The identifiers found, in
order, are matched against licence rules, each an ordered list of identifiers
that may have others between them. All licences whose rules fit are named; of the
rules that fit the one with most sentences gives the text's licence, then the
earlier one. "v." before a number ends no sentence.

A sentence may have gaps, such as for a holder's name, of up to GAP words. An SPDX tag
is a sentence of its own, and of an expression in it the first name counts. A rule can name identifiers whose presence forbids it: a text
with an endorsement clause of any wording is no BSD-2-Clause.

It is one projection: no shuffle, and texts without any of the words that every
known sentence contains aren't searched at all.

Defined cases: a null or empty text has no sentences and no licence; a sentence
that occurs again counts again; of rules with as many sentences the first in
RULES wins; a very long text is searched whole; rows are judged each on its own;
other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What opens a line: signs, and the comment words of m4 and batch files.
OPENING = r"(?md)^[^a-z0-9\n]*(?:(?:dnl|rem)\b[^a-z0-9\n]*)?"
STOP = "\x01"
VERSION = r"\bv\.[ \t\r\n]+([0-9])"
SIGNS = "licen|permission|copyright|redistribution|software|warrant|public domain|creative commons|cc by|terms and conditions"
TAG = r"spdx-license-identifier:[ \t]*"
GAP, GAP_WORDS = "___", 24  # how a gap is written, and how many words fill one

#: Known licence sentences by identifier, as they are written.
SENTENCES = {
    "apache2-line": ["Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'],
    "apache2-comply": ["you may not use this file except in compliance with the License"],
    "apache2-copy": ["You may obtain a copy of the License at"],
    "asis-basis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "mit-line": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "MIT License"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "gpl3-line": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3"],
    "gpl-redistribute": ["This program is free software"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "gpl-terms3": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-terms2": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"],
    "gpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "gpl2-only": ["you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "either-2": ["either version 2 of the License, or (at your option) any later version"],
    "either-21": ["either version 2.1 of the License, or (at your option) any later version"],
    "lgpl-redistribute": ["This library is free software"],
    "lgpl-warranty": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "lgpl-terms": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "lgpl-terms3": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl-terms3": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "bsd-redistribution": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": [
        "Neither the name of ___ nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of ___ may be used to endorse or promote products derived from this software without specific prior written permission",
        "The name of ___ may not be used to endorse or promote products derived from this software without specific prior written permission",
        "The names of ___ may not be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "endorse-any": ["___ endorse or promote products derived from this software ___", "___ endorse or promote products derived from this software"],
    "apache2-title": ["Apache License Version 2.0, January 2004"],
    "apache2-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "gpl3-title": ["GNU General Public License Version 3, 29 June 2007"],
    "gpl2-title": ["GNU General Public License Version 2, June 1991"],
    "lgpl3-title": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "lgpl21-title": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "agpl3-title": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "mpl2-title": ["Mozilla Public License Version 2.0"],
    "verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"],
    "gpl3-preamble": ["The GNU General Public License is a free, copyleft license for software and other kinds of works"],
    "gpl2-preamble": ["The licenses for most software are designed to take away your freedom to share and change it"],
    "agpl3-preamble": ["The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"],
    "isc-grant": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "zlib-origin": ["The origin of this software must not be misrepresented"],
    "bsl-line": ["Distributed under the Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "bsl-grant": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'],
    "cc0-waiver": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"],
    "cc0-line": ["Licensed under CC0 1.0"],
    "epl2-line": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "mpl2-line": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense-line": ["This is free and unencumbered software released into the public domain"],
}
#: The parts of Creative Commons notices, and their licences' short and long names.
COMMONS_OPENINGS = ("Licensed under", "This work is licensed under", "This work is made available under")
COMMONS_ENDINGS = ("4.0 International License", "4.0 International Public License", "4.0 International", "4.0 License", "4.0")
COMMONS = {"ccby4-line": ("BY", "Attribution"), "ccbysa4-line": ("BY-SA", "Attribution-ShareAlike"), "ccbync4-line": ("BY-NC", "Attribution-NonCommercial"), "ccbyncsa4-line": ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), "ccbynd4-line": ("BY-ND", "Attribution-NoDerivatives")}
SENTENCES |= {
    name: [f"{opening} {article}{words} {ending}" for opening in COMMONS_OPENINGS for article in ("", "a ", "the ", "the terms of the ") for words in (f"CC {short}", f"Creative Commons {long}") for ending in COMMONS_ENDINGS]
    + [f"{opening} the Creative Commons {long} {ending} (CC {short} 4.0)" for opening in COMMONS_OPENINGS for ending in COMMONS_ENDINGS]
    for name, (short, long) in COMMONS.items()
}
#: Licence rules in order, each an ordered list of sentence identifiers.
RULES = (
    ("Apache-2.0", ("apache2-line", "apache2-comply", "apache2-copy", "asis-basis")),
    ("Apache-2.0", ("apache2-line",)),
    ("MIT", ("mit-line", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-line",)),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-terms3", "gpl-warranty")),
    ("GPL-3.0-only", ("gpl3-line",)),
    ("GPL-3.0-only", ("gpl3-title",)),
    ("GPL-2.0-only", ("gpl2-title",)),
    ("LGPL-3.0-only", ("lgpl3-title",)),
    ("LGPL-2.1-only", ("lgpl21-title",)),
    ("AGPL-3.0-only", ("agpl3-title",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("Apache-2.0", ("apache2-title", "apache2-terms")),
    ("GPL-2.0-or-later", ("gpl-redistribute", "gpl-terms", "either-2", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl-redistribute", "gpl-terms2", "gpl-warranty")),
    ("GPL-2.0-only", ("gpl-redistribute", "gpl2-only")),
    ("LGPL-2.1-or-later", ("lgpl-redistribute", "lgpl-terms", "either-21", "lgpl-warranty")),
    ("LGPL-3.0-or-later", ("gpl-redistribute", "lgpl-terms3")),
    ("LGPL-3.0-or-later", ("lgpl-redistribute", "lgpl-terms3")),
    ("AGPL-3.0-or-later", ("gpl-redistribute", "agpl-terms3")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "endorse-any")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Zlib", ("zlib-warranty", "zlib-grant", "zlib-origin")),
    ("BSL-1.0", ("bsl-line", "bsl-grant")),
    ("BSL-1.0", ("bsl-line",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("CC0-1.0", ("cc0-line",)),
    ("EPL-2.0", ("epl2-line",)),
    ("MPL-2.0", ("mpl2-line",)),
    ("CC-BY-4.0", ("ccby4-line",)),
    ("CC-BY-SA-4.0", ("ccbysa4-line",)),
    ("CC-BY-NC-4.0", ("ccbync4-line",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa4-line",)),
    ("CC-BY-ND-4.0", ("ccbynd4-line",)),
    ("Unlicense", ("unlicense-line",)),
)


#: Rules that some sentence forbids, wherever it stands.
FORBIDDEN = {"BSD-2-Clause": ("bsd-endorse", "endorse-any")}
#: The full texts, which quote the notices that programs under them carry: a
#: title of one of these and the sentence that opens its text outweigh every notice.
WHOLE_TEXTS = {"GPL-3.0-only": ("gpl3-title", "verbatim", "gpl3-preamble"), "GPL-2.0-only": ("gpl2-title", "verbatim", "gpl2-preamble"), "AGPL-3.0-only": ("agpl3-title", "verbatim", "agpl3-preamble"), "LGPL-3.0-only": ("lgpl3-title", "verbatim")}


def all_rules() -> list[tuple[str, tuple[str, ...], tuple[str, ...]]]:
    """(licence, identifiers in order, identifiers that forbid it), the first that fits
    first: whole texts, tags, then the rules with most sentences."""
    names = list(dict.fromkeys([name for name, _ in RULES]))
    whole = [(name, ids, ()) for name, ids in WHOLE_TEXTS.items()]
    tags = [(name, (f"spdx-{name.lower()}",), ()) for name in names]
    return whole + tags + [(name, ids, FORBIDDEN.get(name, ())) for name, ids in sorted(RULES, key=lambda r: -len(r[1]))]


def _normal(sentence: str) -> str:
    return re.sub("[^a-z0-9_]+", " ", re.sub(VERSION, r"v\1", sentence.lower())).strip()


def known_sentences() -> dict[str, str]:
    """Identifier by normalised sentence; gaps stay as they are written."""
    tags = {f"spdx {_normal(name)}": f"spdx-{name.lower()}" for name in dict.fromkeys(name for name, _ in RULES)}
    return {_normal(s): name for name, written in SENTENCES.items() for s in written} | tags


def _spaced(sentence: str) -> str:
    """A sentence as a pattern: line ends between any two words, and what a gap takes."""
    words = [rf"[a-z0-9]+(?:[ \n]+[a-z0-9]+){{0,{GAP_WORDS - 1}}}" if w == GAP else w for w in sentence.split(" ")]
    return r"[ \n]+".join(words)


def _longest() -> list[str]:
    """Whole sentences first, the longest first, and those that begin with a gap last."""
    return sorted(known_sentences(), key=lambda s: (s.startswith(GAP), -len(s), s))


def sentence_pattern() -> str:
    """The known sentences between boundaries, with ends of lines between any two words."""
    return rf"(?<=[\n{STOP}] ?)(?:{'|'.join(map(_spaced, _longest()))})(?= ?[\n{STOP}])"


def rule_pattern(ids: tuple[str, ...]) -> str:
    """The rule as a pattern over identifiers that each stand between commas."""
    return "," + ",(.*,)?".join(i.replace(".", "[.]") for i in ids) + ","


def scan_licenses(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_matched, sentence_ids (joined by commas), license (null if none) and
    licenses, all that fit, joined by commas."""
    exact = F.create_map(*[F.lit(x) for s, name in known_sentences().items() if GAP not in s for x in (s, name)])
    gapped = [(f"^{_spaced(s)}$", known_sentences()[s]) for s in _longest() if GAP in s]
    named_by = lambda s: F.coalesce(F.element_at(exact, s), *[F.when(s.rlike(pattern), F.lit(name)) for pattern, name in gapped])
    tagged = F.regexp_replace(F.regexp_replace(F.translate(F.lower(F.col(text)), STOP, " "), TAG, f"{STOP}spdx "), rf"(?m)({STOP}spdx [^ \t\r\n]+)[^\r\n]*$", f"$1{STOP}")
    lines = F.regexp_replace(tagged, OPENING, "")
    marked = F.concat(F.lit(STOP), F.regexp_replace(F.regexp_replace(lines, VERSION, "v$1"), r"[.!?;:]+[ \t\r\n]+|\n\n+", STOP), F.lit(STOP))
    plain = F.regexp_replace(marked, rf"[^a-z0-9\n{STOP}]+", " ")
    ids = F.transform(F.regexp_extract_all(plain, F.lit(sentence_pattern()), F.lit(0)), lambda s: named_by(F.regexp_replace(s, r"[ \n]+", " ")))
    found = F.when(F.lower(F.col(text)).rlike(SIGNS), ids).otherwise(F.array().cast("array<string>"))
    line = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    has = lambda ids: line.rlike(rule_pattern(ids))
    fits = [F.when(reduce(lambda fit, i: fit & ~has((i,)), forbidden, has(ids)), F.lit(name)) for name, ids, forbidden in all_rules()]
    everything = F.array_join(F.array_distinct(F.array_compact(F.array(*fits))), ",")
    matched = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(found, F.array().cast("array<string>")).alias("ids"))
    named = matched.select("doc_id", F.size("ids").cast("long").alias("n_matched"), F.array_join("ids", ",").alias("sentence_ids"))
    return named.withColumns({"license": F.when(F.col("n_matched") > 0, F.coalesce(*fits)), "licenses": F.when(F.col("n_matched") > 0, everything).otherwise("")})


def oracle() -> str:
    """The same bounds for an engine without lookarounds: every boundary is doubled, and a
    sentence takes one on either side."""
    table = ", ".join(f"('^{_spaced(s)}$', '{known_sentences()[s]}', {k})" for k, s in enumerate(_longest()))
    line = "',' || sentence_ids || ','"
    tests = [(name, " AND ".join([f"regexp_matches({line}, '{rule_pattern(ids)}')", *[f"NOT regexp_matches({line}, '{rule_pattern((i,))}')" for i in forbidden]])) for name, ids, forbidden in all_rules()]
    each = {name: " OR ".join(f"({t})" for n, t in tests if n == name) for name in dict.fromkeys(name for name, _ in tests)}
    fits = ", ".join(f"CASE WHEN {t} THEN '{name}' END" for name, t in tests)
    stop = "chr(1)"
    return rf"""
WITH known(pattern, id, k) AS (VALUES {table}),
tagged AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_replace(regexp_replace(replace(lower(coalesce(text, '')), {stop}, ' '), '{TAG}', {stop} || 'spdx ', 'g'), '(?m)(spdx [^ 	
]+)[^
]*$', '' || {stop}, 'g') AS text FROM documents),
marked AS (
  SELECT r, doc_id, {stop} || regexp_replace(regexp_replace(regexp_replace(text, '{OPENING.replace("(?md)", "(?m)")}', '', 'g'), '{VERSION}', 'v', 'g'), '[.!?;:]+[ 	
]+|

+', {stop}, 'g') || {stop} AS text FROM tagged),
plain AS (SELECT r, doc_id, regexp_replace(regexp_replace(text, '[^a-z0-9
]+', ' ', 'g'), '([
])', '', 'g') AS text FROM marked),
found AS (SELECT r, unnest(f) AS s, generate_subscripts(f, 1) AS k FROM (SELECT r, regexp_extract_all(text, '[
] ?({'|'.join(_spaced(s).replace('[ \n]+', '[ \n]+') for s in _longest())}) ?[
]', 1) AS f FROM plain)),
named AS (SELECT r, f.k, arg_min(id, known.k) AS id FROM found f JOIN known ON regexp_matches(regexp_replace(s, '[ 
]+', ' ', 'g'), pattern) GROUP BY ALL),
ids AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY k) AS sentence_ids FROM named GROUP BY r)
SELECT doc_id, n_matched, sentence_ids, coalesce({fits}) AS license, concat_ws(',', {", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in each.items())}) AS licenses
FROM (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matched, coalesce(sentence_ids, '') AS sentence_ids FROM plain LEFT JOIN ids USING (r))
"""

"""Licences in texts: known sentences become identifiers, identifier sequences are held against ordered rules.

A text is cut into sentences twice, at ends of sentences and of lines, and once more with its lines joined, since licence
texts are often wrapped. Before, signs and comment words that begin a line are taken off; a line without letters or digits is
a gap, and a copyright line is a sentence of its own. Sentences are normalised (lower case, words only, without the number of
a list item) and looked up in a fixed table; an endorsement clause is known by its wording, whoever holds the copyright.
The rest is passed over. The identifiers left, in order, are matched by rules that are sequences of identifiers without another in
between. SPDX-License-Identifier lines name licences directly; versions of the GNU licences lose "only", "or later" and "+", as in
the rules. All of it happens inside a row with built-in functions, so nothing is shuffled and no text meets another.

Results in odd cases: NULL and blank texts have no sentences and no licence. Repeated sentences count each time. Repeated
rows each get their row; further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and of usual notices, with an identifier each.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-name": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-this": "This project is licensed under the MIT License",
    "apache-name": "Licensed under the Apache License, Version 2.0",
    "apache-the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl3-name": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-licensed": "Licensed under the GNU General Public License v3.0",
    "gpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl3-free": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-end": "either version 2 of the License, or (at your option) any later version",
    "gpl2-start": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-warranty": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "by-4": "Licensed under CC BY 4.0",
    "by-sa-4": "Licensed under CC BY-SA 4.0",
    "by-nc-4": "Licensed under CC BY-NC 4.0",
    "by-nc-nd-4": "Licensed under CC BY-NC-ND 4.0",
    "by-4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "by-sa-4-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "by-nc-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "reserved": "All rights reserved under copyright",
    "gpl3-end": "either version 3 of the License, or (at your option) any later version",
    "gpl2-only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl2-version": "you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation",
    "lgpl21-end": "either version 2.1 of the License, or (at your option) any later version",
    "lgpl-start": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl21-free": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-free": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl2-start": "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    "lgpl2-free": "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "agpl-start": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "agpl3-free": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "cc0-extent": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0-received": "You should have received a copy of the CC0 Public Domain Dedication along with this software",
    "cc0-waived": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "epl1-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl2-v2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
}
#: Plain notices: one of these, and a name of the licence.
NOTICES = {"licensed": "Licensed under the", "released": "Released under the", "distributed": "Distributed under the", "project": "This project is licensed under the", "software": "This software is licensed under the", "work": "This work is licensed under the"}
NAMES = {
    "ISC": ("ISC License",), "BSD": ("BSD License",), "0BSD": ("Zero-Clause BSD License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "LGPL-2.1": ("GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1", "LGPL v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3", "LGPL v3"),
    "AGPL-3.0": ("GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3", "AGPL v3"),
    "GPL-2.0": ("GNU General Public License v2.0", "GNU General Public License, version 2"),
    "CC0-1.0": ("CC0 1.0 License", "CC0 1.0 Universal License", "Creative Commons CC0 1.0 Universal License"), "Unlicense": ("Unlicense",),
    "EPL-1.0": ("Eclipse Public License v1.0", "Eclipse Public License, Version 1.0", "Eclipse Public License 1.0"),
    "EPL-2.0": ("Eclipse Public License v2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"),
}
NAMED = {f"{licence}-{key}-{i}": (licence, f"{notice} {name}") for licence, names in NAMES.items() for i, name in enumerate(names) for key, notice in NOTICES.items()}
SENTENCES |= {key: sentence for key, (_, sentence) in NAMED.items()}
# Rules in the order they are reported, each a licence and the identifiers that must follow one another.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")), ("MIT", ("mit-grant", "mit-notice")), ("MIT", ("mit-name",)), ("MIT", ("mit-licensed",)), ("MIT", ("mit-this",)),
    ("Apache-2.0", ("apache-the", "apache-use")), ("Apache-2.0", ("apache-use", "apache-copy", "apache-warranty")), ("Apache-2.0", ("apache-name",)), ("Apache-2.0", ("apache-the",)),
    ("GPL-3.0", ("gpl3-name",)), ("GPL-3.0", ("gpl3-licensed",)), ("GPL-3.0", ("gpl3-redistribute",)), ("GPL-3.0", ("gpl3-free",)),
    ("GPL-2.0", ("gpl2-free",)), ("GPL-2.0", ("gpl2-start", "gpl2-end")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("CC-BY-4.0", ("by-4",)), ("CC-BY-4.0", ("by-4-long",)), ("CC-BY-SA-4.0", ("by-sa-4",)), ("CC-BY-SA-4.0", ("by-sa-4-long",)),
    ("CC-BY-NC-4.0", ("by-nc-4",)), ("CC-BY-NC-4.0", ("by-nc-4-long",)), ("CC-BY-NC-ND-4.0", ("by-nc-nd-4",)), ("MPL-2.0", ("mpl2-form",)),
    ("GPL-3.0", ("gpl2-start", "gpl3-end")), ("GPL-2.0", ("gpl2-only",)), ("GPL-2.0", ("gpl2-version",)),
    ("LGPL-2.1", ("lgpl21-free",)), ("LGPL-2.1", ("lgpl-start", "lgpl21-end")), ("LGPL-3.0", ("lgpl3-free",)), ("LGPL-3.0", ("lgpl-start", "gpl3-end")),
    ("LGPL-2.0", ("lgpl2-free",)), ("LGPL-2.0", ("lgpl2-start", "gpl2-end")), ("AGPL-3.0", ("agpl3-free",)), ("AGPL-3.0", ("agpl-start", "gpl3-end")),
    ("ISC", ("isc-grant",)), ("ISC", ("isc-and",)), ("0BSD", ("0bsd-grant",)), ("CC0-1.0", ("cc0-extent",)), ("CC0-1.0", ("cc0-received",)), ("CC0-1.0", ("cc0-waived",)),
    ("Unlicense", ("unlicense-free",)), ("EPL-1.0", ("epl1-terms",)), ("EPL-2.0", ("epl2-terms",)), ("EPL-2.0", ("epl2-v2",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert")), ("BSD", ("bsd-style",)),
    *((licence, (key,)) for key, (licence, _) in NAMED.items()),
)
#: A rule is passed over where a longer one that begins like it holds at the same place.
SHADOWED = {("bsd-grant", "bsd-source", "bsd-binary"): (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"))}
#: Every known sentence has one of these; a text without any is not cut.
CUE = r"(?i)licen[cs]e|permission|warrant|redistribut|copyright|public domain|endorse|advertising|[al]gpl|cc0"
#: The grants of MIT and BSD begin a sentence wherever they stand, so also right after a holder's name.
END = r"[.!?;:]+[\x20\x09-\x0D]+|(?=\bPermission\s+is\s+hereby\s+granted,\s+free\s+of\b)|(?=\bRedistribution\s+and\s+use\s+in\s+source\s+and\b)"
LINE, GAP = r"\n", r"\n(?:[^\p{L}\p{N}\n]*\n)+"
#: What begins a line and is no part of its sentence: comment signs, list signs, comment words.
LEADER = r"(?m)^(?:[^\p{L}\p{N}\n(\x{A9}]+|(?:dnl|rem|REM)\b)+"
#: A line that states a copyright, and no line of a sentence that goes on about copyright notices, holders or owners.
HOLDER = r"(?m)^((?:Portions\s+)?(?:(?i:copyright)[\x20\x09]*(?:\([cC]\)|\x{A9}|:|(?:19|20)\d\d)|Copyright[\x20\x09]+(?!Holder|Owner|Notice|Law|Act)\p{Lu}|\([cC]\)[\x20\x09]|\x{A9}).*)$"
ENDORSE = r"\bused to endorse or promote products derived from (?:this|the) software\b"
_SPDX_ID = r"[A-Za-z0-9][A-Za-z0-9.+-]*"
SPDX = rf"SPDX-License-Identifier:[\x20\x09]*(\(*{_SPDX_ID}\)*(?:[\x20\x09]+(?:AND|OR|WITH)[\x20\x09]+\(*{_SPDX_ID}\)*)*)"


def normal(sentence: Column) -> Column:
    found = F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(found, r"^(?:\d{1,2}|[a-z]|[ivx]+) (?=redistributions|neither|all advertising|the above copyright)", "")


def _lines(text: Column) -> Column:
    """The text without what begins its lines, copyright lines between gaps."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), LEADER, ""), HOLDER, "\n\n$1\n\n")


def _declared(text: Column) -> Column:
    """Licences of SPDX lines, without exceptions."""
    found = F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), lambda x: F.regexp_replace(x, rf"\s+WITH\s+\(*{_SPDX_ID}|[()]", ""))
    names = F.flatten(F.transform(found, lambda x: F.split(x, r"\s+(?:AND|OR)\s+")))
    names = F.transform(names, lambda x: F.regexp_replace(F.regexp_replace(x, r"[.-]+$", ""), r"^((?:A|L)?GPL-[0-9.]+?)(?:\+|-only|-or-later)$", "$1"))
    return F.filter(names, lambda x: ~x.isin("", "NONE", "NOASSERTION"))


def _table() -> Column:
    """Normal sentences and their identifiers, as one constant."""
    return F.create_map(*(x for name, sentence in SENTENCES.items() for x in (normal(F.lit(sentence)), F.lit(name))))


def _identifiers(text: Column, cut: str) -> Column:
    """Identifiers of the known sentences of a text, in order, each between commas."""
    found = F.transform(F.split(text, cut), normal)
    known = lambda x: F.coalesce(F.try_element_at(_table(), x), F.when(x.rlike(ENDORSE), F.lit("bsd-endorse")))
    named = F.filter(F.transform(found, known), lambda x: x.isNotNull())
    return F.concat(F.lit(","), F.array_join(named, ","), F.lit(","))


def _times(sequence: Column, rule: tuple[str, ...]) -> Column:
    """How often the identifiers stand one after another; each has a comma of its own before it there."""
    return F.regexp_count(sequence, F.lit(f"(?<=,){','.join(rule)}(?=,)"))


def _matched(sequence: Column, other: Column) -> Column:
    """Licences by the rules. other: the sequence of the other cut, which may show that a rule here is the start of a longer one."""
    out = []
    for licence, rule in RULES:
        if rule in SHADOWED:
            longer = lambda x, rule=rule: sum((_times(x, y) for y in SHADOWED[rule]), F.lit(0))
            held = _times(sequence, rule) > F.greatest(longer(sequence), longer(other))
        else:
            held = F.contains(sequence, F.lit(f",{','.join(rule)},"))
        out.append(F.when(held, F.lit(licence)))
    return F.array_compact(F.array(*out))


def scanned(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_sentences (known ones), sentences (their identifiers) and licences (sorted, comma-joined)."""
    text = F.when(F.col("text").rlike(CUE), F.col("text")).otherwise(F.lit(""))
    rows = documents.select("doc_id", _lines(text).alias("text"), _declared(text).alias("declared")).select(
        "doc_id", "declared", _identifiers(F.col("text"), f"{END}|{LINE}").alias("by_line"), _identifiers(F.col("text"), f"{END}|{GAP}").alias("joined"))
    size = lambda x: F.size(F.filter(F.split(x, ","), lambda y: y != "")).cast("long")
    more = size(F.col("joined")) > size(F.col("by_line"))
    best = F.when(more, F.col("joined")).otherwise(F.col("by_line"))
    by_line, joined = F.col("by_line"), F.col("joined")
    licences = F.array_sort(F.array_distinct(F.concat(_matched(by_line, joined), _matched(joined, by_line), "declared")))
    return rows.select("doc_id", size(best).alias("n_sentences"), F.trim(best, F.lit(",")).alias("sentences"), F.array_join(licences, ",").alias("licences"))

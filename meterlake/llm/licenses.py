"""Licence scans by sentence rules.

Texts are cut into sentences, sentences are normalised and mapped to the identifiers of known licence sentences, and the
sequence of identifiers of a text is matched against ordered rules. A rule that matches replaces its identifiers by the
name of its licence, so a longer statement is taken before the short ones that it contains. Built-in functions only.

A sentence ends at a line break or after `.`, `!` or `?` before white space. Normalised, it has A-Z lower-cased and every
run of other characters than ASCII letters and digits as one space.

Defined results: a null or empty text has no sentences and no licences; repeated rows are scanned one by one; empty tables
give no rows; extra columns are ignored. Texts with no word that every known sentence has one of are not cut at all.

`scan` cuts at every line break, as its SQL states. `scan_texts` finds the sentences of published licence texts and
headers also where their lines are wrapped, commented or numbered: a known sentence begins at the start of a line or
sentence, ends at the end of one, and may have such places within. Of sentences that overlap the first counts, of those
that begin together the longest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import picked

# Sentences of licence notices by identifier, as in the SQL of `scan`; not all are verbatim, PUBLISHED has those.
SENTENCES = {
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache2-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache2-head": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache2-may-not": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache2-you-may-not": "you may not use this file except in compliance with the License.",
    "apache2-obtain": "You may obtain a copy of the License at",
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-work": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "See the GNU General Public License for more details.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "ccbync4": "Licensed under CC BY-NC 4.0.",
    "ccby4": "Licensed under CC BY 4.0.",
    "ccbysa4": "Licensed under CC BY-SA 4.0.",
    "ccby4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbync4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "bsd-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions must retain the above copyright notice.",
    "bsd3-licensed": "Licensed under the BSD 3-Clause License.",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "rights": "All rights reserved under copyright law.",
}
# Ordered rules: sequences of identifiers, longer statements first, and the licence that each stands for.
RULES = (
    (("apache2-may-not", "apache2-obtain", "apache2-see"), "Apache-2.0"),
    (("apache2-head", "apache2-you-may-not", "apache2-obtain", "apache2-see"), "Apache-2.0"),
    (("gpl-free", "gpl-warranty", "gpl-received"), "GPL-3.0-or-later"),
    (("mit-title", "mit-notice"), "MIT"),
    (("apache2-may-not", "apache2-obtain"), "Apache-2.0"),
    (("apache2-head", "apache2-you-may-not"), "Apache-2.0"),
    (("apache2-licensed", "mit-licensed"), "Apache-2.0 OR MIT"),
    (("apache2-may-not",), "Apache-2.0"),
    (("apache2-head",), "Apache-2.0"),
    (("apache2-licensed",), "Apache-2.0"),
    (("mit-title",), "MIT"),
    (("mit-released",), "MIT"),
    (("mit-licensed",), "MIT"),
    (("mit-notice",), "MIT"),
    (("gpl3-work",), "GPL-3.0-only"),
    (("gpl2-work",), "GPL-2.0-only"),
    (("gpl-free",), "GPL-3.0-or-later"),
    (("ccbync4",), "CC-BY-NC-4.0"),
    (("ccbync4-work",), "CC-BY-NC-4.0"),
    (("ccbysa4",), "CC-BY-SA-4.0"),
    (("ccby4",), "CC-BY-4.0"),
    (("ccby4-work",), "CC-BY-4.0"),
    (("bsd3-licensed",), "BSD-3-Clause"),
    (("bsd-terms",), "BSD"),
    (("mpl2-subject",), "MPL-2.0"),
)
# Sentences verbatim from the published texts; notices of one sentence as above.
_MODIFY = "you can redistribute it and/or modify it under the terms of the GNU"
_HOPE = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
PUBLISHED = {i: t for i, t in SENTENCES.items() if i not in ("bsd-terms", "rights")} | {
    "rights": "All rights reserved.",
    "mit-short-title": "MIT License",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-title": "ISC License",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-as-is": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd3-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "apache2-unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl2-free": f"This program is free software; {_MODIFY} General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": f"This program {_HOPE}",
    "lgpl21-free": f"This library is free software; {_MODIFY} Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-hope": f"This library {_HOPE}",
    "lgpl-warranty": "See the GNU Lesser General Public License for more details.",
    "agpl3-free": f"This program is free software: {_MODIFY} Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-warranty": "See the GNU Affero General Public License for more details.",
    "agpl-received": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "mpl2-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl2-obtain-http": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
_BSD2 = ("bsd-terms", "bsd-source", "bsd-binary")
_MIT = ("mit-permission", "mit-notice", "mit-as-is", "mit-liability")
_ISC = ("isc-permission", "isc-as-is", "isc-liability")
PUBLISHED_RULES = (
    (("mit-title", *_MIT), "MIT"),
    (("mit-short-title", *_MIT), "MIT"),
    (_MIT, "MIT"),
    (("isc-title", *_ISC), "ISC"),
    (_ISC, "ISC"),
    ((*_BSD2, "bsd3-names", "bsd-as-is"), "BSD-3-Clause"),
    ((*_BSD2, "bsd3-names"), "BSD-3-Clause"),
    ((*_BSD2, "bsd-as-is"), "BSD-2-Clause"),
    (_BSD2, "BSD-2-Clause"),
    (("apache2-may-not", "apache2-obtain", "apache2-unless", "apache2-see"), "Apache-2.0"),
    (("apache2-head", "apache2-you-may-not", "apache2-obtain", "apache2-unless", "apache2-see"), "Apache-2.0"),
    (("gpl-free", "gpl-hope", "gpl-warranty", "gpl-received"), "GPL-3.0-or-later"),
    (("gpl-free", "gpl-hope", "gpl-warranty"), "GPL-3.0-or-later"),
    (("gpl2-free", "gpl-hope", "gpl-warranty", "gpl-received"), "GPL-2.0-or-later"),
    (("gpl2-free", "gpl-hope", "gpl-warranty"), "GPL-2.0-or-later"),
    (("lgpl21-free", "lgpl-hope", "lgpl-warranty"), "LGPL-2.1-or-later"),
    (("agpl3-free", "gpl-hope", "agpl-warranty", "agpl-received"), "AGPL-3.0-or-later"),
    (("agpl3-free", "gpl-hope", "agpl-warranty"), "AGPL-3.0-or-later"),
    (("mpl2-subject", "mpl2-obtain"), "MPL-2.0"),
    (("mpl2-subject", "mpl2-obtain-http"), "MPL-2.0"),
    *(r for r in RULES if "bsd-terms" not in r[0]),
    (("mit-short-title", "mit-permission"), "MIT"),
    (("mit-short-title",), "MIT"),
    (("mit-permission",), "MIT"),
    (("isc-title",), "ISC"),
    (("isc-permission",), "ISC"),
    (("gpl2-free",), "GPL-2.0-or-later"),
    (("lgpl21-free",), "LGPL-2.1-or-later"),
    (("agpl3-free",), "AGPL-3.0-or-later"),
    (("bsd-terms",), "BSD"),
)
CRITICAL = ("licen", "copyright")  # every known sentence has one of them
SENTENCE_END = r"\n|[.!?]+[ \t\r\n]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_sentence(text: str) -> str:
    """What the column expression below makes of one sentence."""
    plain = "".join(c if c in LOWER + "0123456789" else " " for c in text.translate(str.maketrans(UPPER, LOWER)))
    return " ".join(plain.split())


def known_sentences(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Identifiers by normalised sentence."""
    known = {normal_sentence(t): i for i, t in sentences.items()}
    if any(not any(c in s for c in CRITICAL) for s in known):
        raise ValueError("a known sentence has none of the critical words")
    return known


def sequence(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    pairs = [F.lit(x) for pair in known_sentences(sentences).items() for x in pair]
    known = F.create_map(*pairs)
    lower = F.translate(text, UPPER, LOWER)
    normal = lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    cut = F.filter(F.split(lower, SENTENCE_END), lambda s: F.lit(False) if not CRITICAL else _critical(s))
    ids = F.filter(F.transform(cut, lambda s: F.try_element_at(known, normal(s))), lambda i: i.isNotNull())
    return F.when(_critical(lower), ids).otherwise(F.expr("cast(array() as array<string>)"))


def _critical(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in CRITICAL])


def needed_words(sentences: dict[str, str]) -> list[str]:
    """Few words of which every sentence has one, most frequent first."""
    left, found = [set(normal_sentence(t).split()) for t in sentences.values()], []
    while left:
        words = {w for s in left for w in s}
        found.append(max(words, key=lambda w: (sum(w in s for s in left) * len(w), w)))
        left = [s for s in left if found[-1] not in s]
    return found


BREAK = r"\n|[.!?:;]+(?=[ \t\r\n]|\z)"


def wrapped_sequence(text: Column, sentences: dict[str, str] = PUBLISHED) -> Column:
    """The identifiers of the known sentences of a text in order, wherever its lines break."""
    none = F.expr("cast(array() as array<string>)")
    if not sentences:
        return none
    known = {normal_sentence(t): i for i, t in sentences.items()}
    lower = F.translate(text, UPPER + "|", LOWER + " ")
    words = F.regexp_replace(F.concat(F.lit("|"), F.regexp_replace(lower, BREAK, "|"), F.lit("|")), "[^a-z0-9|]+", " ")
    marked = F.regexp_replace(words, r" ?\|[ |]*", " | ")
    each = "|".join(s.replace(" ", r"(?: \|)? ") for s in sorted(known, key=len, reverse=True))
    found = F.regexp_extract_all(marked, F.lit(rf"(?<= \| )(?:{each})(?= \|)"), 0)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    needed = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in needed_words(sentences)])
    return F.when(needed, F.transform(found, lambda s: F.element_at(table, F.replace(s, F.lit(" |"), F.lit(""))))).otherwise(none)


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """`id`, sentences (identifiers in order), licences (names in order of the text), unmatched (identifiers that no rule
    took)."""
    rows = picked(docs, id=id, text=text).select("id", sequence(F.coalesce("text", F.lit("")), sentences).alias("sentences"))
    return _ruled(rows, id, rules)


def scan_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", sentences: dict[str, str] = PUBLISHED, rules=PUBLISHED_RULES) -> DataFrame:
    """As `scan`, over the published texts in whatever lines."""
    rows = picked(docs, id=id, text=text).select("id", wrapped_sequence(F.coalesce("text", F.lit("")), sentences).alias("sentences"))
    return _ruled(rows, id, rules)


def _ruled(rows: DataFrame, id: str, rules) -> DataFrame:
    marked = F.array_join(F.transform("sentences", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    for ids, name in rules:  # a rule's licence stands as {name} where its identifiers stood
        marked = F.replace(marked, F.lit("".join(f"<{i}>" for i in ids)), F.lit("{" + name + "}"))
    found = rows.select("id", "sentences", marked.alias("marked"))
    return found.select(
        F.col("id").alias(id),
        "sentences",
        F.regexp_extract_all("marked", F.lit(r"\{([^}]*)\}"), 1).alias("licences"),
        F.regexp_extract_all("marked", F.lit("<([^>]*)>"), 1).alias("unmatched"),
    )


def _ruled_sql(rules) -> tuple[str, str]:
    """Marked identifiers with the licences that the rules put in their place; what is read off them."""
    marked = "coalesce(string_agg('<' || k.ident || '>', '' ORDER BY s.place), '')"
    for ids, name in rules:
        marked = f"replace({marked}, '{''.join(f'<{i}>' for i in ids)}', '{{{name}}}')"
    read = r"""SELECT doc_id, n_sentences, array_to_string(regexp_extract_all(marked, '\{([^}]*)\}', 1), ',') AS licences,
    array_to_string(regexp_extract_all(marked, '<([^>]*)>', 1), ',') AS unmatched
FROM marked"""
    return marked, read


def _known_sql(sentences: dict[str, str]) -> str:
    return ", ".join(f"('{normal_sentence(t)}', '{i}')" for i, t in sentences.items())


def scan_sql(sentences: dict[str, str] = SENTENCES, rules=RULES) -> str:
    """`scan` in the SQL of an independent engine: doc_id, n_sentences, licences, unmatched."""
    marked, read = _ruled_sql(rules)
    return rf"""
WITH known(sentence, ident) AS (VALUES {_known_sql(sentences)}),
cut AS (SELECT doc_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS place FROM (
    SELECT doc_id, regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '\n|[.!?]+[ \t\r\n]+') AS parts
    FROM documents)),
s AS (SELECT doc_id, place, trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) AS sentence FROM cut),
marked AS (SELECT s.doc_id, count(k.ident) AS n_sentences, {marked} AS marked
    FROM s LEFT JOIN known k ON s.sentence = k.sentence GROUP BY s.doc_id)
{read}"""


def scan_texts_sql(sentences: dict[str, str] = PUBLISHED, rules=PUBLISHED_RULES) -> str:
    """`scan_texts` likewise. Its patterns cannot look around, so that each break is two bars, one for either neighbour."""
    marked, read = _ruled_sql(rules)
    each = "|".join(s.replace(" ", r"(?: \| \|)? ") for s in sorted(map(normal_sentence, sentences.values()), key=len, reverse=True))
    return rf"""
WITH known(sentence, ident) AS (VALUES {_known_sql(sentences)}),
lowered AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}|', '{LOWER} ') || chr(10) AS t FROM documents),
barred AS (SELECT doc_id, '|' || replace(regexp_replace(t, '[.!?:;]+([ \t\r\n])', '|\1', 'g'), chr(10), '|') || '|' AS t FROM lowered),
words AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[^a-z0-9|]+', ' ', 'g'), ' ?\|[ |]*', ' | | ', 'g') AS t FROM barred),
found AS (SELECT doc_id, regexp_extract_all(t, '\| ({each}) \|', 1) AS parts FROM words),
s AS (SELECT doc_id, replace(unnest(parts), ' | |', '') AS sentence, unnest(range(1, len(parts) + 1)) AS place FROM found),
marked AS (SELECT doc_id, count(k.ident) AS n_sentences, {marked} AS marked
    FROM found LEFT JOIN s USING (doc_id) LEFT JOIN known k ON s.sentence = k.sentence GROUP BY doc_id)
{read}"""

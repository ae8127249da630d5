"""Licence scans by sentence rules.

A text is cut into sentences (wrapped lines of a paragraph are joined), each is
normalised (lower case, letters and digits only, single blanks), and the known
licence sentences that it is or carries are named by their ids. A known notice
right after a negation does not count. The ids of a text, in order, are then
matched against ordered rules: a rule holds where its sentences occur in that
order, with any other known sentences between them, and consumes them. So the
first and longest rule wins, and a text of three clauses is not also reported as
one of two.

Everything runs inside one projection over the scan: no shuffle, no join. A
cheap pattern test on the whole text comes first; it is implied by the sentence
table (every known sentence contains one of its words), so it skips work and
never a finding.

Edge cases: null and empty texts have no sentences and no licences. Very long
texts are read whole. A known sentence is named once for each sentence that holds
it; of a rule's several readings the leftmost and nearest is taken; a licence is
listed once per document. Repeated rows are scanned alike. Extra columns are
carried through, one named like a result is replaced. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: known licence sentences, normalised, by id
SENTENCES: dict[str, str] = {
    "mit-under": "under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache2-under": "under the apache license version 2 0",
    "apache2-title": "apache license version 2 0 january 2004",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl2-under": "under the gnu general public license version 2",
    "gpl2-free": "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
    "gpl2-only": "under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "gpl3-under": "under the gnu general public license version 3",
    "gpl3-free": "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "lgpl21-under": "under the gnu lesser general public license version 2 1",
    "lgpl21-free": "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-under": "under the gnu lesser general public license version 3",
    "lgpl3-free": "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl3-under": "under the gnu affero general public license version 3",
    "agpl3-free": "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "gpl-hope": "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse": "may be used to endorse or promote products derived from this software without specific prior written",
    "bsd2-under": "under the bsd 2 clause license",
    "bsd3-under": "under the bsd 3 clause license",
    "isc-under": "under the isc license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-under": "under the mozilla public license version 2 0",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v",
    "epl2-under": "under the terms of the eclipse public license 2 0",
    "epl2-under-v": "under the terms of the eclipse public license v2 0",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "boost-under": "under the boost software license version 1 0",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-origin": "the origin of this software must not be misrepresented",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "cc0-under": "under cc0 1 0",
    "cc0-title": "creative commons cc0 1 0 universal",
    "ccby4-under": "under cc by 4 0",
    "ccbysa4-under": "under cc by sa 4 0",
    "ccbync4-under": "under cc by nc 4 0",
    "ccbynd4-under": "under cc by nd 4 0",
    "ccbyncsa4-under": "under cc by nc sa 4 0",
    "ccbyncnd4-under": "under cc by nc nd 4 0",
    "ccby4-work": "under a creative commons attribution 4 0 international license",
    "ccbysa4-work": "under a creative commons attribution sharealike 4 0 international license",
    "ccbync4-work": "under a creative commons attribution noncommercial 4 0 international license",
    "ccbynd4-work": "under a creative commons attribution noderivatives 4 0 international license",
    "ccbyncsa4-work": "under a creative commons attribution noncommercial sharealike 4 0 international license",
}

#: Ordered rules: (licence, sentence ids in order); longer ones of a family come first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("bsd2-under",)),
    ("BSD-3-Clause", ("bsd3-under",)),
    ("MIT", ("mit-under", "mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-under",)),
    ("Apache-2.0", ("apache2-under", "apache-compliance", "apache-copy", "apache-basis")),
    ("Apache-2.0", ("apache-compliance", "apache-copy", "apache-basis")),
    ("Apache-2.0", ("apache2-title",)),
    ("Apache-2.0", ("apache2-under",)),
    ("LGPL-2.1", ("lgpl21-free", "gpl-hope")),
    ("LGPL-2.1", ("lgpl21-free",)),
    ("LGPL-2.1", ("lgpl21-title",)),
    ("LGPL-2.1", ("lgpl21-under",)),
    ("LGPL-3.0", ("lgpl3-free", "gpl-hope")),
    ("LGPL-3.0", ("lgpl3-free",)),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("LGPL-3.0", ("lgpl3-under",)),
    ("AGPL-3.0", ("agpl3-free", "gpl-hope")),
    ("AGPL-3.0", ("agpl3-free",)),
    ("AGPL-3.0", ("agpl3-title",)),
    ("AGPL-3.0", ("agpl3-under",)),
    ("GPL-2.0", ("gpl2-free", "gpl-hope")),
    ("GPL-2.0", ("gpl2-free",)),
    ("GPL-2.0", ("gpl2-only",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("GPL-2.0", ("gpl2-under",)),
    ("GPL-3.0", ("gpl3-free", "gpl-hope")),
    ("GPL-3.0", ("gpl3-free",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("GPL-3.0", ("gpl3-under",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-under",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("MPL-2.0", ("mpl2-under",)),
    ("EPL-2.0", ("epl2-under",)),
    ("EPL-2.0", ("epl2-under-v",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-under",)),
    ("Zlib", ("zlib-warranty", "zlib-origin")),
    ("Unlicense", ("unlicense-free",)),
    ("CC0-1.0", ("cc0-under",)),
    ("CC0-1.0", ("cc0-title",)),
    ("CC-BY-4.0", ("ccby4-under",)),
    ("CC-BY-4.0", ("ccby4-work",)),
    ("CC-BY-SA-4.0", ("ccbysa4-under",)),
    ("CC-BY-SA-4.0", ("ccbysa4-work",)),
    ("CC-BY-NC-4.0", ("ccbync4-under",)),
    ("CC-BY-NC-4.0", ("ccbync4-work",)),
    ("CC-BY-ND-4.0", ("ccbynd4-under",)),
    ("CC-BY-ND-4.0", ("ccbynd4-work",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa4-under",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa4-work",)),
    ("CC-BY-NC-ND-4.0", ("ccbyncnd4-under",)),
)

# an identifier line is a sentence of its own for each licence that the rules name
_NAMES = sorted({name for name, _ in RULES})
SENTENCES |= {f"spdx-{name}": "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower()) for name in _NAMES}
RULES += tuple((name, (f"spdx-{name}",)) for name in _NAMES)

#: A sentence ends at these signs before white space or the end, and at a blank line.
ENDS = r"(?<=[.!?])\s+|\n\s*\n"
#: A notice in these words is none: the first sign of it is taken out.
NEGATED = r"(^| )(not|never) ([^ ]+ )?under "


def anchor_pattern(sentences: Mapping[str, str]) -> str:
    """A pattern that every text with a known sentence matches.

    Greedily chosen long words such that each sentence contains at least one;
    sentences without one stand whole, with any signs between their words.
    """
    gap = r"[^\p{L}\p{N}]+"
    left, words = dict(sentences), []
    while left:
        count: dict[str, int] = {}
        for s in left.values():
            for w in set(s.split()):
                if len(w) >= 6:
                    count[w] = count.get(w, 0) + 1
        if not count:
            words += [gap.join(s.split()) for s in left.values()]
            break
        best = max(sorted(count), key=lambda w: (count[w], len(w)))
        words.append(best)
        left = {k: s for k, s in left.items() if best not in s.split()}
    return "(?i)" + "|".join(words) if words else ""


def normalise(sentence: Column) -> Column:
    """Lower case, every run of other signs than letters and digits one blank, negated notices broken."""
    clean = F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(clean, NEGATED, "$1$2 ")


def _ids(text: Column, sentences: Mapping[str, str]) -> Column:
    """Ids of the known sentences that each sentence is or carries, in text order."""
    known = sorted(set(sentences.values()), key=lambda s: (-len(s), s))
    named = F.create_map(*[F.lit(x) for s in known for x in (s, next(k for k, v in sentences.items() if v == s))])
    # a look ahead at each word, so that sentences which share words are both seen
    pattern = F.lit(f"(?<![^ ])(?=({'|'.join(known)})(?![^ ]))")
    found = F.transform(F.split(text, ENDS), lambda s: F.array_distinct(F.regexp_extract_all(normalise(s), pattern, F.lit(1))))
    return F.transform(F.flatten(found), lambda s: F.element_at(named, s))


def _licences(ids: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Names of the rules that hold, each consuming its sentences before the next is tried."""

    def rule(name: str, wanted: Sequence[str]) -> Column:
        pattern = "(.*?)".join(rf"\|{re.escape(x)}\|" for x in wanted)
        between = "".join(f"${i}" for i in range(1, len(wanted)))
        return F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("pattern"), F.lit(between).alias("between"))

    seq = F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|"))
    start = F.struct(seq.alias("seq"), F.array().cast("array<string>").alias("names"))

    def step(s: Column, r: Column) -> Column:
        holds = F.regexp_like(s["seq"], r["pattern"])
        return F.when(holds, F.struct(F.regexp_replace(s["seq"], r["pattern"], r["between"]).alias("seq"), F.array_append(s["names"], r["name"]).alias("names"))).otherwise(s)

    return F.array_sort(F.array_distinct(F.aggregate(F.array(*[rule(*r) for r in rules]), start, step, lambda s: s["names"])))


def scan(docs: DataFrame, *, text: str = "text", sentences: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> DataFrame:
    """``docs`` with ``sentence_ids`` (in text order) and ``licences`` (sorted, distinct)."""
    x = F.coalesce(F.col(text), F.lit(""))
    wanted = anchor_pattern(sentences)
    some = x.rlike(wanted) if wanted else F.lit(False)
    none = F.array().cast("array<string>")
    out = docs.withColumn("sentence_ids", F.when(some, _ids(x, sentences)).otherwise(none) if sentences else none)
    return out.withColumn("licences", F.when(F.size("sentence_ids") > 0, _licences(F.col("sentence_ids"), rules)).otherwise(none) if rules else none)

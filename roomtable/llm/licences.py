"""Licence scans by patience alignment of texts with licence templates."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from roomtable.llm.shared import whole_text, words_of

#: Share of a template's words that must align.
COVERAGE = 0.8
#: Words from the first to the last aligned one, at most, as a multiple of the template's.
SPAN = 1.25

# Public licence notices, as their authors ask to have them written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."
    ),
    "GPL-2.0 header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1 header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "https://www.boost.org/LICENSE_1_0.txt)"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense use": (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or otherwise, and by any means"
    ),
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "BSD-3-Clause names": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
}

_FOUND = ArrayType(
    StructType([StructField("licence", StringType()), StructField("coverage", DoubleType()), StructField("first_word", LongType()), StructField("last_word", LongType())])
)
# Words that tell licences apart; those of a template must all align.
_NAMES = frozenset(
    b"apache mit bsd isc zlib mozilla mpl eclipse epl boost artistic unlicense gnu general gpl lgpl agpl lesser library affero creative commons cc cc0 attribution "
    b"attribution-sharealike attribution-noncommercial attribution-noderivatives attribution-noncommercial-sharealike attribution-noncommercial-noderivatives ofl sil "
    b"by by-nc by-sa by-nd by-nc-sa by-nc-nd nc sa nd noncommercial non-commercial sharealike share-alike noderivatives noderivs no-derivatives".split()
)
# Words that make another licence of the one named, by a word of its name.
_OTHERWISE = {
    b"gnu": frozenset(b"lesser library affero".split()),
    b"mit": frozenset((b"no", b"no-attribution", b"attribution", b"bsd")),
    b"bsd": frozenset((b"mit",)),
    **dict.fromkeys(
        (b"attribution", b"by", b"by-nc", b"by-sa"),
        frozenset(
            b"nc sa nd noncommercial non-commercial commercial sharealike share-alike share noderivatives noderivs no-derivatives noderivative derivatives "
            b"nc-sa nc-nd noncommercial-sharealike noncommercial-noderivatives".split()
        ),
    ),
}
#: A version, with what its number is.
_VERSION = re.compile(rb"v?([0-9]{1,2}(?:\.[0-9]+)*?)(?:\.0)*\+?")
_SAYS = re.compile(rb"[0-9a-z\x80-\xff]")
_EDGE = b".,;:()\"'!?$%&*#|<>[]{}-"


def licence_words(text: str) -> list[bytes]:
    """Words, A-Z lower-cased, without marks at their ends; a word of marks alone stays empty."""
    return [w.strip(_EDGE) for w in words_of(text.lower())]


def _numbered(word: bytes) -> bytes:
    """The word, or the bare number of a version: 3 for v3 and 3.0."""
    number = _VERSION.fullmatch(word) if word[:1].isdigit() or word[:1] == b"v" else None
    return number[1] if number else word


def _telling(template: tuple[bytes, ...]) -> frozenset[int]:
    """Places of a template's words that tell it from other licences: names and versions."""
    named = any(w in _NAMES for w in template)
    return frozenset(j for j, w in enumerate(template) if w in _NAMES or named and _VERSION.fullmatch(w))


def _anchors(a: list[bytes], b: list[bytes], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Pairs of words unique in both ranges, in the longest increasing order."""
    once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    at_b = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
    pairs = [(i, at_b[w]) for i, w in enumerate(a[a0:a1], a0) if w and once_a[w] == 1 and w in at_b]
    ends: list[int] = []
    tops: list[int] = []
    behind: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        behind.append(tops[at - 1] if at else -1)
        if at == len(ends):
            ends.append(j)
            tops.append(k)
        else:
            ends[at], tops[at] = j, k
    chain, k = [], tops[-1] if tops else -1
    while k >= 0:
        chain.append(pairs[k])
        k = behind[k]
    return chain[::-1]


def _longest(a: list[bytes], b: list[bytes], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence of two ranges."""
    own, theirs = set(a[a0:a1]), set(b[b0:b1])
    left = [i for i in range(a0, a1) if a[i] in theirs]
    right = [j for j in range(b0, b1) if b[j] in own]
    rows = [[0] * (len(right) + 1)]
    for i in left:
        row = [0]
        for k, j in enumerate(right):
            row.append(rows[-1][k] + 1 if a[i] == b[j] else max(rows[-1][k + 1], row[k]))
        rows.append(row)
    pairs, n, k = [], len(left), len(right)
    while n and k:
        if a[left[n - 1]] == b[right[k - 1]]:
            n, k = n - 1, k - 1
            pairs.append((left[n], right[k]))
        elif rows[n - 1][k] >= rows[n][k - 1]:
            n -= 1
        else:
            k -= 1
    return pairs[::-1]


def aligned(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Patience alignment: pairs (i, j) of equal words, increasing in both.

    Words unique to both sides anchor the alignment; each gap between anchors is aligned
    by itself, where other words may be unique. Equal words at both ends of a gap are
    taken first. A gap without common unique words takes a longest common subsequence.
    """
    found, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        chain = _anchors(a, b, a0, a1, b0, b1)
        if not chain:
            found += _longest(a, b, a0, a1, b0, b1)
            continue
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        found += chain
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


@dataclass(frozen=True)
class Scanner:
    """Templates as words, with the words that each has once."""

    templates: tuple[tuple[str, tuple[bytes, ...]], ...]
    coverage: float

    @staticmethod
    def of(templates: dict[str, str], coverage: float = COVERAGE) -> Scanner:
        cut = ((name, tuple(_numbered(w) for w in licence_words(t) if _SAYS.search(w))) for name, t in sorted(templates.items()))
        return Scanner(tuple((name, words) for name, words in cut if words), coverage)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, coverage, first word, last word) of each template that the text covers well enough.

        A copy leaves few of a template's words out, so it has one of any `missing + 1`.
        Every place of the rarest of them in the text is held against the template with that
        word fixed, as far as SPAN reaches, so each copy is aligned by itself. Names and
        versions must all align, without a word between that makes another licence of it.
        """
        words = licence_words(text)
        present = set(map(_numbered, set(words)))
        fitting = [(name, template) for name, template in self.templates if sum(w in present for w in template) >= self.coverage * len(template)]
        if not fitting:
            return []
        at = [i for i, w in enumerate(words) if _SAYS.search(w)]
        words = [_numbered(words[i]) for i in at]
        places: dict[bytes, list[int]] = {w: [] for _, template in fitting for w in template}
        for i, w in enumerate(words):
            if w in places:
                places[w].append(i)
        found = []
        for name, template in fitting:
            copy = self._best(words, places, template)
            if copy:
                found.append((name, len(copy) / len(template), at[copy[0][0]], at[copy[-1][0]]))
        return found

    def _best(self, words: list[bytes], places: dict[bytes, list[int]], template: tuple[bytes, ...]) -> list[tuple[int, int]]:
        """The aligned pairs of the copy that covers most of the template, the first in a tie; none below the coverage."""
        size, wanted, own = len(template), Counter(template), list(template)
        need = self.coverage * size
        spare = int(SPAN * size) - size
        telling = _telling(template)
        otherwise = frozenset().union(*(_OTHERWISE.get(template[j], ()) for j in telling)) - wanted.keys()
        rare = lambda j: (len(places[template[j]]), j)
        order = [min(telling, key=rare)] if telling else sorted(range(size), key=rare)[: size - math.ceil(need - 1e-9) + 1]
        best: list[tuple[int, int]] = []
        for j in order:
            for i in places[template[j]]:
                low = max(0, i - j - spare)
                left, right = words[low:i], words[i + 1 : i + size - j + spare]
                if sum((Counter(w for w in (*left, words[i], *right) if w in wanted) & wanted).values()) < need:
                    continue
                pairs = [(low + x, y) for x, y in aligned(left, own[:j])] + [(i, j)] + [(i + 1 + x, j + 1 + y) for x, y in aligned(right, own[j + 1 :])]
                pairs = _within(pairs, size + spare)
                if not telling <= {y for _, y in pairs} or otherwise and _changed(words, pairs, telling, otherwise):
                    continue
                if len(pairs) >= need and (not best or (-len(pairs), pairs[0][0]) < (-len(best), best[0][0])):
                    best = pairs
        return best


def _changed(words: list[bytes], pairs: list[tuple[int, int]], telling: frozenset[int], otherwise: frozenset[bytes]) -> bool:
    """Whether a word of `otherwise` stands from the licence's name to the end of the copy, or next to it."""
    first = min(x for x, y in pairs if y in telling)
    last = max(pairs[-1][0], max(x for x, y in pairs if y in telling) + 1)
    return any(w in otherwise for w in words[first : last + 1])


def _within(pairs: list[tuple[int, int]], span: int) -> list[tuple[int, int]]:
    """The pairs without those at the looser end, until `span` words hold them."""
    while pairs[-1][0] - pairs[0][0] >= span:
        pairs = pairs[1:] if pairs[1][0] - pairs[0][0] >= pairs[-1][0] - pairs[-2][0] else pairs[:-1]
    return pairs


def licences(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, nth, licence, coverage, first_word, last_word, n_licences): every licence of every row.

    The licences of a text are numbered from 1 by their aligned words, most first; ties go to
    the first name. Each comes with its best copy. Texts without a licence, null and empty ones, have one row of nulls and n_licences 0. A null
    doc_id stays null, repeated rows stay repeated, other columns are not read. The whole
    text is searched, so memory follows the words of one text. Words of marks alone count
    as places but not in the span.
    """
    scanner = Scanner.of(templates or TEMPLATES, coverage)
    sizes = {name: len(words) for name, words in scanner.templates}

    def search(texts: pd.Series) -> pd.Series:
        rows = []
        for text in texts:
            found = sorted(scanner.scan(text), key=lambda x: (-x[1] * sizes[x[0]], x[0]))
            rows.append([dict(zip(("licence", "coverage", "first_word", "last_word"), x, strict=True)) for x in found])
        return pd.Series(rows, dtype=object)

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from map(search, parts)

    found = docs.select("doc_id", F.pandas_udf(batches, _FOUND)(whole_text()).alias("found"))
    each = found.select("doc_id", F.size("found").alias("n_licences"), F.posexplode_outer("found").alias("at", "one"))
    return each.select("doc_id", (F.col("at") + 1).alias("nth"), "one.licence", "one.coverage", "one.first_word", "one.last_word", "n_licences")

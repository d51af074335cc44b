"""License scans: exact phrases, and an exact set-similarity join of text blocks with license notices.

A template is the whole notice of a public license, with the phrases that name its kind and version: those are words that
the notices of its relatives don't have in a row, so none of these is taken for it. It matches a block if the block has
at least THRESHOLD of the template's distinct words, and all naming phrases. Blocks of a
template of m words are BLOCK * m words long and start every (BLOCK - 1) * m words, so any m words in a row lie
within one block; a text's last block may be shorter. The join on a template's n distinct words is exact by three
filters:

- prefix: template words are ordered by how many documents have them, rarest first. A block with `need` of n
  words has one of the first n - need + 1, so only blocks around such words are looked at;
- length: a block with fewer than `need` distinct words can't match;
- position: after the template's i-th word at most n - i - 1 more can match, so counting stops early.

Document frequencies are those of the template words over the whole table. The templates are a parameter of
fixed size, so they and their frequencies go to every task.

Defined cases: a null or empty text has no words, places or labels, and score 0. Null and repeated ids are
rows like any other. Without documents the templates keep alphabetic order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, BLOCK = 0.8, 2

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices of public licenses, and for each the words in a row that a block must have to be of that license.
_GNU = """
    This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} Public
    License as published by the Free Software Foundation; either {version} of the License, or (at your option) any later
    version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
    implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for
    more details. You should have received a copy of the GNU {name} Public License along with this program."""
_NO_WARRANTY = """
    THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
    THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
    AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
    TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
    SOFTWARE."""
_ISC_WARRANTY = """
    THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
    IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
    INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
    AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
    PERFORMANCE OF THIS SOFTWARE."""
_BSD = """
    Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
    of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
    notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
    with the distribution."""
TEMPLATES = {
    "gpl-2.0": (_GNU.format(name="General", version="version 2"), ("terms of the gnu general public license", "version 2 of the license")),
    "gpl-3.0": (_GNU.format(name="General", version="version 3"), ("terms of the gnu general public license", "version 3 of the license")),
    "lgpl-2.1": (_GNU.format(name="Lesser General", version="version 2.1"), ("terms of the gnu lesser general public license", "version 2 1 of the license")),
    "lgpl-3.0": (_GNU.format(name="Lesser General", version="version 3"), ("terms of the gnu lesser general public license", "version 3 of the license")),
    "agpl-3.0": (_GNU.format(name="Affero General", version="version 3"), ("terms of the gnu affero general public license", "version 3 of the license")),
    "apache-2.0": (
        """
    Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
    the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
    applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
    WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
    governing permissions and limitations under the License.""",
        ("apache license version 2",),
    ),
    "mpl-2.0": (
        """
    This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        ("terms of the mozilla public license v 2 0",),
    ),
    "mit": (
        """
    Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
    rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
    permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
    notice and this permission notice shall be included in all copies or substantial portions of the Software."""
        + _NO_WARRANTY,
        ("permission is hereby granted free of charge to any person obtaining",),
    ),
    "bsl-1.0": (
        """
    Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
    accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,
    and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
    Software is furnished to do so, all subject to the following:""",
        ("free of charge to any person or organization obtaining a copy of the software",),
    ),
    "isc": (
        """
    Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted, provided that the above copyright notice and this permission notice appear in all copies."""
        + _ISC_WARRANTY,
        ("for any purpose with or without fee is hereby granted provided that the above copyright notice",),
    ),
    "0bsd": (
        """
    Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted."""
        + _ISC_WARRANTY,
        ("for any purpose with or without fee is hereby granted the software is provided",),
    ),
    "bsd-2-clause": (_BSD, ("redistribution and use in source and binary forms", "with the distribution this software is provided by")),
    "bsd-3-clause": (
        _BSD
        + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
    promote products derived from this software without specific prior written permission.""",
        ("redistribution and use in source and binary forms", "may be used to endorse or promote products derived from this software"),
    ),
    "unlicense": (
        """
    This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
    use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
    purpose, commercial or non-commercial, and by any means.""",
        ("free and unencumbered software released into the public domain",),
    ),
}

# Fixed value: ASCII upper case to lower case, other ASCII characters than letters and digits to spaces.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    """label, the distinct words, rarest first, how many words there are in all, and the naming phrases."""

    label: str
    words: tuple[bytes, ...]
    length: int
    names: tuple[tuple[bytes, ...], ...] = ()

    @property
    def need(self) -> int:
        return math.ceil(THRESHOLD * len(self.words) - 1e-9)

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.words[: len(self.words) - self.need + 1]


def document_frequencies(docs: DataFrame, wanted: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each of the wanted words is; each task counts its own first."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = dict.fromkeys(wanted, 0)
        for batch in batches:
            for text in batch["text"]:
                for word in wanted.intersection(words_of(text)):
                    found[word] += 1
        yield pd.DataFrame({"word": [w.decode() for w in found], "n": list(found.values())})

    counted = docs.select("text").mapInPandas(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in counted.collect()}


def ordered_templates(docs: DataFrame, templates: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> list[Template]:
    named = {label: (words_of(text), tuple(tuple(words_of(x)) for x in names)) for label, (text, names) in (templates or TEMPLATES).items()}
    count = document_frequencies(docs, frozenset().union(*(words for words, _ in named.values())))
    return [Template(label, tuple(sorted(set(words), key=lambda w: (count.get(w, 0), w))), len(words), names) for label, (words, names) in named.items() if words]


def overlap(template: Template, block: frozenset[bytes]) -> int:
    """Template words in the block, or 0 if they can't reach what is needed."""
    n, need, found = len(template.words), template.need, 0
    if len(block) < need:
        return 0
    for i, word in enumerate(template.words):
        found += word in block
        if found + n - i - 1 < need:
            return 0
    return found


def stands(words: list[bytes], phrase: tuple[bytes, ...]) -> bool:
    """Whether the phrase's words stand consecutively somewhere."""
    return not phrase or any(tuple(words[i : i + len(phrase)]) == phrase for i, w in enumerate(words) if w == phrase[0])


def matches(words: list[bytes], templates: list[Template]) -> dict[str, float]:
    """Label to the best containment over the text's blocks, for templates that some block matches."""
    there, found = frozenset(words), {}
    for t in templates:
        rare = there.intersection(t.prefix)
        if not rare or len(there.intersection(t.words)) < t.need or not all(stands(words, name) for name in t.names):
            continue
        length, step = BLOCK * t.length, (BLOCK - 1) * t.length
        blocks = {b for i, w in enumerate(words) if w in rare for b in range(max(0, -(-(i - length + 1) // step)), i // step + 1)}
        best = 0
        for part in (words[b * step : b * step + length] for b in blocks):
            n = overlap(t, frozenset(part))
            if n > best and all(stands(part, name) for name in t.names):
                best = n
        if best:
            found[t.label] = best / len(t.words)
    return found


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively."""
    there, found = frozenset(words), []
    for phrase, label in phrases.items():
        parts = phrase.encode().split()
        if there.issuperset(parts):
            i = -1
            while True:
                try:
                    i = words.index(parts[0], i + 1)
                except ValueError:
                    break
                if words[i : i + len(parts)] == parts:
                    found.append((i, label))
    return found


SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_text(text: str | None, templates: list[Template], phrases: dict[str, str] = PHRASES) -> tuple:
    """The row of SCAN of a text; a phrase scores 1, a template what the best block has of it."""
    words = words_of(text)
    places, like = phrase_places(words, phrases), matches(words, templates)
    base = {label for _, label in places}
    starts = [i for i, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base.union(like))), 1.0 if base else max(like.values(), default=0.0),
    )


def scan_column(text: Column, templates: list[Template]) -> Column:
    @F.pandas_udf(SCAN)
    def scan(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([scan_text(t, templates) for t in texts], columns=[c.split()[0] for c in SCAN.split(", ")])
        return found.astype({"first_word": "Int64", "last_word": "Int64"})

    return scan(text)


def license_report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return docs.select("doc_id", scan_column(F.col("text"), ordered_templates(docs)).alias("s")).select("doc_id", "s.*")

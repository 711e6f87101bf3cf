"""Licence scans: normalised text against licence templates by Dice over word bigrams.

Text and templates are lower-cased and cut into words of letters and digits.
A segment is the whole text or any run of its consecutive lines (a line is also
cut at sentence ends). Dice of a segment and a template is twice the bigrams
they share, as multisets, over the bigrams of both. It can reach the threshold
t only if the sizes' ratio is within t / (2 - t) and its inverse; those bounds
prune templates for a segment and end the growth of a run. A run starts and
ends at lines that share a bigram with a template, in them or across their ends.

Whole licence texts (files in ``license_texts``) and source headers go first:
what they cover is not matched with the short notices again. A text that has
not enough of a template's bigrams in all is not searched for it.

Defined results: null text counts as empty and has no licence; texts of fewer
than two words have no bigrams and match nothing; of equal scores the shorter
segment, then the earlier, then the template first in order wins; repeated rows
give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import pkgutil
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

THRESHOLD = 0.75

# Short notices by which texts name their licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LicenseRef-reserved", "All rights reserved."),
)

FILES = ("Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GFDL-1.3", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Zlib")

_GNU = (
    "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. "
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. "
    "You should have received a copy of the GNU {kind}General Public License along with this {what}."
)
HEADERS = (
    ("GPL-2.0", _GNU.format(what="program", kind="", version="2")),
    ("GPL-3.0", _GNU.format(what="program", kind="", version="3")),
    ("LGPL-2.1", _GNU.format(what="library", kind="Lesser ", version="2.1")),
    ("LGPL-3.0", _GNU.format(what="library", kind="Lesser ", version="3")),
    ("AGPL-3.0", _GNU.format(what="program", kind="Affero ", version="3")),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)

_WORD = re.compile(r"[^\W_]+")
_UNIT = re.compile(r"\n+|(?<=[.!?;])\s+(?=[^\W\d_])")


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


@lru_cache(maxsize=8)
def _prepared(templates) -> tuple[list[tuple[str, Counter, int]], frozenset]:
    made = [(name, Counter(b := bigrams(_WORD.findall(text.lower()))), len(b)) for name, text in templates]
    return made, frozenset(g for _, c, _ in made for g in c)


def dice(one: Counter, n1: int, two: Counter, n2: int) -> float:
    return 2 * sum(min(n, one[g]) for g, n in two.items() if g in one) / (n1 + n2)


@lru_cache(maxsize=1)
def _whole() -> tuple[list[tuple[str, Counter, int, frozenset]], frozenset]:
    """Licence texts and headers: name, bigrams, their number, the first ones; and all bigrams."""
    texts = [(name, pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()) for name in FILES]
    apache, gpl = dict(texts)["Apache-2.0"], dict(texts)["GPL-3.0"]
    texts.append(("Apache-2.0", apache[: apache.index("END OF TERMS AND CONDITIONS")]))
    texts += [(name, t[: t.index("END OF TERMS AND CONDITIONS")]) for name, t in texts if name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1")]
    # Its text differs from the GPL's in the name, the preamble and section 13.
    texts.append(("AGPL-3.0", re.sub(r"(?i)GNU General(?= Public License)", "GNU Affero General", gpl)))
    made = []
    for name, text in (*texts, *HEADERS):
        b = bigrams(_WORD.findall(text.lower()))
        made.append((name, Counter(b), len(b), frozenset(b[:10])))
    return made, frozenset(g for _, c, _, _ in made for g in c)


def _whole_matches(lines: list[list[str]], threshold: float) -> list[tuple[float, int, int, int, int, str]]:
    made, known = _whole()
    low = threshold / (2 - threshold)
    last, new = [], []  # new[k]: the bigrams that line k adds
    for words in lines:
        new.append(bigrams(last + words))
        last = words[-1:]
    every = [g for gs in new for g in gs if g in known]
    if len(every) < low * min(n for _, _, n, _ in made):
        return []
    counts, found = Counter(every), []
    for order, (name, template, n, opening) in enumerate(made):
        # Dice t needs t / 2 of both sizes in common, and a size of low * n at least.
        if len(every) < low * n or sum(min(c, counts[g]) for g, c in template.items() if g in counts) < threshold / 2 * (1 + low) * n - 1:
            continue
        share = [sum(g in template for g in gs) / len(gs) if gs else 0.0 for gs in new]
        all_starts = [i for i in range(len(lines)) if share[i]]
        likely = [i for i in all_starts if i == 0 or share[i - 1] < 0.5 or not opening.isdisjoint(new[i])]
        here: list = []
        for starts in (likely, all_starts):
            for i in starts:
                seen: Counter = Counter()
                size = common = 0
                for j in range(i, len(lines)):
                    added = new[j] if j > i else bigrams(lines[j])
                    size += len(added)
                    if size > n / low:
                        break
                    for g in added:
                        if g in template:
                            seen[g] += 1
                            common += seen[g] <= template[g]
                    if 2 * common >= threshold * (size + n):
                        here.append((-2 * common / (size + n), size, i, order, j, name))
            if here:
                break
        found += here
    return found


def matches(text: str, templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """(first unit, last unit, licence, Dice) of the segments that match, best first within a stretch, in text order.

    Overlapping segments count once, for the best of them.
    """
    made, known = _prepared(templates)
    widest = max(n for _, _, n in made) * (2 - threshold) / threshold
    low = threshold / (2 - threshold)
    lines = [_WORD.findall(line) for line in _UNIT.split(text.lower())]
    lines = [words for words in lines if words]
    inside = [any(g in known for g in zip(words, words[1:])) for words in lines]
    across = [(a[-1], b[0]) in known for a, b in zip(lines, lines[1:])]  # from a line to the next
    taken, out = set(), []
    whole = _whole_matches(lines, threshold) if templates is TEMPLATES else []
    starts = [i for i, hit in enumerate(inside) if hit or i < len(across) and across[i]]
    found = []
    for i in starts:
        words: list[str] = []
        counts: Counter = Counter()
        size = 0
        for j in range(i, len(lines)):
            new = bigrams(words[-1:] + lines[j])
            size += len(new)
            if j > i and size > widest:
                break
            counts.update(new)
            words = lines[j]
            if j > i and not inside[j] and not across[j - 1]:
                continue
            for order, (name, template, n) in enumerate(made):
                if n and size and low <= size / n <= 1 / low:
                    d = dice(counts, size, template, n)
                    if d >= threshold:
                        found.append((-d, size, i, order, j, name))
    # A whole text before its notices; of whole texts the better, as they hold one another's headers.
    for d, _, i, _, j, name in [*sorted(whole, key=lambda m: (-round(-m[0] * m[1]), m)), *sorted(found)]:
        if taken.isdisjoint(range(i, j + 1)):
            taken.update(range(i, j + 1))
            out.append((i, j, name, -d))
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
            found = [matches(t.as_py()) for t in part.column(1)]
            best = [max(f, key=lambda m: (m[3], -m[0]), default=(0, 0, None, 0.0)) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([b[2] for b in best], pa.string()), pa.array([b[3] for b in best], pa.float64()), pa.array([len(f) for f in found], pa.int64()),
                    pa.array([",".join(f"{name}:{i}:{j}:{d:.4f}" for i, j, name, d in f) for f in found], pa.string()),
                ],
                ["doc_id", "license", "dice", "n_matches", "matches"],
            )


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, license (the best match's, else null), dice, n_matches, matches (licence, first and last unit, Dice)."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(_scan, "doc_id bigint, license string, dice double, n_matches bigint, matches string")

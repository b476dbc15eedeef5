"""License scans by conditional compression.

Blocks of words are placed where a template shares pairs of words with what lies
within REACH of a license cue, whatever the line breaks; places that overlap are
one block. Every block is compressed once plainly and once with each template as
a zstandard raw-content dictionary. All (block, template) are ranked by the bytes
that the template saves. In that order a winner is confirmed by its wording: the
longest runs of words that both have, in order. What a confirmed notice leaves
of a block is ranked again, so all notices that don't overlap are returned, with
their exact differences: the words of the template that the notice lacks and the
words that it has in their place.

Cases: null and empty texts have no notices; texts are read whole; of templates
that save equally much the first by name goes first, and of equal places the
earlier one; repeated rows each have their result; an empty table gives an empty
result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import difflib
import functools
import heapq
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import texts_of

#: Where a notice may be. Java and Python read it alike.
CUE = r"(?i)licen[cs]e|copyright|warranty|redistribut|permission is hereby|spdx|all rights reserved|public domain|creative commons"
#: Characters on either side of a cue, more than twice the longest template's.
REACH = 1500
#: The share of a notice's bytes a template must save, the share of words alike, the share of a template's word pairs that make a place worth comparing, and the bytes that a template must save of a block.
MIN_SAVED, MIN_ALIKE, MIN_PAIRS, MIN_BYTES = 0.25, 0.8, 0.2, 6

# Public license notices.
TEMPLATES: dict[str, str] = {
    "MIT-short": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-short": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-3.0-short": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-short": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-short": "Use of this source code is governed by a BSD-style license.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work and dedicated it to the public domain under CC0 1.0 Universal.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MIT-warranty": "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "All-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
}

# Ids that a file's SPDX line may name.
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")
TEMPLATES |= {f"SPDX-{x}": f"SPDX-License-Identifier: {x}" for x in SPDX}

RESULT = "doc_id long, block int, start int, stop int, license_id string, plain_bytes int, template_bytes int, saved double, alike double, lacks string, adds string"


WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


@functools.cache
def pairs_of_templates() -> dict[tuple[str, str], list[tuple[str, int]]]:
    """For each two words in a row the templates and places that have them."""
    found: dict[tuple[str, str], list[tuple[str, int]]] = {}
    for name, template in TEMPLATES.items():
        for i, pair in enumerate(itertools.pairwise(words_of(template))):
            found.setdefault(pair, []).append((name, i))
    return found


LEVEL = 9


@functools.cache
def compressors() -> dict[str, tuple]:
    """For each template a compressor that has its words as raw dictionary, and the words; "" has none."""
    import zstandard as z

    made = {"": (z.ZstdCompressor(level=LEVEL, write_content_size=False), [])}
    for name, template in TEMPLATES.items():
        words = words_of(template)
        raw = z.ZstdCompressionDict(" ".join(words).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        made[name] = (z.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False), words)
    return made


def size(words: list[str], name: str = "") -> int:
    """Bytes of these words, compressed with a template or plainly."""
    return len(compressors()[name][0].compress(" ".join(words).encode()))


def ranked(words: list[str]) -> list[tuple[int, str]]:
    """(minus the bytes saved, template) of every template that saves enough of these words, the one that saves most first."""
    plain = size(words)
    return sorted((n - plain, name) for name in TEMPLATES if plain - (n := size(words, name)) >= MIN_BYTES)


def regions(text: str, cue: re.Pattern) -> Iterator[tuple[int, int]]:
    """(start, stop) of what lies within REACH of cues, overlapping ones as one."""
    start = stop = -1
    for m in cue.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if stop >= 0 and a <= stop:
            stop = b
            continue
        if stop >= 0:
            yield start, stop
        start, stop = a, b
    if stop >= 0:
        yield start, stop


def best_match(theirs: list[str], mine: list[str]) -> tuple[float, list] | None:
    """(likeness, matching runs) of a template in these words, without runs at the ends that make it less alike."""
    match = [m for m in difflib.SequenceMatcher(None, theirs, mine, autojunk=False).get_matching_blocks() if m.size]

    def alike(runs: list) -> float:
        return 2 * sum(m.size for m in runs) / (len(theirs) + runs[-1].b + runs[-1].size - runs[0].b)

    while len(match) > 1:
        shorter = max(match[1:], match[:-1], key=alike)
        if alike(shorter) <= alike(match):
            break
        match = shorter
    return (alike(match), match) if match else None


def places(words: list[str]) -> dict[str, list[tuple[int, int]]]:
    """For each template the stretches (low, high) of words where it may be, with room on both sides."""
    offsets: dict[str, list[int]] = {}
    pairs = pairs_of_templates()
    for i, pair in enumerate(itertools.pairwise(words)):
        for name, at in pairs.get(pair, ()):
            offsets.setdefault(name, []).append(i - at)
    out: dict[str, list[tuple[int, int]]] = {}
    for name, found in offsets.items():
        n = len(compressors()[name][1])
        slack, least = n // 4 + 3, MIN_PAIRS * (n - 1)
        found.sort()
        cuts = [0, *[i for i in range(1, len(found)) if found[i] - found[i - 1] > slack], len(found)]
        for a, b in itertools.pairwise(cuts):
            if b - a >= least:
                out.setdefault(name, []).append((max(0, found[a] - slack), min(len(words), found[b - 1] + n + slack)))
    return out


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that overlap as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(stretches):
        if out and low < out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def confirmed(name: str, words: list[str], low: int, high: int, own: list[tuple[int, int]]) -> tuple[float, list, int] | None:
    """(likeness, matching runs, first word) of a template in a block, where its wording is alike enough and saves enough; own: the places found for it."""
    theirs, best = compressors()[name][1], None
    for a, b in [(max(a, low), min(b, high)) for a, b in own if a < high and b > low] or [(low, high)]:
        if b - a < len(theirs) // 2 or not (found := best_match(theirs, words[a:b])) or found[0] < MIN_ALIKE:
            continue
        first, end = a + found[1][0].b, a + found[1][-1].b + found[1][-1].size
        if 1 - size(words[first:end], name) / size(words[first:end]) >= MIN_SAVED and (not best or found[0] > best[0]):
            best = (*found, a)
    return best


def notices(text: str) -> list[tuple]:
    """(start, stop, license, plain size, size with it, share saved, likeness, words lacked, words added) of the notices of a region."""
    spots = [m.span() for m in WORD.finditer(text)]
    words = [text[a:b].lower() for a, b in spots]
    own = places(words)
    queue: list[tuple[int, str, int, int]] = []
    seen: set[tuple[int, int]] = set()
    taken, out = bytearray(len(words)), []

    def put(low: int, high: int) -> None:
        if high > low and (low, high) not in seen:
            seen.add((low, high))
            for saved, name in ranked(words[low:high]):
                heapq.heappush(queue, (saved, name, low, high))

    for low, high in merged([p for found in own.values() for p in found]):
        put(low, high)
    while queue:
        _, name, low, high = heapq.heappop(queue)
        if any(taken[low:high]):  # what is left of it is ranked anew
            edges = [low - 1, *(i for i in range(low, high) if taken[i]), high]
            for a, b in itertools.pairwise(edges):
                put(a + 1, b)
            continue
        if not (found := confirmed(name, words, low, high, own.get(name, []))):
            continue
        alike, match, at = found
        first, end = at + match[0].b, at + match[-1].b + match[-1].size
        taken[first:end] = b"\1" * (end - first)
        plain, with_it = size(words[first:end]), size(words[first:end], name)
        held = {w for m in match for w in range(m.a, m.a + m.size)}
        has = {at + i for m in match for i in range(m.b, m.b + m.size)}
        lacks = " ".join(w for i, w in enumerate(compressors()[name][1]) if i not in held)
        adds = " ".join(words[i] for i in range(first, end) if i not in has)
        out.append((spots[first][0], spots[end - 1][1], name, plain, with_it, 1 - with_it / plain, alike, lacks, adds))
        put(low, first)
        put(end, high)
    return sorted(out)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each confirmed license notice of a document; block numbers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cue = re.compile(CUE)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                found = [(a + x[0], a + x[1], *x[2:]) for a, b in regions(text, cue) for x in notices(text[a:b])]
                out += [(doc, i, *x) for i, x in enumerate(found)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=schema)

    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RESULT.split(", ")])
    # texts without any cue never leave the JVM
    return docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").rlike(CUE)).mapInArrow(run, RESULT)

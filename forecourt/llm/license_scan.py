"""License notices in documents, found by conditional compression."""

from __future__ import annotations

import difflib
import functools
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from forecourt.llm.common import map_batches

# The public wording of licenses, by SPDX identifier. A license may have several.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this'
     " file except in compliance with the License. You may obtain a copy of the License at"
     " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in"
     ' writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT'
     " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the"
     " specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
     ' software and associated documentation files (the "Software"), to deal in the Software without'
     " restriction, including without limitation the rights to use, copy, modify, merge, publish,"
     " distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
     " Software is furnished to do so, subject to the following conditions: The above copyright"
     " notice and this permission notice shall be included in all copies or substantial portions of"
     ' the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR'
     " IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A"
     " PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under"
     " the terms of the GNU General Public License as published by the Free Software Foundation,"
     " either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under"
     " the terms of the GNU General Public License as published by the Free Software Foundation;"
     " either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under"
     " the terms of the GNU Lesser General Public License as published by the Free Software"
     " Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If"
     " a copy of the MPL was not distributed with this file, You can obtain one at"
     " https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification,"
     " are permitted provided that the following conditions are met: Redistributions of source code"
     " must retain the above copyright notice, this list of conditions and the following disclaimer."
     " Redistributions in binary form must reproduce the above copyright notice, this list of"
     " conditions and the following disclaimer in the documentation and/or other materials provided"
     " with the distribution. Neither the name of the copyright holder nor the names of its"
     " contributors may be used to endorse or promote products derived from this software without"
     " specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification,"
     " are permitted provided that the following conditions are met: Redistributions of source code"
     " must retain the above copyright notice, this list of conditions and the following disclaimer."
     " Redistributions in binary form must reproduce the above copyright notice, this list of"
     " conditions and the following disclaimer in the documentation and/or other materials provided"
     " with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
     " without fee is hereby granted, provided that the above copyright notice and this permission"
     " notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0"
     " International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0"
     " International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_CUES = ("licen", "copyright", "redistribut", "permission", "warrant", "public domain",
         "creative commons", "cc by")
_CUE = re.compile("|".join(_CUES))
_WORD = re.compile(r"[^\W_]+(?:[.\-/][^\W_]+)*")
# Blocks of up to so many words are also judged in one piece.
_SHORT = 512


@functools.lru_cache(maxsize=4)
def _compressors(templates: tuple, level: int):
    plain = zstandard.ZstdCompressor(level=level)
    made = []
    for name, wording in templates:
        shaped = _flat(wording)
        data = zstandard.ZstdCompressionDict(
            shaped.encode("utf-8"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append((name, _words(wording), len(plain.compress(shaped.encode("utf-8"))),
                     zstandard.ZstdCompressor(level=level, dict_data=data)))
    return plain, made


def _flat(text: str) -> str:
    return " ".join(text.lower().split())


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def blocks(text: str | None, gap: int = 3) -> list[tuple[int, int, str]]:
    """Candidate blocks (first line, lines, text): lines with a cue, and what lies between near ones."""
    if not text or not _CUE.search(text.lower()):
        return []
    lines = text.split("\n")
    cues = [i for i, line in enumerate(lines) if _CUE.search(line.lower())]
    found, start = [], 0
    for i in range(1, len(cues) + 1):
        if i == len(cues) or cues[i] - cues[i - 1] > gap:
            first, last = cues[start], cues[i - 1]
            found.append((first, last - first + 1, "\n".join(lines[first:last + 1])))
            start = i
    return found


def _matched(block: list[str], template: list[str]) -> tuple[int, list[str], list[str], int, int]:
    """``wording``, and the first word of the match in the block and the one behind its last."""
    match = difflib.SequenceMatcher(None, block, template, autojunk=False)
    spans = [m for m in match.get_matching_blocks() if m.size]
    if not spans:
        return 0, list(template), [], 0, 0
    # Words far off that match by chance are no part: the run of spans that pays most stays.
    best, run, start = (0, 0, 0), 0, 0
    for k, m in enumerate(spans):
        between = m.a - spans[k - 1].a - spans[k - 1].size if k else 0
        if run - between < 0:
            run, start, between = 0, k, 0
        run += m.size - between
        if run > best[0]:
            best = (run, start, k + 1)
    spans = spans[best[1]:best[2]]
    seen = sum(m.size for m in spans)
    missing, extra, at_block, at_template = [], [], spans[0].a, 0
    for m in spans:
        extra += block[at_block:m.a]
        missing += template[at_template:m.b]
        at_block, at_template = m.a + m.size, m.b + m.size
    return seen, missing + template[at_template:], extra, spans[0].a, at_block


def wording(block: list[str], template: list[str]) -> tuple[int, list[str], list[str]]:
    """Words of the template found in order, those missing, and those put in between."""
    return _matched(block, template)[:3]


def _best(block: str, some, templates: tuple, level: int, winners: int, tolerance: float,
          least: float):
    """The winner of ``some`` templates: (rank, what ``judge`` returns, first word, end), or None."""
    plain, made = _compressors(templates, level)
    data = _flat(block).encode("utf-8")
    alone = len(plain.compress(data))
    ranked = sorted(
        ((alone - len(made[i][3].compress(data))) / made[i][2], -i) for i in some)[::-1]
    words, best = _words(block), None
    lowest = ranked[min(winners, len(ranked)) - 1][0]
    for share, i in ranked:
        if share < least or share < lowest:
            break
        name, expected, _, _ = made[-i]
        seen, missing, extra, first, end = _matched(words, expected)
        changed = len(missing) + len(extra)
        if changed > tolerance * len(expected) or any(
                w[0].isdigit() for w in missing + extra):
            continue
        rank = (seen, -changed)
        if best is None or rank > best[0]:
            best = (rank, (name, float(share), seen, missing, extra), first, end)
    return best


def judge(block: str, templates: tuple, level: int, winners: int, tolerance: float, least: float):
    """The winning template of a block: (name, share, words found, missing, extra), or None.

    Each template is given to the compressor as a raw dictionary. The bytes that this saves,
    as a share of the template's own compressed size, tell how much of its wording the
    block holds. The templates that save most, ``winners`` of them and ties, are compared word
    by word; one is confirmed if the words missing or put in are at most the share
    ``tolerance`` of it and none is a number. Of confirmed ones, that which accounts for the
    most words wins, then the one with fewer differences.
    """
    best = _best(block, range(len(templates)), templates, level, winners, tolerance, least)
    return best and best[1]


@functools.lru_cache(maxsize=4)
def _classes(templates: tuple) -> list[tuple[int, list[int]]]:
    """Templates by size: (words of a window, templates). A window is three times their words."""
    sizes: dict[int, list[int]] = {}
    for i, (_, text) in enumerate(templates):
        sizes.setdefault(max(8, 1 << (len(_words(text)) - 1).bit_length()), []).append(i)
    return [(3 * size, some) for size, some in sorted(sizes.items())]


def notices(block: str, templates: tuple, level: int, winners: int, tolerance: float,
            least: float) -> list[tuple]:
    """All notices of a block in order: (what ``judge`` returns, first character, end) of each.

    Templates of about one size are judged in windows of their size that overlap by half and
    hold a cue, so that the text around a notice does not hide it; short blocks are judged
    whole, too. The words of a winner are set apart and the rest of its window is judged
    again. Of confirmed matches that overlap, the one that accounts for more words stays.
    """
    low = block.lower()
    if len(low) != len(block):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in block)
    places = [m.span() for m in _WORD.finditer(low)]
    begins = [a for a, _ in places]
    cues = sorted({max(0, bisect_left(begins, m.start() + 1) - 1) for m in _CUE.finditer(low)})
    n = len(places)

    def cued(a: int, b: int) -> bool:
        at = bisect_left(cues, a)
        return at < len(cues) and cues[at] < b

    todo = {(0, n, tuple(range(len(templates))))} if n <= _SHORT else set()
    for width, some in _classes(templates):
        todo |= {(a, min(a + width, n), tuple(some))
                 for a in range(0, max(n - width // 2, 1), width // 2)}
    used, found = bytearray(n), []

    def collect(a: int, b: int, window: tuple) -> list[tuple]:
        if not cued(a, b):
            return []
        best = _best(low[places[a][0]:places[b - 1][1]], window[2], templates, level, winners,
                     tolerance, least)
        if not best:
            return []
        rank, won, first, end = best
        return [(rank, -a - first, a + end, won, window), *collect(a, a + first, window),
                *collect(a + end, b, window)]

    while todo:
        matches = []
        for window in todo:
            a = window[0]
            while 0 <= a < window[1]:
                a = used.find(0, a, window[1])
                if a >= 0:
                    end = used.find(1, a, window[1])
                    end = window[1] if end < 0 else end
                    matches += collect(a, end, window)
                    a = end
        todo = set()
        for _, first, end, won, window in sorted(matches, key=lambda m: m[:3], reverse=True):
            if any(used[-first:end]):
                todo.add(window)
            else:
                used[-first:end] = b"\1" * (end + first)
                found.append((won, places[-first][0], places[end - 1][1]))
    return sorted(found, key=lambda f: f[1])


def license_notices(
    docs: DataFrame, text: str = "text", key: str = "doc_id", templates: tuple = TEMPLATES,
    level: int = 3, winners: int = 4, tolerance: float = 0.2, least: float = 0.3,
) -> DataFrame:
    """The license notices of all documents, one row per confirmed notice.

    Columns: the key, ``first_line`` (0-based), ``n_lines``, ``license``, ``saved_share`` (bytes
    the template saves, over its own compressed size), ``words_found``, ``words_missing`` and
    ``words_extra`` (the exact differences in wording), ``block``. A block is a run of lines
    with cue words, and may hold several notices; of a block of more than 512 words, ``block``
    and its lines are the notice alone. Null and empty texts have none. Rows with null or repeated keys are
    documents of their own; other columns are not read. Each text is read whole where it
    lies; nothing is shuffled.
    """
    schema = pa.schema([
        ("key", to_arrow_type(docs.schema[key].dataType)), ("first_line", pa.int64()),
        ("n_lines", pa.int64()), ("license", pa.string()), ("saved_share", pa.float64()),
        ("words_found", pa.int64()), ("words_missing", pa.list_(pa.string())),
        ("words_extra", pa.list_(pa.string())), ("block", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, value in zip(batch.column(0), batch.column(1)):
                for first, n, block in blocks(value.as_py()):
                    short = len(_words(block)) <= _SHORT
                    for won, a, b in notices(block, templates, level, winners, tolerance, least):
                        own = block if short else block[a:b]
                        rows.append((
                            name.as_py(), first if short else first + block.count("\n", 0, a),
                            n if short else own.count("\n") + 1, *won, own))
            columns = list(zip(*rows)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_batches(
        texts, run, f"key {kind}, first_line long, n_lines long, license string, saved_share double,"
        " words_found long, words_missing array<string>, words_extra array<string>,"
        " block string").withColumnRenamed("key", key)

"""License scan by conditional compression (operator 1).

1. An Aho-Corasick pass finds cue words.  The text around a cue, far enough on
   either side for the longest template, is a candidate block, over line ends
   and blank lines; blocks that meet are one.
2. A block's words are compressed alone and with every template as a raw
   zstandard dictionary.  Templates are ranked by the bytes they save, templates that
   save none are out.
3. In that order the templates are confirmed by exact wording differences: a
   place counts if at least ``LEAST_KEPT`` of the template's words stand there
   in order with no more words than ``MOST_EXTRA`` of it put in between, and
   no number of the template is missing.  The first one confirmed wins; of
   those whose savings come near its own (``NEAR``: neighbours in the block
   move the sizes by a few bytes) the one with fewest differences.  The
   differences are part of the result.
4. What the winner's place leaves on either side is ranked again, until
   nothing more is confirmed.  No number of templates or finds is fixed.

Every template holds a cue (checked when a scanner is made), so none is out of
reach.  A block longer than ``PIECE`` times the reach is searched in pieces
that overlap by the reach, so no notice is cut in all of them.

Rows are independent.  Defined results: a null or empty text has no block; an
empty table gives an empty result; very long texts and lines are searched
whole; offsets are code points, end exclusive; overlapping finds of two
pieces keep the one that explains most words, ties by template id; repeated
rows give repeated results; other columns, of whatever name, are left alone.
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import chunks, texts_of

CHUNK_BYTES = 8 << 20
LEAST_KEPT = 0.85
MOST_EXTRA = 0.25
MARKUP = 1.5  # room for comment signs, indents and line ends in a notice, times its own length
PIECE = 4
LEVEL = 3
NEAR = 0.9, 8  # savings of at least this share of the winner's, less so many bytes

# Names and customary wording of public licenses.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution.",
    ),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": ("Released into the public domain under CC0 1.0 Universal.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, '
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "EUPL-1.2": ("Licensed under the EUPL, Version 1.2",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions",
    ),
}
# Further customary wordings, longer forms of those above and the notices of the GNU licenses.
_BSD_2 = TEMPLATES["BSD-2-Clause"][1]
_GNU = ("This {work} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {name} as "
        "published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version.")
MORE = {
    "BSD-3-Clause": (
        _BSD_2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    ),
    "GPL-2.0": (_GNU.format(work="program", stop=";", name="General Public License", comma=";", version="2"),),
    "LGPL-2.1": (_GNU.format(work="library", stop=";", name="Lesser General Public License", comma=";", version="2.1"),),
    "LGPL-3.0": (_GNU.format(work="library", stop=":", name="Lesser General Public License", comma=",", version="3"),),
    "AGPL-3.0": (_GNU.format(work="program", stop=":", name="Affero General Public License", comma=",", version="3"),),
}
# Names of the licenses in statements like "under the ...".
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License v3.0", "GNU AGPL v3"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "EUPL-1.2": ("European Union Public Licence 1.2",),
    "GPL-2.0": ("GNU General Public License v2.0", "GNU General Public License, version 2", "GNU GPL v2"),
    "GPL-3.0": ("GNU General Public License v3.0", "GNU General Public License, version 3", "GNU GPL v3"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License",),
}


def wordings(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> dict[str, tuple[str, ...]]:
    """All wordings by license: the templates, statements by name, and the identifier line."""
    out = {name: list(texts) for name, texts in templates.items()}
    for name, texts in MORE.items():
        out.setdefault(name, []).extend(texts)
    for name, known in NAMES.items():
        out.setdefault(name, []).extend(f"licensed under the {n}" for n in known)
        out[name].extend(f"under the {n}" for n in known if "licen" in n.lower() and len(n.split()) > 1)
    for name in out:
        out[name].append(f"SPDX-License-Identifier: {name}")
        if "GPL-" in name:
            out[name] += [f"SPDX-License-Identifier: {name}-{kind}" for kind in ("only", "or-later")]
    return {name: tuple(dict.fromkeys(texts)) for name, texts in out.items()}


CUES = ("license", "licence", "licensed", "permission", "redistribution", "public domain", "creative commons", "cc by")

_WORD = re.compile(r"\w+(?:[.-]\w+)*")


def _packed(words: list[str]) -> bytes:
    """What is compressed: the words alone, so that line ends, comment signs and case don't count."""
    return " ".join(words).encode("utf-8", "surrogatepass")


class Template(NamedTuple):
    name: str
    words: list[str]
    counts: Counter
    need: float
    packer: zstandard.ZstdCompressor


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] | None = None):
        templates = wordings() if templates is None else templates
        self.cues = ahocorasick.Automaton()
        for cue in {v for c in CUES for v in (c, c.upper(), c.title(), c.capitalize())}:
            self.cues.add_word(cue, len(cue))
        self.cues.make_automaton()
        self.templates: list[Template] = []
        longest = 0
        for name, texts in sorted(templates.items()):
            for wording in texts:
                if not any(c in wording.lower() for c in CUES):
                    raise ValueError(f"a wording of {name} holds no cue: {wording[:60]}")
                words = [w.lower() for w in _WORD.findall(wording)]
                raw = zstandard.ZstdCompressionDict(_packed(words), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                raw.precompute_compress(level=LEVEL)
                self.templates.append(Template(name, words, Counter(words), LEAST_KEPT * len(words),
                                               zstandard.ZstdCompressor(level=LEVEL, dict_data=raw)))
                longest = max(longest, len(wording))
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.reach = math.ceil(longest * (1 + MOST_EXTRA) * MARKUP)

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """The text within reach of a cue, long stretches as overlapping pieces."""
        stretches: list[list[int]] = []
        for last, _ in self.cues.iter(text):
            start, end = max(0, last - self.reach), min(len(text), last + self.reach)
            if stretches and start <= stretches[-1][1]:
                stretches[-1][1] = end
            else:
                stretches.append([start, end])
        out = []
        for start, end in stretches:
            at = start
            while end - at > PIECE * self.reach:
                out.append((at, at + PIECE * self.reach))
                at += (PIECE - 1) * self.reach
            out.append((at, end))
        return out

    def ranked(self, raw: bytes) -> list[tuple[int, int]]:
        """(bytes saved, template) of all templates that save any, best first."""
        alone = len(self.plain.compress(raw))
        saved = ((alone - len(t.packer.compress(raw)), i) for i, t in enumerate(self.templates))
        return sorted((s for s in saved if s[0] > 0), key=lambda s: (-s[0], s[1]))

    def judge(self, block: str) -> list[tuple]:
        """Confirmed templates of a block: (name, start, end, saved per mille, missing, extra, words)."""
        spots = [(m.start(), m.end()) for m in _WORD.finditer(block)]
        words = [block[s:e].lower() for s, e in spots]
        found, left = [], [(0, len(words))]
        while left:
            low, high = left.pop()
            if low >= high:
                continue
            held = Counter(words[low:high])
            best, best_saved = None, 0
            for saved, i in self.ranked(_packed(words[low:high])):
                if best and saved < NEAR[0] * best_saved - NEAR[1]:
                    break
                t = self.templates[i]
                if sum(min(n, held[w]) for w, n in t.counts.items()) < t.need:
                    continue  # not confirmed: too few of its words are there at all
                for first, last, missing, extra in self._places(words, low, high, t.words, t.counts):
                    key = (2 * missing + extra - len(t.words), i, first)
                    best_saved = best_saved or saved
                    if best is None or key < best[0]:
                        best = key, i, first, last, missing, extra
            if best:
                _, i, first, last, missing, extra = best
                start, end = spots[first][0], spots[last][1]
                t = self.templates[i]
                found.append((t.name, start, end, self._saved(words[first:last + 1], t), missing, extra, len(t.words)))
                left += (low, first), (last + 1, high)
        return found

    def _saved(self, words: list[str], t: Template) -> int:
        """Bytes that a template saves on the words of its place, per mille."""
        raw = _packed(words)
        alone = len(self.plain.compress(raw))
        return 1000 * (alone - len(t.packer.compress(raw))) // alone

    def _places(self, words: list[str], low: int, high: int, wanted: list[str], counts: Counter) -> list[tuple]:
        """All places of a wording in words[low:high], none over another: (first, last, missing, extra)."""
        places, left = [], [(low, high)]
        while left:
            for starts, stop in self._dense(words, *left.pop(), counts, len(wanted)):
                begin, longest = starts[0], math.floor((1 + MOST_EXTRA) * len(wanted))
                tries = ((begin, stop), *((s, min(s + longest, stop)) for s in starts))
                got = next(((s, g) for s, e in tries if (g := self._compare(words[s:e], wanted))), None)
                if got:
                    s, (first, last, missing, extra) = got
                    places.append((s + first, s + last, missing, extra))
                    left += (begin, s + first), (s + last + 1, stop)
        return places

    @staticmethod
    def _dense(words: list[str], low: int, high: int, counts: Counter, size: int):
        """Runs of the windows that hold enough words of a wording: (starts, end of the last one).

        A place begins with a word of the wording and is no longer than a
        window, so it lies whole in one of them.
        """
        need, longest = LEAST_KEPT * size, math.floor((1 + MOST_EXTRA) * size)
        hits = [k for k in range(low, high) if words[k] in counts]
        if len(hits) < need:
            return
        numbers = [w for w in counts if w[0].isdigit()]
        held: Counter = Counter()
        kept = j = stop = 0
        starts: list[int] = []
        for k in hits:
            while j < len(hits) and hits[j] < k + longest:
                w = words[hits[j]]
                held[w] += 1
                kept += held[w] <= counts[w]
                j += 1
            if kept >= need and all(held[w] for w in numbers):
                if starts and k >= stop:
                    yield starts, stop
                    starts = []
                starts.append(k)
                stop = min(k + longest, high)
            kept -= held[words[k]] <= counts[words[k]]
            held[words[k]] -= 1
        if starts:
            yield starts, stop

    @staticmethod
    def _compare(words: list[str], wanted: list[str]) -> tuple | None:
        """(first, last word of the match, missing words, words put in), or None."""
        near = difflib.SequenceMatcher(None, words, wanted, autojunk=False)
        anchor = near.find_longest_match(0, len(words), 0, len(wanted))
        if not anchor.size:
            return None
        # the notice lies around its longest common run
        low = max(0, anchor.a - anchor.b - len(wanted) // 4 - 1)
        high = min(len(words), anchor.a + len(wanted) - anchor.b + len(wanted) // 4 + 1)
        same = [m for m in difflib.SequenceMatcher(None, words[low:high], wanted, autojunk=False).get_matching_blocks()
                if m.size]
        # words of the wording that stand by themselves beside the notice are left out, as few runs as will do
        for n in range(len(same), 0, -1):
            for run in (same[k:k + n] for k in range(len(same) - n + 1)):
                kept = sum(m.size for m in run)
                first, last = low + run[0].a, low + run[-1].a + run[-1].size - 1
                extra = last - first + 1 - kept
                if kept < LEAST_KEPT * len(wanted) or extra > MOST_EXTRA * len(wanted):
                    continue
                # a number tells versions of a license apart
                if not any(w[0].isdigit() for w in set(wanted) - set(words[first:last + 1])):
                    return first, last, len(wanted) - kept, extra
        return None

    def scan(self, text: str) -> tuple[int, list[tuple]]:
        """(candidate blocks, finds in order: (name, start, end, saved per mille, missing, extra))."""
        tried = self.blocks(text)
        finds = {(name, s + a, s + b, m, x, w): saved for s, e in tried
                 for name, a, b, saved, m, x, w in self.judge(text[s:e])}
        best: list[tuple] = []
        for f in sorted(finds, key=lambda f: (2 * f[3] + f[4] - f[5], f[0], f[1])):
            if all(f[2] <= b[1] or f[1] >= b[2] for b in best):
                best.append(f)
        return len(tried), [(n, s, e, finds[n, s, e, m, x, w], m, x)
                            for n, s, e, m, x, w in sorted(best, key=lambda f: f[1])]


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, candidate blocks, license names, finds.

    ``finds`` joins ``name:start:end:saved per mille:missing words:extra words``.
    """
    def run(batches):
        s = scanner()
        for whole in batches:
            for batch in chunks(whole, "text", CHUNK_BYTES):
                tried, names, finds = [], [], []
                for text in texts_of(batch.column("text")):
                    n, found = s.scan(text)
                    tried.append(n)
                    names.append(",".join(sorted({f[0] for f in found})))
                    finds.append(",".join(":".join(map(str, f)) for f in found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(tried, pa.int64()), pa.array(names, pa.string()),
                     pa.array(finds, pa.string())], ["id", "n_blocks", "licenses", "finds"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")) \
        .mapInArrow(run, f"id {kind}, n_blocks long, licenses string, finds string").withColumnRenamed("id", id_col)

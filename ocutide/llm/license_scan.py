"""Licence scan: Dice coefficient over word bigrams against licence templates.

Words are lower-cased and stripped of punctuation.  The units of a text that are
compared are its lines, its paragraphs (runs of lines that aren't empty), runs of words
whose bigrams occur in templates (notices inside longer lines), the text as a
whole, and for each template the windows between two of its bigrams, wherever they
stand, that are its best places (notices side by side or in prose that resembles
templates).  A unit of u bigrams can reach the threshold t only against templates of
u*t/(2-t) to u*(2-t)/t bigrams, so others are skipped; and only if t*u/(2-t) of
its bigrams occur in some template, which one array pass finds out.

A notice that is exactly a template isn't searched for windows of that template or of
its parts again, and notices are kept in order of place, so time grows with the length
of a text and not with its square.  Templates hold notices, headers, short licences and
the titles of long ones, by which their full texts are told apart; ``templates_in`` adds
whole texts from a folder.

One row per input row, nothing is shuffled.  Null or empty text: no notices.
Repeated rows are each scanned; extra columns are not read.  Of equally good
templates the first by name is reported.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ocutide.llm.textbatch import _BYTE, _LOWER, TextBatch, chunks, span_hashes, windows

#: Public notices and licence texts, by name (fixed values).  Pass your own for more.
TEMPLATES = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE""",
    "AGPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "AGPL-3.0 notice": "Licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0 text": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache-2.0 text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""",
    "CC0-1.0 text": "Creative Commons Legal Code CC0 1.0 Universal",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "GFDL-1.2 text": "GNU Free Documentation License Version 1.2, November 2002",
    "GFDL-1.3 text": "GNU Free Documentation License Version 1.3, 3 November 2008",
    "GFDL notice": """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License""",
    "GPL-1.0 text": "GNU GENERAL PUBLIC LICENSE Version 1, February 1989",
    "GPL-2.0 header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-2.0 text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0 text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GPL-2.0 notice": "Licensed under the GNU General Public License, version 2.",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0 notice": "Licensed under the GNU General Public License, version 3.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "LGPL-2.0 text": "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    "LGPL-2.1 header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "LGPL-2.1 notice": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1 text": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0 text": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-3.0 notice": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "MIT notice": "Released under the MIT License.",
    "MPL-1.1 header": """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.""",
    "MPL-1.1 text": "MOZILLA PUBLIC LICENSE Version 1.1",
    "MPL-2.0 text": "Mozilla Public License Version 2.0 Definitions",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
}
THRESHOLD = 0.8
#: Units whose best template a task remembers.
MEMORY = 10_000
SCHEMA = "doc_id bigint, n_notices bigint, licences string, best_licence string, best_dice double, spans string"
_GAP = np.array([not (48 <= b < 58 or 97 <= b < 123 or b > 127) for b in _LOWER], bool)


def normal_words(text: str) -> list[str]:
    """Lower-case words of letters, digits and non-ASCII characters, as the scan sees them."""
    return re.findall(r"[0-9a-z\x80-\U0010FFFF]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.t, self.names = threshold, sorted(templates)
        b = TextBatch(pa.array([templates[n] for n in self.names], pa.string()))
        h, owner = self.bigrams(b)[:2]
        self.sets = [frozenset(h[owner == i].tolist()) for i in range(b.n)]
        self.all = np.unique(h)
        self.least = min(map(len, self.sets))
        #: For each template those that it is a part of.
        self.wholes = [[j for j, y in enumerate(self.sets) if x < y] for x in self.sets]
        self.known: dict[frozenset, tuple[float, str]] = {}

    @staticmethod
    def bigrams(b: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text, first byte and end byte of each pair of neighbouring words."""
        starts, ends, doc = b.spans(_GAP[b.data])
        h, first = windows(span_hashes(_BYTE[_LOWER[b.data]], starts, ends), doc, 2)
        return h, doc[first], starts[first], ends[first + 1] if len(first) else ends[:0]

    def best(self, unit: frozenset) -> tuple[float, str]:
        if unit in self.known:
            return self.known[unit]
        u, t = len(unit), self.t
        found = [(-dice(unit, s), n) for s, n in zip(self.sets, self.names, strict=True) if u * t <= len(s) * (2 - t) + 1e-9 and len(s) * t <= u * (2 - t) + 1e-9]
        score, name = min(found, default=(0.0, ""))
        if len(self.known) >= MEMORY:
            self.known.clear()
        self.known[unit] = -score, name
        return -score, name

    def units(self, b: TextBatch, owner: np.ndarray, s: np.ndarray, e: np.ndarray, hit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index ranges of bigrams, one kind of unit after another."""
        lines = b.lines()
        yield np.searchsorted(s, lines[0], "left"), np.searchsorted(e, lines[1], "right")
        text = b.data
        blank = np.zeros(len(text), bool)
        if len(text):
            inside = np.zeros(len(text) + 2, np.int64)
            np.add.at(inside, lines[0], 1)
            np.add.at(inside, np.minimum(lines[1] + 1, len(text)), -1)  # a line and its newline
            blank = np.cumsum(inside[: len(text)]) == 0
        p = b.spans(blank)
        yield np.searchsorted(s, p[0], "left"), np.searchsorted(e, p[1], "right")
        yield np.searchsorted(owner, np.arange(b.n), "left"), np.searchsorted(owner, np.arange(b.n), "right")
        at = np.flatnonzero(hit)
        cut = np.flatnonzero((np.diff(at) > 2) | (owner[at[1:]] != owner[at[:-1]])) + 1 if len(at) else at
        yield at[np.concatenate([[0], cut])] if len(at) else at, (at[np.concatenate([cut - 1, [len(at) - 1]])] + 1) if len(at) else at

    def windows(self, k: int, at: np.ndarray, h: np.ndarray, owner: np.ndarray, repeats: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Windows that reach the threshold against template k, its best ones that don't overlap: first and end bigram, coefficient.

        ``at``: places of its bigrams.  A best window begins and ends with a bigram of the
        template that occurs once in it, or it could be shorter; so it ends before its first
        bigram comes again.
        """
        members = self.sets[k]
        n = len(members)
        least, most = max(int(np.ceil(self.t * n / (2 - self.t) - 1e-9)), 1), n * (2 - self.t) / self.t + 1e-9
        if len(at) < least:
            return
        a, z = at[: len(at) - least + 1], at[least - 1 :]
        near = (owner[a] == owner[z]) & (z + 1 - a - (repeats[z + 1] - repeats[a]) <= most)
        found = []
        for p in np.flatnonzero(near).tolist():
            first, doc = int(at[p]), owner[at[p]]
            seen: set[int] = set()
            common, i = 0, first
            while i < len(h) and owner[i] == doc and common < n:
                x = int(h[i])
                if x in seen:
                    if x == h[first]:
                        break
                else:
                    seen.add(x)
                    if len(seen) > most:
                        break
                    if x in members:
                        common += 1
                        score = 2 * common / (n + len(seen))
                        if score >= self.t:
                            found.append((-score, first, i + 1))
                i += 1
        taken = np.zeros(len(h) if found else 0, bool)
        for score, lo, hi in sorted(found, key=lambda x: (x[0], x[1] - x[2], x[1])):
            if not taken[lo] and not taken[hi - 1] and not taken[lo:hi].any():
                taken[lo:hi] = True
                yield lo, hi, -score

    def scan(self, b: TextBatch) -> list[dict[tuple[int, int], tuple[float, str]]]:
        """For each text the notices found: their bytes, Dice coefficient and licence."""
        out: list[dict] = [{} for _ in range(b.n)]
        h, owner, s, e = self.bigrams(b)
        if not len(h):
            return out
        hit = np.isin(h, self.all)
        order = np.lexsort((h, owner))
        again = np.zeros(len(h), bool)  # bigrams seen before in their text; a unit's distinct ones are all but these at least
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        total, repeats = (np.concatenate([[0], np.cumsum(x)]) for x in (hit, again))
        exact: dict[str, list[tuple[int, int]]] = {}
        for lo, hi in self.units(b, owner, s, e, hit):
            hi = np.maximum(hi, lo)
            hits, distinct = total[hi] - total[lo], hi - lo - (repeats[hi] - repeats[lo])
            for i in np.flatnonzero((hits * (2 - self.t) >= 0.999 * self.t * np.maximum(distinct, self.least)) & (hi > lo)):
                score, name = self.best(frozenset(h[lo[i] : hi[i]].tolist()))
                if score >= self.t:
                    out[owner[lo[i]]][(int(s[lo[i]]), int(e[hi[i] - 1]))] = (score, name)
                    if score == 1:
                        exact.setdefault(name, []).append((int(lo[i]), int(hi[i])))
        at_all = np.flatnonzero(hit)
        # long templates first, so that what is part of them is known to be
        for k in sorted(range(len(self.names)), key=lambda k: (-len(self.sets[k]), self.names[k])):
            members = self.sets[k]
            at = at_all[np.isin(h[at_all], np.fromiter(members, np.uint64, len(members)))]
            done = np.zeros(len(h) + 1, np.int64)
            for name in (self.names[k], *(self.names[j] for j in self.wholes[k])):
                for lo, hi in exact.get(name, ()):
                    done[lo] += 1
                    done[hi] -= 1
            at = at[np.cumsum(done[:-1])[at] == 0]
            whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for lo, hi, score in self.windows(k, at, h, owner, repeats):
                doc, a, z = int(owner[lo]), int(s[lo]), int(e[hi - 1])
                if doc not in whole:  # starts and farthest ends of what it may be part of
                    others = {self.names[j] for j in self.wholes[k]}
                    spans = sorted(place for place, (_, other) in out[doc].items() if other in others)
                    whole[doc] = np.array([x for x, _ in spans]), np.maximum.accumulate(np.array([y for _, y in spans], np.int64)) if spans else np.zeros(0, np.int64)
                starts, ends = whole[doc]
                before = int(np.searchsorted(starts, a, "right"))
                # a notice that is part of a longer template found here is no notice of its own
                if score > out[doc].get((a, z), (0.0, ""))[0] and not (before and ends[before - 1] >= z):
                    out[doc][a, z] = (score, self.names[k])
        return out


def _outermost(found: dict[tuple[int, int], tuple[float, str]]) -> list[tuple[int, int, float, str]]:
    """The best of overlapping notices, in order of place."""
    out: list[tuple[int, int, float, str]] = []
    for (a, z), (score, name) in sorted(found.items(), key=lambda x: (-x[1][0], x[0][0] - x[0][1], x[0])):
        i = bisect.bisect_left(out, (a, z))  # what is taken doesn't overlap: only its neighbours can be in the way
        if (i == 0 or out[i - 1][1] <= a) and (i == len(out) or out[i][0] >= z):
            out.insert(i, (a, z, score, name))
    return out


def templates_in(folder: str) -> dict[str, str]:
    """Whole licence texts by file name, to be added to TEMPLATES; ``folder``: one that the driver can read."""
    return {p.name: p.read_text("utf-8", "replace") for p in sorted(Path(folder).iterdir()) if p.is_file()}


def _scanned(batches: Iterable[pa.RecordBatch], templates: dict[str, str], threshold: float) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(templates, threshold)
    for batch in batches:
        for part in chunks(batch):
            b = TextBatch(part.column("text"))
            rows = []
            for i, found in enumerate(scanner.scan(b)):
                hits = _outermost(found) if found else []
                at = int(b.offsets[i])
                ahead = np.concatenate([[0], np.cumsum((b.data[at : int(b.offsets[i + 1])] & 0xC0) != 0x80)]) if hits else None
                chars = lambda z, at=at, ahead=ahead: int(ahead[z - at])
                top = min(hits, key=lambda x: (-x[2], x[3]), default=None)
                rows.append((len(hits), ",".join(sorted({x[3] for x in hits})), top and top[3], top and round(top[2], 6), ",".join(f"{n}:{chars(a)}:{chars(z)}" for a, z, _, n in hits)))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [c.split()[0] for c in SCHEMA.split(", ")])


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Licence notices of each row of ``docs`` (doc_id, text): number, licences, the best match, and ``licence:start:end`` spans in code points."""
    chosen = templates or TEMPLATES
    return docs.select("doc_id", "text").mapInArrow(lambda it: _scanned(it, chosen, threshold), SCHEMA)

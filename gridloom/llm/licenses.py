"""License scan: winnowed fingerprints in an inverted index pick candidates, banded alignment confirms them.

Texts and templates are rows of words. Hashes of each three words are winnowed: of every three in a row the least is kept, so a
shared passage of five words shares a fingerprint. Of templates every place is indexed. The index
gives, for each fingerprint of a text, the templates and places that have it, and with them where the template would start.
Starts that lie within the band of each other are one candidate, which is aligned with the template inside the band. A match
reports the share of the template's words that the alignment finds and the span in code points from the first to the last.

A notice (a template of under NOTICE_WORDS words) also needs its names and numbers inside the span, so another licence's notice
in like words isn't taken for it.

Null and empty texts have no matches. Repeated occurrences are matches of their own. Of overlapping matches that with more
words, then the better coverage, then the first name is kept. The templates' size is checked; documents are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import map_batches

GRAM, WINNOW, MIN_COVERAGE = 3, 3, 0.8
#: Words of all templates together that may be sent to every worker.
MAX_TEMPLATE_WORDS = 2_000_000
WORD = re.compile(r"[^\W_]+")

#: License notices and short license texts.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_OR_LATER = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
_KINDS = {"GPL-2.0": ("General Public", "2"), "LGPL-2.1": ("Lesser General Public", "2.1"), "LGPL-3.0": ("Lesser General Public", "3"), "AGPL-3.0": ("Affero General Public", "3")}
#: Notices of other licence families, in the words of those above.
TEMPLATES |= {f"{name}-notice": f"This work is licensed under the GNU {kind} License, version {v}." for name, (kind, v) in _KINDS.items()}
TEMPLATES |= {f"{name}-or-later": _OR_LATER.format(what="library" if name[0] == "L" else "program", kind=kind, v=v) for name, (kind, v) in _KINDS.items()}
TEMPLATES |= {f"CC-{k}-{v}-notice": f"Licensed under CC {k} {v}." for k in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0") if (k, v) != ("BY-NC", "4.0")}
TEMPLATES |= {f"{k}-notice": f"Released under the {k} License." for k in ("BSD", "ISC", "zlib", "Artistic")}
TEMPLATES |= {f"BSD-{n}-Clause-notice": f"Released under the BSD {n}-Clause License." for n in (2, 3)}
TEMPLATES |= {
    "CC0-1.0-notice": "Released under CC0 1.0 Universal.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "EPL-2.0-notice": "Licensed under the Eclipse Public License, Version 2.0.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "BSD-3-Clause": TEMPLATES["BSD-2-Clause"] + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
}
NOTICE_WORDS = 60
#: Words that tell one licence's notice from another's, besides numbers.
NAMES = set("mit apache gnu lesser affero mozilla mpl eclipse boost bsd isc zlib artistic cc cc0 nc sa nd creative commons".split())


def lowered(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def _grams(ids: np.ndarray, base: int) -> np.ndarray:
    """A number for each three words, 0 where one of them is in no template."""
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    return np.where((a > 0) & (b > 0) & (c > 0), (a * base + b) * base + c, 0)


def _winnowed(grams: np.ndarray) -> np.ndarray:
    """Places that are the least hash of some window; zeros, which no template has, stand above all."""
    if len(grams) <= WINNOW:
        return np.flatnonzero(grams)
    hashed = np.where(grams > 0, (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1), np.uint64(2**64 - 1))
    windows = np.lib.stride_tricks.sliding_window_view(hashed, WINNOW)
    places = np.unique(np.arange(len(windows)) + windows.argmin(axis=1))
    return places[grams[places] > 0]


@dataclass
class Index:
    names: list[str]
    words: dict[str, int]
    templates: list[np.ndarray]
    posts: dict[int, list[tuple[int, int]]]
    keys: np.ndarray
    required: list[set[int]]

    @classmethod
    def of(cls, templates: dict[str, str]) -> Index:
        words: dict[str, int] = {}
        rows = [np.array([words.setdefault(w, len(words) + 1) for w in WORD.findall(lowered(t))], np.int64) for t in templates.values()]
        if sum(map(len, rows)) > MAX_TEMPLATE_WORDS or len(words) >= 1 << 20:
            raise ValueError("too many templates for an index that every worker holds")
        if any(len(r) < GRAM for r in rows):
            raise ValueError(f"a template has at least {GRAM} words")
        posts: dict[int, list[tuple[int, int]]] = {}
        for t, row in enumerate(rows):
            grams = _grams(row, len(words) + 1)
            for place in range(len(grams)):  # all places: a text's window may choose any of them
                posts.setdefault(int(grams[place]), []).append((t, place))
        return cls(list(templates), words, rows, posts, np.array(sorted(posts)), [{words[w] for w in WORD.findall(lowered(t)) if w.isdigit() or w in NAMES} if len(r) < NOTICE_WORDS else set() for t, r in zip(templates.values(), rows, strict=True)])

    def matches(self, text: str | None, min_coverage: float = MIN_COVERAGE) -> list[dict]:
        low = lowered(text or "")
        found = WORD.findall(low)
        if len(found) < GRAM:
            return []
        ids = np.fromiter((self.words.get(w, 0) for w in found), np.int64, len(found))
        grams = _grams(ids, len(self.words) + 1)
        places = _winnowed(grams)
        places = places[np.isin(grams[places], self.keys)]
        if not len(places):
            return []
        starts: dict[int, set[int]] = {}
        for place in places.tolist():
            for t, at in self.posts[int(grams[place])]:
                starts.setdefault(t, set()).add(place - at)
        chars, out = [m.span() for m in WORD.finditer(low)], []
        for t, at in starts.items():
            size = len(self.templates[t])
            band = max(2, size // 8)
            group: list[int] = []
            for s in [*sorted(at), None]:
                if group and (s is None or s - group[-1] > band):
                    first, last = group[0] - band, group[-1] + size + band
                    hit = align(self.templates[t], ids[max(0, first) : last], band + (group[-1] - group[0]) // 2 + 1, (group[0] + group[-1]) // 2 - max(0, first))
                    if hit and hit[0] / size >= min_coverage:
                        a, b = max(0, first) + hit[1], max(0, first) + hit[2]
                        if self.required[t].issubset(ids[a : b + 1].tolist()):
                            out.append((hit[0], hit[0] / size, self.names[t], a, b))
                    group = []
                if s is not None:
                    group.append(s)
        out.sort(key=lambda x: (-x[0], -x[1], x[2], x[3]))
        kept: list = []
        for x in out:
            if all(x[4] < k[3] or x[3] > k[4] for k in kept):
                kept.append(x)
        return [{"license": n, "coverage": round(c, 4), "start": chars[a][0], "end": chars[b][1]} for _, c, n, a, b in sorted(kept, key=lambda x: x[3])]


def align(template: np.ndarray, words: np.ndarray, band: int, start: int) -> tuple[int, int, int] | None:
    """The most words of the template found in order inside a band around its start: their number, first and last place in words.

    Row by row; a cell of the band has the best (matches, first place, last place) so far. Ties go to the shortest stretch.
    """
    width = 2 * band + 1
    none = (0, 0, -1, -1)
    row = [none] * (width + 1)
    for i, w in enumerate(template.tolist()):
        new: list[tuple[int, int, int, int]] = []
        for d in range(width):
            j = i + start - band + d
            best = max(row[d + 1], new[-1] if new else none)  # a template's word or a text's word left out
            if 0 <= j < len(words) and words[j] == w:
                n, _, first, _ = row[d]
                first = j if first < 0 else first
                best = max(best, (n + 1, first - j, first, j))
            new.append(best)
        row = [*new, none]
    n, _, first, last = max(row)
    return (n, first, last) if n else None


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """id_col and matches (license, coverage, start, end), by start, for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(Index.of(TEMPLATES if templates is None else templates))

    def make():
        index = shared.value
        return lambda batch: {id_col: batch.column(0), "matches": [index.matches(t, min_coverage) for t in batch.column(1).to_pylist()]}

    return map_batches(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")), make, f"`{id_col}` {kind}, matches array<struct<license:string,coverage:double,start:int,end:int>>")


def report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """id_col, n_matches, licenses (distinct, sorted, comma-joined), spans (license:start:end) and coverage (the best), for each row."""
    m = F.col("matches")
    return scan(docs, id_col=id_col, **options).select(
        F.col(f"`{id_col}`"), F.size(m).cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["license"]))), ",").alias("licenses"),
        F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"), F.coalesce(F.array_max(F.transform(m, lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"),
    )

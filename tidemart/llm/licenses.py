"""License scans by patience alignment.

A text and a template are aligned like this: words that occur once in both are anchors; the longest
increasing subsequence of their places keeps order; the gaps between anchors are aligned the same
way, and where no anchor is left, equal words at both ends of a gap are matched. The share of the
template's words that are matched is its coverage.

Only stretches of a text that can reach the least coverage are aligned: a stretch at most STRETCH
times the template's length with enough words of the template. That is a necessary condition, so it
loses nothing; stretches overlap by half. Templates are a stated, bounded list that travels to the
tasks; documents are not moved.

Defined cases: a null or empty text has no license. Of equal coverages the template listed first
wins, of equal places the first. Repeated rows are scanned each by itself. An empty table gives an
empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemart.llm.common import as_bytes, lowered_bytes, small_batches

LEAST_COVERAGE = 0.8
#: A template's words lie within so many times its length.
STRETCH = 1.5

# The notices of common licenses.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "MIT-text":
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
    "Apache-2.0-notice":
        "you may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the "
        "License.",
    "BSD-text":
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
}

_TABLE = lowered_bytes(b"0123456789abcdefghijklmnopqrstuvwxyz")
SCHEMA = ("license string, coverage double, matched int, template_words int, start_word int, "
          "end_word int, licenses array<string>")


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that ascends in both; pairs come sorted by the first."""
    tops, at, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[pile], at[pile] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Matched places (of a, of b), ascending in both."""
    out: list[tuple[int, int]] = []
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        i, i_end, j, j_end = waiting.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        of_a, of_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {w: k for k, w in enumerate(b[j:j_end], j) if of_b[w] == 1}
        anchors = _increasing([(k, place[w]) for k, w in enumerate(a[i:i_end], i)
                               if of_a[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        edges = [(i - 1, j - 1), *anchors, (i_end, j_end)]
        waiting += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


class Matcher:
    def __init__(self, templates: dict[str, str], least: float = LEAST_COVERAGE):
        self.least = least
        self.templates = [(name, words(text.encode())) for name, text in templates.items()]
        self.vocabulary = {w for _, own in self.templates for w in own}

    def find(self, text: bytes | None) -> list[tuple[str, int, int, int, int]]:
        """(license, matched words, words of the template, first word, end) of each template that
        is covered, its best place."""
        own = words(text)
        known = [k for k, w in enumerate(own) if w in self.vocabulary]
        if not known:
            return []
        places = np.array(known)
        found = []
        for name, template in self.templates:
            inside = set(template)
            mine = places[[own[k] in inside for k in known]]
            need = int(np.ceil(self.least * len(template)))
            reach = int(STRETCH * len(template)) + 1
            if len(mine) < need:
                continue
            # places from which a stretch has enough words of the template
            last = np.searchsorted(mine, mine + reach)
            starts = mine[last - np.arange(len(mine)) >= need]
            best, after = None, -1
            for start in starts.tolist():
                if start < after:
                    continue
                after = start + max(1, reach // 2)
                pairs = aligned(own[start:start + 2 * reach], template)
                if len(pairs) < need:
                    continue
                first, end = start + pairs[0][0], start + pairs[-1][0] + 1
                if end - first <= 2 * reach and (best is None or len(pairs) > best[1]):
                    best = (name, len(pairs), len(template), first, end)
            if best:
                found.append(best)
        return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None,
         least: float = LEAST_COVERAGE) -> DataFrame:
    """One row per document: doc_id, the best covered license (null: none), coverage, matched words,
    words of the template, its place in words, and all licenses covered."""
    small_batches(docs.sparkSession)
    matcher = Matcher(TEMPLATES if templates is None else templates, least)
    kind = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()),
                      ("template_words", pa.int32()), ("start_word", pa.int32()),
                      ("end_word", pa.int32()), ("licenses", pa.list_(pa.string()))])

    @F.arrow_udf(f"struct<{SCHEMA.replace(' ', ': ').replace(',: ', ', ')}>")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for text in as_bytes(texts):
            found = matcher.find(text)
            name, matched, size, first, end = max(
                found, key=lambda f: f[1] / f[2], default=(None, 0, 0, None, None))
            out.append({"license": name, "coverage": matched / size if size else 0.0,
                        "matched": matched, "template_words": size, "start_word": first,
                        "end_word": end, "licenses": [f[0] for f in found]})
        return pa.array(out, kind)

    return docs.select("doc_id", of(F.col("text")).alias("found")).select("doc_id", "found.*")

"""License scans by patience alignment.

A text passage is aligned with a license template: words that occur once in both anchor the
alignment, the longest increasing subsequence of anchors is kept, and the gaps between anchors
are aligned the same way.  Coverage is the share of template words that are matched.

Passages are found by seeds: rare template words, so many of them that a passage covering the
threshold must hold one.  Each occurrence of a seed opens a window of the template's length, placed
by where the template has the seed; it ends where the passage of the seed's next occurrence starts,
so a license stated twice is two passages and its words are unique in each.  Occurrences that no
passage holds then are tried again in windows that run on past their neighbours, which may be mere
mentions, up to the passages found, and in every window where the longest common subsequence leaves
room for a passage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import rows_of, text_bytes

COVERAGE = 0.8
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

# Public license notices and texts.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
        WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
        OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in
        all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO
        THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
        AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of
        the GNU General Public License as published by the Free Software Foundation, either version 3 of the
        License, or (at your option) any later version. This program is distributed in the hope that it will be
        useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
}
#: Common words of running text: poor seeds.
COMMON = frozenset(
    "a all an and any as at be but by for from in is it not of on or other out that the this to under was with you work use free".split()
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters and digits; bytes beyond ASCII count as letters."""
    return _WORDS.findall(text.lower())


# ---------------------------------------------------------------- patience alignment


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs sorted by the first, a longest run whose second members increase."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(pairs):
        place = bisect_left(tails, b)
        before.append(at[place - 1] if place else -1)
        if place == len(tails):
            tails.append(b)
            at.append(i)
        else:
            tails[place], at[place] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def patience(text: list, template: list) -> list[tuple[int, int]]:
    """Matched (text, template) positions, increasing in both.

    Equal words at a gap's ends are matched first; what is between them is anchored at words that
    occur once on both sides.
    """
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, a_end, b, b_end = gaps.pop()
        while a < a_end and b < b_end and text[a] == template[b]:
            out.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and text[a_end - 1] == template[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            out.append((a_end, b_end))
        if a >= a_end or b >= b_end:
            continue
        once_a, once_b = Counter(text[a:a_end]), Counter(template[b:b_end])
        places = {w: i for i, w in enumerate(template[b:b_end], b) if once_b[w] == 1}
        anchors = [(i, places[w]) for i, w in enumerate(text[a:a_end], a) if once_a[w] == 1 and w in places]
        kept = _longest_increasing(anchors)
        if not kept:
            continue
        out += kept
        edges = [(a - 1, b - 1), *kept, (a_end, b_end)]
        gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(out)


def longest_common(text: list, template: list) -> int:
    """Length of the longest common subsequence: no alignment matches more words."""
    row = [0] * (len(template) + 1)
    for word in text:
        corner = 0
        for j, other in enumerate(template, 1):
            above = row[j]
            row[j] = corner + 1 if word == other else max(above, row[j - 1])
            corner = above
    return row[-1]


# ---------------------------------------------------------------- scan


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[bytes, ...]
    seeds: frozenset[bytes]


def prepared(templates: dict[str, str], coverage: float) -> list[Template]:
    """Templates with their seeds.

    A passage of the given coverage misses at most (1 - coverage) * n template words, so one more
    distinct words than that are enough; the rarest are taken.
    """
    words = {name: tuple(words_of(text.encode())) for name, text in templates.items()}
    spread = Counter(w for found in words.values() for w in set(found))
    out = []
    for name, found in words.items():
        if not found:
            raise ValueError(f"template {name} has no words")
        missed, need = int((1 - coverage) * len(found) + 1e-9), []
        uses = Counter(found)
        for w in sorted(uses, key=lambda w: (w.decode("utf-8", "replace") in COMMON, spread[w], uses[w], -len(w), w)):
            need.append(w)
            missed -= uses[w]
            if missed < 0:
                break
        out.append(Template(name, found, frozenset(need)))
    return out


def passages(words: list[bytes], template: Template, coverage: float) -> list[tuple[int, int, int]]:
    """(start, end, matched) of the non-overlapping passages that cover the template, left to right."""
    places: dict[bytes, list[int]] = {w: [] for w in template.seeds}
    for i, w in enumerate(words):
        if w in places:
            places[w].append(i)
    n, slack = len(template.words), int(0.25 * len(template.words)) + 1
    uses = Counter(template.words)
    found: list[tuple[int, int, int]] = []

    def aligned(left: int, right: int) -> tuple[int, int, int] | None:
        matches = patience(words[left:right], list(template.words))
        if len(matches) >= coverage * n - 1e-9:
            return left + matches[0][0], left + matches[-1][0] + 1, len(matches)
        return None

    def keep(passage: tuple[int, int, int] | None) -> None:
        if passage and not any(s < passage[1] and passage[0] < e for s, e, _ in found):
            found.append(passage)

    for seed in sorted(template.seeds):
        spots = places[seed]
        lead = template.words.index(seed)
        for i, at in enumerate(spots):
            if any(s <= at < e for s, e, _ in found):
                continue
            if uses[seed] > 1:  # the place of the seed in the template is open
                left, right = at - n - slack, at + n + slack + 1
            else:  # a neighbouring occurrence belongs to a passage of its own
                start, end = at - lead, at - lead + n
                left, right = start - slack, end + slack
                if i:
                    left = max(left, min(start, spots[i - 1] - lead + n))
                if i + 1 < len(spots):
                    right = min(right, max(at + 1, spots[i + 1] - lead))
            keep(aligned(max(0, left), min(len(words), right)))
    # A neighbouring occurrence may be a mere mention: wider windows for the occurrences left over.
    for seed in sorted(template.seeds):
        spots = places[seed]
        for i, at in enumerate(spots):
            if any(s <= at < e for s, e, _ in found):
                continue
            first = max([0, *(e for _, e, _ in found if e <= at)])
            last = min([len(words), *(s for s, _, _ in found if s > at)])
            options: list[tuple[int, int, int]] = []
            whole: list[tuple[int, int]] = []
            for lead in (j for j, w in enumerate(template.words) if w == seed):
                start, end = at - lead, at - lead + n
                lefts, rights = {start - slack, start}, {end + slack, end}
                if i:
                    lefts.add(max(start - slack, (spots[i - 1] + at) // 2 + 1))
                if i + 1 < len(spots):
                    rights.add(min(end + slack, (at + spots[i + 1]) // 2 + 1))
                lefts, rights = {max(first, x) for x in lefts}, {min(last, x) for x in rights}
                # No alignment matches more words than the widest window has in common with the template.
                if (Counter(words[min(lefts) : max(rights)]) & uses).total() >= coverage * n - 1e-9:
                    options += [p for x in lefts for y in rights if (p := aligned(x, y))]
                    whole.append((min(lefts), max(rights)))
            if not options:  # words said twice may hide each other: every window, where any can do
                for low, high in whole:
                    if longest_common(words[low:high], template.words) >= coverage * n - 1e-9:
                        lefts = [x for x in range(low, at + 1) if words[x] in uses]
                        rights = [y for y in range(at + 1, high + 1) if words[y - 1] in uses]
                        options += [p for x in lefts for y in rights if y - x >= coverage * n - 1e-9 and (p := aligned(x, y))]
            if options:
                keep(min(options, key=lambda p: (-p[2], p[1] - p[0], p[0])))
    return sorted(found)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE
) -> DataFrame:
    """One row per license passage: doc_id, license, coverage, start_word, end_word, matched, passage.

    Positions count words from 0, the end is exclusive; ``passage`` is the words from start to end.
    A passage is reported for every template it covers to ``coverage`` or more.  Null and empty
    texts have none; a null id stays null; repeated rows are scanned each; an empty table gives no
    rows; columns other than id and text are ignored.  Nothing is shuffled.
    """
    ready = prepared(TEMPLATES if templates is None else templates, coverage)
    by_seed: dict[bytes, list[Template]] = {}
    for template in ready:
        for seed in template.seeds:
            by_seed.setdefault(seed, []).append(template)
    seeds = frozenset(by_seed)

    def find(batches):
        names = ["doc_id", "license", "coverage", "start_word", "end_word", "matched", "passage"]
        types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            out = []
            for key, text in zip(*rows_of(batch)):
                words = words_of(text)
                hit = seeds.intersection(words)
                for template in {t.name: t for w in sorted(hit) for t in by_seed[w]}.values():
                    for start, end, matched in passages(words, template, coverage):
                        said = b" ".join(words[start:end]).decode("utf-8", "replace")
                        out.append((key, template.name, matched / len(template.words), start, end, matched, said))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

    schema = "doc_id long, license string, coverage double, start_word long, end_word long, matched long, passage string"
    return text_bytes(docs, id_col, text_col).mapInArrow(find, schema)

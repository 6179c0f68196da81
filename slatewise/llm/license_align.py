"""License scan: patience alignment of texts with license templates.

Words that occur once in the text and once in the template anchor the alignment; of the anchors the longest
increasing subsequence is kept, words next to an anchor that agree are taken as well, and each gap between
kept anchors is aligned in the same way.  Coverage is the share of the template's words that are aligned.

Texts are scanned in one pass without a shuffle.  A text whose words cannot reach the wanted coverage of a
template even as a bag is not aligned with it; that bound loses nothing.  Templates are parameters of a fixed
number, compiled into the task.

Defined cases: words are runs of letters and digits, lower-cased.  Null and empty texts hold no license, nor
does an empty template.  Where repeated passages leave no unique word, the gap counts as unaligned, except for the
words that agree at its ends.  Repeated rows give repeated results; extra columns are ignored; a null id is kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
COVERAGE = 0.75

_FSF = "under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version"
_WORK = "This work is licensed under {}"

# The notices that are looked for, and the words that tell each from the others.
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "apache 2"),
    "MIT": ("Released under the MIT License", "mit"),
    "BSD": ("Released under the BSD License", "bsd"),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License", "bsd 2"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License", "bsd 3"),
    "ISC": ("Released under the ISC License", "isc"),
    "GPL-2.0": (_WORK.format("the GNU General Public License, version 2"), "general 2"),
    "GPL-3.0": (_WORK.format("the GNU General Public License, version 3"), "general 3"),
    "LGPL-2.1": (_WORK.format("the GNU Lesser General Public License, version 2.1"), "lesser 2 1"),
    "LGPL-3.0": (_WORK.format("the GNU Lesser General Public License, version 3"), "lesser 3"),
    "AGPL-3.0": (_WORK.format("the GNU Affero General Public License, version 3"), "affero 3"),
    "GPL-2.0 or later": (_FSF.format("General Public License", 2), "general 2"),
    "GPL-3.0 or later": (_FSF.format("General Public License", 3), "general 3"),
    "LGPL-2.1 or later": (_FSF.format("Lesser General Public License", 2.1), "lesser 2 1"),
    "LGPL-3.0 or later": (_FSF.format("Lesser General Public License", 3), "lesser 3"),
    "AGPL-3.0 or later": (_FSF.format("Affero General Public License", 3), "affero 3"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla 2"),
    "CC-BY-4.0": (_WORK.format("a Creative Commons Attribution 4.0 International License"), "attribution 4"),
    "CC-BY-SA-4.0": (_WORK.format("a Creative Commons Attribution-ShareAlike 4.0 International License"), "sharealike 4"),
    "CC-BY-NC-4.0 long": (_WORK.format("a Creative Commons Attribution-NonCommercial 4.0 International License"), "noncommercial 4"),
    "CC-BY-ND-4.0": (_WORK.format("a Creative Commons Attribution-NoDerivatives 4.0 International License"), "noderivatives 4"),
    "CC-BY-NC-SA-4.0": (_WORK.format("a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"), "noncommercial sharealike 4"),
    "CC-BY-NC-ND-4.0": (_WORK.format("a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"), "noncommercial noderivatives 4"),
    "CC-BY-4.0 short": ("Licensed under CC BY 4.0", "cc by 4"),
    "CC-BY-SA-4.0 short": ("Licensed under CC BY-SA 4.0", "cc sa 4"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "cc nc 4"),
    "CC-BY-ND-4.0 short": ("Licensed under CC BY-ND 4.0", "cc nd 4"),
    "CC-BY-NC-SA-4.0 short": ("Licensed under CC BY-NC-SA 4.0", "cc nc sa 4"),
    "CC-BY-NC-ND-4.0 short": ("Licensed under CC BY-NC-ND 4.0", "cc nc nd 4"),
    "CC0-1.0": ("Released under CC0 1.0", "cc0"),
    "CC0-1.0 waiver": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived"),
    "All rights reserved": ("All rights reserved", "all rights reserved"),
}
# Whole license texts, read where the plan is made.
TEXTS = {f"{path.stem} text": path.read_text() for path in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
TEMPLATES = {name: text for name, (text, _) in NOTICES.items()} | TEXTS
MARKS = {name: tuple(marks.split()) for name, (_, marks) in NOTICES.items()}


def split_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, ordered by their first, that rises in the second."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        back[i] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[at], ends[at] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (text place, template place) pairs, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        wanted = Counter(template[c:d])
        seen: dict[str, int] = {}
        for i in range(a, b):
            if text[i] in wanted:
                seen[text[i]] = -1 if text[i] in seen else i
        place = {w: j for j, w in enumerate(template[c:d], c) if wanted[w] == 1}
        anchors = increasing(sorted((i, place[w]) for w, i in seen.items() if i >= 0 and w in place))
        if not anchors:
            continue
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        out += anchors
        # words next to an anchor that agree are taken when the gap is looked at
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if i + 1 < k and j + 1 < m]
    return sorted(out)


def _regions(places: list[int], span: int) -> list[tuple[int, int]]:
    """Runs of places with gaps of at most `span`, widened by it."""
    out: list[list[int]] = []
    for p in places:
        if out and p - out[-1][1] <= span:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [(a, b + 1) for a, b in out]


def alignments(text: list[str], template: list[str], coverage: float = COVERAGE, marks: tuple[str, ...] = ()) -> list[tuple[float, int, int]]:
    """(coverage, first word, end word) of the template's places in the text, apart from one another.

    The text is cut where more words than the template has hold none of its words: such a gap
    separates places rather than lying inside one.  One search of a region takes
    all its good places, however many copies it holds; what is left between them is searched again.
    """
    vocabulary = Counter(template)
    needed = {j for j, w in enumerate(template) if w in marks}
    slack = max(3, len(template) // 4)
    todo = _regions([i for i, w in enumerate(text) if w in vocabulary], len(template))
    out = []
    while todo:
        a, b = todo.pop()
        bag = Counter(text[a:b])
        if sum(min(n, bag[w]) for w, n in vocabulary.items()) < coverage * len(template):
            continue
        places = set()
        for lo, hi in ((a, b), *_windows(text, a, b, template, marks)):
            pairs = _without_strays(align(text[lo:hi], template), slack)
            share = len(pairs) / len(template)
            if pairs and share >= coverage and needed <= {j for _, j in pairs}:
                lo, hi = lo + pairs[0][0], lo + pairs[-1][0] + 1
                places.add((2 * len(pairs) - (hi - lo), share, lo, hi))
        if not places:
            continue
        # a place loses by words that do not belong to it: what is pieced together from several copies comes last;
        # all places about as good as the best are taken at once, so a repeated notice needs no search of its own
        ranked = sorted(places, key=lambda x: (-x[0], x[2]))
        taken = [p[1:] for p in apart([p for p in ranked if p[0] >= min(ranked[0][0], len(template) // 2)], lambda p: p[2:])]
        out += taken
        edges = [a, *(x for p in taken for x in p[1:]), b]
        todo += [(lo, hi) for lo, hi in zip(edges[::2], edges[1::2], strict=True) if lo < hi]
    return sorted(out, key=lambda x: x[1])


def apart(ranked: list, span: Callable[[tuple], tuple[int, int]]) -> list:
    """Of ranked items those whose span meets none of an earlier one that stays, in the order of their places."""
    starts, kept = [], []
    for item in ranked:
        lo, hi = span(item)
        at = bisect_left(starts, lo)
        if (at == len(starts) or hi <= starts[at]) and (at == 0 or span(kept[at - 1])[1] <= lo):
            starts.insert(at, lo)
            kept.insert(at, item)
    return kept


def _without_strays(pairs: list[tuple[int, int]], slack: int) -> list[tuple[int, int]]:
    """Pairs without those at either end that lie further off in the text than in the template."""
    a, b = 0, len(pairs)
    while b - a > 1 and pairs[b - 1][0] - pairs[b - 2][0] > pairs[b - 1][1] - pairs[b - 2][1] + slack:
        b -= 1
    while b - a > 1 and pairs[a + 1][0] - pairs[a][0] > pairs[a + 1][1] - pairs[a][1] + slack:
        a += 1
    return pairs[a:b]


def _windows(text: list[str], a: int, b: int, template: list[str], marks: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """Windows of a region, where common words or another copy would hide anchors.

    With marks they lie around each place of the mark that is rarest there, which no place can do without;
    otherwise they overlap, of twice the template, once and a half, and once and a quarter.
    """
    n = len(template)
    if marks:
        mark = min(marks, key=text[a:b].count)
        for i in range(a, b):
            if text[i] == mark:
                for at in (j for j, w in enumerate(template) if w == mark):
                    for slack in (0, max(2, n // 4), n):
                        yield max(a, i - at - slack), min(b, i - at + n + slack)
    elif b - a > n + n // 4:
        for width in (2 * n, n + n // 2, n + n // 4):
            for lo in range(a, b, max(1, n // 4)):
                yield lo, min(b, lo + width)


def best_places(found: list[tuple[str, int, float, int, int]]) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, end word): of overlapping places the one with most words aligned beyond those missed."""
    ranked = sorted(found, key=lambda x: (-(2 * x[2] - 1) * x[1], x[0]))
    return [(name, share, lo, hi) for name, _, share, lo, hi in apart(ranked, lambda x: x[3:])]


def find_licenses(documents: DataFrame, *, templates: dict[str, str] = TEMPLATES, marks: dict[str, tuple[str, ...]] = MARKS, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, coverage, first_word, end_word, n_words) of every place of every document that holds a template.

    ``marks`` names the words without which a template is not found; of templates on one place the best is given.
    """
    compiled = {name: split_words(text) for name, text in templates.items() if split_words(text)}
    vocabulary = {name: Counter(words) for name, words in compiled.items()}
    kind = documents.schema[id_col].dataType.simpleString()
    shortest = {name: sum(sorted(map(len, words))[: int(coverage * len(words))]) for name, words in compiled.items()}
    rare = {name: sorted(vocabulary[name], key=lambda w: (-vocabulary[name][w] * (len(w) > 4), -len(w), w)) for name in compiled}

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"at": [], "license": [], "coverage": [], "first_word": [], "end_word": [], "n_words": []}
            for i, text in enumerate(batch.column(1).to_pylist()):
                low = text.lower() if text else ""
                known: dict[str, bool] = {}  # whether a word is in this text, asked once for all templates
                likely = [name for name in compiled if len(low) >= shortest[name] and _may_hold(low, known, rare[name], vocabulary[name], coverage, marks.get(name, ()))]
                words = WORD.findall(low) if likely else []
                found = [(name, len(compiled[name]), *place) for name in likely for place in alignments(words, compiled[name], coverage, marks.get(name, ()))]
                for place in best_places(found):
                    for key, value in zip(out, (i, *place, len(words)), strict=True):
                        out[key].append(value)
            ids = batch.column(0).take(pa.array(out["at"], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(out["license"], pa.string()), pa.array(out["coverage"], pa.float64()), *(pa.array(np.array(out[c], np.int64)) for c in ("first_word", "end_word", "n_words"))],
                names=["_id", "license", "coverage", "first_word", "end_word", "n_words"],
            )

    schema = f"_id {kind}, license string, coverage double, first_word long, end_word long, n_words long"
    return documents.select(F.col(id_col).alias("_id"), text_col).mapInArrow(scanned, schema).withColumnRenamed("_id", id_col)


def _may_hold(low: str, known: dict[str, bool], words: list[str], counts: Counter, coverage: float, marks: tuple[str, ...]) -> bool:
    """Whether enough of the template's words occur in the text at all, even inside other words."""
    spare = (1 - coverage) * sum(counts.values()) + 1e-9
    for word in (*marks, *words):
        held = known.get(word)
        if held is None:
            held = known[word] = word in low
        if not held:
            spare -= counts[word]
            if spare < 0 or word in marks:
                return False
    return True

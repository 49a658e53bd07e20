"""Fuzzy search for short license and copyright notices.

A notice of m characters may occur with up to k = m // ERROR_SHARE insertions, deletions and
substitutions. It is cut into k + 1 seeds, of which one must occur exactly (pigeonhole). All
seeds of all notices are found in one Aho-Corasick pass over the whole text; around each hit a
window of the notice's length and k more characters on either side is measured once by Myers'
bit-parallel method, which gives the fewest edits of a match that ends at each place. The places
are taken best first; at each the regex library's bounded-error matching verifies the notice in a
stretch of its length and reports the span and the number of edits. The time grows with the
length of the text, however often notices occur.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrays import as_array
from .scratch import map_arrow, table

NOTICES = {
    "agpl-3.0": "GNU Affero General Public License, version 3",
    "all-rights-reserved": "All rights reserved",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc0-1.0": "released into the public domain under CC0 1.0",
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "lgpl-2.1": "GNU Lesser General Public License, version 2.1",
    "mit": "Released under the MIT License",
    "mpl-2.0": "subject to the terms of the Mozilla Public License, v. 2.0",
    "spdx": "SPDX-License-Identifier:",
}
ERROR_SHARE = 10


def lowered(text: str) -> str:
    """Lower case, character by character where needed, so that positions stay what they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Notice:
    def __init__(self, name: str, text: str, edits: int):
        self.name, self.text, self.edits = name, text, edits
        self._full, self._top = (1 << len(text)) - 1, 1 << (len(text) - 1)
        self._places: dict[str, int] = {}
        for i, c in enumerate(text):
            self._places[c] = self._places.get(c, 0) | 1 << i
        self._patterns: dict[int, object] = {}

    def scores(self, text: str, first: int, last: int, most: int) -> list[tuple[int, int]]:
        """(end, edits) where a part of text[first:last] that ends at ``end`` is the notice with at most ``most`` edits, the fewest, by Myers' bit-parallel method."""
        full, top, places = self._full, self._top, self._places.get
        up, down, score, out = full, 0, len(self.text), []
        for end, c in enumerate(text[first:last], first + 1):
            same = places(c, 0)
            horizontal = ((same & up) + up ^ up) | same
            plus, minus = down | (full & ~(horizontal | up)), up & horizontal
            if minus & top:
                score -= 1
            elif plus & top:
                score += 1
            if score <= most:
                out.append((end, score))
            vertical = same | down
            plus <<= 1
            up, down = (minus << 1 | ~(vertical | plus)) & full, plus & vertical & full
        return out

    def least(self, text: str, first: int, last: int) -> int:
        """Fewest edits between the notice and any part of text[first:last]."""
        return min((s for _, s in self.scores(text, first, last, len(self.text))), default=len(self.text))

    def _spelled(self, text: str, first: int, last: int, edits: int) -> tuple[int, int, int]:
        import regex

        if edits not in self._patterns:
            self._patterns[edits] = regex.compile(f"(?b)(?:{regex.escape(self.text, literal_spaces=True)}){{e<={edits}}}")
        hit = self._patterns[edits].search(text, first, last)
        return hit.start(), hit.end(), sum(hit.fuzzy_counts)

    def _fuzzy(self, text: str, first: int, last: int) -> list[tuple[int, int, int]]:
        """Matches in text[first:last], none overlapping another: fewest edits first, then leftmost."""
        size, k = len(self.text), self.edits
        least = dict(self.scores(text, first, last, k))
        heap = [(score, end) for end, score in least.items()]
        heapq.heapify(heap)
        found: list[tuple[int, int, int]] = []
        while heap:
            score, end = heapq.heappop(heap)
            if least.get(end) != score:
                continue
            at = bisect.bisect_left(found, (end,))
            begin, stop = found[at - 1][1] if at else first, found[at][0] if at < len(found) else last
            hit = self._spelled(text, max(begin, end - size - score), min(stop, end + score), score)
            found.insert(at, hit)
            # What ends within the match, or began in it, is gone; what begins after it is measured again.
            for place in range(hit[0] + 1, min(stop, hit[1] + size + k) + 1):
                least.pop(place, None)
            for place, again in self.scores(text, hit[1], min(stop, hit[1] + size + k), k):
                least[place] = again
                heapq.heappush(heap, (again, place))
        return found

    def matches(self, text: str, first: int, last: int) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the matches in text[first:last]; exact ones, which are the best, are looked for first."""
        found, begin = [], first
        while True:
            at = text.find(self.text, begin, last)
            if (at if at >= 0 else last) - begin >= len(self.text) - self.edits and self.edits:
                found += self._fuzzy(text, begin, at if at >= 0 else last)
            if at < 0:
                return found
            begin = at + len(self.text)
            found.append((at, begin, 0))


class Scanner:
    def __init__(self, notices: dict[str, str] = NOTICES, error_share: int = ERROR_SHARE):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        self._notices: list[Notice] = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for name in sorted(notices):
            notice = lowered(notices[name])
            if not notice:
                raise ValueError(f"notice {name} is empty")
            k = len(notice) // error_share
            self._notices.append(Notice(name, notice, k))
            cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
            for first, last in zip(cuts, cuts[1:]):
                seeds.setdefault(notice[first:last], []).append((len(self._notices) - 1, first))
        for seed, uses in seeds.items():
            self._automaton.add_word(seed, (len(seed), uses))
        self._automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[str, int, int, int]]:
        """(notice, start, end, edits) of the matches, none overlapping another of its notice or a better one of any."""
        text = lowered(text)
        windows: dict[int, list[list[int]]] = {}
        for end, (length, uses) in self._automaton.iter(text):
            for k, offset in uses:
                start, notice = end + 1 - length - offset, self._notices[k]
                windows.setdefault(k, []).append([max(0, start - notice.edits), min(len(text), start + len(notice.text) + notice.edits)])
        found = []
        for k, spans in windows.items():
            spans.sort()
            merged = [spans[0]]
            for span in spans[1:]:
                if span[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], span[1])
                else:
                    merged.append(span)
            found += [(self._notices[k].name, *hit) for first, last in merged for hit in self._notices[k].matches(text, first, last)]
        return _best(found)


def _best(found: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """The matches that overlap none of fewer edits that stays."""
    kept: list[tuple[str, int, int, int]] = []
    covered: list[tuple[int, int]] = []  # by matches of fewer edits; apart, in order
    for _, level in groupby(sorted(found, key=lambda x: x[3]), key=lambda x: x[3]):
        fine = []
        for hit in level:
            at = bisect.bisect_left(covered, (hit[2],))
            if not at or covered[at - 1][1] <= hit[1]:
                fine.append(hit)
        kept += fine
        merged: list[tuple[int, int]] = []
        for first, last in sorted([*covered, *((x[1], x[2]) for x in fine)]):
            if merged and first <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], last))
            else:
                merged.append((first, last))
        covered = merged
    return sorted(kept)


def scan_notices(docs: DataFrame, notices: dict[str, str] | None = None, error_share: int = ERROR_SHARE) -> DataFrame:
    """(doc_id, notice, start, end, edits): every occurrence of a notice, as character positions in the whole text.

    Case makes no difference; everything else counts as an edit. Where occurrences of one notice overlap, the best
    is reported (fewest edits, then leftmost); a match that overlaps one of another notice with fewer edits is not.

    Defined results: null and empty texts give no rows; repeated rows give repeated results; a null doc_id stays
    null. An empty table gives no rows. Other columns are ignored. Texts of any length are read whole, in time that
    grows with their length, notices repeated or not. doc_id must be a number.
    """
    notices = dict(NOTICES if notices is None else notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, error_share)
        for batch in batches:
            rows, texts = [], as_array(batch.column(1))
            for i in range(len(texts)):
                if text := texts[i].as_py():
                    rows += [(i, *hit) for hit in scanner.scan(text)]
            at, name, start, end, edits = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(name, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32())],
                ["doc_id", "notice", "start", "end", "edits"],
            )

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, "doc_id bigint, notice string, start bigint, end bigint, edits int")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_notices(table(spark, sf_dir, "documents"))

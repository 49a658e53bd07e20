"""Phrases and proximity over word positions."""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def has_phrase(found: list[str], words: tuple[str, ...]) -> bool:
    k = len(words)
    return any(tuple(found[i : i + k]) == words for i in range(len(found) - k + 1))


def near(found: list[str], words: tuple[str, ...], distance: int) -> bool:
    """Whether the words stand within ``distance`` words of each other.

    The words are visited in query order, starting with the first. A place of the next word is kept if every word
    visited so far has a place among the kept ones at most distance + 1 before it or at most ``distance`` after it.
    """
    return near_places([[i for i, s in enumerate(found) if s == w] for w in words], distance)


def near_places(places: list[list[int]], distance: int) -> bool:
    """``near``, given each word's places in order."""
    if not all(places):
        return False
    kept = {p: 0 for p in places[0]}
    for k in range(1, len(places)):
        order, merged = sorted(kept), {}
        for p in places[k]:
            close = order[bisect_left(order, p - distance - 1) : bisect_left(order, p + distance + 1)]
            if len({kept[q] for q in close}) == k:
                merged |= {q: kept[q] for q in close}
                merged[p] = k
        if not merged:
            return False
        kept = merged
    return True


def _back(places: Column, k: int) -> Column:
    return F.transform(places, lambda p: p - F.lit(k)) if k else places


def placed_phrase(places: list[Column]) -> Column:
    """Whether words stand one after the other, given the places of each; linear in their number."""
    *most, last = [_back(p, k) for k, p in enumerate(places)]
    return F.arrays_overlap(reduce(F.array_intersect, most), last) if most else F.size(last) > 0


def placed_near(places: list[Column], distance: int) -> Column:
    """``near_places`` as an expression for two words; for more as one Arrow pass."""
    if len(places) > 2:
        return F.pandas_udf(lambda *lists: pd.Series([near_places([list(x) for x in row], distance) for row in zip(*lists)], dtype=bool), T.BooleanType())(*places)
    first, second = places
    return F.exists(second, lambda p: F.exists(first, lambda q: (q >= p - F.lit(distance + 1)) & (q < p + F.lit(distance + 1))))

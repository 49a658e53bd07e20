"""The find clause evaluated on a Python document, for what Spark expressions can't say.

Text search and scores inside arrays need the stemmer within a lambda over the elements, where Spark allows no
Python function. Such queries run through one Arrow pass of this evaluator; it is also what tests compare the
compiled expressions with.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np

from ..functions.collation import dumps
from ..functions.geo import box_of
from ..functions.text import stems
from ..plans.nodes import All, And, Array, Bind, Boost, Box, Equal, Field, Node, Not, Or, Range, Words
from .proximity import has_phrase, near

MISSING = object()


@dataclass
class Result:
    matched: bool
    terms: list[np.float32 | None] = field(default_factory=list)
    binds: dict[str, list[Any]] = field(default_factory=dict)


def term_count(node: Node) -> int:
    if isinstance(node, (And, Or)):
        return term_count(node.left) + term_count(node.right)
    if isinstance(node, Not):
        return 0
    if isinstance(node, (Field, Array, Boost)):
        return term_count(node.body)
    if isinstance(node, Bind):
        return term_count(node.array)
    return len(node.stems) if isinstance(node, Words) else 1


def word_leaves(node: Node, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], Words | None]]:
    """The scored leaves in term order: (key path with $ for array steps, words or None)."""
    if isinstance(node, (And, Or)):
        return word_leaves(node.left, path) + word_leaves(node.right, path)
    if isinstance(node, Not):
        return []
    if isinstance(node, Field):
        return word_leaves(node.body, (*path, "." + node.key))
    if isinstance(node, Array):
        return word_leaves(node.body, (*path, "$"))
    if isinstance(node, Boost):
        return word_leaves(node.body, path)
    if isinstance(node, Bind):
        return word_leaves(node.array, path)
    return [(path, node if isinstance(node, Words) else None)]


def all_words(node: Node, path: tuple[str, ...] = ()) -> dict[tuple[str, ...], list[str]]:
    """The stems looked for anywhere in the clause, by key path."""
    if isinstance(node, (And, Or)):
        out = all_words(node.left, path)
        for p, found in all_words(node.right, path).items():
            out[p] = out.get(p, []) + [s for s in found if s not in out.get(p, [])]
        return out
    if isinstance(node, (Field, Array)):
        return all_words(node.body, (*path, "." + node.key if isinstance(node, Field) else "$"))
    if isinstance(node, (Not, Boost)):
        return all_words(node.body, path)
    if isinstance(node, Bind):
        return all_words(node.array, path)
    return {path: list(dict.fromkeys(node.stems))} if isinstance(node, Words) else {}


def _number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


class Evaluator:
    """``idf`` maps (key path, stem) to its weight; empty where no score is asked for."""

    def __init__(self, node: Node, idf: dict[tuple[tuple[str, ...], str], np.float32] | None = None):
        self.node, self.idf = node, idf

    def __call__(self, doc: Any) -> Result:
        return self._run(self.node, doc, (), np.float32(1))

    def _run(self, node: Node, v: Any, path: tuple[str, ...], boost: np.float32) -> Result:
        if isinstance(node, Field):
            return self._run(node.body, v.get(node.key, MISSING) if isinstance(v, dict) else MISSING, (*path, "." + node.key), boost)
        if isinstance(node, And):
            left, right = self._run(node.left, v, path, boost), self._run(node.right, v, path, boost)
            return self._join(left, right, left.matched and right.matched)
        if isinstance(node, Or):
            left, right = self._run(node.left, v, path, boost), self._run(node.right, v, path, boost)
            return self._join(left, right, left.matched or right.matched)
        if isinstance(node, Not):
            return Result(not self._run(node.body, v, path, boost).matched)
        if isinstance(node, Boost):
            return self._run(node.body, v, path, np.float32(boost * np.float32(node.factor)))
        if isinstance(node, Bind):
            array = node.array
            while isinstance(array, Boost):
                array = array.body
            found = self._run(node.array, v, path, boost)
            if isinstance(v, list):
                own = [e for e in v if self._run(array.body, e, (*path, "$"), boost).matched]
                if isinstance(array.body, Box):
                    own.sort(key=lambda e: (b := box_of(e)) and (b[0], b[2], b[1], b[3]))
                found.binds = {**found.binds, node.name: own + found.binds.get(node.name, [])}
            return found
        if isinstance(node, Array):
            if not (isinstance(v, list) and v):
                found = self._run(node.body, MISSING, (*path, "$"), boost)
                return Result(found.matched, found.terms)
            each = [self._run(node.body, e, (*path, "$"), boost) for e in v]
            first = next((r for r in each if r.matched), None)
            binds: dict[str, list[Any]] = {}
            for r in each:
                for name, own in r.binds.items():
                    binds.setdefault(name, []).extend(own)
            return Result(first is not None, first.terms if first else [None] * term_count(node), binds)
        if isinstance(node, Words):
            return self._words(node, v, path, boost)
        matched = self._plain(node, v)
        return Result(matched, [boost if matched else None])

    def _join(self, left: Result, right: Result, matched: bool) -> Result:
        terms, binds = [], {}
        for side in (left, right):
            on = matched and side.matched
            terms += side.terms if on else [None] * len(side.terms)
            if on:
                for name, own in side.binds.items():
                    binds[name] = binds.get(name, []) + own
        return Result(matched, terms, binds)

    def _plain(self, node: Node, v: Any) -> bool:
        if isinstance(node, All):
            return True
        if isinstance(node, Equal):
            if node.value is None or isinstance(node.value, bool):
                return v is node.value
            return v == node.value if isinstance(node.value, str) and isinstance(v, str) else _number(node.value) and _number(v) and float(v) == node.value
        if isinstance(node, Range):
            if not _number(v):
                return False
            v = float(v)
            return {">": v > node.value, ">=": v >= node.value, "<": v < node.value, "<=": v <= node.value}[node.op]
        assert isinstance(node, Box)
        b = box_of(v)
        return b is not None and b[0] <= node.east and b[2] >= node.west and b[1] <= node.north and b[3] >= node.south

    def _words(self, node: Words, v: Any, path: tuple[str, ...], boost: np.float32) -> Result:
        none = [None] * len(node.stems)
        if not isinstance(v, str):
            return Result(False, none)
        found = stems(v)
        matched = has_phrase(found, node.stems) if node.distance is None else near(found, node.stems, node.distance)
        if not matched or self.idf is None:
            return Result(matched, none)
        idf = scored_idf(node, path, self.idf)
        score = term_score(idf, found.count(node.stems[0]) if len(node.stems) == 1 else 1, len(found), np.float32(boost * np.float32(node.boost)))
        return Result(True, [score, *none[1:]])


def scored_idf(node: Words, path: tuple[str, ...], idf: dict[tuple[tuple[str, ...], str], np.float32]) -> np.float32:
    """The weight that scores a match: of a phrase's first word, of a proximity search's rarest."""
    own = [idf[path, s] for s in node.stems]
    return own[0] if node.distance is None else max(own)


def term_score(idf: np.float32, count: int, length: int, boost: np.float32) -> np.float32:
    f = np.float32
    return f(f(f(f(idf * idf) * np.sqrt(f(count))) * f(f(1) / np.sqrt(f(length)))) * boost)


def inverse_frequency(fields: int, occurrences: int) -> np.float32:
    f = np.float32
    with np.errstate(divide="ignore"):
        return f(f(1) + np.log(f(f(fields) / f(f(occurrences) + f(1)))))


def final_score(terms: list[np.float32 | None], norm: np.float32) -> np.float32:
    f, total = np.float32, np.float32(0)
    for x in terms:
        total = f(total + x) if x is not None else total
    on = sum(x is not None for x in terms)
    return f(f(f(norm * total) * f(on)) / f(len(terms))) if terms else f(0)


def field_instances(doc: Any, path: tuple[str, ...]) -> list[str]:
    """The strings at a key path, each an instance of the field."""
    values = [doc]
    for step in path:
        if step == "$":
            values = [e for v in values if isinstance(v, list) for e in v]
        else:
            values = [v[step[1:]] for v in values if isinstance(v, dict) and step[1:] in v]
    return [v for v in values if isinstance(v, str)]


def bound(values: list[Any]) -> list[str]:
    return [dumps(v) for v in values]

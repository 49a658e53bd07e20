"""The find clause as Spark expressions.

Every predicate is two-valued. Inside an array clause the body refers to one element (``exists``); where the array
is empty or missing the body is asked once about a missing value, which only a negation accepts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, functions as F

from ..functions.geo import overlaps
from ..functions.text import element_places_udf, may_have, places_udf
from ..plans.nodes import All, And, Array, Bind, Boost, Box, Equal, Field, Node, Not, Or, Range, Words
from ..sources.values import Missing, Value, true
from .evaluate import scored_idf
from .proximity import placed_near, placed_phrase


class NeedsPython(Exception):
    """The clause can't be said in Spark expressions; the evaluator has to run it."""


@dataclass
class Compiled:
    pred: Column
    terms: list[Column] = field(default_factory=list)
    binds: dict[str, list[tuple[Column, Value]]] = field(default_factory=dict)


@dataclass
class Compiler:
    #: Weights by (key path, stem); None where no score is asked for.
    idf: dict[tuple[tuple[str, ...], str], np.float32] | None = None
    #: The stems looked for, by key path.
    wanted: dict[tuple[str, ...], list[str]] = field(default_factory=dict)
    #: Columns of the words' places to be added to the table before the filter, by name.
    places: dict[str, Column] = field(default_factory=dict)
    _names: dict[tuple[str, ...], str] = field(default_factory=dict)
    #: From a text index: for a key path the columns of a map of stem to places and of the number of words.
    placed: dict[tuple[str, ...], tuple[str, str]] = field(default_factory=dict)
    #: Whether the places are read again after the filter, for bound elements or scores.
    once: bool = False
    #: Inside an array clause: the array, how an element is read, its path, and the element's number.
    _element: tuple[Column, Callable[[Column], Value], tuple[str, ...], Column] | None = None

    def run(self, node: Node, v: Value, path: tuple[str, ...] = (), depth: int = 0, boost: float = 1.0) -> Compiled:
        if isinstance(node, Field):
            return self.run(node.body, v.get(node.key), (*path, "." + node.key), depth, boost)
        if isinstance(node, (And, Or)):
            left, right = self.run(node.left, v, path, depth, boost), self.run(node.right, v, path, depth, boost)
            pred = left.pred & right.pred if isinstance(node, And) else left.pred | right.pred
            terms = [F.when(side.pred, t) for side in (left, right) for t in side.terms]
            binds = {k: list(x) for k, x in left.binds.items()}
            for name, own in right.binds.items():
                binds[name] = binds.get(name, []) + own
            if isinstance(node, Or):  # the elements bound on a side that doesn't hold don't count
                binds = {}
                for side in (left, right):
                    for name, own in side.binds.items():
                        binds[name] = binds.get(name, []) + [(F.when(side.pred, c), e) for c, e in own]
            return Compiled(pred, terms, binds)
        if isinstance(node, Not):
            return Compiled(~self.run(node.body, v, path, depth, boost).pred)
        if isinstance(node, Boost):
            return self.run(node.body, v, path, depth, float(np.float32(boost) * np.float32(node.factor)))
        if isinstance(node, Bind):
            return self._bind(node, v, path, depth, boost)
        if isinstance(node, Array):
            return self._array(node, v, path, depth, boost)
        if isinstance(node, Words):
            return self._words(node, v, path, depth, boost)
        pred = self._plain(node, v)
        return Compiled(pred, [F.when(pred, F.lit(boost).cast("float"))] if self.idf is not None else [])

    def _plain(self, node: Node, v: Value) -> Column:
        if isinstance(node, All):
            return F.lit(True)
        if isinstance(node, Equal):
            return v.equals(node.value)
        if isinstance(node, Range):
            column = v.number()
            if column is None:
                return F.lit(False)
            value = F.lit(node.value)
            return true({">": column > value, ">=": column >= value, "<": column < value, "<=": column <= value}[node.op])
        assert isinstance(node, Box)
        return overlaps(v, node.west, node.south, node.east, node.north)

    def _array(self, node: Array, v: Value, path: tuple[str, ...], depth: int, boost: float) -> Compiled:
        if self.idf is not None:
            raise NeedsPython  # the score is that of the first matching element
        missing = self.run(node.body, Missing(), (*path, "$"), depth + 1, boost).pred
        found = v.elements()
        if found is None:
            return Compiled(missing)
        array, make = found
        if _binds_inside(node.body):
            raise NeedsPython
        if _words_inside(node.body):
            if depth:
                raise NeedsPython
            some = F.exists(_numbers(array), lambda i: self._at(node, array, make, path, i, boost))
        else:
            some = F.exists(array, lambda e: self.run(node.body, make(e), (*path, "$"), depth + 1, boost).pred)
        return Compiled(F.when(true(F.size(array) > 0), true(some)).otherwise(missing))

    def _bind(self, node: Bind, v: Value, path: tuple[str, ...], depth: int, boost: float) -> Compiled:
        array = node.array
        while isinstance(array, Boost):
            array = array.body
        if depth or isinstance(array.body, Box):
            raise NeedsPython
        found = self._array(array, v, path, depth, boost)
        elements = v.elements()
        if elements is None:
            return found
        column, make = elements
        if _words_inside(array.body):
            own = F.transform(F.filter(_numbers(column), lambda i: self._at(array, column, make, path, i, boost)), lambda i: F.get(column, i))
        else:
            own = F.filter(column, lambda e: self.run(array.body, make(e), (*path, "$"), depth + 1, boost).pred)
        return Compiled(found.pred, found.terms, {node.name: [(own, make)]})

    def _at(self, node: Array, array: Column, make: Callable[[Column], Value], path: tuple[str, ...], i: Column, boost: float) -> Column:
        """The body of an array clause about element number ``i``; its words are looked up in columns of places by that number."""
        self._element = array, make, (*path, "$"), i
        found = self.run(node.body, make(F.get(array, i)), (*path, "$"), 1, boost).pred
        self._element = None
        return found

    def _element_places(self, path: tuple[str, ...]) -> Column:
        array, make, base, i = self._element
        if path not in self._names:

            def text(e: Column) -> Column:
                v = make(e)
                for step in path[len(base) :]:
                    v = v.get(step[1:])
                return v.string()

            self._names[path] = f"__places_{len(self._names)}"
            self.places[self._names[path]] = element_places_udf(self.wanted[path], self.once)(F.transform(array, text))
        return F.get(F.col(self._names[path]), i)

    def _words(self, node: Words, v: Value, path: tuple[str, ...], depth: int, boost: float) -> Compiled:
        text = v.string()
        nothing = [F.lit(None).cast("float")] * len(node.stems) if self.idf is not None else []
        if text is None:
            return Compiled(F.lit(False), nothing)
        none = F.array().cast("array<int>")
        if path in self.placed:
            found, size = (F.col(c) for c in self.placed[path])
            places = [F.coalesce(F.try_element_at(found, F.lit(w)), none) for w in node.stems]
        else:
            if depth:
                if self._element is None or "$" in path[len(self._element[2]) :] or node.distance is not None and len(node.stems) > 2:
                    raise NeedsPython
                found = self._element_places(path)
            else:
                if path not in self._names:
                    self._names[path] = f"__places_{len(self._names)}"
                    self.places[self._names[path]] = places_udf(self.wanted[path], self.once)(text)
                found = F.col(self._names[path])
            size = found.getField("n")
            places = [F.coalesce(found.getField(f"p{self.wanted[path].index(w)}"), none) for w in node.stems]
        pred = true(placed_phrase(places) if node.distance is None else placed_near(places, node.distance))
        return self._scored(node, path, boost, pred, F.size(places[0]) if len(node.stems) == 1 else F.lit(1), size, nothing)

    def _scored(self, node: Words, path: tuple[str, ...], boost: float, pred: Column, count: Column, size: Column, nothing: list[Column]) -> Compiled:
        if self.idf is None:
            return Compiled(pred)
        f = lambda c: c.cast("float")
        idf = scored_idf(node, path, self.idf)
        # 32-bit after every step, as the evaluator counts.
        weight = F.lit(float(np.float32(idf * idf))).cast("float")
        factor = F.lit(float(np.float32(boost) * np.float32(node.boost))).cast("float")
        norm = f(F.lit(1.0) / f(F.sqrt(f(size))))
        score = f(f(f(weight * f(F.sqrt(f(count)))) * norm) * factor)
        return Compiled(pred, [F.when(pred, score), *nothing[1:]])


def _numbers(array: Column) -> Column:
    """The numbers of an array's elements."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.array().cast("array<int>"))


def _words_inside(node: Node) -> bool:
    if isinstance(node, Words):
        return True
    if isinstance(node, (And, Or)):
        return _words_inside(node.left) or _words_inside(node.right)
    return isinstance(node, (Field, Not, Boost, Array)) and _words_inside(node.body)


def _binds_inside(node: Node) -> bool:
    if isinstance(node, Bind):
        return True
    if isinstance(node, (And, Or)):
        return _binds_inside(node.left) or _binds_inside(node.right)
    return isinstance(node, (Field, Not, Boost, Array)) and _binds_inside(node.body)


def prefilters(node: Node, v: Value) -> list[Column]:
    """JVM tests that every match passes, from the word searches that must hold; they run before any tokenising."""
    if isinstance(node, And):
        return prefilters(node.left, v) + prefilters(node.right, v)
    if isinstance(node, Field):
        return prefilters(node.body, v.get(node.key))
    if isinstance(node, Boost):
        return prefilters(node.body, v)
    if isinstance(node, Words) and (text := v.string()) is not None:
        return [true(may_have(text, s)) for s in node.stems]
    return []


def split(node: Node) -> list[Node]:
    """Conjuncts over the document."""
    return split(node.left) + split(node.right) if isinstance(node, And) else [node]

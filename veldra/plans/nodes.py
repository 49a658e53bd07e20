"""The query as a tree of immutable nodes."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class All:
    """Every document."""


@dataclass(frozen=True)
class Equal:
    value: Any


@dataclass(frozen=True)
class Range:
    op: str
    value: float


@dataclass(frozen=True)
class Words:
    """Stems in one text: one word, a phrase (consecutive), or within ``distance`` words of each other."""

    stems: tuple[str, ...]
    distance: int | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class Box:
    west: float
    south: float
    east: float
    north: float


@dataclass(frozen=True)
class Field:
    key: str
    body: Node


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class Not:
    body: Node


@dataclass(frozen=True)
class Array:
    body: Node


@dataclass(frozen=True)
class Bind:
    name: str
    array: Node


@dataclass(frozen=True)
class Boost:
    body: Node
    factor: float


Node = All | Equal | Range | Words | Box | Field | And | Or | Not | Array | Bind | Boost


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Path:
    """Steps into a document (``bind`` None) or into each element bound to ``bind``: a key, an index, or None for all."""

    steps: tuple[str | int | None, ...]
    bind: str | None = None
    aggregate: str | None = None
    descending: bool = False
    separator: str = ","
    default: Any = None


@dataclass(frozen=True)
class Score:
    pass


@dataclass(frozen=True)
class Record:
    fields: tuple[tuple[str, Template], ...]


@dataclass(frozen=True)
class Sequence:
    items: tuple[Template, ...]


Template = Literal | Path | Score | Record | Sequence


@dataclass(frozen=True)
class Order:
    steps: tuple[str | int | None, ...] | None
    """None: by score."""
    descending: bool = False
    default: Any = None


@dataclass(frozen=True)
class Query:
    find: Node
    order: tuple[Order, ...]
    template: Template
    limit: int | None

    @property
    def needs_score(self) -> bool:
        return any(o.steps is None for o in self.order) or any(isinstance(x, Score) for x in leaves(self.template))


def leaves(template: Template) -> list[Literal | Path | Score]:
    if isinstance(template, Record):
        return [x for _, v in template.fields for x in leaves(v)]
    if isinstance(template, Sequence):
        return [x for v in template.items for x in leaves(v)]
    return [template]

"""Text of a query to its tree: a recursive-descent parser over the language's grammar.

Positions in messages are byte offsets. ``&&`` (or a comma) and ``||`` bind equally and group to the right.
"""

from __future__ import annotations

import json
from typing import Any

from ..errors import ParseError
from ..functions.text import stems
from .nodes import All, And, Array, Bind, Boost, Box, Equal, Field, Literal, Node, Not, Or, Order, Path, Query, Range, Record, Score, Sequence, Template, Words, leaves

_ESCAPES = {"\\": "\\", '"': '"', "/": "/", "n": "\n", "b": "\b", "r": "\r", "f": "\f", "t": "\t", "v": "\v"}
_AGGREGATES = ("group", "sum", "max_array", "max", "min_array", "min", "array_flat", "array", "concat", "avg", "count")
_BOX = "Bounding box needs to be `[west, south, east, north]`."
_NONE = object()


class Parser:
    def __init__(self, text: str, params: dict[str, Any] | None = None):
        self.text, self.at, self.params = text, 0, params or {}

    # Scanning

    def _byte(self) -> int:
        return len(self.text[: self.at].encode())

    def _space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def _sees(self, token: str) -> bool:
        return self.text.startswith(token, self.at)

    def _take(self, token: str, space: bool = True) -> bool:
        if not self._sees(token):
            return False
        self.at += len(token)
        if space:
            self._space()
        return True

    def _need(self, token: str) -> None:
        if not self._take(token):
            if self.at == len(self.text):
                raise ParseError(f"Expected '{token}' at character {self._byte()} but query string ended.")
            raise ParseError(f"Expected '{token}' at character {self._byte()}, found {self.text[self.at]}.")

    def _word(self) -> str | None:
        end = self.at
        while end < len(self.text) and (self.text[end].isalpha() or self.text[end] in "_$" or end > self.at and self.text[end].isalnum()):
            end += 1
        if end == self.at:
            return None
        word, self.at = self.text[self.at : end], end
        self._space()
        return word

    def _string(self) -> str | None:
        if not self._sees('"'):
            return None
        self.at += 1
        out = []
        while self.at < len(self.text) and self.text[self.at] != '"':
            c = self.text[self.at]
            self.at += 1
            if c != "\\":
                out.append(c)
            elif self.at < len(self.text):
                c = self.text[self.at]
                self.at += 1
                if c == "u":
                    digits = self.text[self.at : self.at + 4]
                    for d in digits:
                        if d not in "0123456789abcdefABCDEF":
                            raise ParseError(f"Invalid hexidecimal escape: {d}")
                    self.at += len(digits)
                    if len(digits) == 4:
                        out.append(chr(int(digits, 16)))
                elif c in _ESCAPES:
                    out.append(_ESCAPES[c])
                else:
                    raise ParseError(f"Unknown character escape: {c}")
        self._need('"')
        text = "".join(out)
        # A pair of surrogates is one character.
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def _need_string(self) -> str:
        text = self._string()
        if text is None:
            raise ParseError("Expected string literal.")
        return text

    def _key(self) -> str | None:
        key = self._word()
        return self._string() if key is None else key

    def _integer(self) -> int | None:
        end = self.at
        while end < len(self.text) and self.text[end] in "0123456789":
            end += 1
        if end == self.at:
            return None
        value, self.at = int(self.text[self.at : end]), end
        self._space()
        return value

    def _number(self) -> float | None:
        text, at = self.text, self.at

        def digits(at: int) -> int:
            while at < len(text) and text[at] in "0123456789":
                at += 1
            return at

        start = at
        if text[at : at + 1] == "-":
            at += 1
        end = at + 1 if text[at : at + 1] == "0" else digits(at)
        if end == at:
            if at == start:
                return None
            raise ParseError("Expected digits after sign (-).")
        if text[end : end + 1] == ".":
            at, end = end + 1, digits(end + 1)
            if end == at:
                raise ParseError("Expected digits after decimal point.")
        if text[end : end + 1] in ("e", "E"):
            at = end + 2 if text[end + 1 : end + 2] in ("+", "-") and text[end + 1 : end + 2] else end + 1
            end = digits(at)
            if end == at:
                raise ParseError("Expected exponent after e.")
        self.at = end
        self._space()
        return float(text[start:end])

    def _param(self) -> tuple[str, Any] | None:
        if not self._take("@", space=False):
            return None
        name = self._word()
        if name is None:
            raise ParseError("No parameter name after @.")
        if name not in self.params:
            raise ParseError(f"No matching parameter for @{name}.")
        return name, self.params[name]

    def _primitive(self) -> Any:
        if (text := self._string()) is not None:
            return text
        for token, value in (("true", True), ("false", False), ("null", None)):
            if self._take(token):
                return value
        if (number := self._number()) is not None:
            return number
        if param := self._param():
            return float(param[1]) if isinstance(param[1], (int, float)) and not isinstance(param[1], bool) else param[1]
        return _NONE

    def _need_primitive(self) -> Any:
        value = self._primitive()
        if value is _NONE:
            raise ParseError("Expected JSON primitive.")
        return value

    def _json(self) -> Any:
        if self._take("{"):
            out = {}
            if self._take("}"):
                return out
            while True:
                key = self._key()
                if key is None:
                    raise ParseError("Invalid json found")
                self._need(":")
                value = self._json()
                if value is _NONE:
                    raise ParseError("Invalid json found")
                out[key] = value
                if not self._take(","):
                    break
            self._need("}")
            return out
        if self._sees("["):
            return self._json_array()
        return self._primitive()

    def _json_array(self) -> list[Any]:
        self._need("[")
        out = []
        if self._take("]"):
            return out
        while True:
            value = self._json()
            if value is _NONE:
                raise ParseError("Invalid json found")
            out.append(value)
            if not self._take(","):
                break
        self._need("]")
        return out

    # Find

    def query(self) -> Query:
        self._space()
        if not self._take("find"):
            raise ParseError("Missing 'find' keyword")
        found = self._not_object()
        order = self._order()
        template = self._return()
        limit = self._limit()
        self._space()
        if self.at < len(self.text):
            raise ParseError(f"At character {self._byte()} unexpected {self.text[self.at :]}.")
        return checked(Query(found, order, template, limit))

    def _not_object(self) -> Node:
        return Not(self._object()) if self._take("!") else self._object()

    def _object(self) -> Node:
        if not self._take("{"):
            return self._parens()
        if self._take("}"):
            return All()
        left = self._boosted(self._bool(False, start="{"))
        if self._take("&&"):
            return And(left, self._not_object())
        if self._take("||"):
            return Or(left, self._not_object())
        return left

    def _parens(self) -> Node:
        if self._take("!"):
            return Not(self._parens())
        self._need("(")
        body = self._object()
        self._need(")")
        return self._boosted(body)

    def _bool(self, in_array: bool, start: str = "") -> Node:
        node = self._compare_element() if in_array else self._compare_field()
        while True:
            if self._take("&&") or self._take(","):
                node = And(node, self._bool(in_array))
            elif self._take("||"):
                node = Or(node, self._bool(in_array))
            else:
                break
        if start == "{":
            self._need("}")
        return node

    def _compare_field(self) -> Node:
        if (node := self._group(False)) is not None:
            return node
        key = self._key()
        if key is None:
            raise ParseError("Expected object key or '('")
        self._need(":")
        node = self._group(False)
        return Field(key, self._leaf() if node is None else node)

    def _compare_element(self) -> Node:
        node = self._group(True)
        return self._leaf() if node is None else node

    def _group(self, in_array: bool) -> Node | None:
        start = self.at
        if self._take("!"):
            if (node := self._group(in_array)) is not None:
                return Not(node)
            self.at = start
            return None
        if self._take("("):
            node = self._bool(in_array)
            self._need(")")
        elif self._sees("["):
            node = self._array()
        elif self._sees("{"):
            node = self._object()
        else:
            name = self._word()
            if name is None or not self._take("::"):
                self.at = start
                return None
            node = Bind(name, self._array())
        return self._boosted(node)

    def _array(self) -> Node:
        if not self._take("["):
            raise ParseError("Expected '['")
        body = self._bool(True)
        self._need("]")
        return self._boosted(Array(body))

    def _boost(self) -> float:
        if not self._take("^"):
            return 1.0
        number = self._number()
        if number is None:
            raise ParseError("Expected number after ^ symbol.")
        return number

    def _boosted(self, node: Node) -> Node:
        factor = self._boost()
        return node if factor == 1.0 else Boost(node, factor)

    def _leaf(self) -> Node:
        if (negated := self._take("!=")) or self._take("=="):
            value = self._need_primitive()
            self._boost()  # allowed, without effect
            return Not(Equal(value)) if negated else Equal(value)
        if (negated := self._take("!~=")) or self._take("~="):
            words = tuple(stems(self._text()))
            node = Words(words, None, self._boost())
            return Not(node) if negated else node
        if self._take("~"):
            distance = self._integer()
            if distance is None:
                raise ParseError("Expected integer for proximity search")
            self._need("=")
            words = tuple(stems(self._text()))
            boost = self._boost()
            if distance > 0xFFFFFFFF:
                raise ParseError("Proximity search number too large.")
            return Words(words, distance if len(words) > 1 else None, boost)
        if self._take("&&"):
            box = self._json_array()
            if len(box) != 4 or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in box):
                raise ParseError(_BOX)
            return Box(*map(float, box))
        for op in (">", "<"):
            if self._take(op):
                op += "=" if self._take("=") else ""
                value = self._need_primitive()
                if isinstance(value, bool) or not isinstance(value, (int, float)):
                    raise ParseError("Range operator on non-number JSON types is not yet implemented!")
                return Range(op, float(value))
        raise ParseError("Expected comparison operator")

    def _text(self) -> str:
        if param := self._param():
            if not isinstance(param[1], str):
                raise ParseError(f"Parameter @{param[0]} must be a string.")
            return param[1]
        return self._need_string()

    # Order, return, limit

    def _steps(self) -> tuple[str | int | None, ...] | None:
        if not self._take(".", space=False):
            return None
        if self._take("["):
            key = self._need_string()
            self._need("]")
        elif (key := self._word()) is None:
            self._space()
            return ()
        steps: list[str | int | None] = [key]
        while True:
            if self._take("["):
                index = self._integer()
                if index is not None:
                    self._need("]")
                elif not self._take("]"):
                    raise ParseError("Expected array index integer or *.")
                steps.append(index)
            elif self._take("."):
                if (key := self._word()) is None:
                    raise ParseError("Expected object key.")
                steps.append(key)
            else:
                break
        self._space()
        return tuple(steps)

    def _default(self) -> Any:
        if not self._take("default"):
            return None
        self._need("=")
        value = self._json()
        if value is _NONE:
            raise ParseError("Expected json value for default")
        return value

    def _direction(self) -> bool | None:
        return False if self._take("asc") else True if self._take("desc") else None

    def _order(self) -> tuple[Order, ...]:
        if not self._take("order"):
            return ()
        found: dict[Any, Order] = {}
        while True:
            steps = self._steps()
            if steps is not None:
                direction = self._direction()
                default = self._default()
                again = self._direction()
                direction = again if again is not None else direction
                node = Order(steps, bool(direction), default)
            else:
                for token in ("score", "(", ")"):
                    self._need(token)
                node = Order(None, bool(self._direction()))
            # A path that is named again counts where and as it was named last.
            found.pop(node.steps, None)
            found[node.steps] = node
            if not self._take(","):
                return tuple(found.values())

    def _return(self) -> Template:
        if not self._take("return"):
            return Path(("_id",))
        template = self._template()
        if template is None:
            raise ParseError("Expected key, object or array to return.")
        return template

    def _template(self) -> Template | None:
        for token, value in (("true", True), ("false", False), ("null", None)):
            if self._take(token):
                return Literal(value)
        start = self.at
        if self._take("score"):
            if self._take("("):
                self._need(")")
                return Score()
            self.at = start
        if (node := self._aggregate()) is not None:
            return node
        if (name := self._word()) is not None:
            steps = self._steps()
            return Path(steps or (), name, default=self._default())
        if (steps := self._steps()) is not None:
            return Path(steps, default=self._default())
        if self._take("{"):
            fields: dict[str, Template] = {}
            while (key := self._key()) is not None:
                self._need(":")
                value = self._template()
                if value is None:
                    raise ParseError("Expected key to return.")
                fields[key] = value
                if not self._take(","):
                    break
            self._need("}")
            return Record(tuple(fields.items()))
        if self._take("["):
            items = []
            while (value := self._template()) is not None:
                items.append(value)
                if not self._take(","):
                    break
            self._need("]")
            return Sequence(tuple(items))
        if (text := self._string()) is not None:
            return Literal(text)
        number = self._number()
        return None if number is None else Literal(number)

    def _aggregate(self) -> Path | None:
        start = self.at
        name = next((a for a in _AGGREGATES if self._take(a)), None)
        if name is None or not self._take("("):
            self.at = start
            return None
        if name == "count":
            self._need(")")
            return Path((), None, name, default=self._default())
        bind = self._word()
        steps = self._steps()
        if steps is None:
            if bind is None:
                raise ParseError("Expected keypath or bind variable")
            steps = ()
        separator, descending = ",", False
        if name == "concat":
            if self._take("sep"):
                self._need("=")
                separator = self._need_string()
        elif self._take("order"):
            self._need("=")
            direction = self._direction()
            if direction is None:
                raise ParseError("Expected asc or desc")
            if name != "group":
                raise ParseError("order= belongs to group() only")
            descending = direction
        self._need(")")
        return Path(steps, bind, name, descending, separator, self._default())

    def _limit(self) -> int | None:
        if not self._take("limit"):
            return None
        number = self._integer()
        if number is None:
            raise ParseError("limit expects an integer greater than 0")
        if number <= 0:
            raise ParseError("limit must be an integer greater than 0")
        return number


def _double_not(node: Node, negated: bool = False) -> bool:
    if isinstance(node, Not):
        return negated or _double_not(node.body, True)
    if isinstance(node, (And, Or)):
        return _double_not(node.left, negated) or _double_not(node.right, negated)
    if isinstance(node, (Field, Array, Boost)):
        return _double_not(node.body, negated)
    return isinstance(node, Bind) and _double_not(node.array, negated)


def _all_not(node: Node) -> bool:
    if isinstance(node, (And, Or)):
        return _all_not(node.left) and _all_not(node.right)
    if isinstance(node, (Field, Array, Boost)):
        return _all_not(node.body)
    if isinstance(node, Bind):
        return _all_not(node.array)
    return isinstance(node, Not)


def binds(node: Node) -> set[str]:
    if isinstance(node, Bind):
        return {node.name} | binds(node.array)
    if isinstance(node, (And, Or)):
        return binds(node.left) | binds(node.right)
    return binds(node.body) if isinstance(node, (Field, Array, Boost, Not)) else set()


def checked(query: Query) -> Query:
    if _double_not(query.find):
        raise ParseError('Logical not ("!") is nested inside of another logical not. This is not allowed.')
    if _all_not(query.find):
        raise ParseError("query cannot be made up of only logical not. Must have at least one match clause not negated.")
    found = leaves(query.template)
    aggregated = [x for x in found if isinstance(x, Path) and x.aggregate]
    if aggregated and query.order:
        raise ParseError("Cannot have aggregates and ordering in the same query")
    if aggregated and any(isinstance(x, Score) or isinstance(x, Path) and not x.aggregate for x in found):
        raise ParseError("Return keypaths must either all have aggregate functions, or none can them.")
    return query


def parameters(text: str | dict[str, Any] | None) -> dict[str, Any]:
    """Parameters of a query: an object whose values are primitives, as JSON text or as a dict."""
    if text is None:
        return {}
    if isinstance(text, str):
        try:
            text = json.loads(text)
        except ValueError as e:
            raise ParseError(f"Error parsing parameters: {e}") from e
    if not isinstance(text, dict):
        raise ParseError("Parameters must be json object")
    if any(isinstance(v, (list, dict)) for v in text.values()):
        raise ParseError("Parameterized query values must be String, Number, true, false or null")
    return text


def parse(text: str, params: str | dict[str, Any] | None = None) -> Query:
    return Parser(text, parameters(params)).query()

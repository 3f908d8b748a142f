"""The path language: from text such as ``OBX[@3.1='4711-0']-5.1`` to a frozen description.

Paths are read on the driver, once for each query. A pattern reads one hop as far as it fits; what
stands where it stopped says what is wrong. Offsets in errors are bytes of the path's UTF-8 text.

    PATH  ::= HOP { " -> " HOP }            only the last hop may have a field
    HOP   ::= SEG [ "[" INDEX "]" ] [ "-" FIELD ]
    INDEX ::= NUMBER | "$LAST" | "*" | "@" n ["." n ["." n]] OP "'" VALUE { "||" VALUE } "'"
    FIELD ::= NUMBER [ "[" NUMBER | "$LAST" | "*" "]" ] [ "." n [ "." n ] ]
"""

from __future__ import annotations

import re
from dataclasses import dataclass

ARROW = " -> "
LAST, ALL = "$LAST", "*"
MOST = 2**32 - 1

# Kinds of errors and what they say.
MESSAGES = {
    "InvalidSegmentName": "segment name must be 3 characters, alphabetic-led",
    "InvalidSegIndex": "segment index must be a number, $LAST, *, or a filter clause",
    "InvalidFieldIndex": "field number/index must be numeric, $LAST, or *",
    "InvalidOperator": "filter operator must be one of =, !=, >, >=, <, <=",
    "UnterminatedFilter": "filter clause is missing its closing quote or is otherwise malformed",
    "UnexpectedSeparator": "expected '-' or ' -> ' after the segment expression",
    "MultipleHierarchyHops": "only a single ' -> ' hierarchy hop is supported",
    "UnexpectedEnd": "PATH ended where more input was required",
    "TrailingInput": "unexpected characters after a complete PATH",
}
OPERATORS = ("=", "!=", ">", ">=", "<", "<=")


class PathError(ValueError):
    """A path that can't be read: its ``kind`` (a key of MESSAGES) and the byte ``offset`` in it."""

    def __init__(self, kind: str, path: str, at: int):
        self.kind, self.offset = kind, len(path[:at].encode())
        super().__init__(f"{MESSAGES[kind]} (offset {self.offset})")


@dataclass(frozen=True)
class Part:
    """A field, and a component and subcomponent of it where given; all numbers count from 1."""

    field: int
    component: int | None = None
    subcomponent: int | None = None


@dataclass(frozen=True)
class Filter:
    part: Part
    operator: str
    values: tuple[str, ...]

    @property
    def ordering(self) -> bool:
        return self.operator[0] in "<>"


@dataclass(frozen=True)
class Field:
    """What is taken from a segment. ``repetition``: None (not given) or ALL, LAST, or a number."""

    part: Part
    repetition: int | str | None = None


@dataclass(frozen=True)
class Hop:
    """Segments of one name. ``index``: None (not given) or ALL, LAST, a number, or a filter."""

    name: str
    index: int | str | Filter | None = None
    field: Field | None = None


@dataclass(frozen=True)
class Path:
    source: str
    hops: tuple[Hop, ...]

    @property
    def first(self) -> Hop:
        return self.hops[0]

    @property
    def last(self) -> Hop:
        return self.hops[-1]

    @property
    def has_child(self) -> bool:
        return len(self.hops) > 1


_NAME = re.compile(r"[A-Z][A-Z0-9]{2}")
_BRACKET = re.compile(r"\[([^\]]*)\]")
_DIGITS = re.compile(r"[0-9]+")
_TARGET = re.compile(r"@(?P<field>[0-9]*)(?P<dot>\.(?P<component>[0-9]*)(?P<dot2>\.(?P<subcomponent>[0-9]*))?)?[ \t]*")
_SIGNS = re.compile(r"[!<>=]*")
_QUOTED = re.compile(r"'([^']*)'")
_VALUES = re.compile(r"[A-Za-z0-9_.-]+(?:\|\|[A-Za-z0-9_.-]+)*")


def _number(path: str, at: int, digits: str, kind: str) -> int:
    if not digits or int(digits[:400]) > MOST:
        raise PathError(kind, path, at)
    return int(digits)


def _index(path: str, at: int, text: str, kind: str) -> int | str:
    """The number, LAST or ALL in brackets."""
    if text in (LAST, ALL):
        return text
    if not _DIGITS.fullmatch(text):
        raise PathError(kind, path, at)
    return _number(path, at, text, kind)


def _filter(path: str, at: int, text: str) -> Filter:
    """The filter ``text``, which stands at ``at`` in the path."""
    target = _TARGET.match(text)
    numbers = [_number(path, at + target.start(k), target[k], "InvalidSegIndex") for k in ("field", "component", "subcomponent") if target[k] is not None]
    signs = _SIGNS.match(text, target.end())
    if signs[0] not in OPERATORS:
        raise PathError("InvalidOperator", path, at + signs.start())
    quote = re.compile(r"[ \t]*").match(text, signs.end()).end()
    if not text.startswith("'", quote):
        raise PathError("UnterminatedFilter", path, at + quote)
    quoted = _QUOTED.match(text, quote)
    if quoted and quoted.end() != len(text):
        raise PathError("UnterminatedFilter", path, at + quoted.end())
    if not quoted or not _VALUES.fullmatch(quoted[1]):
        raise PathError("UnterminatedFilter", path, at + quote + 1)
    return Filter(Part(*numbers), signs[0], tuple(quoted[1].split("||")))


def _bracket(path: str, at: int, kind: str) -> tuple[str | None, int]:
    """What the brackets at ``at`` hold, if any are there, and where they end."""
    if not path.startswith("[", at):
        return None, at
    found = _BRACKET.match(path, at)
    if not found:
        raise PathError(kind, path, at)
    return found[1], found.end()


def _field(path: str, at: int) -> tuple[Field, int]:
    def number(at: int) -> tuple[int, int]:
        digits = re.compile("[0-9]*").match(path, at)
        return _number(path, at, digits[0], "InvalidFieldIndex"), digits.end()

    numbers, repetition = [], None
    n, at = number(at)
    numbers.append(n)
    text, end = _bracket(path, at, "InvalidFieldIndex")
    if text is not None:
        repetition = _index(path, at + 1, text, "InvalidFieldIndex")
    at = end
    while len(numbers) < 3 and path.startswith(".", at):
        n, at = number(at + 1)
        numbers.append(n)
    return Field(Part(*numbers), repetition), at


def _hop(path: str, at: int) -> tuple[Hop, int]:
    if at == len(path):
        raise PathError("UnexpectedEnd", path, at)
    name = _NAME.match(path, at)
    if not name:
        raise PathError("InvalidSegmentName", path, at)
    text, end = _bracket(path, name.end(), "InvalidSegIndex")
    index = None
    if text is not None:
        start = name.end() + 1
        index = _filter(path, start, text) if text.startswith("@") else _index(path, start, text, "InvalidSegIndex")
    if end < len(path) and path[end] != "-" and not path.startswith(ARROW, end):
        raise PathError("UnexpectedSeparator", path, end)
    field = None
    if path.startswith("-", end):
        if end + 1 == len(path):
            raise PathError("UnexpectedEnd", path, end + 1)
        field, end = _field(path, end + 1)
    return Hop(name[0], index, field), end


def parse(path: str, hops: str = "reject") -> Path:
    """``path`` as a Path, or a PathError. ``hops``: ``reject`` a second arrow, or take any number of them (``chain``, ``legacy``)."""
    found: list[Hop] = []
    at = 0
    while True:
        hop, at = _hop(path, at)
        found.append(hop)
        if at == len(path):
            return Path(path, tuple(found))
        arrow = path.startswith(ARROW, at)
        if arrow and len(found) > 1 and hops == "reject":
            raise PathError("MultipleHierarchyHops", path, at)
        if not arrow or hop.field is not None:
            raise PathError("TrailingInput", path, at)
        at += len(ARROW)

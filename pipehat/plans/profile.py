"""Profiles: the expected structure of a message and its fields, read on the driver.

A profile is a JSON object with ``segmentDefinition`` (segment name to ``cardinality`` and nested
``children``) and ``segmentFields`` (segment name to a list of field descriptions).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import cached_property

ROOT = 0


class CardinalityError(ValueError):
    """A cardinality that is not ``[m..n]`` or ``[m..*]`` with m up to n."""


def cardinality(text: str) -> tuple[int, int | None]:
    found = re.fullmatch(r"\[([0-9]+)\.\.([0-9]+|\*)\]", text)
    least, most = (int(found[1]), None if found[2] == "*" else int(found[2])) if found else (0, -1)
    if most is not None and most < least:
        raise CardinalityError(f"invalid cardinality {text!r}")
    return least, most


@dataclass(frozen=True)
class FieldRule:
    """What a profile says of a field. ``most_length`` and ``constant`` are null where it says nothing."""

    segment: str
    number: int
    name: str
    data_type: str
    most_length: int | None
    usage: str
    cardinality: tuple[int, int | None]
    constant: str | None


@dataclass(frozen=True)
class Profile:
    definition: dict = field(hash=False)
    fields: dict = field(default_factory=dict, hash=False)

    @staticmethod
    def of(source: dict | str) -> Profile:
        """From a parsed JSON object or its text."""
        data = json.loads(source) if isinstance(source, str) else source
        return Profile(data.get("segmentDefinition") or {}, data.get("segmentFields") or {})

    @staticmethod
    def load(path: str) -> Profile:
        with open(path, encoding="utf-8") as f:
            return Profile.of(f.read())

    @cached_property
    def transitions(self) -> dict[str, int]:
        """From ``node:NAME`` to the node that a segment of that name opens below it. Node 0 is the root."""
        found: dict[str, int] = {}
        todo = [(ROOT, self.definition)]
        while todo:
            node, children = todo.pop()
            for name, config in children.items():
                found[f"{node}:{name}"] = len(found) + 1
                todo.append((len(found), (config or {}).get("children") or {}))
        return found

    @cached_property
    def counts(self) -> dict[str, tuple[int, int | None]]:
        """The cardinality of each segment name that the definition holds, the first place in document order counting."""
        found: dict[str, tuple[int, int | None]] = {}

        def visit(children: dict) -> None:
            for name, config in children.items():
                found.setdefault(name, cardinality((config or {}).get("cardinality", "[0..*]")))
                visit((config or {}).get("children") or {})

        visit(self.definition)
        return found

    @cached_property
    def rules(self) -> list[FieldRule]:
        def one(segment: str, f: dict) -> FieldRule:
            length = f.get("maxLength")
            constant = f.get("default") or f.get("constant") or None
            return FieldRule(segment, int(f["fieldNumber"]), f.get("name", ""), f.get("dataType", ""), int(length) if length not in (None, "") else None, f.get("usage", "O"), cardinality(f.get("cardinality") or "[0..*]"), constant)

        return [one(s, f) for s, own in self.fields.items() for f in own]

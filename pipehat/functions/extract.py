"""Paths as Column expressions over an array of segments and the message's delimiters.

A segment is given as text. Values are array<array<string>>: an entry for each occurrence that the
path selects, of an entry for each repetition. Missing parts are '' and repetitions out of range leave
their occurrence out; no match is an empty array.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.path import ALL, LAST, Field, Filter, Hop, Part

QUERY_ERROR = "struct<kind:string,operator:string>"
#: No text has so many parts; beyond it, numbers need no evaluation (and don't fit Spark's int).
_FAR = 2**31 - 2
# What counts as a number in an ordering filter: no blanks, no suffixes, infinities and NaN in any case.
NUMBER = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"
TRUE, FALSE, ERROR = 1, 0, 2


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also within a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def nth(text: Column, delimiter: Column, n: int) -> Column:
    """Part ``n`` (from 1) of a text; '' for part 0 and beyond the end."""
    return F.lit("") if not 0 < n <= _FAR else F.split_part(text, delimiter, F.lit(n))


def field_text(segment: Column, name: str, n: int, d: Column) -> Column:
    """Field ``n`` of a segment. Of MSH, field 1 is the field delimiter itself and field 0 is empty; of others, field 0 is the name."""
    if name == "MSH":
        return d["field"] if n == 1 else nth(segment, d["field"], n)
    return nth(segment, d["field"], n + 1)


def sub_text(text: Column, part: Part, d: Column) -> Column:
    if part.component is None:
        return text
    text = nth(text, d["component"], part.component)
    return text if part.subcomponent is None else nth(text, d["subcomponent"], part.subcomponent)


def split_on(text: Column, delimiter: Column) -> Column:
    """All parts of a text; the delimiter is a character, not a pattern."""
    return F.split(text, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")), -1)


def selected(array: Column, index: int | str | None) -> Column:
    """The entries of an array that an index selects, as an array: all, the last, or the n-th (none if there is no such)."""
    if index is None or index == ALL:
        return array
    if index == LAST:
        return F.slice(array, F.lit(-1), F.lit(1))
    return F.slice(array, F.lit(index if 0 < index <= _FAR else _FAR), F.lit(1))


def segment_values(segment: Column, name: str, field: Field | None, d: Column) -> Column:
    """The repetitions that ``field`` takes from a segment; without a field, the segment itself."""
    if field is None:
        return F.array(segment)
    text = field_text(segment, name, field.part.field, d)
    if field.repetition is None and field.part.component is None:
        return split_on(text, d["repetition"])
    repetitions = selected(split_on(text, d["repetition"]), field.repetition)
    return repetitions if field.part.component is None else F.transform(repetitions, lambda r: sub_text(r, field.part, d))


def _compare(target: Column, operator: str, value: float) -> Column:
    return {">": target > value, ">=": target >= value, "<": target < value, "<=": target <= value}[operator]


def verdict(segment: Column, name: str, clause: Filter, d: Column) -> Column:
    """TRUE or FALSE as a segment satisfies a filter, or ERROR if it can't be judged.

    The target is the field with all its repetitions. ``!=`` holds if any value differs. In ordering
    filters, the target and each value that is reached must be numbers; values are reached in turn up to the first that holds.
    """
    target = sub_text(field_text(segment, name, clause.part.field, d), clause.part, d)
    if not clause.ordering:
        holds = target.isin(list(clause.values)) if clause.operator == "=" else F.lit(len(set(clause.values)) > 1) | (target != clause.values[0])
        return F.when(holds, TRUE).otherwise(FALSE)

    def judged(t: Column) -> Column:
        number = F.when(~F.lower(t).endswith("nan"), t.try_cast("double"))
        out = F.when(~t.rlike(NUMBER), ERROR)
        for v in clause.values:
            if not re.match(NUMBER, v):
                return out.otherwise(ERROR)
            if not math.isnan(float(v)):
                out = out.when(_compare(number, clause.operator, float(v)), TRUE)
        return out.otherwise(FALSE)

    return let(target, judged)


def no_error() -> Column:
    return F.lit(None).cast(QUERY_ERROR)


def query_error(clause: Filter) -> Column:
    return F.struct(F.lit("NonNumericComparison").alias("kind"), F.lit(clause.operator).alias("operator"))


def query_error_text(error: Column) -> Column:
    """What a QUERY_ERROR says."""
    names = {">": "Gt", ">=": "Ge", "<": "Lt", "<=": "Le"}
    name = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[error["operator"]]
    return F.when(error["kind"].isNotNull(), F.format_string("cannot apply ordering operator %s to a non-numeric operand", name))


def chosen(entries: Column, hop: Hop, d: Column, text: Callable[[Column], Column] = lambda e: e) -> tuple[Column, Column]:
    """Of ``entries`` of the hop's name, those that its index selects, and the error if its filter can't be judged.

    ``text`` gives the segment of an entry.
    """
    if not isinstance(hop.index, Filter):
        return selected(entries, hop.index), no_error()
    judge = lambda e: verdict(text(e), hop.name, hop.index, d)
    error = no_error()
    if hop.index.ordering:
        error = F.when(F.exists(entries, lambda e: judge(e) == ERROR), query_error(hop.index))
    return F.filter(entries, lambda e: judge(e) == TRUE), error


def named(lines: Column, name: str) -> Column:
    """The segments of a name, in message order."""
    return F.filter(lines, lambda s: F.startswith(s, F.lit(name)))


def values_of(entries: Column, hop: Hop, d: Column) -> Column:
    """What the hop's field takes from each segment; occurrences of which nothing is selected are left out."""
    found = F.transform(entries, lambda s: segment_values(s, hop.name, hop.field, d))
    repetition = hop.field.repetition if hop.field else None
    return found if repetition in (None, ALL, LAST) else F.filter(found, lambda v: F.size(v) > 0)


def first_value(values: Column) -> Column:
    return F.get(F.get(values, F.lit(0)), F.lit(0))


def without_empty(values: Column) -> Column:
    """``values`` without '' and without occurrences that hold nothing else; null if nothing is left."""
    left = F.filter(F.transform(values, lambda v: F.filter(v, lambda x: x != "")), lambda v: F.size(v) > 0)
    return F.when(F.size(left) > 0, left)


def decoded(text: Column, d: Column) -> Column:
    """``text`` with escape sequences replaced: delimiters, line breaks and hexadecimal bytes; highlighting marks go.

    Sequences of other kinds, and one that isn't closed, stay as they are.
    """
    parts = split_on(text, d["escape"])

    def one(code: Column, i: Column) -> Column:
        raw = F.concat(d["escape"], code, d["escape"])
        hexed = F.try_to_binary(F.substring(code, 2, 1 << 20), F.lit("hex"))
        kind = F.when(code == "F", d["field"]).when(code == "S", d["component"]).when(code == "R", d["repetition"])
        kind = kind.when(code == "E", d["escape"]).when(code == "T", d["subcomponent"]).when(code.isin("H", "N"), "").when(code == ".br", "\n")
        kind = kind.when(code.rlike("^X([0-9A-Fa-f]{2})+$"), F.decode(hexed, "ISO-8859-1")).otherwise(raw)
        open_end = (i == F.size(parts) - 1) & (i % 2 == 1)
        return F.when(i % 2 == 0, code).when(open_end, F.concat(d["escape"], code)).otherwise(kind)

    return F.array_join(F.transform(parts, one), "")

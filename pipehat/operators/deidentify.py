"""De-identification: fields replaced, hashed or removed by rules, with a report of what was done.

A rule is ``PATH,REPLACEMENT[,CONDITION]``. The replacement is a text, ``$HASH`` (the magnitude of the
value's 31-based 32-bit hash) or ``$REMOVE`` (the whole line goes). The condition is ``PATH OP VALUE`` with
``=``, ``!=``, ``IN (a;b)`` or ``!IN (a;b)``, judged on the same line if it names the same segment, and
else on the first value in the message.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract
from ..plans.path import ALL, LAST, Part, Path, parse
from .frames import _scanned, held, own_signs

HASH, REMOVE = "$HASH", "$REMOVE"


@dataclass(frozen=True)
class Condition:
    path: Path
    negated: bool
    values: tuple[str, ...]
    text: str


@dataclass(frozen=True)
class Rule:
    path: Path
    replacement: str
    condition: Condition | None = None


def rule(text: str) -> Rule:
    """A rule from its text; filters in the path may hold no commas, so commas part the three."""
    path, _, rest = text.strip().partition(",")
    replacement, _, condition = rest.partition(",")
    return Rule(parse(path.strip()), replacement.strip(), _condition(condition.strip()) if condition.strip() else None)


def _condition(text: str) -> Condition:
    tokens = text.split()
    if len(tokens) != 3 or tokens[1] not in ("=", "!=", "IN", "!IN"):
        raise ValueError(f"a condition is PATH OPERATOR VALUE, not {text!r}")
    values = (tokens[2],)
    if tokens[1].endswith("IN"):
        found = re.fullmatch(r"\(([^()]*)\)", tokens[2])
        if not found:
            raise ValueError(f"a set is (a;b), not {tokens[2]!r}")
        values = tuple(found[1].split(";"))
    return Condition(parse(tokens[0]), tokens[1].startswith("!"), values, text)


def java_hash(text: Column) -> Column:
    """The magnitude of the 31-based hash of a text's UTF-16 units, as text; the least 32-bit number stays negative."""
    units = F.encode(text, "UTF-16BE")
    whole = F.hex(units)
    unit = lambda i: F.conv(F.substr(whole, (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long")
    n = (F.length(whole) / 4).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(places, F.lit(0).cast("long"), lambda h, i: F.pmod(h * 31 + unit(i), F.lit(1 << 32)))
    signed = F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
    return F.when(signed == -(1 << 31), signed).otherwise(F.abs(signed)).cast("string")


def _put(text: Column, delimiter: Column, n: int, new: Column) -> Column:
    """``text`` with part ``n`` (from 1) replaced; as it is if there is no such part."""
    parts = extract.split_on(text, delimiter)
    joined = F.transform(parts, lambda p, i: F.concat(F.when(i == 0, "").otherwise(delimiter), F.when(i == n - 1, new).otherwise(p)))
    return F.when(F.size(parts) >= n, F.concat_ws("", joined)).otherwise(text)


def _within(text: Column, part: Part, d: Column, change) -> Column:
    """``text`` (a repetition) with the part that is named changed."""
    if part.component is None:
        return change(text)
    component = extract.nth(text, d["component"], part.component)
    new = change(component) if part.subcomponent is None else _put(component, d["subcomponent"], part.subcomponent, change(extract.nth(component, d["subcomponent"], part.subcomponent)))
    return _put(text, d["component"], part.component, new)


def _holds(condition: Condition | None, segment: Column, name: str, d: Column) -> Column:
    if condition is None:
        return F.lit(True)
    path = condition.path
    if path.first.name == name:
        value = F.coalesce(F.get(extract.segment_values(segment, name, path.last.field, d), F.lit(0)), F.lit(""))
    else:
        entries, _ = extract.chosen(extract.named(F.col("segments"), path.first.name), path.first, d)
        value = F.coalesce(extract.first_value(extract.values_of(entries, path.last, d)), F.lit(""))
    found = value.isin(list(condition.values))
    return ~found if condition.negated else found


def _changed(text: Column, r: Rule) -> Column:
    if r.replacement == HASH:
        return F.when(text == "", text).otherwise(java_hash(text))
    return F.when(text == "", text).otherwise(F.lit(r.replacement))


def _apply(entries: Column, r: Rule, d: Column) -> Column:
    """``entries`` (array of struct<line, text, gone>) after one rule."""
    name, field = r.path.first.name, r.path.last.field
    own = F.filter(entries, lambda e: F.startswith(e["text"], F.lit(name)) & ~e["gone"])
    targets = F.transform(extract.chosen(own, r.path.first, d, lambda e: e["text"])[0], lambda e: e["line"])
    hit = lambda e: F.array_contains(targets, e["line"]) & _holds(r.condition, e["text"], name, d)
    if r.replacement == REMOVE or field is None:
        whole = lambda e: F.lit("") if r.replacement == REMOVE else F.when(F.lit(r.replacement == HASH), java_hash(e["text"])).otherwise(F.lit(r.replacement))
        gone = r.replacement == REMOVE
        return F.transform(entries, lambda e: F.struct(e["line"].alias("line"), F.when(hit(e) & F.lit(not gone), whole(e)).otherwise(e["text"]).alias("text"), (e["gone"] | hit(e) & F.lit(gone)).alias("gone")))

    def rewritten(text: Column) -> Column:
        old = extract.field_text(text, name, field.part.field, d)
        repetitions = extract.split_on(old, d["repetition"])
        chosen = lambda i: F.lit(True) if field.repetition in (None, ALL) else (i == F.size(repetitions) - 1 if field.repetition == LAST else i == field.repetition - 1)
        new = F.transform(repetitions, lambda x, i: F.concat(F.when(i == 0, "").otherwise(d["repetition"]), F.when(chosen(i), _within(x, field.part, d, lambda t: _changed(t, r))).otherwise(x)))
        place = field.part.field + (name != "MSH")
        return _put(text, d["field"], place, F.concat_ws("", new))

    return F.transform(entries, lambda e: F.struct(e["line"].alias("line"), F.when(hit(e), rewritten(e["text"])).otherwise(e["text"]).alias("text"), e["gone"].alias("gone")))


def deidentify(messages: DataFrame, rules: list[str], message: str = "message", terminator: str = "\r") -> DataFrame:
    """``messages`` with ``message`` rewritten and ``redactions``: array<struct<path, field_index, rule, condition, line_number>>.

    Rules apply in turn, each to what the ones before left. Empty values stay empty and are not reported.
    MSH-1 and MSH-2 can't be redacted. Messages that don't scan are null, with null redactions.
    """
    kept = messages.columns
    d = own_signs()
    rows = _scanned(messages, message=message)
    rows = held(rows, {"__e0": F.transform("segments", lambda s, i: F.struct((i + 1).alias("line"), s.alias("text"), F.lit(False).alias("gone")))})
    reports = []
    for k, text in enumerate(rules):
        r = rule(text)
        if r.path.first.name == "MSH" and r.path.last.field is not None and r.path.last.field.part.field <= 2:
            raise ValueError("the delimiters of a message can't be redacted")
        rows = held(rows, {f"__e{k + 1}": _apply(F.col(f"__e{k}"), r, d)})
        both = F.arrays_zip(F.col(f"__e{k}").alias("a"), F.col(f"__e{k + 1}").alias("b"))
        changed = F.filter(both, lambda z: (z["a"]["text"] != z["b"]["text"]) | (z["a"]["gone"] != z["b"]["gone"]))
        index = r.path.last.field.repetition if r.path.last.field and isinstance(r.path.last.field.repetition, int) else 0
        done = {HASH: "hashed", REMOVE: "segment removed"}.get(r.replacement, f"replaced with {r.replacement}")
        reports.append(F.transform(changed, lambda z: F.struct(F.lit(r.path.source).alias("path"), F.lit(index).alias("field_index"), F.lit(done).alias("rule"), F.lit(r.condition.text if r.condition else None).cast("string").alias("condition"), z["a"]["line"].alias("line_number"))))
    final = F.filter(F.col(f"__e{len(rules)}"), lambda e: ~e["gone"])
    clean = F.array_join(F.transform(final, lambda e: e["text"]), terminator)
    empty = F.array().cast("array<struct<path:string,field_index:int,rule:string,condition:string,line_number:int>>")
    report = F.when(F.col("segments").isNotNull(), F.concat(empty, *reports))
    return rows.select(*(clean.alias(message) if c == message else F.col(c) for c in kept), report.alias("redactions"))


def redaction_report(cleaned: DataFrame, id_column: str = "message_id") -> DataFrame:
    """A row for each redaction."""
    return cleaned.select(id_column, F.explode("redactions").alias("r")).select(id_column, "r.*")

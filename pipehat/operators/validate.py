"""Validation of messages against profiles, rules and the batch envelope.

Each check gives rows of one shape: id, line (from 1; 0 for the whole message), begin_column and
end_column (of the value, or 0), path, classification (ERROR or WARNING), category, description.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract, scan as scans
from ..plans.path import parse
from ..plans.profile import FieldRule, Profile, cardinality
from ..sources.files import ENVELOPE
from .frames import _scanned, own_signs

ERROR, WARNING = "ERROR", "WARNING"
ENTRY = "struct<line:int,begin_column:int,end_column:int,path:string,classification:string,category:string,description:string>"

# What a value of a primitive HL7 data type looks like; other primitive types take any text.
TYPE_PATTERNS = {
    "NM": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$",
    "SI": r"^[0-9]{1,4}$",
    "DT": r"^[0-9]{4}((0[1-9]|1[0-2])((0[1-9]|[12][0-9]|3[01]))?)?$",
    "TM": r"^([01][0-9]|2[0-3])([0-5][0-9]([0-5][0-9](\.[0-9]{1,4})?)?)?([+-][0-9]{4})?$",
    "TS": r"^[0-9]{4}((0[1-9]|1[0-2])((0[1-9]|[12][0-9]|3[01])(([01][0-9]|2[0-3])([0-5][0-9]([0-5][0-9](\.[0-9]{1,4})?)?)?)?)?)?([+-][0-9]{4})?$",
}
TYPE_PATTERNS["DTM"] = TYPE_PATTERNS["TS"]


def _entry(line: Column, path: Column, category: str, description: Column, classification: str = ERROR, begin: Column | None = None, length: Column | None = None) -> Column:
    begin = F.lit(0) if begin is None else begin
    end = begin if length is None else begin + length
    return F.struct(
        line.cast("int").alias("line"), begin.cast("int").alias("begin_column"), end.cast("int").alias("end_column"), path.alias("path"),
        F.lit(classification).alias("classification"), F.lit(category).alias("category"), description.alias("description"),
    )


def _rows(df: DataFrame, id_column: str, entries: Column) -> DataFrame:
    return df.select(id_column, F.explode(entries).alias("e")).where("e is not null").select(id_column, "e.*")


def scan_errors(messages: DataFrame, id_column: str = "message_id", message: str = "message") -> DataFrame:
    """An INVALID_MESSAGE row for each message that doesn't scan."""
    return _rows(_scanned(messages, message=message).where("scan_error is not null"), id_column, _scan_entries())


def _scan_entries() -> Column:
    line = F.coalesce(F.col("scan_error.segment_index") + 1, F.lit(1))
    return F.array(_entry(line, F.lit("MSH"), "INVALID_MESSAGE", scans.scan_error_text(F.col("scan_error"))).cast(ENTRY))


def segment_cardinality(messages: DataFrame, profile: Profile, id_column: str = "message_id") -> DataFrame:
    """Segments that a profile wants more or less often, counted over the whole message, and those it doesn't know."""
    return _rows(_scanned(messages).where("segments is not null"), id_column, _cardinality_entries(profile))


def _cardinality_entries(profile: Profile) -> Column:
    entries = []
    for name, (least, most) in profile.counts.items():
        n = F.size(extract.named(F.col("segments"), name))
        wanted = f"[{least}..{'*' if most is None else most}]"
        bad = (n < least) if most is None else (n < least) | (n > most)
        entries.append(F.when(bad, _entry(F.lit(0), F.lit(name), "INVALID_CARDINALITY", F.format_string(f"segment {name} occurs %d times; expected {wanted}", n))))
    known = list(profile.counts)
    strange = F.transform(
        F.filter(F.transform("segments", lambda s, i: F.struct(i.alias("i"), F.substring(s, 1, 3).alias("name"))), lambda e: ~e["name"].isin(known)),
        lambda e: _entry(e["i"] + 1, e["name"], "INVALID_SEGMENT", F.concat(F.lit("segment "), e["name"], F.lit(" is not part of the profile")), WARNING),
    )
    return F.concat(F.array(*entries).cast(f"array<{ENTRY}>"), strange.cast(f"array<{ENTRY}>"))


def check_segment_cardinality(messages: DataFrame, name: str, text: str, id_column: str = "message_id") -> DataFrame:
    """``segment_cardinality`` of one segment and a cardinality such as ``[0..1]``."""
    cardinality(text)
    found = segment_cardinality(messages, Profile.of({"segmentDefinition": {name: {"cardinality": text}}}), id_column)
    return found.where("category = 'INVALID_CARDINALITY'")


def _is(kind: str, value: Column) -> Column:
    """Whether a value is of a primitive type; a date must be a day of the calendar."""
    good = value.rlike(TYPE_PATTERNS[kind])
    if kind in ("DT", "TS", "DTM"):
        good = good & ((F.length(value) < 8) | ~value.rlike("^[0-9]{8}") | F.try_to_timestamp(F.substring(value, 1, 8), F.lit("yyyyMMdd")).isNotNull())
    return good


def _not(kind: str):
    return lambda x: (x["value"] != "") & ~_is(kind, x["value"])


def _longer(most: int):
    return lambda x: F.length(x["value"]) > most


def _text(s: Column, segment: str, number: int, d: Column) -> Column:
    """Field ``number`` of a segment struct <line, occurrence, text, fields>."""
    if segment == "MSH":
        return d["field"] if number == 1 else F.lit("") if number < 1 else F.coalesce(F.get(s["fields"], F.lit(number - 1)), F.lit(""))
    return F.coalesce(F.get(s["fields"], F.lit(number)), F.lit(""))


def _field_entries(rule: FieldRule, profile: Profile, s: Column, d: Column, condition: Column | None) -> Column:
    """What is wrong with one field of a segment struct <line, occurrence, text, fields>, as an array with nulls for what is right.

    The field and its repetitions are taken once; paths and places are made only for what is wrong.
    """
    delimiters_field = rule.segment == "MSH" and rule.number <= 2
    text = _text(s, rule.segment, rule.number, d)
    repetitions = F.array(text) if delimiters_field else extract.split_on(text, d["repetition"])
    label = f"{rule.segment}-{rule.number} {rule.name}".strip()
    # the column at which the field starts: what comes before it and the delimiter
    before = F.array_join(F.slice(s["fields"], F.lit(1), F.lit(rule.number - (rule.segment == "MSH") or 1)), "|")
    begin = F.length(before) + 2 if rule.number > (rule.segment == "MSH") else F.lit(1)

    def entries(v: Column) -> Column:
        own, parts = v["text"], v["repetitions"]
        path = F.concat(F.lit(f"{rule.segment}["), s["occurrence"].cast("string"), F.lit(f"]-{rule.number}"))
        entry = lambda category, said, kind=ERROR: _entry(s["line"], path, category, said if isinstance(said, Column) else F.lit(said), kind, begin, F.length(own))
        empty = own == ""
        out = []
        if rule.usage == "R":
            out.append(F.when(empty, entry("INVALID_USAGE", f"{label} is required")))
        elif rule.usage == "RE":
            out.append(F.when(empty, entry("INVALID_USAGE", f"{label} is required if known", WARNING)))
        elif rule.usage == "X":
            out.append(F.when(~empty, entry("INVALID_USAGE", f"{label} is not used", WARNING)))
        elif condition is not None:
            out.append(F.when(empty & condition, entry("INVALID_USAGE", f"{label} is required: {rule.usage}")))
        least, most = rule.cardinality
        n = F.when(empty, 0).otherwise(F.size(parts))
        bad = (n < least) & ~empty if most is None else (n > most) | (n < least) & ~empty
        if least > 1 or most is not None:
            out.append(F.when(bad, entry("INVALID_CARDINALITY", F.format_string(f"{label} has %d repetitions", n))))
        if rule.data_type in TYPE_PATTERNS:
            out.append(F.when(F.exists(parts, lambda r: (r != "") & ~_is(rule.data_type, r)), entry("INVALID_FIELD_TYPE", f"{label} is not a valid {rule.data_type}")))
        if rule.most_length is not None:
            out.append(F.when(F.exists(parts, lambda r: F.length(r) > rule.most_length), entry("INVALID_FIELD_LENGTH", f"{label} is longer than {rule.most_length}")))
        if rule.constant is not None:
            out.append(F.when(~empty & F.exists(parts, lambda r: r != rule.constant), entry("INVALID_DEFAULT_VALUE", f"{label} is not {rule.constant}")))
        for number, part, values in _components(rule, profile, parts, d):
            whole = F.concat(path, F.lit(f".{number}"))
            said = f"{rule.segment}-{rule.number}.{number} {part.name}".strip()
            inner = lambda category, what, whole=whole: _entry(s["line"], whole, category, F.lit(what))
            if part.usage == "R":
                out.append(F.when(F.exists(values, lambda x: x["within"] & (x["value"] == "")), inner("INVALID_USAGE", f"{said} is required")))
            if part.data_type in TYPE_PATTERNS:
                out.append(F.when(F.exists(values, _not(part.data_type)), inner("INVALID_FIELD_TYPE", f"{said} is not a valid {part.data_type}")))
            if part.most_length is not None:
                out.append(F.when(F.exists(values, _longer(part.most_length)), inner("INVALID_FIELD_LENGTH", f"{said} is longer than {part.most_length}")))
        return F.array(*(x.cast(ENTRY) for x in out)) if out else F.array().cast(f"array<{ENTRY}>")

    return extract.let(F.struct(text.alias("text"), repetitions.alias("repetitions")), entries)


def _components(rule: FieldRule, profile: Profile, repetitions: Column, d: Column) -> list[tuple[str, FieldRule, Column]]:
    """(number, rule, array<struct<value, within>>) of the components of a composite type that the profile describes under ``segmentFields`` by the type's name,
    and of the subcomponents where those are composite themselves; ``within`` says that what holds them is not empty. There are no levels below."""
    out = []
    each = lambda value, holder: F.transform(repetitions, lambda r: F.struct(value(r).alias("value"), (holder(r) != "").alias("within")))
    nth = lambda of, sign, k: lambda r: extract.nth(of(r), d[sign], k)
    whole = lambda r: r
    for part in (r for r in profile.rules if r.segment == rule.data_type):
        component = nth(whole, "component", part.number)
        out.append((str(part.number), part, each(component, whole)))
        for inner in (r for r in profile.rules if r.segment == part.data_type):
            out.append((f"{part.number}.{inner.number}", inner, each(nth(component, "subcomponent", inner.number), component)))
    return out


def _condition(rule: FieldRule, s: Column, d: Column) -> Column | None:
    """The condition in a usage ``C(3)`` or ``C(3!=)``: the field of that number in the same segment is given (or is not)."""
    import re

    found = re.fullmatch(r"C\(\s*([0-9]+)\s*(=?)\s*\)", rule.usage)
    if not found:
        return None
    other = _text(s, rule.segment, int(found[1]), d)
    return other == "" if found[2] else other != ""


def field_checks(messages: DataFrame, profile: Profile, id_column: str = "message_id") -> DataFrame:
    """Usage, repetitions, data type, length and constant of each field that a profile's ``segmentFields`` describes."""
    rows = _scanned(messages).where("segments is not null")
    return _rows(rows, id_column, _field_checks(profile))


def _field_checks(profile: Profile) -> Column:
    """What is wrong with the fields of a ``_scanned`` frame's segments."""
    d = own_signs()
    entries = [F.array().cast(f"array<{ENTRY}>")]
    for name in dict.fromkeys(r.segment for r in profile.rules if len(r.segment) == 3 and r.segment[0].isalpha()):
        lines = F.filter(F.transform("segments", lambda s, i: F.struct((i + 1).alias("line"), s.alias("text"))), lambda e: F.startswith(e["text"], F.lit(name)))
        own = F.transform(lines, lambda e, i: F.struct(e["line"].alias("line"), (i + 1).alias("occurrence"), e["text"].alias("text"), extract.split_on(e["text"], d["field"]).alias("fields")))
        rules = [r for r in profile.rules if r.segment == name]
        entries.append(F.flatten(F.transform(own, lambda s: F.filter(F.flatten(F.array(*(_field_entries(r, profile, s, d, _condition(r, s, d)) for r in rules))), lambda e: e.isNotNull()))))
    return F.concat(*entries)


def validate_structure(messages: DataFrame, profile: Profile, fields: Profile | None = None, id_column: str = "message_id") -> DataFrame:
    """All of ``scan_errors``, ``segment_cardinality`` and ``field_checks``; field descriptions may come from another profile."""
    rows = _scanned(messages)
    whole = F.concat(_cardinality_entries(profile), _field_checks(fields or profile))
    return _rows(rows, id_column, F.when(F.col("scan_error").isNotNull(), _scan_entries()).otherwise(whole))


def load_rules(source: str | dict) -> dict[str, list[dict]]:
    """``predicates`` and ``conformance`` of a rules document (parsed, or its JSON text)."""
    data = json.loads(source) if isinstance(source, str) else source
    return {k: list(data.get("rules", {}).get(k) or []) for k in ("predicates", "conformance")}


def _located(path: str, d: Column) -> Column:
    """array<struct<line, occurrence, values>> of the segments that a path names, all of them."""
    plan = parse(path)
    lines = F.filter(F.transform("segments", lambda s, i: F.struct((i + 1).alias("line"), s.alias("text"))), lambda e: F.startswith(e["text"], F.lit(plan.first.name)))
    lines = F.transform(lines, lambda e, i: F.struct(e["line"].alias("line"), (i + 1).alias("occurrence"), extract.segment_values(e["text"], plan.first.name, plan.last.field, d).alias("values"), e["text"].alias("text")))
    return extract.chosen(lines, plan.first, d, lambda e: e["text"])[0]


def _given(values: Column) -> Column:
    return F.exists(values, lambda v: v != "")


def predicate_errors(messages: DataFrame, rules: list[dict], id_column: str = "message_id") -> DataFrame:
    """Fields that are empty although another, in the same occurrence of the segment, is empty (requiredIfEmpty) or given (requiredIfNotEmpty)."""
    rows = _scanned(messages).where("segments is not null")
    d = own_signs()
    entries = []
    for rule in rules:
        if rule["name"] not in ("requiredIfEmpty", "requiredIfNotEmpty"):
            raise ValueError(f"unknown predicate {rule['name']!r}")
        other = parse(rule["reference"])
        same = other.first.name == parse(rule["field"]).first.name

        def wrong(e: Column) -> Column:
            there = _given(extract.segment_values(e["text"], other.first.name, other.last.field, d)) if same else F.exists(_located(rule["reference"], d), lambda x: _given(x["values"]))
            due = ~there if rule["name"] == "requiredIfEmpty" else there
            path = F.concat(F.lit(f"{parse(rule['field']).first.name}["), e["occurrence"].cast("string"), F.lit(f"]-{rule['field'].partition('-')[2]}"))
            return F.when(due & ~_given(e["values"]), _entry(e["line"], path, "INVALID_PREDICATE", F.lit(rule.get("description") or f"{rule['field']}: {rule['name']} {rule['reference']}")).cast(ENTRY))

        entries.append(F.transform(_located(rule["field"], d), wrong))
    return _rows(rows, id_column, F.concat(*entries) if entries else F.array(F.lit(None).cast(ENTRY)))


def conformance_errors(messages: DataFrame, rules: list[dict], id_column: str = "message_id") -> DataFrame:
    """Values that don't match a pattern (regEx) or aren't a constant, and fields not given exactly once in the message (existsUnique)."""
    rows = _scanned(messages).where("segments is not null")
    d = own_signs()
    entries = []
    for rule in rules:
        said = F.lit(rule.get("description") or f"{rule['field']}: {rule['name']} {rule.get('reference', '')}")
        found = _located(rule["field"], d)
        if rule["name"] == "existsUnique":
            n = F.size(F.filter(F.flatten(F.transform(found, lambda e: e["values"])), lambda v: v != ""))
            entries.append(F.array(F.when(n != 1, _entry(F.lit(0), F.lit(rule["field"]), "INVALID_CONFORMANCE", said).cast(ENTRY))))
            continue
        if rule["name"] not in ("regEx", "constant"):
            raise ValueError(f"unknown conformance rule {rule['name']!r}")
        good = (lambda v: v.rlike(f"^(?:{rule['reference']})$")) if rule["name"] == "regEx" else (lambda v: v == rule["reference"])
        path = lambda e: F.concat(F.lit(f"{parse(rule['field']).first.name}["), e["occurrence"].cast("string"), F.lit(f"]-{rule['field'].partition('-')[2]}"))
        entries.append(F.transform(found, lambda e: F.when(F.exists(e["values"], lambda v: ~good(v)), _entry(e["line"], path(e), "INVALID_CONFORMANCE", said).cast(ENTRY))))
    return _rows(rows, id_column, F.concat(*entries) if entries else F.array(F.lit(None).cast(ENTRY)))


def batch_errors(files: DataFrame, id_column: str = "message_id", column: str = "message") -> DataFrame:
    """What is wrong with the envelope of a batch file: missing, repeated or misplaced FHS, BHS, BTS and FTS, the count in BTS-1, and no MSH at all."""
    text = F.regexp_replace(column, "[\r\n]+$", "")
    lines = F.filter(F.split(text, "\r\n|\r|\n", -1), lambda s: s != "")
    rows = files.select(id_column, lines.alias("lines"))
    names = F.transform("lines", lambda s: F.substring(s, 1, 3))
    rows = rows.withColumn("names", names)
    count = lambda name: F.size(F.filter("names", lambda x: x == name))
    place = lambda name: F.array_position("names", name)
    any_ = F.arrays_overlap("names", F.array(*map(F.lit, ENVELOPE)))
    last = F.size("lines")
    entry = lambda line, name, category, said: _entry(line, F.lit(name), category, said if isinstance(said, Column) else F.lit(said)).cast(ENTRY)
    entries = [F.when(any_ & (count(n) == 0), entry(F.lit(0), n, "INVALID_BATCH_SEGMENTS", f"the batch has no {n}")) for n in ENVELOPE]
    entries += [F.when(count(n) > 1, entry(place(n), n, "DUPLICATE_SEGMENT", f"the batch has more than one {n}")) for n in ENVELOPE]
    has = {n: count(n) > 0 for n in ENVELOPE}
    entries.append(F.when(has["FHS"] & (place("FHS") != 1), entry(place("FHS"), "FHS", "INVALID_FILE_HEADER_SEGMENT", "FHS is not the first line")))
    due = F.when(has["FHS"], place("FHS") + 1).otherwise(1)
    entries.append(F.when(has["BHS"] & (place("BHS") != due), entry(place("BHS"), "BHS", "INVALID_BATCH_SEGMENT", "BHS does not follow the file header or start the batch")))
    entries.append(F.when(has["FTS"] & (place("FTS") != last), entry(place("FTS"), "FTS", "INVALID_BATCH_SEGMENT", "FTS is not the last line")))
    entries.append(F.when(has["BTS"] & (place("BTS") != F.when(has["FTS"], last - 1).otherwise(last)), entry(place("BTS"), "BTS", "INVALID_BATCH_SEGMENT", "BTS does not end the batch")))
    said = F.split_part(F.get("lines", (place("BTS") - 1).cast("int")), F.lit("|"), F.lit(2))
    entries.append(F.when(has["BTS"] & ~said.eqNullSafe(count("MSH").cast("string")), entry(place("BTS"), "BTS", "INVALID_BATCH_SEGMENT", F.format_string("BTS-1 says %s messages; there are %d", said, count("MSH")))))
    entries.append(F.when(count("MSH") == 0, entry(F.lit(0), "MSH", "INVALID_MESSAGE", "there is no message")))
    return _rows(rows, id_column, F.array(*entries))


def totals(errors: DataFrame, id_column: str = "message_id") -> DataFrame:
    """(id, n_errors, n_warnings) of the messages that have any."""
    count = lambda kind: F.count_if(F.col("classification") == kind)
    return errors.groupBy(id_column).agg(count(ERROR).alias("n_errors"), count(WARNING).alias("n_warnings"))

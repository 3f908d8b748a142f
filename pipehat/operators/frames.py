"""Messages as DataFrames: scanned, queried by path, and in long form.

A messages frame has a ``message`` column (and any others, which are kept). ``scan`` adds
``delimiters``, ``segments`` and ``scan_error``; ``query`` adds a column of values for each path and one
for its errors. Bad messages are rows with an error and null values; nothing is raised unless
``on_error="failfast"``. All of it is projections of built-in functions: no shuffle and no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract, hierarchy, scan as scans
from ..plans.path import Path, PathError, parse
from ..plans.profile import Profile

SCANNED = ("delimiters", "segments", "scan_error")


def held(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with more columns, each evaluated once.

    They come from a generator, as filters aren't pushed below one: the optimiser would write such long
    expressions into each filter above, and again into one another.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))) if columns else df


def scan(messages: DataFrame, message: str = "message", strict_msh2: bool = False, on_error: str = "capture") -> DataFrame:
    """``messages`` with delimiters, segments (array of text) and scan_error; the first two are null where the third isn't."""
    if on_error not in ("capture", "failfast"):
        raise ValueError(f"unknown on_error {on_error!r}")
    text = F.col(message)
    rows = held(messages.drop(*SCANNED), {"__lines": scans.segments(text)})
    rows = held(rows, {"scan_error": scans.scan_error(text, F.col("__lines"), strict_msh2)})
    good = F.col("scan_error").isNull() & text.isNotNull()
    segments = F.when(good, F.col("__lines"))
    if on_error == "failfast":
        said = F.raise_error(scans.scan_error_text(F.col("scan_error"))).cast("array<string>")
        segments = F.when(F.col("scan_error").isNotNull(), said).otherwise(segments)
    return rows.withColumns({"delimiters": F.when(good, scans.delimiters(text)), "segments": segments}).drop("__lines")


def _scanned(df: DataFrame, **options) -> DataFrame:
    """``df`` scanned if it isn't, with its delimiters as a text for ``own_signs``."""
    rows = df if set(SCANNED) <= set(df.columns) else scan(df, **options)
    return held(rows.drop("__signs"), {"__signs": scans.signs(F.col("delimiters"))})


def own_signs() -> scans.Signs:
    """The delimiters of a ``_scanned`` frame."""
    return scans.Signs(F.col("__signs"))


def query(
    messages: DataFrame,
    paths: dict[str, str],
    *,
    profile: Profile | None = None,
    build_hierarchy: bool = True,
    hops: str = "reject",
    child_index: str = "legacy",
    remove_empty: bool = False,
    decode_escapes: bool = False,
    on_error: str = "capture",
    message: str = "message",
    strict_msh2: bool = False,
) -> DataFrame:
    """``messages`` with, for each name in ``paths``, ``<name>`` (array<array<string>>) and ``<name>_error``.

    Paths are read first, and a bad one raises a PathError before any job. Values are null where the
    message has a scan error or the path a query error. A path with an arrow needs a profile: without one,
    or without ``build_hierarchy``, its values are null. ``hops`` says what a second arrow means: an error
    (``reject``), null values (``legacy``) or a further step (``chain``). ``child_index`` counts children
    from 0 among all names (``legacy``) or from 1 among the name's own below each parent (``per_parent``).
    ``remove_empty`` drops '' and gives null if nothing is left; ``decode_escapes`` replaces escape sequences.

    The message is split once for all paths, and the segments of one name are picked once for all paths over it.
    """
    if hops not in ("reject", "legacy", "chain") or child_index not in ("legacy", "per_parent"):
        raise ValueError("unknown hops or child_index")
    plans = {name: parse(p, hops) for name, p in paths.items()}
    kept = messages.columns
    rows = _scanned(messages, message=message, strict_msh2=strict_msh2, on_error=on_error)
    extra = [c for c in rows.columns if c not in kept]
    lines, d = F.col("segments"), own_signs()

    down = {n: p for n, p in plans.items() if p.has_child and profile is not None and build_hierarchy and (len(p.hops) == 2 or hops == "chain")}
    flat = {n: p for n, p in plans.items() if not p.has_child}
    picked = {name: f"__{name}" for name in sorted({p.first.name for p in flat.values()})}
    rows = held(rows, {c: extract.named(lines, name) for name, c in picked.items()})
    if down:
        rows = held(rows, {"__parents": hierarchy.parents(lines, profile)})
        rows = held(rows, {"__nodes": hierarchy.placed(lines, F.col("__parents"))})

    def column(name: str, p: Path) -> list[Column]:
        if name in down:
            values, error = hierarchy.hierarchy_values(F.col("__nodes"), p, d, child_index == "per_parent")
        elif p.has_child:
            values, error = F.lit(None).cast("array<array<string>>"), extract.no_error()
        else:
            entries, error = extract.chosen(F.col(picked[p.first.name]), p.first, d)
            values = extract.values_of(entries, p.last, d)
        if decode_escapes:
            values = F.transform(values, lambda v: F.transform(v, lambda x: extract.decoded(x, d)))
        if remove_empty:
            values = extract.without_empty(values)
        if any(getattr(h.index, "ordering", False) for h in p.hops):
            if on_error == "failfast":
                values = F.when(error.isNotNull(), F.raise_error(extract.query_error_text(error)).cast("array<array<string>>")).otherwise(values)
            values = F.when(error.isNull(), values)
        return [values.alias(name), error.alias(f"{name}_error")]

    new = {c for name in plans for c in (name, f"{name}_error")}
    keep = [F.col(c) for c in [*kept, *(c for c in extra if c == "scan_error")] if c not in new]
    return rows.select(*keep, *(c for name, p in plans.items() for c in column(name, p)))


def get_value(messages: DataFrame, path: str, **options) -> DataFrame:
    """``query`` of one path, as ``values`` and ``values_error``."""
    return query(messages, {"values": path}, **options)


def get_first_value(messages: DataFrame, path: str, **options) -> DataFrame:
    """The first repetition of the first occurrence as ``value`` (null if there is none), and ``values_error``."""
    rows = get_value(messages, path, **options)
    return rows.withColumn("value", extract.first_value(F.col("values"))).drop("values")


def values_long(messages: DataFrame, paths: dict[str, str], id_column: str = "message_id", **options) -> DataFrame:
    """(id, path, occurrence, repetition, value): a row for each value; occurrence and repetition count from 1 in the result."""
    rows = query(messages, paths, **options)
    every = [F.struct(F.lit(name).alias("path"), F.col(name).alias("values")) for name in paths]
    rows = rows.select(id_column, F.explode(F.array(*every)).alias("q"))
    rows = rows.select(id_column, F.col("q.path").alias("path"), F.posexplode("q.values").alias("o", "v"))
    rows = rows.select(id_column, "path", (F.col("o") + 1).alias("occurrence"), F.posexplode("v").alias("r", "value"))
    return rows.select(id_column, "path", "occurrence", (F.col("r") + 1).alias("repetition"), "value")


def located_values(
    messages: DataFrame, path: str, id_column: str = "message_id", *, profile: Profile | None = None, build_hierarchy: bool = True, hops: str = "reject", child_index: str = "legacy", **options
) -> DataFrame:
    """(id, line_number, occurrence, repetition, value): values with their segment's line, from 1.

    Paths with arrows need a profile, and have no rows without one or without ``build_hierarchy``; ``hops`` and ``child_index`` as in ``query``.
    """
    plan = parse(path, hops)
    rows = _scanned(messages, **options)
    d = own_signs()
    if plan.has_child:
        if profile is None or not build_hierarchy or (len(plan.hops) > 2 and hops != "chain"):
            rows = rows.where("false")
        rows = held(rows, {"__parents": hierarchy.parents(F.col("segments"), profile or Profile({}))})
        rows = held(rows, {"__entries": hierarchy.placed(F.col("segments"), F.col("__parents"))})
        found, error = hierarchy.reached(F.col("__entries"), plan, d, child_index == "per_parent")
        line = lambda e: e["index"] + 1
    else:
        entries = F.filter(F.transform("segments", lambda s, i: F.struct((i + 1).alias("line"), s.alias("text"))), lambda e: F.startswith(e["text"], F.lit(plan.first.name)))
        rows = held(rows, {"__entries": entries})
        found, error = extract.chosen(F.col("__entries"), plan.first, d, lambda e: e["text"])
        line = lambda e: e["line"]
    found = F.transform(found, lambda e: F.struct(line(e).alias("line"), extract.segment_values(e["text"], plan.last.name, plan.last.field, d).alias("v")))
    rows = rows.where(error.isNull()).select(id_column, F.filter(found, lambda e: F.size(e["v"]) > 0).alias("f"))
    rows = rows.select(id_column, F.posexplode("f").alias("o", "e"))
    return rows.select(id_column, F.col("e.line").alias("line_number"), (F.col("o") + 1).alias("occurrence"), F.posexplode("e.v").alias("r", "value")).select(
        id_column, "line_number", "occurrence", (F.col("r") + 1).alias("repetition"), "value"
    )


def segments_long(messages: DataFrame, id_column: str = "message_id", profile: Profile | None = None, with_spans: bool = False, message: str = "message") -> DataFrame:
    """A row for each segment: id, segment_index (from 0), line_number (from 1), name, occurrence (from 1, by name), raw.

    With a profile also parent_index (-1 below the root, null outside the tree), and on request the
    bytes ``start`` and ``end``. Messages with a scan error have no rows.
    """
    rows = _scanned(messages, message=message)
    parts = {"raw": F.col("segments")}
    if profile is not None:
        parts["parent_index"] = hierarchy.parents(F.col("segments"), profile)
    if with_spans:
        parts["span"] = scans.spans(F.col(message), F.col("segments"))
    # the occurrence is counted within the message's own array, so that no shuffle is needed
    names = F.transform("segments", lambda s: F.substring(s, 1, 3))
    rows = rows.select(id_column, "segments", names.alias("__names"), *(c.alias(f"__{k}") for k, c in parts.items()))
    occurrence = F.transform("__names", lambda n, i: F.size(F.filter(F.slice("__names", F.lit(1), i + 1), lambda x: x == n)))
    zipped = F.arrays_zip(F.col("__names").alias("name"), occurrence.alias("occurrence"), *(F.col(f"__{k}").alias(k) for k in parts))
    rows = rows.where(F.col("segments").isNotNull()).select(id_column, F.posexplode(zipped).alias("segment_index", "z"))
    out = [id_column, "segment_index", (F.col("segment_index") + 1).alias("line_number"), "z.name", "z.occurrence", "z.raw"]
    out += ["z.parent_index"] if profile is not None else []
    out += ["z.span.start", "z.span.end"] if with_spans else []
    return rows.select(*out)


def delimiter_occurrences(messages: DataFrame, id_column: str = "message_id", message: str = "message") -> DataFrame:
    """(id, segment_index, offset, kind): each delimiter byte of each segment, those that define the delimiters included."""
    rows = _scanned(messages, message=message)
    rows = rows.select(id_column, "__signs", F.posexplode(F.arrays_zip(F.col("segments").alias("raw"), scans.spans(F.col(message), F.col("segments")).alias("span"))).alias("segment_index", "z"))
    rows = rows.select(id_column, "__signs", "segment_index", F.col("z.span.start").alias("start"), F.posexplode(F.split(scans.byte_view(F.col("z.raw")), "")).alias("at", "byte"))
    kind = scans.delimiter_kind(F.col("byte"), own_signs())
    return rows.select(id_column, "segment_index", (F.col("start") + F.col("at")).alias("offset"), kind.alias("kind")).where("kind is not null")


# Segments by name, over a scanned frame's ``segments``.


def peek(name: str) -> Column:
    """How many segments of a name there are."""
    return F.size(extract.named(F.col("segments"), name))


def _entry(name: str) -> Column:
    lines = F.transform("segments", lambda s, i: F.struct((i + 1).alias("line_number"), s.alias("raw")))
    own = F.filter(lines, lambda e: F.startswith(e["raw"], F.lit(name)))
    return F.transform(own, lambda e: F.struct(e["line_number"].alias("line_number"), extract.split_on(e["raw"], F.col("delimiters")["field"]).alias("fields")))


def retrieve_multiple_segments(name: str) -> Column:
    """A map from line number (from 1) to the fields of each segment of a name."""
    return F.map_from_entries(_entry(name))


def retrieve_segment(name: str) -> Column:
    """struct<line_number, fields, error>: the only segment of a name; an error text if there is none or another."""
    found = _entry(name)
    one = F.size(found) == 1
    error = F.when(F.size(found) == 0, f"segment {name} not found").when(F.size(found) > 1, f"segment {name} found more than once")
    return F.struct(F.when(one, F.get(found, F.lit(0))["line_number"]).alias("line_number"), F.when(one, F.get(found, F.lit(0))["fields"]).alias("fields"), error.alias("error"))


def retrieve_first_segment(name: str) -> Column:
    """struct<line_number, fields, error>: the first segment of a name; an error text if there is none."""
    first = F.get(_entry(name), F.lit(0))
    return F.struct(first["line_number"].alias("line_number"), first["fields"].alias("fields"), F.when(first.isNull(), f"segment {name} not found").alias("error"))


def split_fields(segment: Column, field: int, delimiters: Column) -> Column:
    """struct<parts, error>: the components of a field of a segment line; an error text if the line has no such field."""
    fields = extract.split_on(segment, delimiters["field"])
    text = F.get(fields, F.lit(field))
    return F.struct(F.when(text.isNotNull(), extract.split_on(text, delimiters["component"])).alias("parts"), F.when(text.isNull(), f"field {field} not found").alias("error"))


def segment_value(segment: Column, path: str, delimiters: Column, remove_empty: bool = False) -> Column:
    """What a path's field takes from one segment line of its name; null from lines of other names."""
    plan = parse(path)
    values = extract.segment_values(segment, plan.first.name, plan.last.field, delimiters)
    if remove_empty:
        left = F.filter(values, lambda x: x != "")
        values = F.when(F.size(left) > 0, left)
    return F.when(F.startswith(segment, F.lit(plan.first.name)), values)


def rendered(values: Column) -> Column:
    """One line for each entry of a result, ``[i] a ~ b``."""
    return F.transform(values, lambda v, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.array_join(v, " ~ ")))

"""Columns that take a raw HL7 v2 message apart: delimiters, segments and structural errors.

Everything is built from Spark's own functions; nothing is raised for a bad message, which is a
value of ``scan_error`` instead. Offsets count bytes of the message's UTF-8 text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELIMITERS = ("field", "component", "repetition", "escape", "subcomponent")
TERMINATOR = "\r\n|\r|\n"
NAME = "^[A-Z][A-Z0-9]{2}"
SCAN_ERROR = "struct<kind:string,offset:bigint,segment_index:int>"

# What scan errors say.
SCAN_MESSAGES = {
    "MissingMsh": "message does not start with a valid MSH segment (offset %d)",
    "TruncatedMsh": "MSH segment is truncated before MSH-2 completes (offset %d)",
    "UnrecognizedSegment": "segment %d at offset %d has an unrecognized name",
}


def delimiters(message: Column) -> Column:
    """The five delimiters, by their places in the message header."""
    return F.struct(*(F.substring(message, 4 + i, 1).alias(d) for i, d in enumerate(DELIMITERS)))


class Signs:
    """The delimiters in a text of five characters, by name.

    Within lambdas a plain text is used for them: Spark's pruning of struct fields loses track of fields that
    are only read there.
    """

    def __init__(self, text: Column):
        self.text = text

    def __getitem__(self, name: str) -> Column:
        return F.substring(self.text, DELIMITERS.index(name) + 1, 1)


def signs(d: Column) -> Column:
    """The delimiters struct as a text of five characters."""
    return F.concat(*(d[k] for k in DELIMITERS))


def segments(message: Column) -> Column:
    """The segments as an array of text. One terminator at the end of the message opens no segment."""
    cut = F.when(F.endswith(message, F.lit("\r\n")), 2).when(F.endswith(message, F.lit("\r")) | F.endswith(message, F.lit("\n")), 1).otherwise(0)
    return F.split(F.left(message, F.length(message) - cut), TERMINATOR, -1)


def terminators(message: Column) -> Column:
    return F.regexp_extract_all(message, F.lit(f"({TERMINATOR})"), F.lit(1))


def _bytes(array: Column, n: Column) -> Column:
    """Bytes of the first ``n`` strings of an array."""
    return F.aggregate(F.slice(array, F.lit(1), n), F.lit(0).cast("long"), lambda total, s: total + F.octet_length(s))


def offset(message: Column, lines: Column, index: Column) -> Column:
    """The byte at which segment ``index`` (from 0) starts."""
    return _bytes(lines, index) + _bytes(terminators(message), index)


def _error(kind: str, at: Column, index: Column | None = None) -> Column:
    index = F.lit(None) if index is None else index
    return F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("offset"), index.cast("int").alias("segment_index"))


def scan_error(message: Column, lines: Column, strict_msh2: bool = False) -> Column:
    """The first structural error of a message as SCAN_ERROR, or null. A null message has no error."""
    header = F.get(lines, F.lit(0))
    short = F.octet_length(header) < 8
    if strict_msh2:
        short = short | (F.length(F.split_part(header, F.substring(message, 4, 1), F.lit(2))) != 4)
    bad = F.array_position(F.transform(lines, lambda s, i: (i == 0) | s.rlike(NAME)), False) - 1
    return (
        F.when(message.isNull(), F.lit(None).cast(SCAN_ERROR))
        .when(~F.startswith(message, F.lit("MSH")), _error("MissingMsh", F.lit(0)))
        .when(short, _error("TruncatedMsh", F.octet_length(header)))
        .when(bad > 0, _error("UnrecognizedSegment", offset(message, lines, bad.cast("int")), bad))
    )


def scan_error_text(error: Column) -> Column:
    """What a SCAN_ERROR says."""
    one = lambda kind: F.format_string(SCAN_MESSAGES[kind], error["offset"])
    many = F.format_string(SCAN_MESSAGES["UnrecognizedSegment"], error["segment_index"], error["offset"])
    return F.when(error["kind"] == "MissingMsh", one("MissingMsh")).when(error["kind"] == "TruncatedMsh", one("TruncatedMsh")).when(error["kind"].isNotNull(), many)


def spans(message: Column, lines: Column) -> Column:
    """For each segment its bytes as struct<start, end>, without the terminator."""
    breaks = terminators(message)
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(found: Column, i: Column) -> Column:
        past = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(found, i - 1)["end"] + F.octet_length(F.get(breaks, i - 1)))
        return F.concat(found, F.array(F.struct(past.alias("start"), (past + F.octet_length(F.get(lines, i))).alias("end"))))

    return F.when(F.size(lines) > 0, F.aggregate(F.sequence(F.lit(0), F.size(lines) - 1), empty, step)).otherwise(empty)


def byte_view(text: Column) -> Column:
    """``text`` with one character for each byte of its UTF-8 form, so that character places are byte places."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def delimiter_kind(byte: Column, d: Column) -> Column:
    """The kind of a one-byte text; where delimiters share a character, the first kind of DELIMITERS."""
    kind = F.when(byte == d[DELIMITERS[0]], DELIMITERS[0])
    for k in DELIMITERS[1:]:
        kind = kind.when(byte == d[k], k)
    return kind

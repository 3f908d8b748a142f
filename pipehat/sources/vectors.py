"""Conformance vectors: cases of paths, hierarchies and scans as JSON, and how the engine does on them.

A file is a list of objects with an ``id`` and a ``message_ref``. Path cases have ``path``, ``method`` (getValue or getFirstValue),
``expected`` and maybe ``expected_lines`` and ``flags``; hierarchy cases also ``profile_ref``; scan cases ``expected_delimiters``,
``expected_segments`` and ``expected_delimiter_occurrences``, or ``expected_error``. Cases are few and small: they are held on the driver,
and the messages that they name are one DataFrame, read once for all paths of one setting.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..operators import frames
from ..plans.path import PathError, parse
from ..plans.profile import Profile

INVALID, NOT_NUMERIC = "INVALID", "ERROR:NonNumericComparison"
CHAIN_RULE, LEGACY_LIMIT = "B.2-multi-level-navigation", "A.6-chained-arrow-silently-empty"


def load(path: str) -> list[dict]:
    """The cases of one JSON file; ids must differ."""
    with open(path, encoding="utf-8") as f:
        cases = json.load(f)
    if len({c["id"] for c in cases}) != len(cases):
        raise ValueError(f"{path} has an id twice")
    return cases


def setting(case: dict) -> tuple[str, str | None, bool, bool]:
    """(hops, profile, build hierarchy, remove empty) of a case."""
    flags = case.get("flags") or {}
    hops = flags.get("hops") or ("chain" if CHAIN_RULE in case.get("semantic_rules", ()) else "legacy" if case.get("known_limitation") == LEGACY_LIMIT else "reject")
    return hops, case.get("profile_ref") or flags.get("profile"), flags.get("buildHierarchy", True), flags.get("removeEmpty", False)


def run(spark: SparkSession, cases: list[dict], message: Callable[[str], str], profile: Callable[[str], Profile]) -> dict[str, str | None]:
    """What differs, by id: None where a case holds. ``message`` and ``profile`` give what a reference names."""
    scans = [c for c in cases if "path" not in c]
    return _run_paths(spark, [c for c in cases if "path" in c], message, profile) | _run_scans(spark, scans, message)


def _frame(spark: SparkSession, cases: list[dict], message: Callable[[str], str]) -> DataFrame:
    return spark.createDataFrame([(r, message(r)) for r in sorted({c["message_ref"] for c in cases})], "message_id string, message string")


def _run_paths(spark: SparkSession, cases: list[dict], message, profile) -> dict[str, str | None]:
    said: dict[str, str | None] = {}
    groups: dict[tuple, list[dict]] = {}
    for case in cases:
        try:
            parse(case["path"], setting(case)[0])
        except PathError as e:
            said[case["id"]] = None if case["expected"] == INVALID else f"{e.kind} at {e.offset}"
            continue
        if case["expected"] == INVALID:
            said[case["id"]] = "the path is read, and should not be"
        else:
            groups.setdefault(setting(case), []).append(case)
    for (hops, name, build, remove), own in groups.items():
        options = {"hops": hops, "profile": profile(name) if name else None, "build_hierarchy": build}
        df = _frame(spark, own, message)
        rows = {r.message_id: r for r in frames.query(df, {f"v{i}": c["path"] for i, c in enumerate(own)}, remove_empty=remove, **options).collect()}
        for i, case in enumerate(own):
            said[case["id"]] = _difference(case, rows[case["message_ref"]], f"v{i}")
        located = [c for c in own if c.get("expected_lines") is not None and said[c["id"]] is None]
        if located:
            parts = [frames.located_values(df.where(df.message_id == c["message_ref"]), c["path"], **options).selectExpr(f"{i} AS i", "occurrence", "repetition", "line_number") for i, c in enumerate(located)]
            lines: dict[int, list] = {}
            for r in sorted(tuple(r) for r in reduce(DataFrame.unionAll, parts).collect()):
                lines.setdefault(r[0], []).append(r[1:])
            for i, case in enumerate(located):
                got = _nested(lines.get(i, []))
                first = case["method"] == "getFirstValue"
                got = got[0][:1] if first and got else got
                if got != case["expected_lines"]:
                    said[case["id"]] = f"lines {got}"
    return said


def _nested(rows: list[tuple[int, int, int]]) -> list[list[int]]:
    """Lines by occurrence and repetition."""
    out: dict[int, list[int]] = {}
    for occurrence, _, line in rows:
        out.setdefault(occurrence, []).append(line)
    return list(out.values())


def _difference(case: dict, row, name: str) -> str | None:
    expected, values, error = case["expected"], row[name], row[f"{name}_error"]
    if expected == NOT_NUMERIC:
        return None if error and error.kind == "NonNumericComparison" else f"no error, but {values}"
    if error:
        return f"{error.kind} {error.operator}"
    got = values if case["method"] == "getValue" else (values[0][0] if values and values[0] else None)
    if expected is None and not parse(case["path"], "chain").has_child:
        return None if not got else f"{got}"  # a path without an arrow has no result other than an empty one
    return None if got == expected else f"{got}"


def _run_scans(spark: SparkSession, cases: list[dict], message) -> dict[str, str | None]:
    if not cases:
        return {}
    df = _frame(spark, cases, message)
    scanned = {r.message_id: r for r in frames.scan(df).collect()}
    spans: dict[str, list[dict]] = {}
    for r in sorted(frames.segments_long(df, with_spans=True).select("message_id", "start", "end").collect()):
        spans.setdefault(r.message_id, []).append({"start": r.start, "end": r.end})
    signs: dict[str, list[dict]] = {}
    for r in sorted(frames.delimiter_occurrences(df).select("message_id", "offset", "segment_index", "kind").collect()):
        signs.setdefault(r.message_id, []).append({"segment_index": r.segment_index, "offset": r.offset, "kind": r.kind.capitalize()})
    said = {}
    for case in cases:
        r = scanned[case["message_ref"]]
        if "expected_error" in case:
            got = None if r.scan_error is None else {k: v for k, v in r.scan_error.asDict().items() if v is not None}
            wanted = case["expected_error"]
            said[case["id"]] = None if got and all(got.get(k) == v for k, v in wanted.items()) else f"{got}"
            continue
        got = {"expected_delimiters": r.delimiters and r.delimiters.asDict(), "expected_segments": spans.get(r.message_id, []), "expected_delimiter_occurrences": signs.get(r.message_id, [])}
        wrong = {k: v for k, v in got.items() if k in case and case[k] != v}
        said[case["id"]] = f"{r.scan_error or wrong}" if r.scan_error or wrong else None
    return said

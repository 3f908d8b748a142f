"""``python -m pipehat.cli FILE PATH [--first] [--profile=FILE]``: the values of a path in a message file.

A path with an arrow needs a profile.

Exit code 0 if there are any, 1 if there are none, 2 on an error.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .functions.extract import query_error_text
from .functions.scan import scan_error_text
from .operators.frames import query, rendered, scan
from .plans.path import PathError, parse
from .plans.profile import Profile


def run(spark: SparkSession, args: list[str], out=sys.stdout, err=sys.stderr) -> int:
    from pyspark.sql import functions as F

    first = "--first" in args
    profile = next((a.partition("=")[2] for a in args if a.startswith("--profile=")), None)
    places = [a for a in args if not a.startswith("--")]
    if len(places) != 2:
        print("usage: pipehat FILE PATH [--first] [--profile=FILE]", file=err)
        return 2
    try:
        with open(places[0], "rb") as f:
            text = f.read().decode()
    except (OSError, UnicodeDecodeError) as e:
        print(f"cannot read {places[0]}: {e}", file=err)
        return 2
    rows = scan(spark.createDataFrame([(text,)], "message string"))
    said = rows.select(scan_error_text(F.col("scan_error"))).first()[0]
    if said:
        print(f"scan error: {said}", file=err)
        return 2
    try:
        path = parse(places[1])
    except PathError as e:
        print(f"path error: {e}", file=err)
        return 2
    if path.has_child and not profile:
        print("a path with an arrow needs a profile", file=err)
        return 2
    row = query(rows, {"v": places[1]}, profile=Profile.load(profile) if profile else None).select("v", rendered(F.col("v")).alias("lines"), query_error_text(F.col("v_error")).alias("said")).first()
    if row["said"]:
        print(f"query error: {row['said']}", file=err)
        return 2
    if not row["v"]:
        print("(no match)", file=out)
        return 1
    for line in [row["v"][0][0]] if first else row["lines"]:
        print(line, file=out)
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate(), sys.argv[1:]))

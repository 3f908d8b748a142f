"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

Messages are built from the order tables once, outside the timings; each query then reads them from
Parquet and its whole result goes to a sink that drops it. Best of ``ROUNDS``.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pipehat.functions.extract import first_value
from pipehat.operators import frames, validate
from pipehat.plans.registry import PROFILE
from pipehat.sources import synth

ROUNDS = 3
PATHS = {
    "first_segment": "PID[1]",
    "first_value": "PID-5.1",
    "nth_occurrence": "OBX[2]-5",
    "all_repetitions": "OBX-5",
    "component": "OBR-4.2.2",
    "filter_equals": "OBX[@3.1='7||42||100']-6",
    "filter_ordering": "OBX[@6>='50000.5']-1",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "8m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="pipehat-bench-")
    try:
        began = time.time()
        synth.messages(spark, sf_dir).repartition(int(cpus) * 2).write.parquet(f"{folder}/messages")
        built = time.time() - began
        messages = spark.read.parquet(f"{folder}/messages")
        n = messages.count()
        # a hundred observations in each of a fiftieth of the messages, and only the first two lines of all
        lines = F.split("message", "\r")
        messages.where("message_id % 50 = 0").select("message_id", F.array_join(F.concat(F.slice(lines, 1, 4), F.array_repeat(F.get(lines, F.lit(4)), 100)), "\r").alias("message")).write.parquet(f"{folder}/large")
        messages.select("message_id", F.array_join(F.slice(lines, 1, 2), "\r").alias("message")).write.parquet(f"{folder}/minimal")
        large, minimal = spark.read.parquet(f"{folder}/large"), spark.read.parquet(f"{folder}/minimal")
        queries = {name: (lambda p=path: frames.get_value(messages, p)) for name, path in PATHS.items()}
        queries |= {
            "retrieve_first": lambda: frames.scan(messages).select("message_id", frames.retrieve_first_segment("PID")),
            "large_first": lambda: frames.scan(large).select("message_id", frames.retrieve_first_segment("PID")),
            "large_repetitions": lambda: frames.get_value(large, "OBX-5"),
            "minimal_first_value": lambda: frames.get_first_value(minimal, "PID-5.1"),
            "retrieve_multiple": lambda: frames.scan(messages).select("message_id", frames.retrieve_multiple_segments("OBX")),
            "seven_paths": lambda: frames.query(messages, PATHS),
            "segments_long": lambda: frames.segments_long(messages),
            "child_values": lambda: frames.get_value(messages, "OBR[1] -> OBX-5", profile=PROFILE),
            "field_checks": lambda: validate.field_checks(messages, PROFILE),
            "values_by_flag": lambda: frames.query(messages, {"v": "OBX-5[2]"}).select(first_value(F.col("v")).alias("flag")).groupBy("flag").count(),
        }
        times = {}
        for name, make in queries.items():
            best = None
            for _ in range(ROUNDS):
                began = time.time()
                make().write.format("noop").mode("overwrite").save()
                best = min(best or 1e9, time.time() - began)
            times[name] = round(best, 3)
        total = round(sum(times.values()), 3)
        n_large = large.count()
        rates = {name: round((n_large if name.startswith("large") else n) / s) for name, s in times.items()}
        print(json.dumps({"metric": "total seconds of path queries", "value": total, "unit": "sec", "queries": times, "sf": sf_dir, "messages": n, "messages_per_second": rates, "build_sec": round(built, 1)}))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())

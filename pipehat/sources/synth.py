"""Observation reports made of order tables: one message for each order that has line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _money(c: str) -> Column:
    return F.format_string("%.2f", F.col(c).cast("double"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(message_id long, message): MSH, PID, ORC, OBR and an OBX for each line item, with a note below returned ones.

    Line items are in the order of their number and then all other values, as numbers may repeat.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    item = read("lineitem").join(read("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    keys = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "p_name")
    items = item.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*keys))).alias("items"))
    rows = read("orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).join(read("customer").select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    when = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    head = [
        join("MSH|^~\\&|LAB^", F.col("o_orderpriority"), "|HOSP|RCV|DEST|", when, "||ORU^R01^ORU_R01|", F.col("o_orderkey"), "|P|2.5.1"),
        join("PID|1||", F.col("o_custkey"), "^^^HOSP&1.2.3&ISO^MR~X", F.col("o_custkey"), "^^^ALT^PI||", F.col("c_name"), "^GIVEN^M||||||", F.col("c_nationkey")),
        join("ORC|RE|", F.col("o_orderkey")),
        join("OBR|1|", F.col("o_orderkey"), "||", F.col("o_orderpriority"), "^", F.col("o_orderstatus"), "&", F.col("o_custkey"), "^L|||", when, "|", _money("o_totalprice")),
    ]

    def lines(x: Column, i: Column) -> Column:
        value = join(F.format_string("%.0f", x["l_quantity"].cast("double")), "~", x["l_returnflag"], "~", x["l_linestatus"])
        obx = join("OBX|", (i + 1), "|NM|", x["l_partkey"], "^", x["p_name"], "^L&", x["l_suppkey"], "|", x["l_linenumber"], "|", value, "|", F.format_string("%.2f", x["l_extendedprice"].cast("double")), "|||||", x["l_linestatus"])
        return F.when(x["l_returnflag"] == "R", F.array(obx, join("NTE|1|L|returned \\T\\ kept ", x["l_partkey"]))).otherwise(F.array(obx))

    text = F.array_join(F.concat(F.array(*head), F.flatten(F.transform("items", lines))), "\r")
    return rows.select(F.col("o_orderkey").cast("long").alias("message_id"), text.alias("message"))

"""Registered queries: the engine over messages made of the order tables, and what SQL gets from those tables.

The SQL never sees a message: it computes the expected values from orders, customer, lineitem and part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract
from ..operators import deidentify, frames, validate
from ..sources import files, synth
from .path import PathError, parse
from .profile import Profile

PROFILE = Profile.of(
    {
        "segmentDefinition": {
            "MSH": {
                "cardinality": "[1..1]",
                "children": {
                    "PID": {"cardinality": "[1..1]"},
                    "ORC": {"cardinality": "[0..1]"},
                    "OBR": {"cardinality": "[1..*]", "children": {"OBX": {"cardinality": "[1..3]", "children": {"NTE": {"cardinality": "[0..*]"}}}}},
                },
            }
        },
        "segmentFields": {
            "OBX": [
                {"fieldNumber": 2, "name": "Value Type", "dataType": "ID", "maxLength": 2, "usage": "R", "cardinality": "[1..1]"},
                {"fieldNumber": 5, "name": "Value", "dataType": "ST", "usage": "R", "cardinality": "[1..2]"},
                {"fieldNumber": 6, "name": "Price", "dataType": "NM", "maxLength": 8, "usage": "R", "cardinality": "[1..1]"},
                {"fieldNumber": 11, "name": "Status", "dataType": "ID", "usage": "R", "cardinality": "[1..1]", "default": "F"},
            ],
            "PID": [{"fieldNumber": 8, "name": "Sex", "dataType": "IS", "usage": "R", "cardinality": "[1..1]"}, {"fieldNumber": 7, "name": "Birth", "dataType": "TS", "usage": "RE", "cardinality": "[0..1]"}],
        },
    }
)

# The line items of each message in order, with their number in it; messages have at least one.
_ITEMS = """
WITH i AS (
    SELECT l.*, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, p_name) AS n
    FROM lineitem l JOIN part ON l_partkey = p_partkey),
m AS (SELECT o.*, c_name, c_nationkey FROM orders o JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM i)),
x AS (SELECT i.*, m.* FROM i JOIN m ON l_orderkey = o_orderkey)
"""
_QUANTITY = "printf('%.0f', CAST(l_quantity AS DOUBLE))"
_PID = "'PID|1||' || o_custkey || '^^^HOSP&1.2.3&ISO^MR~X' || o_custkey || '^^^ALT^PI||' || c_name || '^GIVEN^M||||||' || c_nationkey"
_MSH = "'MSH|^~\\&|LAB^' || o_orderpriority || '|HOSP|RCV|DEST|' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '||ORU^R01^ORU_R01|' || o_orderkey || '|P|2.5.1'"
_PRICE = "printf('%.2f', CAST(l_extendedprice AS DOUBLE))"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _ITEMS + sql
        return f

    return add


def _first(df: DataFrame, **names: str) -> DataFrame:
    return df.select("message_id", *(extract.first_value(F.col(c)).alias(a) for a, c in names.items()))


@_query(
    """SELECT o_orderkey AS message_id, strftime(o_orderdate, '%Y%m%d%H%M%S') AS sent, '2.5.1' AS version, 'ORU' AS kind, CAST(o_orderkey AS VARCHAR) AS control_id, '|' AS separator, '^' AS encoding FROM m"""
)
def header_fields(spark, sf_dir):
    """MSH fields, whose numbers count the separator itself."""
    paths = {"sent": "MSH-7", "version": "MSH-12", "kind": "MSH-9.1", "control_id": "MSH-10", "separator": "MSH-1", "encoding": "MSH-2"}
    return _first(frames.query(synth.messages(spark, sf_dir), paths), **{k: k for k in paths})


@_query("SELECT o_orderkey AS message_id, c_name AS name, CAST(o_custkey AS VARCHAR) AS patient, '1.2.3' AS authority, 'X' || o_custkey AS other_id, 'ALT' AS other_authority, '' AS beyond FROM m")
def patient_parts(spark, sf_dir):
    """Components, subcomponents and repetitions of PID."""
    paths = {"name": "PID-5.1", "patient": "PID[1]-3[1].1", "authority": "PID-3.4.2", "other_id": "PID-3[2].1", "other_authority": "PID-3[$LAST].4", "beyond": "PID-99.2"}
    return _first(frames.query(synth.messages(spark, sf_dir), paths), **{k: k for k in paths})


@_query(f"SELECT o_orderkey AS message_id, n AS occurrence, r.k AS repetition, r.v AS value FROM x, LATERAL (VALUES (1, {_QUANTITY}), (2, l_returnflag), (3, l_linestatus)) r(k, v)")
def observation_values(spark, sf_dir):
    """All of OBX-5 in long form."""
    return frames.values_long(synth.messages(spark, sf_dir), {"v": "OBX-5"}).select("message_id", F.col("occurrence").cast("long").alias("occurrence"), "repetition", "value")


@_query(f"SELECT o_orderkey AS message_id, {_QUANTITY} AS second, CAST(count(*) OVER () AS BIGINT) AS messages FROM x WHERE n = 2")
def second_observation(spark, sf_dir):
    """The n-th occurrence, and aggregation on top."""
    rows = _first(frames.query(synth.messages(spark, sf_dir), {"v": "OBX[2]-5[1]"}), second="v").where("second is not null")
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("messages"))))


@_query(f"SELECT o_orderkey AS message_id, {_PRICE} AS price, l_linestatus AS status FROM x QUALIFY n = max(n) OVER (PARTITION BY o_orderkey)")
def last_observation(spark, sf_dir):
    return _first(frames.query(synth.messages(spark, sf_dir), {"price": "OBX[$LAST]-6", "status": "OBX[$LAST]-5[$LAST]"}), price="price", status="status")


@_query(f"SELECT o_orderkey AS message_id, string_agg({_PRICE}, '~' ORDER BY n) AS prices FROM x WHERE l_partkey IN (7, 42, 100) GROUP BY 1")
def filter_equals(spark, sf_dir):
    """Occurrences by equality with any of several values."""
    rows = frames.get_value(synth.messages(spark, sf_dir), "OBX[@3.1='7||42||100']-6").where(F.size("values") > 0)
    return rows.select("message_id", F.array_join(F.flatten("values"), "~").alias("prices"))


@_query("SELECT o_orderkey AS message_id, CAST(count(*) AS BIGINT) AS open FROM x WHERE l_linestatus <> 'F' GROUP BY 1")
def filter_differs(spark, sf_dir):
    rows = frames.get_value(synth.messages(spark, sf_dir), "OBX[@11!='F']-1").where(F.size("values") > 0)
    return rows.select("message_id", F.size("values").cast("long").alias("open"))


@_query("SELECT o_orderkey AS message_id, CAST(count(*) AS BIGINT) AS n, min(n) AS first_number FROM x WHERE l_extendedprice >= 50000.5 GROUP BY 1")
def filter_ordering(spark, sf_dir):
    """An ordering filter on numbers, with blanks around the operator."""
    rows = frames.get_value(synth.messages(spark, sf_dir), "OBX[@6 >= '50000.5']-1").where(F.size("values") > 0)
    return rows.select("message_id", F.size("values").cast("long").alias("n"), extract.first_value(F.col("values")).cast("long").alias("first_number"))


@_query("SELECT 'NonNumericComparison' AS kind, '>' AS operator, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS with_values FROM m")
def filter_not_numeric(spark, sf_dir):
    """An ordering filter on text is an error of each message, not of the job."""
    rows = frames.get_value(synth.messages(spark, sf_dir), "OBX[@5>'3']-1")
    return rows.groupBy("values_error.kind", "values_error.operator").agg(F.count("*").alias("n"), F.count("values").alias("with_values"))


@_query("SELECT o_orderkey AS message_id, o_orderpriority AS priority, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS customer FROM m WHERE o_orderstatus = 'O'")
def filter_subcomponent(spark, sf_dir):
    paths = {"priority": "OBR[@4.2.1='O']-4.1", "status": "OBR-4.2.1", "customer": "OBR-4.2.2"}
    return _first(frames.query(synth.messages(spark, sf_dir), paths).where(F.size("priority") > 0), **{k: k for k in paths})


@_query("SELECT o_orderkey AS message_id, 'ORC|RE|' || o_orderkey AS segment, 0 AS n_missing, 0 AS n_beyond FROM m")
def whole_segment(spark, sf_dir):
    rows = frames.query(synth.messages(spark, sf_dir), {"segment": "ORC", "missing": "ZZZ-1", "beyond": "ORC[5]-2"})
    return rows.select("message_id", extract.first_value(F.col("segment")).alias("segment"), F.size("missing").alias("n_missing"), F.size("beyond").alias("n_beyond"))


@_query("SELECT o_orderkey AS message_id, CAST(n + 4 + coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_number, CAST(l_partkey AS VARCHAR) AS value FROM x")
def located(spark, sf_dir):
    """Values with the line they stand on."""
    return frames.located_values(synth.messages(spark, sf_dir), "OBX-3.1").select("message_id", F.col("line_number").cast("long").alias("line_number"), "value")


@_query("SELECT name, CAST(sum(c) AS BIGINT) AS n, CAST(max(c) AS BIGINT) AS most FROM (SELECT o_orderkey, 'OBX' AS name, count(*) AS c FROM x GROUP BY ALL UNION ALL SELECT o_orderkey, 'NTE', count(*) FROM x WHERE l_returnflag = 'R' GROUP BY ALL UNION ALL SELECT o_orderkey, unnest(['MSH', 'PID', 'ORC', 'OBR']), 1 FROM m) GROUP BY 1")
def segment_counts(spark, sf_dir):
    """The long form of segments, aggregated."""
    rows = frames.segments_long(synth.messages(spark, sf_dir))
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.max("occurrence").cast("long").alias("most"))


@_query("SELECT o_orderkey AS message_id, CAST(count(*) AS BIGINT) AS n_obx, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS n_nte FROM x GROUP BY 1")
def peeked(spark, sf_dir):
    return frames.scan(synth.messages(spark, sf_dir)).select("message_id", frames.peek("OBX").cast("long").alias("n_obx"), frames.peek("NTE").cast("long").alias("n_nte"))


@_query(f"SELECT o_orderkey AS message_id, string_agg(n || ':' || {_QUANTITY}, ',' ORDER BY n) AS numbers, string_agg('returned \\T\\ kept ' || l_partkey, ',' ORDER BY n) FILTER (l_returnflag = 'R') AS notes FROM x GROUP BY 1")
def child_values(spark, sf_dir):
    """Children of the first OBR, and with two steps their notes."""
    rows = frames.query(synth.messages(spark, sf_dir), {"number": "OBR[1] -> OBX-1", "value": "OBR -> OBX-5[1]", "note": "OBR[1] -> OBX -> NTE-3"}, profile=PROFILE, hops="chain")
    pairs = F.zip_with(F.flatten("number"), F.flatten("value"), lambda a, b: F.concat(a, F.lit(":"), b))
    return rows.select("message_id", F.array_join(pairs, ",").alias("numbers"), F.when(F.size("note") > 0, F.array_join(F.flatten("note"), ",")).alias("notes"))


@_query("SELECT o_orderkey AS message_id, CAST(l_partkey AS VARCHAR) AS second, CAST(l_partkey AS VARCHAR) AS own_second, 0 AS grandchildren FROM x WHERE n = 2")
def child_by_number(spark, sf_dir):
    """A child's number counts from 0 among all children, or from 1 among its own below each parent."""
    base = frames.scan(synth.messages(spark, sf_dir))
    rows = frames.query(base, {"second": "OBR[1] -> OBX[1]-3.1", "grandchildren": "OBR -> NTE-3"}, profile=PROFILE)
    rows = frames.query(rows, {"own": "OBR[1] -> OBX[2]-3.1"}, profile=PROFILE, child_index="per_parent")
    rows = rows.select("message_id", extract.first_value(F.col("second")).alias("second"), extract.first_value(F.col("own")).alias("own_second"), F.size("grandchildren").alias("grandchildren"))
    return rows.where("second is not null")


@_query("SELECT o_orderkey AS message_id, CAST(n + 4 + coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS note_line, l_partkey AS part FROM x QUALIFY l_returnflag = 'R'")
def note_parents(spark, sf_dir):
    """Notes joined to the segment they lie under, in the long form."""
    rows = frames.segments_long(synth.messages(spark, sf_dir), profile=PROFILE)
    notes = rows.where("name = 'NTE'").select("message_id", "parent_index")
    above = rows.select(F.col("message_id").alias("id"), F.col("segment_index").alias("i"), "raw", "line_number")
    both = notes.join(above, (F.col("message_id") == F.col("id")) & (F.col("parent_index") == F.col("i")))
    part = F.split_part(F.split_part("raw", F.lit("|"), F.lit(4)), F.lit("^"), F.lit(1))
    return both.select("message_id", F.col("line_number").cast("long").alias("note_line"), part.cast("long").alias("part"))


@_query("SELECT o_orderkey AS message_id, 'returned & kept ' || min_by(l_partkey, n) AS note FROM x WHERE l_returnflag = 'R' GROUP BY 1")
def escapes_decoded(spark, sf_dir):
    rows = frames.query(synth.messages(spark, sf_dir), {"note": "NTE[1]-3"}, decode_escapes=True)
    return _first(rows, note="note").where("note is not null")


@_query("SELECT o_orderkey AS message_id, c_name AS kept, true AS gone FROM m")
def empty_removed(spark, sf_dir):
    rows = frames.query(synth.messages(spark, sf_dir), {"kept": "PID-5.1", "gone": "PID-6"}, remove_empty=True)
    return rows.select("message_id", extract.first_value(F.col("kept")).alias("kept"), F.col("gone").isNull().alias("gone"))


@_query(
    f"""SELECT o_orderkey AS message_id, CASE o_orderkey % 4 WHEN 0 THEN 'MissingMsh' WHEN 1 THEN 'TruncatedMsh' ELSE 'UnrecognizedSegment' END AS kind,
    CAST(CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 6 ELSE strlen({_MSH}) + 1 END AS BIGINT) AS place FROM m WHERE o_orderkey % 4 < 3"""
)
def scan_errors(spark, sf_dir):
    """Messages broken in three ways: what is wrong with each, and where."""
    k, text = F.col("message_id") % 4, F.col("message")
    broken = F.when(k == 0, F.concat(F.lit("FHS|x\r"), text)).when(k == 1, F.concat(F.substring(text, 1, 6), F.lit("\r"), text)).when(k == 2, F.regexp_replace(text, "\rPID", "\rpid")).otherwise(text)
    rows = frames.scan(synth.messages(spark, sf_dir).select("message_id", broken.alias("message"))).where("scan_error is not null")
    return rows.select("message_id", "scan_error.kind", F.col("scan_error.offset").cast("long").alias("place"))


@_query(
    f"""SELECT kind, CAST(sum(length(t) - length(replace(t, sign, ''))) AS BIGINT) AS n, CAST(sum(CASE WHEN contains(t, sign) THEN strlen(h) + strpos(t, sign) END) AS BIGINT) AS first_offsets
    FROM (SELECT {_PID} AS t, {_MSH} AS h FROM m), (VALUES ('field', '|'), ('component', '^'), ('repetition', '~'), ('subcomponent', '&')) s(kind, sign) GROUP BY 1"""
)
def delimiter_counts(spark, sf_dir):
    """Delimiter bytes of PID in all messages, by kind, and the sum of each message's first offset of that kind."""
    rows = frames.delimiter_occurrences(synth.messages(spark, sf_dir)).where("segment_index = 1")
    firsts = rows.groupBy("message_id", "kind").agg(F.count("*").alias("n"), F.min("offset").alias("first"))
    return firsts.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("first").cast("long").alias("first_offsets"))


@_query(f"SELECT o_orderkey AS message_id, CAST(strlen({_MSH}) + 1 AS BIGINT) AS first, CAST(strlen({_PID}) AS BIGINT) AS n_bytes FROM m")
def segment_spans(spark, sf_dir):
    """Where a segment starts and how long it is, in bytes."""
    rows = frames.segments_long(synth.messages(spark, sf_dir), with_spans=True).where("name = 'PID'")
    return rows.select("message_id", F.col("start").cast("long").alias("first"), (F.col("end") - F.col("start")).cast("long").alias("n_bytes"))


@_query("SELECT CAST(floor(o_orderkey / 50) AS BIGINT) AS file, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM m GROUP BY 1")
def batch_messages(spark, sf_dir):
    """Batch files of at most 50 messages each, made and taken apart again."""
    rows = synth.messages(spark, sf_dir).groupBy(F.floor(F.col("message_id") / 50).alias("file"))
    text = F.concat(F.lit("FHS|^~\\&\rBHS|^~\\&\r"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_id", "message"))), lambda x: x["message"]), "\r"), F.lit("\rBTS|9\rFTS|1\r"))
    rows = files.debatch(rows.agg(text.alias("message")).withColumn("message_id", F.col("file").cast("string")))
    ids = frames.get_first_value(rows, "MSH-10").groupBy("file").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.col("value").cast("long"))).alias("ids"))
    return ids.select("file", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@_query("SELECT 'INVALID_CARDINALITY' AS category, 'OBX' AS path, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey FROM x GROUP BY 1 HAVING count(*) > 3)")
def cardinality_errors(spark, sf_dir):
    rows = validate.segment_cardinality(synth.messages(spark, sf_dir), PROFILE)
    return rows.groupBy("category", "path").agg(F.count("*").alias("n"))


@_query(
    f"""SELECT category, classification, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT 'INVALID_CARDINALITY' AS category, 'ERROR' AS classification, count(*) AS k FROM x
    UNION ALL SELECT 'INVALID_FIELD_LENGTH', 'ERROR', count(*) FROM x WHERE length({_PRICE}) > 8
    UNION ALL SELECT 'INVALID_DEFAULT_VALUE', 'ERROR', count(*) FROM x WHERE l_linestatus <> 'F'
    UNION ALL SELECT 'INVALID_USAGE', 'ERROR', count(*) FROM m UNION ALL SELECT 'INVALID_USAGE', 'WARNING', count(*) FROM m) GROUP BY ALL HAVING sum(k) > 0"""
)
def field_errors(spark, sf_dir):
    """Usage, repetitions, types, lengths and constants of fields, by category."""
    rows = validate.field_checks(synth.messages(spark, sf_dir), PROFILE)
    return rows.groupBy("category", "classification").agg(F.count("*").alias("n"))


@_query(
    """SELECT said, category, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT 'final' AS said, 'INVALID_CONFORMANCE' AS category, count(*) AS k FROM x WHERE l_linestatus <> 'F' UNION ALL SELECT 'flag', 'INVALID_CONFORMANCE', count(*) FROM x WHERE l_returnflag = 'R'
    UNION ALL SELECT 'one', 'INVALID_CONFORMANCE', count(*) FROM (SELECT o_orderkey FROM x GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unit', 'INVALID_PREDICATE', count(*) FROM x
    UNION ALL SELECT 'sex', 'INVALID_PREDICATE', count(*) FROM m) GROUP BY ALL HAVING sum(k) > 0"""
)
def rule_errors(spark, sf_dir):
    """Both predicates and all three conformance rules, by what they say; two more of them have nothing to say."""
    rows = frames.scan(synth.messages(spark, sf_dir))
    rules = [
        {"name": "constant", "field": "OBX-5[3]", "reference": "F", "description": "final"}, {"name": "regEx", "field": "OBX-5[2]", "reference": "[^R]", "description": "flag"},
        {"name": "existsUnique", "field": "OBX-1", "description": "one"}, {"name": "existsUnique", "field": "PID-5.1", "description": "never"},
    ]
    due = [
        {"name": "requiredIfNotEmpty", "field": "OBX-7", "reference": "OBX-6", "description": "unit"}, {"name": "requiredIfEmpty", "field": "PID-8", "reference": "PID-9", "description": "sex"},
        {"name": "requiredIfEmpty", "field": "OBX-7", "reference": "OBX-3.1", "description": "never"},
    ]
    found = validate.conformance_errors(rows, rules).unionByName(validate.predicate_errors(rows, due))
    return found.groupBy(F.col("description").alias("said"), "category").agg(F.count("*").alias("n"))


@_query(
    """, h AS (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(CAST(o_custkey AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: (a * 31 + b) % 4294967296) AS h FROM x WHERE n = 1)
    SELECT o_orderkey AS message_id, 'Someone' AS name, CASE WHEN l_returnflag = 'R' THEN '0' ELSE l_linestatus END AS status, CAST(l_partkey AS VARCHAR) AS part, CAST(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END AS VARCHAR) AS patient FROM h"""
)
def deidentified(spark, sf_dir):
    """Values replaced, under a condition too, and hashed, and lines removed."""
    rules = ["PID-5.1,Someone", "OBX-5[3],0,OBX-5[2] = R", "NTE,$REMOVE", "PID-3[1].1,$HASH"]
    rows = deidentify.deidentify(synth.messages(spark, sf_dir), rules)
    rows = frames.query(rows, {"name": "PID-5.1", "status": "OBX[1]-5[3]", "part": "OBX[1]-3.1", "patient": "PID-3[1].1"})
    return _first(rows, name="name", status="status", part="part", patient="patient")


@_query("SELECT rule, CAST(sum(k) AS BIGINT) AS n FROM (SELECT 'replaced with Someone' AS rule, count(*) AS k FROM m UNION ALL SELECT 'replaced with 0', count(*) FROM x WHERE l_returnflag = 'R' UNION ALL SELECT 'segment removed', count(*) FROM x WHERE l_returnflag = 'R') GROUP BY 1 HAVING sum(k) > 0")
def redactions(spark, sf_dir):
    rows = deidentify.deidentify(synth.messages(spark, sf_dir), ["PID-5.1,Someone", "OBX-5[3],0,OBX-5[2] = R", "NTE,$REMOVE"])
    return deidentify.redaction_report(rows).groupBy("rule").agg(F.count("*").alias("n"))


@_query("SELECT CAST(c_nationkey AS BIGINT) AS nation, l_returnflag AS flag, CAST(count(*) AS BIGINT) AS n, CAST(round(sum(l_extendedprice) * 100) AS BIGINT) AS cents FROM x GROUP BY ALL")
def values_joined(spark, sf_dir):
    """Extracted values grouped like any other columns."""
    rows = frames.query(synth.messages(spark, sf_dir), {"nation": "PID-11", "flag": "OBX-5[2]", "price": "OBX-6"})
    pairs = F.arrays_zip(F.flatten("flag").alias("flag"), F.flatten("price").alias("price"))
    rows = rows.select(extract.first_value(F.col("nation")).cast("long").alias("nation"), F.explode(pairs).alias("z"))
    cents = F.round(F.col("z.price").cast("decimal(18,2)") * 100).cast("long")
    return rows.groupBy("nation", F.col("z.flag").alias("flag")).agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))


@_query("SELECT o_orderkey AS message_id, '[1] ' || string_agg(v, '') AS line FROM (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || ' ~ X' || o_custkey AS v FROM m) GROUP BY 1")
def rendered_lines(spark, sf_dir):
    """What the command line prints."""
    rows = frames.get_value(synth.messages(spark, sf_dir), "PID-3.1")
    return rows.select("message_id", F.get(frames.rendered(F.col("values")), F.lit(0)).alias("line"))


@_query(
    f"""SELECT o_orderkey AS message_id, 4 + 1 AS first_line, CAST(l_partkey AS VARCHAR) AS part, 'segment OBX found more than once' AS more, 'segment ZZZ not found' AS none, 'ORC|RE' AS orc
    FROM x WHERE n = 1 AND o_orderkey IN (SELECT o_orderkey FROM x WHERE n = 2)"""
)
def segments_by_name(spark, sf_dir):
    """The first, the only and all segments of a name; what is wrong is told for each message."""
    rows = frames.scan(synth.messages(spark, sf_dir)).where(frames.peek("OBX") > 1)
    rows = rows.select("message_id", frames.retrieve_first_segment("OBX").alias("f"), frames.retrieve_segment("OBX").alias("more"), frames.retrieve_first_segment("ZZZ").alias("none"), frames.retrieve_segment("ORC").alias("orc"))
    part = F.split_part(F.get("f.fields", F.lit(3)), F.lit("^"), F.lit(1))
    return rows.select("message_id", F.col("f.line_number").alias("first_line"), part.alias("part"), F.col("more.error").alias("more"), F.col("none.error").alias("none"), F.array_join(F.slice("orc.fields", 1, 2), "|").alias("orc"))


@_query("SELECT o_orderkey AS message_id, CAST(count(*) AS BIGINT) AS n, CAST(max(line) AS INTEGER) AS last_line FROM (SELECT o_orderkey, n + 4 + coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM x) GROUP BY 1")
def segment_maps(spark, sf_dir):
    """All segments of a name as a map from line to fields."""
    rows = frames.scan(synth.messages(spark, sf_dir)).select("message_id", frames.retrieve_multiple_segments("OBX").alias("m"))
    return rows.select("message_id", F.size("m").cast("long").alias("n"), F.array_max(F.map_keys("m")).alias("last_line"))


@_query("SELECT o_orderkey AS message_id, n AS occurrence, p_name AS name, l_returnflag AS flag FROM x")
def line_values(spark, sf_dir):
    """Paths over single segment lines, and a field split into its components."""
    rows = frames.scan(synth.messages(spark, sf_dir))
    rows = rows.select("message_id", "delimiters", F.posexplode(extract.named(F.col("segments"), "OBX")).alias("k", "line"))
    d = F.col("delimiters")
    name = F.get(frames.split_fields(F.col("line"), 3, d)["parts"], F.lit(1))
    return rows.select("message_id", (F.col("k") + 1).cast("long").alias("occurrence"), name.alias("name"), F.get(frames.segment_value(F.col("line"), "OBX-5[2]", d), F.lit(0)).alias("flag"))


@_query(
    """SELECT category, path, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(CASE o_orderkey % 9
        WHEN 0 THEN [{'category': 'INVALID_BATCH_SEGMENTS', 'path': 'BHS'}] WHEN 1 THEN [{'category': 'INVALID_BATCH_SEGMENT', 'path': 'BTS'}]
        WHEN 3 THEN [{'category': 'DUPLICATE_SEGMENT', 'path': 'FHS'}, {'category': 'INVALID_BATCH_SEGMENT', 'path': 'BHS'}]
        WHEN 4 THEN [{'category': 'INVALID_BATCH_SEGMENT', 'path': 'FTS'}, {'category': 'INVALID_BATCH_SEGMENT', 'path': 'BTS'}]
        WHEN 5 THEN [{'category': 'INVALID_FILE_HEADER_SEGMENT', 'path': 'FHS'}, {'category': 'INVALID_BATCH_SEGMENT', 'path': 'BHS'}]
        WHEN 6 THEN [{'category': 'INVALID_MESSAGE', 'path': 'MSH'}] WHEN 7 THEN [{'category': 'INVALID_BATCH_SEGMENTS', 'path': 'FTS'}]
        WHEN 8 THEN [{'category': 'INVALID_BATCH_SEGMENT', 'path': 'BTS'}] ELSE [] END, recursive := true) FROM m) GROUP BY ALL"""
)
def batch_checks(spark, sf_dir):
    """Batch envelopes that lack, repeat or misplace a segment, count wrongly, hold no message, or are as they should be."""
    k = F.col("message_id") % 9
    head = F.when(k == 0, "FHS|a\r").when(k == 3, "FHS|a\rFHS|a\rBHS|b\r").when(k == 5, "BHS|b\rFHS|a\r").otherwise("FHS|a\rBHS|b\r")
    tail = F.when(k == 1, "\rBTS|7\rFTS|1").when(k == 4, "\rFTS|1\rBTS|1").when(k == 7, "\rBTS|1").when(k == 8, "\rBTS|x\rFTS|1").otherwise("\rBTS|1\rFTS|1")
    text = F.when(k == 6, "FHS|a\rBHS|b\rBTS|0\rFTS|1").otherwise(F.concat(head, F.col("message"), tail))
    return validate.batch_errors(synth.messages(spark, sf_dir).select("message_id", text.alias("message"))).groupBy("category", "path").agg(F.count("*").alias("n"))


@_query("SELECT path, kind, CAST(place AS INTEGER) AS place FROM (VALUES ('PID-5.1', NULL, NULL), ('pid-1', 'InvalidSegmentName', 0), ('PID-', 'UnexpectedEnd', 4), ('OBX[1].5', 'UnexpectedSeparator', 6), ('OBX[x]-1', 'InvalidSegIndex', 4), ('OBX[1', 'InvalidSegIndex', 3), ('PID-x', 'InvalidFieldIndex', 4), ('OBX[@3<>''x'']', 'InvalidOperator', 6), ('OBX[@3=''x]', 'UnterminatedFilter', 8), ('PID-1 more', 'TrailingInput', 5), ('ORC -> OBR -> OBX', 'MultipleHierarchyHops', 10)) v(path, kind, place)")
def path_errors(spark, sf_dir):
    """What is wrong with paths that can't be read, and at which byte."""
    rows = []
    for path in ("PID-5.1", "pid-1", "PID-", "OBX[1].5", "OBX[x]-1", "OBX[1", "PID-x", "OBX[@3<>'x']", "OBX[@3='x]", "PID-1 more", "ORC -> OBR -> OBX"):
        try:
            parse(path)
            rows.append((path, None, None))
        except PathError as e:
            rows.append((path, e.kind, e.offset))
    return spark.createDataFrame(rows, "path string, kind string, place int")


@_query("SELECT o_orderkey AS message_id, CAST(n + 5 + coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY o_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_number, 'returned \\T\\ kept ' || l_partkey AS value FROM x QUALIFY l_returnflag = 'R'")
def located_children(spark, sf_dir):
    """Values two steps down, with the line they stand on."""
    rows = frames.located_values(synth.messages(spark, sf_dir), "OBR[1] -> OBX -> NTE-3", profile=PROFILE, hops="chain")
    return rows.select("message_id", F.col("line_number").cast("long").alias("line_number"), "value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

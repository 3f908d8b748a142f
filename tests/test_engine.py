import random

import pytest
from pyspark.sql import functions as F

from pipehat.functions import extract
from pipehat.functions.scan import scan_error_text
from pipehat.operators import deidentify, frames, validate
from pipehat.plans.path import PathError, parse
from pipehat.plans.profile import CardinalityError, Profile, cardinality
from pipehat.sources import files

from .plain import SCAN_FAILED, evaluate, lines_of, scan_error

HEAD = "MSH|^~\\&|LAB|FAC|||20200102030405||ORU^R01|7|P|2.5.1"
REPORT = "\r".join([HEAD, "PID|1||A^^^X&Y~B||NAME^FIRST", "OBR|1|||CODE^Long&Short", "OBX|1|NM|4711-0^T||Positive~Weak||5||||F", "OBX|2|NM|4712-8||Negative||7.5||||P", "OBX|3|ST|1-1||||nan||||F"])
ODD = "MSH#@%!$#a@b#\nPID#1##x@y$z%w\nOBX#1\n"

MESSAGES = [
    REPORT, REPORT + "\r", REPORT.replace("\r", "\n"), REPORT.replace("\r", "\r\n") + "\r\n", ODD, "MSH|^~\\&", "MSH|^~\\&\r\rPID|1", "MSH|^~\\&|\rPID|1\r\r", "MSH|^~\\&|\r\npid|1", "", "x", "MSH", "MSH|^~\\", "FHS|^~\\&\rMSH|^~\\&|",
    "MSH|^~\\&|é^ü\rPIDX|é~ü^ä|ß&s\rOBX|1\rOBX\rOBX||\rObX|", "MSH$@%!$$x\rPID$1$a@b", "MSH|^~\\&|a\rOBX|1|x~y~z|~|^a^|&b&\rOBX|2||~~|^^|&&\rOBX|+inf|-INF|1e3|.5|5.|1d| 1|0x1",
]
PATHS = [
    "MSH", "MSH-0", "MSH-1", "MSH-2", "MSH-2.1", "MSH-3", "MSH-12", "MSH-9.2", "PID", "PID-0", "PID-3", "PID-3[2]", "PID-3[2].1", "PID-3[9]", "PID-3[0]", "PID-3[$LAST].4.2", "PID-3.4.2", "PID-3.0", "PID-3.1.0", "PID-5.2", "PID-99", "PID-99.1",
    "OBX[1]-5", "OBX[0]-5", "OBX[2]-5", "OBX[9]-5", "OBX[$LAST]-1", "OBX[*]-5[*]", "OBX-5[2]", "OBX[2]", "ZZZ", "ZZZ-1", "OBX-4294967295", "OBX[4294967295]-1", "OBX-2[4294967295].4294967295",
    "OBX[@3.1='4711-0']-5", "OBX[@3.1='4711-0||4712-8']-5", "OBX[@3='4711-0']-5", "OBX[@11!='F']-1", "OBX[@11!='F||P']-1", "OBX[@11!='F||F']-1", "OBX[@99!='x']-1", "OBR[@4.2.2='Short']-4.1", "OBX[@3.1 = '1-1']-1", "OBX[@3='no']-1",
    "OBX[@7>'5']-1", "OBX[@7>='5']-1", "OBX[@7<'6||x']-1", "OBX[@7<'6||8']-1", "OBX[@7<='5']-1", "OBX[@1>'1']-1", "OBX[@1<'2.5e0||abc']-1", "OBX[@5>'1']-1", "ZZZ[@1>'x']-1", "OBX[@1>'nan']-1", "OBX[@1<'inf']-1", "OBX[@2>'-inf']-1", "OBX[@6>'1']-1",
    "OBX[@1>'-infinity']-2", "OBX[@3>'999']-1", "OBX[@4<'1']-1", "OBX[@5>='5']-1", "MSH[@0!='x']-3", "MSH[@3='LAB']-4",
]


def shown(r, name):
    error = r[f"{name}_error"]
    return SCAN_FAILED if r.scan_error else ("error", error.operator) if error else r[name]


def compare(spark, messages, paths):
    df = spark.createDataFrame(list(enumerate(messages)), "message_id int, message string")
    names = {f"p{i}": p for i, p in enumerate(paths)}
    for r in frames.query(df, names).collect():
        for name, p in names.items():
            assert shown(r, name) == evaluate(r.message, p), (r.message, p)


def test_paths_against_plain_evaluation(spark):
    for k in range(0, len(PATHS), 12):
        compare(spark, MESSAGES, PATHS[k : k + 12])


def test_random_messages(spark):
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("ab1|^~&\\.é") for _ in range(rng.randrange(14)))
    messages = ["MSH|^~\\&|" + text() + "".join(rng.choice(["\r", "\n", "\r\n"]) + rng.choice(["PID|", "OBX|", "OBX|", "NT|", "OBX"]) + text() for _ in range(rng.randrange(6))) for _ in range(150)]
    compare(spark, messages, ["OBX-1", "OBX[2]-2.1", "OBX[$LAST]-1[$LAST].2.1", "PID[@1!='a']-2", "OBX[@1>'0']-2", "OBX[@1.1='a||1']-1[2]"])


def test_scan(spark):
    df = spark.createDataFrame([*enumerate(MESSAGES), (99, None)], "message_id int, message string")
    rows = {r.message_id: r for r in frames.scan(df).withColumn("said", scan_error_text(F.col("scan_error"))).collect()}
    for i, m in enumerate(MESSAGES):
        want = scan_error(m)
        assert (tuple(rows[i].scan_error) if rows[i].scan_error else None) == want, m
        assert rows[i].segments == (None if want else lines_of(m)) and (rows[i].said is None) == (want is None)
        assert want or "".join(rows[i].delimiters) == m[3:8]
    assert rows[99].scan_error is None and rows[99].segments is None
    assert rows[8].said == "segment 1 at offset 11 has an unrecognized name"
    strict = frames.scan(spark.createDataFrame([("MSH|^~|A|B",), ("MSH|^~\\&#|A",), ("MSH|^~\\&|A",)], "message string"), strict_msh2=True).collect()
    assert [r.scan_error is None for r in strict] == [False, False, True]
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):
        frames.scan(df, on_error="failfast").collect()
    with pytest.raises(PathError):
        frames.query(df, {"x": "OBX[1].5"})


def test_spans_and_delimiters(spark):
    df = spark.createDataFrame(list(enumerate(MESSAGES)), "message_id int, message string")
    for r in frames.segments_long(df, with_spans=True).collect():
        assert MESSAGES[r.message_id].encode()[r.start : r.end].decode() == r.raw and r.name == r.raw[:3]
    found = {}
    for r in frames.delimiter_occurrences(df).collect():
        found.setdefault(r.message_id, []).append((r.offset, r.segment_index, r.kind))
    kinds = ("field", "component", "repetition", "escape", "subcomponent")
    for i, m in enumerate(MESSAGES):
        if scan_error(m) is None:
            raw, signs = m.encode(), m[3:8].encode()
            want = [(k, kinds[signs.index(bytes([b]))]) for k, b in enumerate(raw) if bytes([b]) in signs]
            assert [(o, k) for o, _, k in sorted(found[i])] == want


CARE = Profile.of({"segmentDefinition": {"MSH": {"children": {"PID": {"children": {"PV1": {}}}, "ORC": {"children": {"RXO": {"children": {"RXR": {}, "NTE": {}}}, "NTE": {}, "FT1": {"children": {"NTE": {}}}}}}}}})
VISIT = "\r".join([HEAD, "PID|1", "PV1|1", "ORC|1", "NTE|1|top", "RXO|1|asp", "RXR|1|po", "NTE|2|slow", "RXO|2|ibu", "ZXT|1", "FT1|1", "NTE|3|paid", "ORC|2", "PV1|9", "RXO|3|par"])


def test_hierarchy(spark):
    df = spark.createDataFrame([(1, VISIT)], "message_id int, message string")
    rows = frames.segments_long(df, profile=CARE).collect()
    assert [r.parent_index for r in rows] == [-1, 0, 1, 0, 3, 3, 5, 5, 3, None, 3, 10, 0, None, 12]
    one = lambda path, **o: frames.get_value(df, path, profile=CARE, **o).first()["values"]
    assert one("ORC[1] -> RXO-2") == [["asp"], ["ibu"]] and one("ORC -> RXO-2") == [["asp"], ["ibu"], ["par"]]
    assert one("ORC[2] -> FT1-1") == [] and one("ORC[9] -> RXO-2") == []
    assert one("ORC[1] -> RXO[2]-2") == [["ibu"]] and one("ORC[1] -> RXO[0]-2") == [] and one("ORC[1] -> RXO[1]-2", child_index="per_parent") == [["asp"]]
    assert one("ORC[1] -> NTE[0]-2") == [["top"]] and one("ORC[1] -> RXO[@2='ibu']-1") == [["2"]] and one("ORC[1] -> RXO[$LAST]-2") == [["ibu"]]
    assert one("FT1 -> NTE") == [["NTE|3|paid"]] and one("ORC -> RXO -> NTE-2", hops="chain") == [["slow"]] and one("ORC[1] -> RXO[1] -> NTE-2", hops="chain") == [["slow"]]
    assert one("ORC[1] -> RXO -> NTE-2", hops="legacy") is None and one("ORC -> RXO-2", build_hierarchy=False) is None
    assert frames.get_value(df, "ORC -> RXO-2").first()["values"] is None
    r = frames.get_value(df, "ORC -> RXO[@2>'1']-1", profile=CARE).first()
    assert r["values"] is None and r.values_error.operator == ">"
    with pytest.raises(PathError):
        one("ORC -> RXO -> NTE-2")
    where = lambda path, **o: [(r.line_number, r.occurrence, r.value) for r in frames.located_values(df, path, profile=CARE, **o).collect()]
    assert where("ORC -> RXO-2") == [(6, 1, "asp"), (9, 2, "ibu"), (15, 3, "par")] and where("ORC -> RXO -> NTE-2", hops="chain") == [(8, 1, "slow")]
    assert where("ORC[2] -> FT1-1") == [] and where("ORC[1] -> RXO[2]-2") == [(9, 1, "ibu")] and where("ORC -> RXO[@2>'1']-1") == [] and where("ORC -> RXO-2", build_hierarchy=False) == []
    with pytest.raises(PathError):
        where("ORC -> RXO -> NTE-2")


def test_segment_api(spark):
    df = frames.scan(spark.createDataFrame([(1, REPORT)], "message_id int, message string"))
    r = df.select(
        frames.peek("OBX").alias("n"), frames.retrieve_segment("PID").alias("pid"), frames.retrieve_segment("OBX").alias("many"), frames.retrieve_segment("ZZZ").alias("none"),
        frames.retrieve_first_segment("OBX").alias("first"), frames.retrieve_first_segment("ZZZ").alias("no_first"), frames.retrieve_multiple_segments("OBX").alias("all"),
        frames.split_fields(F.get("segments", F.lit(1)), 5, F.col("delimiters")).alias("split"), frames.split_fields(F.get("segments", F.lit(1)), 50, F.col("delimiters")).alias("bad"),
        frames.segment_value(F.get("segments", F.lit(3)), "OBX-5[2]", F.col("delimiters")).alias("value"), frames.segment_value(F.get("segments", F.lit(1)), "PID-4", F.col("delimiters"), True).alias("empty"),
    ).first()
    assert r.n == 3 and r.pid.line_number == 2 and r.pid.fields[5] == "NAME^FIRST" and r.pid.error is None and r.many.error and r.none.error and r.many.fields is None
    assert r.first.line_number == 4 and r.no_first.error and sorted(r.all) == [4, 5, 6] and r.split.parts == ["NAME", "FIRST"] and r.bad.error and r.value == ["Weak"] and r.empty is None
    first = frames.get_first_value(df, "OBX-5").first()
    assert first.value == "Positive"
    long = frames.values_long(df, {"v": "OBX-5"}).collect()
    assert [(x.occurrence, x.repetition, x.value) for x in long] == [(1, 1, "Positive"), (1, 2, "Weak"), (2, 1, "Negative"), (3, 1, "")]
    assert [(x.line_number, x.value) for x in frames.located_values(df, "OBX[@11='F']-1").collect()] == [(4, "1"), (6, "3")]
    assert frames.get_value(df, "OBX-5", remove_empty=True).first()["values"] == [["Positive", "Weak"], ["Negative"]] and frames.get_value(df, "PID-4", remove_empty=True).first()["values"] is None
    assert frames.get_value(df, "OBX-5").select(frames.rendered(F.col("values")).alias("x")).first().x == ["[1] Positive ~ Weak", "[2] Negative", "[3] "]


def test_escapes(spark):
    raw = r"a\F\b\S\c\R\d\E\e\T\f\H\g\N\h\.br\i\X4142\j\Z1\k\X4\l\F"
    df = spark.createDataFrame([(1, HEAD + "\rNTE|" + raw)], "message_id int, message string")
    assert frames.get_first_value(df, "NTE-1", decode_escapes=True).first().value == "a|b^c~d\\e&fgh\niABj\\Z1\\k\\X4\\l\\F"
    assert frames.get_first_value(df, "NTE-1").first().value == raw


def test_files_and_batches(spark, tmp_path):
    (tmp_path / "b.hl7").write_bytes(("FHS|^~\\&\rBHS|^~\\&\r" + REPORT + "\r" + VISIT + "\rBTS|2\rFTS|1\r").encode())
    df = files.read_messages(spark, f"{tmp_path}/b.hl7")
    assert df.first().message_id == "b.hl7" and validate.batch_errors(df).count() == 0
    got = files.debatch(df).collect()
    assert [(r.message_id, r.message) for r in got] == [("b.hl7_00001", REPORT + "\r"), ("b.hl7_00002", VISIT + "\r")]
    files.write_messages(spark.createDataFrame([(REPORT,), (VISIT + "\r",)], "message string").coalesce(1), f"{tmp_path}/out")
    again = files.read_messages(spark, f"{tmp_path}/out/*.txt", split=True).collect()
    assert [r.message.rstrip("\r") for r in again] == [REPORT, VISIT]
    assert [r.text for r in files.observation_text(df.limit(0)).collect()] == []
    (tmp_path / "rules.txt").write_text("# names\nPID-5.1,XX\n\nOBX,$REMOVE\n")
    report = files.deidentify_files(spark, f"{tmp_path}/b.hl7", f"{tmp_path}/rules.txt", f"{tmp_path}/safe")
    assert sorted(r.line_number for r in report.collect()) == [2, 4, 5, 6]
    safe = files.read_messages(spark, f"{tmp_path}/safe/*.txt", split=True).collect()
    assert len(safe) == 2 and not any("OBX" in r.message or "NAME" in r.message for r in safe)
    files.write_each(spark.createDataFrame([("a", REPORT), ("b", VISIT)], "message_id string, message string"), f"{tmp_path}/each")
    assert files.read_messages(spark, f"{tmp_path}/each/message_id=b/*.txt").first().message.rstrip("\r") == VISIT
    files.write_observation_text(spark.createDataFrame([("a", REPORT)], "message_id string, message string"), f"{tmp_path}/text")
    assert [r.value for r in spark.read.text(f"{tmp_path}/text").collect()] == ["Positive", "Weak", "Negative", ""]
    two = spark.createDataFrame([("f", "FHS|1\rMSH|a\rFTS|1\nFHS|2\nMSH|FHS|x")], "message_id string, message string")
    assert [r.message for r in files.split_batches(two).collect()] == ["FHS|1\rMSH|a\rFTS|1\n", "FHS|2\nMSH|FHS|x"]


def test_batch_errors(spark):
    cases = {
        "FHS|\rBHS|\rMSH|\rBTS|1\rFTS|1": [],
        "MSH|\rPID|": [],
        "BHS|\rFHS|\rMSH|\rBTS|1\rFTS|1": ["INVALID_BATCH_SEGMENT", "INVALID_FILE_HEADER_SEGMENT"],
        "FHS|\rBHS|\rMSH|\rMSH|\rBTS|1\rFTS|1": ["INVALID_BATCH_SEGMENT"],
        "FHS|\rBHS|\rBTS|0\rFTS|1": ["INVALID_MESSAGE"],
        "FHS|\rMSH|\rBTS|1\rFTS|1": ["INVALID_BATCH_SEGMENTS"],
        "FHS|\rBHS|\rBHS|\rMSH|\rBTS|1\rFTS|1": ["DUPLICATE_SEGMENT"],
    }
    df = spark.createDataFrame([(str(i), m) for i, m in enumerate(cases)], "message_id string, message string")
    got = {}
    for r in validate.batch_errors(df).collect():
        got.setdefault(r.message_id, []).append(r.category)
    assert {k: sorted(v) for k, v in got.items()} == {str(i): sorted(v) for i, v in enumerate(cases.values()) if v}


def test_validation(spark):
    profile = Profile.of(
        {
            "segmentDefinition": {"MSH": {"cardinality": "[1..1]", "children": {"PID": {"cardinality": "[1..1]"}, "OBR": {"cardinality": "[0..1]", "children": {"OBX": {"cardinality": "[1..2]"}}}, "NTE": {"cardinality": "[1..*]"}}}},
            "segmentFields": {
                "OBX": [
                    {"fieldNumber": 7, "name": "Value", "dataType": "NM", "usage": "R", "cardinality": "[1..1]", "maxLength": 2},
                    {"fieldNumber": 5, "name": "Text", "dataType": "ST", "usage": "C(7)", "cardinality": "[0..1]"},
                    {"fieldNumber": 2, "name": "Type", "dataType": "ID", "usage": "X", "cardinality": "[0..1]", "default": "NM"},
                    {"fieldNumber": 3, "name": "Code", "dataType": "CE", "usage": "R", "cardinality": "[1..1]"},
                ],
                "CE_": [],
                "CE": [{"fieldNumber": 2, "name": "Text", "dataType": "ST", "usage": "R"}],
            },
        }
    )
    df = spark.createDataFrame([(1, REPORT), (2, "bad")], "message_id int, message string")
    got = sorted((r.message_id, r.line, r.category, r.classification, r.path) for r in validate.validate_structure(df, profile).collect())
    want = [
        (1, 0, "INVALID_CARDINALITY", "ERROR", "NTE"), (1, 0, "INVALID_CARDINALITY", "ERROR", "OBX"),
        (1, 4, "INVALID_CARDINALITY", "ERROR", "OBX[1]-5"), (1, 5, "INVALID_FIELD_LENGTH", "ERROR", "OBX[2]-7"), (1, 6, "INVALID_FIELD_LENGTH", "ERROR", "OBX[3]-7"), (1, 6, "INVALID_FIELD_TYPE", "ERROR", "OBX[3]-7"),
        (1, 6, "INVALID_USAGE", "ERROR", "OBX[3]-5"), (1, 6, "INVALID_DEFAULT_VALUE", "ERROR", "OBX[3]-2"), (1, 4, "INVALID_USAGE", "WARNING", "OBX[1]-2"), (1, 5, "INVALID_USAGE", "WARNING", "OBX[2]-2"), (1, 6, "INVALID_USAGE", "WARNING", "OBX[3]-2"),
        (1, 5, "INVALID_USAGE", "ERROR", "OBX[2]-3.2"), (1, 6, "INVALID_USAGE", "ERROR", "OBX[3]-3.2"), (2, 1, "INVALID_MESSAGE", "ERROR", "MSH"),
    ]
    assert got == sorted(want)
    spot = validate.field_checks(df, profile).where("path = 'OBX[2]-7'").first()
    line = REPORT.split("\r")[4]
    assert line[spot.begin_column - 1 : spot.end_column - 1] == "7.5"
    assert {r.message_id: (r.n_errors, r.n_warnings) for r in validate.totals(validate.validate_structure(df, profile)).collect()} == {1: (10, 3), 2: (1, 0)}
    assert validate.check_segment_cardinality(df, "OBX", "[4..*]").count() == 1 and validate.check_segment_cardinality(df, "OBX", "[3..3]").count() == 0
    assert cardinality("[0..*]") == (0, None)
    for bad in ("[2..1]", "1..2", "[a..b]"):
        with pytest.raises(CardinalityError):
            cardinality(bad)


def test_rules(spark):
    df = spark.createDataFrame([(1, REPORT)], "message_id int, message string")
    rules = validate.load_rules({"rules": {"predicates": [{"name": "requiredIfNotEmpty", "field": "OBX-5", "reference": "OBX-3.1"}, {"name": "requiredIfEmpty", "field": "OBX-4", "reference": "PID-4"}, {"name": "requiredIfEmpty", "field": "OBX-4", "reference": "PID-3"}], "conformance": [{"name": "regEx", "field": "MSH-12", "reference": r"2\.5"}, {"name": "constant", "field": "OBX-11", "reference": "F"}, {"name": "existsUnique", "field": "PID-5.1"}, {"name": "existsUnique", "field": "PID-3.1"}]}})
    got = [(r.line, r.path) for r in validate.predicate_errors(df, rules["predicates"]).collect()]
    assert sorted(got) == [(4, "OBX[1]-4"), (5, "OBX[2]-4"), (6, "OBX[3]-4"), (6, "OBX[3]-5")]
    got = [(r.line, r.path) for r in validate.conformance_errors(df, rules["conformance"]).collect()]
    assert sorted(got) == [(0, "PID-3.1"), (1, "MSH[1]-12"), (5, "OBX[2]-11")]


def java(s):
    h = 0
    for k in range(0, len(raw := s.encode("utf-16-be")), 2):
        h = (h * 31 + int.from_bytes(raw[k : k + 2], "big")) & 0xFFFFFFFF
    h -= (h >> 31) << 32
    return str(h if h == -(1 << 31) else abs(h))


def test_deidentification(spark):
    df = spark.createDataFrame([(1, REPORT, "keep"), (2, "bad", "keep")], "message_id int, message string, other string")
    rules = ["PID-5.1,XX", "PID-3[2],$HASH", "OBX-5,***,OBX-11 = F", "OBX[2],$REMOVE", "OBR-4.2.2,q,PID-5.2 IN (FIRST;LAST)", "OBR-1,no,PID-5.2 !IN (FIRST)", "PID-99,zz", "PID-4,empty"]
    rows = {r.message_id: r for r in deidentify.deidentify(df, rules).collect()}
    want = REPORT.replace("NAME^", "XX^").replace("X&Y~B|", f"X&Y~{java('B')}|").replace("Positive~Weak", "***~***").replace("Long&Short", "Long&q")
    want = "\r".join(x for x in want.split("\r") if not x.startswith("OBX|2"))
    assert rows[1].message == want and rows[1].other == "keep" and rows[2].message is None and rows[2].redactions is None
    assert [(r.path, r.field_index, r.condition, r.line_number) for r in rows[1].redactions] == [("PID-5.1", 0, None, 2), ("PID-3[2]", 2, None, 2), ("OBX-5", 0, "OBX-11 = F", 4), ("OBX[2]", 0, None, 5), ("OBR-4.2.2", 0, "PID-5.2 IN (FIRST;LAST)", 3)]
    texts = ["hello", "", "é", "a𝄞b", "polygenelubricants", "x" * 50]
    got = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select(deidentify.java_hash(F.col("t")).alias("h")).collect()]
    assert got == [java(t) for t in texts] and java("polygenelubricants") == "-2147483648"
    for bad in ("PID-5,x,PID-1 IS 2", "PID-5,x,PID-1 = a b", "PID-5,x,PID-1 IN a", "MSH-2,x"):
        with pytest.raises(ValueError):
            deidentify.deidentify(df, [bad])


def test_plans_stay_native_and_narrow(spark):
    df = spark.createDataFrame([(1, REPORT)], "message_id int, message string")
    plan = frames.query(df, {"a": "OBX[@3.1='x']-5", "b": "OBR -> OBX-5"}, profile=CARE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert extract.NUMBER and parse("PID").last


def test_files_by_name(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.hl7").write_bytes((REPORT + "\r" + VISIT + "\r").encode())
    (tmp_path / "in" / "b.txt").write_bytes(REPORT.replace("NAME", "OTHER").encode())
    df = files.read_messages(spark, f"{tmp_path}/in/*")
    names = files.write_split(df, f"{tmp_path}/split", "part")
    assert names == ["part_00001.txt", "part_00002.txt", "part_00003.txt"] and sorted(x.name for x in (tmp_path / "split").iterdir() if x.suffix == ".txt") == names
    assert (tmp_path / "split" / "part_00002.txt").read_bytes().decode().rstrip() == VISIT
    (tmp_path / "rules.txt").write_text("PID-5.1,XX\n")
    report = files.deidentify_each(spark, f"{tmp_path}/in/*", f"{tmp_path}/rules.txt", f"{tmp_path}/safe")
    assert report.count() == 2
    safe = {x.name: x.read_bytes().decode() for x in (tmp_path / "safe").iterdir() if not x.name.startswith(".")}
    assert set(safe) == {"a_deidentified.hl7", "b_deidentified.txt"} and safe["b_deidentified.txt"].rstrip() == REPORT.replace("NAME", "XX")
    assert files.split_messages(spark.createDataFrame([("x", safe["a_deidentified.hl7"])], "message_id string, message string")).count() == 2
    files.write_clean(spark, f"{tmp_path}/in/*", f"{tmp_path}/text")
    text = {x.name: x.read_text() for x in (tmp_path / "text").iterdir() if not x.name.startswith(".")}
    assert text == {"a_clean.hl7": "Positive\nWeak\nNegative\n\n", "b_clean.txt": "Positive\nWeak\nNegative\n\n"}


def test_large_files_are_read_in_splits(spark, tmp_path):
    messages = ["\r".join([HEAD.replace("|7|", f"|{k}|"), f"PID|{k}||MSH^x", f"OBX|1|ST|c||{'v' * (k % 97)}"]) for k in range(3000)]
    (tmp_path / "big.hl7").write_bytes(("FHS|^~\\&\rBHS|^~\\&\r" + "\r".join(messages) + "\rBTS|3000\rFTS|1\r").encode())
    (tmp_path / "other.hl7").write_bytes("\r".join(messages[:3]).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = files.read_large(spark, f"{tmp_path}/*.hl7")
        assert rows.rdd.getNumPartitions() > 8
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.message for r in got) == sorted(messages + messages[:3]) and len({r.message_id for r in got}) == 3003
    assert {r.source_path.rpartition("/")[2] for r in got} == {"big.hl7", "other.hl7"}


def test_composites_and_dates(spark):
    fields = {
        "PID": [{"fieldNumber": 3, "name": "Ids", "dataType": "CX", "usage": "R", "cardinality": "[1..*]"}, {"fieldNumber": 7, "name": "Birth", "dataType": "TS"}],
        "CX": [{"fieldNumber": 1, "name": "Id", "dataType": "ST", "usage": "R"}, {"fieldNumber": 4, "name": "Authority", "dataType": "HD"}],
        "HD": [{"fieldNumber": 2, "name": "Universal", "dataType": "NM", "usage": "R"}],
    }
    cases = {"PID|1||A^^^N&1||||20200229": [], "PID|1||A^^^N&x||||20200231": [("PID[1]-3.4.2", "INVALID_FIELD_TYPE"), ("PID[1]-7", "INVALID_FIELD_TYPE")], "PID|1||A^^^N~^^^N&2||||2019": [("PID[1]-3.1", "INVALID_USAGE"), ("PID[1]-3.4.2", "INVALID_USAGE")], "PID|1||A||||20190229120000": [("PID[1]-7", "INVALID_FIELD_TYPE")]}
    df = spark.createDataFrame([(i, HEAD + "\r" + t) for i, t in enumerate(cases)], "message_id int, message string")
    got = validate.field_checks(df, Profile.of({"segmentFields": fields})).collect()
    for i, want in enumerate(cases.values()):
        assert sorted((r.path, r.category) for r in got if r.message_id == i) == want


def test_views_for_sql(spark):
    from pipehat import sql

    df = spark.createDataFrame([(1, REPORT), (2, VISIT), (3, "bad")], "message_id int, message string")
    sql.register(spark, df, "v", {"result": "OBX-5", "drug": "ORC -> RXO-2"}, profile=CARE)
    assert [r.value for r in spark.sql("SELECT value FROM v_values WHERE path = 'drug' ORDER BY occurrence").collect()] == ["asp", "ibu", "par"]
    assert spark.sql("SELECT count(*) AS n FROM v_segments s JOIN v_segments p ON s.message_id = p.message_id AND s.parent_index = p.segment_index WHERE p.name = 'ORC'").first().n == 5
    assert spark.sql("SELECT message_id FROM v_messages WHERE scan_error IS NOT NULL").first().message_id == 3
    assert sql.arrow(spark.table("v_values")).num_rows == spark.table("v_values").count()


def test_corpus_coverage():
    from pipehat.plans.coverage import coverage

    report = coverage(["PID-5.1", "OBX[@3.1='x||y']-5[2]", "ORC[1] -> RXO[$LAST]-2.1.1", "pid", "OBX[*]"])
    assert report["paths"] == 5 and report["rejected"] == {"pid": "InvalidSegmentName"}
    assert report["covered"]["filter"] == 1 and report["covered"]["child"] == 1 and report["covered"]["subcomponent"] == 1 and report["covered"]["last"] == 1
    assert report["missing"] == ["field_all", "field_last", "ordering"]

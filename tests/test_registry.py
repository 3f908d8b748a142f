import io

import duckdb
import pytest

import __spark_entry__
from pipehat import cli
from pipehat.plans import registry
from pipehat.sources import synth
from pipehat.streaming import stream

SF = "/root/testdata/sf0.001"


def results(spark, name):
    df = registry.QUERIES[name](spark, SF)
    return sorted(df.columns), sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", ["patient_parts", "observation_values", "filter_equals", "filter_ordering", "located", "child_values", "scan_errors", "batch_messages", "field_errors", "deidentified"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "part"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = con.execute(registry.SQL[name])
    columns = [c[0] for c in cursor.description]
    rows = sorted(tuple(str(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall())
    assert results(spark, name) == (sorted(columns), rows)


def test_every_query_has_sql_and_the_entry_works(spark):
    assert set(registry.QUERIES) == set(registry.SQL) and set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_streams(spark, tmp_path):
    head = "MSH|^~\\&|LAB||||20200102{}00||ORU^R01|{}|P|2.5.1\rPID|1"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.hl7").write_text("\r".join(head.format(t, i) for t, i in (("1000", 1), ("1001", 2), ("1002", 2), ("1011", 3))))
    (tmp_path / "in/b.hl7").write_text("not a message")
    rows = stream.with_header(stream.stream_messages(spark, f"{tmp_path}/in", split=True))
    q = stream.without_repeats(rows).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.control_id for r in spark.table("seen").collect()) == ["1", "2", "3"]
    q = stream.counts_by_type(rows).writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.message_type, r.n) for r in spark.table("counted").collect()) == [("ORU", 1), ("ORU", 3)]


def test_command_line(spark, tmp_path):
    (tmp_path / "m.hl7").write_bytes(b"MSH|^~\\&|a\rOBX|1|x~y\rOBX|2|z\r")
    (tmp_path / "bad.hl7").write_bytes(b"PID|1")

    def run(*args):
        out, err = io.StringIO(), io.StringIO()
        code = cli.run(spark, list(args), out, err)
        return code, out.getvalue(), bool(err.getvalue())

    m = str(tmp_path / "m.hl7")
    assert run(m, "OBX-2") == (0, "[1] x ~ y\n[2] z\n", False) and run("--first", m, "OBX-2") == (0, "x\n", False)
    assert run(m, "ZZZ-1") == (1, "(no match)\n", False) and run(m, "ZZZ-1", "--first") == (1, "(no match)\n", False)
    (tmp_path / "p.json").write_text('{"segmentDefinition": {"MSH": {"children": {"OBX": {}}}}}')
    assert run(m, "MSH -> OBX-1", f"--profile={tmp_path}/p.json") == (0, "[1] 1\n[2] 2\n", False)
    for args in ((m, "MSH -> OBX-1"), (m,), (m, "obx"), (str(tmp_path / "none"), "OBX-2"), (str(tmp_path / "bad.hl7"), "obx"), (m, "OBX[@2>'1']")):
        assert run(*args) == (2, "", True), args


def test_messages_are_whole(spark):
    assert synth.messages(spark, SF).count() == registry.QUERIES["peeked"](spark, SF).count()

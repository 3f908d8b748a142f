import pytest

from pipehat.plans.path import ALL, LAST, Field, Filter, Hop, Part, PathError, parse


@pytest.mark.parametrize(
    "path, hop",
    [
        ("PID", Hop("PID")),
        ("PID-5", Hop("PID", None, Field(Part(5)))),
        ("PID[*]-5", Hop("PID", ALL, Field(Part(5)))),
        ("Z1A[$LAST]-05[007].2.3", Hop("Z1A", LAST, Field(Part(5, 2, 3), 7))),
        ("PID[0]-0[$LAST].0", Hop("PID", 0, Field(Part(0, 0), LAST))),
        ("PID[4294967295]-1[*]", Hop("PID", 4294967295, Field(Part(1), ALL))),
        ("OBX[@3.1='4711-0||a_b.C']-5", Hop("OBX", Filter(Part(3, 1), "=", ("4711-0", "a_b.C")), Field(Part(5)))),
        ("OBX[@4.2.1 \t>=\t '7']", Hop("OBX", Filter(Part(4, 2, 1), ">=", ("7",)))),
    ],
)
def test_hops(path, hop):
    assert parse(path).hops == (hop,) and parse(path).source == path


@pytest.mark.parametrize(
    "path, kind, offset",
    [
        ("", "UnexpectedEnd", 0), ("PI", "InvalidSegmentName", 0), ("pid", "InvalidSegmentName", 0), ("9BC-1", "InvalidSegmentName", 0), ("ÄPID", "InvalidSegmentName", 0),
        ("PID[", "InvalidSegIndex", 3), ("PID[]", "InvalidSegIndex", 4), ("PID[ABC]-1", "InvalidSegIndex", 4), ("PID[4294967296]", "InvalidSegIndex", 4), ("PID[1 ]", "InvalidSegIndex", 4),
        ("PID ", "UnexpectedSeparator", 3), ("OBX[1].5", "UnexpectedSeparator", 6), ("PID-", "UnexpectedEnd", 4), ("PID-x", "InvalidFieldIndex", 4), ("OBX-5[ABC]", "InvalidFieldIndex", 6),
        ("OBX-5[", "InvalidFieldIndex", 5), ("OBX-5.", "InvalidFieldIndex", 6), ("OBX-5.1.", "InvalidFieldIndex", 8), ("OBX-5.1.2.3", "TrailingInput", 9), ("PID-1 extra", "TrailingInput", 5),
        ("OBX-99999999999", "InvalidFieldIndex", 4), ("OBX[@='a']", "InvalidSegIndex", 5), ("OBX[@3.='a']", "InvalidSegIndex", 7), ("OBX[@3=='a']", "InvalidOperator", 6), ("OBX[@3<>'a']", "InvalidOperator", 6),
        ("OBX[@3'a']", "InvalidOperator", 6), ("OBX[@3 'a']", "InvalidOperator", 7), ("OBX[@3=a]", "UnterminatedFilter", 7), ("OBX[@3.1='9945-3]-5", "UnterminatedFilter", 10), ("OBX[@3='']", "UnterminatedFilter", 8),
        ("OBX[@3='a||']", "UnterminatedFilter", 8), ("OBX[@3='a b']", "UnterminatedFilter", 8), ("OBX[@3='a'x]", "UnterminatedFilter", 10), ("OBX[@3='ä']", "UnterminatedFilter", 8),
        ("OBR->OBX", "InvalidFieldIndex", 4), ("OBR -> ", "UnexpectedEnd", 7), ("OBR -> x", "InvalidSegmentName", 7), ("OBR-4 -> OBX-5", "TrailingInput", 5),
        ("ORC[1] -> OBR[1] -> OBX-5", "MultipleHierarchyHops", 16), ("ORC -> OBR-1 -> OBX", "MultipleHierarchyHops", 12), ("ORC -> OBR-1x", "TrailingInput", 12),
    ],
)
def test_errors(path, kind, offset):
    with pytest.raises(PathError) as e:
        parse(path)
    assert (e.value.kind, e.value.offset) == (kind, offset) and str(e.value).endswith(f"(offset {offset})")


def test_steps():
    assert [h.name for h in parse("OBR[1] -> OBX-5").hops] == ["OBR", "OBX"]
    assert len(parse("OBR -> OBX[3] -> NTE-3", hops="chain").hops) == 3
    with pytest.raises(PathError):
        parse("OBR -> OBX-3 -> NTE-3", hops="chain")


def test_no_cut_of_a_path_raises_anything_else():
    whole = "OBX[@3.1.2 != 'a||b']-5[$LAST].1.2 -> NTE[*]-3[2]"
    for text in (whole, whole.replace("-5[$LAST].1.2", "")):
        for i in range(len(text) + 1):
            for cut in (text[:i], text[i:]):
                try:
                    parse(cut)
                except PathError:
                    pass

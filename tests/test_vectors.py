import json
from pathlib import Path

import pytest

from pipehat.plans.profile import Profile
from pipehat.sources import vectors

HERE = Path(__file__).parent / "vectors"
MESSAGES, PROFILES = (json.loads((HERE / f"{n}.json").read_text()) for n in ("messages", "profiles"))


def run(spark, cases):
    return vectors.run(spark, cases, MESSAGES.__getitem__, lambda name: Profile.of(PROFILES[name]))


@pytest.mark.parametrize("family, n", [("paths", 28), ("hierarchy", 10), ("scans", 8)])
def test_cases_hold(spark, family, n):
    cases = vectors.load(HERE / f"{family}.json")
    said = run(spark, cases)
    assert len(said) == n and {k: v for k, v in said.items() if v is not None} == {}


def test_what_differs_is_told(spark, tmp_path):
    path = {"id": "a", "path": "NTE-3", "message_ref": "three", "method": "getValue", "expected": [["low"]]}
    cases = [
        path, path | {"id": "b", "expected": [["low"], ["mid"], ["high"]], "expected_lines": [[1], [2], [3]]}, path | {"id": "c", "expected": "INVALID"}, path | {"id": "d", "path": "x", "expected": None},
        path | {"id": "e", "expected": vectors.NOT_NUMERIC}, path | {"id": "f", "path": "NTE[@3>'1']-1"}, {"id": "g", "message_ref": "scan_all", "expected_segments": []}, {"id": "h", "message_ref": "scan_all", "expected_error": {"kind": "MissingMsh"}},
    ]
    assert {k for k, v in run(spark, cases).items() if v} == set("abcdefgh")
    (tmp_path / "twice.json").write_text(json.dumps([path, path]))
    with pytest.raises(ValueError):
        vectors.load(tmp_path / "twice.json")

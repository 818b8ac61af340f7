import os

import pytest

from sparkloom.llm import registry

SF = "/root/testdata/sf0.001"
FOUND = {
    "p1_found": ["traj_a", "traj_b"], "p2_found": ["group_head", "source_id"], "p3_found": ["origin", "record_key", "pos", "line_no"], "p4_found": ["source_id", "path", "verdict"],
    "p5_found": ["doc_id", "case_id"], "p6_found": ["source"], "p7_found": ["doc_a", "doc_b"],
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_runs(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    df = registry.queries()[name](spark, SF)
    if name in FOUND:
        assert df.columns == FOUND[name]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))

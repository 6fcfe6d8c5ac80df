"""Every query runs on the smallest tables and gives the columns that are asked for."""

import pytest

from lexloom.llm.queries import queries

COLUMNS = {
    "p1_found": ["id_a", "id_b"], "p2_found": ["shard", "source", "lang", "topic"], "p3_found": ["tab_name", "rec_id", "seg_no", "lang"], "p4_found": ["id_a", "id_b"], "p5_found": ["sample_id", "defect"],
    "p6_found": ["raw_id", "kind"], "p7_found": ["spec_id", "doc_id"], "p8_found": ["mix_id", "source"], "p9_found": ["doc_id", "reading_level"],
}


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, data, name):
    out = queries()[name](spark, data)
    rows = out.collect()
    assert rows
    if name in COLUMNS:
        assert out.columns == COLUMNS[name]
        assert len(set(map(tuple, rows))) == len(rows)

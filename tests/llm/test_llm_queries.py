"""Every query of the subpackage runs on the smallest tables; those with SQL equal it."""

import pytest

from lodestone.llm import catalog
from tests.oracle import compare, connect

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    if name in SQL:
        compare(spark, connect(sf), sf, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, sf).columns


def test_found_columns(spark, sf):
    want = {"p2_found": ["chunk_a", "chunk_b"], "p3_found": ["chunk_id", "line_no"], "p4_found": ["chunk_id"], "p5_found": ["chunk_a", "chunk_b"], "p7_found": ["doc_id"], "p9_found": ["doc_a", "doc_b"]}
    for name, cols in want.items():
        df = QUERIES[name](spark, sf)
        assert df.columns == cols
        rows = df.collect()
        assert len(rows) == len(set(rows))
        if len(cols) == 2 and cols[1] != "line_no":
            assert all(r[0] < r[1] for r in rows)

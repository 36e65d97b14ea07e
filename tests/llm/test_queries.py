import pytest

from cairn.llm.queries import QUERIES, SQL
from tests.oracle import compare, views


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_and_matches(spark, data, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        compare(df, SQL[name], views(data))
    else:
        assert df.columns and df.count() > 0


COLUMNS = {"p2_found": ["id_a", "id_b"], "p4_found": ["id", "line_no", "defect"], "p5_found": ["item_id", "cut_kind"], "p6_found": ["id", "defect"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, data, name):
    assert QUERIES[name](spark, data).columns == COLUMNS[name]

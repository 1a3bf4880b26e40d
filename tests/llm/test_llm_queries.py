import os

import duckdb
import pytest

from tessera.llm import queries as llm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    cur = db.execute(llm.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert {tuple(r[c] for c in names) for r in llm.queries()[name](spark, SF).collect()} == set(cur.fetchall())


def test_found_queries_have_the_stated_columns(spark):
    want = {
        "p1_found": "vec_a bigint, vec_b bigint", "p2_found": "item_table string, item_id string, field string", "p3_found": "group_id bigint, field string, cand_id bigint",
        "p4_found": "kind string, key_a string, key_b string", "p5_found": "answer_id bigint, defect string", "p6_found": "doc_id string, page_no int, line_no int, kind string",
        "p7_ids": "doc_id bigint, ids array<int>", "p9_found": "doc_id bigint",
    }
    for name, ddl in want.items():
        df = llm.queries()[name](spark, SF)
        assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == ddl

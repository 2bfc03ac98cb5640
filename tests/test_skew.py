"""Every query again over tables in which one key holds a third of the rows."""

import pytest

from ledgermark import catalog
from tests.oracle import TABLES, compare, connect

SF = "/root/testdata/sf0.001"

# table: what to add so that one key reaches a third of the rows
HOT = {
    "lineitem": "SELECT * REPLACE (7 AS l_orderkey, (row_number() OVER ())::INTEGER AS l_linenumber) FROM lineitem USING SAMPLE 50 PERCENT (reservoir, 1)",
    "orders": "SELECT * REPLACE (o_orderkey + 1000000 AS o_orderkey, 3 AS o_custkey) FROM orders USING SAMPLE 50 PERCENT (reservoir, 1)",
    "documents": "SELECT d.* REPLACE (d.doc_id + 1000000 AS doc_id, h.text AS text) FROM documents d, (SELECT text FROM documents ORDER BY length(text) DESC LIMIT 1) h USING SAMPLE 50 PERCENT (reservoir, 1)",
    "events": "SELECT * REPLACE (event_id + 1000000 AS event_id, 5 AS user_id) FROM events USING SAMPLE 50 PERCENT (reservoir, 1)",
    "embeddings": "SELECT * REPLACE (vec_id + 1000000 AS vec_id, 0 AS label) FROM embeddings USING SAMPLE 50 PERCENT (reservoir, 1)",
    "conversations": "SELECT * REPLACE (2 AS conv_id, 10 + (row_number() OVER ())::BIGINT AS turn, 'user' AS role) FROM conversations",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    root = tmp_path_factory.mktemp("skewed")
    db = connect(SF)
    for name in TABLES:
        extra = f" UNION ALL {HOT[name]}" if name in HOT else ""
        db.execute(f"COPY (SELECT * FROM {name}{extra}) TO '{root}/{name}.parquet' (FORMAT parquet)")
    counts = f"SELECT count(*) AS n FROM '{root}/lineitem.parquet' GROUP BY l_orderkey"
    assert db.execute(f"SELECT max(n) / sum(n) FROM ({counts})").fetchone()[0] > 0.3
    return str(root)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(spark, skewed, name):
    problems, rows = compare(spark, connect(skewed), catalog.queries()[name], catalog.oracle_sql()[name], skewed)
    assert not problems
    assert rows > 0

"""Every query of the text operators over the smallest tables: stable columns, and SQL where there is some."""

import duckdb
import pytest

from velario.llm import queries

COLUMNS = {
    "p1_found": ["unit_kind", "unit_id"],
    "p2_found": ["doc_kind", "doc_id", "pii_type", "char_start"],
    "p3_found": ["record_kind", "record_id"],
    "p4_found": ["party_id_a", "party_id_b"],
    "p5_found": ["unit_kind", "unit_id", "char_start", "char_end"],
    "p6_found": ["doc_id", "noise_kind"],
    "p7_found": ["chunk_id"],
    "p8_ids": ["doc_id", "ids"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, tables, name):
    df = queries.queries()[name](spark, tables)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len(set(map(str, rows))) == len(rows)


def test_sql(spark, tables):
    c = duckdb.connect()
    for t in ("chunks", "chunk_limits"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        assert sorted(map(tuple, queries.queries()[name](spark, tables).collect())) == sorted(c.execute(sql).fetchall())

"""Every diversity query against its SQL on the smallest tables."""

import os

import pytest

from allelia.plans import file_queries, queries

QUERIES, ORACLE = queries.QUERIES | file_queries.QUERIES, queries.ORACLE | file_queries.ORACLE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("orders", "part", "nation", "supplier"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(ORACLE[name])
    want_columns, want = rel.columns, rel.fetchall()
    df = QUERIES[name](spark, SF)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    order = sorted(range(len(want_columns)), key=lambda i: want_columns[i])
    assert sorted(df.columns) == sorted(want_columns)
    rounded = lambda rows: sorted([tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in rows], key=repr)
    assert rounded(got) == rounded([tuple(r[i] for i in order) for r in want])


def test_block_queries_take_every_order(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    found = QUERIES["block_expand"](spark, SF)
    assert found.select("row_id").distinct().count() == orders and found.where("pos > 1000").count() > 0
    assert found.select("chrom", "pos").distinct().count() == found.count()


def test_numbers_of_the_written_lines_come_from_one_reading(spark):
    """A second reading of the file may be cut into other parts."""
    found = QUERIES["vcf_pi_file"](spark, SF)
    assert found.inputFiles() and not [f for f in found.inputFiles() if f.endswith(".txt")]
    assert sorted(r.line_number for r in found.collect()) == list(range(found.count()))

"""Files and catalogue tables."""

import pytest

from millrace import get, read, read_table, select, sift, write


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_round_trip(kind, spark, tmp_path, same):
    rows = [dict(n=i, s=f"x{i}") for i in range(5)]
    options = dict(header=True) if kind == "csv" else {}
    rows >> write(f"{tmp_path}/out", kind=kind, **options)
    same(read(f"{tmp_path}/out", kind, schema="n long, s string", **options) >> sift(lambda r: r.n > 2), rows[3:])


def test_catalogue(spark, same):
    spark.range(3).createOrReplaceTempView("three")
    same(read_table("three") >> select(n=get("id")), [dict(n=i) for i in range(3)])

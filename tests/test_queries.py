"""Every query against its SQL; those without SQL against themselves under another partitioning."""

from __future__ import annotations

import pytest

from sparkloom import queries as q

RUN, SQL = q.queries(), q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(same_rows, name):
    same_rows(RUN[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(RUN) - set(SQL)))
def test_repeatable(spark, sf_dir, name):
    from tests.conftest import rows_of

    first = rows_of(RUN[name](spark, sf_dir).toArrow())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows_of(RUN[name](spark, sf_dir).toArrow()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).count() == 5
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

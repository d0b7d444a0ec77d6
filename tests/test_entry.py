"""Registered queries of the core against their SQL, as far as the tables are there."""

import os

import duckdb
import pytest

import __spark_entry__
from tubal import catalog

FOLDER = "/root/testdata/sf0.001"


def rows_of(rows):
    return sorted((tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file[:-8]} as select * from read_parquet('{FOLDER}/{file}')")
    con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(con.fetchall()) == rows_of(got.select(*names).collect())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_tolerance_holds_takes_few_tasks(spark):
    """Each task sends some kB to the driver. Their number follows the tensor, not the shuffle partitions of large tables."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def tasks() -> dict[int, int]:
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).numCompleteTasks() for i in range(stages.size())}

    before, usual = max(tasks(), default=-1), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert all(r.within for r in catalog.QUERIES["tolerance_holds"](spark, FOLDER).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert 0 < sum(n for stage, n in tasks().items() if stage > before) < 300


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if os.path.isdir(FOLDER):
        row = __spark_entry__.entry(spark).first()
        assert row.relative_err <= 0.1
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)

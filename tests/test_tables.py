"""How the source tables are derived: the same rows at any size, over tasks that do not grow."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from claimspark.sources.store import TableStore
from harness import tables
from tests.conftest import values


@pytest.fixture
def folder(tmp_path):
    people = pa.table({"c_custkey": pa.array([*range(1, 400), 7, None], pa.int64())})
    orders = pa.table(
        {
            "o_orderkey": pa.array([*range(1, 800), 9, None], pa.int64()),
            "o_custkey": pa.array([k % 400 for k in range(801)], pa.int64()),
            "o_totalprice": pa.array([float(k) for k in range(801)]),
            "o_orderdate": pa.array(["1996-03-04"] * 801),
        }
    )
    lines = {c: pa.array([float(k % 9) for k in range(2000)]) for c in ("l_quantity", "l_extendedprice")}
    keys = {c: pa.array([k % 900 for k in range(2000)], pa.int64()) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")}
    for name, table in {"customer": people, "orders": orders, "lineitem": pa.table(keys | lines)}.items():
        pq.write_table(table, f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_enrollment_of_many_people_is_worked_out_by_many_tasks(spark, folder, monkeypatch):
    few = tables.beneficiary(spark, folder)
    monkeypatch.setattr(tables, "PEOPLE_PER_TASK", 50)
    many = tables.beneficiary(spark, folder)
    assert few.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() > 4
    assert values(few) == values(many) and many.count() == 401 * 9


def test_the_order_join_is_shuffled_once(spark, folder, with_conf, tmp_path):
    """By order only: its even parts are written as they are, not gathered by claim file first."""
    with_conf({"spark.sql.autoBroadcastJoinThreshold": "10MB"})
    joined = tables.order_line(spark, folder)
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning") == 2

    class Watched(TableStore):
        gathers = {}

        def table(self, name, build, partition_by=(), inputs=(), gather=True):
            self.gathers[name] = gather
            return super().table(name, build, partition_by, inputs, gather)

    store = Watched(f"{tmp_path}/store")
    tables.source_tables(spark, folder, store)["pde"].count()
    assert store.gathers == {"order_line": False}
    assert values(store.table("order_line", lambda: joined, ["k"], [folder])) == values(joined)

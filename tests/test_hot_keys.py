"""Every registered query against its SQL where a third of all rows have one customer, order, supplier and part."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import TABLES, connect, duck_rows, spark_rows

from sojourn.plans import queries_analyses  # noqa: F401  (fills the registry)
from sojourn.plans.registry import ORACLES, QUERIES
from sojourn.session import release

HOT = {"orders": ["o_custkey"], "lineitem": ["l_orderkey", "l_suppkey", "l_partkey"], "events": ["user_id"]}


@pytest.fixture(scope="module")
def hot_dir(sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hot"))
    for name in TABLES.split():
        source = f"{sf_dir}/{name}.parquet"
        if name not in HOT:
            os.symlink(source, f"{folder}/{name}.parquet")
            continue
        table = pq.read_table(source)
        hot = np.arange(table.num_rows) % 3 == 0
        for column in HOT[name]:
            values = table.column(column).to_numpy().copy()
            values[hot] = 1
            at = table.schema.get_field_index(column)
            table = table.set_column(at, table.schema.field(at), pa.array(values, table.schema.field(at).type))
        pq.write_table(table, f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_hot_keys_change_no_answer(spark, hot_dir, name):
    assert spark_rows(QUERIES[name](spark, hot_dir)) == duck_rows(connect(hot_dir), ORACLES[name])
    release(spark)

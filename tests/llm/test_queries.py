"""The registered queries on the smallest tables, and those with SQL against it."""

import pytest

import __spark_entry__ as driver
from tests.check import connect, differences

SF = "/root/testdata/sf0.001"
NAMES = [name for name in driver.queries() if name[:2] == "op" or name == "pipeline"]


def test_all_are_registered():
    assert {name.split("_")[0] for name in NAMES} == {"pipeline", *[f"op{n}" for n in range(1, 14)]}


@pytest.mark.parametrize("name", [n for n in NAMES if n in driver.oracle_sql()])
def test_query_equals_sql(spark, name):
    assert not differences(spark, connect(SF), SF, name)


ROWS = {"op1": "documents", "op2": "pages", "op3": "documents", "op5": "documents", "op8": "documents", "op9": "documents", "op10": "documents"}


@pytest.mark.parametrize("name", [n for n in NAMES if n.split("_")[0] in ROWS])
def test_a_row_for_each_row(spark, name):
    table = spark.read.parquet(f"{SF}/{ROWS[name.split('_')[0]]}.parquet")
    assert driver.queries()[name](spark, SF).count() == table.count()


def test_rules_against_labels(spark):
    """The labels play no part in fitting; junk goes and good documents stay."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = driver.queries()["op5_quality"](spark, "/root/testdata/sf0.01").where("not base_failed").collect()
    known = [(r["kept"], labels[r["doc_id"]] == 1) for r in judged if r["doc_id"] in labels]
    assert sum(kept == good for kept, good in known) >= 0.98 * len(known)

import os

import pytest

import __spark_entry__ as contract
import check

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


def test_every_checking_text_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


# One query per kind of work; `python check.py` runs all of them.
@pytest.mark.parametrize("name", [
    "read_train_transactions", "repair_lines", "export_geojson", "keep_near_target", "shop_index", "customer_near_pairs", "cluster_customer_points",
    "cluster_global_points", "dbscan", "cluster_features", "point_features", "spectrum_training_set", "match_by_shared_points",
])
def test_query_equals_its_checking_text(spark, con, name):
    verdict, rows = check.compare(contract.queries()[name](spark, SF_DIR), contract.oracle_sql()[name], con)
    assert verdict == "ok" and rows > 0

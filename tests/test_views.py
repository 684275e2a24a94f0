"""The views hold all rows of their tables."""

import os

import pytest

from framesift import views

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("view,table", [("v_videos", "customer"), ("v_probe", "orders")])
def test_all_customers_and_orders_take_part(spark, view, table):
    assert views.load(spark, SF, view).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()

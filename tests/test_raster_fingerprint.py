"""Rasters that differ anywhere in steps of 32 stay apart."""

import os

import pytest

from framesift import views
from framesift.plans.all_queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_the_whole_raster_is_fingerprinted(spark):
    want = {}
    for r in views.load(spark, SF, "v_raster").collect():
        want.setdefault((r["label"], tuple(p // 32 for p in r["px"])), []).append(r["vec_id"])
    got = QUERIES["fingerprint_dedup_raster"](spark, SF).collect()
    assert {(r["label"], r["vec_id"], r["copies"]) for r in got} == {(label, min(ids), len(ids)) for (label, _), ids in want.items()}

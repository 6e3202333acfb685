"""Registered queries against DuckDB on the smallest tables.

The whole registry takes a while; it runs with WAVECAIRN_ALL=1 (or tools_check.py SF_DIR). The
default run covers one query of every family.
"""

import os

import pytest

from checks import ORACLES, QUERIES
from tools_check import compare, duck

SF = "/root/testdata/sf0.001"
FAST = [
    "a5_crop", "b2_in_region", "b3_clock_to_offset", "c3_fill_window", "d2_apply_montage_packed", "d3_nearest_in_time",
    "e2_detector_features", "f1_robust_z_two_sided", "g5_cluster_annotations", "h3_roles", "k2_dfa_exponent", "l1_dwt",
    "l5_welch_psd", "m7_residual_verdict", "p1_detect",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("WAVECAIRN_ALL") else FAST)
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, duck(SF).execute(ORACLES[name]).df()) == ""

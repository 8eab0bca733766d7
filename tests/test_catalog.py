"""Registered queries against their check SQL on the smallest scale, one per family."""

import pytest
from check import compare, connect

from matchloom import catalog

SF = "/root/testdata/sf0.001"
NAMES = [
    "ag_shot_grid", "ag_save_report", "src_league", "zone10", "px_to_m", "wn_speed", "wn_sprint", "ag_heat", "wn_possession", "ag_team_stats",
    "jn_assist_asof", "ag_def_gap", "al_6m", "vs_topk", "jn_temporal_vote", "wn_tech_pass", "mt_shot_edit", "src_gallery_b64", "st_live_stats", "st_goal_wait",
]


def test_every_check_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    status, message, *_ = compare(spark, connect(SF), SF, name, catalog.queries()[name], catalog.oracle_sql()[name])
    assert status == "OK", message

"""Members and their submission folders: contained names, whole tokens first, none, ambiguous."""

from __future__ import annotations

from riskweave.sources.artifacts import match_members


def test_match(spark):
    members = spark.createDataFrame([("lgb_full",), ("cat_oof",), ("xgb_v2",), ("nn",), ("lgb_full",), ("_odd",), (None,)], "model string")
    folders = spark.createDataFrame([("LGBM_run",), ("catboost",), ("out-cat",), ("cat2",), ("lgb",), ("",), (None,), ("catboost",)], "folder string")
    got = {r[0]: tuple(r)[1:] for r in match_members(members, folders).collect()}
    assert got == {"lgb_full": ("lgb", True, 2), "cat_oof": ("out-cat", True, 3), "xgb_v2": (None, None, 0), "nn": (None, None, 0),
                   "_odd": (None, None, 0), None: (None, None, 0)}
    assert match_members(members.limit(0), folders).count() == 0
    assert {r[1] for r in match_members(members, folders.limit(0)).collect()} == {None}

"""Packed ranking of candidate blends against the grouped AUC of each candidate's scores."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import blend_auc as ba
from riskweave.operators import ensemble as ens
from riskweave.operators.metrics import roc_auc
from tests.test_refined_search import M, frame


def plain(wide, cands, groups=()):
    return {(i, *[r[g] for g in groups]): r["auc"] for i, c in enumerate(cands)
            for r in roc_auc(wide.withColumn("p", ens._blend(c, M)), group_cols=groups).collect()}


def test_pack_returns_the_same_doubles():
    v = np.sort(np.concatenate([np.random.default_rng(1).normal(0, 3, 999), [0.0, 0.0, -1e300, 1e-310, np.inf]]))
    assert (ba.unpack(ba.pack(v)) == v).all() and len(ba.unpack(ba.pack(v[:0]))) == 0


@pytest.mark.parametrize("ties", [False, True])
def test_many_ranges_and_chunks(spark, monkeypatch, ties):
    monkeypatch.setattr(ba, "RANGE_ROWS", 300)
    monkeypatch.setattr(ba, "CHUNK_ROWS", 200)
    wide, cands = frame(spark, 3000, ties=ties).cache(), ens.candidates(M, 9, 4)
    for groups in ((), ("fold",)):
        got = {(r["candidate"], *[r[g] for g in groups]): r["auc"] for r in ens.candidate_auc(wide, M, cands, groups).collect()}
        want = plain(wide, cands, groups)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_scores_outside_the_unit_interval_one_class_and_no_rows(spark):
    wide, cands = frame(spark, 400).withColumn("a", F.col("a") * 9 - 4).cache(), ens.candidates(M, 3, 4)
    got = {(r["candidate"],): r["auc"] for r in ens.candidate_auc(wide, M, cands).collect()}
    assert all(abs(got[k] - v) < 1e-12 for k, v in plain(wide, cands).items())
    assert [r["auc"] for r in ens.candidate_auc(wide.where("target = 1"), M, cands).collect()] == [None] * 3
    assert ens.candidate_auc(wide.limit(0), M, cands).count() == 0


def test_no_row_per_row_and_candidate(spark):
    """What leaves the map side is a packed array per chunk, candidate and range."""
    wide, cands = frame(spark, 4000).coalesce(1).cache(), ens.candidates(M, 20, 4)
    plan = ens.candidate_auc(wide, M, cands)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Union" not in plan       # before: inline of a struct per candidate, a union per 16
    rows = ba.ranked_pairs(wide, M, [[c[m] for m in M] for c in cands])
    assert rows.count() == 20

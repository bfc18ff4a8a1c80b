"""Artifact discovery: files are listed, with a reason where one is not usable."""

from __future__ import annotations

from riskweave.sources.artifacts import discover


def test_discover(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(10).selectExpr("id", "id / 10.0d as p")
    df.coalesce(1).write.parquet(f"{root}/good/oof")
    df.repartition(2).write.parquet(f"{root}/two/oof")
    df.limit(7).coalesce(1).write.parquet(f"{root}/short/oof")
    df.select("id").coalesce(1).write.parquet(f"{root}/bare/oof")
    df.limit(0).coalesce(1).write.parquet(f"{root}/none/oof")
    (tmp_path / "broken" / "oof").mkdir(parents=True)
    (tmp_path / "broken" / "oof" / "part.parquet").write_bytes(b"PAR1 not a table PAR1")
    (tmp_path / "broken" / "oof" / "empty.parquet").write_bytes(b"")         # passed over
    got = sorted((r.model, r.folder, r.n_rows, r.pred_col, r.reason) for r in discover(spark, root, 10).collect() if r.model != "two")
    assert got == [("bare", "oof", 10, None, "no prediction column"), ("broken", "oof", 0, None, "unreadable or empty"), ("good", "oof", 10, "p", None),
                   ("none", "oof", 0, None, "unreadable or empty"), ("short", "oof", 7, "p", "row count")]
    two = [r for r in discover(spark, root, 10).collect() if r.model == "two"]
    assert sum(r.n_rows for r in two) == 10 and {r.reason for r in two} == {None}

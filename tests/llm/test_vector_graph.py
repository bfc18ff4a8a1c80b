"""Op 12 against all cosines."""

import math

import numpy as np

from riskweave.llm import vector_graph as vg

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, node string"


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, threshold=0.98):
    """(id, n_links, component_id, kept) per row, by row."""
    n, links = len(rows), [[] for _ in rows]
    x = [np.array(v, np.float32).astype(float) if good(v) else None for _, v, _ in rows]
    x = [None if v is None else v / np.linalg.norm(v) for v in x]
    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold:
                links[i].append(j)
                links[j].append(i)
    out, seen = [], {}
    for i in range(n):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            low = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            seen.update(dict.fromkeys(group, low))
        out.append((rows[i][0], len(links[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "a", "b") for i, v, y in rows], SCHEMA)


def result(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def group(rng, centre, n, noise):
    return [(centre + rng.normal(size=len(centre)) * noise).astype(np.float32).tolist() for _ in range(n)]


def test_edge_cases(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 8))
    rows = [(1, a, 1), (2, 3 * a, 1), (3, a, 2), (4, a, None), (None, a, None), (5, None, 1), (6, [], 1), (7, [0.0] * 8, 1),
            (8, [float("nan")] + [1.0] * 7, 1), (9, [float("inf")] + [1.0] * 7, 1), (10, [None] + [1.0] * 7, 1), (11, a[:4], 1),
            (12, b, 1), (12, b, 1), (None, b, 1), (None, b, 3), (None, b, 3), (13, -a, 1), (14, [-0.0, 1, 0, 0, 0, 0, 0, 0], 1),
            (15, [0.0, 1, 0, 0, 0, 0, 0, 0], 1), (16, [1e30] + [0.0] * 7, 4), (17, [1e-30] + [0.0] * 7, 4)]
    rows = [(i, None if v is None else list(v), y) for i, v, y in rows]
    assert result(vg.near_duplicates(frame(spark, rows))) == brute(rows)
    assert vg.near_duplicates(frame(spark, [])).count() == 0


def test_groups_shards_and_tiles(spark):
    rng = np.random.default_rng(2)
    vectors = [v.tolist() for v in rng.normal(size=(500, 16)).astype(np.float32)]
    for size in (2, 3, 8, 150):                                    # 150: more than a shard
        vectors += group(rng, rng.normal(size=16), size, 0.02)
    vectors += [vectors[0]] * 40
    order = rng.permutation(len(vectors))
    rows = [(int(k), vectors[i], int(i) % 7 == 6 and 2 or 1) for k, i in enumerate(order)]
    want = brute(rows)
    for shard, limit in ((1024, 4096), (64, 96)):
        report = {}
        got = result(vg.near_duplicates(frame(spark, rows), shard=shard, limit=limit, report=report))
        assert report["found"] >= 0.95 * report["there"] > 0
        there = sum(r[1] for r in want)
        by_id, right = {r[0]: r for r in got}, {r[0]: r for r in want}
        assert all(by_id[i][1] <= right[i][1] for i in right)       # no link below the threshold
        assert sum(r[1] for r in got) >= 0.97 * there
        if shard == 1024:
            assert got == want


def test_pruned_lists():
    rng = np.random.default_rng(3)
    x = vg.unit(rng.normal(size=(300, 12)))
    src, dst = vg.robust_prune(x)
    edges = set(zip(src.tolist(), dst.tolist()))
    assert all((b, a) in edges and a != b for a, b in edges)
    sims = x @ x.T - 3 * np.eye(300)
    assert all((i, int(sims[i].argmax())) in edges for i in range(300))   # the nearest always stays
    first = np.searchsorted(src, np.arange(301))
    q, hit = vg.range_search(x, first, dst, vg.medoids(x), np.arange(300), 0.6)
    want = set(zip(*np.nonzero(x @ x.T >= 0.6)))
    assert set(zip(q.tolist(), hit.tolist())) <= want
    assert len(set(zip(q.tolist(), hit.tolist()))) >= 0.95 * len(want)

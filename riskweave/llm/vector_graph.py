"""Near duplicates of embeddings by a robust-pruned flat graph.

1. Equal vectors of a label become one node with a count.
2. Labels of more than ``SHARD`` nodes are clustered (spherical k-means on a bounded sample); each
   node joins its nearest clusters (``overlap`` of them; the nearest is its home): overlapping
   shards. Clusters whose centres are themselves near duplicates are one shard. A shard beyond
   ``LIMIT`` nodes is dealt into blocks, and each pair of blocks is a shard (tile), so a large group
   of near copies is split over tasks with no pair left out.
3. Each shard builds adjacency lists: every node's nearest nodes, robust-pruned (a neighbour goes
   where a kept one is closer to it by the factor ``ALPHA``), with reverse edges.
4. A node's lists from all its shards are united.
5. Each shard runs range-expanding greedy search over the united lists: from its medoids and the
   query's own node, expanding the most similar nodes seen and every node in range. Found pairs
   are verified by their cosine in double precision.
6. Recall is audited: the links of a bounded sample of nodes are counted against all nodes. Below
   ``RECALL`` the overlap is doubled and 3 to 5 are run again, until a node is in all clusters.

A task returns one row per node (its number of links and the smallest node it hangs together with
in the shard), never its pairs, so output does not grow with the square of a group. Components come
from those rows.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without a
label, link with nothing; so do vectors of different length. Rows are counted, so equal rows are
copies of each other, also with equal ids. Null ids do not count as the smallest; where a component
has no other, its id is null. Columns but id, vector and label are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm import common as c

#: Nodes that a cluster aims at, and that a shard holds at most.
SHARD, LIMIT = 1024, 4096
#: Clusters of all labels together (their centres are broadcast), and sampled nodes per cluster.
MAX_CLUSTERS, PER_CLUSTER = 4096, 32
#: Candidates and neighbours of a node, factor of the pruning, nodes expanded, medoids of a shard.
CANDIDATES, DEGREE, ALPHA, BEAM, MEDOIDS = 32, 12, 1.2, 8, 8
#: Cosine of centres from which clusters count as one.
SAME_CENTRE = 0.9
#: Audited nodes, and the recall aimed at.
AUDITED, RECALL = 1024, 0.95


def unit(vectors) -> np.ndarray:
    """Rows scaled to length 1 in double precision (first by their largest component)."""
    x = np.array(vectors, np.float64)
    x = x.reshape(len(vectors), -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(col) -> np.ndarray:
    """The rows of an Arrow list column of equal lengths."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


# ---------------------------------------------------------------- nodes and shards

def valid_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, g (class of rows that are compared), node (hash of label and vector; null where a row links
    with nothing), v."""
    v = F.col(vector_col)
    if vectors.schema[vector_col].dataType.elementType.typeName() not in ("float", "double"):
        v = v.cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    ok = F.coalesce(F.col("label").isNotNull() & fine & F.exists("v", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one number
    v = F.when(ok, F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(rows.schema["v"].dataType.elementType)).otherwise(x)))
    return rows.select("id", F.when(ok, F.xxhash64("label", F.size("v"))).alias("g"), v.alias("v")).select(
        "id", "g", F.when(F.col("g").isNotNull(), F.xxhash64("g", "v")).alias("node"), "v")


def cluster(k: int, seed: int = 5, rounds: int = 8):
    """Spherical k-means of a sample's unit vectors: the centres."""
    def fit(x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(seed)
        centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(rounds):
            near = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
        return centres
    return fit


def _merged(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the smallest row it hangs together with."""
    lab = np.arange(len(near))
    while True:
        low = np.where(near, lab[None, :], len(near)).min(axis=1, initial=len(near))
        new = np.minimum(lab, low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def centres(nodes: DataFrame, shard: int = SHARD) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """g -> (centres, cluster of each centre) of the classes of more than ``shard`` nodes."""
    sizes = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > shard)
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not total:
        return {}
    shard = max(shard, -(-total // MAX_CLUSTERS))             # so the clusters stay within their bound
    k = F.ceil(F.col("size") / F.lit(shard))
    share = F.least(F.lit(1.0), k * F.lit(PER_CLUSTER) / F.col("size"))
    picked = F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 30)) < share * F.lit(float(1 << 30))
    sample = nodes.join(sizes.where(F.col("size") > shard), "g").where(picked).select("g", "node", "v", k.cast("int").alias("k"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        found = cluster(int(pdf["k"].iloc[0]))(unit(np.stack(pdf["v"].to_numpy())))
        return pd.DataFrame({"g": pdf["g"].iloc[0], "i": np.arange(len(found)), "centre": list(found)})

    out: dict[int, list] = {}
    for r in sample.groupBy("g").applyInPandas(fit, "g long, i int, centre array<double>").orderBy("g", "i").collect():
        out.setdefault(r["g"], []).append(r["centre"])         # at most MAX_CLUSTERS rows and one per large class
    return {g: (x := np.array(v), _merged(x @ x.T >= SAME_CENTRE)) for g, v in out.items()}


def members(nodes: DataFrame, found: dict, overlap: int, limit: int = LIMIT) -> DataFrame:
    """The shards' rows: g, cell, lo, hi (blocks of the tile), block, home, node, n, v."""
    held = nodes.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        for batch in batches:
            gs = batch.column(0).to_numpy()
            rows, cells, homes = [], [], []
            for g in np.unique(gs):
                at = np.flatnonzero(gs == g)
                if g not in held.value:
                    rows.append(at)
                    cells.append(np.zeros(len(at), np.int64))
                    homes.append(np.ones(len(at), bool))
                    continue
                centre, same = held.value[g]
                sims = unit(_matrix(batch.column(3).take(pa.array(at)))) @ centre.T
                by_cell = np.full((len(at), len(centre)), -2.0)
                for i, cell in enumerate(same):
                    by_cell[:, cell] = np.maximum(by_cell[:, cell], sims[:, i])
                order = np.argsort(-by_cell, axis=1, kind="stable")[:, :overlap]
                for r in range(order.shape[1]):
                    ok = by_cell[np.arange(len(at)), order[:, r]] > -2.0
                    rows.append(at[ok])
                    cells.append(order[ok, r].astype(np.int64))
                    homes.append(np.full(ok.sum(), r == 0))
            pick = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), pa.array(np.concatenate(cells)), pa.array(np.concatenate(homes)),
                                              *(batch.column(i).take(pick) for i in (1, 2, 3))], ["g", "cell", "home", "node", "n", "v"])

    kind = nodes.schema["v"].dataType.simpleString()
    in_cell = nodes.select("g", "node", "n", "v").mapInArrow(run, f"g long, cell long, home boolean, node long, n long, v {kind}")
    large = (in_cell.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > limit)
             .select("g", "cell", F.ceil(F.col("size") * 2 / F.lit(limit)).cast("int").alias("blocks")))
    dealt = in_cell.join(large, ["g", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    return dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other")).select(
        "g", "cell", F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi"), "block", "home", "node", "n", "v")


SHARD_KEY = ("g", "cell", "lo", "hi")


# ---------------------------------------------------------------- graph

def robust_prune(x: np.ndarray, candidates: int = CANDIDATES, degree: int = DEGREE, alpha: float = ALPHA,
                 block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of the pruned lists of all rows of ``x`` (unit vectors), with reverse edges."""
    m, src, dst = len(x), [], []
    wanted = min(candidates, m - 1)
    if wanted < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    for a in range(0, m, block):
        sims = x[a:a + block] @ x.T
        b = len(sims)
        sims[np.arange(b), np.arange(a, a + b)] = -3.0         # not the node itself
        near = np.argpartition(-sims, wanted - 1, axis=1)[:, :wanted] if wanted < m else np.tile(np.arange(m), (b, 1))
        s = np.take_along_axis(sims, near, axis=1)
        order = np.argsort(-s, axis=1, kind="stable")
        near, s = np.take_along_axis(near, order, axis=1), np.take_along_axis(s, order, axis=1)
        among = np.einsum("bcd,bed->bce", x[near], x[near], optimize=True)
        far, apart = 2 - 2 * s, 2 - 2 * among                  # squared distances
        alive, kept = np.ones((b, wanted), bool), np.zeros(b, np.int64)
        keep = np.zeros((b, wanted), bool)
        for j in range(wanted):
            now = alive[:, j] & (kept < degree)
            keep[:, j], kept = now, kept + now
            alive &= ~(now[:, None] & (alpha * alpha * apart[:, j] <= far))
        r, j = np.nonzero(keep)
        src.append(a + r)
        dst.append(near[r, j])
    src, dst = np.concatenate(src), np.concatenate(dst)
    pairs = np.unique(np.concatenate((src * m + dst, dst * m + src)))
    return pairs // m, pairs % m


def build(table: pa.Table) -> pa.Table:
    """A shard's adjacency lists: node, near."""
    node = table["node"].to_numpy()
    order = np.argsort(node, kind="stable")
    node, x = node[order], unit(_matrix(table["v"]))[order]
    src, dst = robust_prune(x)
    offsets = np.searchsorted(src, np.arange(len(node) + 1)).astype(np.int32)
    return pa.table([pa.array(node), pa.ListArray.from_arrays(pa.array(offsets), pa.array(node[dst]))], names=["node", "near"])


def medoids(x: np.ndarray, n: int = MEDOIDS) -> np.ndarray:
    """The row closest to the mean, then rows far from those taken."""
    first = int((x @ x.mean(axis=0)).argmax())
    out, close = [first], x @ x[first]
    while len(out) < min(n, len(x)):
        nxt = int(close.argmin())
        out.append(nxt)
        close = np.maximum(close, x @ x[nxt])
    return np.array(sorted(set(out)))


def range_search(x: np.ndarray, first: np.ndarray, near: np.ndarray, starts: np.ndarray, queries: np.ndarray,
                 least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query row of ``queries``, node) pairs met with cosine ``least`` or more. ``first`` and ``near`` are
    the adjacency lists. The ``beam`` most similar nodes met and all in range are expanded, until
    none of them is left."""
    m, b = len(x), len(queries)
    sims, todo = np.full((b, m), -3.0), np.zeros((b, m), bool)

    def visit(rows, cols):
        new = sims[rows, cols] == -3.0
        key = np.unique(rows[new] * m + cols[new])
        rows, cols = key // m, key % m
        for a in range(0, len(rows), 1 << 16):
            r, k = rows[a:a + (1 << 16)], cols[a:a + (1 << 16)]
            sims[r, k] = np.einsum("ij,ij->i", x[queries[r]], x[k])
        todo[rows, cols] = True

    visit(np.repeat(np.arange(b), len(starts)), np.tile(starts, b))
    visit(np.arange(b), queries)
    while True:
        kth = np.partition(sims, m - min(beam, m), axis=1)[:, m - min(beam, m)]
        rows, cols = np.nonzero(todo & ((sims >= least) | (sims >= kth[:, None])))
        if not len(rows):
            break
        todo[rows, cols] = False
        for a in range(0, len(rows), 1 << 14):
            r, k = rows[a:a + (1 << 14)], cols[a:a + (1 << 14)]
            degree = first[k + 1] - first[k]
            within = np.arange(degree.sum()) - np.repeat(np.cumsum(degree) - degree, degree)
            visit(np.repeat(r, degree), near[np.repeat(first[k], degree) + within])
    return np.nonzero(sims >= least)


def search(threshold: float, block: int = 128):
    """A shard's nodes with links: node, links (of home nodes, rows of other nodes counted), root."""
    def run(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        order = np.argsort(node, kind="stable")
        node, x = node[order], unit(_matrix(table["v"]))[order]
        n, part, home = (table[k].to_numpy(zero_copy_only=False)[order] for k in ("n", "block", "home"))
        lists = table["near"].combine_chunks()
        lists = lists.take(pa.array(order))
        to = lists.flatten().to_numpy()
        src = np.repeat(np.arange(len(node)), np.diff(lists.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(node, to), len(node) - 1)
        ok = (node[at] == to) & (at != src)                    # neighbours outside the shard are not here
        src, near = src[ok], at[ok]
        first = np.searchsorted(src, np.arange(len(node) + 1))
        starts = medoids(x)
        linked = np.zeros((len(node), len(node)), bool)
        for a in range(0, len(node), block):
            queries = np.arange(a, min(a + block, len(node)))
            r, k = range_search(x, first, near, starts, queries, threshold - 1e-9)
            r = queries[r]
            for p in range(0, len(r), 1 << 16):                # the exact check
                i, j = r[p:p + (1 << 16)], k[p:p + (1 << 16)]
                linked[i, j] = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        if table["lo"][0].as_py() != table["hi"][0].as_py():    # pairs of one block belong to its own tile
            linked &= part[:, None] != part[None, :]
        linked |= linked.T
        np.fill_diagonal(linked, False)
        some = np.flatnonzero(linked.any(axis=1))
        linked = linked[np.ix_(some, some)]
        links = np.where(home[some], linked @ n[some], 0)
        root = node[some][_merged(linked)]
        return pa.table([pa.array(node[some]), pa.array(links.astype(np.int64)), pa.array(root)], names=["node", "links", "root"])
    return run


# ---------------------------------------------------------------- the operator

def audit(nodes: DataFrame, found: DataFrame, threshold: float, audited: int = AUDITED) -> tuple[int, int]:
    """(links found, links there are) of about ``audited`` nodes, compared with all nodes of their
    class. The sample is bounded: it is broadcast, and each task counts against its rows."""
    total = nodes.count()
    share = min(1.0, audited / max(total, 1))
    picked = nodes.where(F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = picked.select("g", "node", "v").limit(4 * audited).collect()
    classes: dict[int, list] = {}
    for r in rows:
        classes.setdefault(r["g"], []).append(r)
    sample = {g: (np.array([r["node"] for r in rs]), unit([r["v"] for r in rs])) for g, rs in classes.items()}
    held = nodes.sparkSession.sparkContext.broadcast(sample)

    def run(batches):
        for batch in batches:
            gs, node, n = (batch.column(i).to_numpy() for i in (0, 1, 2))
            for g in np.unique(gs):
                if g not in held.value:
                    continue
                at, (own, x) = np.flatnonzero(gs == g), held.value[g]
                hit = x @ unit(_matrix(batch.column(3).take(pa.array(at)))).T >= threshold
                hit &= own[:, None] != node[at][None, :]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array((hit @ n[at]).astype(np.int64))], ["node", "there"])

    there = nodes.select("g", "node", "n", "v").mapInArrow(run, "node long, there long").groupBy("node").agg(F.sum("there").alias("there"))
    got = there.join(found, "node", "left").agg(F.sum(F.least("there", F.coalesce("links", F.lit(0)))), F.sum("there")).first()
    return int(got[0] or 0), int(got[1] or 0)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.98, overlap: int = 2, shard: int = SHARD, limit: int = LIMIT,
                    report: dict | None = None) -> DataFrame:
    """Every row's id, n_links, component_id and kept (the row has its component's id). ``report``
    receives the audited links and the overlap that was used."""
    rows = valid_rows(vectors, id_col, vector_col, label_col)
    nodes = c.stage(rows.where("node IS NOT NULL").groupBy("g", "node", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
                    .select("g", "node", "n", "least", "v"))
    found = centres(nodes, shard)
    most = max((len(set(same.tolist())) for _, same in found.values()), default=1)
    while True:
        shards = members(nodes, found, overlap, limit)
        lists = (shards.groupBy(*SHARD_KEY).applyInArrow(build, "node long, near array<long>")
                 .groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
        links = c.stage(shards.join(c.stage(lists), "node").groupBy(*SHARD_KEY)
                        .applyInArrow(search(threshold), "node long, links long, root long"))
        per_node = links.groupBy("node").agg(F.sum("links").alias("links"))
        hit, there = audit(nodes, per_node, threshold)
        if report is not None:
            report.update(found=hit, there=there, overlap=overlap)
        if hit >= RECALL * there or overlap >= most:
            break
        overlap *= 2
    comps = c.components(links.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.select("node", "n", "least").join(per_node, "node", "left").join(comps, "node", "left").where("n > 1 OR links IS NOT NULL")
    known = known.withColumn("root", F.coalesce("root", "node"))
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(ids, "root").select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("id", "node").join(known.withColumn("_known", F.lit(True)), "node", "left")
    out = out.withColumn("component_id", F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

"""N-gram Jaccard self-join over size-banded tiles, exact at every size.

A document is its set of word n-grams (64-bit hashes, sorted). Two documents link when
``den * |A & B| >= num * |A | B|``.

* **Tiles.** Set sizes fall into geometric bands. A pair belongs to the tile of its smaller set's
  band, so a document stands in its own tile and in the few lower tiles whose sets it can match.
  Linked sets of a tile differ in at most ``d`` shingles. The hash range is cut into ``d + 1 + e``
  segments; linked sets agree on at least ``e + 1`` of them, hence on one that is not empty
  unless both have more than ``e`` empty segments (those repeat with another cut, a last resort
  key after four). A tile's cells are its (segment, content) keys: documents meet only in cells
  they agree on, so a passage or word that many documents share makes no large cell.
* **Bitmaps.** Each set has a 512-bit parity bitmap. The bits in which two bitmaps differ are a
  lower bound of the symmetric difference, and so bound the overlap from above.
* **Exact check.** Pairs that pass are intersected as sorted arrays.
* **Groups of copies.** Equal sets are one node. In each cell every node is first paired with the
  cell's smallest node only, then with the node before it; verified links make components. Only
  then are pairs of one cell that still lie in different components compared by their bitmaps,
  and verified where these allow a link. So a group of near copies costs about as many checks as
  it has members, and no link between different components is lost.

Hashes of shingles and of sets have 64 bits; a false link needs a collision among them.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm import common as c

BAND = 1.3
WORDS = 8                      # 64-bit words of a bitmap
CHUNK = 1 << 18                # bytes of text that a task works on at once
SALTS = 4
SLICES = 2                     # passes over the cells, each with its share of the keys: the shuffle of one stands at a time
U64 = np.uint64


@lru_cache(maxsize=None)
def bands(upto: int) -> tuple[int, ...]:
    """First set size of each band, far enough to hold ``upto``."""
    out = [1]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return tuple(out)


@lru_cache(maxsize=None)
def tile_cut(lo: int, hi: int, num: int, den: int) -> tuple[int, int]:
    """(segments, empty segments allowed) of the tile whose smaller sets have lo..hi shingles."""
    most = hi + hi * den // num
    total = np.arange(max(2, most - 64), most + 1)
    d = int(max(0, (total - 2 * -(-num * total // (num + den))).max()))
    e = 0
    while e < 4 * (d + 1):
        m = d + 1 + e
        mean = m * math.exp(-lo / m) if m > 1 else 0.0
        term, tail = math.exp(-mean), 1.0
        for k in range(e + 1):
            tail -= term
            term *= mean / (k + 1)
        if tail <= 0.005:
            break
        e += 1
    return d + 1 + e, e


def sets_of(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row: (hashes, offsets)."""
    words, row = c.word_hashes(c.lower_ascii(data), offsets)
    h, r, _ = c.shingles(words, row, len(offsets) - 1, n)
    return c.distinct_per_row(h, r, len(offsets) - 1)


def set_ids(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit id of each row's set (0 for the empty set)."""
    size = np.diff(off)
    out = np.zeros(len(size), U64)
    full = size > 0
    out[full] = c.mix64(c.run_sums(c.mix64(h + U64(0x5851F42D4C957F2D)), off[:-1][full]) + size[full].astype(U64)) | U64(1)
    return out


def _cells(h, sub, m, e, tile, salt):
    """Keys of one tile and cut: (key, set), and which sets have too many empty segments."""
    rot = h if salt == 0 else np.concatenate([np.sort(c.mix64(h[a:b] + U64(salt))) for a, b in zip(sub[:-1], sub[1:])])
    seg = ((rot >> U64(32)) * U64(m)) >> U64(32)
    owner = np.repeat(np.arange(len(sub) - 1), np.diff(sub))
    new = np.ones(len(rot), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    content = c.run_sums(c.mix64(rot + U64(0xA0761D6478BD642F)), at)
    own = owner[at]
    key = c.mix64(content + c.mix64(seg[at] + U64((tile * SALTS + salt + 1) << 32)))
    return key, own, (m - np.bincount(own, minlength=len(sub) - 1)) > e


def cell_keys(h: np.ndarray, off: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """All (key, row) cells of the rows' sets."""
    size = np.diff(off)
    top = int(size.max()) if len(size) else 0
    keys, rows = [], []
    starts = bands(top + 1)
    for t, (lo, nxt) in enumerate(zip(starts[:-1], starts[1:])):
        member = np.flatnonzero((size >= lo) & (size <= (nxt - 1) * den // num))
        m, e = tile_cut(lo, nxt - 1, num, den)
        for salt in range(SALTS):
            if not len(member):
                break
            sub = np.concatenate(([0], np.cumsum(size[member])))
            take = np.concatenate([h[off[i]:off[i + 1]] for i in member])
            key, own, over = _cells(take, sub, m, e, t, salt)
            keys.append(key)
            rows.append(member[own])
            member = member[over]
        if len(member):                                   # an exact last resort, not seen in practice
            keys.append(np.full(len(member), c.mix64(np.array([t], U64) + U64(77 << 40))[0]))
            rows.append(member)
    if not keys:
        return np.empty(0, U64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def _profile(id_type, n):
    """Per document (id, text, hash of the text): id, hash, node, set size, bitmap words."""
    names = [f"_w{k}" for k in range(WORDS)]

    def run(batches):
        for batch in c.tidy(batches):
            for a, b, data, offsets in c.text_chunks(batch.column(1), CHUNK):
                h, off = sets_of(data, offsets, n)
                owner = np.repeat(np.arange(b - a), np.diff(off)) * (64 * WORDS)
                odd = np.bincount(owner + (h & U64(64 * WORDS - 1)).astype(np.int64), minlength=(b - a) * 64 * WORDS) & 1
                bits = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(b - a, WORDS)
                node = set_ids(h, off).view(np.int64)
                size = np.diff(off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(node, mask=size == 0), pa.array(size, pa.int64()),
                     *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(WORDS)]],
                    names=["_id", "_th", "_node", "_n", *names])

    return run, f"_id {id_type}, _th long, _node long, _n long, " + ", ".join(f"{x} long" for x in names)


def _emit_cells(n, num, den, part, parts):
    """(key, node) cells of one of ``parts`` shares of the keys, of equal sets in a task only those of the first."""
    def run(batches):
        seen: set[int] = set()
        for batch in c.tidy(batches):
            for _, _, data, offsets in c.text_chunks(batch.column(0), CHUNK):
                h, off = sets_of(data, offsets, n)
                node = set_ids(h, off)
                fresh = np.zeros(len(node), bool)
                for i, x in enumerate(node.tolist()):
                    if x and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                size = np.diff(off)
                h, off, node = h[np.repeat(fresh, size)], np.concatenate(([0], np.cumsum(size[fresh]))), node[fresh]
                key, row = cell_keys(h, off, num, den)
                mine = key % U64(parts) == U64(part)
                key, row = key[mine], row[mine]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[row].view(np.int64))], names=["key", "node"])

    return run


def _verify(n, num, den):
    """Exact check of pairs (a, b, ta, tb): sorted-array intersection of the two sets."""
    def run(batches):
        for batch in c.tidy(batches):
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                ids = [part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
                sets = []
                for k in (2, 3):
                    data, offsets = c.text_buffers(part.column(k))
                    h, off = sets_of(data[offsets[0]:offsets[-1]], offsets - offsets[0], n)
                    sets.append((h, off, set_ids(h, off).view(np.int64)))
                (ha, oa, na), (hb, ob, nb) = sets
                good = []
                for i in range(part.num_rows):
                    if na[i] != ids[0][i] or nb[i] != ids[1][i]:
                        continue                            # another text with the same hash
                    x, y = ha[oa[i]:oa[i + 1]], hb[ob[i]:ob[i + 1]]
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.searchsorted(y, x)
                    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                    if den * both >= num * (len(x) + len(y) - both):
                        good.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(ids[0][good]), pa.array(ids[1][good])], names=["a", "b"])

    return run


def _side(nodes: DataFrame, x: str) -> DataFrame:
    """Size and bitmap of each node, named for one side of a pair."""
    return nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), *[F.col(f"_w{k}").alias(f"w{k}_{x}") for k in range(WORDS)])


def _may_link(num: int, den: int):
    """Whether the bitmaps of the sides a and b leave the overlap large enough."""
    differ = sum((F.bit_count(F.col(f"w{k}_a").bitwiseXOR(F.col(f"w{k}_b"))) for k in range(1, WORDS)),
                 F.bit_count(F.col("w0_a").bitwiseXOR(F.col("w0_b"))))
    both = F.least(F.floor((F.col("n_a") + F.col("n_b") - differ) / 2), "n_a", "n_b")
    return den * both >= num * (F.col("n_a") + F.col("n_b") - both)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4,
                       num: int = 85, den: int = 100) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles`` (size of its set) and ``component_id``,
    the smallest id reachable over links of Jaccard similarity ``num/den`` or more.

    Null, empty or blank texts have no shingles and are their own component; repeated rows each
    get a row; other columns of ``docs`` are not read. Null ids are not the smallest of a component
    that has others; texts are found again by id and hash, so rows without an id link like any. A
    very long text is one row of a task's batch, its hashes some 60 bytes a byte. An empty table
    gives an empty result."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_th"))
    run, schema = _profile(id_type, n)
    profile = c.stage(texts.mapInArrow(run, schema))
    nodes = c.stage(profile.where("_node is not null").groupBy(F.col("_node").alias("node")).agg(
        F.min("_id").alias("rep"), F.coalesce(F.min_by("_th", "_id"), F.first("_th")).alias("th"), F.first("_n").alias("n"), *[F.first(f"_w{k}").alias(f"_w{k}") for k in range(WORDS)]))

    # cells that hold two nodes or more: each node with the cell's smallest and the one before it
    w = Window.partitionBy("key").orderBy("node")
    stars = [c.stage(texts.select("_text").mapInArrow(_emit_cells(n, num, den, part, SLICES), "key long, node long")
                     .select("key", "node", F.first("node").over(w).alias("first"), F.lag("node").over(w).alias("prev"))
                     .where("node != first and node != prev")) for part in range(SLICES)]
    star = reduce(DataFrame.unionByName, stars)

    ids = star.select("node").unionByName(star.select(F.col("first").alias("node"))).distinct()
    wanted = nodes.join(ids, "node", "left_semi").select("node", "rep", "th")
    # one text per node, whatever the number of its copies; by one key, so that the texts are dealt once
    keyed = texts.select(F.xxhash64("_id", "_th").alias("at"), "_text")
    held = c.stage(keyed.join(wanted.select("node", F.xxhash64("rep", "th").alias("at")), "at").dropDuplicates(["at", "node"]).select("node", "_text"))

    def verified(pairs: DataFrame, held: DataFrame = held) -> DataFrame:
        """The links among pairs (a, b) that passed the bitmaps."""
        ta = held.select(F.col("node").alias("a"), F.col("_text").alias("ta"))
        tb = held.select(F.col("node").alias("b"), F.col("_text").alias("tb"))
        return c.stage(pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(n, num, den), "a long, b long"))

    def bounded(pairs: DataFrame) -> DataFrame:
        return pairs.join(_side(nodes, "a"), "a").join(_side(nodes, "b"), "b").where(_may_link(num, den)).select("a", "b")

    def rooted(df: DataFrame, root: DataFrame, x: str) -> DataFrame:
        return df.join(root.select(F.col("node").alias(x), F.col("root").alias(f"r_{x}")), x, "left").withColumn(f"r_{x}", F.coalesce(f"r_{x}", x))

    # first each node with the smallest node of most of its cells
    links = verified(bounded(star.groupBy(F.col("node").alias("b")).agg(F.mode("first", True).alias("a")).select("a", "b")))
    root = c.components(links)
    # then neighbours in cells that are still in different components
    near = star.where("prev != first").select(F.col("prev").alias("a"), F.col("node").alias("b")).distinct()
    links = links.unionByName(verified(bounded(rooted(rooted(near, root, "a"), root, "b").where("r_a != r_b").select("a", "b"))))
    root = c.components(links)
    # last all pairs of a cell that still are: the bitmaps are compared in the join
    known = rooted(rooted(star.select("key", "node", "first"), root, "node"), root, "first")
    open_keys = known.where("r_node != r_first").select("key").distinct()
    rest = c.stage(known.join(open_keys, "key", "left_semi"))
    member = rest.select("key", "node", F.col("r_node").alias("root")).unionByName(
        rest.select("key", F.col("first").alias("node"), F.col("r_first").alias("root")).distinct())
    x = member.select("key", F.col("node").alias("a"), F.col("root").alias("r_a")).join(_side(nodes, "a"), "a")
    y = member.select("key", F.col("node").alias("b"), F.col("root").alias("r_b")).join(_side(nodes, "b"), "b")
    pairs = x.join(y, (x["key"] == y["key"]) & (F.col("a") < F.col("b")) & (F.col("r_a") != F.col("r_b")) & _may_link(num, den)).select("a", "b").distinct()
    # few nodes are left: their texts are picked out before they are dealt to both sides of the pairs
    pairs = c.stage(pairs)
    asked = c.stage(held.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"))
    c.discard(*stars, held, rest)
    root = c.components(links.unionByName(verified(pairs, asked)))
    c.discard(pairs, asked)

    label = nodes.select("node", "rep").join(root, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    least = label.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_node = label.join(least, "root").select(F.col("node").alias("_node"), "component_id")
    return profile.join(of_node, "_node", "left").select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
             num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without the members of a near-duplicate group other than its smallest id (rows
    without shingles stay). Of repeated rows with the kept id all stay."""
    found = jaccard_components(docs, id_col, text_col, n, num, den)
    drop = found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("_drop")).distinct()
    return docs.join(drop, docs[id_col] == F.col("_drop"), "left_anti")

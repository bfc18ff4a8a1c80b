"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut by the vocabulary's pattern; each piece starts as a linked list of byte symbols with
a heap of its adjacent pairs by (merge rank, place). The lowest pair is popped and merged, its
new neighbours pushed; stale entries are skipped. The count is the initial symbols minus the
merges; no identifiers are built or emitted. Counts of pieces are kept per Python worker in a
table of bounded size.
"""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# pieces of text kept with their counts, and the longest piece that is kept
CACHE_PIECES, CACHE_CHARS = 400_000, 64
#: The splitting pattern of byte-level BPE (public_tokenizers.PATTERN).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BITS, _MASK = 20, (1 << 20) - 1


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def merged_length(symbols: list[int], pairs: dict[int, int]) -> int:
    """Symbols left after all merges. ``pairs``: (left, right) packed -> (rank, merged) packed."""
    n = len(symbols)
    if n < 2:
        return n
    get = pairs.get
    sym, nxt, prev = symbols, list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        p = get(sym[i] << _BITS | sym[i + 1])
        if p is not None:
            heap.append((p >> _BITS) << 40 | i)
    heapify(heap)
    left = n
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFFFF
        a, j = sym[i], nxt[i]
        if a < 0 or j >= n:
            continue
        p = get(a << _BITS | sym[j])
        if p is None or p >> _BITS != top >> 40:
            continue
        a = sym[i] = p & _MASK
        sym[j] = -1
        k = nxt[i] = nxt[j]
        left -= 1
        if k < n:
            prev[k] = i
            p = get(a << _BITS | sym[k])
            if p is not None:
                heappush(heap, (p >> _BITS) << 40 | i)
        h = prev[i]
        if h >= 0:
            p = get(sym[h] << _BITS | a)
            if p is not None:
                heappush(heap, (p >> _BITS) << 40 | h)
    return left


class Counter(dict):
    """Counts by piece of text; as a mapping it computes and keeps what it is asked for."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["model"]["type"] != "BPE" or spec["model"].get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        ids = {**byte_symbols()}
        self.pairs = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            new = ids.setdefault(a + b, len(ids))
            self.pairs[ids[a] << _BITS | ids[b]] = rank << _BITS | new
        if len(ids) > _MASK:
            raise ValueError("vocabulary too large")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.find = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        n = merged_length(list(piece.encode("utf-8")), self.pairs)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text; strings of special tokens count as one, as is the library's default."""
        if self.special is None or not (cuts := [m.span() for m in self.special.finditer(text)]):
            return sum(map(self.__getitem__, self.find(text)))
        ends, starts = [0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(text)]
        return len(cuts) + sum(self[p] for a, b in zip(ends, starts) for p in self.find(text[a:b]))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _count(path):
    def run(batches):
        count = counter(path).count
        for batch in batches:
            n = [count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per input row: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` of the whole text without added
    tokens, ``over_limit`` (more than ``limit``). ``vocabulary``: the vocabulary file's path on
    every executor.

    A null text counts as empty (0 tokens); repeated rows get a row each; other columns are not
    read; an empty table gives no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(_count(vocabulary), f"_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""External induced sorting of suffixes with common-prefix (LCP) values.

The input is a run of byte strings, each ended by a zero byte (``T``). Suffixes stop at their
string's end. S*-suffixes (an S-type after an L-type) are sorted first, through the reduced string
of the names of the S*-substrings; all L-type suffixes are then induced from left to right and all S-type suffixes from right to left. The priority queue of
each direction is keyed by first byte, then by arrival, which is already the right order; so it is
one first-in first-out queue per byte, written to disk beyond ``memory`` bytes. A queue's tuples
carry the suffix and its LCP with the tuple before it: one plus the least LCP met between the two
suffixes that induced them.
"""

from __future__ import annotations

import tempfile

import numpy as np

U64 = np.uint64
MEMORY = 256 << 20
CHUNK = 1 << 16                # tuples scanned at once: their range minima stay in a core's cache
FAR = np.iinfo(np.int32).max


class Queues:
    """A first-in first-out queue of (suffix, lcp) per byte; the longest goes to disk when all
    together hold more than ``memory`` bytes. The files have no name and go with the task."""

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0
        self.parts: dict[int, list] = {}
        self.files: dict[int, object] = {}

    def push(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts.setdefault(c, []).append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        while self.held > self.memory:
            big = max(self.parts, key=lambda k: sum(p.nbytes for p, _ in self.parts[k]))
            f = self.files.setdefault(big, None) or tempfile.TemporaryFile()
            self.files[big] = f
            for p, v in self.parts.pop(big):
                np.array([len(p)], np.int64).tofile(f)
                p.astype(np.int32).tofile(f)
                v.astype(np.int32).tofile(f)
                self.held -= p.nbytes + v.nbytes

    def drain(self, c: int):
        """Tuples of byte ``c`` in order, about ``CHUNK`` at a time, those pushed meanwhile included."""
        while c in self.parts or self.files.get(c):
            f, mem = self.files.pop(c, None), self.parts.pop(c, [])
            self.held -= sum(pos.nbytes + lcp.nbytes for pos, lcp in mem)
            yield from _joined(self._read(f))
            yield from _joined(mem)

    @staticmethod
    def _read(f):
        if f is not None:
            f.seek(0)
            while len(n := np.fromfile(f, np.int64, 1)):
                yield np.fromfile(f, np.int32, int(n[0])), np.fromfile(f, np.int32, int(n[0]))
            f.close()


def _joined(parts):
    """Small (suffix, lcp) parts joined to about ``CHUNK`` tuples, larger ones cut."""
    some, size = [], 0
    for part in parts:
        some.append(part)
        size += len(part[0])
        if size >= CHUNK:
            yield from _pieces(some)
            some, size = [], 0
    if some:
        yield from _pieces(some)


def _pieces(parts):
    pos, lcp = parts[0] if len(parts) == 1 else (np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts]))
    for lo in range(0, len(pos), 2 * CHUNK):
        yield pos[lo:lo + 2 * CHUNK], lcp[lo:lo + 2 * CHUNK]


def _words(T: np.ndarray, at: np.ndarray, left: np.ndarray, fill: np.ndarray | None = None) -> np.ndarray:
    """Eight bytes from each place as a big-endian number; beyond ``left`` bytes zero, or all bits
    set where ``fill``."""
    view = np.ndarray(shape=(len(T) - 7,), dtype=">u8", buffer=T, strides=(1,))
    w = view[np.minimum(at, len(T) - 8)].astype(U64)
    short = np.flatnonzero(left < 8)
    keep = np.maximum(left[short], 0).astype(U64) * U64(8)
    tail = np.where(keep == 0, ~U64(0), (U64(1) << (U64(64) - keep) % U64(64)) - U64(1))
    w[short] &= ~tail
    if fill is not None:
        w[short] |= np.where(fill[short], tail, U64(0))
    return w


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of each number."""
    bits = np.frexp((x >> U64(32)).astype(np.float64))[1]
    low = np.frexp((x & U64(0xFFFFFFFF)).astype(np.float64))[1]
    return (64 - np.where(bits > 0, bits + 32, low)) // 8


def _split_ties(order: np.ndarray, rank: np.ndarray, act: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Sort the places ``act`` of ``order``, which are whole groups of equal ``rank``, by ``key``
    within their groups. The rank of a new group is its first place. Returns the sorting of ``act``
    and whether the suffix at each place is still tied."""
    i = order[act]
    g = rank[i]
    if g[0] == g[-1]:
        k = np.argsort(key)
    elif key.dtype == U64:
        k = np.lexsort((key, g))
    else:                                                      # a rank or 0: both fit in one number
        k = np.argsort(g.astype(np.int64) * (len(order) + 1) + key)
    i, key, g = i[k], key[k], g[k]
    new = np.ones(len(i) + 1, bool)
    new[1:-1] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new[:-1])
    order[act] = i
    rank[i] = np.repeat(act[first], np.diff(first, append=len(i)))
    return k, ~(new[:-1] & new[1:])


def sort_stars(T: np.ndarray, end: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and LCPs of all S*-suffixes of ``T``, given in text order as ``pos``.

    The S*-substrings (up to the next S*-place of the string, this included, or to the string's
    end) are named in order, by eight bytes at a time. One that ends at an S*-place goes after one
    that it begins: bits set beyond its end say so. The reduced string of the names is sorted by
    doubling: ranks of 1, 2, 4, ... names, only ties going on. An LCP is read from the same ranks,
    longest first, and from the bytes of the first names that differ. ``T`` has eight zero bytes
    at its end."""
    m = len(pos)
    pos, order, rank, act = pos.astype(np.int32), np.arange(m, dtype=np.int32), np.zeros(m, np.int32), np.arange(m, dtype=np.int32)
    if not m:
        return pos, rank
    stop = end[pos].astype(np.int32)
    last = np.append(np.flatnonzero(stop[1:] != stop[:-1]), m - 1)
    rem = (np.repeat(last, np.diff(last, prepend=-1)) - np.arange(m) + 1).astype(np.int32)    # names from here to the string's end
    inner = rem > 1
    size = stop - pos
    size[:-1][inner[:-1]] = (np.diff(pos) + 1)[inner[:-1]]
    depth, equal = 0, np.zeros(m, bool)
    while len(act):
        i = order[act]
        left = size[i] - depth
        k, tied = _split_ties(order, rank, act, _words(T, pos[i] + depth, left, inner[i]))
        more = tied & (left[k] >= 8)
        equal[act] = tied
        act, depth = act[more], depth + 8
    act, levels, h, longest = np.flatnonzero(equal).astype(np.int32), [rank.copy()], 1, int(rem.max())
    while len(act) and h < longest:
        i = order[act]
        following = np.where(rem[i] > h, rank[np.minimum(i + h, m - 1)] + 1, 0)
        _, tied = _split_ties(order, rank, act, following)
        levels.append(rank.copy())
        act, h = act[tied], 2 * h
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(m, np.int32)
    ended = np.zeros(m - 1, bool)
    for level in range(len(levels) - 1, -1, -1):
        r, h = levels.pop(), 1 << level
        e = np.flatnonzero((r[a] == r[b]) & ~ended)
        x = a[e]
        goes = rem[x] > h
        lcp[1 + e] += np.where(goes, pos[np.minimum(x + h, m - 1)], stop[x]) - pos[x]
        ended[e[~goes]] = True
        a[e[goes]] += h
        b[e[goes]] += h
    e, depth = np.flatnonzero(~ended), 0
    while len(e):
        x, y = a[e], b[e]
        lx, ly = stop[x] - pos[x] - depth, stop[y] - pos[y] - depth
        differ = _words(T, pos[x] + depth, lx) ^ _words(T, pos[y] + depth, ly)
        both = np.minimum(lx, ly)
        lcp[1 + e] += np.minimum(_equal_bytes(differ), both)
        e, depth = e[(differ == 0) & (both > 8)], depth + 8
    return pos[order], lcp


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last] for each pair, from minima over spans of powers of two."""
    size = last - first + 1
    level = np.frexp(size.astype(np.float32))[1] - 1
    table = [values]
    while len(table) <= level.max():
        half = 1 << (len(table) - 1)
        wide = table[-1].copy()                                # the last places, with no full span, are never asked for
        np.minimum(table[-1][:-half], table[-1][half:], out=wide[:-half])
        table.append(wide)
    table = np.stack(table)
    return np.minimum(table[level, first], table[level, last - (1 << level) + 1])


def _scan(chunks, T, wanted, into: Queues, cur: np.ndarray, started: np.ndarray):
    """Push the suffixes that start one byte earlier and are ``wanted``; keep for each byte the
    least LCP since its last push. ``chunks`` are (suffix, lcp with the suffix scanned before)."""
    for pos, lcp in chunks:
        q = pos - 1                                            # -1 is the last zero byte, which is never wanted
        at = np.flatnonzero(wanted[q])
        if not len(at):
            np.minimum(cur, lcp.min(), out=cur)
            continue
        c = T[q[at]]
        order = np.argsort(c, kind="stable")
        at, c = at[order], c[order]
        first = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1))
        targets, stop = c[first], np.concatenate((first[1:], [len(at)]))
        since = np.concatenate(([0], at[:-1] + 1))
        since[first] = 0
        least = _least(lcp, since, at)
        least[first] = np.minimum(least[first], cur[targets])
        least += 1
        least[first[~started[targets]]] = 0
        started[targets] = True
        q = q[at]
        for t, x, y in zip(targets.tolist(), first.tolist(), stop.tolist()):
            into.push(t, q[x:y].copy(), least[x:y].copy())
        after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], FAR).astype(np.int32)
        np.minimum(cur, after[0], out=cur)
        cur[targets] = after[at[stop - 1] + 1]


def repeated(T: np.ndarray, end: np.ndarray, length: int, memory: int = MEMORY) -> np.ndarray:
    """For each place of ``T`` whether the ``length`` bytes from it also start elsewhere in ``T``
    (never beyond the end of its string). ``T``: strings each ended by one zero byte, which occurs
    nowhere else, and eight more zero bytes; ``end``: the place of the string's zero byte."""
    n = len(T) - 8
    out = np.zeros(n, bool)
    if not n:
        return out
    t = T[:n]
    # types; a run of one byte has the type of its last place
    last = np.append(np.flatnonzero((t[1:] != t[:-1]) | (t[1:] == 0)), n - 1)
    times = np.diff(last, prepend=-1)
    following = t[np.minimum(last + 1, n - 1)]
    is_s = np.repeat((t[last] == 0) | ((following > t[last]) & (last + 1 < n)), times)
    run = (np.repeat(last, times) - np.arange(n) + 1).astype(np.int32)
    star = np.zeros(n, bool)
    star[1:] = is_s[1:] & ~is_s[:-1]
    stars, star_lcp = sort_stars(T, end, np.flatnonzero(star & (t != 0)))
    first = t[stars]
    cuts = np.searchsorted(first, np.arange(257))
    ends_of_strings = np.flatnonzero(t == 0).astype(np.int32)

    def mark(pos, lcp, before):
        hit = lcp >= length
        out[pos[hit]] = True
        prev = np.concatenate(([before if before is not None else -1], pos[:-1]))[hit]
        out[prev[prev >= 0]] = True

    # left to right: L-types, from all L-types and S*-types
    queues, cur, started = Queues(memory), np.full(256, FAR, np.int32), np.zeros(256, bool)
    is_l = ~is_s
    found: dict[int, list] = {}
    _scan([(ends_of_strings, np.zeros(len(ends_of_strings), np.int32))], t, is_l, queues, cur, started)
    keep = Queues(memory)
    last_l = np.full(256, -1, np.int64)
    for c in range(1, 256):
        before = None

        def left_part():
            nonlocal before
            for pos, lcp in queues.drain(c):
                mark(pos, lcp, before)
                keep.push(c, pos, lcp)
                before = int(pos[-1])
                yield pos, lcp
            own, lcps = stars[cuts[c]:cuts[c + 1]], star_lcp[cuts[c]:cuts[c + 1]].copy()
            if len(own):
                lcps[0] = min(run[before], run[own[0]]) if before is not None else 0
                yield own, lcps

        _scan(left_part(), t, is_l, queues, cur, started)
        last_l[c] = -1 if before is None else before
    # right to left: S-types, from all S-types and L-types
    queues, cur, started = Queues(memory), np.full(256, FAR, np.int32), np.zeros(256, bool)
    s_wanted = is_s & (t != 0)
    for c in range(255, 0, -1):
        before = None

        def right_part():
            nonlocal before
            for pos, lcp in queues.drain(c):
                mark(pos, lcp, before)
                before = int(pos[-1])
                yield pos, lcp
            parts = list(keep.drain(c))
            after = None                                     # LCP of the next larger L-type with this chunk's largest
            for pos, lcp in reversed(parts):
                down = pos[::-1]
                with_next = np.concatenate(([0], lcp[:0:-1])).astype(np.int32)
                if after is not None:
                    with_next[0] = after
                elif before is not None:
                    with_next[0] = min(run[before], run[down[0]])
                    mark(down[:1], with_next[:1], before)
                after = int(lcp[0])
                yield down, with_next

        _scan(right_part(), t, s_wanted, queues, cur, started)
    return out

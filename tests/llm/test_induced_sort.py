"""The induced sort's repeats against a table of all substrings."""

import collections
import random

import numpy as np
import pytest

from riskweave.llm.induced_sort import repeated


def run(strings, length, **kw):
    T = np.frombuffer(b"".join(s + b"\0" for s in strings) + b"\0" * 8, np.uint8)
    end = np.concatenate([np.full(len(s) + 1, k) for s, k in zip(strings, np.cumsum([len(s) + 1 for s in strings]) - 1)]) if strings else np.empty(0, np.int64)
    got, at, out = repeated(T, end.astype(np.int64), length, **kw), 0, []
    for s in strings:
        out.append(got[at:at + len(s)].tolist())
        at += len(s) + 1
    return out


def brute(strings, length):
    seen = collections.Counter(s[i:i + length] for s in strings for i in range(len(s) - length + 1))
    return [[len(s) - i >= length and seen[s[i:i + length]] > 1 for i in range(len(s))] for s in strings]


@pytest.mark.parametrize("memory", [1 << 28, 200])
def test_random_strings(memory):
    rnd = random.Random(4)
    for trial in range(300):
        letters = rnd.choice([b"a", b"ab", b"abc", bytes(range(1, 60)), bytes(range(1, 256))])
        strings = [bytes(rnd.choice(letters) for _ in range(rnd.randrange(1, 40))) for _ in range(rnd.randrange(1, 9))]
        if rnd.random() < .5:
            strings += [s[rnd.randrange(len(s)):] + bytes([rnd.choice(letters)]) for s in strings]
        for length in (1, 2, 3, 7, 12):
            assert run(strings, length, memory=memory) == brute(strings, length), (trial, length, strings)


def test_long_repeats():
    rnd = random.Random(8)
    word = lambda k: bytes(rnd.choice(b"etaoin shrdlu") for _ in range(k))
    common = word(260)
    strings = [word(rnd.randrange(200)) + common[rnd.randrange(50):] + word(rnd.randrange(99)) for _ in range(40)] + [b"x" * 300, b"x" * 230]
    assert run(strings, 200) == brute(strings, 200)

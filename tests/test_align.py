"""Matching blocks of many pairs at once are those of ``difflib``."""

import difflib
import random

import numpy as np
import pytest

from logloom.functions import align


def model(a, b, least=3):
    return [(m.a, m.b, m.size) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= least]


def cases():
    rng = random.Random(4)
    out = [(b"", b""), (b"abc", b""), (b"", b"abc"), (b"aaaaaaaaaa" * 9, b"aaaa" * 9), (b"ab" * 60, b"ba" * 50), (b"abc", b"abc"), (b"\0\0\0\0", b"\0\0\0"), (b"xyz\0\0", b"xyz")]
    for k in range(160):
        words = [rng.choice([b"alpha", b"be", b"c", b"a", b"status=200", "é漢".encode(), b"request_id=%d" % rng.randrange(40)]) for _ in range(rng.randrange(0, 90))]
        out.append((b" ".join(words), b" ".join(w for n, w in enumerate(words) if n % 3 != k % 3)))
    for k in range(160):
        a = bytes(rng.choice(b"ab" if k % 2 else b"abcdef") for _ in range(rng.randrange(0, 120)))
        b = bytes(rng.choice(b"ab" if k % 2 else b"abcdef") for _ in range(rng.randrange(0, 120)))
        out.append((a, b if k % 4 else a[: len(a) // 2] + b + a[len(a) // 2 :]))
    return out


def found(pairs, least=3):
    a, b = (b"".join(p[k] for p in pairs) for k in (0, 1))
    ends = [np.cumsum([len(p[k]) for p in pairs]) for k in (0, 1)]
    rows, out = align.blocks(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8), *ends, least), [[] for _ in pairs]
    for i, j, k in rows.T.tolist():
        p = int(np.searchsorted(ends[0], i, side="right"))
        out[p].append((i - int(ends[0][p]) + len(pairs[p][0]), j - int(ends[1][p]) + len(pairs[p][1]), k))
    return out


@pytest.mark.parametrize("most", [align.MOST_PAIRS, 2_000, 0])
@pytest.mark.parametrize("least", [1, 3, 12])
def test_blocks_equal_difflib(monkeypatch, most, least):
    monkeypatch.setattr(align, "MOST_PAIRS", most)
    pairs = cases()
    assert found(pairs, least) == [model(a, b, least) for a, b in pairs]


def test_a_long_chunk_is_aligned_in_bounded_memory(monkeypatch):
    """Before, the time of one such pair was the square of its length in Python: minutes."""
    line = b"2024-01-01 00:00:00 INFO svc=click user=%d status=200 request_id=%d client_ip=10.0.0.1"
    a = b"\n".join(line % (k % 7, k) for k in range(600))
    b = b" ".join(w for k, w in enumerate(a.split(b" ")) if k % 3 != 2)
    (rows,) = found([(a, b)])
    assert sum(k for _, _, k in rows) > 0.8 * len(b) and all(a[i : i + k] == b[j : j + k] for i, j, k in rows)

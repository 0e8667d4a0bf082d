"""Induced sorting and the windows that it finds, against brute force."""

import random

import numpy as np
import pytest

from dupeplan.llm import substrings, suffixes


def strings(seed, n):
    """Random strings, strings with few symbols, runs, periods, one symbol, and copies with separators; a 0 ends each."""
    rng = random.Random(seed)
    for i in range(n):
        size = rng.randint(0, 250)
        period = [rng.randint(1, 4) for _ in range(rng.randint(1, 12))]
        block = [rng.randint(2, 5) for _ in range(40)]
        made = [
            lambda: [rng.randint(1, 3) for _ in range(size)],
            lambda: [rng.randint(1, 257) for _ in range(size)],
            lambda: [1 + (k // rng.randint(1, 9)) % 2 for k in range(size)],
            lambda: (period * size)[:size],
            lambda: [5] * size,
            lambda: [x for _ in range(6) for x in [*block[rng.randint(0, 20) : rng.randint(20, 40)], 1]],
        ][i % 6]()
        yield np.array([*made, 0], np.uint16 if max(made, default=0) > 255 or i % 2 else np.uint8)


def brute(text, width):
    """Suffixes but the last, the largest first, and what each shares with the one before."""
    own = text.tolist()
    order = sorted(range(len(own) - 1), key=lambda i: own[i:], reverse=True)

    def shared(a, b):
        k = 0
        while k < width and max(a, b) + k < len(own) and own[a + k] == own[b + k]:
            k += 1
        return k

    return order, [shared(a, b) for a, b in zip([None, *order], order) if a is not None]


@pytest.mark.parametrize(("block", "small"), [(1 << 17, 1 << 11), (1 << 17, 4), (3, 4), (16, 4)])
def test_order_and_common_prefixes(monkeypatch, block, small):
    """Blocks and groups of any size, and recursion down to a few symbols, give one order."""
    monkeypatch.setattr(suffixes, "BLOCK", block)
    monkeypatch.setattr(suffixes, "SMALL", small)
    for i, text in enumerate(strings(block + small, 120)):
        width = (1, 5, 30, 100)[i % 4]
        found = list(suffixes.descending(text, width, suffixes.Disk()))
        order = [int(x) for places, _ in found for x in places]
        shared = [int(x) for _, prefixes in found for x in prefixes]
        want, common = brute(text, width)
        assert order == want
        assert shared[1:] == common and (not shared or shared[0] == 0)


def test_queues_on_disk(tmp_path, monkeypatch):
    """Far more tuples than memory may hold give the same order; the files go afterwards."""
    monkeypatch.setattr(suffixes, "BLOCK", 32)
    rng = np.random.default_rng(3)
    text = np.append(np.tile(rng.integers(1, 6, 900), 4), 0).astype(np.uint16)
    plain = [np.concatenate(x) for x in zip(*suffixes.descending(text, 100, suffixes.Disk()))]
    disk = suffixes.Disk(f"file://{tmp_path}/queues", held=64)
    spilled = [np.concatenate(x) for x in zip(*suffixes.descending(text, 100, disk))]
    assert disk.spilled > 10_000 and all((a == b).all() for a, b in zip(plain, spilled, strict=True))
    disk.clear()
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_long_string_on_many_levels():
    """Neighbours of a long string's order ascend, symbol by symbol, down to where a doubled half begins."""
    rng = np.random.default_rng(5)
    half = rng.integers(1, 9, 30_000).astype(np.uint16)
    text = np.concatenate([half, half, [0]]).astype(np.uint16)
    order = np.concatenate([p for p, _ in suffixes.descending(text, 100, suffixes.Disk())])
    assert sorted(order.tolist()) == list(range(60_000))
    raw = text.astype(">u2").tobytes()
    for a, b in zip(order.tolist(), order[1:].tolist()):
        assert raw[2 * a :] > raw[2 * b :]


@pytest.mark.parametrize("block", [1 << 17, 5])
def test_copied_windows(monkeypatch, block):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    for i, text in enumerate(strings(7, 90)):
        length, own, seen = (2, 7, 12)[i % 3], text.tolist(), set()
        want = []
        for p in range(len(own)):
            window = tuple(own[p : p + length])
            want.append(len(window) == length and window in seen)
            seen.add(window)
        got = substrings.copied_windows(text, length, suffixes.Disk())
        assert got.tolist() == want


def test_ranges_cover_every_place_once():
    for length in (64, 65, 100, 255):
        found = substrings.ranges(length)
        assert [x for a, b in found for x in range(a, b)] == list(range(length - substrings.PICK + 1))

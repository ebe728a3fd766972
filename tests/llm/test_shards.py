import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from llm_rows import ROWS, documents, empty, pairs

from tertulia.llm import shards as S


def needed(sizes, capacity):
    """Shards that a walk over the groups needs, or None if one group is too large."""
    n, filled = 1, 0
    for s in sizes:
        if s > capacity:
            return None
        if filled + s > capacity:
            n, filled = n + 1, 0
        filled += s
    return n


def brute(sizes, shards):
    return next(c for c in range(max(sizes), sum(sizes) + 1) if needed(sizes, c) <= shards)


@pytest.mark.parametrize("shards", [1, 2, 3, 7, 40])
def test_capacity_is_the_smallest(shards):
    sizes = [8, 5, 13, 40, 8, 8, 9, 30, 2, 2, 2, 61, 7, 7]
    assert S.smallest_capacity(sizes, shards) == brute(sizes, shards)


@pytest.mark.parametrize("part", [0.0, 0.06, 0.1, 1 / 3])
@pytest.mark.parametrize("place", [0, 7_000, 20_000])
def test_other_shards_are_near_equal_beside_a_hot_group(part, place):
    draw = random.Random(4)
    sizes = [draw.randint(200, 2000) for _ in range(20_000)]
    hot = int(sum(sizes) * part / (1 - part))
    if hot:
        sizes.insert(place, hot)
    capacity = S.smallest_capacity(sizes, 24)
    cuts = [0, *S.fair(sizes, capacity, 24)]
    got = [sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert cuts[-1] == len(sizes) and max(got) <= capacity and min(got) > 0
    others = [g for g in got if not hot or g < hot]
    assert len(others) >= 23 and max(others) < 1.1 * min(others)


@pytest.mark.parametrize("seed", range(60))
def test_fair_cuts_keep_the_capacity(seed):
    draw = random.Random(seed)
    sizes = [draw.choice([8, 9, 20, 50, 400]) for _ in range(draw.randint(1, 40))]
    shards = draw.randint(1, 12)
    cuts = [0, *S.fair(sizes, brute(sizes, shards), shards)]
    got = [sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert len(got) == shards and sum(got) == sum(sizes) and max(got) <= brute(sizes, shards)
    assert sum(g > 0 for g in got) == min(shards, len(sizes))


def digest(text):
    return "" if text is None else hashlib.sha256(text.encode()).hexdigest()


def check(rows, found, shards):
    groups = Counter()
    for _, t in rows:
        groups[digest(t)] += len((t or "").encode()) + 8
    got, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        got[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[r["digest"]].add(r["shard"])
    assert len(found) == len(rows)
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(got.values()) == brute([groups[k] for k in sorted(groups)], shards)


def test_edge_rows(spark):
    found = S.sharded(documents(spark), 3).collect()
    check(ROWS, found, 3)
    for r in found:
        if r["doc_id"] == 3:
            assert (r["size"], r["text_crc32"]) == (8, None)
        if r["doc_id"] == 9:
            assert r["text_crc32"] == zlib.crc32(ROWS[9][1].encode())


def test_hot_group_and_refined_ranges(spark, monkeypatch):
    rows = [(i, "same text") for i in range(400)] + [(1000 + i, f"text {i} " * (i % 7)) for i in range(600)]
    monkeypatch.setattr(S, "RANGES", 64)
    check(rows, S.sharded(pairs(spark, rows), 6).collect(), 6)


def test_no_shard_is_empty_beside_a_hot_group(spark):
    rows = [(i, "same text " * 9) for i in range(1200)] + [(5000 + i, f"other text {i} " * 6) for i in range(2400)]
    found = S.sharded(pairs(spark, rows), 24).collect()
    check(rows, found, 24)
    got = Counter()
    for r in found:
        got[r["shard"]] += r["size"]
    others = sorted(got.values())[:-1]
    assert len(got) == 24 and others[-1] < 1.2 * others[0]


def test_empty(spark):
    assert S.sharded(empty(spark), 4).count() == 0

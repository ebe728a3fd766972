import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tertulia.llm import tries as R
from tertulia.llm.radix import Few, Full, Indexed, Tree

SCHEMA = "conv_id long, turn long, role string, text string, path string, words int, pid int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def tid(role, text):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    return md5(md5(role) + md5(text))


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, tid(role, text), (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    out = []
    for p, of in members.items():
        subtree = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in subtree if q)
        leaves = [q for q in subtree if not any(len(x) == len(q) + 1 and x[:-1] == q for x in members)]
        ends = ",".join(map(str, sorted(c for c in of if whole[c] == p)))
        out.append((
            min(of), len(p), min(members[p[:-1]]) if p else None, len(of),
            sum(1 for x in subtree if len(x) == len(p) + 1), len(leaves), saved,
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def got(df):
    fields = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert df.columns == fields
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(n=90, seed=3, hot=0.4):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        if draw.random() < hot:
            turns = [("user", "hello there"), ("assistant", "hi you")] + [("user", "go on")] * draw.randint(0, 3)
        else:
            turns = [(draw.choice(["user", "assistant", None]), draw.choice(["a", "a b", "", None, "c  d\x0be"]))
                     for _ in range(draw.randint(1, 6))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows_a_task", [3, 100_000])
def test_brute_force(spark, monkeypatch, rows_a_task):
    monkeypatch.setattr(R, "ROWS_A_TASK", rows_a_task)
    monkeypatch.setattr(R, "IDS_A_TEXT", 2)
    rows = conversations()
    assert got(R.prefix_trie(frame(spark, rows))) == brute(rows)


def test_edges(spark):
    rows = [(7, 0, "user", "x"), (None, 0, "user", "lost"), (-25, None, None, None), (-25, 1, "u", "b"), (-25, 1, "u", "b"),
            (-20, 0, "u", "base"), (40, 0, "u", "w " * 40_000), (41, 0, "u", "w " * 40_000), (41, None, "s", ""),
            (3, 0, "u", "only"), (3, 0, "v", "tie"), (23, 0, "a", "b")]
    assert got(R.prefix_trie(frame(spark, rows))) == brute(rows)
    # conversations that are left without a turn end at the root
    alone = [(c, 0, "u", "x") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    assert got(R.prefix_trie(frame(spark, alone))) == brute(alone)
    assert R.prefix_trie(frame(spark, [])).count() == 0


def test_one_conversation_many_times(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_A_TASK", 40)
    monkeypatch.setattr(R, "IDS_A_TEXT", 7)
    rows = [(c * 20, t, "u", f"turn {t}") for c in range(200) for t in range(3)]
    rows += [(c * 20, t, "u", f"turn {t} of {c}") for c in range(200, 260) for t in range(2)]
    assert got(R.prefix_trie(frame(spark, rows))) == brute(rows)


def test_layouts_grow():
    tree = Tree()
    kinds = set()
    for n in range(256):
        tree.put(bytes([7, n, 1, 2]), n)
        kinds.add((type(tree.root.kids), getattr(tree.root.kids, "room", None)))
    assert kinds == {(Few, 4), (Few, 16), (Indexed, None), (Full, None)}


def test_a_tree_holds_what_was_put():
    draw = random.Random(2)
    keys = {bytes(draw.choices(b"\x00\x01\xfe\xff", k=draw.randint(0, 9))) for _ in range(600)}
    tree = Tree()
    for k in keys:
        tree.put(k, k)
    seen = [n.value for n, _, _ in tree.upwards() if n.value is not None]
    assert sorted(seen) == sorted(keys)
    for node, begin, end in tree.upwards():
        assert node.value is None or len(node.value) == end
        assert end - begin == len(node.prefix) + 1

"""Byte-level BPE by rank files: whole texts to token ids and back.

A minimal perfect hash over the vocabulary answers pre-tokens that are tokens already.
The others are merged by pair ranks, lowest rank first and leftmost among equals: thousands
of short ones side by side, a merge each at a time, and long ones with a heap over a linked
list of their bytes. Text is cut where white space follows something else, which no
pre-token spans; such pieces are remembered by each worker, in a table of bounded size.

Every byte value must be a token of its own. A null text counts as empty and gives no
ids; repeated rows are encoded each; extra columns stay, but for those that have the name
of an output, which are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, types as T

from tertulia.llm.store import with_computed
from tertulia.llm.words import buffers, runs

REMEMBERED, LONGEST_REMEMBERED = 200_000, 48
SHORT, SIDE_BY_SIDE, UNITS_AT_ONCE = 63, 2048, 200_000
NO_PAIR = 1 << 56  # a rank that no pair has
WORD = (1 << 64) - 1
SPREAD, TURN = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15

ASCII_BLANKS = "\t\n\x0b\x0c\r"
OTHER_BLANKS = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
UNITS = regex.compile(r"\s*\S+|\s+")
UNEVEN = ["  ", *(c + " " for c in ASCII_BLANKS), *(" " + c for c in ASCII_BLANKS)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: base64 and number on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, file))}


def perfect_hash(keys: list[bytes]) -> tuple[list[int], list[int]]:
    """Displacement per bucket, and the key at each of ``len(keys)`` places.

    A displacement below 0 is itself the place (-1 - place) of a bucket's only key.
    """
    n, buckets = len(keys), max(1, len(keys) // 4)
    hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
    if len(np.unique(hashes)) < n:
        raise ValueError("two tokens have one hash")
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    size = np.diff(cuts)
    shift, at = [0] * buckets, [-1] * n
    free = np.ones(n, dtype=bool)
    block = 512
    for b in np.argsort(-size, kind="stable"):
        mine = order[cuts[b] : cuts[b + 1]]
        if len(mine) < 2:
            break
        h, first = hashes[mine], 0
        while True:
            d = np.arange(first, first + block, dtype=np.uint64) * np.uint64(TURN)
            slots = (((h[None, :] ^ d[:, None]) * np.uint64(SPREAD)) >> np.uint64(33)) % np.uint64(n)
            ok = free[slots].all(axis=1)
            if ok.any():
                ordered = np.sort(slots, axis=1)
                ok &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if ok.any():
                k = int(np.argmax(ok))
                shift[b] = first + k
                for key, slot in zip(mine.tolist(), slots[k].tolist(), strict=True):
                    at[slot] = key
                    free[slot] = False
                break
            first += block
    left = np.flatnonzero(free).tolist()
    for b in np.flatnonzero(size == 1).tolist():
        slot = left.pop()
        at[slot] = int(order[cuts[b]])
        shift[b] = -1 - slot
    return shift, at


def vocabulary(ranks: dict[bytes, int], pattern: str) -> dict:
    """What workers need of a rank file; plain values, to be broadcast (a few MB)."""
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no token for the bytes {missing[:5]}")
    tokens = sorted(ranks, key=ranks.__getitem__)
    shift, at = perfect_hash(tokens)
    pairs, base = {}, max(ranks.values()) + 1  # keys that spread over a dict
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                pairs[left * base + right] = rank
    table = [b""] * base
    for token, rank in ranks.items():
        table[rank] = token
    return {
        "pattern": pattern,
        "shift": shift,
        "keys": [tokens[k] for k in at],
        "ranks": [ranks[tokens[k]] for k in at],
        "digests": np.array([xxhash.xxh3_64_intdigest(tokens[k]) for k in at], dtype=np.uint64),
        "pairs": pairs,
        "base": base,
        "table": pair_table(pairs),
        "bytes": [ranks[bytes([b])] for b in range(256)],
        "flat": np.frombuffer(b"".join(table), dtype=np.uint8),
        "starts": np.concatenate([[0], np.cumsum([len(t) for t in table])]).astype(np.int64),
        "memo": {},  # each worker's own, empty when sent
    }


def merged(piece: bytes, v: dict) -> list[int]:
    """Ids of one pre-token that is no token: heap of pair ranks over linked bytes."""
    single, pairs, base = v["bytes"], v["pairs"].get, v["base"]
    ids = [single[b] for b in piece]
    n = len(ids)
    found = [pairs(a * base + b) for a, b in zip(ids, ids[1:], strict=False)]  # with the next
    found.append(None)
    heap = [(rank << 32) + i for i, rank in enumerate(found) if rank is not None]
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        top = heapq.heappop(heap)
        i, rank = top & 0xFFFFFFFF, top >> 32
        if found[i] != rank:
            continue  # one of the two has been merged since
        j = after[i]
        ids[i], ids[j], found[i], found[j] = rank, -1, None, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            new = found[i] = pairs(rank * base + ids[k])
            if new is not None:
                heapq.heappush(heap, (new << 32) + i)
        k = before[i]
        if k >= 0:
            new = found[k] = pairs(ids[k] * base + rank)
            if new is not None:
                heapq.heappush(heap, (new << 32) + k)
    return [x for x in ids if x >= 0]


def pair_table(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (-1: none) and ranks of the pairs, each at the first free place from its hash on."""
    size = 1 << max(4, (4 * len(pairs)).bit_length())
    keys, ranks = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
    left = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
    value = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
    place = _place(left, size)
    while len(left):
        free = np.flatnonzero(keys[place] < 0)
        spot, first = np.unique(place[free], return_index=True)
        keys[spot], ranks[spot] = left[free[first]], value[free[first]]
        rest = np.ones(len(left), dtype=bool)
        rest[free[first]] = False
        left, value, place = left[rest], value[rest], (place[rest] + 1) & (size - 1)
    return keys, ranks


def _place(keys: np.ndarray, size: int) -> np.ndarray:
    spread = keys.astype(np.uint64) * np.uint64(TURN)
    return (spread >> np.uint64(65 - size.bit_length())).astype(np.int64)


def pair_ranks(a: np.ndarray, b: np.ndarray, v: dict) -> np.ndarray:
    """Rank of each pair of ids; NO_PAIR where they do not merge or an id is -1."""
    keys, ranks = v["table"]
    wanted = np.where((a >= 0) & (b >= 0), a * v["base"] + b, 0)
    place = _place(wanted, len(keys))
    met = keys[place]
    out = np.where(met == wanted, ranks[place], NO_PAIR)
    todo = np.flatnonzero((met != wanted) & (met >= 0))
    while len(todo):
        place[todo] = (place[todo] + 1) & (len(keys) - 1)
        met = keys[place[todo]]
        hit = met == wanted[todo]
        out[todo[hit]] = ranks[place[todo[hit]]]
        todo = todo[~hit & (met >= 0)]
    out[(a < 0) | (b < 0)] = NO_PAIR
    return out


def merged_side_by_side(pieces: list[bytes], v: dict) -> list[bytes]:
    """Ids (32-bit) of pre-tokens of 1 to SHORT bytes that are no tokens: of each the leftmost
    pair of the lowest rank is merged, over and over."""
    width, n = max(map(len, pieces)), len(pieces)
    flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
    kind = np.int32 if v["base"] < 1 << 24 else np.int64  # rank and place in one number
    none = np.iinfo(kind).max
    ids = np.full((width + 1, n), -1, dtype=kind)  # a column is a piece, -1 after its last id
    ids[:-1] = np.array(v["bytes"], dtype=kind)[flat.T]
    at = np.arange(width + 1, dtype=kind)[:, None]
    ids[at >= np.array([len(p) for p in pieces], dtype=kind)] = -1
    order = np.full(ids.shape, none, dtype=kind)  # of the pair that starts here: rank, then place

    def ordered(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        rank = pair_ranks(a.astype(np.int64), b.astype(np.int64), v)
        return np.where(rank < NO_PAIR, rank << 6 | place, none)

    order[:-1] = ordered(ids[:-1].ravel(), ids[1:].ravel(), np.repeat(np.arange(width), n)).reshape(width, n)
    out: list[bytes] = [b""] * n
    who = np.arange(n)
    while len(who):
        lowest = order.min(axis=0)
        done = lowest == none
        ready = int(done.sum())
        if 4 * ready > len(who):  # they leave, with the rows that no other needs
            rows = np.ascontiguousarray(ids[:, done].T).astype("<i4")
            for k, row, size in zip(who[done].tolist(), rows, (rows >= 0).sum(axis=1).tolist(), strict=True):
                out[k] = row[:size].tobytes()
            go = np.flatnonzero(~done)
            who, lowest, done = who[go], lowest[go], done[go]
            width = int((ids[:, go] >= 0).any(axis=1).sum())
            ids, order, at = ids[: width + 1, go], order[: width + 1, go], at[: width + 1]
            ready = 0
            if not len(who):
                break
        spot = lowest & 63  # behind all places where nothing is left to merge
        later = at[:-1] > spot
        ids[:-1] = np.where(later, ids[1:], ids[:-1])
        order[:-1] = np.where(later, order[1:] - (order[1:] < none), order[:-1])
        line = np.flatnonzero(~done) if ready else np.arange(len(who))
        spot, merged_ids = spot[line], lowest[line] >> 6
        ids[spot, line] = merged_ids
        order[spot, line] = ordered(merged_ids, ids[spot + 1, line], spot)
        inner = np.flatnonzero(spot)
        line, before = line[inner], spot[inner] - 1
        order[before, line] = ordered(ids[before, line], merged_ids[inner], before)
    return out


def texts_encoder(v: dict):
    """The function from texts to their ids as little-endian 32-bit numbers."""
    keys, ranks, memo = v["keys"], v["ranks"], v["memo"]
    shifts, places = np.array(v["shift"], dtype=np.int64), v["digests"]
    buckets, n = len(shifts), len(keys)
    split = regex.compile(v["pattern"]).findall
    digest = xxhash.xxh3_64_intdigest
    known = memo.setdefault("units", {})  # units met before; when it is full the older half goes
    memo.setdefault("older", {})

    def whole(raws: list[bytes]) -> list[int | None]:
        """Rank of each that is a token itself."""
        h = np.array([digest(raw) for raw in raws], dtype=np.uint64)
        d = shifts[h % np.uint64(buckets)]
        slots = (((h ^ d.astype(np.uint64) * np.uint64(TURN)) * np.uint64(SPREAD)) >> np.uint64(33)) % np.uint64(n)
        slots = np.where(d < 0, -1 - d, slots.astype(np.int64))
        out: list[int | None] = [None] * len(raws)
        for k in np.flatnonzero(places[slots] == h).tolist():
            slot = int(slots[k])
            if keys[slot] == raws[k]:
                out[k] = ranks[slot]
        return out

    def piece_ids(pieces: list[str]) -> dict[str, bytes]:
        raws = [piece.encode() for piece in pieces]
        ids: list[bytes | None] = [None if r is None else r.to_bytes(4, "little") for r in whole(raws)]
        size = np.array([0 if i else len(raw) for raw, i in zip(raws, ids, strict=True)], dtype=np.int64)
        for k in np.flatnonzero(size > SHORT).tolist():
            ids[k] = np.array(merged(raws[k], v), dtype="<i4").tobytes()
        short = np.argsort(size, kind="stable")
        first, last = np.searchsorted(size[short], [1, SHORT + 1])
        short = short[first:last]
        for at in range(0, len(short), SIDE_BY_SIDE):
            part = short[at : at + SIDE_BY_SIDE].tolist()
            for k, found in zip(part, merged_side_by_side([raws[k] for k in part], v), strict=True):
                ids[k] = found
        return dict(zip(pieces, ids, strict=True))

    def cut(text: str) -> list[str]:
        even = not (text[0] == " " or text[-1] == " " or any(x in text for x in UNEVEN))
        if even and "\0" not in text and (text.isascii() or not OTHER_BLANKS.search(text)):
            return text.replace(" ", "\0 ").split("\0")
        return UNITS.findall(text)

    def pieces(unit: str) -> str | list[str]:
        """The pre-tokens, or the only one."""
        bare = unit[1:] if unit[0] == " " else unit
        if bare.isalpha():  # one run of letters: what the pattern would find
            return unit
        if bare[-1:] in (".", ",") and bare[:-1].isalpha():
            return [unit[:-1], unit[-1]]
        return split(unit)

    def learn(units: set[str]) -> None:
        """Makes all these units known."""
        if len(known) >= REMEMBERED:
            memo["older"] = dict(known)
            known.clear()
        older, new = memo["older"], {}
        for unit in units.difference(known):
            if (ids := older.get(unit)) is None:
                new[unit] = pieces(unit)
            else:
                known[unit] = ids
        wanted = set()
        for parts in new.values():
            if type(parts) is str:
                wanted.add(parts)
            else:
                wanted.update(parts)
        found = {p: known[p] for p in wanted if p in known}
        found |= piece_ids([p for p in wanted if p not in found])
        for unit, parts in new.items():
            known[unit] = found[parts] if type(parts) is str else b"".join([found[p] for p in parts])

    def joined(rows: list[list[str]]) -> list[bytes]:
        units = set().union(*rows)
        learn(units)
        out = [b"".join(map(known.__getitem__, row)) for row in rows]
        for unit in units:
            if len(unit) > LONGEST_REMEMBERED:
                del known[unit]
        return out

    def encode(texts: list[str | None]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # nothing here has cycles, and there are many small objects to look through
        try:
            return run(texts)
        finally:
            if collects:
                gc.enable()

    def run(texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        rows: list[list[str]] = []
        waiting = 0
        for text in texts:
            row = cut(text) if text else []
            if len(row) > UNITS_AT_ONCE:
                out += joined(rows)
                parts = (row[at : at + UNITS_AT_ONCE] for at in range(0, len(row), UNITS_AT_ONCE))
                out.append(b"".join(joined([part])[0] for part in parts))
                rows, waiting = [], 0
                continue
            rows.append(row)
            waiting += len(row)
            if waiting > UNITS_AT_ONCE:
                out += joined(rows)
                rows, waiting = [], 0
        return out + joined(rows)

    return encode


def encoder(v: dict):
    """The function from a text to its ids as little-endian 32-bit numbers."""
    encode = texts_encoder(v)
    return lambda text: encode([text])[0]


def decode(ids: np.ndarray, v: dict) -> bytes:
    """The bytes that the ids stand for."""
    starts = v["starts"]
    if len(ids) and (ids.min() < 0 or ids.max() >= len(starts) - 1):
        raise ValueError("an id is outside the vocabulary")
    sizes = starts[ids + 1] - starts[ids]
    if not len(ids):
        return b""
    ends = np.cumsum(sizes)
    return v["flat"][np.repeat(starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


def sent(df: DataFrame, v: dict):
    """The vocabulary as a broadcast, without what the driver itself remembers."""
    return df.sparkSession.sparkContext.broadcast(v | {"memo": {}})


def encoded(
    docs: DataFrame,
    vocabulary: dict,
    text: str = "text",
    ids: str = "ids",
    decoded: str = "decoded",
) -> DataFrame:
    """Adds the ids of each text, and the bytes that decoding these ids gives back.

    The text column is dropped; ``decoded`` holds what it held.
    """
    fields = [
        T.StructField(ids, T.ArrayType(T.IntegerType(), False)),
        T.StructField(decoded, T.BinaryType()),
    ]
    shared = sent(docs, vocabulary)

    def make():
        v = shared.value
        encode = texts_encoder(v)
        kind = pa.list_(pa.field("element", pa.int32(), nullable=False))

        def compute(column: pa.Array) -> Iterator[list[pa.Array]]:
            _, offsets = buffers(column)
            for first, last in runs(offsets, 1 << 20):
                rows = encode(column.slice(first, last - first).to_pylist())
                cuts = pa.array(np.cumsum([0, *map(len, rows)]) // 4, pa.int32())
                flat = pa.array(np.frombuffer(b"".join(rows), dtype="<i4"))
                back = [decode(np.frombuffer(r, dtype="<i4"), v) for r in rows]
                yield [pa.ListArray.from_arrays(cuts, flat, kind), pa.array(back, pa.binary())]

        return compute

    return with_computed(docs, text, fields, make, drop=(text,))

"""Shards of near equal size without splitting groups of equal texts.

Documents are ordered by the SHA-256 of their text, so that equal texts are one atomic group,
and the order is cut into contiguous shards. The largest shard is as small as it can be: the
smallest capacity for which a greedy walk needs no more shards than there are, found by binary
search over the group sizes in order. Within that capacity the cuts lie at the fair share of
what remains, groups larger than a fair share aside: beside such a group the other shards are
of near equal size too, and no shard is empty while there are as many groups.

The walk needs the sizes' running sums, not every group. Sums over ranges of the order come
first, at most RANGES of them; a capacity range that these cannot decide names the ranges
that a cut may lie in, and only these are summed at a finer level. That repeats until the
ranges are single groups. So the driver holds a bounded number of sums whatever the number of
groups, and the result is exact. The shard of a document follows from its digest by comparing
it with the cuts: no join, and no row moves for it.

Slots number the rows of a shard from 0. Rows of a shard are dealt to buckets by where they
are stored, so that a group of copies, however large, is numbered in parts.

A null text has no bytes, no checksum, and is a group of its own before all others. Repeated
rows get a slot each; an empty table gives an empty result; only the id and text columns are
read, so others cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window, functions as F

from tertulia.llm.store import written

RANGES = 1 << 14
PER_ROW = 8
BUCKET_ROWS, MOST_BUCKETS = 250_000, 4096
DIGITS = 64
END = "g"  # after every digest
NEAR = 0.01  # of a fair share: a range not wider than this is not refined for a fair cut


def _level(narrow: DataFrame, within: list[str], length: int) -> list[tuple[str, int, bool]]:
    """Prefix of ``length`` digits, bytes, and whether it is one group, in order.

    ``within`` has prefixes of one length; only rows that start with one of them count.
    """
    prefix = F.substring("digest", 1, length)
    if within and within != [""]:
        wanted = narrow.sparkSession.createDataFrame([(p,) for p in within], "_within string")
        narrow = narrow.join(
            F.broadcast(wanted), F.substring("digest", 1, len(within[0])) == F.col("_within"), "left_semi"
        )
    rows = narrow.groupBy(prefix.alias("p")).agg(
        F.sum("size").alias("size"), (F.min("digest") == F.max("digest")).alias("single")
    )
    return sorted((r["p"], r["size"], r["single"]) for r in rows.collect())


def greedy(ends: list[int], capacity: int, shards: int, start: int = 0) -> list[int] | None:
    """Positions after which a greedy walk cuts, or None if it needs more shards."""
    cuts, done = [], start
    for _ in range(shards):
        at = bisect_right(ends, done + capacity)
        cuts.append(at)
        if at == len(ends):
            return cuts
        if at and ends[at - 1] <= done or at == 0:
            return None  # the next group alone is over the capacity
        done = ends[at - 1]
    return None


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search over capacities, each checked by the greedy walk."""
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append(total)
    low, high = max([-(-total // shards), *sizes, 0]), total
    while low < high:
        middle = (low + high) // 2
        if greedy(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def oversized(sizes: list[int], shards: int) -> set[int]:
    """Positions of the groups larger than the share of a shard once those are set aside."""
    found, left = set(), sum(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if len(found) + 1 >= shards or sizes[i] * (shards - len(found)) <= left:
            break
        found.add(i)
        left -= sizes[i]
    return found


def fair(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """Positions after which to cut for sizes near equal, no shard over ``capacity``.

    ``capacity`` must be one that suffices. No shard is empty if there are as many sizes.
    """
    n, ends = len(sizes), [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    # first[k]: the earliest position from which k shards hold the rest
    first = [n]
    for _ in range(shards):
        first.append(bisect_left(ends, ends[first[-1]] - capacity))
    large = sorted(oversized(sizes, shards))
    loose = ends[-1] - sum(sizes[i] for i in large)  # bytes of other groups that remain
    cuts, at, passed = [], 0, 0
    for left in range(shards, 1, -1):
        stop = large[passed] if passed < len(large) else n
        run = ends[stop] - ends[at]  # up to the next oversized group
        share = loose / max(1, left - (len(large) - passed))
        if 2 * run < share and stop < n:
            want = ends[stop + 1]
        else:
            want = ends[at] + run / max(1, round(run / share)) if run else ends[at]
        cut = bisect_left(ends, want)
        if cut > 0 and (cut > n or want - ends[cut - 1] < ends[cut] - want):
            cut -= 1
        low = max(first[left - 1], min(at + 1, n))
        high = min(bisect_right(ends, ends[at] + capacity) - 1, n - left + 1)
        cut = max(low, min(cut, high))
        while passed < len(large) and large[passed] < cut:
            passed += 1
        loose -= ends[cut] - ends[at] - sum(sizes[i] for i in large if at <= i < cut)
        cuts.append(cut)
        at = cut
    return [*cuts, n]


def _uneven(parts: list[tuple[str, int, bool]], at: list[int], shards: int) -> list[str]:
    """Ranges of several groups beside a cut that are too wide for sizes near equal."""
    if len(parts) < shards:
        return [p for p, _, single in parts if not single]
    sizes = [s for _, s, _ in parts]
    large = oversized(sizes, shards)
    share = (sum(sizes) - sum(sizes[i] for i in large)) / (shards - len(large))
    beside = {i for cut in at for i in (cut - 1, cut) if 0 <= i < len(parts)} | large
    return [parts[i][0] for i in sorted(beside) if not parts[i][2] and parts[i][1] > NEAR * share]


def _bounds(parts: list[tuple[str, int, bool]], shards: int) -> tuple[int, int]:
    """Capacities between which the smallest one lies, knowing only sums over ranges.

    As if the ranges were groups it can only be too large. Every cut moved to the end of
    its range makes no shard larger by more than the largest range that can be split.
    """
    most = smallest_capacity([s for _, s, _ in parts], shards)
    loose = max([s for _, s, single in parts if not single], default=0)
    floor = max([-(-sum(s for _, s, _ in parts) // shards), *(s for _, s, single in parts if single), 0])
    return max(floor, most - loose), most


def _reach(parts: list[tuple[str, int, bool]], low: int, high: int, shards: int) -> list[str]:
    """Ranges of several groups in which a cut of a walk with low <= capacity <= high may lie."""
    ends, total = [], 0
    for _, s, _ in parts:
        total += s
        ends.append(total)
    found, early, late = set(), 0, 0
    for _ in range(shards):
        # the earliest and the latest end of this shard, as running sums
        first = min(bisect_right(ends, early + low), len(ends))
        last = min(bisect_right(ends, late + high), len(ends) - 1)
        found.update(range(first, last + 1))
        early = ends[first - 1] if first else 0
        late = min(late + high, total)
        if early >= total:
            break
    return [parts[i][0] for i in sorted(found) if i < len(parts) and not parts[i][2]]


def cuts(narrow: DataFrame, shards: int) -> list[str]:
    """The first digest of every shard but the first; END if there are fewer groups than shards.

    ``narrow`` has the columns digest (64 hex digits, or empty) and size.
    """
    length = 3
    parts = _level(narrow, [""], length)
    while True:
        low, high = _bounds(parts, shards)
        split = _reach(parts, low, high, shards) if parts else []
        if not split:
            sizes = [s for _, s, _ in parts]
            at = fair(sizes, smallest_capacity(sizes, shards), shards)
            split = _uneven(parts, at, shards)
        if not split:
            break
        # ranges have several lengths by now; those to split are refined by equal length
        length = len(split[0]) if len({len(p) for p in split}) == 1 else min(map(len, split))
        now = [p for p in split if len(p) == length]
        more = max(1, (RANGES // len(now)).bit_length() // 4)
        finer = _level(narrow, now, min(DIGITS, length + more))
        gone = set(now)
        parts = sorted([x for x in parts if x[0] not in gone] + finer)
    firsts = [parts[i][0] if i < len(parts) else END for i in at]
    return (firsts + [END] * shards)[: shards - 1]


def shard_of(digest: Column, firsts: list[str]) -> Column:
    """Number of cuts at or before the digest."""
    return F.size(F.filter(F.array(*(F.lit(c) for c in firsts)), lambda c: c <= digest)) if firsts else F.lit(0)


def sharded(
    docs: DataFrame, shards: int, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, digest, shard and slot of every row."""
    raw = F.col(text).cast("binary")
    narrow = written(
        docs.select(
            F.col(id_column),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + PER_ROW).alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.coalesce(F.sha2(raw, 256), F.lit("")).alias("digest"),
        ),
        "digests",
    )
    rows = narrow.count()
    firsts = cuts(narrow, shards)
    buckets = min(MOST_BUCKETS, max(16, -(-rows // (shards * BUCKET_ROWS))))
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    dealt = narrow.select(
        "*",
        shard_of(F.col("digest"), firsts).cast("int").alias("shard"),
        F.pmod(F.xxhash64(place), F.lit(buckets)).cast("int").alias("_bucket"),
        F.xxhash64(place).alias("_at"),
        F.col("_metadata.row_index").alias("_row"),
    )
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )  # at most shards * MOST_BUCKETS rows
    inside = Window.partitionBy("shard", "_bucket").orderBy("_at", "_row")
    numbered = dealt.withColumn("_k", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), ["shard", "_bucket"]).select(
        id_column,
        "size",
        "text_crc32",
        "digest",
        "shard",
        (F.col("_offset") + F.col("_k")).cast("long").alias("slot"),
    )

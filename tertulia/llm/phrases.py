"""Collocations: frequent phrases of two to five words, scored by their weakest cut.

Every word begins a suffix, the words from it to the end of its piece, at most LONGEST. The
suffixes are routed to tasks by their leading words and sorted there through pointers by
multikey three-way quicksort, one word a level, to depth LONGEST: the suffixes that are equal
to the pivots of k levels are the occurrences of a phrase of k words, so sizes of partitions
are counts. Partitions below ``least`` occurrences are abandoned.

What is routed is reduced first. A scan counts words and pairs of words by hash; those that
are frequent go into a Bloom filter of bounded size, and a suffix ends before the first word
or pair that is not in it (a false positive only costs a longer suffix). Equal suffixes are
one row with a count. Suffixes whose leading word holds too large a share of the rows are
routed by two words, and if need be by three, four or five: then no two rows are equal. The
counts of the shorter phrases of such a word are sums over its tasks.

Everything is by language; a null language counts as ``und``, a null text as empty. Rows of
equal texts count each, ties go as the order of the result says, an empty table and texts
without words give no row. Very long texts are worked through in parts that share the words
at their border. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tertulia.llm.store import written
from tertulia.llm.words import Words, buffers, mixed, runs

LONGEST, LEAST, TOP = 5, 100, 2000
UNKNOWN = "und"
SPLITS = np.zeros(256, dtype=bool)
SPLITS[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
BLANKS = SPLITS.copy()
BLANKS[[32, 9]] = True

STRETCH = 1 << 20  # bytes worked on at once
COUNTED = 1 << 20  # keys counted at once
BLOOM_LEAST, BLOOM_MOST = 16, 28  # log2 of the filter's bits
ROWS_A_TASK = 400_000
_WORD, _PAIR = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xD6D0B4F6C3A1E58B)


def stretches(data: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Parts of one text and how many of their first bytes hold the words that are theirs.

    A part is cut between words and goes on for LONGEST more, so that each suffix is whole.
    """
    at = 0
    while at < len(data):
        end = _after_words(data, at + STRETCH, 0)
        yield data[at : _after_words(data, end, LONGEST)], end - at
        at = end


def _after_words(data: np.ndarray, at: int, words: int) -> int:
    """The end of the word at ``at`` or of the one ``words`` further."""
    left, step = words, 1 << 12
    while at < len(data):
        blank = BLANKS[data[at : at + step + 1]]
        ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        if words == 0:
            if blank[0]:
                return at
            left = 1
        if len(ends) >= left:
            return at + int(ends[left - 1])
        left, at = left - len(ends), at + step
        words = max(words, 1)
    return len(data)


class Texts:
    """Words of stretches of rows: hashes, pieces, languages, and their bytes."""

    def __init__(self):
        self.split = Words(BLANKS)

    def of(self, span: np.ndarray, local: np.ndarray, codes: np.ndarray, owned: int):
        """Of each word: hash, code of its row's language, how many words of its piece follow
        (at most LONGEST - 1), and whether it lies within the first ``owned`` bytes."""
        self.starts, self.ends, hashes, self.low = self.split.of(span, local[:-1][local[:-1] < len(span)])
        row = np.searchsorted(local, self.starts, side="right") - 1
        piece = np.cumsum(SPLITS[self.low])[self.starts] if len(span) else row
        joined = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])  # with the next word
        return hashes, codes[row], joined, self.starts < owned

    def phrases(self, first: np.ndarray, size: np.ndarray) -> pa.Array:
        """The words ``first`` to ``first + size - 1``, lower-cased, with one space between."""
        ends = np.cumsum(size)
        word = np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        length = self.ends[word] - self.starts[word] + 1
        stops = np.cumsum(length)
        index = np.repeat(self.starts[word] - stops + length, length)
        index += np.arange(len(index))
        out = self.low[np.minimum(index, len(self.low) - 1)]
        out[stops - 1] = 32
        cuts = np.concatenate([[0], stops[ends - 1]]).astype(np.int64)
        # without the space after the last word
        keep = np.ones(len(out), dtype=bool)
        keep[cuts[1:] - 1] = False
        cuts -= np.arange(len(cuts))
        flat = out[keep]
        return pa.LargeStringArray.from_buffers(
            len(first), pa.py_buffer(cuts.tobytes()), pa.py_buffer(flat.tobytes())
        ).cast(pa.string())


def _stretched(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bytes, row borders, language codes and owned bytes; languages are column 0, texts 1."""
    data, offsets = buffers(batch.column(1))
    codes = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    for first, last in runs(offsets, STRETCH):
        span = data[offsets[first] : offsets[last]]
        if last == first + 1 and len(span) > STRETCH:
            for part, owned in stretches(span):
                yield part, np.array([0, len(part)]), codes[first:last], owned
        elif len(span):
            yield span, offsets[first : last + 1] - offsets[first], codes[first:last], len(span)


def _language_keys(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """Distinct languages of a batch and a hash of each."""
    names = batch.column(0).dictionary_encode().dictionary
    split = Words(np.zeros(256, dtype=bool))
    keys = [split.of(np.frombuffer(x.encode(), np.uint8))[2] if x else [0] for x in names.to_pylist()]
    return names, np.array([k[0] for k in keys], dtype=np.uint64)


def _keys(hashes: np.ndarray, of: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of words and, where ``joined``, of pairs with the next word."""
    with np.errstate(over="ignore"):
        words = mixed(hashes * _WORD + of)
        pairs = mixed(mixed(hashes[:-1] * _PAIR + of[:-1]) + hashes[1:] * _WORD)
    return words, pairs[joined]


def key_counts(docs: DataFrame) -> DataFrame:
    """key, n: occurrences of words and pairs of words by hash (of language and words)."""

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    def work(batches):
        texts, parts, size = Texts(), [], 0
        for batch in batches:
            _, hashed = _language_keys(batch)
            for span, local, codes, owned in _stretched(batch):
                hashes, code, joined, mine = texts.of(span, local, codes, owned)
                words, pairs = _keys(hashes, hashed[code], joined)
                parts += [words[mine], pairs[mine[:-1][joined]]]
                size += len(parts[-1]) + len(parts[-2])
                if size > COUNTED:
                    yield counted(parts)
                    parts, size = [], 0
        if parts:
            yield counted(parts)

    return docs.mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def filter_of(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``key``: two probes, 32 bits a key within the bounds.

    It is put together by Spark; the driver gets its 64-bit words, at most 2^BLOOM_MOST bits.
    """
    wanted = int(keys.count() * 32)
    power = min(BLOOM_MOST, max(BLOOM_LEAST, wanted.bit_length()))
    low = F.col("key").bitwiseAND(F.lit((1 << power) - 1))
    high = F.shiftrightunsigned("key", 64 - power)
    bits = keys.select(F.explode(F.array(low, high)).alias("bit"))
    cells = bits.groupBy(F.shiftright("bit", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word")
    )
    out = np.zeros(1 << (power - 6), dtype=np.int64)
    rows = cells.toArrow()
    out[rows["cell"].to_numpy()] = rows["word"].to_numpy()
    return out.view(np.uint64)


def known(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    power = np.uint64(len(bloom).bit_length() + 5)
    out = np.ones(len(keys), dtype=bool)
    for bit in (keys & ((np.uint64(1) << power) - np.uint64(1)), keys >> (np.uint64(64) - power)):
        out &= (bloom[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return out


def suffixes(docs: DataFrame, bloom: np.ndarray) -> DataFrame:
    """lang, phrase, n: distinct suffixes of frequent words, and under the empty phrase the
    number of all words of the language."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)  # bounded by BLOOM_MOST

    def work(batches):
        texts, filter_ = Texts(), shared.value
        for batch in batches:
            names, hashed = _language_keys(batch)
            for span, local, codes, owned in _stretched(batch):
                hashes, code, joined, mine = texts.of(span, local, codes, owned)
                words, pairs = _keys(hashes, hashed[code], joined)
                frequent = known(filter_, words)
                go = np.zeros(len(hashes), dtype=bool)  # on to the next word
                go[:-1][joined] = known(filter_, pairs)
                go[:-1] &= frequent[:-1] & frequent[1:]
                size, on = np.ones(len(hashes), dtype=np.int64), go.copy()
                key = words.copy()
                with np.errstate(over="ignore"):
                    for k in range(1, LONGEST):
                        size += on
                        at = np.flatnonzero(on)
                        key[at] = mixed(key[at] * _PAIR + words[at + k])
                        on &= np.concatenate([go[k:], np.zeros(min(k, len(go)), dtype=bool)])
                begin = np.flatnonzero(frequent & mine)
                _, first, n = np.unique(key[begin], return_index=True, return_counts=True)
                first = begin[first]
                of, totals = np.unique(code[mine], return_counts=True)
                found = texts.phrases(first, size[first])
                yield pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(np.concatenate([code[first], of]))),
                        pa.concat_arrays([found, pa.array([""] * len(of), pa.string())]),
                        pa.array(np.concatenate([n, totals])),
                    ],
                    names=["lang", "phrase", "n"],
                )

    rows = docs.mapInArrow(work, "lang string, phrase string, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def routed(rows: DataFrame, tasks: int, limit: int) -> DataFrame:
    """Adds ``route``, the leading words that deal out the row, and ``depth``, their number.

    Leading words with more than ``limit`` rows are routed by one word more. There are at most
    rows / limit of them at each depth, which bounds the sets that the expression holds. (Words
    hold no tab, so language and words together name them.)
    """
    deeper = F.lit(1)
    for depth in range(1, LONGEST):
        lead = F.concat_ws("\t", F.col("lang"), F.substring_index("phrase", " ", depth))
        hot = rows.groupBy(lead.alias("_lead")).count().where(F.col("count") > limit).collect()
        if not hot:
            break  # words that lead more rows than that also do so without the last of them
        deeper = deeper + lead.isin([r["_lead"] for r in hot]).cast("int")
    out = rows.withColumn("depth", deeper)
    route = F.expr("substring_index(phrase, ' ', depth)")
    return out.withColumn("route", route).repartition(tasks, "lang", "route")


def sorted_counts(
    words: np.ndarray, weight: np.ndarray, depth: np.ndarray, least: int
) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of row pointers: (a row, k, occurrences of its first k words).

    ``words`` has one column a level, -1 after the end of a row. At level k the pointers of a
    partition agree in k words; those that end there leave it. A partition below ``least`` is
    abandoned unless it holds rows routed by more words than it agrees in, which other tasks
    hold more of.
    """
    stack = [(np.arange(len(words)), 0)] if len(words) else []
    levels = words.shape[1]
    while stack:
        at, level = stack.pop()
        if weight[at].sum() < least and depth[at].max() <= level:
            continue
        key = words[at, level]
        pivot = key[len(key) // 2]
        same = key == pivot
        less = key < pivot
        for part in (at[less], at[~(same | less)]):
            if len(part):
                stack.append((part, level))
        if pivot < 0:
            continue
        equal = at[same]
        count = int(weight[equal].sum())
        if count >= least or depth[equal[0]] > level:
            yield int(equal[0]), level + 1, count
            if level + 1 < levels:
                stack.append((equal, level + 1))


def phrase_counts(rows: DataFrame, least: int) -> DataFrame:
    """lang, phrase, size, n of all phrases of up to LONGEST words that occur ``least`` times."""

    def work(batches):
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        phrase = table["phrase"].combine_chunks()
        listed = pc.split_pattern(phrase, " ")
        cuts = listed.offsets.to_numpy()
        cuts, sizes = cuts - cuts[0], np.diff(cuts)
        codes = listed.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        words = np.full((len(phrase), LONGEST), -1, dtype=np.int32)
        row = np.repeat(np.arange(len(phrase)), sizes)
        words[row, np.arange(len(row)) - cuts[row]] = codes
        lang = table["lang"].combine_chunks()
        of = lang.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        weight, depth = table["n"].to_numpy(), table["depth"].to_numpy()
        found = []
        for code in np.unique(of):
            mine = np.flatnonzero(of == code)
            found += [(mine[i], k, n) for i, k, n in sorted_counts(words[mine], weight[mine], depth[mine], least)]
        if found:
            at, k, n = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
            texts = [" ".join(p.split(" ")[:m]) for p, m in zip(phrase.take(at).to_pylist(), k.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [lang.take(pa.array(at)), pa.array(texts, pa.string()), pa.array(k), pa.array(n)],
                names=["lang", "phrase", "size", "n"],
            )

    found = rows.select("lang", "phrase", "n", "depth").mapInArrow(
        work, "lang string, phrase string, size long, n long"
    )
    # words routed by more than themselves were counted in several tasks
    return found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def cut_scores(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, n, score of phrases of two words or more, by the weakest cut."""
    phrases = counts.where("size > 1")
    cuts = phrases.select(
        "lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.expr("sequence(1L, size - 1)")).alias("k")
    ).select(
        "*",
        F.expr("substring_index(phrase, ' ', cast(k as int))").alias("_left"),
        F.expr("substring_index(phrase, ' ', cast(k - size as int))").alias("_right"),
    )
    left = counts.select("lang", F.col("phrase").alias("_left"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("_right"), F.col("n").alias("r"))
    whole = "cast({} as decimal(20, 0))"
    score = F.expr(
        "cast((cast(1000 as decimal(4, 0)) * cast(a as decimal(16, 0)) * cast(n as decimal(18, 0)))"
        f" div ({whole.format('l')} * {whole.format('r')}) as long)"
    )
    return (
        cuts.join(left, ["lang", "_left"])
        .join(right, ["lang", "_right"])
        .join(totals.select("lang", "n"), "lang")
        .select("*", score.alias("score"))
        .groupBy("lang", "phrase", "size", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
        .select("lang", "phrase", "size", "a", "_cut.l", "_cut.r", "n", "_cut.score")
    )


def without_parts(scored: DataFrame) -> DataFrame:
    """Drops phrases that occur only inside a longer one.

    A longer phrase that holds a phrase as often as it occurs holds one of just one word more
    that does, so looking at those is enough.
    """
    longer = scored.where("size > 2").select(
        "lang",
        F.explode(
            F.array(
                F.expr("substring_index(phrase, ' ', cast(size - 1 as int))"),
                F.expr("substring_index(phrase, ' ', cast(1 - size as int))"),
            )
        ).alias("phrase"),
        F.col("a").alias("_longer"),
    )
    most = longer.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    kept = scored.join(most, ["lang", "phrase"], "left")
    return kept.where(F.coalesce(F.col("_longer") < F.col("a"), F.lit(True))).drop("_longer")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col(f"`{lang}`"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    frequent = written(key_counts(texts).where(F.col("n") >= least).select("key"), "phrase-keys")
    rows = written(suffixes(texts, filter_of(frequent)), "phrase-suffixes")
    there = rows.where(F.col("phrase") != "")
    total = there.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ROWS_A_TASK))
    dealt = routed(there, tasks, max(1000, total // (8 * tasks)))
    counts = written(phrase_counts(dealt, least), "phrase-counts")
    scored = written(cut_scores(counts, rows.where(F.col("phrase") == "")), "phrase-scores")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = without_parts(scored).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )

"""Marginal likelihood of texts over all segmentations into pieces of a given vocabulary.

A text is its words (A-Z lower-cased) and an end. A word, with the space that opens it, is
generated piece by piece, each piece independently by its probability; the probability of a
word is the sum over all ways to cut it, by a forward recursion over its bytes in log space.
A word that training holds is a piece too: it has an arc over its whole length, with its
count less DISCOUNT as weight, and what is taken off goes to the pieces of the vocabulary.
No piece spans two words, so a text's probability is the product over its words and the end,
and each distinct word needs one recursion only, wherever it stands. All probabilities,
unseen words included, sum to one.

The vocabulary is given, never learned, and has a piece for every byte. Its order gives the
first scores (Zipf: 1 / (rank + 2.7)); EM_STEPS passes of expectation and maximisation over
all distinct training words then fit the scores to the corpus.

``scored`` counts words in one pass (distinct words per task, summed by a shuffle), scores
each distinct word, and sums the scores per text in a second pass. The most frequent words,
at most FREQUENT of them, go to the tasks as a table; the words of the rest of the positions
are looked up by a join.

A null text counts as empty: one token, the end. Repeated rows count and are scored each. An
empty table gives an empty result; without training texts every piece keeps its first score.
Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tertulia.llm.store import with_computed, written
from tertulia.llm.words import BLANK, LOWER, PIECE, Words, buffers, pieces, runs

FREQUENT = 1 << 18
EM_STEPS = 3
PSEUDO = 0.05
DISCOUNT = 0.6
MARK = " "
RUN = 4 << 20
CHUNK = 1 << 17


def read_pieces(path: str) -> list[bytes]:
    """Lower-case pieces of a sentencepiece model in its order, then the missing single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, None] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        raw = piece.replace("▁", MARK).encode()
        inner = np.frombuffer(raw[1:] if raw[:1] == b" " else raw, dtype=np.uint8)
        if piece and not BLANK[inner].any() and bytes(LOWER[np.frombuffer(raw, np.uint8)]) == raw:
            found[raw] = None
    found |= {bytes([b]): None for b in range(256)}
    return list(found)


class Lattice:
    """Finds the pieces at every position of many words at once, and runs the recursions."""

    def __init__(self, vocabulary: list[bytes]):
        nodes = {b"": 0}
        keys, targets = [], []
        ids = [-1]
        for number, piece in enumerate(vocabulary):
            for n in range(1, len(piece) + 1):
                if piece[:n] not in nodes:
                    nodes[piece[:n]] = len(ids)
                    keys.append(nodes[piece[: n - 1]] << 8 | piece[n - 1])
                    targets.append(len(ids))
                    ids.append(-1)
            ids[nodes[piece]] = number
        order = np.argsort(keys)
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.targets = np.array(targets, dtype=np.int64)[order]
        self.ids = np.array(ids, dtype=np.int64)
        self.size = len(vocabulary)
        self.first = np.full(256, -1, dtype=np.int64)
        root = self.keys < 256
        self.first[self.keys[root]] = self.targets[root]

    def edges(self, data: np.ndarray, ends: np.ndarray):
        """(start, end, piece) for every piece that occurs; ``ends``: each byte's word's end."""
        at = np.arange(len(data))
        node = self.first[data]
        found = []
        n = 1
        while len(at):
            piece = self.ids[node]
            here = piece >= 0
            found.append((at[here], at[here] + n, piece[here]))
            more = at + n < ends[at]
            at, node = at[more], node[more]
            key = node << 8 | data[at + n]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[spot] == key
            at, node = at[good], self.targets[spot[good]]
            n += 1
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def run(self, data: np.ndarray, starts: np.ndarray, logp: np.ndarray, counts: np.ndarray | None = None):
        """Log probability of each word; with ``counts``, also the pieces' expected counts."""
        stops = np.append(starts[1:], len(data))
        sizes = stops - starts
        word = np.repeat(np.arange(len(starts)), sizes)
        begin, end, piece = self.edges(data, stops[word])
        owner = word[begin]
        # node t of a word is at starts + word number + t, as each word has one node more
        source, target = begin + owner, end + owner
        total = np.full(len(data) + len(starts), -np.inf)
        total[starts + np.arange(len(starts))] = 0.0
        _recursion(total, source, target, end - starts[owner], logp[piece])
        last = stops + np.arange(len(starts))
        whole = total[last]
        if counts is None:
            return whole, None
        back = np.full(len(total), -np.inf)
        back[last] = 0.0
        _recursion(back, target, source, stops[owner] - begin, logp[piece])
        share = np.exp(total[source] + logp[piece] + back[target] - whole[owner]) * counts[owner]
        return whole, np.bincount(piece, weights=share, minlength=self.size)


def _recursion(total, source, target, step, weight) -> None:
    """total[target] = log sum exp(total[source] + weight), in the order of ``step``."""
    order = np.lexsort((target, step))
    source, target, weight, step = source[order], target[order], weight[order], step[order]
    heads = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
    cuts = np.flatnonzero(np.append(True, step[1:] != step[:-1])) if len(step) else []
    cuts = np.append(cuts, len(step)).astype(np.int64)
    spans = np.searchsorted(heads, cuts)
    for k in range(len(cuts) - 1):
        a, b = cuts[k], cuts[k + 1]
        value = total[source[a:b]] + weight[a:b]
        head = heads[spans[k] : spans[k + 1]] - a
        most = np.maximum.reduceat(value, head)
        size = np.diff(np.append(head, b - a))
        summed = np.add.reduceat(np.exp(value - np.repeat(most, size)), head)
        total[target[a:b][head]] = most + np.log(summed)


def marked(words: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of a binary column with their words' bytes, each opened by a space."""
    column = words.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for a, b in runs(offsets, CHUNK):
        local = offsets[a : b + 1] - offsets[a] + np.arange(b - a + 1)
        out = np.full(local[-1], 32, dtype=np.uint8)
        inner = np.ones(local[-1], dtype=bool)
        inner[local[:-1]] = False
        out[inner] = data[offsets[a] : offsets[b]]
        yield a, b, out, local[:-1]


def _occurrences(split: Words, data: np.ndarray, offsets: np.ndarray, first: int, last: int):
    """Hashes, byte ranges in the lower-cased bytes, and number per row, of the words of rows."""
    hashes, starts, sizes, lows, counts = [], [], [], [], []
    base = 0
    for a, b in runs(offsets[first : last + 1]):
        span = data[offsets[first + a] : offsets[first + b]]
        one = b == a + 1 and len(span) > PIECE
        local = offsets[first + a : first + b + 1] - offsets[first + a]
        inside = 0
        for part in pieces(span) if one else [span]:
            if not len(part):
                counts.append(np.zeros(b - a, dtype=np.int64))
                continue
            cuts = None if one else local[:-1][local[:-1] < len(part)]
            s, e, h, low = split.of(part, cuts)
            hashes.append(h)
            starts.append(s + base)
            sizes.append(e - s)
            lows.append(low)
            base += len(low)
            if one:
                inside += len(h)
            else:
                counts.append(np.diff(np.searchsorted(s, local)))
        if one:
            counts.append(np.array([inside]))
    whole = [np.concatenate([*x, np.zeros(0, kind)]) for x, kind in (
        (hashes, np.uint64), (starts, np.int64), (sizes, np.int64), (lows, np.uint8), (counts, np.int64))]
    return [x.astype(k) for x, k in zip(whole, (np.uint64, np.int64, np.int64, np.uint8, np.int64), strict=True)]


def _binary(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The byte ranges as a binary column."""
    ends = np.cumsum(sizes)
    index = np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(low[index].tobytes())]
    )


def word_counts(docs: DataFrame, training: str, text: str) -> DataFrame:
    """Distinct words: word, trained (occurrences in rows where ``training``), every (all)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words()
        for batch in batches:
            flags = np.array(batch.column(1).to_pylist(), dtype=bool)
            data, offsets = buffers(batch.column(0))
            for a, b in runs(offsets, RUN):
                hashes, starts, sizes, low, counts = _occurrences(split, data, offsets, a, b)
                _, one, which, n = np.unique(
                    hashes, return_index=True, return_inverse=True, return_counts=True
                )
                weight = np.repeat(flags[a:b], counts)
                trained = np.bincount(which, weights=weight, minlength=len(one)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [_binary(low, starts[one], sizes[one]), pa.array(trained), pa.array(n.astype(np.int64))],
                    names=["word", "trained", "every"],
                )

    found = docs.select(text, training).mapInArrow(work, "word binary, trained long, every long")
    return found.groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("every").alias("every"))


def fitted(words: DataFrame, vocabulary: list[bytes], steps: int = EM_STEPS) -> np.ndarray:
    """Log probabilities of the pieces, fitted to the distinct words of the training texts."""
    size = len(vocabulary)
    p = 1.0 / (np.arange(size) + 2.7)
    logp = np.log(p / p.sum())
    known = words.where("trained > 0").select("word")
    for _ in range(steps):

        def expect(batches: Iterable[pa.RecordBatch], logp=logp) -> Iterator[pa.RecordBatch]:
            lattice = None
            total = np.zeros(size)
            for batch in batches:
                lattice = lattice or Lattice(vocabulary)
                for a, b, data, starts in marked(batch.column(0)):
                    total += lattice.run(data, starts, logp, np.ones(b - a))[1]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "n"])

        rows = known.mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        rows = rows.collect()  # one row per piece of the vocabulary at most
        if not rows:
            break
        counts = np.full(size, PSEUDO)
        for piece, n in rows:
            counts[piece] += n
        logp = np.log(counts / counts.sum())
    return logp


def _cut(words: DataFrame, most: int) -> int:
    """The least count for which at most ``most`` words are as frequent."""
    level = F.floor(F.log2("every") * 8).cast("int")
    rows = words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    left = most
    for level, n in sorted(((r["level"], r["n"]) for r in rows), reverse=True):
        if n > left:
            return int(np.ceil(2 ** ((level + 1) / 8)))
        left -= n
    return 1


def scored(
    docs: DataFrame,
    training: Column,
    vocabulary: list[bytes],
    id_column: str = "doc_id",
    text: str = "text",
    frequent: int = FREQUENT,
) -> DataFrame:
    """The id, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``training`` says which rows to learn from. ``base_score`` is that of single words with
    0.1 added to each count; both scores are log10 probabilities.
    """
    rows = docs.select(
        F.col(id_column).alias("_id"), F.col(text).alias("_text"), training.alias("_training")
    )
    words = written(word_counts(rows, "_training", "_text"), "words")
    texts = rows.where("_training").count()
    total = words.agg(F.sum("trained"), F.count(F.when(F.col("trained") > 0, 1))).first()
    tokens, kinds = (total[0] or 0) + texts, total[1] + (texts > 0)
    whole = np.log10(tokens + 0.1 * (kinds + 1))
    logp = fitted(words, vocabulary)
    mass = tokens + 1.5  # half a count more for the end, one for unseen words
    unseen = np.log((DISCOUNT * total[1] + 1) / mass)

    def likelihoods(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = None
        for batch in batches:
            lattice = lattice or Lattice(vocabulary)
            trained = batch.column(1).to_numpy()
            base = np.log10(trained + 0.1) - whole
            found = []
            for a, b, data, starts in marked(batch.column(0)):
                cut = lattice.run(data, starts, logp)[0] + unseen
                counts = np.maximum(trained[a:b] - DISCOUNT, 0)
                uncut = np.log(counts / mass, where=counts > 0, out=np.full(b - a, -np.inf))
                found.append(np.logaddexp(uncut, cut) / np.log(10))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(trained > 0), batch.column(2), pa.array(base), pa.array(np.concatenate(found))],
                names=["word", "known", "every", "base", "lattice"],
            )

    weighed = words.select("word", "trained", "every").mapInArrow(
        likelihoods, "word binary, known boolean, every long, base double, lattice double"
    )
    weighed = written(weighed, "weighed-words")
    top = weighed.where(F.col("every") >= _cut(weighed, frequent)).drop("every").toArrow()
    table = _table(top.combine_chunks())
    shared = docs.sparkSession.sparkContext.broadcast(table)
    ends = (float(np.log10(texts + 0.1) - whole), float(np.log10((texts + 0.5) / mass)), int(texts > 0))
    parts = written(
        _by_text(rows.drop("_training"), shared, ends).withColumn("_row", F.monotonically_increasing_id()),
        "text-parts",
    )
    rest = (
        parts.select("_row", F.explode("rare").alias("word"))
        .join(weighed, "word")
        .groupBy("_row")
        .agg(
            F.sum(F.col("known").cast("long")).alias("_known"),
            F.sum("base").alias("_base"),
            F.sum("lattice").alias("_lattice"),
        )
    )
    return parts.drop("rare").join(rest, "_row", "left").select(
        F.col("_id").alias(id_column),
        "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("lattice") + F.coalesce("_lattice", F.lit(0.0))).alias("score"),
    )


def _table(top: pa.Table) -> dict[str, np.ndarray]:
    """The frequent words by hash."""
    if not top.num_rows:
        return {k: np.zeros(0, d) for k, d in (("hash", np.uint64), ("known", bool), ("base", float), ("lattice", float))}
    split, hashes = Words(), []
    for _, _, data, starts in marked(top.column("word").combine_chunks()):
        hashes.append(split.of(data, starts)[2])
    hashes = np.concatenate(hashes)
    order = np.argsort(hashes)
    return {"hash": hashes[order]} | {
        k: top.column(k).to_numpy()[order] for k in ("known", "base", "lattice")
    }


def _by_text(rows: DataFrame, shared, ends: tuple[float, float, int]) -> DataFrame:
    """Sums over the frequent words of each text, and the list of its other words."""
    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("known", T.LongType()),
        T.StructField("base", T.DoubleType()),
        T.StructField("lattice", T.DoubleType()),
        T.StructField("rare", T.ArrayType(T.BinaryType(), False)),
    ]

    def make():
        split, t = Words(), shared.value
        kind = pa.list_(pa.field("element", pa.binary(), nullable=False))

        def compute(column: pa.Array):
            data, offsets = buffers(column)
            for a, b in runs(offsets, RUN):
                hashes, starts, sizes, low, counts = _occurrences(split, data, offsets, a, b)
                row = np.repeat(np.arange(b - a), counts)
                at = np.minimum(np.searchsorted(t["hash"], hashes), max(0, len(t["hash"]) - 1))
                hit = t["hash"][at] == hashes if len(t["hash"]) else np.zeros(len(hashes), bool)
                at, mine, rare = at[hit], row[hit], ~hit
                sums = [np.bincount(mine, weights=t[k][at], minlength=b - a) for k in ("known", "base", "lattice")]
                cuts = np.concatenate([[0], np.cumsum(np.bincount(row[rare], minlength=b - a))])
                lists = pa.ListArray.from_arrays(
                    pa.array(cuts.astype(np.int32)), _binary(low, starts[rare], sizes[rare]), kind
                )
                yield [
                    pa.array(counts + 1),
                    pa.array(sums[0].astype(np.int64) + ends[2]),
                    pa.array(sums[1] + ends[0]),
                    pa.array(sums[2] + ends[1]),
                    lists,
                ]

        return compute

    return with_computed(rows, "_text", fields, make, drop=("_text",))

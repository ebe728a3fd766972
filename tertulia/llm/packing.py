"""Documents packed into sequences of a fixed number of tokens, by sums of squares.

A document's ids, END after them, are cut into whole windows and a rest. Rests are placed one
after another, each into the open window of the fill level (or into a new one) that makes the
sum over all levels of (open windows at that level)^2 least; the counts are kept in an array
by level. Levels thus stay about equally used, and a later rest finds its counterpart.

Each task packs the rows it has, so nothing is shuffled; a sequence never spans tasks. What is
still open at the end of a task, or when more than OPEN windows are, is joined, fullest first,
and cut into whole windows; the last remainder is cut into sequences of a power of two, which
need no padding. So there is none, and documents are cut only there and at whole windows.
The numbers of sequences have the task's number in the upper half; they and the packing follow
from how the rows lie, but every id is in exactly one piece however they do.

A null text counts as empty and has the one id END. Repeated rows are packed each. An empty
table gives no piece. A very long text is encoded in parts that end at white space, which no
token spans. A null key is returned as null. Other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tertulia.llm.words import buffers, runs

LENGTH, END, OPEN = 4096, 2, 2048
REMEMBERED = 600_000  # words whose ids a worker keeps, twice
LONGEST_REMEMBERED = 64  # bytes of such a word
TOGETHER = 10_000  # words encoded at once
PART, ROWS_OUT = 1 << 20, 8192
MARKS, BLANK = b".,;:!?", re.compile(rb"[ \t\n\x0b\x0c\r]")


class WordIds:
    """Ids of texts by a tokenizer to which the case of words of ASCII does not matter, and whose
    tokens span no ASCII white space and no border between letters and MARKS after them.

    ``encode`` turns a list of texts into the bytes of their ids (little-endian, 32 bits each).
    A word between white space is encoded once while it is remembered; the older half of what is
    remembered goes when full.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], remembered: int = REMEMBERED):
        self.encode, self.remembered = encode, remembered
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def of(self, raws: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        parts = [list(_parts(raw)) for raw in raws]
        words = [[p.split() for p in of] for of in parts]
        self._learn({w for of in words for p in of for w in p})
        known = self.new.__getitem__
        out = [b"".join([b"".join(map(known, p)) for p in of]) for of in words]
        for w in self.long:
            del self.new[w]
        return out

    def _learn(self, wanted: set[bytes]) -> None:
        """Has ``new`` hold all words of ``wanted``."""
        missing = wanted.difference(self.new)
        if len(self.new) + len(missing) > self.remembered:
            self.old, self.new, missing = self.new, {}, wanted
        unknown = []
        for w in missing:
            ids = self.old.get(w)
            if ids is None:
                unknown.append(w)
            else:
                self.new[w] = ids
        halves, alone = {}, set()  # words made of others, and those that are not
        for w in unknown:
            plain = w.lower() if w.isascii() else w
            body = plain.rstrip(MARKS)
            if len(body) < len(w) and (body.isalpha() or normalize("NFC", body.decode().lower()).isalpha()):
                halves[w] = body, plain[len(body) :]
            elif plain != w:
                halves[w] = plain, b""
            else:
                alone.add(w)
                continue
            alone.update(x for x in halves[w] if x not in self.new)
        alone = list(alone)
        found = dict(zip(alone, self.encode([w.decode() for w in alone]), strict=True))
        self.new.update(found)
        for w, (body, marks) in halves.items():
            self.new[w] = self.new[body] + self.new[marks]
        self.long = [w for w in {*halves, *alone} if len(w) > LONGEST_REMEMBERED]


def _parts(raw: bytes) -> Iterator[bytes]:
    """A text in parts of about PART bytes, cut before white space."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PART)
        if end < len(raw):
            blank = BLANK.search(raw, end)
            end = blank.start() if blank else len(raw)
        yield raw[at:end]
        at = end


def file_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """The encoder of a tokenizer file whose words end with a token in ``</w>``.

    Strings of special tokens are ordinary text. Texts of letters alone are words, and encoded
    together; the ends show which ids are whose.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    ends = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def separately(texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def together(words: list[str]) -> list[bytes]:
        ids = np.array(tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        cuts = np.flatnonzero(ends[ids]) + 1
        if len(cuts) != len(words):  # a letter whose lower case is more than letters
            return separately(words)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]

    def encode(texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        rest = [i for i, t in enumerate(texts) if not t.isalpha()]
        for of, how in ((plain, together), (rest, separately)):
            for first in range(0, len(of), TOGETHER):
                some = of[first : first + TOGETHER]
                for i, ids in zip(some, how([texts[i] for i in some]), strict=True):
                    out[i] = ids
        return out

    return encode


class Levels:
    """Open windows by fill level; says which level the next rest goes to."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.count = np.zeros(length + 1, dtype=np.int64)  # of open windows; 0 and full: none
        self.windows: list[list] = [[] for _ in range(length)]
        self.open = 0

    def level(self, size: int) -> int:
        """The level, 0 for a new window, at which adding ``size`` makes the squares least.

        Moving a window from level h to h + size changes their sum by
        2 (count[h + size] - count[h]) + 2; opening one, by 2 count[size] + 1; filling one up,
        by 1 - 2 count[h]. Of equal changes the fullest window is taken.
        """
        top = self.length - size
        change = 2 * (self.count[size : self.length + 1] - self.count[: top + 1]) + 2
        change[top] = 1 - 2 * self.count[top] if top else 0
        used = self.count[: top + 1] > 0
        change[~used] = np.iinfo(np.int64).max
        if size < self.length:
            change[0] = 2 * self.count[size] + 1
        return top - int(change[::-1].argmin())

    def place(self, piece) -> list | None:
        """Puts a piece (its size first) where ``level`` says; the window's pieces once it is full."""
        size = piece[0]
        at = self.level(size)
        window = []
        if at:
            window = self.windows[at].pop()
            self.count[at] -= 1
            self.open -= 1
        window.append(piece)
        if at + size == self.length:
            return window
        self.windows[at + size].append(window)
        self.count[at + size] += 1
        self.open += 1
        return None

    def emptied(self) -> Iterator:
        """All pieces of open windows, those of the fullest first; none is open afterwards."""
        for windows in reversed(self.windows):
            for window in windows:
                yield from window
            windows.clear()
        self.count[:] = 0
        self.open = 0


def without_padding(pieces: list, length: int = LENGTH) -> Iterator[list]:
    """Pieces (size, row, start) one after another, cut into windows and powers of two."""
    left = sum(p[0] for p in pieces)
    window, room = [], 0
    for size, row, start in pieces:
        while size:
            if not room:
                room = length if left >= length else 1 << (left.bit_length() - 1)
            part = min(size, room)
            window.append((part, row, start))
            size, start, room, left = size - part, start + part, room - part, left - part
            if not room:
                yield window
                window = []


def packed_rows(sizes: Iterator[int], length: int = LENGTH) -> Iterator[list]:
    """Sequences of pieces (size, row, start) of rows with ``sizes`` tokens."""
    levels = Levels(length)
    for row, size in enumerate(sizes):
        whole = size // length
        for k in range(whole):
            yield [(length, row, k * length)]
        if size % length:
            full = levels.place((size % length, row, whole * length))
            if full:
                yield full
        if levels.open > OPEN:
            yield from without_padding(list(levels.emptied()), length)
    yield from without_padding(list(levels.emptied()), length)


def packed(
    docs: DataFrame,
    encoder: Callable[[], Callable[[list[str]], list[bytes]]],
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    end: int = END,
) -> DataFrame:
    """A row per piece: the key, start, length, ids (little-endian, 32 bits each), doc_tokens,
    sequence_id and offset. ``encoder`` makes, in a worker, the function of ``WordIds``."""
    tail = np.array([end], dtype="<u4").tobytes()
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    kinds = [to_arrow_type(schema[0].dataType), *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 3]

    memo = docs.sparkSession.sparkContext.broadcast({})  # each worker fills its own

    def work(batches):
        if "words" not in memo.value:
            memo.value["words"] = WordIds(encoder())
        words = memo.value["words"]
        keys: dict[int, object] = {}  # of rows with pieces that are not out yet
        held: dict[int, tuple[bytes, int, int]] = {}  # ids, the first one's place, doc_tokens

        def rows() -> Iterator[int]:
            n = 0
            for batch in batches:
                data, offsets = buffers(batch.column(1))
                of = batch.column(0).to_pylist()
                for first, last in runs(offsets, PART):
                    raws = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(first, last)]
                    for value, ids in zip(of[first:last], words.of(raws), strict=True):
                        size = len(ids) // 4 + 1
                        keys[n], held[n] = value, (ids + tail, 0, size)
                        yield size
                        n += 1

        left: dict[int, int] = {}  # tokens that are not out yet
        number = TaskContext.get().partitionId() << 32
        out: list[list] = [[] for _ in schema]

        def made() -> pa.RecordBatch:
            arrays = [pa.array(v, kind) for v, kind in zip(out, kinds, strict=True)]
            for v in out:
                v.clear()
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for sequence in packed_rows(rows(), length):
            at = 0
            for size, row, start in sequence:
                raw, base, total = held[row]
                ids = raw[4 * (start - base) : 4 * (start - base + size)]
                values = (keys[row], start, size, ids, total, number, at)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
                at += size
                rest = left.get(row, total) - size
                if rest:
                    left[row] = rest
                    if rest < length <= size:  # the whole windows are out: only the rest is held
                        held[row] = (raw[4 * (start - base + size) :], start + size, total)
                else:
                    left.pop(row, None)
                    del held[row], keys[row]
            number += 1
            if len(out[0]) >= ROWS_OUT:
                yield made()
        if out[0]:
            yield made()

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(work, schema)

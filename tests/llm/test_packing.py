import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_rows import CLASHING, ROWS, documents, empty
from tokenizers import Tokenizer

from tertulia.llm import packing as K
from tertulia.llm.queries import QUERIES, word_encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(texts):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_the_library(monkeypatch):
    monkeypatch.setattr(K, "PART", 50)
    draw = random.Random(1)
    letters = [chr(c) for c in [*range(0x400), 0x958, 0x1100, 0x1161, 0x212A, 0x2028, 0xA0, 0x85]]
    letters += [" "] * 200 + ["\n", "\t", "'", ".", ",", "!", "'s", "'T", "̈"] * 20
    texts = ["".join(draw.choices(letters, k=60)) for _ in range(1500)]
    texts += ["<|endoftext|> x", "", " ", "It's A.'s b,'T. c;'re", "İ. K, ẞ!"]
    words = K.WordIds(K.file_encoder(PATH), remembered=300)
    got = []
    for at in range(0, len(texts), 40):
        got += [np.frombuffer(x, "<u4").tolist() for x in words.of([t.encode() for t in texts[at : at + 40]])]
    assert got == library(texts)


@pytest.mark.parametrize("length", [16, 64])
def test_the_level_makes_the_squares_least(length):
    draw = random.Random(length)
    levels = K.Levels(length)
    for _ in range(800):
        size = draw.randint(1, length - 1)
        counts = levels.count.copy()

        def after(level):
            n = counts.copy()
            n[level] -= level > 0
            n[level + size] += level + size < length
            return int((n[1:length] ** 2).sum())

        open_ = [0] + [h for h in range(1, length - size + 1) if counts[h]]
        at = levels.level(size)
        assert at in open_ and after(at) == min(map(after, open_))
        levels.place((size, 0, 0))
        assert levels.open == levels.count.sum() == sum(map(len, levels.windows))


def test_sequences_hold_every_token_once(monkeypatch):
    monkeypatch.setattr(K, "OPEN", 6)
    draw = random.Random(4)
    for length in (8, 64):
        sizes = [draw.choice([1, 3, length, 2 * length, draw.randint(1, 5 * length)]) for _ in range(300)]
        seen = Counter()
        for sequence in K.packed_rows(iter(sizes), length):
            total = sum(s for s, *_ in sequence)
            assert total == length or total & (total - 1) == 0
            for size, row, start in sequence:
                seen.update((row, start + i) for i in range(size))
        assert seen == Counter((r, i) for r, n in enumerate(sizes) for i in range(n))


def check(rows, texts):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for of in sequences.values():
        of.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in of])
        assert [r["offset"] for r in of] == [0, *ends[:-1].tolist()]
        assert ends[-1] <= 4096 and (ends[-1] == 4096 or ends[-1] & (ends[-1] - 1) == 0)
    ids = {t: x + [2] for t, x in zip(texts, library(texts), strict=True)}
    wanted = Counter()
    for i, t in rows_of:
        wanted.update((i, len(ids[t or ""]), k, x) for k, x in enumerate(ids[t or ""]))
    got = Counter()
    for r in rows:
        found = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(found) == r["length"]
        got.update((r["doc_id"], r["doc_tokens"], r["start"] + k, x) for k, x in enumerate(found))
    assert got == wanted


rows_of = ROWS


def test_edge_rows(spark):
    docs = documents(spark).drop(*(c for c in CLASHING if c == "size"))
    check(K.packed(docs, word_encoder).collect(), [t or "" for _, t in ROWS])
    assert K.packed(empty(spark), word_encoder).count() == 0


def test_query_digests(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op13_packing"](spark, str(tmp_path)).collect()
    ids = dict(zip(("word",), (x + [2] for x in library(["word"])), strict=True))
    whole = [r for r in rows if r["doc_id"] == 6]
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in whole] == [(0, len(ids["word"]), len(ids["word"]))]
    assert whole[0]["ids_crc32"] == zlib.crc32(np.array(ids["word"], "<u4").tobytes())
    assert {r["doc_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
